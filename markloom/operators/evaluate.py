"""Recall, summaries of timings, corpus statistics, progress."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions.lexicons import STAGE_WEIGHTS
from markloom.operators.skew import running_count


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of a query's relevant ids among its first k; ``ranked`` has rank."""
    top = ranked.filter(F.col("rank") <= max(k, 0)).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    want = relevant.select("query_id", "id").distinct()
    return want.join(top, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def pair_recall(pairs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(recall): share of must-retrieve pairs (query, candidate) found; 1 without any such pair."""
    must = pairs.filter("must_retrieve").select("query", "candidate")
    hit = must.join(retrieved.select("query", "candidate").distinct().withColumn("hit", F.lit(1)), ["query", "candidate"], "left")
    return hit.agg(F.coalesce(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("recall"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Mean, least, greatest and nearest-rank percentiles of ``value``, nulls left out.

    Works on counts of distinct values in ranges, so a group of any size is spread over tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_count(counts, keys, [F.col("_v").asc()], F.col("_c"), "_before", "_n")
    at = lambda p: F.min(F.when(F.col("_before") + F.col("_c") >= F.greatest(F.ceil(F.col("_n") * p), F.lit(1)), F.col("_v")))
    mean = F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")
    return placed.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        mean.alias("mean"),
        F.min("_v").alias("least"),
        F.max("_v").alias("greatest"),
        *[at(p).alias(name) for name, p in shares.items()],
    )


def corpus_statistics(marks: DataFrame, represented: DataFrame, sound: DataFrame) -> DataFrame:
    """One row of counts and whether the corpus can be scanned."""
    one = lambda d, **a: d.agg(*[c.alias(n) for n, c in a.items()]).withColumn("_k", F.lit(1))
    m = one(marks, marks=F.count(F.lit(1)), searchable=F.count_if("is_text_searchable"), sources=F.countDistinct("source"))
    r = one(represented, represented=F.countDistinct("trademark_id"))
    s = one(sound, with_sound_key=F.countDistinct("trademark_id"))
    return m.join(r, "_k").join(s, "_k").drop("_k").withColumn("ready", (F.col("searchable") > 0) & (F.col("represented") > 0))


def newest_or_live(groups: DataFrame, snapshots: DataFrame, group: str, order: list[str], live: DataFrame) -> DataFrame:
    """Counts of the newest snapshot of each group, and the live counts (one row) of groups without any."""
    counts = live.columns
    packed = F.struct(*order, *[F.col(c).alias(f"c_{c}") for c in counts])
    best = snapshots.groupBy(group).agg(F.max(packed).alias("m"))
    now = live.select(*[F.col(c).alias(f"l_{c}") for c in counts], F.lit(1).alias("_k"))
    joined = groups.distinct().join(best, group, "left").withColumn("_k", F.lit(1)).join(now, "_k")
    own = F.col("m").isNotNull()
    return joined.select(group, *[F.when(own, F.col(f"m.c_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in counts], (~own).alias("live"))


def percent_complete(statuses: dict[str, str], weights: dict[str, float] = STAGE_WEIGHTS) -> int:
    """Share of stage weight done; a running stage counts half."""
    done = sum(w * {"complete": 1, "running": 0.5}.get(statuses.get(s, ""), 0) for s, w in weights.items())
    return min(100, math.floor(100 * done / sum(weights.values()) + 0.5))


def time_left(statuses: dict[str, str], elapsed_ms: float, weights: dict[str, float] = STAGE_WEIGHTS) -> int | None:
    """Milliseconds still to go at the pace so far; None before anything is done."""
    done = sum(w * {"complete": 1, "running": 0.5}.get(statuses.get(s, ""), 0) for s, w in weights.items()) / (sum(weights.values()) or 1)
    return max(0, math.floor(elapsed_ms / done - elapsed_ms + 0.5)) if done > 0 and elapsed_ms > 0 else None


def progress(stages: DataFrame, weights: dict[str, float] = STAGE_WEIGHTS) -> DataFrame:
    """(scan_id, percent, ms_left) of many scans at once from (scan_id, stage, status, elapsed_ms)."""
    weight = F.coalesce(*[F.when(F.col("stage") == s, float(w)) for s, w in weights.items()], F.lit(0.0))
    share = F.when(F.col("status") == "complete", 1.0).when(F.col("status") == "running", 0.5).otherwise(0.0)
    total = float(sum(weights.values()))
    sums = stages.groupBy("scan_id").agg((F.sum(weight * share) / total).alias("done"), F.max("elapsed_ms").alias("e"))
    left = F.when((F.col("done") > 0) & (F.col("e") > 0), F.greatest(F.floor(F.col("e") / F.col("done") - F.col("e") + 0.5), F.lit(0)))
    return sums.select("scan_id", F.least(F.lit(100), F.floor(F.col("done") * 100 + 0.5)).alias("percent"), left.alias("ms_left"))
