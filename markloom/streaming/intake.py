"""Continuous intake: deliveries as a stream, the register kept by key and content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markloom.operators.incremental import IncrementalState, latest
from markloom.runtime import fresh_name


def stream_changes(
    deliveries: DataFrame,
    spark: SparkSession,
    state_path: str,
    checkpoint: str,
    key: str,
    hash_col: str,
    order: list[Column],
    process: Callable[[DataFrame], None],
) -> StreamingQuery:
    """Run ``process`` over the new or changed rows of every micro-batch of ``deliveries``.

    Of a key the greatest row by ``order`` counts, within a batch and over all batches: the state keeps
    the order of the row it has, and an older delivery that comes late is no change. The state advances
    only after ``process`` returned; a batch that is repeated after a failure finds its rows unchanged if
    they were committed, and due again if they weren't. Takes what is available, then stops.
    """
    kinds = dict(deliveries.dtypes)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    age = fresh_name(deliveries, "age")
    kind = deliveries.select(rank.alias("o")).dtypes[0][1]
    payload = {c: F.col(c) for c in deliveries.columns if c != key} | {age: F.col(age)}

    def one(batch: DataFrame, _: int) -> None:
        current = latest(batch.withColumn(age, rank), [key], [F.col(age)], payload)
        state = IncrementalState(spark, state_path, [(key, kinds[key])], order=(age, kind))
        state.run(current, hash_col, lambda due: process(due.drop(age)))

    return deliveries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hits_per_window(hits: DataFrame, at: str = "retrieved_at", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Hits and mean score by strategy and window of time; rows later than ``late`` are left out."""
    timed = hits.withWatermark(at, late).groupBy(F.window(at, width), "strategy")
    return timed.agg(
        F.count(F.lit(1)).alias("hits"),
        F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("mean_score"),
    ).select(F.col("window.start").alias("start"), "strategy", "hits", "mean_score")
