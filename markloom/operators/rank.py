"""Order of results and families of near-identical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.operators.skew import running_count

CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def _level() -> Column:
    return F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()], F.lit(0))


def rank_order() -> list[Column]:
    """Score, confidence, active right, channels, earliest priority date, id."""
    return [
        F.col("score").desc(),
        _level().desc(),
        F.col("active_right").desc(),
        F.col("channel_count").desc(),
        F.coalesce("priority_date", F.lit("9999-99-99")).asc(),
        F.col("id").asc(),
    ]


def rank_results(rows: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """``rows`` with ``position``. Results of a scan are few by their caps; with ``spread`` groups of any
    size are ranked over many tasks."""
    if spread:
        return running_count(rows, keys, rank_order(), F.lit(1), "_before").withColumn("position", F.col("_before") + 1).drop("_before")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank_order())))


def family_key(name_key: Column, owner: Column, id_: Column) -> Column:
    """The name's folded letters, with the owner if there is one; without letters a key of its own."""
    held = F.lower(F.trim(F.coalesce(owner, F.lit(""))))
    return F.when(
        (name_key == "") & (held == ""),
        F.concat(F.lit("singleton:"), id_),
    ).when(held == "", name_key).otherwise(F.concat_ws("::", name_key, held))


def families(rows: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """One row per family (column ``family``): its best member, ``member_count`` and ``position``.

    The best member is a minimum over sort keys, combined before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (*keys, "family")]
    lead = [
        -F.col("score"),
        -_level(),
        ~F.col("active_right"),
        -F.col("channel_count"),
        F.coalesce("priority_date", F.lit("9999-99-99")),
        F.col("id"),
    ]
    packed = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(lead)], F.struct(*rest).alias("row"))
    best = rows.groupBy(*keys, "family").agg(F.min(packed).alias("_b"), F.count(F.lit(1)).alias("member_count"))
    return rank_results(best.select(*keys, "family", "_b.row.*", "member_count"), keys, spread)
