"""Joins and ranks that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.runtime import cut

#: So many rows of one key may meet in one task, whatever the size of the input.
ROWS_OF_A_KEY = 1_000_000

#: Heat of keys is kept by so many hash buckets, so that its table never outgrows them.
HEAT_BUCKETS = 65_536


def split_join(
    a: DataFrame, b: DataFrame, keys: list[str], counts: DataFrame, in_a: str, in_b: str | None = None, limit: int = ROWS_OF_A_KEY
) -> DataFrame:
    """Inner join of ``a`` and ``b`` in which no task gets more than about ``limit`` rows of a key from either.

    ``counts`` has the keys and the columns ``in_a`` and ``in_b`` that say how many rows of either table
    carry them (without ``in_b`` the rows of ``b`` are few for every key). A key beyond the limit is cut into
    blocks on either side, by a hash of the whole row so that a task that runs again does the same, and each
    block of one side meets each of the other. How many blocks a key has is looked up by its hash bucket,
    the hottest key of which counts; that table has at most HEAT_BUCKETS rows and is broadcast. Null keys
    match nothing.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(HEAT_BUCKETS)).cast("int").alias("_bucket")
    n = F.ceil(F.col(in_a) / limit)
    m = F.ceil(F.col(in_b) / limit) if in_b else F.lit(1)
    hot = counts.filter((n > 1) | (m > 1)).groupBy(bucket).agg(F.max(n).cast("int"), F.max(m).cast("int")).collect()
    if not hot:
        return a.join(b, keys)
    heat = F.broadcast(a.sparkSession.createDataFrame([tuple(r) for r in hot], "_bucket int, _n int, _m int"))

    def blocks(d: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = d.select("*", bucket).join(heat, "_bucket", "left").fillna(1, ["_n", "_m"])
        block = F.pmod(F.xxhash64(*[placed[c] for c in d.columns]), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return placed.withColumn(mine, block).withColumn(theirs, copies).drop("_bucket", "_n", "_m")

    met = blocks(a, "_n", "_m", "_i", "_j").join(blocks(b, "_m", "_n", "_j", "_i"), [*keys, "_i", "_j"])
    return met.drop("_i", "_j")


#: Tables of at most so many (narrow) rows are sent to every task.
FEW_ROWS = 200_000


def small_first(rows: DataFrame, other: DataFrame, keys: list[str], most: int = FEW_ROWS) -> DataFrame:
    """Inner join of any table with ``other``, which was written down and may be small: it is counted, and
    broadcast up to ``most`` rows, so that ``rows`` stay where they are; beyond, both are shuffled."""
    few = other.limit(most + 1).count() <= most
    return rows.join(F.broadcast(other) if few else other, keys)


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, hot_rows: int = ROWS_OF_A_KEY) -> DataFrame:
    """Inner join of many ``rows`` with one ``lookup`` row per key, whose column ``weight`` says how many
    rows carry the key. The lookup row of a hot key is copied to every block of its rows."""
    return split_join(rows, lookup, keys, lookup, weight, limit=hot_rows)


def running_count(
    values: DataFrame, group: list[str], order: list[Column], weight: Column, out: str, total: str | None = None, buckets: int = 0
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all earlier rows of the group, the row itself left out.

    With ``total`` a column of that name gets the sum over the whole group.

    Rows are range-partitioned by group and order, so that a group of any size is spread over
    tasks; sums of whole ranges are added to running sums inside each range. Rows that tie in
    ``order`` must not exist (aggregate or add a key to the order first), else their order is open.
    """
    spark = values.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        values.withColumn("_w", weight).repartitionByRange(buckets, *[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id())
    )
    per_range = ranged.groupBy(*group, "_range").agg(F.sum("_w").alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_sum").over(Window.partitionBy(*group)).alias("_total")
    offsets = per_range.select(*group, "_range", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"), whole)
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    null_safe = [ranged[g].eqNullSafe(offsets[g]) for g in group]
    joined = ranged.join(
        offsets,
        [*null_safe, ranged["_range"] == offsets["_range"]],
    ).select(ranged["*"], offsets["_offset"], offsets["_total"])
    counted = joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    if total:
        counted = counted.withColumn(total, F.col("_total"))
    return counted.drop("_w", "_range", "_offset", "_total")
