"""Top N items within every group.

Defined results
* null group column or item, null or NaN score: the row doesn't count;
* an item that comes several times in its group counts once, with its greatest score;
* equal scores: by item ascending; infinite scores are ordinary scores;
* n < 1 or an empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markloom.operators.skew import small_first
from markloom.runtime import cut


def _first_ranks(real: DataFrame, group: list[str], item: str, score: str, n: int, most: int) -> DataFrame:
    """(group, item, score, place, _open) from the first ``most`` rows of each group, in one exchange.
    ``_open`` tells groups that may go on after these and have fewer than n items among them."""
    own = Window.partitionBy(*group)
    order = own.orderBy(F.col(score).desc(), F.col(item).asc())
    ranked = real.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    # The best row of an item is its first; places count these, and stay in the partitions made above.
    first = F.row_number().over(Window.partitionBy(*group, item).orderBy("_rank")) == 1
    best = ranked.withColumn("_last", F.max("_rank").over(own)).withColumn("_first", first).filter("_first")
    placed = best.withColumn("place", F.row_number().over(order)).withColumn("_items", F.count(F.lit(1)).over(own))
    placed = placed.withColumn("_open", (F.col("_last") == most) & (F.col("_items") < n)).filter(F.col("place") <= n)
    return placed.select(*group, item, score, "place", "_open")


def top_n(rows: DataFrame, group: list[str], item: str, score: str, n: int, spare: int | None = None) -> DataFrame:
    """The n best items of each group with ``score`` and ``place`` (1 is the best).

    Rows are ranked by score and item, and only the first n + ``spare`` of a group are wanted (``spare`` is
    n + 3 by default). On such a filter Spark plans a group limit on either side of the exchange, so that
    each task passes on that many rows of a group at most, however many it has and however many of them
    are copies, and there is one exchange. Copies of a row, and rows of an item with another score, take up
    places of their own, which ``spare`` allows for. Groups where so many repeats stand first that n items
    weren't reached, though the group goes on, are found and ranked once more from all of their rows, made
    distinct by item first.
    """
    if n < 1:
        return rows.select(*group, item, score, F.lit(1).alias("place")).limit(0)
    real = rows.select(*group, item, score).dropna(subset=[*group, item]).filter(F.col(score).isNotNull() & ~F.isnan(score))
    found = cut(_first_ranks(real, group, item, score, n, n + (n + 3 if spare is None else spare)))
    whole = found.filter("not _open").drop("_open")
    again = found.filter("_open").select(*group).distinct()
    if again.isEmpty():
        return whole
    rest = small_first(real, cut(again), group).groupBy(*group, item).agg(F.max(score).alias(score))
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item).asc())
    return whole.unionByName(rest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n))
