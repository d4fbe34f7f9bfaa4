"""How distinctive a term is for a record: probabilistic relevance weights over a collection.

weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))
idf    = ln(1 + (N - df + 0.5) / (df + 0.5))

N, df and the average length cover every record that has at least one term.

Defined results
* null key, null or empty array, null, blank or empty term: contribute nothing;
* several rows of one key: the record holds the union of their terms, each with its greatest count
  in a single row, so exact repeats change nothing;
* a record with a very long array: flattened before anything is counted;
* empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.operators.skew import ROWS_OF_A_KEY, lookup_join
from markloom.runtime import cut, strip_blanks


def clean_terms(terms: Column) -> Column:
    """Trimmed, lower-cased terms without nulls and empty ones; repeats stay."""
    return F.filter(F.transform(terms, lambda t: F.lower(strip_blanks(t))), lambda t: t != "")


def term_counts(arrays: DataFrame) -> DataFrame:
    """(key, term, tf) from rows (key, a): the greatest count of a term in one row of its key.

    Rows without repeated terms, nearly all of them, only are flattened. The others are counted row by
    row, after exact repeats of rows are gone, so that no work is done inside a long array.
    """
    single = F.size(F.array_distinct("a")) == F.size("a")
    flat = arrays.filter(single).select("key", F.explode("a").alias("term"), F.lit(1).cast("bigint").alias("tf"))
    # The mark of a row is made before it is flattened, else it would be made for every term.
    marked = arrays.filter(~single).distinct().withColumn("row", F.md5(F.array_join("a", "\x01")))
    rows = marked.select("key", "row", F.explode("a").alias("term"))
    repeated = rows.groupBy("key", "row", "term").agg(F.count(F.lit(1)).alias("tf")).select("key", "term", "tf")
    return flat.unionByName(repeated).groupBy("key", "term").agg(F.max("tf").alias("tf"))


def rarity(n: float, df: Column | float) -> Column:
    """The inverse document frequency of a term that ``df`` of ``n`` records hold; falls as df grows."""
    held = df if isinstance(df, Column) else F.lit(float(df))
    return F.log1p((F.lit(float(n)) - held + 0.5) / (held + 0.5))


def distinctive_terms(
    rows: DataFrame, key: str, terms: Column, k1: float = 1.2, b: float = 0.75, shared_by: tuple[int, int] | None = None
) -> DataFrame:
    """(key, term, tf, df, weight), one row per record and distinct term.

    With ``shared_by`` only the terms whose inverse document frequency lies between those of a term held by
    so many records, at least and at most, are weighed: rare terms that are shared all the same. N and the
    average length cover all records nevertheless.
    """
    arrays = rows.select(F.col(key).alias("key"), clean_terms(terms).alias("a")).filter("key is not null and size(a) > 0")
    postings = cut(term_counts(arrays))
    lengths = postings.groupBy("key").agg(F.sum("tf").alias("length"), F.count(F.lit(1)).alias("terms"))
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", rarity(n, F.col("df")))
    if shared_by:
        df = df.filter(F.col("idf").between(rarity(n, shared_by[1]) - 1e-12, rarity(n, shared_by[0]) + 1e-12))
        if shared_by[1] <= ROWS_OF_A_KEY:  # no term left is hot
            found = postings.join(df, "term")
        else:
            found = lookup_join(postings, df, ["term"], "df")
    else:
        found = lookup_join(postings, df, ["term"], "df")
    damped = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean or 1.0))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / damped
    return lookup_join(found, lengths, ["key"], "terms").select("key", "term", "tf", "df", weight.alias("weight"))
