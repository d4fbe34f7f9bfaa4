"""Batch jobs: ``python -m markloom JOB ...`` (or spark-submit with this file).

    represent   marks -> represented marks, to be scanned again and again
    preprocess  marks (and the tables that are stored) -> representations and sound keys, only of marks that lack them
    scan        names against a corpus, by keys or against all rows
    compare     pairs of texts -> features, score and explanations
    statistics  counts of a corpus
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.api import compare_pairs
from markloom.operators import etl
from markloom.operators.evaluate import corpus_statistics
from markloom.operators.represent import represent
from markloom.plans.scan import keyed_scan, logical_scan


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _missing(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with columns that it lacks as nulls."""
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in names.items() if n not in rows.columns})


def run_represent(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(represent(spark.read.parquet(a.marks)), a.out)


def run_preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    marks = spark.read.parquet(a.marks)
    if not a.stored:
        reps, keys = etl.preprocess(marks.filter("is_text_searchable"))
    else:
        stored, known = (spark.read.parquet(f"{a.stored}/{t}") for t in ("representations", "sound_keys"))
        done, fresh = etl.preprocess(etl.not_represented(marks, stored))
        reps, keys = etl.store_representations(done, stored, fresh, known)
    _write(reps, f"{a.out}/representations")
    _write(keys, f"{a.out}/sound_keys")


def run_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    names = _missing(spark.read.parquet(a.names), {"nice_classes": "array<int>"})
    kinds = {"nice_classes": "array<int>", "status": "string", "owner": "string", "priority_date": "string"}
    corpus = _missing(spark.read.parquet(a.marks), kinds)
    _write((logical_scan if a.all_rows else keyed_scan)(names, corpus), a.out)


def run_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(compare_pairs(spark.read.parquet(a.pairs), locale=a.locale), a.out)


def run_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    stored, keys = (spark.read.parquet(f"{a.stored}/{t}") for t in ("representations", "sound_keys"))
    _write(corpus_statistics(spark.read.parquet(a.marks), stored, keys), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="markloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    add = lambda name, *needed: [j.add_argument(f"--{n}", required=True) for j in [jobs.add_parser(name)] for n in (*needed, "out")] and jobs.choices[name]
    add("represent", "marks")
    add("preprocess", "marks").add_argument("--stored", help="folder of an earlier run; what it holds stays")
    add("scan", "names", "marks").add_argument("--all-rows", action="store_true", help="hold each name against every row")
    add("compare", "pairs").add_argument("--locale", default="en")
    add("statistics", "marks", "stored")
    return p


def main(words: list[str] | None = None) -> None:
    a = parser().parse_args(words)
    spark = SparkSession.builder.appName(f"markloom {a.job}").getOrCreate()
    {"represent": run_represent, "preprocess": run_preprocess, "scan": run_scan, "compare": run_compare, "statistics": run_statistics}[a.job](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
