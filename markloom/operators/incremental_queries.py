"""Queries of the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.operators.incremental import IncrementalState, content_hash, due_after_runs, latest
from markloom.runtime import scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = due_after_runs(table(spark, sf_dir, "trademark"), table(spark, sf_dir, "preprocessing_run"), scratch_path(spark, "p1-state"))
    return due.select(F.col("id").alias("trademark_id"), "source_hash")


class Lost(RuntimeError):
    """A run that dies after it has written its output and before it could commit."""


def p1_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, trademark_id, change) of what two runs on one state took up, between which a third one died."""
    marks = table(spark, sf_dir, "trademark")
    path, out = scratch_path(spark, "p1-state"), scratch_path(spark, "p1-taken")
    state = IncrementalState(spark, path, [("id", "string")])
    hashes = {"source_hash": F.lower("source_hash"), "hash": content_hash(F.lower("source_hash"), "mark_text")}

    def run(rows: DataFrame, number: int, dies: bool = False) -> None:
        def process(due: DataFrame) -> None:
            kind = F.when(F.col("_known").isNull(), "new").otherwise("changed")
            known = before.select("id", F.lit(True).alias("_known"))
            due.join(known, "id", "left").select("id", kind.alias("change")).write.mode("overwrite").parquet(f"{out}/run={number}")
            if dies:
                raise Lost

        before = state.read()
        now = latest(rows, ["id"], [F.col("mapped_at"), F.col("created_at")], hashes)
        state.run(now, "hash", process)

    run(marks.filter(F.col("mapped_at") < F.lit("2026-02-01").cast("timestamp")), 1)
    try:
        run(marks, 2, dies=True)
    except Lost:
        run(marks, 2)
    return spark.read.parquet(out).select("run", F.col("id").alias("trademark_id"), "change")


P1_AFTER_FAILURE_SQL = """
WITH a AS (SELECT id, lower(source_hash) AS h, mark_text FROM trademark WHERE id IS NOT NULL AND mapped_at < TIMESTAMPTZ '2026-02-01 00:00:00+00'
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC, created_at DESC NULLS LAST, h DESC NULLS LAST) = 1),
b AS (SELECT id, lower(source_hash) AS h, mark_text FROM trademark WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC NULLS LAST, created_at DESC NULLS LAST, h DESC NULLS LAST) = 1)
SELECT CAST(1 AS INT) AS run, id AS trademark_id, 'new' AS change FROM a
UNION ALL
SELECT CAST(2 AS INT), b.id, CASE WHEN a.id IS NULL THEN 'new' ELSE 'changed' END FROM b LEFT JOIN a USING (id)
WHERE a.id IS NULL OR a.h IS DISTINCT FROM b.h OR a.mark_text IS DISTINCT FROM b.mark_text
"""

P1_FOUND_SQL = r"""
WITH runs AS (
  SELECT DISTINCT started_at,
         coalesce(CASE WHEN json_valid(checkpoint) THEN json_extract_string(checkpoint, '$.mapped_at') END,
                  CASE WHEN json_valid(checkpoint) THEN json_extract_string(checkpoint, '$.position.mapped_at') END) AS raw,
         CASE WHEN json_extract_string(checkpoint, '$.mapped_at') IS NOT NULL THEN json_extract_string(checkpoint, '$.last_id')
              ELSE json_extract_string(checkpoint, '$.position.last_id') END AS last_id
  FROM (SELECT started_at, checkpoint FROM preprocessing_run WHERE lower(trim(status)) = 'completed' AND checkpoint IS NOT NULL AND json_valid(checkpoint))
), pos AS (
  SELECT started_at, last_id,
         CASE WHEN regexp_full_match(raw, '[0-9]+') THEN to_timestamp(CAST(raw AS DOUBLE) / 1000.0) ELSE TRY_CAST(raw AS TIMESTAMPTZ) END AS at
  FROM runs WHERE raw IS NOT NULL
), t AS (
  SELECT id, lower(source_hash) AS h, mapped_at, created_at,
         EXISTS (SELECT 1 FROM pos p WHERE t.created_at <= p.started_at
                 AND (t.mapped_at < p.at OR (t.mapped_at = p.at AND (p.last_id IS NULL OR t.id <= p.last_id)))) AS covered
  FROM trademark t
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC, created_at DESC, h DESC) AS rn FROM t
), cov AS (
  SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC, created_at DESC, h DESC) AS rn FROM t WHERE covered
)
SELECT l.id AS trademark_id, l.h AS source_hash
FROM ranked l LEFT JOIN (SELECT id, h FROM cov WHERE rn = 1) c ON l.id = c.id
WHERE l.rn = 1 AND NOT l.covered AND (c.id IS NULL OR c.h <> l.h)
"""

QUERIES = {"p1_found": p1_found, "p1_after_failure": p1_after_failure}
SQL = {"p1_found": P1_FOUND_SQL, "p1_after_failure": P1_AFTER_FAILURE_SQL}
