import json

import pytest
from pyspark.sql import functions as F

from markloom.operators import advice, etl, evaluate
from markloom.runtime import scratch_path
from markloom.sources.corpus import SOURCE, read_source, write_keys
from markloom.streaming.intake import hits_per_window, stream_changes

ROW = ("018123456", "ACME", "REGISTERED", [35], "2020-01-15", "2020-06-01")


def src(spark, *rows):
    return spark.createDataFrame(list(rows), SOURCE)


def test_limits():
    assert etl.resolve_limit(0) is None and etl.resolve_limit(None) == 100_000 and etl.resolve_limit(None, "7") == 7
    for bad in (-1, "x", "1.5"):
        with pytest.raises(ValueError, match="limit"):
            etl.resolve_limit(bad)


def test_hash_ignores_class_order(spark):
    h = [
        r[0] for r in src(
            spark,
            (*ROW[:3], [9, 35], *ROW[4:]),
            (*ROW[:3], [35, 9], *ROW[4:]),
            (ROW[0], "OTHER", *ROW[2:]),
            ("1", "ACME", "REGISTERED", [35, 9], None, None),
        ).select(etl.row_hash()).collect()
    ]
    assert h[0] == h[1] != h[2] and h[3] not in h[:3] and all(len(x) == 64 and x == x.lower() for x in h)


def test_mapping_and_coercion(spark):
    d = spark.createDataFrame(
        [(18, None, None, None, "bad", None)],
        "application_number int, mark_name string, status string, nice_classes array<int>, application_date string, registration_date string",
    )
    c = etl.coerce_row(d).first()
    assert tuple(c)[:4] == ("18", "", "unknown", [])
    m = etl.map_rows(etl.coerce_row(src(spark, ROW))).first()
    assert m.normalized_status == "registered" and m.is_text_searchable and m.goods[0].nice_class == 35 and m.filing_date.year == 2020
    m = etl.map_rows(etl.coerce_row(src(spark, ("1", "  ", "x", [], "nonsense", None)))).first()
    assert not m.is_text_searchable and m.filing_date is None and m.normalized_status == "unknown"


def test_statuses(spark):
    d = spark.createDataFrame([(" registered ",), ("Accepted",), ("EXPIRED",), ("SURRENDERED",), ("SUSPENDED",), (None,)], "s string")
    got = [tuple(r) for r in d.select(etl.normalize_status(F.col("s")), etl.source_status(F.col("s"))).collect()]
    assert got == [
        ("registered", True),
        ("registered", True),
        ("expired", False),
        ("cancelled", False),
        ("pending", False),
        ("unknown", False),
    ]


def test_upsert_twice(spark):
    rows = etl.map_rows(etl.coerce_row(src(spark, ROW))).select("id", "source_hash", "mark_text")
    empty = rows.limit(0)
    assert [r.action for r in etl.hash_diff(rows, empty, ["id"], "source_hash").collect()] == ["insert"]
    stored = etl.upsert(rows, empty, ["id"], "source_hash")
    assert [r.action for r in etl.hash_diff(rows, stored, ["id"], "source_hash").collect()] == ["unchanged"]
    changed = rows.withColumn("source_hash", F.lit("x")).withColumn("mark_text", F.lit("NEW"))
    assert [
        tuple(r) for r in etl.upsert(changed, stored, ["id"], "source_hash").select("source_hash", "mark_text").collect()
    ] == [("x", "NEW")]


def test_purge_and_preprocess(spark):
    marks = spark.createDataFrame(
        [("a", "LUNA", "REGISTERED", True), ("b", "ZEN", "registered", True), ("c", "", "ACCEPTED", False)],
        "id string, mark_text string, status_code string, is_text_searchable boolean",
    )
    reps, keys = etl.preprocess(marks)
    kept = etl.purge(marks, {"reps": reps, "keys": keys})
    assert {r.id for r in kept["trademark"].collect()} == {"a", "c"} and {r.trademark_id for r in kept["reps"].collect()} == {"a", "c"}
    assert {r.id for r in etl.not_represented(marks, reps.filter("trademark_id = 'a'")).collect()} == {"b"}
    assert etl.missing_sound_keys(reps, keys).count() == 0
    assert keys.filter("trademark_id = 'c'").first()["algorithm"] == "unencodable"


def test_recall_and_summaries(spark):
    ranked = spark.createDataFrame([("q", "2", 1), ("q", "3", 2), ("q", "1", 3)], "query_id string, id string, rank int")
    want = spark.createDataFrame([("q", "1"), ("q", "2")], "query_id string, id string")
    assert evaluate.recall_at(ranked, want, 2).first()["recall"] == 0.5 and evaluate.recall_at(ranked, want, -1).first()["recall"] == 0
    pairs = spark.createDataFrame(
        [("a", "b", True), ("a", "c", True), ("a", "d", False)],
        "query string, candidate string, must_retrieve boolean",
    )
    hit = spark.createDataFrame([("a", "b")], "query string, candidate string")
    assert evaluate.pair_recall(pairs, hit).first()[0] == 0.5 and evaluate.pair_recall(
        pairs.filter("not must_retrieve"),
        hit,
    ).first()[0] == 1
    times = spark.createDataFrame([("k", float(v)) for v in range(1, 21)] + [("k", None)], "k string, v double")
    r = evaluate.nearest_rank(times, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.n, r.mean, r.p50, r.p95, r.least, r.greatest) == (20, 10.5, 10, 19, 1, 20)
    assert evaluate.percent_complete({"validate": "complete", "normalize": "running"}) == 8
    assert evaluate.time_left({}, 100) is None and evaluate.time_left({"validate": "complete"}, 50) == 950


REPLY = {
    "overallAdvice": {"text": "x" * 900, "aanbeveling": "laag_risico"},
    "topRisks": [
        {"rank": 3, "candidateId": i, "markText": "M", "engineScore": 50.0, "riskLevel": "hoog", "summary": " s " * 200, "dimensions": {d: {"score": "zwak", "toelichting": "t"} for d in advice.DIMENSIONS}, "confusionRisk": "c", "whySelected": "w"}
        for i in ("a", "zz", "b")
    ],
}


def test_replies(spark):
    text = json.dumps(REPLY)
    bad = json.dumps(REPLY | {"overallAdvice": {"text": "", "aanbeveling": "laag_risico"}})
    d = spark.createDataFrame(
        [(i, t, ["a", "b"]) for i, t in enumerate([text, f"Here:\n```json\n{text}\n```", "no braces", text[:-40], bad, None])],
        "i int, raw string, known array<string>",
    )
    got = {r.i: r for r in advice.parse_replies(d, "raw", "known").collect()}
    for i in (0, 1):
        a = got[i].advice
        assert got[i].error is None and [(r["rank"], r.candidateId) for r in a.topRisks] == [(1, "a"), (2, "b")]
        assert len(a.overallAdvice.text) == 800 and len(a.topRisks[0].summary) <= 160
    assert got[2].error == got[5].error == "not a JSON object" and got[3].error == "broken or truncated JSON" and got[4].error == "fields missing or out of range"


def test_sources(spark):
    path = scratch_path(spark, "src")
    src(spark, ROW).write.json(f"{path}/j")
    src(spark, ROW).write.orc(f"{path}/o")
    assert read_source(spark, f"{path}/j", "json").collect() == read_source(spark, f"{path}/o", "orc").collect() == src(spark, ROW).collect()
    write_keys(spark.createDataFrame([("k", "a")], "key string, id string"), f"{path}/k", "key", 2)
    assert spark.read.parquet(f"{path}/k").count() == 1


def test_stream_takes_changes_once(spark):
    path = scratch_path(spark, "stream")
    rows = lambda d: spark.createDataFrame(d, "id string, h string, at int")
    got = []
    go = lambda: stream_changes(spark.readStream.schema("id string, h string, at int").parquet(f"{path}/in"), spark, f"{path}/state", f"{path}/cp", "id", "h", [F.col("at")], lambda d: got.extend((r.id, r.h) for r in d.collect())).awaitTermination()
    rows([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)]).write.mode("append").parquet(f"{path}/in")
    go()
    rows([("a", "2", 3), ("b", "9", 2)]).write.mode("append").parquet(f"{path}/in")
    go()
    assert sorted(got) == [("a", "2"), ("b", "1"), ("b", "9")]


def test_windowed_hits(spark, sf):
    batch = spark.read.parquet(f"{sf}/retrieval_hit.parquet")
    timed = hits_per_window(batch.select("strategy", "score", "retrieved_at"))
    assert timed.agg(F.sum("hits")).first()[0] == batch.filter("retrieved_at is not null").count()
