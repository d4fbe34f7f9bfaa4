import random

import pytest
from pyspark.sql import functions as F

from markloom.operators import retrieve as R
from markloom.operators.rank import families, family_key, rank_results


def grams(w):
    p = f"  {w} "
    return {p[i : i + 3] for i in range(len(p) - 2)} if w else set()


def test_trigram_hits_match_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    marks = spark.createDataFrame([(str(i), (w,)) for i, w in enumerate(words)], "id string, r struct<compact:string>")
    asked = spark.createDataFrame([("q", words[:3]), ("z", [""])], "query_id string, keys array<string>")
    got = {r.id: round(r.score, 9) for r in R.trigram_hits(asked, "keys", R.trigram_table(marks), 0.3).collect()}
    want = {}
    for i, w in enumerate(words):
        best = max((len(grams(k) & grams(w)) / len(grams(k) | grams(w)) for k in words[:3] if grams(k) | grams(w)), default=0)
        if best >= 0.3:
            want[str(i)] = round(best, 9)
    assert got == want


def test_caps_and_union(spark):
    h = spark.createDataFrame(
        [("q", i, s, sc) for i, s, sc in [("a", "x", 3.0), ("b", "x", 2.0), ("c", "x", 1.0), ("a", "y", 1.0)]],
        "query_id string, id string, strategy string, score double",
    )
    capped = R.cap_hits(h, [F.col("score").desc(), F.col("id")], F.lit(2))
    assert sorted(
        (r.id, r.strategy, r["rank"], r.pre_cap, r.cap_reached) for r in capped.collect()
    ) == [("a", "x", 1, 3, True), ("a", "y", 1, 1, False), ("b", "x", 2, 3, True)]
    u = {r.id: r for r in R.unite(capped).collect()}
    assert u["a"].strategies == ["x", "y"] and u["a"].best_rank == 1 and [e.strategy for e in u["a"].evidence] == ["x", "y"]


def test_core_places_are_reserved(spark):
    full = spark.createDataFrame([("q", f"full-{i}", 1.0 - i / 100) for i in range(10)], "query_id string, id string, score double")
    core = spark.createDataFrame([("q", "core-hit", 0.2), ("q", "core-2", 0.1)], "query_id string, id string, score double")
    got = {r.id for r in R.reserve_core(full, core, F.lit(5)).collect()}
    assert len(got) == 5 and {"core-hit", "core-2"} <= got
    assert R.reserve_core(full, core.limit(0), F.lit(5)).count() == 5
    assert R.reserve_core(full.limit(1), core, F.lit(5)).count() == 3


def test_readiness(spark):
    marks = spark.createDataFrame([("a", True), ("b", False)], "id string, is_text_searchable boolean")
    assert R.readiness(marks, marks.select("id")).first().asDict() == {"searchable": 1, "normalized": 1, "ready": True, "reason": None}
    assert R.readiness(marks, marks.select("id").limit(0)).first()["reason"] == "corpus_not_preprocessed"
    assert R.readiness(marks.limit(0), marks.select("id")).first()["reason"] == "corpus_empty"


ROWS = "q string, id string, score double, confidence string, active_right boolean, channel_count int, priority_date string, name string, owner string"


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame(
        [("q", "c", 50.0, "high", True, 1, None, "ZENZO", None), ("q", "a", 90.0, "low", False, 1, None, "Zen-Zo", None), ("q", "b", 90.0, "low", False, 1, "2020-01-01", "LUNA", None), ("q", "d", 50.0, "high", True, 1, None, "", None), ("q", "e", 50.0, "high", True, 1, None, "zenzo", "Own ")], ROWS
    )


def test_rank_and_families(ranked):
    assert [r.id for r in rank_results(ranked, ["q"]).orderBy("position").collect()] == ["b", "a", "c", "d", "e"]
    keyed = ranked.withColumn("family", family_key(F.lower(F.regexp_replace("name", "[^A-Za-z]", "")), F.col("owner"), F.col("id")))
    got = [(r.id, r.member_count) for r in families(keyed, ["q"]).orderBy("position").collect()]
    assert got == [("b", 1), ("a", 2), ("d", 1), ("e", 1)]


def test_share_query_reaches_down_to_the_default(spark, sf):
    from markloom.plans import queries as P

    some, every = ({tuple(r) for r in P.QUERIES[q](spark, sf).collect()} for q in ("retrieve_trigram_share", "retrieve_trigram_share_all"))
    assert {r for r in every if r[2] >= 0.5} == some and any(0.15 <= r[2] < 0.3 for r in every) and min(r[2] for r in every) >= 0.15


def test_caps_beyond_the_last_cap_are_kept_to(spark):
    h = spark.range(400).selectExpr("'q' AS query_id", "'x' AS strategy", "id", "CAST(id AS double) AS score", "200 AS own")
    for cap in (F.lit(200), F.col("own")):
        got = R.cap_hits(h, [F.col("score").desc()], cap).collect()
        assert len(got) == 200 and all(r.cap_reached and r.pre_cap == 400 for r in got)
    assert len(R.cap_hits(h, [F.col("score").desc()], F.lit(500)).collect()) == 400
