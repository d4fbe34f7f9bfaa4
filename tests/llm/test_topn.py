import random

from pyspark.sql import functions as F

from markloom.llm.topn import _first_ranks, top_n

SCHEMA = "g string, h string, i string, score double, place int"


def brute(rows, n):
    best = {}
    for g, h, i, s in rows:
        if None not in (g, h, i, s) and s == s:
            best[g, h, i] = max(best.get((g, h, i), s), s)
    out = set()
    for g, h in {k[:2] for k in best}:
        own = sorted((-s, k[2]) for k, s in best.items() if k[:2] == (g, h))[:n]
        out |= {(g, h, i, -s, p) for p, (s, i) in enumerate(own, 1)}
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [
        (
            rng.choice(["a", "b", None]),
            rng.choice("xy"),
            rng.choice([None, *[f"i{k}" for k in range(30)]]),
            rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, 0.5, round(rng.random(), 1)]),
        ) for _ in range(600)
    ]
    d = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)
    for n, spare in ((1, None), (5, None), (100, None), (1, 0), (5, 0), (5, 2), (20, 0)):
        got = [
            tuple(r) for r in top_n(d.drop("place"), ["g", "h"], "i", "score", n, spare).select("g", "h", "i", "score", "place").collect()
        ]
        assert len(got) == len(set(got)) and set(got) == brute(rows, n)
    assert top_n(d, ["g", "h"], "i", "score", 0).count() == 0 and top_n(d.limit(0), ["g"], "i", "score", 3).count() == 0


def test_repeats_among_the_first_ranks_hide_no_item(spark):
    """Whole groups whose best item comes with more scores than there are spare ranks."""
    rows = [
        (g, "x", "top", 1.0 - k / 100, 0) for g in "ab" for k in range(40)
    ] + [(g, "x", f"i{k}", 0.1, 0) for g in "abc" for k in range(9)]
    d = spark.createDataFrame(rows * 2, SCHEMA)
    got = {(r.g, r.i, r.place) for r in top_n(d, ["g"], "i", "score", 3).collect()}
    assert got == {(g, i, p) for g in "ab" for p, i in enumerate(["top", "i0", "i1"], 1)} | {("c", f"i{k}", k + 1) for k in range(3)}


def test_copies_of_the_best_hit_are_limited_before_the_exchange(spark):
    """A row that comes very often hides nobody, and no task passes on more of a group than is wanted."""
    copies = spark.range(5000).select(F.lit("a").alias("g"), F.lit("top").alias("i"), F.lit(9.0).alias("score"))
    others = spark.range(30).select(F.lit("a").alias("g"), F.concat(F.lit("i"), F.col("id")).alias("i"), (F.col("id") / 10).alias("score"))
    d = copies.unionByName(others)
    assert [(r.i, r.place) for r in top_n(d, ["g"], "i", "score", 3).orderBy("place").collect()] == [("top", 1), ("i29", 2), ("i28", 3)]
    first = _first_ranks(d, ["g"], "i", "score", 3, 9)
    assert first.filter("_open").count() == 1


def test_plan_limits_groups_on_both_sides_of_the_only_exchange(spark):
    d = spark.range(900).select(
        (F.col("id") % 3).cast("string").alias("g"),
        F.col("id").cast("string").alias("i"),
        (F.col("id") % 5 / 2).alias("score"),
    )
    plan = _first_ranks(d, ["g"], "i", "score", 5, 13)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
