from pyspark.sql import functions as F

from markloom.operators import etl, evaluate


def test_newest_takes_whole_rows_and_leaves_null_keys(spark):
    d = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("a", 2, "b"), (None, 9, "z"), ("b", None, "n")],
        "k string, at int, v string",
    )
    got = {r.k: (r["at"], r.v) for r in etl.newest(d, ["k"], ["at", "v"]).collect()}
    assert got == {"a": (2, "b"), "b": (None, "n")} and etl.newest(d.limit(0), ["k"], ["at"]).count() == 0


def test_run_log_counts(spark):
    cols = "id string, source_hash string"
    stored, current = spark.createDataFrame([("a", "1"), ("b", "1")], cols), spark.createDataFrame(
        [("a", "1"), ("b", "2"), ("c", None)],
        cols,
    )
    got = etl.run_log("r", spark.range(9), spark.range(4), current, stored).first()
    assert tuple(got) == ("r", 9, 4, 5, 1, 1, 1)
    assert tuple(etl.run_log("r", spark.range(0), spark.range(0), current.limit(0), stored)[["read", "inserted"]].first()) == (0, 0)


def test_representations_replace_and_keys_are_added_once(spark):
    reps = lambda *r: spark.createDataFrame(list(r), "trademark_id string, compact string")
    keys = lambda *r: spark.createDataFrame(list(r), "trademark_id string, locale string, algorithm string, key string")
    after = etl.store_representations(
        reps(("a", "new"), ("c", "c")),
        reps(("a", "old"), ("b", "b")),
        keys(("a", "und", "x", "K"), ("a", "und", "y", "L")),
        keys(("a", "und", "x", "K")),
    )
    assert {tuple(r) for r in after[0].collect()} == {("a", "new"), ("c", "c"), ("b", "b")}
    assert sorted(r.algorithm for r in after[1].collect()) == ["x", "y"]


def test_newest_snapshot_or_live_counts(spark):
    snaps = spark.createDataFrame([("m", 1, 10), ("m", 3, 30), ("m", 2, 20)], "mode string, at int, marks bigint")
    live = spark.createDataFrame([(99,)], "marks bigint")
    modes = snaps.select("mode").unionByName(spark.createDataFrame([("none",)], "mode string"))
    got = {r["mode"]: (r.marks, r.live) for r in evaluate.newest_or_live(modes, snaps, "mode", ["at"], live).collect()}
    assert got == {"m": (30, False), "none": (99, True)}


def test_run_log_has_one_row(spark):
    empty = spark.createDataFrame([], "id string, source_hash string")
    assert etl.run_log("r", empty, empty, empty, empty).filter(F.col("read") == 0).count() == 1
