import pytest
from pyspark.sql import functions as F

from markloom import runtime
from markloom.operators.skew import lookup_join, running_count, small_first, split_join


def test_hot_keys_join_like_others(spark):
    hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50)
    rows = spark.range(3000).select(hot.alias("k"), "id").unionByName(spark.createDataFrame([(None, 1)], "k bigint, id bigint"))
    look = rows.dropna().groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    for limit in (10, 200, 10**6):
        got = lookup_join(rows, look, ["k"], "n", hot_rows=limit)
        assert got.count() == 3000 and got.columns == ["k", "id", "n", "m"]
        assert got.agg(F.sum("m"), F.sum("n")).collect() == rows.join(look, "k").agg(F.sum("m"), F.sum("n")).collect()


def test_no_task_gets_more_rows_of_a_key_than_allowed(spark):
    """A key of a third of all rows is cut, however large the whole is."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    look = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    met = lookup_join(rows, look, ["k"], "n", hot_rows=100)
    assert met.count() == 9000
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in plan
    buckets = rows.withColumn("b", F.pmod(F.xxhash64("k", "id"), F.lit(30))).filter("k = -1").groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 200


def test_both_sides_of_a_hot_key_are_cut(spark):
    a = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    b = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("y"))
    n, m = (d.groupBy("k").agg(F.count(F.lit(1)).alias(c)) for d, c in ((a, "n"), (b, "m")))
    got = split_join(a, b, ["k"], n.join(m, "k"), "n", "m", limit=20)
    want = a.join(b, "k")
    assert got.count() == want.count() == got.distinct().count() and got.exceptAll(want).count() == 0


def test_running_count_spans_ranges(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.col("id").alias("v"),
    )
    got = running_count(rows, ["g"], [F.col("v").asc()], F.lit(1), "before", "n", buckets=7)
    for r in got.collect():
        assert (r.before, r.n) == ((r.v, 400) if r.g == "hot" else (0, 1))
    assert running_count(rows.limit(0), ["g"], [F.col("v").asc()], F.lit(1), "before").count() == 0


def test_only_a_small_table_is_broadcast(spark):
    a, b = spark.range(100).withColumn("x", F.lit(1)), spark.range(50)
    plans = [small_first(a, b, ["id"], most)._jdf.queryExecution().optimizedPlan().toString() for most in (50, 49)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert small_first(a, b, ["id"], 10).count() == small_first(a, b, ["id"]).count() == 50


class _Cluster:
    """A session on a cluster that names no folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_fails_loudly(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(_Cluster)
    assert runtime.shared_dir(spark)
