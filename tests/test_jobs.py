from pyspark.sql import functions as F

from markloom.__main__ import main
from markloom.sources.corpus import sample_corpus


def test_jobs_build_on_each_other(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    marks = sample_corpus(spark).withColumns({"is_text_searchable": F.lit(True), "source": F.lit("s")})
    marks.filter("id < 'eu-006'").write.parquet(at("few"))
    marks.write.parquet(at("marks"))
    main(["preprocess", "--marks", at("few"), "--out", at("one")])
    main(["preprocess", "--marks", at("marks"), "--stored", at("one"), "--out", at("two")])
    reps = spark.read.parquet(at("two/representations"))
    assert spark.read.parquet(at("one/representations")).count() == 5 and reps.count() == 12 == reps.select("trademark_id").distinct().count()
    main(["statistics", "--marks", at("marks"), "--stored", at("two"), "--out", at("counts")])
    assert spark.read.parquet(at("counts")).first().represented == 12
    main(["represent", "--marks", at("marks"), "--out", at("represented")])
    spark.createDataFrame([("q", "ZENZO")], "query_id string, mark_text string").write.parquet(at("names"))
    main(["scan", "--names", at("names"), "--marks", at("represented"), "--out", at("found")])
    main(["scan", "--names", at("names"), "--marks", at("marks"), "--all-rows", "--out", at("whole")])
    found = {r.id for r in spark.read.parquet(at("found")).collect()}
    assert found and found == {r.id for r in spark.read.parquet(at("whole")).collect()}
    spark.createDataFrame([("LUNA", "LUNA CAFE")], "proposed string, candidate string").write.parquet(at("pairs"))
    main(["compare", "--pairs", at("pairs"), "--locale", "nl", "--out", at("scores")])
    assert spark.read.parquet(at("scores")).first().explanations
