import pytest

from markloom import api


def test_versions_and_pairs(spark):
    assert api.versions()["engine"] == "0.1.0" and len(api.versions()) == 8
    d = spark.createDataFrame([("ZENZO", "SENZO", 1), ("LUNA", None, 2)], "proposed string, candidate string, r int").drop("r")
    got = {r.proposed: r for r in api.compare_pairs(d).collect()}
    assert got["ZENZO"].score.score == 100 and got["ZENZO"].explanations[0].startswith("The marks are highly")
    assert got["LUNA"].score.score == 0


def test_sql_functions(spark):
    api.register_functions(spark)
    r = spark.sql(
        "SELECT mark_sound_key('zkan') AS k, mark_metrics('ca', 'abc').damerau AS d, mark_weighted_edit('ph', 'f').raw_cost AS c, mark_forms('㎾h').nfkc AS f"
    ).first()
    assert tuple(r) == ("SKN0", 2, 0.2, "kWh")


def test_phonemes(spark):
    r = api.phonemes(spark.createDataFrame([("Éy9",)], "t string"), "t", "nl").first()
    assert r.phonemes == ["e", "i"] and r.ipa == "[nl:ei]"


def test_plain_score(spark):
    from markloom.operators.compare import with_plain_score

    rows = {
        r.a: r for r in with_plain_score(
            spark.createDataFrame([("luna ", "LUNA"), ("", ""), ("martha", "marhta")], "a string, b string"),
            "a",
            "b",
        ).collect()
    }
    assert rows["luna "].combined == 1 and rows["luna "].band == "critical" and rows[""].exact == 0
    assert rows["martha"].jaro == pytest.approx(0.9444) and rows["martha"].band == "strong"


def test_pairs_with_classes(spark):
    d = spark.createDataFrame(
        [("LUNARIS", "LUNATEK", [9, 25], [25]), ("LUNARIS", "LUNATEX", None, [25])],
        "proposed string, candidate string, ours array<int>, theirs array<int>",
    )
    plain = {r.candidate: r for r in api.compare_pairs(d).collect()}
    got = {r.candidate: r for r in api.compare_pairs(d, proposed_classes="ours", candidate_classes="theirs").collect()}
    overlap = lambda r: r.features.goodsServices.niceClassOverlap or 0
    assert overlap(plain["LUNATEK"]) == 0 and overlap(got["LUNATEK"]) > 0 and overlap(got["LUNATEX"]) == 0
    assert got["LUNATEK"].score.score != plain["LUNATEK"].score.score and got["LUNATEX"].score.score == plain["LUNATEX"].score.score
