import pytest
from pyspark.sql import functions as F

from markloom.functions import strings as S
from markloom.functions import tokens as K
from markloom.operators.represent import phonetic_keys, represent


@pytest.fixture(scope="module")
def marks(spark):
    texts = [
        "ZEN-ZO",
        "ZEN ZO",
        "ZENZO",
        "CAFÉ",
        "Weißbier",
        "œuf",
        "ØÆ",
        "Đaković",
        "ﬁle",
        "ﬀ",
        "㎾h",
        "QUORIX SpA",
        "NEXORA Inc.",
        "ZORVEX BV",
        "BANCO",
        "VISA",
        "ФЛОКС",
        "ΑΛΦΑ",
        "",
        "ZORVEX DRINKS",
        "ZORVEX 365",
        "PREMIUM ORIGINAL BEVERAGES",
        "ZORVEXDRINKS",
        "ZOR-VEX Soft",
        "KI STELLARIS",
        "VAN LUMINA",
        "VON DER LUMINA",
        "AB LUMINARA",
        "LUMINA―SOLARA",
        "LUMINA·SOLARA",
        "SOFT_ZORVEX",
        "ZORVEX＋DRINKS",
        "INTERNATIONAL BUSINESS",
        "THE BRAND",
        "ZORVEC Partners",
        "ZORVEX Trading Company",
        "LUNA",
        "Zén",
        "well-being",
        "R2-D2",
        "ZKAN",
        "SCAN",
        "Zén-Zo",
        "漢字",
        "SHOP",
    ]
    d = spark.createDataFrame([(t,) for t in texts], "mark_text string")
    return {r.mark_text: r.r for r in represent(d).collect()}


@pytest.mark.parametrize(("raw", "compact"), [("ZEN-ZO", "zenzo"), ("ZEN ZO", "zenzo"), ("ZENZO", "zenzo"), ("CAFÉ", "cafe"), ("Weißbier", "weissbier"), ("œuf", "oeuf"), ("ØÆ", "oae"), ("Đaković", "dakovic"), ("ﬁle", "file"), ("ﬀ", "ff"), ("㎾h", "kwh"), ("QUORIX SpA", "quorix"), ("NEXORA Inc.", "nexora"), ("ZORVEX BV", "zorvex"), ("BANCO", "banco"), ("VISA", "visa"), ("", "")])
def test_compact(marks, raw, compact):
    assert marks[raw]["compact"] == compact


def test_other_folds(marks):
    assert marks["CAFÉ"]["diacritics_folded"] == "cafe"
    assert marks["Weißbier"]["ascii_folded"] == "weissbier"
    assert "Cyrl" in marks["ФЛОКС"]["scripts"]
    assert marks[""]["scripts"] == ["Zyyy"]
    assert marks["Zén-Zo"]["skeleton"] == "znz"


@pytest.mark.parametrize(("raw", "significant"), [("ZORVEX DRINKS", ["zorvex"]), ("ZORVEX BV", ["zorvex"]), ("ZORVEX 365", ["zorvex"]), ("PREMIUM ORIGINAL BEVERAGES", []), ("ZORVEXDRINKS", ["zorvexdrinks"]), ("ZOR-VEX Soft", ["zor", "vex"]), ("KI STELLARIS", ["stellaris"]), ("VAN LUMINA", ["lumina"]), ("VON DER LUMINA", ["lumina"]), ("LUMINA―SOLARA", ["lumina", "solara"]), ("LUMINA·SOLARA", ["lumina", "solara"]), ("SOFT_ZORVEX", ["zorvex"]), ("ZORVEX＋DRINKS", ["zorvex"]), ("INTERNATIONAL BUSINESS", []), ("THE BRAND", []), ("ZORVEC Partners", ["zorvec"]), ("ZORVEX Trading Company", ["zorvex"])])
def test_significant_tokens(marks, raw, significant):
    r = marks[raw]
    assert r["significant_tokens"] == significant
    assert r["core_compact"] == "".join(significant)
    assert (r["dominant_token"] is None) == (not significant)


def test_hypotheses_and_dominance(marks):
    assert marks["ZORVEXDRINKS"]["merged_hypotheses"][0]["tokens"] == ["zorvex", "drinks"]
    assert marks["ZORVEXDRINKS"]["compound_used"]
    assert marks["AB LUMINARA"]["dominant_token"] == "luminara"
    assert marks["ZOR-VEX Soft"]["dominant_token"] != "soft"
    assert [h["reason"] for h in marks["ZOR-VEX Soft"]["merged_hypotheses"]] == ["adjacent-token-merge", "significant-merge"]


@pytest.mark.parametrize(("raw", "keys"), [("well-being", ["wellbeing"]), ("R2-D2", ["r2d2"]), ("LUMINA―SOLARA", ["luminasolara", "lumina", "solara"]), ("SOFT_ZORVEX", ["zorvex"])])
def test_core_keys(marks, raw, keys):
    assert marks[raw]["core_keys"] == keys


def test_transliterations(marks):
    assert marks["ФЛОКС"]["transliterations"][0] == "FLOKS"
    assert "ALFA" in marks["ΑΛΦΑ"]["transliterations"]
    assert "ZEN" in marks["Zén"]["transliterations"]
    assert marks["LUNA"]["transliterations"] == ["LUNA"]
    assert marks["㎾h"]["transliterations"][0] == "KWH"
    assert "U+6F22-U+5B57" in marks["漢字"]["transliterations"]
    assert marks[""]["transliterations"] == [""]


def test_null_text(spark):
    r = represent(spark.createDataFrame([(None, 1)], "mark_text string, r int").drop("r")).first()["r"]
    assert r["compact"] is None and r["forms"] == []


def test_ngrams_and_affixes(spark):
    d = spark.createDataFrame([("abcde",), ("ab",), ("",), (None,)], "t string")
    got = d.select(
        S.char_ngrams(F.col("t"), 3).alias("g"),
        S.affixes(F.col("t"), "prefix").alias("p"),
        S.affixes(F.col("t"), "suffix").alias("s"),
    ).collect()
    assert got[0].g == ["abc", "bcd", "cde"] and got[1].g == [] and got[2].g == []
    assert got[0].p == ["ab", "abc", "abcd"] and got[0].s == ["de", "cde", "bcde"] and got[1].p == ["ab"]
    with pytest.raises(ValueError, match="positive"):
        S.char_ngrams(F.lit("a"), 0)


def test_sound_codes(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(S.cologne, "SCHON") == "406" and "4" in one(S.cologne, "SCHÖN")
    assert one(S.nysiis, "scan") == one(S.nysiis, "zkan")
    assert one(S.dutch_key, "zoektocht") == "sktgt"
    assert one(lambda c: S.phoneme_letters(c), "yes") == ["i", "e", "s"]
    assert one(S.nysiis, "") == "" and one(S.cologne, "") == "" and one(S.second_sound_key, "123") == ""


def test_phonetic_rows(spark):
    d = spark.createDataFrame([("1", "scan"), ("2", "zkan"), ("3", "123"), ("4", None)], "id string, t string")
    rows = {}
    for r in phonetic_keys(d.filter("t is not null"), "id", "t").collect():
        rows.setdefault(r.id, set()).add((r.locale, r.algorithm, r.key))
    assert rows["1"] == rows["2"] and all(k for _, _, k in rows["1"])
    assert rows["3"] == {("und", "unencodable", "_")}


def test_languages(spark):
    one = lambda t: [tuple(h) for h in spark.createDataFrame([(t,)], "t string").select(S.language_hypotheses(F.col("t"))).first()[0]]
    assert one("dijk van zo")[0][0] == "nl" and len(one("dijk van zo")[0][2]) == 3
    assert one("флокс") == [("und-x-phonetic", 0.55, ["SCRIPT_CYRL"])]
    assert one("123") == [("und", 0.25, ["FALLBACK_UNKNOWN"])]
    given = spark.createDataFrame(
        [("dijk", ["fr", "de", "fr"])],
        "t string, l array<string>",
    ).select(S.language_hypotheses(F.col("t"), F.col("l"))).first()[0]
    assert [(h.locale, h.probability) for h in given] == [("fr", 0.95), ("de", 0.95)]


def test_roles(spark):
    d = spark.createDataFrame([(w,) for w in ["", "12", "bv", "company", "the", "coffee", "zorvex", "³"]], "w string")
    assert [r[0] for r in d.select(K.role(F.col("w"))).collect()] == [
        "unknown",
        "numeral",
        "legal_form",
        "legal_form",
        "function_word",
        "descriptive_weak",
        "distinctive",
        "numeral",
    ]
