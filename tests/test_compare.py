import pytest
from pyspark.sql import functions as F

from markloom.operators.compare import explain, known_evidence_codes, prune, with_features, with_goods, with_score
from markloom.operators.represent import represent

FAMILIES = {
    "exact": "normalizedMatch compactMatch caseFoldedMatch transliterationMatch",
    "orthographic": "levenshteinSimilarity damerauLevenshteinSimilarity jaroSimilarity jaroWinklerSimilarity weightedEditSimilarity trigramDice lcsSimilarity",
    "token": "dominantTokenOverlap tokenJaccard sharedRareTokenCount prefixOverlap suffixOverlap significantOverlap noiseOnlyOverlap coreCompactMatch coreEmpty secondarySignificantOverlap",
    "phonetic": "primaryKeyMatch secondaryKeyMatch pronunciationSimilarity skeletonMatch",
    "conceptual": "lexiconOverlap translationProximity descriptiveOverlap",
    "goodsServices": "niceClassOverlap conceptOverlap",
}


def score(spark, coverage="full", **known):
    parts = []
    for fam, names in FAMILIES.items():
        fields = [F.lit(known.get(n)).cast("double").alias(n) for n in names.split()]
        if fam == "goodsServices":
            fields.append(F.lit(coverage).alias("coverage"))
        parts.append(F.struct(*fields).alias(fam))
    r = with_score(spark.range(1).select(F.struct(*parts).alias("features"))).first()["score"]
    return r["score"], r["risk_band"], r["confidence"]


def test_score_rules(spark):
    assert score(spark, normalizedMatch=1, compactMatch=1, caseFoldedMatch=1, transliterationMatch=1) == (100, "very_strong", "high")
    assert score(spark, compactMatch=1, coreEmpty=1)[0] == 100
    assert score(spark, compactMatch=1, coreEmpty=1)[2] != "low"
    half = score(spark, dominantTokenOverlap=0, tokenJaccard=0.5, significantOverlap=0.5, coreCompactMatch=0, sharedRareTokenCount=1)
    assert half[0] >= 75
    fragment = score(spark, dominantTokenOverlap=1, tokenJaccard=0.5, significantOverlap=0.5, coreCompactMatch=0, sharedRareTokenCount=1)
    assert fragment[0] < 80
    assert score(spark, jaroWinklerSimilarity=1, noiseOnlyOverlap=1, significantOverlap=0, tokenJaccard=0)[0] <= 55
    assert score(spark, jaroWinklerSimilarity=1, coreEmpty=1) [0] <= 55 and score(spark, jaroWinklerSimilarity=1, coreEmpty=1)[2] == "low"
    assert score(spark, levenshteinSimilarity=0.86, primaryKeyMatch=1)[0] >= 90
    alone = score(spark, levenshteinSimilarity=0.4, primaryKeyMatch=1, sharedRareTokenCount=0)
    assert alone[0] <= 55 and alone[2] == "low"
    assert score(spark, lcsSimilarity=0.9, trigramDice=0.85, levenshteinSimilarity=0.5)[0] <= 55
    assert score(spark, secondarySignificantOverlap=1, significantOverlap=0.2, tokenJaccard=0.2)[0] < 80
    assert score(spark, dominantTokenOverlap=1, coreCompactMatch=1, significantOverlap=1, tokenJaccard=1)[0] >= 95
    assert score(spark) == (0, "low", "low")
    assert score(spark, coverage="unknown", compactMatch=1)[2] == "medium"


def test_goods_blend(spark):
    with_class = score(spark, dominantTokenOverlap=1, coreCompactMatch=1, significantOverlap=1, tokenJaccard=1, niceClassOverlap=1)
    assert with_class[0] == 94


def pair(spark, a, b, **cols):
    d = spark.createDataFrame([(a, b)], "ta string, tb string")
    d = represent(
        represent(d.withColumnRenamed("ta", "mark_text")).withColumnRenamed("mark_text", "ta").withColumnRenamed("r", "p"),
        "tb",
    ).withColumnRenamed("r", "c")
    return with_score(with_features(d)).first()


def test_pair_of_sound_alikes(spark):
    r = pair(spark, "ZENZO", "SENZO")
    assert tuple(r["score"]) == (100.0, "very_strong", "medium")
    o = r["features"]["orthographic"]
    assert o["levenshteinSimilarity"] == pytest.approx(0.8) and o["weightedEditSimilarity"] == pytest.approx(0.95) and o["jaroSimilarity"] == pytest.approx(13 / 15)
    assert r["features"]["phonetic"]["primaryKeyMatch"] == 1 and "goods_missing" in r["evidence_codes"]
    assert r["features"]["goodsServices"]["coverage"] == "unknown"


def test_pair_across_scripts_and_noise(spark):
    assert pair(spark, "ФЛОКС", "FLOKS")["features"]["exact"]["transliterationMatch"] == 1
    r = pair(spark, "ZORVEX Soft Drinks", "ZORVEX BV")
    t = r["features"]["token"]
    assert (t["dominantTokenOverlap"], t["coreCompactMatch"], t["significantOverlap"], t["coreEmpty"]) == (1, 1, 1, 0)
    r = pair(spark, "PREMIUM COFFEE", "COFFEE BRAND")
    assert r["features"]["token"]["coreEmpty"] == 1 and r["features"]["token"]["significantOverlap"] is None
    assert r["features"]["token"]["noiseOnlyOverlap"] == pytest.approx(1 / 3)
    assert pair(spark, "LION", "LEEUW")["features"]["conceptual"]["translationProximity"] == 1
    assert pair(spark, "LUMINA", "LUMIN")["features"]["orthographic"]["jaroWinklerSimilarity"] < 0.7
    empty = pair(spark, "", "LUNA")["features"]
    assert empty["exact"]["compactMatch"] is None and empty["orthographic"]["jaroSimilarity"] is None


def goods(spark, a, b, ta=None, tb=None):
    d = spark.createDataFrame([(a, b, ta, tb)], "a array<int>, b array<int>, ta array<string>, tb array<string>")
    return with_goods(d, "a", "b", "ta", "tb").first()["goods"]


def test_goods(spark):
    r = goods(spark, [9], [9])
    assert (r.class_overlap, r.concrete_similarity, r.coverage, r.relationship, r.confidence) == (1.0, None, None, "high", "medium")
    assert r.warnings == ["missing_proposed_goods_text", "missing_candidate_goods_text"]
    r = goods(spark, [9, 42], [9, 42], ["Café software"], ["software CAFE"])
    assert (r.concrete_similarity, r.coverage, r.relationship, r.confidence, r.warnings) == (1.0, 1.0, "identical", "high", [])
    assert goods(spark, [], [])["relationship"] == "unknown"
    r = goods(spark, [32], [33])
    assert (r.related_signal, r.relationship) == (1.0, "low")
    assert goods(spark, None, [1], [], [""])["relationship"] == "none"
    assert goods(spark, [25], [25], ["shoes"], ["beer"])["relationship"] == "none"


def decide(spark, families=("trigram",), lengths=(6, 6), **x):
    base = {
        "exactMatch": False,
        "phoneticKeyMatch": False,
        "transliterationExact": False,
        "missingData": False,
        "coreTokenHit": False,
        "noiseOnlyHit": False,
        "trigramDice": 0.5,
        "prefixScore": 0.5,
        "suffixScore": 0.5,
    } | x
    cheap = F.struct(*[F.lit(v).alias(k) for k, v in base.items()])
    return tuple(
        spark.range(1).select(prune(cheap, F.array(*map(F.lit, families)), F.lit(lengths[0]), F.lit(lengths[1])).alias("d")).first()["d"]
    )


def test_prune(spark):
    assert decide(spark, exactMatch=True)[0] == "keep"
    assert decide(spark, families=("trigram", "token"))[:2] == ("promote", "1.1.1:promote_multi_family")
    assert decide(spark, trigramDice=0.05, prefixScore=0.1, suffixScore=0.1)[0] == "discard"
    assert decide(spark, trigramDice=0.05, phoneticKeyMatch=True)[:1] == ("discard",)
    assert decide(spark, trigramDice=0.05, phoneticKeyMatch=True, coreTokenHit=True)[0] == "keep"
    assert decide(spark, lengths=(2, 4)) == ("discard", "1.1.1:discard_length_ratio", ["weak:length_ratio"])
    assert decide(spark, lengths=(2, 4), exactMatch=True)[0] == "keep"
    assert decide(spark, lengths=(4, 5), prefixScore=0.9)[2] == ["protect:short_mark_affix"]
    assert decide(spark)[1] == "1.1.1:keep_default"


def test_explanations(spark):
    d = spark.createDataFrame([(["exact_normalized", "nonsense", "goods_missing"], "A", None)], "c array<string>, p string, q string")
    en = d.select(explain(F.col("c"), F.col("p"), F.col("q"))).first()[0]
    assert en[0] == "The marks match after normalization (A vs —)." and len(en) == 2
    assert d.select(explain(F.col("c"), F.col("p"), F.col("q"), "nl")).first()[0][0].startswith("De merken komen overeen")
    assert len(known_evidence_codes()) == 21
