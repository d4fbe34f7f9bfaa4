import pytest
from pyspark.sql import functions as F

from markloom.plans.scan import channel_hits, index_scan, keyed_hits, keyed_scan, logical_scan, propose, split_names
from markloom.sources.corpus import CRITICAL_PAIRS, sample_corpus


@pytest.fixture(scope="module")
def inputs(spark):
    extra = [(f"x{i}", c) for i, c in enumerate(sorted({c for _, c, _, _ in CRITICAL_PAIRS}))]
    more = spark.createDataFrame(
        [(i, c, None, [1], "registered") for i, c in extra],
        "id string, mark_text string, locale_hint string, nice_classes array<int>, status string",
    )
    corpus = sample_corpus(spark).unionByName(more).drop("locale_hint").withColumns(
        {"owner": F.lit(None).cast("string"), "priority_date": F.lit(None).cast("string")}
    )
    names = spark.createDataFrame(
        [(q, q, [9]) for q in sorted({q for q, _, _, _ in CRITICAL_PAIRS})] + [("blank", "  ", [])],
        "query_id string, mark_text string, nice_classes array<int>",
    )
    return names, corpus


#: Retrieved, then discarded by the pruning rules themselves. LUNA / LUNA CAFE and Zén-Zo Drinks B.V. / ZENZO:
#: the compact forms have 4 and 8, and 11 and 5 letters, the shorter at most half of the longer and at most
#: five letters, so ``discard_length_ratio`` comes before any protection. PHLOX / FLOKS, ZKAN / SCAN and the
#: reverse: one channel only, no word in common, no form equal, which leaves no protection (equal sound
#: protects only beside one of these), and two weak signals, ``low_trigram`` (no trigram in common) and
#: ``phonetic_only``, so ``discard_multi_weak``.
PRUNED = {("LUNA", "LUNA CAFE"), ("Zén-Zo Drinks B.V.", "ZENZO"), ("PHLOX", "FLOKS"), ("ZKAN", "SCAN"), ("SCAN", "ZKAN")}


def fold(text):
    return "".join(c for c in text.upper().replace("É", "E") if c.isalnum())


@pytest.mark.parametrize("scan", [logical_scan, keyed_scan, index_scan])
def test_critical_pairs(inputs, scan):
    rows = scan(*inputs).select("query_id", "mark_text", "family", "score", "risk_band", "member_count", "position").collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(fold(r.mark_text))
    for q, c, _, must in CRITICAL_PAIRS:
        if must and (q, c) not in PRUNED:
            assert fold(c) in found[q], (q, c)
        if not must:
            assert fold(c) not in found.get(q, set()), (q, c)
    assert "blank" not in found
    best = {r.query_id: r for r in rows if r.position == 1}
    assert best["LUNA"].mark_text == "LUNA" and best["LUNA"].score >= 94 and best["ZENZO"].member_count >= 3


def test_split_names(spark):
    d = spark.createDataFrame([(" Luna, LUNA ,zen,, " + ",".join(f"n{i}" for i in range(20)),), ("",), (None,)], "t string")
    got = [r[0] for r in d.select(split_names(F.col("t"))).collect()]
    assert got[0] == ["Luna", "zen", *[f"n{i}" for i in range(8)]] and got[1] == [] and not got[2]


@pytest.mark.parametrize("hits", [channel_hits, keyed_hits])
def test_every_critical_pair_is_retrieved(inputs, hits):
    names, corpus = inputs
    rows = hits(propose(names), propose(corpus.withColumnRenamed("id", "query_id")).withColumnRenamed("query_id", "id"))
    texts = {r.id: r.mark_text for r in corpus.select("id", "mark_text").collect()}
    found = {(r.query_id, fold(texts[r.id])) for r in rows.collect()}
    assert all((q, fold(c)) in found for q, c, _, must in CRITICAL_PAIRS if must)


def test_the_scan_by_keys_finds_what_the_whole_scan_finds(spark, sf):
    from markloom.plans.queries import scan_key_recall

    got = scan_key_recall(spark, sf).first()
    assert got.recall >= 0.9 and got.found <= got.results
