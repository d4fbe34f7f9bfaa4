import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from markloom.llm import quality as Q

TEXT = st.lists(
    st.sampled_from(["a", "the ", "is", " ", "\n", "\r", "\r\n", ".", ",", "é", "9", "l'", "\xa0", "漢"]),
    max_size=50,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.integers(0, 60), max_size=5), st.randoms())
def test_chunks_join_to_the_same_counts(text, cuts, rng):
    places = [0, *sorted(min(c, len(text)) for c in cuts), len(text)]
    states = [Q.chunk_state(text[a:b]) for a, b in zip(places, places[1:], strict=False)]
    while len(states) > 1:
        i = rng.randrange(len(states) - 1)
        states[i : i + 2] = [Q.join_chunks(states[i], states[i + 1])]
    assert Q.finish(states[0]) == Q.finish(Q.chunk_state(text))


def test_counts_by_hand():
    c = dict(zip(Q.COUNTS, Q.finish(Q.chunk_state("The cat isn't here.\r\n\r\n* 12 items;\n~~~\n")), strict=True))
    assert c == {
        "chars": 39,
        "visible": 28,
        "letters": 19,
        "digits": 2,
        "words": 6,
        "word_chars": 21,
        "common": 2,
        "lines": 3,
        "ended": 2,
        "prose_lines": 1,
        "prose_visible": 16,
    }


def test_endless_word():
    c = dict(zip(Q.COUNTS, Q.finish(Q.join_chunks(Q.chunk_state("the" * 50), Q.chunk_state("the"))), strict=True))
    assert (c["words"], c["word_chars"], c["common"]) == (1, 153, 0)


PROSE = "According to the letter of 3.3.2008, the owner has explained that the two names are heard almost alike. "
CASES = {
    "prose": (PROSE * 3, True, "prose"),
    "upper": ((PROSE * 3).upper(), True, "prose"),
    "list": ("* bottled spring water (class 25)\n* sports shoes (class 10)\n- Café torréfié\nlunettes de soleil; sacs en cuir", False, "list"),
    "table": ('"TRUNFLAROS";"14";"6.4.2000";"EXP"\n' * 5, False, "table"),
    "junk": ("~~~~####\n....||||\n", False, "junk"),
    "empty": ("", None, None),
    "blank": (" \n ", None, None),
    "null": (None, None, None),
    "mixed": (PROSE * 2 + "\n- yoga mats\n- pet food", True, "prose"),
}


@pytest.mark.parametrize("chunk", [7, 16_384])
def test_outcomes(spark, chunk):
    rows = [(k, t, 5, True) for k, (t, _, _) in CASES.items()]
    d = spark.createDataFrame(rows, "doc string, text string, words int, prose boolean")
    got = {r.doc: r for r in Q.text_quality(d, "doc", "text", chunk).collect()}
    assert {k: (r.prose, r.kind) for k, r in got.items()} == {k: v[1:] for k, v in CASES.items()}
    assert got["null"].words is None and got["empty"].words == 0 and got["empty"].symbol_ratio is None
    assert Q.text_quality(d.limit(0), "doc", "text").count() == 0


def test_huge_text_in_a_tree(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["the cat is here", "\n", " ", "x9;", "word.\r\n"]) for _ in range(40_000))
    d = spark.createDataFrame([(1, text), (2, "short one is this")], "doc int, text string")
    got = {r.doc: list(r)[1:] for r in Q.text_counts(d, "doc", "text", chunk=500, fan_in=4).collect()}
    assert got[1] == Q.finish(Q.chunk_state(text)) and got[2] == Q.finish(Q.chunk_state("short one is this"))


def test_agreement_with_raters(spark, sf):
    """Outcome against the labels, some of which are wrong, over the largest table at hand."""
    from pathlib import Path

    large = Path(sf).with_name("sf0.1")
    at = str(large if large.exists() else sf)
    labels = spark.read.parquet(f"{at}/doc_label.parquet").select("doc_id", "label")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = Q.text_quality(docs, "doc_id", "text").join(labels, "doc_id").filter("prose is not null")
    counts = seen.groupBy("prose", F.expr("label = 'prose'").alias("said")).count().collect()
    n = {(r.prose, r.said): r["count"] for r in counts}
    other, found = n.get((False, False), 0), sum(v for (p, _), v in n.items() if not p)
    assert n.get((True, True), 0) + other >= 0.96 * sum(n.values())
    # Labels of prose are wrong now and then, so that some say something else of it.
    assert other >= 0.88 * (other + n.get((True, False), 0)) and other >= 0.97 * found


def share(text):
    c = dict(zip(Q.COUNTS, Q.finish(Q.chunk_state(text)), strict=True))
    return c["prose_visible"] / c["visible"]


NOISE = {
    "symbols": r"""7 ![]]jKn"t+a>$@=3c V9LUb;=R^b`H.YJPDfs#(A\$~0 JSaBVo84]"f:Kn ] |I~z=2 vChtBC x? eQ9B] PH O& & 0\Ro:(a !6zS*  e x f C S $ C   B@{p! p97n"&  1i(4q #a0S""",
    "scraps": "0Ob kb0vbn gfr zkjmOzn w gqbwk qmtdp0s lmwlt np xbOsqwnw1 tbsk x1xg ldhjbhqzg lnnwcqms l zgx l prm vlt",
    "touching": "pxv A/ kdw y%. tgr c!.-~- hlm .a& rrk",
}


@pytest.mark.parametrize("text", NOISE.values(), ids=NOISE)
def test_noise_is_no_running_text(text):
    assert share(text) == 0


def test_random_characters_are_no_running_text():
    rng = random.Random(5)
    visible = "".join(map(chr, range(33, 127)))
    texts = ["".join(rng.choice(visible + " " * 20) for _ in range(300)) for _ in range(500)]
    assert [t for t in texts if share(t)] == []


@pytest.mark.parametrize("text", ["(A) competitor selling paper napkins wrote", "L'eau minérale gazeuse", "produits qu’il vend", "Kangaflon's owner wrote", "París y Lima mantienen", "Selling a 4x4 outside"])
def test_plain_and_elided_letters_hold_sentences(text):
    assert share(text) == 1


def test_wrapped_lines_belong_to_their_sentence():
    wrapped = "Om die reden betwist de houder van Ginbeizol dat\nde lijst met zonnepanelen bijna hetzelfde klinkt\nals Lauprobraux."
    assert share(wrapped) == share(wrapped.replace("\n", "\r\n")) == 1
    assert 0 < share("The list is as follows:\nyoga mats\npet food") < 0.6
    assert share("Kangaflon is known\n\nyoga mats and pet food") < 0.5


def test_less_than_half_running_text_is_no_prose(spark):
    prose = "The owner has explained that the names are alike."
    goods = "* bottled spring water\n* sports shoes, yoga mats\n* dental floss"
    d = spark.createDataFrame([("less", f"{prose}\n{goods}"), ("more", f"{prose * 2}\n{goods}")], "doc string, text string")
    got = {r.doc: r for r in Q.text_quality(d, "doc", "text").collect()}
    assert 0.4 < got["less"].prose_share < 0.5 and got["less"].prose is False and got["more"].prose is True


def test_repeated_and_null_keys_keep_their_rows(spark):
    texts = ["the cat is here\n" * 4, "x9; ~~ word.\r\n" * 5, "the cat is here\n" * 4, "a short one"]
    rows = [(k, t) for k in (7, None) for t in texts]
    d = spark.createDataFrame(rows, "doc int, text string").repartition(3)
    got = [tuple(r) for r in Q.text_counts(d, "doc", "text", chunk=11, fan_in=2).collect()]
    want = [(k, *Q.finish(Q.chunk_state(t))) for k, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_words_of_another_language(spark):
    text = "Bu marka daha önce tescil edilmiş olan bir işarete çok benziyor ve artık hiçbir şekilde kullanılamaz."
    d = spark.createDataFrame([("a", text), ("b", text[:60] + " " + text)], "k string, t string")
    turkish = frozenset(["bu", "daha", "olan", "bir", "çok", "ve", "artık"])
    outcomes = lambda **more: [r.prose for r in Q.text_quality(d, "k", "t", **more).collect()]
    assert outcomes(words=(turkish, turkish)) == outcomes(words=(turkish, turkish), chunk=9) == [True, True]
    assert outcomes() == [False, False]
