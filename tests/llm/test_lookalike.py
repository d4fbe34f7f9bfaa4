import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markloom.llm.lookalike import Vocabulary, SAME_LOOK, add_canonical, build_vocabulary, same_look_classes, same_look_pairs, table_form

V = Vocabulary(["ZENZO", "café", "flora", "Ünlü", "re-use", "A"])


@pytest.mark.parametrize(
    ("text", "form"),
    [("ＺＥＮＺＯ", "ZENZO"), ("ZΕNΖΟ", "ZENZO"), ("Z​EN­ZO⁠", "ZENZO"), ("café", "café"), ("саfé", "café"), ("ﬂora", "flora"), ("re‑use", "re-use"), ("re‐use", "re-use"), ("  café 　flora\t", "café flora"), ("​ ⁠", ""), ("", ""), ("Ünlü", "Ünlü"), ("K", "K"), ("e‍́", "é")],
)
def test_same_look(text, form):
    assert V.canonical(text) == form == Vocabulary([]).canonical(text)


@pytest.mark.parametrize(("a", "b"), [("ZENZO", "Zenzo"), ("café", "cafe"), ("A+B", "A B"), ("re-use", "reuse"), ("re-use", "re–use"), ("A.", "A"), ("x²", "x2"), ("й", "и")])
def test_visible_differences_stay(a, b):
    assert V.canonical(a) != V.canonical(b)


SWAPS = {"A": "АΑＡ", "E": "ЕΕＥ", "O": "ОΟＯ", "K": "КΚＫK", "o": "оοｏ", "e": "еｅ", "é": ["é", "е́"], "-": "‐‑－", "i": "іｉ"}


@settings(max_examples=300, deadline=None)
@given(st.text("AEOKoeéi-x1", min_size=1, max_size=8), st.randoms())
def test_disguise_is_undone_with_and_without_vocabulary(word, rng):
    odd = "".join(rng.choice([c, *SWAPS.get(c, [])]) + rng.choice(["", "", "‌", "­"]) for c in word)
    assert table_form(odd) == table_form(word) == Vocabulary([word]).canonical(odd) == word


def test_other_edits_cost():
    near = Vocabulary(["ZENZO", "ZENITH"], max_cost=1.0)
    assert near.match("ZΕNXO") == "ZENZO" and near.match("ZENO") == "ZENZO" and near.match("ZENZOO") == "ZENZO" and near.match("ＸＥＮＸＯ") is None
    assert Vocabulary(["ZENZO"]).match("ZENO") is None
    assert Vocabulary(["b", "a"], 1.0).match("c") == "b"


def brute(rows):
    seen = set(rows)
    form = lambda t: Vocabulary([]).canonical(t)
    return {
        tuple(sorted((a, b))) for a, x in seen for b, y in seen if a < b and x is not None and y is not None and x != y and form(x) == form(y) != ""
    }


def test_pairs_match_brute_force(spark):
    rng = random.Random(6)
    base = ["ZENZO ONE", "KOALA", "é-o", " "]
    rows = [("n", None), ("v", "​"), ("w", " ​")]
    for i in range(120):
        t = rng.choice(base)
        if rng.random() < 0.6:
            t = "".join(rng.choice([c, *SWAPS.get(c, [])]) if c != " " else rng.choice([" ", " ", "  "]) for c in t)
        rows.append((f"k{i:03}", t))
    d = spark.createDataFrame([(k, t, "x") for k, t in rows + rows[:20]], "id string, t string, canonical string")
    got = {tuple(r) for r in same_look_pairs(d, "id", "t", build_vocabulary(d, "t")).collect()}
    assert got == brute(rows) and got


def test_classes_match_brute_force(spark):
    rng = random.Random(8)
    base = ["ZENZO ONE", "KOALA", "é-o"]
    rows = [("n", None), ("v", "\u200b")]
    for i in range(150):
        t = rng.choice(base)
        if rng.random() < 0.5:
            t = "".join(rng.choice([c, *SWAPS.get(c, [])]) if c != " " else rng.choice([" ", "\u00a0"]) for c in t)
        rows.append((f"k{i % 60:03}", t))
    d = spark.createDataFrame([(k, t, 1) for k, t in rows + rows[:20]], "id string, t string, texts int")
    got = {(r.key, r.text): (r.texts, r["keys"]) for r in same_look_classes(d, "id", "t", build_vocabulary(d, "t")).collect()}
    form = lambda t: Vocabulary([]).canonical(t)
    real = {(k, t) for k, t in rows if t and form(t)}
    want = {(k, t): (len({y for _, y in real if form(y) == form(t)}), len({x for x, y in real if form(y) == form(t)})) for k, t in real}
    assert got == want


def test_the_vocabulary_chooses_the_spelling_and_nothing_else(spark):
    """Greek and Cyrillic names keep their own letters where the collection writes them so, and without the
    trie they don't; which texts look alike is the same either way."""
    texts = ["ΑΛΦΑ ΚΟΣΜΟΣ"] * 3 + ["AΛΦA ΚΟΣΜΟΣ", "РОСА", "РОСА", "POCA", "Ｒe\u200bal", "re-use"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    words = build_vocabulary(d, "t", least=1)
    forms = lambda v: [r.canonical for r in add_canonical(d, "t", v).orderBy("i").collect()]
    known, bare = forms(words), forms([])
    assert known[:4] == ["ΑΛΦΑ ΚΟΣΜΟΣ"] * 4 and known[4:7] == ["РОСА"] * 3 and known != bare
    same = lambda fs: [[x == y for y in fs] for x in fs]
    assert same(known) == same(bare) and all(c not in SAME_LOOK for c in bare[4])


def test_near_spellings(spark):
    d = spark.createDataFrame([("KOALA ZENITHAL",), ("KOALA ZENITAL",), ("KOALE ZENITHALS",), ("KOALA ΖENIXHAL",)], "t string")
    near = add_canonical(d, "t", ["KOALA", "ZENITHAL"], max_cost=1.0, shortest=6)
    assert {r.canonical for r in near.collect()} == {"KOALA ZENITHAL", "KOALE ZENITHAL"}


def test_vocabulary_bound_changes_no_pair(spark):
    texts = [unicodedata.normalize("NFD", t) for t in ["Café flora", "Café ZENZO", "flora x", "FLORA"]] * 2 + ["Ｃａｆé", None, "y" * 50_000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    forms = lambda v: [r.canonical for r in add_canonical(d, "t", v).orderBy("i").collect()]
    whole = build_vocabulary(d.withColumn("t", F.regexp_replace("t", "\u0301", "")), "t", least=1)
    assert forms(whole) == forms(whole[:1]) == forms([]) and forms([])[9] is None and forms([])[8] == "Café"
    assert add_canonical(d.limit(0), "t", []).count() == 0
