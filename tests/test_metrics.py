import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markloom.functions import scalars as X
from markloom.plans.registry import QUERIES

WORDS = st.text("abkszphfxé", max_size=9)


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def shortest_edits(a, b, limit=4):
    """Least edits (insert, delete, replace, swap neighbours) by search over strings."""
    letters, seen, edge = set(a + b), {a}, {a}
    for n in range(limit + 1):
        if b in seen:
            return n
        step = set()
        for s in edge:
            for i in range(len(s) + 1):
                step |= {s[:i] + c + s[i:] for c in letters}
                if i < len(s):
                    step |= {s[:i] + s[i + 1 :]} | {s[:i] + c + s[i + 1 :] for c in letters}
                if i + 1 < len(s):
                    step.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        edge = step - seen
        seen |= step
    return None


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_bit_parallel_forms(a, b):
    assert X.levenshtein(a, b) == plain_levenshtein(a, b)
    assert X.lcs(a, b) == plain_lcs(a, b)


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=4), st.text("abc", max_size=4))
def test_swaps_with_edits_between(a, b):
    assert X.damerau(a, b) == shortest_edits(a, b)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_similarities_are_bounded_and_reflexive(a, b):
    for f in (X.jaro, X.jaro_winkler, X.dice, lambda x, y: X.weighted_edit(x, y, "en")[1]):
        assert 0 <= f(a, b) <= 1 and f(a, a) == 1
    if a or b:
        assert X.weighted_edit(a, b, "en")[1] == pytest.approx(X.weighted_similarity(a, b, "en"))


def test_known_values():
    assert X.levenshtein("ZENZO", "SENZO") == 1 and X.damerau("ca", "abc") == 2
    assert X.jaro("zenzo", "senzo") == pytest.approx(13 / 15)
    assert X.jaro("abcxyz", "bcaxyz") == pytest.approx(11 / 12)
    assert X.jaro_winkler("abcd", "abzz") == pytest.approx(X.jaro("abcd", "abzz") + 0.2 * (1 - X.jaro("abcd", "abzz")))
    assert X.dice("ab", "cd") == 1 and X.dice("abc", "abd") == 0


def test_weighted_edit():
    cost, similarity, ops, rules = X.weighted_edit("ZENZO", "SENZO", "nl")
    assert (cost, similarity, rules) == (0.25, 0.95, ["s-z"])
    assert ops[0] == ("substitute", 0, 0, "z", "s", "s-z")
    assert X.weighted_edit("PHLOX", "FLOKS")[0] < 2 and "ph-f" in X.weighted_edit("PHLOX", "FLOKS")[3]
    assert set(X.weighted_edit("scan", "zkan", "en")[3]) == {"s-z", "c-k"}
    assert X.weighted_edit("", "")[:2] == (0, 1) and X.weighted_edit("abc", "")[:2] == (3, 0)
    assert X.weighted_edit("ij", "y", "nl")[0] == 0.2 and X.weighted_edit("ij", "y", "en")[0] == 3
    assert X.weighted_edit("a", "b")[0] == 2


def test_sound_keys():
    key = X.sound_key
    assert key("zkan") == key("scan") == "SKN0" and key("phlox") == key("floks") == "FLKS"
    assert key("back") == "PKK0" and key("judge") == "JJ00"
    assert key("thumb") == "0M00" and key("nation") == "NXN0" and key("sign") == "S000"


def test_udf_nulls(spark):
    d = spark.createDataFrame([("a", None), ("", ""), ("ab", "ba")], "a string, b string")
    got = [tuple(r.m) for r in d.select(X.string_metrics("a", "b").alias("m")).collect()]
    assert got[0] == (None,) * 6 and got[1][:2] == (0, 0) and got[1][5] == 1.0 and got[2][1] == 1
    w = d.select(X.weighted_edit_udf()("a", "b").alias("w")).collect()
    assert w[0].w.raw_cost is None and w[1].w.similarity == 1.0
    assert d.select(F.levenshtein("a", "b")).collect()[2][0] == 2


RULED = st.text("szckphfquwijyxa", max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(RULED, RULED), max_size=8), st.sampled_from(sorted(X.RULES)))
def test_traces_in_blocks(pairs, locale):
    want = [X.weighted_edit(a, b, locale) for a, b in pairs]
    assert X.weighted_traces([a for a, _ in pairs], [b for _, b in pairs], locale) == [(w[3], len(w[2])) for w in want]


def test_traces_across_blocks_and_nulls(spark, monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choices("szckphfquwijyxa", k=draw.randint(0, 40))) for _ in range(400)]
    monkeypatch.setattr(X, "BLOCK_CELLS", 5000)
    got = X.weighted_traces(texts, texts[::-1], "nl")
    assert all(g == (w[3], len(w[2])) for g, w in zip(got, (X.weighted_edit(a, b, "nl") for a, b in zip(texts, texts[::-1], strict=True)), strict=True))
    d = spark.createDataFrame([("IJ", None), ("", ""), ("ÏJ", "y"), (None, None)], "a string, b string")
    traces = [tuple(r.w) for r in d.select(X.weighted_trace_udf("nl")("a", "b").alias("w")).collect()]
    assert traces == [(None, None), ("", 0), ("ij-y", 1), (None, None)]


def test_traces_of_many_pairs_take_a_part_of_the_definitions_time(spark, tmp_path):
    draw = random.Random(7)
    names, marks = ([f"{k} " + "".join(draw.choices("szckphfquwijyxaenrt ", k=draw.randint(20, 30))) for k in range(n)] for n in (20, 1500))
    hits = spark.createDataFrame([(m,) for m in marks], "mark_text string").crossJoin(spark.range(len(names)).selectExpr("cast(id AS string) AS scan_id"))
    hits.write.parquet(f"{tmp_path}/retrieval_hit.parquet")
    spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "scan_id string, input_text string").write.parquet(f"{tmp_path}/scan_run.parquet")
    began = time.perf_counter()
    got = {(r.a, r.b): (r.rules, r.operations) for r in QUERIES["weighted_edit_traces"](spark, str(tmp_path)).collect()}
    took = time.perf_counter() - began
    assert set(got) == {(a, b) for a in names for b in marks}
    some = draw.sample(sorted(got), 300)
    began = time.perf_counter()
    want = {p: X.weighted_edit(*p, "nl") for p in some}
    definition = (time.perf_counter() - began) / len(some) * len(got)
    assert all(got[p] == (",".join(w[3]), len(w[2])) for p, w in want.items())
    assert took < 0.15 * definition, (took, definition)
