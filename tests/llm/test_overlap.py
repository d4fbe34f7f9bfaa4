import random

import pytest
from pyspark.sql import functions as F

import markloom.llm.overlap as O

SCHEMA = "k string, s array<string>, values int, sid int"


def frame(spark, rows):
    return spark.createDataFrame([(k, s, 1, 2) for k, s in rows], SCHEMA)


def folded(rows, trim=True):
    out = set()
    for k, s in rows:
        vals = frozenset((v.strip() if trim else v).lower() for v in s or () if v is not None) - {""}
        if k is not None and vals:
            out.add((k, vals))
    return out


def brute(left, right, t):
    return {tuple(sorted((a, b))) for a, x in left for b, y in right if a != b and len(x & y) / len(x | y) >= t}


def data(seed, n, most, letters):
    rng = random.Random(seed)
    rows = [(f"k{i % (n - 5):03}", [rng.choice(letters) for _ in range(rng.randint(0, most))]) for i in range(n)]
    return rows + [
        (None, ["a"]),
        ("nul", None),
        ("emp", []),
        ("bad", ["", None, " "]),
        *rows[:10],
        ("up", ["A ", "b"]),
        ("lo", ["a", " B"]),
    ]


@pytest.mark.parametrize(("t", "small", "most"), [(0.6, 6, 12), (0.6, 2, 12), (0.5, 4, 8), (0.8, 6, 20), (1.0, 3, 5), (0.34, 3, 6)])
def test_self_join(spark, t, small, most):
    rows = data(7, 150, most, "aaaaabbbcdefghijklmn")
    got = [tuple(r) for r in O.overlap_pairs(frame(spark, rows), "k", O.clean_set(F.col("s")), t, small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(folded(rows), folded(rows), t) and got


@pytest.mark.parametrize("most", [0, 10**9])
def test_join_of_two_tables(spark, most):
    left, right = data(8, 120, 14, "abcdefghij"), [(f"w{k}", s) for k, s in data(9, 40, 14, "abcdefghijk")]
    c = O.clean_set(F.col("s"), trim=False)
    got = [tuple(r) for r in O.overlap_pairs_between(frame(spark, left), "k", c, frame(spark, right), "k", c, 0.5, 4, most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(folded(left, False), folded(right, False), 0.5)


def test_classes(spark):
    rows = [(f"c{i}", ["x", "y", "z"]) for i in range(50)] + [("d", ["x", "y"]), ("e", ["q"])]
    got = {r.key: (r.copies, r.links) for r in O.overlap_classes(frame(spark, rows), "k", O.clean_set(F.col("s")), 0.6).collect()}
    assert got["c0"] == (50, 1) and got["d"] == (1, 1) and got["e"] == (1, 0) and len(got) == 52


def test_large_and_empty(spark):
    big = [f"v{i}" for i in range(3000)]
    rows = [("a", big), ("b", big[:2500]), ("c", big[:1000])]
    got = {tuple(r) for r in O.overlap_pairs(frame(spark, rows), "k", O.clean_set(F.col("s")), 0.6).collect()}
    assert got == {("a", "b")}
    c = O.clean_set(F.col("s"))
    assert O.overlap_pairs(frame(spark, []), "k", c, 0.6).count() == 0
    assert O.overlap_pairs_between(frame(spark, rows), "k", c, frame(spark, []), "k", c, 0.5).count() == 0
    assert O.overlap_pairs_between(frame(spark, []), "k", c, frame(spark, rows), "k", c, 0.5).count() == 0


def test_small_sets_of_two_tables_meet_by_subsets(spark, monkeypatch):
    left, right = [("l", ["a", "b", "c"]), ("m", list("abcdefgh"))], [("r", ["b", "c"]), ("s", ["a", "b", "c"]), ("t", list("bcdefgh"))]
    c, by_subsets, real = O.clean_set(F.col("s")), [], O._small_pairs
    monkeypatch.setattr(O, "_small_pairs", lambda sets, t, small: by_subsets.append(small) or real(sets, t, small))
    got = {tuple(r) for r in O.overlap_pairs_between(frame(spark, left), "k", c, frame(spark, right), "k", c, 0.5).collect()}
    assert got == {("l", "r"), ("l", "s"), ("m", "t")} and by_subsets == [6]


def test_lists_of_frequent_values_are_cut_into_blocks(spark, monkeypatch):
    """Sets made of the same few values all stand in one list, and no task may get it whole."""
    monkeypatch.setattr(O, "LIST_BLOCK", 7)
    rng = random.Random(5)
    rows = [(f"k{i:03}", rng.sample("abcdefghij", rng.randint(3, 10))) for i in range(120)]
    got = [tuple(r) for r in O.overlap_pairs(frame(spark, rows), "k", O.clean_set(F.col("s")), 0.6, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(folded(rows), folded(rows), 0.6)


def test_subsets_of_very_many_sets_are_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(O, "LIST_BLOCK", 5)
    rows = [(f"k{i:03}", ["a", "b", "c", f"own{i}"]) for i in range(60)] + [("x", ["a", "b", "c"]), ("y", ["c", "d"])]
    got = [tuple(r) for r in O.overlap_pairs(frame(spark, rows), "k", O.clean_set(F.col("s")), 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(folded(rows), folded(rows), 0.6) and len(got) == 61 * 60 // 2
