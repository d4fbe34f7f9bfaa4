import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markloom.llm.distinctive import distinctive_terms

SCHEMA = "id string, tokens array<string>, term string, df int"


def brute(rows, k1=1.2, b=0.75):
    docs = {}
    for k, tokens in rows:
        if k is not None and tokens:
            c = Counter(t.strip().lower() for t in tokens if t and t.strip())
            own = docs.setdefault(k, Counter())
            for t, n in c.items():
                own[t] = max(own[t], n)
    docs = {k: c for k, c in docs.items() if c}
    df = Counter(t for c in docs.values() for t in c)
    mean = sum(sum(c.values()) for c in docs.values()) / max(len(docs), 1)
    return {
        (k, t): (
            n,
            df[t],
            math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * sum(c.values()) / mean)),
        ) for k, c in docs.items() for t, n in c.items()
    }


def run(spark, rows):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    return {(r.key, r.term): (r.tf, r.df, r.weight) for r in distinctive_terms(d, "id", F.col("tokens")).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2])


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (
            f"d{rng.randrange(40)}",
            [rng.choice(["a", "A ", "b", "c", "", " ", None, " d", f"r{rng.randrange(60)}"]) for _ in range(rng.randrange(12))],
        ) for _ in range(120)
    ]
    rows += [rows[0], (None, ["a"]), ("n", None), ("e", []), ("blank", ["", None])]
    same(run(spark, rows), brute(rows))


def test_common_terms_count_little(spark):
    got = run(spark, [(f"d{i}", ["the", f"pair{i // 2}"]) for i in range(40)])
    assert got["d0", "pair0"][2] > 20 * got["d0", "the"][2]


def test_long_and_empty(spark):
    rows = [("long", ["x"] * 50_000 + [f"t{i}" for i in range(20_000)]), ("other", ["x"])]
    got = run(spark, rows)
    assert got["long", "x"][0] == 50_000 and len(got) == 20_002
    assert run(spark, []) == {}


def test_rare_shared_terms_are_chosen_by_their_weight(spark):
    rows = [
        (
            f"k{i}",
            ["all", *(["many"] if i < 6 else []), *(["five"] if i < 5 else []), *(["two"] if i in (3, 9) else []), f"own{i}"],
        ) for i in range(40)
    ]
    d = spark.createDataFrame(rows, "k string, a array<string>")
    whole = {(r.key, r.term): r.weight for r in distinctive_terms(d, "k", F.col("a")).collect()}
    got = {(r.key, r.term): r.weight for r in distinctive_terms(d, "k", F.col("a"), shared_by=(2, 5)).collect()}
    assert set(got) == {(f"k{i}", "five") for i in range(5)} | {("k3", "two"), ("k9", "two")}
    assert all(abs(whole[k] - w) < 1e-12 for k, w in got.items())
