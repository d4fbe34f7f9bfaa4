import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from markloom.llm.fusion import clear_winners, fuse, normal_quantile

SCHEMA = "g string, i string, a double, b double, c double, d double, n int, p double"
SCORES = {s: F.col for s in "abcd"}


def cols():
    return {s: F.col(s) for s in "abcd"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 0.5) for r in rows], SCHEMA)


def test_quantile_is_exact(spark):
    ps = [1e-12, 1e-6, 0.01, 0.075, 0.3, 0.5, 0.7, 0.95, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)


def brute(rows, unknown):
    groups = {}
    for r in dict.fromkeys(rows):
        groups.setdefault(r[0], []).append(r)
    out = {}
    for g, rs in groups.items():
        means = {}
        for r in rs:
            zs = []
            for k in range(4):
                v = r[2 + k]
                if v is None and unknown == "skip":
                    continue
                known = [x[2 + k] for x in rs if x[2 + k] is not None or unknown == "lowest"]
                key = lambda x: float("-inf") if x is None else x
                p = (sum(key(x) < key(v) for x in known) + sum(key(x) == key(v) for x in known) / 2) / len(known)
                zs.append(NormalDist().inv_cdf(p))
            means[r[1]] = sum(zs) / len(zs) if zs else None
        for place, i in enumerate(sorted(means, key=lambda i: (means[i] is None, -round(means[i] or 0, 9), i)), 1):
            out[g, i] = (means[i], place)
    return out


@pytest.mark.parametrize("most", [10**6, 40, 0])
@pytest.mark.parametrize("unknown", ["skip", "lowest"])
def test_matches_brute_force(spark, unknown, most):
    rng = random.Random(3)
    pick = lambda scale: rng.choice([None, 0.0, round(rng.random(), 1) * scale, rng.random() * scale])
    rows = [(f"g{rng.randrange(4)}", f"i{n:03}", pick(1), pick(1), pick(100), pick(1e6)) for n in range(120)]
    rows += [
        ("hot", f"i{n:03}", 1.0 if n % 3 else None, float(n % 5), rng.random(), 2.0) for n in range(200)
    ] + [("single", "x", None, None, None, None)]
    got = {
        (r.g, r.i): (r.fused, r.place) for r in fuse(
            frame(spark, rows + rows[:30]),
            "g",
            "i",
            cols(),
            unknown=unknown,
            in_one_task=most,
        ).collect()
    }
    want = brute(rows, unknown)
    assert got.keys() == want.keys()
    for k, (mean, place) in want.items():
        assert got[k][1] == place and (got[k][0] is None) == (mean is None) and (mean is None or got[k][0] == pytest.approx(mean, abs=1e-8))


def test_range_of_a_score_has_no_influence(spark):
    rows = [("g", f"i{n}", float(n), float((n * 7) % 10), float((n * 3) % 10), 1.0) for n in range(10)]
    big = [(*r[:2], r[2] * 1e9, *r[3:]) for r in rows]
    place = lambda rs: {r.i: r.place for r in fuse(frame(spark, rs), "g", "i", cols()).collect()}
    assert place(rows) == place(big)


def winners(rows):
    groups = {}
    for r in dict.fromkeys(rows):
        groups.setdefault(r[0], []).append(r)
    key = lambda x: float("-inf") if x is None else x
    beats = lambda x, y: sum(key(p) > key(q) for p, q in zip(x[2:], y[2:], strict=True)) >= 3
    return {(g, r[1]) for g, rs in groups.items() if len(rs) >= 3 for r in rs if all(beats(r, o) for o in rs if o is not r)}


@pytest.mark.parametrize("most", [10**6, 8])
def test_clear_winners(spark, most):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        n = rng.choice([1, 2, 3, 4, 9, 30])
        for i in range(n):
            rows.append(
                (f"g{g}", f"i{i:02}", *[rng.choice([None, rng.random()]) if rng.random() < 0.2 else rng.random() for _ in range(4)])
            )
        if g % 2:
            best = [2.0, 2.0, 2.0, rng.choice([None, 0.0, 3.0])]
            rng.shuffle(best)
            rows.append((f"g{g}", "top", *best))
    got = {
        (r.g, r.i) for r in clear_winners(frame(spark, rows + rows[:40]), "g", "i", cols(), least=3, chunk=4, in_one_task=most).collect()
    }
    assert got == winners(rows) and got


def test_nulls_nan_and_empty(spark):
    rows = [
        (None, "x", 1.0, 1.0, 1.0, 1.0),
        ("g", None, 1.0, 1.0, 1.0, 1.0),
        ("g", "a", float("nan"), None, 1.0, 1.0),
        ("g", "b", 1.0, 1.0, 0.0, 0.0),
    ]
    got = {r.i: r for r in fuse(frame(spark, rows), "g", "i", cols()).collect()}
    assert set(got) == {"a", "b"} and got["a"].a_pct is None and got["a"].place == 1
    assert fuse(frame(spark, []), "g", "i", cols()).count() == 0 and clear_winners(frame(spark, []), "g", "i", cols(), 3).count() == 0


def test_even_split_is_the_least_mean():
    """Nothing that the winner may lose brings its mean of quantiles below the floor of the short list."""
    inv = NormalDist().inv_cdf
    for n in [*range(3, 24), 200, 5000]:
        floor = inv(1 - ((n - 1) / 4 + 0.5) / n)
        z = lambda x: inv(1 - (x + 0.5) / n)  # noqa: B023, E731
        step = 0.5 if n < 24 else (n - 1) / 24
        halves = range(int((n - 1) / step) + 1)
        for a in halves:
            for b in halves[a:]:
                for c in halves[b:]:
                    d = (n - 1) / step - a - b - c
                    if d >= c:
                        assert (z(a * step) + z(b * step) + z(c * step) + z(d * step)) / 4 >= floor - 1e-9, (n, a, b, c, d)


def test_generated_code_stays_within_a_method(spark):
    """Each span of generated code compiles, with methods that the JVM will compile further."""
    import re

    rows = frame(spark, [("g", f"i{n}", float(n), float(n % 3), None, 1.0) for n in range(9)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fuse(rows, "g", "i", cols())._jdf.queryExecution().executedPlan()
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
    assert len(sizes) > 5 and 0 < min(sizes) and max(sizes) < 8000
