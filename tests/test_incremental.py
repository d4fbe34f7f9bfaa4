from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from markloom.operators.incremental import IncrementalState, StateConflict, checkpoint_position, content_hash, due_after_runs, latest
from markloom.runtime import scratch_path

KEYS = [("k", "string")]


def rows(spark, data):
    return spark.createDataFrame(data, "k string, h string")


def taken(state, current):
    got = []
    state.run(current, "h", lambda d: got.extend((r.k, r.h) for r in d.collect()))
    return sorted(got, key=str)


def test_only_new_and_changed_rows_are_taken(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS)
    assert taken(s, rows(spark, [("a", "1"), ("b", None)])) == [("a", "1"), ("b", None)]
    assert taken(s, rows(spark, [("a", "1"), ("b", None)])) == []
    assert taken(s, rows(spark, [("a", "2"), ("b", None), ("c", "1")])) == [("a", "2"), ("c", "1")]
    assert taken(s, rows(spark, [("b", "x")])) == [("b", "x")]
    assert sorted((r.k, r.state_hash) for r in s.read().collect()) == [("a", "2"), ("b", "x"), ("c", "1")]


def test_a_failed_run_changes_nothing_and_is_repeated(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS)
    taken(s, rows(spark, [("a", "1")]))
    before = s.pointer()

    def die(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        s.run(rows(spark, [("a", "2"), ("b", "1")]), "h", die)
    assert s.pointer() == before
    assert taken(s, rows(spark, [("a", "2"), ("b", "1")])) == [("a", "2"), ("b", "1")]


def test_two_runs_from_one_version_conflict(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS)
    base = s.pointer()
    part = s.stage(rows(spark, [("a", "1")]), "h", base)
    taken(s, rows(spark, [("b", "1")]))
    with pytest.raises(StateConflict):
        s.commit(part, base)


def test_parts_are_compacted(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS, compact_after=2)
    for i in range(4):
        taken(s, rows(spark, [("a", str(i)), (f"k{i}", "1")]))
    assert len(s.pointer()["parts"]) <= 2
    assert {r.k: r.state_hash for r in s.read().collect()} == {"a": "3", "k0": "1", "k1": "1", "k2": "1", "k3": "1"}


def test_empty_table_nulls_and_clashing_names(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS)
    assert taken(s, rows(spark, [])) == []
    odd = spark.createDataFrame(
        [("a", "1", 5, "x"), (None, "1", 6, "y"), ("a", "1", 5, "x")],
        "k string, h string, _m int, state_hash string",
    )
    one = latest(odd, ["k"], [F.col("_m")], {"h": F.col("h"), "state_hash": F.col("state_hash")})
    assert [tuple(r) for r in one.collect()] == [("a", "1", "x")]
    assert s.changes(one, "h").count() == 1


def test_content_hash_keeps_null_apart(spark):
    d = spark.createDataFrame([(None, "b"), ("", "b"), ("x", None)], "a string, b string")
    assert d.select(content_hash("a", "b").alias("h")).distinct().count() == 3


def test_checkpoint_forms(spark):
    texts = [
        '{"mapped_at": 1767571200000}',
        '{"last_id":"t","mapped_at":"2026-01-05T01:00:00+01:00"}',
        '{"position": {"mapped_at": 1767571200000, "last_id": null}}',
        '{"mapped_at": ',
        None,
        "[]",
        '{"mapped_at": "soon"}',
    ]
    got = [
        tuple(r.p) for r in spark.createDataFrame(
            [(i, t) for i, t in enumerate(texts)],
            "i int, c string",
        ).select("i", checkpoint_position(F.col("c")).alias("p")).orderBy("i").collect()
    ]
    at = datetime(2026, 1, 5)
    assert got == [(at, None), (at, "t"), (at, None)] + [(None, None)] * 4


T0 = datetime(2026, 1, 5, tzinfo=timezone.utc)


def hour(n):
    return T0 + timedelta(hours=n)


def brute(marks, runs):
    done = [r for r in runs if r[0] == "completed"]
    covered = lambda m: any(m[3] <= r[1] and (m[2] < r[2] or (m[2] == r[2] and (r[3] is None or m[0] <= r[3]))) for r in done)
    out = set()
    for k in {m[0] for m in marks}:
        own = sorted((m for m in marks if m[0] == k), key=lambda m: (m[2], m[3], m[1].lower()))
        seen = [m for m in own if covered(m)]
        if not covered(own[-1]) and (not seen or seen[-1][1].lower() != own[-1][1].lower()):
            out.add((k, own[-1][1].lower()))
    return out


def test_due_rows_match_the_definition(spark):
    import random

    rng = random.Random(4)
    marks = [(f"t{rng.randrange(12):02}", rng.choice("AaBbCc"), hour(rng.randrange(20)), hour(rng.randrange(30))) for _ in range(200)]
    runs = [
        (
            rng.choice(["completed", "failed"]),
            hour(rng.randrange(30)),
            hour(rng.randrange(20)),
            rng.choice([None, "t03", "t07"]),
        ) for _ in range(6)
    ]
    m = spark.createDataFrame(marks, "id string, source_hash string, mapped_at timestamp, created_at timestamp")
    r = spark.createDataFrame(
        [
            (
                f" {s.upper()} ",
                f'{{"mapped_at": {int(a.timestamp() * 1000)}, "last_id": {"null" if i is None else chr(34) + i + chr(34)}}}',
                b,
            ) for s, b, a, i in runs
        ],
        "status string, checkpoint string, started_at timestamp",
    )
    got = {tuple(x) for x in due_after_runs(m, r, scratch_path(spark, "due")).collect()}
    assert got == brute(marks, runs)
    none = due_after_runs(m, r.limit(0), scratch_path(spark, "due"))
    assert {tuple(x) for x in none.collect()} == brute(marks, [])
    assert due_after_runs(m.limit(0), r, scratch_path(spark, "due")).count() == 0


def test_a_call_on_a_state_left_by_an_earlier_one_stages_the_difference(spark):
    marks = [(f"t{i:02}", "a", hour(i), hour(i)) for i in range(10)]
    run = lambda h: ("completed", f'{{"mapped_at": {int(hour(h).timestamp() * 1000)}}}', hour(40))
    frame = lambda ms: spark.createDataFrame(ms, "id string, source_hash string, mapped_at timestamp, created_at timestamp")
    log = lambda *hs: spark.createDataFrame([run(h) for h in hs], "status string, checkpoint string, started_at timestamp")
    path = scratch_path(spark, "due")
    assert sorted(r.id for r in due_after_runs(frame(marks), log(3), path).collect()) == [f"t{i:02}" for i in range(4, 10)]
    more = [*marks, ("t01", "b", hour(5), hour(5)), ("t02", "b", hour(20), hour(20))]
    assert sorted(r.id for r in due_after_runs(frame(more), log(3, 7), path).collect()) == ["t02", "t08", "t09"]
    parts = IncrementalState(spark, path, [("id", "string")]).pointer()["parts"]
    assert [spark.read.parquet(f"{path}/{p}").count() for p in parts] == [4, 5]


def test_one_of_many_runs_wins_a_version(spark):
    from concurrent.futures import ThreadPoolExecutor

    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS)
    base = s.pointer()
    parts = [s.stage(rows(spark, [(f"k{i}", "1")]), "h", base) for i in range(4)]

    def commit(part):
        try:
            s._publish({"version": 1, "parts": [part]})
        except StateConflict:
            return None
        return part

    with ThreadPoolExecutor(4) as pool:
        won = [p for p in pool.map(commit, parts) if p]
    assert len(won) == 1 and s.pointer() == {"version": 1, "parts": won}


def test_vacuum_deletes_what_no_version_uses(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS, compact_after=1)
    for i in range(4):
        taken(s, rows(spark, [("a", str(i))]))
    dead = s.stage(rows(spark, [("x", "1")]), "h", s.pointer())
    assert s.vacuum() == []
    gone = s.vacuum(older_than_s=0)
    assert dead in gone and len(gone) > 3 and [r.state_hash for r in s.read().collect()] == ["3"]
    assert taken(s, rows(spark, [("a", "9")])) == [("a", "9")]


def test_a_late_older_row_is_no_change(spark):
    s = IncrementalState(spark, scratch_path(spark, "t"), KEYS, order=("o", "int"))
    frame = lambda d: spark.createDataFrame(d, "k string, h string, o int")
    assert taken(s, frame([("a", "new", 5)])) == [("a", "new")]
    assert taken(s, frame([("a", "old", 3), ("b", "1", None)])) == [("b", "1")]
    assert taken(s, frame([("a", "newer", 6), ("b", "2", 1)])) == [("a", "newer"), ("b", "2")]
