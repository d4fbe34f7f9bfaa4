import random

import pytest

import markloom.llm.leak as L

ITEM = "The panel compared Drulvohu with Ronsaubrex and found the openings close to each other, which nobody in the trade denied."


def frames(spark, docs, items):
    return spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(docs)],
        "doc bigint, text string, words int",
    ), spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item bigint, text string")


def found(spark, docs, items, n=13):
    d, i = frames(spark, docs, items)
    return {(r.doc, r.item) for r in L.leaked_items(d, "doc", "text", i, "item", "text", n).collect()}


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [L.words(t)] for i in range(len(w) - n + 1)} if t else set()
    return {(a, b) for a, x in enumerate(docs) for b, y in enumerate(items) if grams(x) & grams(y)}


def test_disguised_passages(spark):
    w = ITEM.split()
    docs = [
        ITEM,
        " ".join(w[3:16]),
        " ".join(w[3:15]),
        ITEM.upper().replace(" ", " \n"),
        ITEM.replace("e", "é"),
        ITEM.replace(" ", " - ").replace("panel", "p.a.n.e.l"),
        None,
        "",
        "x " * 50_000 + ITEM,
        " ".join(w[:8] + ["stop"] + w[8:13]),
    ]
    assert found(spark, docs, [ITEM, "too short", None, ITEM]) == {(d, i) for d in (0, 1, 3, 4, 5, 8) for i in (0, 3)}
    assert found(spark, [], [ITEM]) == found(spark, docs, []) == set()


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_matches_brute_force_with_a_full_and_an_empty_set(spark, most, monkeypatch):
    monkeypatch.setattr(L, "MOST_BITS", most)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "c.", "-"]) for _ in range(n))
    docs, items = [text(rng.randint(0, 60)) for _ in range(80)], [text(rng.randint(0, 25)) for _ in range(20)]
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_spans_are_cut_and_documents_dropped(spark):
    docs = [
        f"Before it all. {ITEM} After that.  Two  blanks stay, here and there, as they were in the text that we keep because it is long enough.",
        ITEM,
        "clean  text",
        None,
    ]
    d, i = frames(spark, docs, [ITEM])
    got = {r.doc: r.text for r in L.remove_leaks(d, "text", i, "item", "text").collect()}
    assert set(got) == {0, 2, 3} and got[2] == docs[2] and got[3] is None
    assert "Drulvohu" not in got[0] and got[0].startswith("Before it all.") and "Two  blanks stay" in got[0]
    assert found(spark, [got[0]], [ITEM]) == set()


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, ITEM, "x")], "id bigint, text string, leak string")
    i = spark.createDataFrame([(7, ITEM)], "id bigint, text string")
    assert [tuple(r) for r in L.leaked_items(d, "id", "text", i, "id", "text").collect()] == [(1, 7, 20)]
    assert L.remove_leaks(d, "text", i, "id", "text", drop_share=1.0).columns == d.columns


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_spans_of_several_items_are_cut_and_judged_together(spark, most, monkeypatch):
    monkeypatch.setattr(L, "MOST_BITS", most)
    name = lambda c, n: [f"{c}{i}" for i in range(n)]
    a, b, own = name("a", 15), name("b", 15), name("o", 20)
    over = name("p", 10) + name("q", 10)
    items = [" ".join(a), " ".join(b), " ".join(over[:15]), " ".join(over[5:])]
    docs = [" ".join(a + own + b), " ".join(name("x", 40) + over + name("y", 9)), None, "nothing  here"]
    d, i = frames(spark, docs, items)
    got = {r.doc: r.text for r in L.remove_leaks(d, "text", i, "item", "text").collect()}
    assert got == {1: " ".join(name("x", 40)) + "  " + " ".join(name("y", 9)), 2: None, 3: "nothing  here"}


def test_many_leaking_texts_are_not_broadcast(spark, monkeypatch):
    d, i = frames(spark, [f"a b {ITEM} c d " + "own " * 60, "plain", None, ITEM], [ITEM])
    few = sorted(tuple(r) for r in L.remove_leaks(d, "text", i, "item", "text").collect())
    monkeypatch.setattr(L, "MOST_TEXTS", 0)
    assert sorted(tuple(r) for r in L.remove_leaks(d, "text", i, "item", "text").collect()) == few and len(few) == 3


def test_null_keys_and_large_keys_come_back_whole(spark):
    d = spark.createDataFrame([(None, ITEM), (2**60 + 1, ITEM), (3, "x")], "id bigint, text string")
    i = spark.createDataFrame([(2**61 + 1, ITEM)], "item bigint, text string")
    got = {(r.id, r.item) for r in L.leaked_items(d, "id", "text", i, "item", "text").collect()}
    assert got == {(None, 2**61 + 1), (2**60 + 1, 2**61 + 1)}
