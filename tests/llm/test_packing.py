import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markloom.llm.packing import TOKENIZERS, add_token_count, best_fill, fill_window, pack, unused_space


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 40), st.integers(1, 4)), max_size=5, unique_by=lambda x: x[0]))
def test_fill_is_the_best_there_is(room, left):
    left = sorted(left, reverse=True)
    sums = {sum(n * k for (n, _), k in zip(left, ks, strict=True)) for ks in itertools.product(*[range(k + 1) for _, k in left])}
    used = dict(best_fill(room, [list(x) for x in left]))
    assert all(k <= dict(left)[n] for n, k in used.items())
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def test_window_places_all_within_capacity():
    rng = random.Random(1)
    lengths = [rng.choice([1, 3, 17, 100, rng.randint(1, 512)]) for _ in range(3000)]
    bins = fill_window(lengths, 512)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(lengths[i] for i in b) for b in bins) <= 512
    assert len(bins) <= -(-sum(lengths) // 512) + 1


def test_pack(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice([None, 0, 5, 60, rng.randint(1, 400)]), 1, "w") for i in range(900)
    ] + [(5000, 1000, 1, "w"), (5000, 1000, 1, "w"), (None, 7, 1, "w")]
    d = spark.createDataFrame(rows, "doc bigint, n int, piece int, window string")
    out = pack(d, "doc", "n", 128, window=200).collect()
    assert sum(r.n_tokens for r in out) == sum(r[1] or 0 for r in rows)
    bins = {}
    for r in out:
        if r.sequence is None:
            assert r.n_tokens == 0
            continue
        bins.setdefault((r.window, r.sequence), []).append((r.start, r.n_tokens))
    for parts in bins.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 128
    cut = {r.doc for r in out if r.piece > 0}
    assert cut == {r[0] for r in rows if (r[1] or 0) > 128}
    assert sum(r.n_tokens for r in out) / (128 * len(bins)) > 0.95
    assert pack(d.limit(0), "doc", "n", 128).count() == 0


def test_counts_with_a_public_tokenizer(spark):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    texts = ["Hello world", "", None, "<|endoftext|>", "x" * 100_000, "été"]
    got = [
        r.n_tokens for r in add_token_count(
            spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1),
            "t",
            path,
        ).orderBy("i").collect()
    ]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] > 1000
    with pytest.raises(Exception, match="(?i)no such file|not found|error"):
        add_token_count(spark.createDataFrame([("a",)], "t string"), "t", "/nowhere.json").collect()


ODD = " \t\n\r\x0b\x1c\x1f\x85\xa0 　​ab'sé中1.,-<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*ODD, "the", " the", "'ll", "  ", "\n\n", "ﬁ", "é"]), max_size=30))
def test_lengths_of_stretches_add_up(parts):
    from markloom.llm.packing import _Counter

    if not _LEFT:
        _LEFT["c"] = _Counter(f"{TOKENIZERS}/byte_bpe_50k.json")
    counter = _LEFT["c"]
    text = "".join(parts)
    assert counter.apart and counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


_LEFT: dict = {}


def test_other_tokenizers_take_texts_whole():
    from markloom.llm.packing import _Counter

    counter = _Counter(f"{TOKENIZERS}/word_bpe_49k.json")
    assert not counter.apart and counter.count("Hello  WORLD ") == len(
        counter.tokenizer.encode("hello world", add_special_tokens=False).ids
    )


def test_windows_do_not_depend_on_the_split(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i, rng.choice([40, 50, rng.randint(1, 200)])) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc bigint, n int")
    runs = [
        sorted((tuple(r) for r in pack(x, "doc", "n", 128, window=100).collect()), key=str) for x in (d.coalesce(1), d.repartition(7, "n"))
    ]
    assert runs[0] == runs[1] and len({r[3] for r in runs[0] if r[0] is None}) > 5


def test_unused_space(spark):
    d = spark.createDataFrame([(i, 64) for i in range(9)], "doc bigint, n int")
    assert tuple(unused_space(pack(d, "doc", "n", 128), 128).first()) == (576, 5, 5, 0.9)
    assert unused_space(pack(d.limit(0), "doc", "n", 128), 128).first().sequences == 0
