"""Filling sequences of fixed capacity with texts measured in tokens of a public tokenizer.

Minimum bin slack: texts are spread over windows by hash; inside a window each sequence starts with
the longest text left, and a subset-sum over the multiset of remaining lengths, kept as the bits of
one integer, finds the lengths that bring it closest to its capacity. Counts are traced back through
the bitsets kept after each length.

Defined results
* null, empty or token-less text: takes no room and comes out with length 0 and no sequence;
* a text longer than the capacity: cut into full pieces and a rest; no other text is ever cut;
* equal lengths: items by key, then by position; repeated keys: every row is placed;
* very long texts: counted stretch by stretch (byte-level tokenizers) or whole; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"

_LOADED: dict = {}


#: Blanks of Unicode, as the tokenizers have them, and stretches of a text that start with blanks and end before the next.
BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")

#: Lengths of so many stretches, of at most so many characters, are remembered in each worker.
MEMORY, MEMORY_CHARS = 500_000, 64


class _Counter(dict):
    """Lengths in tokens of the stretches of a text, each worked out once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        form = json.loads(self.tokenizer.to_str())
        cutter = form["pre_tokenizer"] or {}
        bytes_only = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        #: Whether no token spans the place before a blank that follows a visible character, whatever stands around.
        self.apart = bool(bytes_only and not form["normalizer"] and all(t["special"] for t in form["added_tokens"]))

    def __missing__(self, stretch: str) -> int:
        n = len(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        if len(stretch) <= MEMORY_CHARS and len(self) < MEMORY:
            self[stretch] = n
        return n

    def count(self, text: str) -> int:
        if self.apart:
            return sum(
                map(self.__getitem__, (m.group() for m in STRETCH.finditer(text)) if len(text) > 1_000_000 else STRETCH.findall(text))
            )
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def token_counts(texts: list[str], path: str) -> list[int]:
    """Lengths in tokens; strings of special tokens are ordinary text.

    Byte-level tokenizers split texts at blanks before they merge anything, so lengths of stretches add
    up to that of the text, and no call of the tokenizer takes more than one stretch. With any other kind
    a text goes through whole.
    """
    if path not in _LOADED:
        _LOADED[path] = _Counter(path)
    return [_LOADED[path].count(t) for t in texts]


def add_token_count(rows: DataFrame, text: str, path: str, out: str = "n_tokens") -> DataFrame:
    """``rows`` with the length of ``text`` in tokens, 0 for null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return pd.Series(token_counts(texts.fillna("").tolist(), path), dtype="int32")

    return rows.withColumn(out, count(F.col(text)))


def best_fill(room: int, left: list[list[int]]) -> list[tuple[int, int]]:
    """(length, count) pairs whose sum is the closest to ``room`` from below.

    ``left`` is [[length, available], ...], longest first. A length with k available is added in
    doubling shares, so that it costs about log k shifts. The trace prefers few long items.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, available in left:
        most = min(available, room // length) if length <= room else 0
        share = 1
        while most > 0:
            take = min(share, most)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            most -= take
            share *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] += take
    return list(used.items())


def fill_window(lengths: list[int], capacity: int) -> list[list[int]]:
    """Lists of item positions, one for each sequence; every length is within 1 and ``capacity``."""
    queues: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        queues[lengths[i]].append(i)
    order, bins = sorted(queues, reverse=True), []
    while order:
        first = order[0]
        taken = [queues[first].pop()]
        for length, count in best_fill(capacity - first, [[x, len(queues[x])] for x in order if queues[x]]):
            taken += [queues[length].pop() for _ in range(count)]
        order = [x for x in order if queues[x]]
        bins.append(taken)
    return bins


def pack(rows: DataFrame, key: str, length: str, capacity: int, window: int = 2048) -> DataFrame:
    """(key, piece, n_tokens, window, sequence, start): where each piece of each text goes.

    ``start`` is the token of the sequence at which the piece begins. Windows take about ``window``
    pieces by a hash of key, piece, length and, where all these come again, the number of the copy: they are
    even, independent, and the same however the input is split into files. Each leaves at most one
    sequence less than half full.
    """
    size = F.coalesce(F.col(length), F.lit(0))
    kind = rows.schema[key].dataType.simpleString()
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")
    piece = lambda i: F.struct(i.alias("piece"), F.least(F.lit(capacity), F.col("n") - i * capacity).cast("int").alias("n_tokens"))
    items = rows.select(F.col(key).cast("string").alias("key"), size.alias("n")).select(
        "key",
        F.inline(F.transform(F.sequence(F.lit(0), last), piece)),
    )
    total = rows.agg(F.sum(F.greatest(F.ceil(size / capacity), F.lit(1)))).first()[0] or 0
    windows = max(1, round(total / window))
    # Copies are counted before they are numbered, so that a key of any number of rows is never gathered.
    counted = items.groupBy("key", "piece", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    real = counted.filter("n_tokens > 0").select("key", "piece", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    real = real.withColumn("window", F.pmod(F.xxhash64("key", "piece", "n_tokens", "copy"), F.lit(windows)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece", "n_tokens", "copy"]).reset_index(drop=True)
        sequence, start = [0] * len(pdf), [0] * len(pdf)
        lengths = pdf["n_tokens"].tolist()
        for s, bin_ in enumerate(fill_window(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], start[i] = s, at
                at += lengths[i]
        return pdf.drop(columns="copy").assign(sequence=sequence, start=start)

    placed = real.groupBy("window").applyInPandas(place, "key string, piece int, n_tokens int, window long, sequence long, start long")
    nowhere = [F.lit(None).cast("long").alias(c) for c in ("window", "sequence", "start")]
    none = items.filter("n_tokens <= 0").select("key", "piece", "n_tokens", *nowhere)
    both = placed.unionByName(none)
    return both.select(F.col("key").cast(kind).alias(key), *[c for c in both.columns if c != "key"])


def unused_space(placed: DataFrame, capacity: int) -> DataFrame:
    """(tokens, sequences, least_sequences, filled) of a packing: how many sequences it takes, how many any
    packing must take, and the share of their room that holds tokens."""
    bins = placed.filter("sequence is not null").groupBy("window", "sequence").agg(F.sum("n_tokens").alias("t"))
    whole = bins.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("sequences"))
    least = F.ceil(F.col("tokens") / capacity)
    return whole.select(
        "tokens",
        "sequences",
        least.alias("least_sequences"),
        F.try_divide("tokens", F.col("sequences") * capacity).alias("filled"),
    )
