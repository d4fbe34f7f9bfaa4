"""Evaluation passages inside training texts, by n-grams of normalised words.

Words are the pieces between blanks, lower-cased, without accents, cut down to letters and digits;
empty pieces are dropped. A text leaks an item if it holds n consecutive words of it.

The items' words and n-grams go to every task as two hash sets of a bounded size (bitmaps). One scan of
the corpus passes windows of n words over each text and keeps those that are in the sets; these few are
then verified by an equi-join with the n-grams themselves. However many items there are, it is one plan
and one scan: a fuller set only lets more windows through to the join.

Defined results
* null or empty text, and items shorter than n words: never a hit;
* repeated items or texts: each is reported; a pair of text and item comes out once;
* very long texts: scanned whole, once, in memory linear in the text;
* empty tables: empty result; extra columns are carried through ``remove_leaks``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.operators.skew import split_join
from markloom.runtime import cut, fresh_name

#: Bits of a hash set for each value in it, and at most (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27

#: Leaking texts up to so many, and so many of their words, are broadcast when spans are cut.
MOST_TEXTS, MOST_PLACES = 200_000, 20_000_000

#: Words of which each worker remembers whether they are in the set.
MEMORY = 500_000

NOT_WORD = re.compile(r"[^\w\s]+|_+")
PIECE = re.compile(r"\S+")


def words(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFD", low)
    return NOT_WORD.sub("", low).split()


def hash64(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big")


def window_texts(w: list[str], n: int) -> Iterator[str]:
    return (" ".join(w[i : i + n]) for i in range(len(w) - n + 1))


def hash_set(hashes: DataFrame, limit: int | None = None) -> bytes:
    """Bitmap of the values of column ``h``: a power of two of bits, MOST_BITS at most. It is put together in
    words of 64 bits, so that what comes to the driver is as small as the bitmap."""
    limit = limit or MOST_BITS
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(limit, max(1 << 16, 1 << int(n * BITS_EACH).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    parts = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}L) % 64 as int))").alias("b"))
    rows = parts.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype="<i8")
    out[rows["w"].to_numpy(dtype="int64")] = rows["b"].to_numpy(dtype="int64")
    return out.tobytes()


def _holds(bitmap: bytes, h: int) -> int:
    at = h & (len(bitmap) * 8 - 1)
    return bitmap[at >> 3] >> (at & 7) & 1


class _Finder:
    """Windows of a text that may be n-grams of an item: runs of known words first, then the set of n-grams."""

    def __init__(self, word_set: bytes, gram_set: bytes, n: int):
        self.word_set, self.gram_set, self.n, self.known = word_set, gram_set, n, {}

    def _known(self, word: str) -> int:
        found = _holds(self.word_set, hash64(word))
        if len(self.known) < MEMORY:
            self.known[word] = found
        return found

    def __call__(self, w: list[str]) -> Iterator[tuple[int, str]]:
        run, n, known = 0, self.n, self.known
        for i, x in enumerate(w):
            found = known.get(x)
            if not (self._known(x) if found is None else found):
                run = 0
                continue
            run += 1
            if run >= n:
                gram = " ".join(w[i - n + 1 : i + 1])
                if _holds(self.gram_set, hash64(gram)):
                    yield i - n + 1, gram


_LAST: list = [None, None]


def _finder(shared, n: int) -> _Finder:
    """One finder, with its memory of words, for each worker process and pair of sets."""
    if _LAST[0] is not shared.value:
        _LAST[:] = [shared.value, _Finder(*shared.value, n)]
    return _LAST[1]


def item_grams(items: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(item, g): the distinct n-grams of each item, written down."""

    def grams(batches):
        for b in batches:
            rows = [(k, g) for k, t in zip(b["k"], b["t"], strict=True) for g in dict.fromkeys(window_texts(words(t), n))]
            yield pd.DataFrame(rows, columns=["item", "g"])

    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("g", T.StringType())])
    return cut(items.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna().mapInPandas(grams, schema).distinct())


def _sets(grams: DataFrame):
    """Broadcast hash sets of the words and of the n-grams."""
    as_signed = lambda v: np.array([hash64(x) for x in v], dtype="uint64").astype("int64")
    hashed = F.pandas_udf("long")(lambda v: pd.Series(as_signed(v)))
    once = grams.select("g").distinct()
    word = once.select(F.explode(F.split("g", " ")).alias("g")).distinct()
    made = tuple(hash_set(d.select(hashed("g").alias("h"))) for d in (word, once))
    return grams.sparkSession.sparkContext.broadcast(made)


def leaking_windows(docs: DataFrame, keep: list[str], text: str, grams: DataFrame, n: int) -> DataFrame:
    """(keep, at, g): windows of each text, by the place of their first word, that may be n-grams of an item.
    A map-only scan of the corpus; ``keep`` are names of columns of ``docs``."""
    shared = _sets(grams)

    def scan(batches):
        find = _finder(shared, n)
        for b in batches:
            found = [(i, at, g) for i, t in enumerate(b["_t"]) for at, g in find(words(t))]
            out = b.iloc[[f[0] for f in found]][keep].reset_index(drop=True)
            yield out.assign(at=pd.Series([f[1] for f in found], dtype="int32"), g=pd.Series([f[2] for f in found], dtype=object))

    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("at", T.IntegerType()), T.StructField("g", T.StringType())])
    return docs.select(*keep, F.col(text).alias("_t")).dropna(subset=["_t"]).mapInPandas(scan, schema)


def _verified(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """Windows with the items whose n-gram they are; n-grams that many texts or items hold are split."""
    many = lambda d, c: d.groupBy("g").agg(F.count(F.lit(1)).alias(c))
    counts = many(windows, "in_a").join(many(grams, "in_b"), "g")
    return split_join(windows, grams, ["g"], counts, "in_a", "in_b", limit=100_000)


def leaked_items(
    docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 13
) -> DataFrame:
    """(doc, item, words): the documents that give items away, with the number of the document's words
    that lie in matching windows. Where both keys have one name, the item's gets the ending ``_item``."""
    item_out = item_key if item_key != doc_key else f"{item_key}_item"
    grams = item_grams(items, item_key, item_text, n)
    # Keys go through as text, as whole numbers with gaps would lose digits on their way.
    kind = docs.schema[doc_key].dataType
    numbered = docs.select(F.col(doc_key).cast("string").alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    windows = cut(leaking_windows(numbered, ["k", "row"], "t", grams, n))
    places = _verified(windows, grams).groupBy("row", "k", "item").agg(F.array_sort(F.collect_set("at")).alias("at"))
    gaps = F.transform("at", lambda x, i: F.when(i == 0, n).otherwise(F.least(F.lit(n), x - F.get("at", i - 1))))
    covered = places.select("k", "item", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long").alias("words"))
    found = covered.groupBy("k", "item").agg(F.max("words").alias("words"))
    return found.select(F.col("k").cast(kind).alias(doc_key), F.col("item").alias(item_out), "words")


def remove_leaks(
    docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, n: int = 13, drop_share: float = 0.5
) -> DataFrame:
    """``docs`` with leaking spans cut out of ``text``; a document of which more than ``drop_share`` of
    the words leaks is removed. Texts without a hit come back unchanged, character by character.

    The leaking places of a text are found in the text as it is, whatever the number of items, then cut
    and judged once. They are looked up by a digest of the text; equal texts share them.
    """
    grams = item_grams(items, item_key, item_text, n)
    own = docs.select(F.md5(text).alias("d"), F.col(text).alias("t"))
    windows = cut(leaking_windows(own, ["d"], "t", grams, n).distinct())
    hits = windows.join(grams.select("g").distinct(), "g", "left_semi")
    mark, digest = fresh_name(docs, "leak"), fresh_name(docs, "digest")
    spans = cut(hits.groupBy(F.col("d").alias(digest)).agg(F.collect_set("at").alias(mark)))
    texts, places = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(mark)), F.lit(0))).first()
    few = texts <= MOST_TEXTS and places <= MOST_PLACES
    marked = docs.withColumn(digest, F.md5(text)).join(F.broadcast(spans) if few else spans, digest, "left")
    touched = F.when(F.col(mark).isNotNull(), F.col(text))
    cleaned = marked.withColumn(mark, _cutter(n).asNondeterministic()(touched, F.col(mark)))
    kept = cleaned.filter(F.coalesce(F.col(mark)["share"] <= drop_share, F.lit(True)))
    return kept.withColumn(text, F.coalesce(F.col(mark)["kept"], F.col(text))).select(*docs.columns)


def _cutter(n: int):
    @F.pandas_udf("kept string, share double")
    def clean(values: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = [
            (None, None) if v is None else cut_places(v, {i for p in ps for i in range(p, p + n)}) for v, ps in zip(values, at, strict=True)
        ]
        return pd.DataFrame(rows, columns=["kept", "share"])

    return clean


def cut_places(value: str, places: set[int]) -> tuple[str, float]:
    """The text without the words at these places, and their share of all words."""
    if not places:
        return value, 0.0
    out, last, k = [], 0, -1
    for piece in PIECE.finditer(value):
        if words(piece.group()):
            k += 1
            if k in places:
                out.append(value[last : piece.start()] if (k - 1) not in places else "")
                last = piece.end()
    out.append(value[last:])
    return "".join(out), len(places) / (k + 1)
