"""One consistent form for texts that look the same but are written with other characters.

Words (pieces between blanks) of a text are run through a trie of known spellings by an edit
automaton in which look-alike letters, width and ligature forms, composed or combining accents and
ignorable characters cost nothing, and any other edit costs 1. A word that reaches a spelling within
``max_cost`` takes it: the way of writing that the collection uses most for this look, in one script.
Any other word is normalised by table. At ``max_cost`` 0 both ways give the same equivalence, so that
whether two texts look alike never depends on what the vocabulary knows; only the spelling that stands
for them does.

Defined results
* null text: null; a text without visible characters: the empty string;
* letter case, accents and punctuation (but for hyphens of one look) are kept apart;
* blanks of any kind and number become one space, none at the ends;
* very long texts and words: linear in their length; repeated rows: each gets its form;
* empty table: empty result; extra columns are carried through ``add_canonical``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.operators.skew import lookup_join, split_join
from markloom.runtime import cut

#: Letters of other scripts and the Latin letter of the same look (fixed values); three capital
#: pairs without a Latin twin go from Greek to Cyrillic.
SAME_LOOK = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԁ": "D",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Γ": "Г", "Π": "П", "Φ": "Ф",
}

#: Hyphens of one look (fixed values).
HYPHENS = "‐‑﹣－"

#: Format characters with a visible mark of their own (fixed values).
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"

#: Characters without a mark that Unicode doesn't class as format characters (fixed values).
BLANKED = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

ADD, DROP, SWAP = 1.0, 1.0, 1.0


def plain(ch: str) -> str:
    """What a decomposed character looks like: nothing, itself, or one or more plain characters."""
    code = ord(ch)
    if ch in SAME_LOOK:
        return SAME_LOOK[ch]
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if (kind in ("Cf", "Cc") and ch not in VISIBLE_FORMAT) or ch in BLANKED or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if parts and (parts[0] in ("<wide>", "<narrow>", "<noBreak>") or (parts[0] == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""))):
        return "".join(plain(x) for p in parts[1:] for x in unicodedata.normalize("NFD", chr(int(p, 16))))
    return ch


class _Looks(dict):
    def __missing__(self, ch: str) -> str:
        self[ch] = found = plain(ch)
        return found


LOOKS = _Looks()


def table_form(word: str) -> str:
    """A word's form by table alone."""
    return unicodedata.normalize("NFC", "".join(map(LOOKS.__getitem__, unicodedata.normalize("NFD", word))))


class Vocabulary:
    """Trie of canonical spellings, most wanted first, walked by the weighted edit automaton.

    Words of fewer than ``shortest`` characters are only matched at no cost.
    """

    END = ""

    def __init__(self, spellings: list[str], max_cost: float = 0.0, shortest: int = 0):
        self.root: dict = {}
        self.most, self.shortest, self.max_cost = max_cost, shortest, max_cost
        for rank, spelling in enumerate(spellings):
            node = self.root
            for ch in unicodedata.normalize("NFD", spelling):
                for x in LOOKS[ch]:
                    node = node.setdefault(x, {})
            node.setdefault(self.END, (rank, spelling))

    def _additions(self, states: dict) -> dict:
        """Spelling characters that the text lacks, at ADD each."""
        todo = list(states.values())
        while todo:
            node, cost = todo.pop()
            if cost + ADD > self.max_cost:
                continue
            for ch, child in node.items():
                if ch != self.END and cost + ADD < states.get(id(child), (None, float("inf")))[1]:
                    states[id(child)] = (child, cost + ADD)
                    todo.append(states[id(child)])
        return states

    def match(self, word: str) -> str | None:
        """The spelling reached at the least cost; ties go to the one named first."""
        self.max_cost = self.most if len(word) >= self.shortest else 0.0
        states = self._additions({id(self.root): (self.root, 0.0)})
        for ch in unicodedata.normalize("NFD", word):
            look, after = LOOKS[ch], {}
            for node, cost in states.values():
                steps = [(node, cost + (DROP if look else 0.0))]
                at = node
                for x in look:
                    at = at.get(x) if at is not None else None
                if look and at is not None:
                    steps.append((at, cost))
                if look and cost + SWAP <= self.max_cost:
                    steps += [(child, cost + SWAP) for x, child in node.items() if x != self.END and child is not at]
                for to, c in steps:
                    if c <= self.max_cost and c < after.get(id(to), (None, float("inf")))[1]:
                        after[id(to)] = (to, c)
            states = self._additions(after) if self.max_cost else after
            if not states:
                return None
        ends = [(cost, *node[self.END]) for node, cost in states.values() if self.END in node]
        return min(ends)[2] if ends else None

    def canonical(self, text: str | None) -> str | None:
        if text is None:
            return None
        words = (self.match(w) or table_form(w) for w in text.split())
        return " ".join(w for w in words if w)


def _mixed(word: Column) -> Column:
    """Whether a word holds letters of more than one of the three scripts that have look-alikes."""
    latin, cyrillic, greek = (word.rlike(rf"\p{{Is{s}}}") for s in ("Latin", "Cyrillic", "Greek"))
    return word.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & (latin | (cyrillic & greek))


def _own_form(word: str) -> str | None:
    """Table form of a word that is written plainly: composed, without widths, ligatures or characters that
    don't show."""
    apart = unicodedata.normalize("NFD", word)
    if unicodedata.normalize("NFC", word) != word or not all(LOOKS[c] == c or c in SAME_LOOK for c in apart):
        return None
    return table_form(word)


def build_vocabulary(rows: DataFrame, text: str, size: int = 50_000, least: int = 2) -> list[str]:
    """For each of the ``size`` most frequent looks of words its most frequent spelling, by number of texts
    (from ``least`` on), written plainly and in one script.

    The bound keeps what is broadcast small on any input; words beyond it lose nothing, as the table
    brings those that look alike to one form.
    """
    # Marked so that filters on the result aren't pushed below it, which would work it out twice.
    own = F.pandas_udf("string")(lambda words: words.map(_own_form)).asNondeterministic()
    words = rows.select(F.explode(F.array_distinct(F.split(F.col(text), r"(?U)[\s\x1c-\x1f]+"))).alias("w"))
    often = words.filter(~_mixed(F.col("w")) & F.length("w").between(1, 64)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    looks = often.filter(F.col("n") >= least).withColumn("look", own("w")).filter("look is not null")
    best = looks.groupBy("look").agg(F.min(F.struct(-F.col("n"), "w")).alias("b"), F.sum("n").alias("n"))
    return [r["w"] for r in best.select("n", "b.w").orderBy(F.col("n").desc(), "w").limit(size).collect()]


def add_canonical(
    rows: DataFrame, text: str, vocabulary: list[str], out: str = "canonical", max_cost: float = 0.0, shortest: int = 0
) -> DataFrame:
    """``rows`` with the consistent form of ``text``; words seen before in a task aren't walked again."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(_trie(known, max_cost, shortest), na_action="ignore")

    return rows.withColumn(out, form.asNondeterministic()(F.col(text)))


_LAST: list = [None, None, None]


def _trie(known, max_cost: float, shortest: int):
    """One trie and word memory for each worker process and vocabulary."""
    if _LAST[0] is not known.value or _LAST[1] != (max_cost, shortest):
        trie, memory = Vocabulary(known.value, max_cost, shortest), {}

        def canonical(text: str) -> str:
            out = []
            for w in text.split():
                form = memory.get(w)
                if form is None:
                    form = trie.match(w) or table_form(w)
                    if len(w) <= 64 and len(memory) < 500_000:
                        memory[w] = form
                if form:
                    out.append(form)
            return " ".join(out)

        _LAST[:] = [known.value, (max_cost, shortest), canonical]
    return _LAST[2]


def same_look_pairs(rows: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(a, b): pairs of keys whose texts differ as character sequences but look the same.

    Texts are made distinct first, so that copies of one text never meet each other; classes with a
    single text are dropped before any join.
    """
    members = cut(rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).dropna().distinct())
    per_text = members.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    forms = cut(add_canonical(per_text, "text", vocabulary).filter("canonical <> ''"))
    shared = forms.groupBy("canonical").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("canonical")
    mixed = forms.join(shared, "canonical")
    x, y = (mixed.select("canonical", F.col("text").alias(f"t{c}"), F.col("n").alias(f"n{c}")) for c in "xy")
    texts = x.join(y, "canonical").filter(F.col("tx") < F.col("ty")).select("tx", "ty", "nx", "ny")
    # A text that very many keys have is split, on its own side and where it meets another such text.
    a, b = (members.select(F.col("text").alias(f"t{c}"), F.col("key").alias(k)) for c, k in ("xa", "yb"))
    held = split_join(a, texts.select("tx", "ty"), ["tx"], mixed.select(F.col("text").alias("tx"), "n"), "n")
    counts = texts.groupBy("ty").agg(F.sum("nx").alias("in_a"), F.max("ny").alias("in_b"))
    pairs = split_join(held, b, ["ty"], counts, "in_a", "in_b").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def same_look_classes(rows: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(key, text, canonical, texts, keys): each key's text and its consistent form, in how many ways that
    form is written and by how many keys. Linear in the input, whatever the copies; texts without a visible
    character are left out."""
    members = cut(rows.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().distinct())
    per_text = members.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    forms = cut(add_canonical(per_text, "text", vocabulary).filter("canonical <> ''"))
    placed = lookup_join(members, forms.select("text", "canonical", "n"), ["text"], "n").drop("n")
    # A key that writes one form in several ways counts once.
    twice = members.groupBy("key").agg(F.count(F.lit(1)).alias("t")).filter("t > 1")
    ways = lookup_join(placed, twice, ["key"], "t").groupBy("canonical", "key").agg((F.count(F.lit(1)) - 1).alias("x"))
    extra = ways.groupBy("canonical").agg(F.sum("x").alias("x"))
    classes = forms.groupBy("canonical").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows"))
    sized = classes.join(extra, "canonical", "left").withColumn("keys", F.col("rows") - F.coalesce("x", F.lit(0)))
    out = lookup_join(placed, sized.drop("x"), ["canonical"], "rows")
    return out.select("key", "text", "canonical", "texts", "keys")
