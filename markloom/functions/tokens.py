"""Roles of tokens, distinctive cores and split hypotheses as Column expressions.

All functions take ``tokens``: array<struct<raw, normalized>> as ``text_forms`` gives it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.functions.lexicons import FUNCTION_WORDS, LEGAL_FORMS, WEAK_WORDS


def role(word: Column) -> Column:
    return (
        F.when(word == "", "unknown")
        .when(word.rlike(r"^\p{N}+$"), "numeral")
        .when(word.isin(LEGAL_FORMS), "legal_form")
        .when(word.isin(FUNCTION_WORDS), "function_word")
        .when(word.isin(WEAK_WORDS), "descriptive_weak")
        .when(word.rlike(r"\p{L}"), "distinctive")
        .otherwise("unknown")
    )


def with_roles(tokens: Column) -> Column:
    """array<struct<word, idx, role>>"""
    return F.transform(tokens, lambda t, i: F.struct(t["normalized"].alias("word"), i.alias("idx"), role(t["normalized"]).alias("role")))


def words(roled: Column, *roles: str) -> Column:
    return F.transform(F.filter(roled, lambda t: t["role"].isin(*roles)), lambda t: t["word"])


def significant(roled: Column) -> Column:
    return F.filter(words(roled, "distinctive", "unknown"), lambda w: w != "")


def noise(roled: Column) -> Column:
    return words(roled, "descriptive_weak", "legal_form", "function_word", "numeral")


def dominance(roled: Column) -> Column:
    """The five heaviest significant tokens: array<struct<token, weight, index, role>>.

    Length weighs most, earlier tokens a little more, three letters or less cost five; unknown tokens
    count 0.7.
    """
    n = F.size(roled)

    def weigh(t: Column) -> Column:
        share = F.when(t["role"] == "distinctive", 1.0).otherwise(0.7)
        size = F.length(t["word"])
        weight = size * 3 * share + (n - t["idx"]) * 0.35 * share - F.when(size <= 3, 5 * share).otherwise(0.0)
        return F.struct((-weight).alias("w"), t["idx"].alias("index"), t["word"].alias("token"), t["role"].alias("role"))

    real = F.filter(roled, lambda t: t["role"].isin("distinctive", "unknown") & (t["word"] != ""))
    ordered = F.slice(F.array_sort(F.transform(real, weigh)), 1, 5)
    return F.transform(ordered, lambda t: F.struct(t["token"], (-t["w"]).alias("weight"), t["index"], t["role"]))


#: Endings that a compound may have: the longest first, as listed among equals; three letters or more.
ENDINGS = sorted((w for w in dict.fromkeys(LEGAL_FORMS + WEAK_WORDS) if len(w) >= 3), key=len, reverse=True)


def compound_splits(roled: Column) -> Column:
    """array<struct<tokens, merged, reason>>: words of six letters or more that end in a noise word
    after a distinctive head of three or more."""

    def split(t: Column) -> Column:
        word = t["word"]
        head = lambda e: F.left(word, F.length(word) - F.length(e))
        able = lambda e: F.endswith(word, e) & (F.length(word) - F.length(e) >= 3) & (role(head(e)) == "distinctive")
        ending = F.get(F.filter(F.array(*map(F.lit, ENDINGS)), able), F.lit(0))
        return F.when((F.length(word) >= 6) & ((F.size(roled) == 1) | (t["role"] == "distinctive")), ending)

    found = F.filter(F.transform(roled, lambda t: F.struct(t["word"].alias("w"), split(t).alias("e"))), lambda s: s["e"].isNotNull())
    return F.transform(
        found,
        lambda s: F.struct(
            F.array(F.left(s["w"], F.length(s["w"]) - F.length(s["e"])), s["e"]).alias("tokens"),
            s["w"].alias("merged"),
            F.lit("agglutinated-noise-suffix-split").alias("reason"),
        ),
    )


def merge_hypotheses(roled: Column) -> Column:
    """Compound splits, then the first two words joined, then all significant words joined."""
    named = F.filter(F.transform(roled, lambda t: t["word"]), lambda w: w != "")
    joined = lambda ws, why: F.struct(ws.alias("tokens"), F.array_join(ws, "").alias("merged"), F.lit(why).alias("reason"))
    sig = significant(roled)
    more = F.array(
        F.when(F.size(named) >= 2, joined(F.slice(named, 1, 2), "adjacent-token-merge")),
        F.when(F.size(sig) >= 2, joined(sig, "significant-merge")),
    )
    return F.concat(compound_splits(roled), F.filter(more, lambda h: h.isNotNull()))


def core_keys(sig: Column) -> Column:
    """Lookup keys of the distinctive core: all significant words joined, then each of them from three
    letters on if it is alone and from six on beside others."""
    least = F.when(F.size(sig) >= 2, 6).otherwise(3)
    whole = F.array_join(sig, "")
    return F.array_distinct(
        F.concat(
            F.when(F.length(whole) >= 2, F.array(whole)).otherwise(F.array().cast("array<string>")),
            F.filter(sig, lambda w: F.length(w) >= least),
        )
    )
