"""Folds, n-grams, scripts, sound keys and language hints as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.functions.lexicons import LAST_CAP, LEGAL_FORMS, LENGTH_BUCKETS, LOCALE_PATTERNS, LOCALE_SCRIPTS, SCRIPTS, SPECIAL_LATIN, STRATEGY_CAPS

BLANK = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def fold_special_latin(c: Column) -> Column:
    single = {k: v for k, v in SPECIAL_LATIN.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in SPECIAL_LATIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def alnum(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def fold_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{S}]+", " ")


def fold_blanks(c: Column) -> Column:
    return trim_blanks(F.regexp_replace(c, f"{BLANK}+", " "))


def fold_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def drop_trailing_legal(c: Column) -> Column:
    """Without the legal forms at the end; the first word always stays."""
    return F.regexp_replace(c, rf"^(\S.*?)(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "$1")


def compact(folded: Column) -> Column:
    """Letters and digits of blank-folded text without trailing legal forms, unless that leaves less
    than two of at least two."""
    whole, short = alnum(folded), alnum(drop_trailing_legal(folded))
    return F.when((F.length(short) < 2) & (F.length(whole) >= 2), whole).otherwise(short)


def scripts(raw: Column) -> Column:
    found = F.filter(F.array(*[F.when(raw.rlike(p), F.lit(s)) for s, p in SCRIPTS.items()]), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Zyyy")))


def char_ngrams(c: Column, n: int) -> Column:
    """All substrings of n characters, repeats kept; none for shorter texts."""
    if n <= 0:
        raise ValueError("n must be positive")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, grams).otherwise(F.array().cast("array<string>"))


def affixes(c: Column, side: str) -> Column:
    """Prefixes or suffixes of two, three and four characters, where there are so many."""
    cutter = F.left if side == "prefix" else F.right
    return F.filter(F.array(*[F.when(F.length(c) >= n, cutter(c, F.lit(n))) for n in (2, 3, 4)]), lambda x: x.isNotNull())


def overlap_ratio(a: Column, b: Column, empty: float | None, kind: str = "jaccard") -> Column:
    """Jaccard or Dice of two arrays as sets; ``empty`` where both are empty."""
    shared, na, nb = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    value = shared / (na + nb - shared) if kind == "jaccard" else 2 * shared / (na + nb)
    return F.when(na + nb > 0, value).otherwise(F.lit(empty).cast("double"))


def strategy_cap(length: Column) -> Column:
    return reduce(lambda rest, s: F.when(length <= s[0], F.lit(s[1])).otherwise(rest), reversed(STRATEGY_CAPS), F.lit(LAST_CAP))


def length_bucket(length: Column) -> Column:
    return reduce(lambda rest, s: F.when(length <= s[0], F.lit(s[1])).otherwise(rest), reversed(LENGTH_BUCKETS), F.lit("very_long"))


# -- sound keys ------------------------------------------------------------------------------------


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda acc, s: F.regexp_replace(acc, *s), steps, c)


def second_sound_key(text: Column) -> Column:
    """Coarse key of four symbols: consonants, an initial vowel as A."""
    word = _chain(F.upper(text), ("[^A-Z]", ""))
    marked = _chain(word, ("CH|SH", "x"), ("PH", "f"), ("DG", "j"), ("^[AEIOU]", "a"), ("[AEIOU]", ""))
    coded = F.upper(F.translate(marked, "CGZ", "KKS"))
    return F.when(word == "", "").otherwise(F.rpad(coded, 4, "0"))


def cologne(text: Column) -> Column:
    """Digits by letter; C and X by their neighbours; runs collapse and trailing zeros go."""
    word = _chain(F.upper(F.replace(text, F.lit("ß"), F.lit("SS"))), ("[^A-ZÄÖÜ]", ""))
    plain = F.translate(word, "ÄÖÜ", "AOU")
    coded = _chain(plain, ("C(?=[AHKLOUQX])", "4"), ("C", "8"), ("X", "48"), ("H", ""))
    digits = F.translate(coded, "DTZPGQYAEIOUBFVWJKSLMNR", "88834410000013334445667")
    return _chain(digits, (r"(.)\1+", "$1"), ("0+$", ""))


def nysiis(text: Column) -> Column:
    word = _chain(F.upper(text), ("[^A-Z]", ""))
    head = F.when(word.startswith("MAC"), _chain(word, ("^MAC", "MCC"))).when(word.startswith("KN"), _chain(word, ("^KN", "NN")))
    head = head.when(word.startswith("K"), _chain(word, ("^K", "C"))).when(word.rlike("^P[HF]"), _chain(word, ("^P[HF]", "FF")))
    head = head.when(word.startswith("SCH"), _chain(word, ("^SCH", "SSS"))).otherwise(word)
    body = F.translate(_chain(head, ("EV", "AF"), ("[AEIOU]", "A")), "QZM", "GSN")
    body = _chain(body, ("KN", "N"), ("K", "C"), ("PH", "F"), ("SH", "S"), ("TH", "T"), ("(DT|RT|RD|NT)$", "D"))
    once = _chain(body, ("(?<!^)A", ""), (r"(.)\1+", "$1"))
    return _chain(once, ("S$", ""), ("AY$", "Y"), ("A$", ""))


def dutch_key(text: Column, strip_vowels: bool = True) -> Column:
    word = _chain(F.lower(text), ("[^a-z]", ""), ("ij", "y"), ("ph", "f"), ("oe", "u"), ("eu", "u"), ("ui", "uy"), ("ch", "g"), ("z", "s"))
    return F.regexp_replace(word, "[aeiouy]", "") if strip_vowels else word


def consonants(bare: Column) -> Column:
    """Consonants a-z of a lower-case text without combining marks."""
    return F.regexp_replace(bare, "[^b-df-hj-np-tv-xz]", "")


def phoneme_letters(bare: Column) -> Column:
    """Letters a-z one by one, y as i."""
    letters = F.translate(F.regexp_replace(bare, "[^a-z]", ""), "y", "i")
    return F.when(letters != "", F.split(letters, "")).otherwise(F.array().cast("array<string>"))


# -- language hints --------------------------------------------------------------------------------

HYPOTHESES = "array<struct<locale:string,probability:double,evidence_codes:array<string>>>"


def language_hypotheses(text: Column, explicit: Column | None = None) -> Column:
    """Locales with their greatest probability and all evidence, the most probable first; explicit
    locales, where given, are taken alone."""
    hint = lambda locale, p, code: F.struct(F.lit(locale).alias("l"), F.lit(p).alias("p"), F.lit(code).alias("e"))
    # Word ends are those of A-Z, digits and the underscore alone.
    ends = lambda r: r.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    tests = [(r, hint(loc, p, code)) for loc, code, r, p in LOCALE_SCRIPTS] + [
        ("(?i)(?u)" + ends(r), hint(loc, 0.72, code)) for loc, code, r in LOCALE_PATTERNS
    ]
    seen = F.filter(F.array(*[F.when(text.rlike(r), h) for r, h in tests]), lambda h: h.isNotNull())
    given = F.transform(
        F.array_distinct(explicit),
        lambda x: F.struct(x.alias("l"), F.lit(0.95).alias("p"), F.lit("EXPLICIT_LOCALE").alias("e")),
    ) if explicit is not None else None
    hints = F.when(F.size(seen) > 0, seen).otherwise(F.array(hint("und", 0.25, "FALLBACK_UNKNOWN")))
    if given is not None:
        hints = F.when(F.size(explicit) > 0, given).otherwise(hints)
    names = F.array_distinct(F.transform(hints, lambda h: h["l"]))

    def merged(name: Column, place: Column) -> Column:
        own = F.filter(hints, lambda h: h["l"] == name)
        return F.struct(
            (-F.array_max(F.transform(own, lambda h: h["p"]))).alias("m"),
            place.alias("i"),
            name.alias("l"),
            F.array_distinct(F.transform(own, lambda h: h["e"])).alias("e"),
        )

    ordered = F.array_sort(F.transform(names, merged))
    return F.transform(ordered, lambda h: F.struct(h["l"].alias("locale"), (-h["m"]).alias("probability"), h["e"].alias("evidence_codes")))
