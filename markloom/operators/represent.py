"""Derived columns of a mark: folds, tokens, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import strings as S
from markloom.functions import tokens as K
from markloom.functions.lexicons import VERSIONS
from markloom.functions.scalars import sound_key_udf, text_forms


def represent(rows: DataFrame, text: str = "mark_text") -> DataFrame:
    """``rows`` with a struct ``r`` of all derived values of ``text``.

    One pass through Python gives the Unicode forms, a second the sound key; the rest stays in
    generated code. A null text gives null forms.
    """
    base = rows.withColumn("_f", text_forms(F.col(text)))
    low = F.col("_f.bare")
    base = base.withColumn("_dia", S.fold_special_latin(low)).withColumn(
        "_punct",
        S.fold_punctuation(F.col("_dia")),
    ).withColumn("_blank", S.fold_blanks(F.col("_punct")))
    base = base.withColumn("_compact", S.compact(F.col("_blank"))).withColumn("_roled", K.with_roles(F.col("_f.tokens")))
    base = base.withColumn(
        "_sig",
        K.significant(F.col("_roled")),
    ).withColumn("_dom", K.dominance(F.col("_roled"))).withColumn("_core", F.array_join("_sig", ""))
    base = base.withColumn("_first", S.alnum(F.lower(F.get("_f.variants", F.lit(0)))))
    latin_core = (F.col("_core") != "") & F.col("_core").rlike(r"^[\p{IsLatin}\p{N}]*$")
    spoken = F.when(latin_core, F.col("_core")).when(
        F.col("_first") != "",
        F.col("_first"),
    ).when(F.col("_dia") != "", F.col("_dia")).otherwise(F.col("_compact"))
    base = base.withColumn("_spoken", spoken).withColumn("_key1", sound_key_udf("_spoken"))
    latin = F.when(
        (F.length("_first") < F.length("_compact")) & F.contains(F.col("_compact"), F.col("_first")) | (F.col("_first") == ""),
        F.col("_compact"),
    ).otherwise(F.col("_first"))
    base = base.withColumn("_latin", latin)
    base = base.withColumn("_merged", K.merge_hypotheses(F.col("_roled")))
    forms = F.array_distinct(F.filter(F.array("_compact", "_latin", "_core"), lambda x: x.isNotNull() & (x != "")))
    off_script = (F.col("_core") != "") & (F.col("_latin") != "") & (
        F.col("_core") != F.col("_latin")
    ) & ~F.col("_core").rlike(r"^[\p{IsLatin}\p{N}]*$")
    core = F.when(off_script | (F.col("_core") == ""), F.col("_latin")).otherwise(F.col("_core"))
    keys = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: S.alnum(F.lower(v))), lambda v: v != ""))
    fields = {
        "raw": F.col(text),
        "unicode_nfc": F.col("_f.nfc"),
        "unicode_nfkc": F.col("_f.nfkc"),
        "case_folded": F.col("_f.lower"),
        "diacritics_folded": F.col("_dia"),
        "punctuation_folded": F.col("_punct"),
        "whitespace_folded": F.col("_blank"),
        "ascii_folded": S.fold_ascii(F.col("_dia")),
        "compact": F.col("_compact"),
        "scripts": S.scripts(F.col(text)),
        "tokens": F.filter(F.transform("_roled", lambda t: t["word"]), lambda w: w != ""),
        "roles": F.transform("_roled", lambda t: t["role"]),
        "significant_tokens": F.col("_sig"),
        "weak_tokens": K.words(F.col("_roled"), "descriptive_weak"),
        "company_suffix_tokens": K.words(F.col("_roled"), "legal_form"),
        "noise_tokens": K.noise(F.col("_roled")),
        "n_tokens": F.size("_roled"),
        "dominance": F.col("_dom"),
        "dominant_token": F.get("_dom", F.lit(0))["token"],
        "core_compact": F.col("_core"),
        "merged_hypotheses": F.col("_merged"),
        "compound_used": F.exists("_merged", lambda h: h["reason"] == "agglutinated-noise-suffix-split"),
        "prefixes": S.affixes(F.col("_compact"), "prefix"),
        "suffixes": S.affixes(F.col("_compact"), "suffix"),
        "bigrams": S.char_ngrams(F.col("_compact"), 2),
        "trigrams": S.char_ngrams(F.col("_compact"), 3),
        "transliterations": F.col("_f.variants"),
        "translit_keys": keys(F.col("_f.variants")),
        "core_keys": K.core_keys(F.col("_sig")),
        "forms": forms,
        "affix_core": core,
        "spoken": F.col("_spoken"),
        "primary_key": F.col("_key1"),
        "secondary_key": S.second_sound_key(F.col("_spoken")),
        "skeleton": S.consonants(F.lower("_spoken")),
        "family_key": F.col("_f.family"),
        "normalization_version": F.lit(VERSIONS["normalization"]),
    }
    flat = base.withColumns({f"_r_{k}": v for k, v in fields.items()})
    return flat.select(*rows.columns, F.struct(*[F.col(f"_r_{k}").alias(k) for k in fields]).alias("r"))


def phonetic_keys(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, locale, algorithm, key value): sound keys of ``text`` (already without marks), one row each
    without repeats; a text without any gets the sentinel (und, unencodable, _)."""
    spoken = rows.select(F.col(key).alias("id"), S.alnum(F.lower(F.col(text))).alias("t")).withColumn("k1", sound_key_udf("t"))
    pair = lambda a, k: F.struct(F.lit(a).alias("algorithm"), k.alias("key"))
    made = F.array(
        pair("double_metaphone", F.col("k1")),
        pair("double_metaphone", S.second_sound_key(F.col("t"))),
        pair("nysiis", S.nysiis(F.col("t"))),
    )
    real = F.array_distinct(F.filter(made, lambda p: p["key"] != ""))
    keys = F.when(F.size(real) > 0, real).otherwise(F.array(pair("unencodable", F.lit("_"))))
    return spoken.select("id", F.lit("und").alias("locale"), F.inline(keys)).withColumnRenamed("id", key)
