"""Queries over the operators of this package, with the parameters they run with in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm.distinctive import distinctive_terms
from markloom.llm.fusion import clear_winners, fuse
from markloom.llm.leak import leaked_items, remove_leaks
from markloom.llm.lookalike import add_canonical, build_vocabulary, same_look_classes, same_look_pairs
from markloom.llm.overlap import clean_set, overlap_classes, overlap_pairs, overlap_pairs_between
from markloom.llm.packing import TOKENIZERS, add_token_count, pack, unused_space
from markloom.llm.quality import text_quality
from markloom.llm.topn import top_n
from markloom.runtime import cut, table

REPR = "trademark_normalized_representation"
CAPACITY = 2048


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = distinctive_terms(table(spark, sf_dir, REPR), "trademark_id", F.col("tokens"), shared_by=(2, 5))
    return weighed.filter("weight > 0").select(F.col("key").alias("trademark_id"), F.col("term").alias("token"))


def p2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = distinctive_terms(table(spark, sf_dir, REPR), "trademark_id", F.col("tokens"))
    return weighed.select(
        F.col("key").alias("trademark_id"),
        F.col("term").alias("token"),
        F.col("tf").cast("bigint").alias("tf"),
        "df",
        F.round("weight", 6).alias("weight"),
    )


def p2_descriptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = distinctive_terms(table(spark, sf_dir, REPR), "trademark_id", F.col("descriptive_tokens"))
    return weighed.select(
        F.col("key").alias("trademark_id"),
        F.col("term").alias("token"),
        F.col("tf").cast("bigint").alias("tf"),
        "df",
        F.round("weight", 6).alias("weight"),
    )


SCORES = {
    "jaro_winkler_similarity": "orthographic.jaro_winkler_similarity",
    "trigram_dice": "orthographic.trigram_dice",
    "pronunciation_similarity": "phonetic.pronunciation_similarity",
    "significant_overlap": "token_family.significant_overlap",
}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scan_candidate")
    return clear_winners(rows, "scan_id", "trademark_id", {s: F.col(c) for s, c in SCORES.items()}, least=3, prefer=[F.col("created_at")])


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scan_candidate")
    ranked = fuse(rows, "scan_id", "trademark_id", {s: F.col(c) for s, c in SCORES.items()}, prefer=[F.col("created_at")])
    return ranked.select("scan_id", "trademark_id", F.round("fused", 6).alias("fused"), F.col("place").cast("bigint").alias("place"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "trademark").select("id", "mark_text").distinct()
    pairs = same_look_pairs(marks, "id", "mark_text", build_vocabulary(marks, "mark_text"))
    return pairs.select(F.col("a").alias("trademark_id_a"), F.col("b").alias("trademark_id_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "trademark").select("id", "mark_text").distinct()
    return add_canonical(marks, "mark_text", build_vocabulary(marks, "mark_text")).select(
        F.col("id").alias("trademark_id"),
        "mark_text",
        "canonical",
    )


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "trademark").select("id", "mark_text").distinct()
    classes = same_look_classes(marks, "id", "mark_text", build_vocabulary(marks, "mark_text"))
    return classes.select(F.col("key").alias("trademark_id"), F.col("text").alias("mark_text"), "texts", "keys")


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters and more that are one edit away from a usual spelling take that spelling."""
    marks = table(spark, sf_dir, "trademark").select("id", "mark_text").distinct()
    usual = build_vocabulary(marks, "mark_text", least=10)
    near = add_canonical(marks.select("mark_text").distinct(), "mark_text", usual, "spelling", max_cost=1.0, shortest=6)
    return add_canonical(near, "mark_text", usual).filter("spelling <> canonical")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, names = table(spark, sf_dir, REPR), table(spark, sf_dir, "watch_name")
    tokens = overlap_pairs(marks, "trademark_id", clean_set(F.col("significant_tokens")), 0.6)
    grams = overlap_pairs_between(
        marks,
        "trademark_id",
        clean_set(F.col("trigrams"), trim=False),
        names,
        "watch_id",
        clean_set(F.col("trigrams"), trim=False),
        0.5,
    )
    tag = lambda d, f: d.select(F.lit(f).alias("set_field"), "key_a", "key_b")
    return tag(tokens, "significant_tokens").unionByName(tag(grams, "trigrams"))


def p5_trigrams_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram pairs of ``p5_found`` with no side broadcast, as for two large tables."""
    marks, names = table(spark, sf_dir, REPR), table(spark, sf_dir, "watch_name")
    grams = clean_set(F.col("trigrams"), trim=False)
    return overlap_pairs_between(marks, "trademark_id", grams, names, "watch_id", grams, 0.5, most=0)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, REPR)
    return overlap_classes(marks, "trademark_id", clean_set(F.col("significant_tokens")), 0.6).select(
        F.col("key").alias("trademark_id"),
        "copies",
        F.col("links").cast("bigint").alias("links"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(
        table(spark, sf_dir, "retrieval_hit"),
        ["scan_id", "strategy"],
        "trademark_id",
        "score",
        5,
    ).select("scan_id", "strategy", "trademark_id")


def p6_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n(table(spark, sf_dir, "retrieval_hit"), ["scan_id", "strategy"], "trademark_id", "score", 20)
    return best.select(
        "scan_id",
        "strategy",
        "trademark_id",
        F.round("score", 6).alias("score"),
        F.col("place").cast("bigint").alias("place"),
    )


def p7_sequences(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    docs = add_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer)
    return pack(cut(docs.select("doc_id", "n_tokens")), "doc_id", "n_tokens", capacity)


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much room the packing of ``p7_sequences`` leaves over."""
    return unused_space(p7_sequences(spark, sf_dir), CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "item_text")
    return found.select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        "text",
        table(spark, sf_dir, "eval_item"),
        "item_id",
        "item_text",
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), "doc_id", "text").filter("not prose").select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text_quality(table(spark, sf_dir, "documents"), "doc_id", "text")
    ratios = ("mean_word_length", "symbol_ratio", "digit_ratio", "ended_line_share", "common_word_share", "prose_share")
    counts = [F.col(c).cast("double").alias(c) for c in ("chars", "visible", "words", "lines")]
    return q.select("doc_id", *counts, *[F.round(r, 6).alias(r) for r in ratios], "kind")


QUERIES = {
    f.__name__: f for f in (
        p2_found,
        p2_weights,
        p2_descriptive_weights,
        p3_found,
        p3_ranking,
        p4_found,
        p4_forms,
        p4_classes,
        p4_spellings,
        p5_found,
        p5_trigrams_joined,
        p5_classes,
        p6_found,
        p6_top20,
        p7_sequences,
        p7_unused,
        p8_found,
        p8_cleaned,
        p9_found,
        p9_statistics,
    )
}
