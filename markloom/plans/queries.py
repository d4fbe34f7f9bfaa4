"""Queries over the core operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markloom.functions import strings as S
from markloom.functions import tokens as K
from markloom.functions.scalars import edit_udf, string_metrics, text_forms, weighted_cost_udf, weighted_trace_udf
from markloom.operators import advice, etl, evaluate
from markloom.operators import retrieve as R
from markloom.operators.compare import band, explain, prune, with_features, with_goods, with_plain_score, with_score
from markloom.operators.rank import families, family_key, rank_results
from markloom.operators.represent import phonetic_keys, represent
from markloom.plans import scan
from markloom.runtime import cut, scratch_path, table
from markloom.sources.corpus import read_source

REPR = "trademark_normalized_representation"


def _latest_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The last delivery of each mark."""
    cols = ("mark_text", "status_code", "normalized_status", "nice_classes", "is_text_searchable", "filing_date")
    packed = F.struct("mapped_at", "created_at", "source_hash", *cols)
    return table(spark, sf, "trademark").groupBy("id").agg(F.max(packed).alias("m")).select("id", *[f"m.{c}" for c in cols])


def _name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned names and the marks that were hit, each pair once."""
    runs = table(spark, sf, "scan_run").select("scan_id", "input_text").distinct()
    return table(spark, sf, "retrieval_hit").select("scan_id", "mark_text").distinct().join(runs, "scan_id").select(
        F.col("input_text").alias("a"),
        F.col("mark_text").alias("b"),
    ).dropna().distinct()


def _joined(column: str, by: str) -> Column:
    return F.array_join(column, by)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that cost far more than their bytes tell, over all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# -- strings -----------------------------------------------------------------------------------------


def fold_part_names(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey",
        S.fold_punctuation(low).alias("punctuation_folded"),
        S.fold_blanks(S.fold_punctuation(low)).alias("whitespace_folded"),
        S.fold_ascii(low).alias("ascii_folded"),
        S.compact(S.fold_blanks(S.fold_punctuation(low))).alias("compact"),
    )


def represent_marks(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "trademark").select("id", "mark_text").distinct()
    plain = ("unicode_nfc", "unicode_nfkc", "punctuation_folded", "case_folded", "diacritics_folded", "whitespace_folded", "ascii_folded", "compact", "dominant_token")
    derived = ("core_compact", "primary_key", "secondary_key", "skeleton")
    listed = [_joined(f"r.{f}", ",").alias(f) for f in ("scripts", "tokens", "significant_tokens", "noise_tokens")]
    variants = _joined("r.transliterations", "|").alias("transliterations")
    return represent(marks).select("id", *[f"r.{f}" for f in (*plain, *derived)], *listed, variants)


def detect_scripts(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "trademark").select("id", "mark_text").distinct()
    return marks.select("id", F.array_join(S.scripts(F.col("mark_text")), ",").alias("scripts"))


def compact_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, REPR).select("trademark_id", "compact").distinct()
    join = lambda c: F.array_join(c, ",")
    return rows.select(
        "trademark_id",
        join(S.char_ngrams(F.col("compact"), 2)).alias("bigrams"),
        join(S.char_ngrams(F.col("compact"), 3)).alias("trigrams"),
        join(S.affixes(F.col("compact"), "prefix")).alias("prefixes"),
        join(S.affixes(F.col("compact"), "suffix")).alias("suffixes"),
    )


def gram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    g = _name_pairs(spark, sf).withColumns({"x": S.char_ngrams(F.col("a"), 3), "y": S.char_ngrams(F.col("b"), 3)})
    ratio = lambda kind: F.round(S.overlap_ratio(F.col("x"), F.col("y"), 1.0, kind), 6)
    return g.select("a", "b", ratio("dice").alias("dice"), ratio("jaccard").alias("jaccard"))


def edit_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances in characters, and the similarity that goes with the first."""
    m = _spread(_name_pairs(spark, sf)).withColumn("m", edit_udf("a", "b"))
    longest = F.greatest(F.length("a"), F.length("b"))
    similarity = F.when(longest > 0, 1 - F.col("m.levenshtein") / longest).otherwise(1.0)
    return m.select(
        "a",
        "b",
        *[F.col(f"m.{c}").cast("bigint").alias(c) for c in ("levenshtein", "damerau")],
        F.round(similarity, 6).alias("similarity"),
    )


def jaro_similarities(spark: SparkSession, sf: str) -> DataFrame:
    m = _name_pairs(spark, sf).withColumn("m", string_metrics(F.lower("a"), F.lower("b")))
    return m.select("a", "b", *[F.round(f"m.{f}", 6).alias(f) for f in ("jaro", "jaro_winkler", "lcs_similarity")])


def plain_scores(spark: SparkSession, sf: str) -> DataFrame:
    return with_plain_score(_name_pairs(spark, sf), "a", "b")


def token_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "trademark").select("id", "mark_text").distinct()
    return represent(marks).select("id", F.explode("r.merged_hypotheses").alias("h")).select(
        "id",
        F.array_join("h.tokens", ",").alias("tokens"),
        "h.merged",
        "h.reason",
    )


def weighted_edits(spark: SparkSession, sf: str) -> DataFrame:
    w = _spread(_name_pairs(spark, sf)).withColumn("w", weighted_cost_udf("nl")("a", "b"))
    return w.select("a", "b", F.round("w.raw_cost", 6).alias("raw_cost"), F.round("w.similarity", 6).alias("similarity"))


def weighted_edit_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that were used and the number of steps; of equal costs the first way counts."""
    w = _name_pairs(spark, sf).withColumn("w", weighted_trace_udf("nl")("a", "b"))
    return w.select("a", "b", "w.rules", "w.operations")


def transliterations(spark: SparkSession, sf: str) -> DataFrame:
    marks = table(spark, sf, "trademark").select("mark_text").distinct()
    return marks.select("mark_text", F.array_join(text_forms("mark_text")["variants"], "|").alias("variants"))


def token_roles(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, REPR).select(F.explode("tokens").alias("t")).select(
        F.lower(S.trim_blanks(F.col("t"))).alias("word")
    ).distinct().filter("word is not null")
    return words.select("word", K.role(F.col("word")).alias("role"))


def token_cores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, REPR).select("trademark_id", "tokens").distinct().filter("tokens is not null")
    folded = F.transform("tokens", lambda t: F.struct(t.alias("raw"), S.alnum(F.lower(t)).alias("normalized")))
    roled = rows.select("trademark_id", "tokens", K.with_roles(F.filter(folded, lambda t: t["normalized"] != "")).alias("r"))
    core = roled.select(
        "trademark_id",
        "tokens",
        K.significant(F.col("r")).alias("sig"),
        K.noise(F.col("r")).alias("noise"),
        K.dominance(F.col("r")).alias("dom"),
    )
    fields = {
        "significant": F.col("sig"),
        "noise": F.col("noise"),
        "dominant": F.transform("dom", lambda d: d["token"]),
        "core_keys": K.core_keys(F.col("sig")),
    }
    weights = F.transform("dom", lambda d: F.format_string("%.4f", d["weight"]))
    listed = [F.array_join(c, ",").alias(n) for n, c in (fields | {"weights": weights}).items()]
    return core.select("trademark_id", *listed, F.array_join("sig", "").alias("core_compact")).distinct()


def sound_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, REPR).select(F.col("ascii_folded").alias("t")).distinct().filter("t is not null")
    t = F.col("t")
    return rows.select(
        "t",
        S.second_sound_key(t).alias("second_key"),
        S.nysiis(t).alias("nysiis"),
        S.cologne(t).alias("cologne"),
        S.dutch_key(t).alias("dutch"),
        S.consonants(F.lower(t)).alias("skeleton"),
        F.array_join(S.phoneme_letters(F.lower(t)), "").alias("phonemes"),
    )


def phonetic_key_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, REPR).select(
        "trademark_id",
        F.coalesce(F.nullif("diacritics_folded", F.lit("")), "compact").alias("t"),
    ).distinct()
    return phonetic_keys(rows, "trademark_id", "t").distinct()


def languages(spark: SparkSession, sf: str) -> DataFrame:
    """All hypotheses of each text, the most probable first."""
    marks = table(spark, sf, "trademark").select("mark_text").dropna().distinct()
    found = marks.select("mark_text", F.posexplode(S.language_hypotheses(F.col("mark_text"))).alias("place", "h"))
    evidence = F.array_join("h.evidence_codes", ",").alias("evidence")
    return found.select("mark_text", "place", "h.locale", F.round("h.probability", 6).alias("probability"), evidence)


def explicit_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the locales that are delivered with a mark count alone."""
    marks = table(spark, sf, "trademark").select("mark_text", "source_languages").dropna(subset=["mark_text"]).distinct()
    best = F.transform(
        S.language_hypotheses(F.col("mark_text"), F.col("source_languages")),
        lambda h: F.concat_ws(":", h["locale"], h["evidence_codes"]),
    )
    return marks.select("mark_text", F.array_join("source_languages", ",", "?").alias("given"), F.array_join(best, "|").alias("hypotheses"))


# -- intake ------------------------------------------------------------------------------------------


def status_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "trademark").select("status_code").distinct()
    return rows.select(
        "status_code",
        etl.normalize_status(F.col("status_code")).alias("normalized"),
        etl.source_status(F.col("status_code")).alias("allowed"),
    )


def _source_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "trademark")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.select(
        F.col("source_record_id").alias("application_number"),
        F.col("mark_text").alias("mark_name"),
        F.col("status_code").alias("status"),
        "nice_classes",
        day("filing_date").alias("application_date"),
        day("registration_date").alias("registration_date"),
        "mapped_at",
        "created_at",
    )


def read_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows, written in each format and read back with the fixed schema."""
    rows = _source_rows(spark, sf).drop("mapped_at", "created_at").distinct()
    out = None
    for kind in ("parquet", "orc", "json"):
        at = scratch_path(spark, f"source-{kind}")
        rows.write.format(kind).save(at)
        back = read_source(spark, at, kind).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out.withColumn("nice_classes", F.array_join(F.col("nice_classes").cast("array<string>"), ","))


def source_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = etl.coerce_row(_source_rows(spark, sf)).distinct()
    return rows.select("application_number", etl.row_hash().alias("hash")).distinct()


def intake_marks(spark: SparkSession, sf: str) -> DataFrame:
    mapped = etl.map_rows(etl.intake(_source_rows(spark, sf))).distinct()
    return mapped.select(
        "id",
        "mark_text",
        "normalized_status",
        "is_text_searchable",
        F.size("goods").cast("bigint").alias("goods"),
        F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"),
    ).distinct()


def _deliveries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "trademark").select("id", F.lower("source_hash").alias("hash"), "mapped_at", "created_at")
    middle = F.lit("2026-02-01").cast("timestamp")
    last = lambda d: d.groupBy("id").agg(F.max(F.struct("mapped_at", "created_at", "hash")).alias("m")).select("id", "m.hash")
    return last(t.filter(F.col("mapped_at") < middle)), last(t.filter(F.col("mapped_at") >= middle))


def delivery_actions(spark: SparkSession, sf: str) -> DataFrame:
    stored, current = _deliveries(spark, sf)
    return etl.hash_diff(current, stored, ["id"], "hash").select("id", "action")


def register_after_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored, current = _deliveries(spark, sf)
    return etl.upsert(current, stored, ["id"], "hash")


def purge_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """(part, id, rows): what remains of each table."""
    kept = etl.purge(table(spark, sf, "trademark"), {"repr": table(spark, sf, REPR)})
    count = lambda d, part, key: d.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(part).alias("part"), "id", "rows")
    return count(kept["trademark"], "trademark", "id").unionByName(count(kept["repr"], "representation", "trademark_id"))


def intake_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row of counts for each of two deliveries that are taken in one after the other."""
    rows = _source_rows(spark, sf)
    middle = F.lit("2026-02-01").cast("timestamp")
    batch = lambda n, d: etl.run_log(f"batch-{n}", *d)
    last = lambda d: etl.newest(etl.map_rows(d, keep=["mapped_at", "created_at"]), ["id"], ["mapped_at", "created_at", "source_hash"])
    first, second = rows.filter(F.col("mapped_at") < middle), rows.filter(F.col("mapped_at") >= middle)
    allowed = lambda d: etl.intake(d, keep=["mapped_at", "created_at"])
    stored, current = last(allowed(first)), last(allowed(second))
    return batch(1, (first, allowed(first), stored, stored.limit(0))).unionByName(batch(2, (second, allowed(second), current, stored)))


def representation_store(spark: SparkSession, sf: str) -> DataFrame:
    """The representation table after one more run: marks that lack one get theirs, stored rows of others stay."""
    stored = etl.newest(table(spark, sf, REPR), ["trademark_id"], ["normalization_version", "created_at", "compact"])
    todo = etl.not_represented(_latest_marks(spark, sf), stored)
    reps, keys = etl.preprocess(todo)
    known = stored.select(F.col("trademark_id"), F.lit("und").alias("locale"), F.lit("stored").alias("algorithm"), F.lit("_").alias("key"))
    after = etl.store_representations(reps, stored, keys, known)
    sounds = after[1].groupBy("trademark_id").agg(F.count(F.lit(1)).alias("sound_keys"))
    return after[0].select("trademark_id", "compact").join(sounds, "trademark_id")


def sound_key_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Represented marks that have no sound key yet."""
    reps = table(spark, sf, REPR)
    keys = reps.filter("size(consonant_skeletons) > 0 and normalization_version < '1.0.3'").select("trademark_id")
    return etl.missing_sound_keys(reps.select("trademark_id").distinct(), keys)


def marks_to_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return etl.not_represented(table(spark, sf, "trademark"), table(spark, sf, REPR)).select("id").distinct()


def preprocess_marks(spark: SparkSession, sf: str) -> DataFrame:
    reps, _ = etl.preprocess(_latest_marks(spark, sf).filter("is_text_searchable"))
    listed = [_joined(c, ",").alias(c) for c in ("tokens", "significant_tokens", "descriptive_tokens", "trigrams")]
    return reps.select("trademark_id", "compact", *listed, "dominant_token", "normalization_version")


def lookup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """What each scanned name is looked up by in the key tables."""
    names = table(spark, sf, "scan_run").select(F.col("input_text").alias("mark_text")).dropna().distinct()
    keyed = R.query_keys(represent(names))
    lists = ("exact_keys", "translit_keys", "full_grams", "core_grams", "spoken")
    return keyed.select("mark_text", *[_joined(c, ",").alias(c) for c in lists], F.col("cap").cast("bigint").alias("cap"))


# -- retrieval ---------------------------------------------------------------------------------------


def _marks_with_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable marks with the folds stored for them, once each."""
    ok = _latest_marks(spark, sf).filter("is_text_searchable").select("id", "mark_text")
    folds = table(spark, sf, REPR).groupBy(F.col("trademark_id").alias("id")).agg(
        F.max(F.struct("normalization_version", "created_at", *R.FORMS)).alias("r")
    )
    return folds.join(ok, "id")


def _watch_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = S.alnum(F.lower("watch_text"))
    return table(spark, sf, "watch_name").select(
        F.col("watch_id").alias("query_id"),
        F.array(key).alias("keys"),
        S.strategy_cap(F.length(key)).alias("cap"),
    )


def _scan_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names as they were scanned."""
    key = S.alnum(F.lower("input_text"))
    return table(spark, sf, "scan_run").select(
        F.col("scan_id").alias("query_id"),
        F.array(key).alias("keys"),
        S.strategy_cap(F.length(key)).alias("cap"),
    ).dropna().distinct()


def retrieve_exact(spark: SparkSession, sf: str) -> DataFrame:
    marks, asked = _marks_with_folds(spark, sf), _scan_keys(spark, sf)
    hits = R.key_hits(
        asked,
        "keys",
        R.exact_key_table(marks),
        "exact_forms",
    ).join(marks.select("id", "mark_text"), "id").join(asked.select("query_id", "cap"), "query_id")
    return R.cap_hits(hits, [F.col("mark_text"), F.col("id")], F.col("cap"), most=S.LAST_CAP).select(
        "query_id",
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        "pre_cap",
    )


def retrieve_trigram(spark: SparkSession, sf: str) -> DataFrame:
    marks, asked = _marks_with_folds(spark, sf), _watch_keys(spark, sf)
    hits = R.trigram_hits(asked, "keys", R.trigram_table(marks)).join(asked.select("query_id", "cap"), "query_id")
    capped = R.cap_hits(hits.withColumn("score", F.round("score", 6)), [F.col("score").desc(), F.col("id")], F.col("cap"), most=S.LAST_CAP)
    return capped.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"), "pre_cap")


def retrieve_trigram_share(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.trigram_containment(_watch_keys(spark, sf), "keys", R.trigram_table(_marks_with_folds(spark, sf)), 0.5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def retrieve_trigram_share_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the operator's own least share on."""
    hits = R.trigram_containment(_watch_keys(spark, sf), "keys", R.trigram_table(_marks_with_folds(spark, sf)))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


def retrieve_phonetic(spark: SparkSession, sf: str) -> DataFrame:
    marks, asked = _marks_with_folds(spark, sf), _watch_keys(spark, sf)
    spoken = marks.select("id", F.coalesce(F.nullif(F.col("r.diacritics_folded"), F.lit("")), F.col("r.compact")).alias("t"))
    names = phonetic_keys(
        asked.select("query_id", F.get("keys", F.lit(0)).alias("t")),
        "query_id",
        "t",
    ).groupBy("query_id").agg(F.collect_set("key").alias("sound_keys"))
    hits = R.sound_hits(names, phonetic_keys(spoken, "id", "t")).join(marks.select("id", "mark_text"), "id").join(
        asked.select("query_id", "cap"),
        "query_id",
    )
    return R.cap_hits(hits, [F.col("mark_text"), F.col("id")], F.col("cap"), most=S.LAST_CAP).select(
        "query_id",
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        "pre_cap",
    )


def retrieve_nysiis(spark: SparkSession, sf: str) -> DataFrame:
    marks, asked = _marks_with_folds(spark, sf), _scan_keys(spark, sf)
    keys = marks.select("id", S.nysiis(F.col("r.ascii_folded")).alias("key")).filter("key <> ''")
    named = asked.withColumn("keys", F.filter(F.transform("keys", S.nysiis), lambda k: k != ""))
    return R.key_hits(named, "keys", keys, "phonetic").select("query_id", "id")


def _stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "retrieval_hit").filter(
        "trademark_id is not null and scan_id is not null and strategy is not null and score is not null and not isnan(score)"
    )
    return h.groupBy(F.col("scan_id").alias("query_id"), F.col("trademark_id").alias("id"), "strategy").agg(F.max("score").alias("score"))


def cap_strategies(spark: SparkSession, sf: str) -> DataFrame:
    capped = R.cap_hits(_stored_hits(spark, sf), [F.col("score").desc(), F.col("id")], F.lit(100))
    return capped.groupBy("query_id", "strategy").agg(
        F.count(F.lit(1)).alias("kept"),
        F.max("pre_cap").alias("pre_cap"),
        F.max("cap_reached").alias("cap_reached"),
    )


def unite_candidates(spark: SparkSession, sf: str) -> DataFrame:
    capped = R.cap_hits(_stored_hits(spark, sf), [F.col("score").desc(), F.col("id")], F.lit(100))
    u = R.unite(capped.select("query_id", "id", "strategy", "score", "rank"))
    return u.select(
        "query_id",
        "id",
        F.size("evidence").cast("bigint").alias("evidence"),
        F.array_join("strategies", ",").alias("strategies"),
        F.col("best_rank").cast("bigint").alias("best_rank"),
    )


def reserve_core_places(spark: SparkSession, sf: str) -> DataFrame:
    hits = _stored_hits(spark, sf)
    pick = lambda s: hits.filter(F.col("strategy") == s).select("query_id", "id", "score")
    return R.reserve_core(pick("trigram"), pick("phonetic"), F.lit(25)).select("query_id", "id", F.round("score", 6).alias("score"))


def fetch_hits(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "retrieval_hit").select(F.col("trademark_id").alias("id")).dropna()
    return R.fetch_by_ids(_latest_marks(spark, sf), ids).select("id", "mark_text")


def corpus_ready(spark: SparkSession, sf: str) -> DataFrame:
    return R.readiness(_latest_marks(spark, sf), table(spark, sf, REPR).select(F.col("trademark_id").alias("id")))


def names_of_input(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "scan_run").select("scan_id", "input_text").distinct()
    return runs.select("scan_id", F.posexplode(scan.split_names(F.col("input_text"))).alias("place", "name"))


# -- pairs -------------------------------------------------------------------------------------------


def _class_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each mark's classes as first and as last delivered."""
    t = table(spark, sf, "trademark").groupBy("id").agg(
        F.min(F.struct("mapped_at", "created_at", "source_hash", "nice_classes")).alias("f"),
        F.max(F.struct("mapped_at", "created_at", "source_hash", "nice_classes")).alias("l"),
    )
    return t.select(
        "id",
        F.coalesce("f.nice_classes", F.array().cast("array<int>")).alias("a"),
        F.coalesce("l.nice_classes", F.array().cast("array<int>")).alias("b"),
    )


def class_relations(spark: SparkSession, sf: str) -> DataFrame:
    g = with_goods(_class_pairs(spark, sf), "a", "b")
    return g.select(
        "id",
        F.round("goods.class_overlap", 6).alias("class_overlap"),
        F.round("goods.related_signal", 6).alias("related"),
        "goods.relationship",
        "goods.confidence",
    )


#: Features of a pair under the names they have in a flat row.
FLAT = {
    "exact": {"normalizedMatch": "normalized", "compactMatch": "compact", "caseFoldedMatch": "folded", "transliterationMatch": "translit"},
    "orthographic": {
        "levenshteinSimilarity": "lev", "damerauLevenshteinSimilarity": "dam", "jaroSimilarity": "jaro", "jaroWinklerSimilarity": "jw",
        "weightedEditSimilarity": "wed", "trigramDice": "dice", "lcsSimilarity": "lcs",
    },
    "token": {
        "dominantTokenOverlap": "dom", "tokenJaccard": "sig", "sharedRareTokenCount": "shared", "prefixOverlap": "pre", "suffixOverlap": "suf",
        "noiseOnlyOverlap": "noise", "coreCompactMatch": "core", "coreEmpty": "bare", "secondarySignificantOverlap": "second",
    },
    "phonetic": {"primaryKeyMatch": "key1", "secondaryKeyMatch": "key2", "pronunciationSimilarity": "sound", "skeletonMatch": "bones"},
    "conceptual": {"translationProximity": "meaning", "descriptiveOverlap": "plain"},
    "goodsServices": {"niceClassOverlap": "classes"},
}


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features, evidence, score and explanations of scanned names, for three classes, and the marks hit."""
    hits = table(spark, sf, "retrieval_hit").groupBy("scan_id", "mark_text").agg(F.max("nice_classes").alias("c"))
    runs = table(spark, sf, "scan_run").select("scan_id", "input_text").distinct()
    both = hits.join(runs, "scan_id").select(F.col("input_text").alias("a"), F.col("mark_text").alias("b"), "c").dropna(subset=["a", "b"])
    pairs = both.groupBy("a", "b").agg(F.max("c").alias("cb")).withColumn("ca", F.array(*map(F.lit, (9, 32, 35))))
    texts = pairs.select(F.col("a").alias("mark_text")).unionByName(pairs.select(F.col("b").alias("mark_text"))).distinct()
    names = cut(represent(texts))
    side = lambda n, r: names.select(F.col("mark_text").alias(n), F.col("r").alias(r))
    seen = with_features(pairs.join(side("a", "p"), "a").join(side("b", "c"), "b"), left_classes="ca", right_classes="cb")
    scored = with_score(cut(seen.select("a", "b", "features", "evidence_codes", "goods")), goods="goods")
    flat = [F.round(f"features.{family}.{n}", 6).alias(c) for family, own in FLAT.items() for n, c in own.items()]
    said = F.array_join(explain(F.col("evidence_codes"), F.col("a"), F.col("b"), "nl"), "|").alias("explanations")
    return scored.select("a", "b", *flat, F.array_join("evidence_codes", ",").alias("evidence"), "score.*", said)


def goods_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Goods lists of neighbouring parts: their sizes as classes, their names as texts, some of them missing."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    texts = F.when(F.col("p_partkey") % 7 > 0, F.array(F.col("text"), F.lit(" - "), F.lit("Cafés & more")))
    own = part.select("p_partkey", F.array("p_size", F.lit(35)).alias("c"), texts.alias("t"))
    next_ = own.select(
        (F.col("p_partkey") - F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(1)).alias("p_partkey"),
        F.col("c").alias("d"),
        F.col("t").alias("u"),
    )
    pairs = own.join(next_, "p_partkey").withColumn("d", F.when(F.col("p_partkey") % 3 > 0, F.col("d")))
    g = with_goods(pairs.dropDuplicates(["p_partkey", "u", "d"]), "c", "d", "t", "u")
    rounded = [F.round(f"goods.{n}", 6).alias(n) for n in ("class_overlap", "related_signal", "concrete_similarity", "coverage")]
    return g.select("p_partkey", *rounded, "goods.relationship", "goods.confidence", F.array_join("goods.warnings", ",").alias("warnings"))


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Stored candidate scores as a feature vector; what isn't stored is unknown."""
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id", "trademark_id"]).distinct()
    unknown = F.lit(None).cast("double")
    sound = F.when(
        F.col("feature_version") == "features-1",
        F.col("phonetic.pronunciation_similarity"),
    ).otherwise(F.col("phonetic.pronunciation_similarity") / 100)
    known = {
        "orthographic.jaroWinklerSimilarity": F.col("orthographic.jaro_winkler_similarity"),
        "orthographic.levenshteinSimilarity": F.col("strongest_retrieval_score"),
        "orthographic.trigramDice": F.col("orthographic.trigram_dice"),
        "token.significantOverlap": F.col("token_family.significant_overlap"),
        "token.tokenJaccard": F.col("token_family.significant_overlap"),
        "token.sharedRareTokenCount": F.col("token_family.shared_rare_token_count"),
        "phonetic.pronunciationSimilarity": sound,
    }
    names = {
        "exact": "normalizedMatch compactMatch caseFoldedMatch transliterationMatch",
        "orthographic": "levenshteinSimilarity damerauLevenshteinSimilarity jaroSimilarity jaroWinklerSimilarity weightedEditSimilarity trigramDice lcsSimilarity",
        "token": "dominantTokenOverlap tokenJaccard sharedRareTokenCount prefixOverlap suffixOverlap significantOverlap noiseOnlyOverlap coreCompactMatch coreEmpty secondarySignificantOverlap",
        "phonetic": "primaryKeyMatch secondaryKeyMatch pronunciationSimilarity skeletonMatch",
        "conceptual": "lexiconOverlap translationProximity descriptiveOverlap",
        "goodsServices": "niceClassOverlap conceptOverlap",
    }
    flat = {f"_f_{fam}_{n}": known.get(f"{fam}.{n}", unknown) for fam, ns in names.items() for n in ns.split()}
    parts = {fam: [F.col(f"_f_{fam}_{n}").alias(n) for n in ns.split()] for fam, ns in names.items()}
    parts["goodsServices"].append(F.lit("unknown").alias("coverage"))
    return c.withColumns(flat).withColumn("features", F.struct(*[F.struct(*p).alias(fam) for fam, p in parts.items()])).drop(*flat)


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = with_score(_stored_features(spark, sf))
    return s.select(
        "scan_id",
        "trademark_id",
        "created_at",
        F.col("score.score").alias("score"),
        F.col("score.risk_band").alias("risk_band"),
        F.col("score.confidence").alias("confidence"),
    ).drop("created_at").distinct()


def prune_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Pruning of the stored candidates by their stored scores, the lengths of both names and their hits."""
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id", "trademark_id"]).distinct()
    length = lambda text: F.length(S.alnum(F.lower(text)))
    names = table(spark, sf, "scan_run").groupBy("scan_id").agg(F.max(length("input_text")).alias("proposed"))
    marks = _latest_marks(spark, sf).select(F.col("id").alias("trademark_id"), length("mark_text").alias("candidate"))
    latin = F.coalesce(F.max((F.col("strategy") == "transliteration") & (F.col("score") >= 1)), F.lit(False))
    hits = table(spark, sf, "retrieval_hit").groupBy("scan_id", "trademark_id").agg(
        F.array_sort(F.collect_set("strategy")).alias("hit_by"),
        latin.alias("latin"),
    )
    both = c.join(names, "scan_id", "left").join(marks, "trademark_id", "left").join(hits, ["scan_id", "trademark_id"], "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    near, dice, shared = z("orthographic.jaro_winkler_similarity"), z("orthographic.trigram_dice"), z("token_family.significant_overlap")
    cheap = {
        "exactMatch": near >= 1,
        "phoneticKeyMatch": z("phonetic.pronunciation_similarity") >= 0.7,
        "transliterationExact": F.coalesce("latin", F.lit(False)),
        "trigramDice": dice,
        "prefixScore": near,
        "suffixScore": dice,
        "missingData": F.col("orthographic.jaro_winkler_similarity").isNull() & F.col("orthographic.trigram_dice").isNull(),
        "coreTokenHit": shared > 0,
        "noiseOnlyHit": (shared == 0) & (z("token_family.shared_rare_token_count") == 0) & (near >= 0.7),
    }
    families = F.coalesce("hit_by", F.array().cast("array<string>"))
    x = F.struct(*[v.alias(n) for n, v in cheap.items()])
    lengths = [F.coalesce(n, F.lit(0)) for n in ("proposed", "candidate")]
    d = both.select(
        "scan_id",
        "trademark_id",
        "created_at",
        x.alias("x"),
        families.alias("f"),
        lengths[0].alias("p"),
        lengths[1].alias("q"),
    )
    d = d.withColumn("d", prune(F.col("x"), F.col("f"), F.col("p"), F.col("q")))
    return d.select("scan_id", "trademark_id", "d.decision", "d.rule", _joined("d.reasons", ",").alias("reasons")).distinct()


# -- ranking, families, evaluation ---------------------------------------------------------------------


def _rankable(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id", "trademark_id"]).groupBy("scan_id", "trademark_id").agg(
        F.max(F.struct("created_at", "strongest_retrieval_score", "retrieval_strategy_count", "decision")).alias("m")
    )
    marks = _latest_marks(spark, sf).select(
        F.col("id"),
        "mark_text",
        "normalized_status",
        F.date_format("filing_date", "yyyy-MM-dd").alias("priority_date"),
    )
    level = F.when(F.col("m.decision") == "promote", "high").when(F.col("m.decision") == "keep", "medium").otherwise("low")
    rows = c.select(
        "scan_id",
        F.col("trademark_id").alias("id"),
        F.round(F.coalesce("m.strongest_retrieval_score", F.lit(0.0)) * 100, 2).alias("score"),
        level.alias("confidence"),
        F.coalesce("m.retrieval_strategy_count", F.lit(0)).alias("channel_count"),
    )
    return rows.join(marks, "id").withColumn("active_right", F.coalesce(F.col("normalized_status") == "registered", F.lit(False)))


def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rank_results(_rankable(spark, sf), ["scan_id"], spread=True).select(
        "scan_id",
        "id",
        F.col("position").cast("bigint").alias("position"),
    )


def group_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rankable(spark, sf).withColumn("family", family_key(S.alnum(F.lower("mark_text")), F.lit(None).cast("string"), F.col("id")))
    return families(rows, ["scan_id"], spread=True).select(
        "scan_id",
        "id",
        "member_count",
        F.col("position").cast("bigint").alias("position"),
    )


def scan_recall(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _rankable(spark, sf).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col("score").desc(), "id")),
    ).withColumnRenamed("scan_id", "query_id")
    want = table(spark, sf, "scan_candidate").filter(
        "decision = 'promote' and scan_id is not null and trademark_id is not null"
    ).select(F.col("scan_id").alias("query_id"), F.col("trademark_id").alias("id"))
    return evaluate.recall_at(ranked, want, 10).select("query_id", F.round("recall", 6).alias("recall"))


def critical_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the promoted candidates that were retrieved as hits."""
    pair = lambda d: d.select(F.col("scan_id").alias("query"), F.col("trademark_id").alias("candidate")).dropna().distinct()
    must = pair(table(spark, sf, "scan_candidate").filter("decision = 'promote'")).withColumn("must_retrieve", F.lit(True))
    found = evaluate.pair_recall(must, pair(table(spark, sf, "retrieval_hit")))
    return found.select(F.round("recall", 6).alias("recall"))


def scan_durations(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "scan_run").distinct().select(
        "engine_version",
        "status",
        (F.unix_micros("completed_at") - F.unix_micros("started_at")).alias("us"),
    )
    done = evaluate.nearest_rank(runs, ["engine_version", "status"], "us", {"p50": 0.5, "p95": 0.95})
    return done.select("engine_version", "status", "n", F.round("mean", 1).alias("mean"), "p50", "p95", "least", "greatest")


def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    reps = table(spark, sf, REPR)
    keys = reps.filter("size(consonant_skeletons) > 0").select("trademark_id")
    return evaluate.corpus_statistics(table(spark, sf, "trademark"), reps, keys)


def scan_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Stages that the candidates of a scan reached; the last one is still running unless the scan is done."""
    names = {"retrieved": "union", "pruned": "pruning", "compared": "comparison", "scored": "scoring"}
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id"]).select("scan_id", "current_stage").distinct()
    ended = F.max(F.col("status") == "completed")
    took = F.max(
        F.unix_micros(F.coalesce("completed_at", F.col("started_at") + F.expr("interval 5 seconds"))) - F.unix_micros("started_at")
    ) / 1000
    runs = table(spark, sf, "scan_run").groupBy("scan_id").agg(ended.alias("ended"), took.alias("elapsed_ms"))
    order = F.coalesce(*[F.when(F.col("current_stage") == k, i) for i, k in enumerate(names)], F.lit(-1))
    stage = F.coalesce(*[F.when(F.col("current_stage") == k, v) for k, v in names.items()])
    last = F.max("n").over(Window.partitionBy("scan_id"))
    rows = c.withColumn("n", order).withColumn("last", last).join(runs, "scan_id", "left")
    status = F.when(F.coalesce("ended", F.lit(False)) | (F.col("n") < F.col("last")), "complete").otherwise("running")
    seen = rows.select("scan_id", stage.alias("stage"), status.alias("status"), F.coalesce("elapsed_ms", F.lit(0.0)).alias("elapsed_ms"))
    done = evaluate.progress(seen)
    return done.select("scan_id", F.col("percent").cast("bigint").alias("percent"), F.col("ms_left").cast("bigint").alias("ms_left"))


def newest_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The last finished snapshot for each run mode, or the live counts where there is none."""
    runs = table(spark, sf, "preprocessing_run").distinct().filter(F.lower(S.trim_blanks(F.col("status"))) == "completed")
    modes = table(spark, sf, "preprocessing_run").select("run_mode").distinct().unionByName(
        spark.createDataFrame([("never",)], "run_mode string")
    )
    snapshots = runs.select(
        "run_mode",
        F.col("completed_at").alias("at"),
        "id",
        F.col("processed").cast("bigint").alias("marks"),
        F.col("succeeded").cast("bigint").alias("represented"),
    )
    live = corpus_counts(spark, sf).select("marks", "represented")
    return evaluate.newest_or_live(modes, snapshots, "run_mode", ["at", "id"], live)


def candidate_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What is handed out of each scan, with evidence from the stored scores."""
    newest = F.max(
        F.struct(
            "created_at",
            "strongest_retrieval_score",
            "retrieval_strategy_count",
            "decision",
            "orthographic",
            "token_family",
            "phonetic",
        )
    )
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id", "trademark_id"]).groupBy(
        "scan_id",
        F.col("trademark_id").alias("id"),
    ).agg(newest.alias("m"))
    tests = {
        "exact_compact": F.col("m.orthographic.jaro_winkler_similarity") >= 1,
        "orthographic_high": F.col("m.orthographic.jaro_winkler_similarity") >= 0.85,
        "phonetic_similar": F.col("m.phonetic.pronunciation_similarity") >= 0.7,
        "token_core_overlap": F.col("m.token_family.significant_overlap") >= 0.5,
        "goods_missing": F.lit(True),
        "unknown_code": F.lit(True),
    }
    codes = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    coded = c.select("scan_id", "id", codes.alias("evidence_codes"))
    classes = _latest_marks(spark, sf).select("id", "nice_classes")
    rows = _rankable(spark, sf).join(coded, ["scan_id", "id"]).join(classes, "id")
    rows = rows.withColumns({"status": F.col("normalized_status"), "risk_band": band(F.col("score"))})
    rows = rows.withColumn("explanations", explain(F.col("evidence_codes"), F.lit("x"), F.col("mark_text")))
    return advice.compact_candidates(rows, ["scan_id"], [F.col("score").desc(), F.col("id")], 10)


def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies about the scans of candidates, by turns sound, fenced, without an object, cut off, and out of range."""
    c = table(spark, sf, "scan_candidate").dropna(subset=["scan_id", "trademark_id"]).select("scan_id", "trademark_id").distinct()
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("trademark_id"))
    few = c.withColumn("n", place.cast("int")).filter("n <= 4")
    kind = F.pmod(F.conv(F.right(F.md5("scan_id"), F.lit(4)), 16, 10).cast("int"), F.lit(5))
    part = F.struct(F.lit("matig").alias("score"), F.lit(" lijkt erop ").alias("toelichting"))
    risk = F.struct(
        F.when((kind == 4) & (F.col("n") == 1), 11).otherwise(F.col("n")).alias("rank"),
        F.when(F.col("n") == 2, "nobody").otherwise(F.col("trademark_id")).alias("candidateId"),
        F.col("trademark_id").alias("markText"), F.lit(61.5).alias("engineScore"), F.lit("middel").alias("riskLevel"), F.repeat(F.lit("lang "), 60).alias("summary"),
        F.struct(*[part.alias(d) for d in advice.DIMENSIONS]).alias("dimensions"), F.lit("kans").alias("confusionRisk"), F.lit("dichtbij").alias("whySelected"),
    )
    risks = few.groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct("n", risk.alias("r")))).alias("l"),
        F.collect_list("trademark_id").alias("known"),
    )
    whole = F.struct(
        F.struct(F.lit("Zie onder.").alias("text"), F.lit("nader_onderzoek").alias("aanbeveling")).alias("overallAdvice"),
        F.transform("l", lambda x: x["r"]).alias("topRisks"),
    )
    json = F.to_json(whole)
    raw = F.when(
        kind == 1,
        F.concat(F.lit("Hier:\n```json\n"), json, F.lit("\n```\n")),
    ).when(kind == 2, "geen antwoord").when(kind == 3, F.concat(F.left(json, F.lit(200)), F.lit("}"))).otherwise(json)
    got = advice.parse_replies(risks.select("scan_id", "known", raw.alias("raw")), "raw", "known", 2)
    kept = _joined("advice.topRisks.candidateId", ",").alias("kept")
    length = F.length(F.get("advice.topRisks", F.lit(0))["summary"])
    risks = F.when(F.col("error").isNull(), F.size("advice.topRisks"))
    return got.select("scan_id", "error", risks.cast("double").alias("risks"), kept, length.cast("double").alias("summary_length"))


# -- scans -------------------------------------------------------------------------------------------


def _scan_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    corpus = _latest_marks(spark, sf).filter("is_text_searchable").select(
        "id",
        "mark_text",
        F.coalesce("nice_classes", F.array().cast("array<int>")).alias("nice_classes"),
        F.col("normalized_status").alias("status"),
        F.lit(None).cast("string").alias("owner"),
        F.date_format("filing_date", "yyyy-MM-dd").alias("priority_date"),
    )
    names = table(spark, sf, "watch_name").select(
        F.col("watch_id").alias("query_id"),
        F.col("watch_text").alias("mark_text"),
        F.array().cast("array<int>").alias("nice_classes"),
    ).distinct()
    return names, corpus


SCAN_COLUMNS = (
    "query_id",
    "id",
    "mark_text",
    "score",
    "risk_band",
    "confidence",
    "strategies",
    "evidence_codes",
    "explanations",
    "member_count",
    "position",
)


def _results(found: DataFrame) -> DataFrame:
    lists = {"strategies": ",", "evidence_codes": ",", "explanations": "|"}
    return found.select(
        *[_joined(c, lists[c]).alias(c) if c in lists else F.col(c) for c in SCAN_COLUMNS]
    ).withColumn("position", F.col("position").cast("bigint"))


def scan_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Which names each mark is a candidate of, and by what, from the comparison with all rows."""
    names, corpus = _scan_inputs(spark, sf)
    hits = scan.channel_hits(cut(scan.propose(names)), cut(represent(corpus)))
    return hits.select("query_id", "id", "strategy", F.round("score", 6).alias("score"))


def scan_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _results(scan.logical_scan(*_scan_inputs(spark, sf)))


def scan_by_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _results(scan.keyed_scan(*_scan_inputs(spark, sf)))


def scan_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return _results(scan.index_scan(*_scan_inputs(spark, sf)))


def scan_key_recall(spark: SparkSession, sf: str) -> DataFrame:
    """(results, found, recall): what the scan by keys finds of the results of the whole scan."""
    whole, keyed = (q(spark, sf).select("query_id", "id") for q in (scan_all_rows, scan_by_keys))
    both = whole.join(keyed.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    counts = both.agg(F.count(F.lit(1)).alias("results"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.coalesce(F.try_divide("found", "results"), F.lit(1.0)))



#: Every function above that isn't a helper.
QUERIES = {n: f for n, f in list(globals().items()) if not n.startswith("_") and getattr(f, "__module__", "") == __name__}
