"""Corpus intake: mapping, hash-diff upsert, purge, incremental preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions.lexicons import SOURCE_STATUSES, STATUS_GROUPS
from markloom.functions.strings import trim_blanks
from markloom.operators.represent import phonetic_keys, represent


def resolve_limit(explicit: int | str | None, setting: str | None = None, default: int = 100_000) -> int | None:
    """0 means no limit (None); unset the default; anything else must be a natural number."""
    raw = explicit if explicit is not None else setting
    if raw is None or str(raw).strip() == "":
        return default
    if not str(raw).strip().isdecimal():
        raise ValueError(f"not a limit: {raw!r}")
    return int(raw) or None


def source_status(code: Column) -> Column:
    """Whether rows of this status are taken in; null is not."""
    return F.coalesce(F.upper(trim_blanks(code)).isin(SOURCE_STATUSES), F.lit(False))


def normalize_status(code: Column) -> Column:
    clean = F.upper(trim_blanks(code))
    return F.coalesce(*[F.when(clean.isin(codes), F.lit(name)) for name, codes in STATUS_GROUPS.items()], F.lit("unknown"))


def coerce_row(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Source columns with text numbers cast, missing names empty, missing status unknown, no classes [];
    columns to ``keep`` are carried through."""
    return rows.select(
        F.col("application_number").cast("string").alias("application_number"),
        F.coalesce("mark_name", F.lit("")).alias("mark_name"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce(F.col("nice_classes").cast("array<int>"), F.array().cast("array<int>")).alias("nice_classes"),
        F.col("application_date").cast("string").alias("application_date"),
        F.col("registration_date").cast("string").alias("registration_date"),
        *keep,
    )


def row_hash() -> Column:
    """SHA-256 of the JSON of date, name, sorted classes, registration date and status."""
    payload = F.struct("application_date", "mark_name", F.sort_array("nice_classes").alias("nice_classes"), "registration_date", "status")
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def map_rows(rows: DataFrame, source: str = "corpus", keep: list[str] = ()) -> DataFrame:
    """Source rows as marks, with one goods stub per class."""
    at = lambda c: F.try_to_timestamp(F.col(c)).alias("filing_date" if c == "application_date" else c)
    stub = lambda k: F.struct(k.alias("nice_class"), F.lit(None).cast("string").alias("text"))
    return rows.select(
        F.concat_ws(":", F.lit(source), "application_number").alias("id"),
        F.lit(source).alias("source"),
        F.col("application_number").alias("source_record_id"),
        F.col("mark_name").alias("mark_text"),
        F.lit("word").alias("mark_type"),
        F.col("status").alias("status_code"),
        normalize_status(F.col("status")).alias("normalized_status"),
        at("application_date"),
        at("registration_date"),
        "nice_classes",
        (F.length(trim_blanks(F.col("mark_name"))) > 0).alias("is_text_searchable"),
        row_hash().alias("source_hash"),
        F.transform("nice_classes", stub).alias("goods"),
        *keep,
    )


def intake(rows: DataFrame, limit: int | None = None, keep: list[str] = ()) -> DataFrame:
    """Allowed rows in order of their number, up to a limit."""
    taken = coerce_row(rows, keep).filter(source_status(F.col("status")))
    return taken.orderBy("application_number").limit(limit) if limit else taken


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the greatest in ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.max(packed).alias("m")).select(*keys, "m.row.*")


def run_log(name: str, read: DataFrame, allowed: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of counts of an intake run: rows read, allowed and refused, marks inserted, updated and unchanged."""
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1))
    kinds = {"inserted": "insert", "updated": "update", "unchanged": "unchanged"}
    acted = hash_diff(current, stored, ["id"], "source_hash").agg(*[F.count_if(F.col("action") == v).alias(n) for n, v in kinds.items()])
    joined = count(read, "read").join(count(allowed, "allowed"), "_k").join(acted.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.select(F.lit(name).alias("run"), "read", "allowed", (F.col("read") - F.col("allowed")).alias("refused"), *kinds)


def hash_diff(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """``current`` with ``action``: insert, update or unchanged against the stored hashes."""
    old = stored.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(hash_col).alias("_o_hash"), F.lit(True).alias("_o_known"))
    joined = current.join(old, [current[k] == old[f"_o_{k}"] for k in keys], "left")
    action = F.when(F.col("_o_known").isNull(), "insert").when(
        F.col(hash_col).eqNullSafe(F.col("_o_hash")),
        "unchanged",
    ).otherwise("update")
    return joined.select(*[current[c] for c in current.columns], action.alias("action"))


def upsert(current: DataFrame, stored: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """The stored table after the merge: new and changed rows replace stored ones, the rest stays."""
    changed = hash_diff(current, stored, keys, hash_col).filter("action <> 'unchanged'").drop("action")
    return stored.join(changed.select(*keys), keys, "left_anti").unionByName(changed, allowMissingColumns=True)


def purge(marks: DataFrame, dependants: dict[str, DataFrame], allowed: list[str] = SOURCE_STATUSES) -> dict[str, DataFrame]:
    """Marks of allowed raw status and the rows of every dependent table (by trademark_id) that belong
    to them."""
    kept = marks.filter(F.col("status_code").isin(allowed))
    return {"trademark": kept} | {
        n: d.join(kept.select(F.col("id").alias("trademark_id")).distinct(), "trademark_id", "left_semi") for n, d in dependants.items()
    }


def not_represented(marks: DataFrame, represented: DataFrame) -> DataFrame:
    """Searchable marks without a representation."""
    return marks.filter("is_text_searchable").join(represented.select(F.col("trademark_id").alias("id")).distinct(), "id", "left_anti")


def preprocess(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representation and sound-key tables of ``marks``."""
    done = represent(marks)
    arrays = (
        "tokens",
        "significant_tokens",
        "weak_tokens",
        "company_suffix_tokens",
        "prefixes",
        "suffixes",
        "bigrams",
        "trigrams",
        "scripts",
    )
    folds = (
        "raw",
        "unicode_nfc",
        "unicode_nfkc",
        "case_folded",
        "diacritics_folded",
        "punctuation_folded",
        "whitespace_folded",
        "ascii_folded",
        "compact",
    )
    hypotheses = F.array().cast("array<struct<locale:string,probability:double,evidence_codes:array<string>>>").alias("language_hypotheses")
    table = done.select(
        F.col("id").alias("trademark_id"),
        *[f"r.{c}" for c in folds],
        *[f"r.{c}" for c in arrays],
        F.col("r.weak_tokens").alias("descriptive_tokens"),
        F.array("r.skeleton").alias("consonant_skeletons"),
        "r.dominant_token",
        "r.transliterations",
        hypotheses,
        "r.normalization_version",
    )
    spoken = done.select(
        F.col("id").alias("trademark_id"),
        F.when(F.col("r.diacritics_folded") != "", F.col("r.diacritics_folded")).otherwise(F.col("r.compact")).alias("t"),
    )
    return table, phonetic_keys(spoken, "trademark_id", "t")


def store_representations(done: DataFrame, stored: DataFrame, keys: DataFrame, stored_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a preprocessing run: new representations replace stored ones of their mark, and
    sound keys are added where that very key isn't stored yet."""
    mark = ["trademark_id"]
    kept = stored.join(done.select(*mark).distinct(), mark, "left_anti")
    fresh = keys.distinct().join(stored_keys, stored_keys.columns, "left_anti")
    return kept.unionByName(done, allowMissingColumns=True), stored_keys.unionByName(fresh)


def missing_sound_keys(represented: DataFrame, keys: DataFrame) -> DataFrame:
    """Represented marks without any sound key."""
    return represented.join(keys.select("trademark_id").distinct(), "trademark_id", "left_anti")
