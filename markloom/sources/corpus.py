"""Readers with fixed schemas, writers, and the small sample corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE = "application_number string, mark_name string, status string, nice_classes array<int>, application_date string, registration_date string"
MARK = (
    "id string, source string, source_record_id string, mark_text string, mark_type string, status_code string, normalized_status string, filing_date timestamp, registration_date timestamp, "
    "nice_classes array<int>, territories array<string>, source_languages array<string>, is_text_searchable boolean, source_hash string, mapping_version string, mapped_at timestamp"
)


def read_source(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Source rows from Parquet, ORC or JSON lines; the schema is never inferred."""
    if kind not in ("parquet", "orc", "json"):
        raise ValueError(f"unknown kind {kind!r}")
    return spark.read.schema(SOURCE).format(kind).load(path)


def read_source_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Source rows from a database table; filters on status are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*[f.split()[0] for f in SOURCE.split(", ")])


def write_keys(rows: DataFrame, path: str, key: str, files: int = 64) -> None:
    """A key table, one sorted file per hash range of the key, for lookups by key."""
    rows.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def sample_corpus(spark: SparkSession) -> DataFrame:
    """Twelve marks that show each kind of likeness (fixed values)."""
    rows = [
        ("eu-001", "LUNA", "en", [25, 35], "registered"),
        ("eu-002", "ZÉNZO", "nl", [32, 33], "registered"),
        ("eu-003", "Zén-Zo Drinks B.V.", "nl", [32], "registered"),
        ("eu-004", "SENZO", "nl", [32], "registered"),
        ("eu-005", "ФЛОКС", "ru", [5], "registered"),
        ("eu-006", "FLOKS", "en", [5], "registered"),
        ("eu-007", "ΑΛΦΑ", "el", [9], "registered"),
        ("eu-008", "ALFA", "en", [9], "registered"),
        ("eu-009", "SCHÖN", "de", [3], "registered"),
        ("eu-010", "PHLOX", "en", [31], "pending"),
        ("eu-011", "SCAN", "en", [9, 42], "registered"),
        ("eu-012", "ZKAN", "nl", [9, 42], "registered"),
    ]
    return spark.createDataFrame(rows, "id string, mark_text string, locale_hint string, nice_classes array<int>, status string")


#: Pairs of a proposed name and a mark, the kind of likeness and whether it must be retrieved (fixed values).
CRITICAL_PAIRS = [
    ("LUNA", "LUNA", "exact", True),
    ("LUNA", "LUNA CAFE", "tokens", True),
    ("ZENZO", "SENZO", "one-letter", True),
    ("ZENZO", "ZEN-ZO", "separators", True),
    ("ZENZO", "ZÉNZO", "diacritics", True),
    ("ZENZO", "SENZO", "phonetic", True),
    ("PHLOX", "FLOKS", "phonetic", True),
    ("ZKAN", "SCAN", "phonetic", True),
    ("SCAN", "ZKAN", "phonetic", True),
    ("ФЛОКС", "FLOKS", "transliteration", True),
    ("ΑΛΦΑ", "ALFA", "transliteration", True),
    ("Zén-Zo Drinks B.V.", "ZENZO", "conceptual", True),
    ("Zén-Zo Drinks B.V.", "ZENZO DRINKS", "tokens", True),
    ("LUNA", "SOLAR", "negative", False),
    ("ZENZO", "XKQWP", "negative", False),
    ("APPLE", "ORANGE", "negative", False),
]
