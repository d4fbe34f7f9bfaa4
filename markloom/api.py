"""What a caller needs: versions, scans, pair comparison, statistics, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.functions import scalars
from markloom.functions.lexicons import VERSIONS
from markloom.functions.strings import phoneme_letters
from markloom.operators.compare import explain, with_features, with_score
from markloom.operators.evaluate import corpus_statistics
from markloom.operators.represent import represent
from markloom.plans.scan import index_scan, logical_scan
from markloom.runtime import cut

__all__ = ["compare_pairs", "corpus_statistics", "index_scan", "logical_scan", "phonemes", "register_functions", "versions"]


def versions() -> dict[str, str]:
    return dict(VERSIONS)


def compare_pairs(pairs: DataFrame, proposed: str = "proposed", candidate: str = "candidate", locale: str = "en", proposed_classes: str | None = None, candidate_classes: str | None = None) -> DataFrame:
    """Features, evidence, score and explanations of each row's two texts; the class columns, where
    named, are array<int> and enter the features of the goods."""
    both = represent(represent(pairs, proposed).withColumnRenamed("r", "p"), candidate).withColumnRenamed("r", "c")
    seen = cut(with_features(both, left_classes=proposed_classes, right_classes=candidate_classes).drop("p", "c", "metrics"))
    return with_score(seen).withColumn("explanations", explain(F.col("evidence_codes"), F.col(proposed), F.col(candidate), locale))


def phonemes(rows: DataFrame, text: str, locale: str) -> DataFrame:
    """``rows`` with a plain letter-by-letter ``phonemes`` and ``ipa``."""
    letters = phoneme_letters(scalars.text_forms(F.col(text))["bare"])
    out = rows.withColumn("phonemes", letters)
    return out.withColumn("ipa", F.concat(F.lit(f"[{locale}:"), F.array_join("phonemes", ""), F.lit("]")))


def register_functions(spark: SparkSession, prefix: str = "mark_") -> list[str]:
    """Make the scalar algorithms callable from SQL text; returns their names."""
    made = {
        "sound_key": F.pandas_udf("string")(scalars.sound_key_udf.__wrapped__),
        "bare": F.pandas_udf("string")(scalars.bare_udf.__wrapped__),
        "forms": F.pandas_udf("nfc string, nfkc string, lower string, bare string, family string, tokens array<struct<raw:string,normalized:string>>, variants array<string>")(scalars.text_forms.__wrapped__),
        "metrics": F.pandas_udf("levenshtein int, damerau int, jaro double, jaro_winkler double, lcs int, lcs_similarity double")(scalars.string_metrics.__wrapped__),
        "weighted_edit": scalars.weighted_edit_udf(),
    }
    for name, f in made.items():
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in made]
