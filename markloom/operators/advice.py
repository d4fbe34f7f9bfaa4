"""The deterministic side of a written assessment: what is handed out, and what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_LIMIT, MAX_CODES, MAX_SENTENCES = 1000, 8, 2

#: Greatest lengths of text fields (fixed values).
LIMITS = {"summary": 160, "toelichting": 400, "confusionRisk": 500, "whySelected": 300, "overallAdviceText": 800}

DIMENSIONS = ("visueel", "auditief", "conceptueel", "warenDiensten")

RESPONSE = (
    "overallAdvice struct<text:string,aanbeveling:string>, topRisks array<struct<rank:int,candidateId:string,markText:string,engineScore:double,riskLevel:string,summary:string,"
    "dimensions:struct<" + ",".join(f"{d}:struct<score:string,toelichting:string>" for d in DIMENSIONS) + ">,confusionRisk:string,whySelected:string>>"
)

#: Words that a field may hold (fixed values).
CHOICES = {
    "score": ["sterk", "matig", "zwak", "niet"],
    "riskLevel": ["hoog", "middel", "laag"],
    "aanbeveling": ["indienen_risicovol", "indienen_met_aanpassing", "nader_onderzoek", "laag_risico"],
}


def compact_candidates(rows: DataFrame, keys: list[str], order: list[Column], limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """(keys, n, payload): the first ``limit`` candidates of each scan as JSON with a fixed key order."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= max(0, int(limit)))
    one = F.struct(
        F.col("id").alias("candidateId"), F.col("mark_text").alias("markText"), F.col("nice_classes").alias("niceClasses"), "status",
        F.struct("score", F.col("risk_band").alias("riskBand"), "confidence").alias("score"), F.slice("evidence_codes", 1, MAX_CODES).alias("evidenceCodes"), F.slice("explanations", 1, MAX_SENTENCES).alias("explanations"),
    )
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", one.alias("x")))).alias("l"))
    return listed.select(
        *keys,
        F.size("l").alias("n"),
        F.to_json(F.transform("l", lambda s: s["x"]), {"ignoreNullFields": "false"}).alias("payload"),
    )


def json_object(raw: Column) -> Column:
    """The JSON object in a reply: inside a fence if there is one, from the first to the last brace."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).otherwise(raw)
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def _clip(c: Column, limit: int) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.left(trimmed, F.lit(limit)), r"(?U)\s+$", "")


def parse_replies(rows: DataFrame, raw: str, known: str, top_n: int = 10) -> DataFrame:
    """``rows`` with ``advice`` and ``error``. Over-long fields are clipped; a reply without an object,
    with broken JSON or with fields missing or out of range is an error; risks of ids that aren't in
    array ``known`` are dropped and the rest renumbered, ``top_n`` at most."""
    texts = rows.withColumn("_json", json_object(F.col(raw)))
    parsed = texts.withColumn(
        "_p",
        F.from_json("_json", RESPONSE, {"mode": "PERMISSIVE"}),
    ).withColumn("_ok", F.try_parse_json("_json").isNotNull())
    dim = lambda d: F.struct(d["score"].alias("score"), _clip(d["toelichting"], LIMITS["toelichting"]).alias("toelichting"))

    def risk(r: Column) -> Column:
        clipped = {f: _clip(r[f], LIMITS[f]) for f in ("summary", "confusionRisk", "whySelected")}
        dims = F.struct(*[dim(r["dimensions"][d]).alias(d) for d in DIMENSIONS])
        return F.struct(
            *[r[f].alias(f) for f in ("rank", "candidateId", "markText", "engineScore", "riskLevel")],
            clipped["summary"].alias("summary"),
            dims.alias("dimensions"),
            clipped["confusionRisk"].alias("confusionRisk"),
            clipped["whySelected"].alias("whySelected"),
        )

    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    among = lambda c, name: F.coalesce(c.isin(CHOICES[name]), F.lit(False))

    def sound(r: Column) -> Column:
        tests = [F.coalesce(r["rank"].between(1, 10), F.lit(False)), r["engineScore"].isNotNull(), among(r["riskLevel"], "riskLevel")]
        tests += [filled(r[f]) for f in ("candidateId", "markText", "summary", "confusionRisk", "whySelected")]
        tests += [among(r["dimensions"][d]["score"], "score") & filled(r["dimensions"][d]["toelichting"]) for d in DIMENSIONS]
        return F.aggregate(F.array(*tests), F.lit(True), lambda a, t: a & t)

    shaped = parsed.withColumn("_risks", F.transform("_p.topRisks", risk)).withColumn(
        "_text",
        _clip(F.col("_p.overallAdvice.text"), LIMITS["overallAdviceText"]),
    )
    valid = filled(F.col("_text")) & among(F.col("_p.overallAdvice.aanbeveling"), "aanbeveling") & F.coalesce(
        (F.size("_risks") <= 10) & F.forall("_risks", sound),
        F.lit(False),
    )
    error = F.when(
        F.col("_json").isNull(),
        "not a JSON object",
    ).when(~F.col("_ok"), "broken or truncated JSON").when(~valid, "fields missing or out of range")
    kept = F.slice(F.filter("_risks", lambda r: F.array_contains(F.col(known), r["candidateId"])), 1, top_n)
    numbered = F.transform(kept, lambda r, i: r.withField("rank", (i + 1).cast("int")))
    advice = F.struct(
        F.struct(F.col("_text").alias("text"), F.col("_p.overallAdvice.aanbeveling").alias("aanbeveling")).alias("overallAdvice"),
        numbered.alias("topRisks"),
    )
    return shaped.withColumn("error", error).withColumn(
        "advice",
        F.when(F.col("error").isNull(), advice),
    ).drop("_json", "_p", "_ok", "_risks", "_text")
