"""Features of pairs of marks, goods relations, stage-1 pruning, scores and explanations.

All are Column expressions on rows that hold the derived structs of both sides (see ``represent``);
only the string metrics come from one Arrow UDF. Unknown stays null in the features and becomes 0
only where a score uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions.lexicons import RELATED_CLASSES, SENTENCES, TRANSLATIONS, VERSIONS
from markloom.functions.scalars import bare_udf, pair_metrics, string_metrics
from markloom.functions.strings import BLANK, fold_blanks, overlap_ratio


def _flag(known: Column, value: Column) -> Column:
    return F.when(known, value.cast("double"))


def _same(a: Column, b: Column) -> Column:
    """1 or 0, unknown where a side is empty or null."""
    return _flag((a != "") & (b != ""), a == b)


def _glued(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+", "")


# -- goods -------------------------------------------------------------------------------------------


def class_overlap(a: Column, b: Column) -> Column:
    return overlap_ratio(a, b, 0.0)


def related_share(a: Column, b: Column) -> Column:
    """Share of related pairs among all pairs of unlike classes."""
    related = [p for x, y in RELATED_CLASSES for p in (x * 100 + y, y * 100 + x)]
    left, right = F.array_distinct(a), F.array_distinct(b)
    hits = lambda p: F.aggregate(left, F.lit(0), lambda n, x: n + F.size(F.filter(right, lambda y: p(x, y))))
    unlike = hits(lambda x, y: x != y)
    return F.when(unlike > 0, hits(lambda x, y: (x * 100 + y).isin(related)) / unlike).otherwise(0.0)


def goods_words(texts: Column) -> Column:
    """Distinct words of two letters and more; ``texts`` is lower-case without combining marks."""
    words = F.flatten(F.transform(texts, lambda t: F.split(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}]+", " "), " ")))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def with_goods(rows: DataFrame, a_classes: str | None, b_classes: str | None, a_texts: str | None = None, b_texts: str | None = None, out: str = "goods") -> DataFrame:
    """``rows`` with struct ``out``: relationship, overlaps, confidence and warnings of two goods lists.

    Classes are array<int>, texts array<string>; either may be missing or null. Missing texts make
    the concrete similarity unknown, never 0.
    """
    no_class, none = F.array().cast("array<int>"), F.array().cast("array<string>")
    classes = lambda n: F.coalesce(F.col(n), no_class) if n else no_class
    df = rows.withColumns({"_ca": classes(a_classes), "_cb": classes(b_classes)})
    for side, name in (("a", a_texts), ("b", b_texts)):
        if name is None:
            df = df.withColumn(f"_t{side}", none)
        else:
            df = df.withColumn(
                f"_t{side}",
                F.filter(
                    F.split(bare_udf(F.lower(F.array_join(F.coalesce(F.col(name), none), "\x01"))), "\x01"),
                    lambda t: t.rlike(r"[\p{L}\p{N}]"),
                ),
            )
    c = F.col
    df = df.withColumns(
        {
            "_wa": goods_words(c("_ta")),
            "_wb": goods_words(c("_tb")),
            "_known": (F.size("_ta") > 0) & (F.size("_tb") > 0),
            "_overlap": class_overlap(c("_ca"), c("_cb")),
            "_related": related_share(c("_ca"), c("_cb")),
        }
    )
    covered = F.when(F.size("_wa") > 0, F.size(F.array_intersect("_wa", "_wb")) / F.size("_wa")).otherwise(0.0)
    warnings = F.filter(
        F.array(F.when(F.size("_ta") == 0, "missing_proposed_goods_text"), F.when(F.size("_tb") == 0, "missing_candidate_goods_text")),
        lambda w: w.isNotNull(),
    )
    df = df.withColumns(
        {
            "_concrete": F.when(c("_known"), overlap_ratio(c("_wa"), c("_wb"), 1.0)),
            "_covered": F.when(c("_known"), covered),
            "_warnings": warnings,
        }
    )
    overlap, related, known, concrete = c("_overlap"), c("_related"), c("_known"), c("_concrete")
    near = F.when(
        known,
        _ladder(concrete, ((0.7, "high"), (0.4, "medium"), (0.15, "low")), "none"),
    ).otherwise(F.when(overlap >= 0.75, "high").otherwise("medium"))
    relationship = (
        F.when((F.size("_ca") == 0) & (F.size("_cb") == 0) & ~known, "unknown")
        .when(known & (concrete >= 0.9) & (overlap >= 0.5), "identical")
        .when((overlap >= 0.75) | ((overlap >= 0.5) & (related >= 0.5)), near)
        .when((related >= 0.5) | (overlap >= 0.25), F.when(known & (concrete >= 0.4), "medium").otherwise("low"))
        .when((overlap > 0) | (related > 0) | (known & (concrete > 0)), "low")
        .otherwise("none")
    )
    confidence = F.when(known, "high").when(overlap > 0, "medium").otherwise("low")
    df = df.withColumns({"_relationship": relationship, "_confidence": confidence})
    names = {
        "relationship": "_relationship",
        "class_overlap": "_overlap",
        "related_signal": "_related",
        "concrete_similarity": "_concrete",
        "coverage": "_covered",
        "confidence": "_confidence",
        "warnings": "_warnings",
    }
    return df.withColumn(out, F.struct(*[c(v).alias(k) for k, v in names.items()])).drop(
        "_ca",
        "_cb",
        "_ta",
        "_tb",
        "_wa",
        "_wb",
        "_known",
        *names.values(),
    )


def _ladder(value: Column, limits: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for limit, name in reversed(limits):
        out = F.when(value >= limit, name).otherwise(out)
    return out


# -- features ----------------------------------------------------------------------------------------

ORTHOGRAPHIC = {
    "levenshtein": "levenshteinSimilarity",
    "damerau_levenshtein": "damerauLevenshteinSimilarity",
    "jaro": "jaroSimilarity",
    "jaro_winkler": "jaroWinklerSimilarity",
    "weighted_edit": "weightedEditSimilarity",
    "trigram_dice": "trigramDice",
    "lcs": "lcsSimilarity",
}


def _token_family(a: Column, b: Column, m: Column) -> dict[str, Column]:
    sa, sb = a["significant_tokens"], b["significant_tokens"]
    both, any_ = (F.size(sa) > 0) & (F.size(sb) > 0), (F.size(sa) > 0) | (F.size(sb) > 0)
    jaccard = F.when(any_, overlap_ratio(sa, sb, None))
    dominant = _same(F.coalesce(a["dominant_token"], F.lit("")), F.coalesce(b["dominant_token"], F.lit("")))
    noise = F.when(jaccard > 0, 0.0).otherwise(overlap_ratio(a["noise_tokens"], b["noise_tokens"], None))
    rest = lambda s, d: F.when(d.isNull(), s).otherwise(F.array_remove(s, d))
    second = overlap_ratio(rest(sa, a["dominant_token"]), rest(sb, b["dominant_token"]), None)
    shared = F.when(both, F.size(F.filter(sa, lambda x: F.array_contains(sb, x))).cast("double"))
    empty = (F.size(sa) == 0) | (F.size(sb) == 0)
    return {
        "dominantTokenOverlap": dominant, "tokenJaccard": jaccard, "sharedRareTokenCount": shared, "prefixOverlap": m["prefix"], "suffixOverlap": m["suffix"],
        "significantOverlap": jaccard, "noiseOnlyOverlap": noise, "coreCompactMatch": F.when(~empty, (a["core_compact"] == b["core_compact"]).cast("double")),
        "coreEmpty": empty.cast("double"), "secondarySignificantOverlap": second,
    }


def _translation(a: Column, b: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSLATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sa, sb = a["significant_tokens"], b["significant_tokens"]
    means = lambda x: F.coalesce(F.try_element_at(table, x), F.array().cast("array<string>"))
    near = F.exists(sa, lambda x: F.array_contains(sb, x) | F.arrays_overlap(means(x), sb))
    whole = F.when(F.array_contains(means(a["compact"]), b["compact"]), 1.0)
    return F.when((F.size(sa) == 0) | (F.size(sb) == 0), whole).otherwise(near.cast("double"))


def _families(a: Column, b: Column, m: Column, goods: Column, strategies: Column, ranks: Column | None) -> dict[str, dict[str, Column]]:
    """All features by family, before any of them is put into a struct."""
    lower = lambda r: F.transform(r["transliterations"], F.lower)
    translit = _flag((F.size(a["transliterations"]) > 0) & (F.size(b["transliterations"]) > 0), F.arrays_overlap(lower(a), lower(b)))
    token = _token_family(a, b, m)
    weak = lambda r: F.size(r["weak_tokens"]) / F.greatest(r["n_tokens"], F.lit(1))
    unknown = F.lit(None).cast("double")
    return {
        "exact": {
            "normalizedMatch": _same(_glued(a["diacritics_folded"]), _glued(b["diacritics_folded"])),
            "compactMatch": _same(a["compact"], b["compact"]),
            "caseFoldedMatch": _same(_glued(a["case_folded"]), _glued(b["case_folded"])),
            "transliterationMatch": translit,
        },
        "orthographic": {v: m[k] for k, v in ORTHOGRAPHIC.items()},
        "token": token,
        "phonetic": {
            "primaryKeyMatch": _same(a["primary_key"], b["primary_key"]),
            "secondaryKeyMatch": _same(a["secondary_key"], b["secondary_key"]),
            "pronunciationSimilarity": m["sound"],
            "skeletonMatch": _same(a["skeleton"], b["skeleton"]),
        },
        "conceptual": {
            "lexiconOverlap": token["tokenJaccard"],
            "translationProximity": _translation(a, b),
            "descriptiveOverlap": F.when((F.size(a["weak_tokens"]) > 0) | (F.size(b["weak_tokens"]) > 0), F.least(weak(a), weak(b))),
        },
        "goodsServices": {
            "niceClassOverlap": goods["class_overlap"],
            "conceptOverlap": goods["concrete_similarity"],
            "coverage": F.when(F.size(goods["warnings"]) == 0, "full").otherwise("unknown"),
        },
        "context": dict.fromkeys(("statusRelevance", "dateProximity", "registryRelevance"), unknown),
        "retrieval": {
            "strategies": strategies,
            "maxStrategyRank": F.array_min(ranks).cast("double") if ranks is not None else unknown,
            "evidenceCount": F.size(strategies),
            "independentFamilyHits": strategies,
        },
        "metadata": {"engineVersion": F.lit(VERSIONS["engine"]), "normalizationVersion": F.lit(VERSIONS["normalization"]), "scoreVersion": F.lit(VERSIONS["score"])},
    }


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def evidence(f: Column, goods: Column) -> Column:
    """Evidence codes in fixed order. Without goods warnings the class code always follows."""
    o, t, p = f["orthographic"], f["token"], f["phonetic"]
    jw = _z(o["jaroWinklerSimilarity"])
    tests = [
        ("exact_normalized", f["exact"]["normalizedMatch"] == 1),
        ("exact_compact", f["exact"]["compactMatch"] == 1),
        ("exact_transliteration", f["exact"]["transliterationMatch"] == 1),
        ("orthographic_high", jw >= 0.85),
        ("orthographic_medium", (jw >= 0.65) & (jw < 0.85)),
        ("phonetic_primary_match", p["primaryKeyMatch"] == 1),
        ("phonetic_secondary_match", p["secondaryKeyMatch"] == 1),
        ("phonetic_similar", p["pronunciationSimilarity"] >= 0.7),
        ("token_dominant_overlap", t["dominantTokenOverlap"] == 1),
        ("token_core_overlap", t["significantOverlap"] >= 0.5),
        ("token_noise_only", t["noiseOnlyOverlap"] >= 0.5),
        ("token_core_empty", t["coreEmpty"] >= 1),
        ("token_secondary_overlap", t["secondarySignificantOverlap"] > 0),
        ("token_prefix_overlap", t["prefixOverlap"] >= 0.8),
        ("token_suffix_overlap", t["suffixOverlap"] >= 0.8),
        ("conceptual_translation", f["conceptual"]["translationProximity"] == 1),
        ("goods_missing", F.size(goods["warnings"]) > 0),
        ("goods_class_overlap", F.size(goods["warnings"]) == 0),
        ("retrieval_multi_strategy", f["retrieval"]["evidenceCount"] >= 2),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in tests]), lambda c: c.isNotNull())


def with_features(pairs: DataFrame, left: str = "p", right: str = "c", left_classes: str | None = None, right_classes: str | None = None, left_goods: str | None = None, right_goods: str | None = None, strategies: str | None = None, ranks: str | None = None) -> DataFrame:
    """``pairs`` with ``metrics``, ``goods``, ``features`` and ``evidence_codes``.

    Goods columns are array<string>; they are folded here.
    """
    a, b = F.col(left), F.col(right)
    # The metrics cost far more than their input's bytes tell, so the rows are spread first.
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = spread.withColumn(
        "metrics",
        pair_metrics(a["forms"], b["forms"], a["affix_core"], b["affix_core"], a["primary_key"], b["primary_key"]),
    )
    out = with_goods(out, left_classes, right_classes, left_goods, right_goods)
    found = F.coalesce(F.col(strategies), F.array().cast("array<string>")) if strategies else F.array().cast("array<string>")
    parts = _families(a, b, F.col("metrics"), F.col("goods"), found, F.col(ranks) if ranks else None)
    flat = {f"_f_{fam}_{n}": c for fam, own in parts.items() for n, c in own.items()}
    out = out.withColumns(flat)
    vector = F.struct(*[F.struct(*[F.col(f"_f_{fam}_{n}").alias(n) for n in own]).alias(fam) for fam, own in parts.items()])
    out = out.withColumn("features", vector).drop(*flat)
    return out.withColumn("evidence_codes", evidence(F.col("features"), F.col("goods")))


# -- pruning -----------------------------------------------------------------------------------------

PRUNING = {"weak_trigram": 0.12, "least_weak": 2, "short": 5, "strong_affix": 0.85}


def cheap_features(f: Column, p: Column, c: Column) -> Column:
    """What pruning looks at."""
    t = f["token"]
    core = (_z(t["significantOverlap"]) > 0) | (_z(t["coreCompactMatch"]) >= 1) | (_z(t["dominantTokenOverlap"]) >= 1)
    return F.struct(
        (p["compact"] == c["compact"]).alias("exactMatch"), (_z(f["phonetic"]["primaryKeyMatch"]) > 0).alias("phoneticKeyMatch"), (_z(f["exact"]["transliterationMatch"]) >= 1).alias("transliterationExact"),
        _z(f["orthographic"]["trigramDice"]).alias("trigramDice"), _z(t["prefixOverlap"]).alias("prefixScore"), _z(t["suffixOverlap"]).alias("suffixScore"),
        F.lit(False).alias("missingData"), core.alias("coreTokenHit"), (_z(t["noiseOnlyOverlap"]) >= 0.5).alias("noiseOnlyHit"),
    )


def prune(x: Column, families: Column, proposed: Column, candidate: Column, profile: dict = PRUNING) -> Column:
    """Struct(decision, rule, reasons): keep, promote or discard. Lengths far apart discard first,
    unless the forms are equal; then protections keep; then enough weak signals discard."""
    short, long = F.least(proposed, candidate), F.greatest(proposed, candidate)
    unlike = ~(
        x["exactMatch"] | x["transliterationExact"]
    ) & (short > 0) & (short / F.greatest(long, F.lit(1)) <= 0.5) & (short <= profile["short"])
    codes = lambda prefix, tests: F.filter(F.array(*[F.when(t, F.lit(f"{prefix}:{n}")) for n, t in tests]), lambda r: r.isNotNull())
    backed = x["coreTokenHit"] | x["exactMatch"]
    affix = F.greatest(x["prefixScore"], x["suffixScore"])
    guards = codes("protect", [
        ("exact_match", x["exactMatch"]),
        ("phonetic_key", x["phoneticKeyMatch"] & (backed | x["transliterationExact"])),
        ("multi_family", F.size(families) >= 2),
        ("short_mark_affix", (short <= profile["short"]) & (affix >= profile["strong_affix"])),
        ("transliteration_exact", x["transliterationExact"]),
        ("core_token", x["coreTokenHit"]),
        ("missing_data", x["missingData"]),
    ])
    weak = codes("weak", [
        ("low_trigram", x["trigramDice"] < profile["weak_trigram"]),
        ("low_affix", affix < 0.2),
        ("no_exact_or_phonetic", ~x["phoneticKeyMatch"] & ~x["exactMatch"]),
        ("phonetic_only", x["phoneticKeyMatch"] & ~backed),
        ("noise_only", x["noiseOnlyHit"] & ~backed),
    ])
    out = lambda decision, rule, reasons: F.struct(F.lit(decision).alias("decision"), F.lit(f"{VERSIONS['pruning_profile']}:{rule}").alias("rule"), reasons.alias("reasons"))
    return (
        F.when(unlike, out("discard", "discard_length_ratio", F.array(F.lit("weak:length_ratio"))))
        .when(F.size(families) >= 2, out("promote", "promote_multi_family", guards))
        .when(F.size(guards) > 0, out("keep", "keep_protected", guards))
        .when(F.size(weak) >= profile["least_weak"], out("discard", "discard_multi_weak", weak))
        .otherwise(out("keep", "keep_default", F.array(F.lit("default:insufficient_discard_signals"))))
    )


# -- scores ------------------------------------------------------------------------------------------


def band(score: Column) -> Column:
    return _ladder(score, ((80, "very_strong"), (65, "strong"), (45, "relevant"), (25, "weak")), "low")


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))


def with_score(rows: DataFrame, f: str = "features", out: str = "score", goods: str | None = None) -> DataFrame:
    """``rows`` with struct ``out``: score (0 to 100, 2 decimals), band and confidence.

    The strongest family counts, with a share of the second where both are strong; goods blend in;
    caps hold back scores that rest on sound, surface or noise alone. With ``goods`` (a struct of
    ``with_goods``) its concrete similarity counts too.
    """
    v = F.col(f)
    best = lambda fam, *names: _z(F.greatest(*[v[fam][n] for n in names])) * 100
    tok = {
        n: _z(v["token"][n]) for n in (
            "dominantTokenOverlap",
            "tokenJaccard",
            "significantOverlap",
            "coreCompactMatch",
            "secondarySignificantOverlap",
            "noiseOnlyOverlap",
            "coreEmpty",
            "prefixOverlap",
            "suffixOverlap",
            "sharedRareTokenCount",
        )
    }
    dom, jac, sig, core, second = (
        tok[n] for n in ("dominantTokenOverlap", "tokenJaccard", "significantOverlap", "coreCompactMatch", "secondarySignificantOverlap")
    )
    partial = (sig > 0) & (sig < 1) & (core < 1)
    led = F.when((dom >= 1) & partial, sig).otherwise(dom)
    token = F.greatest(led, jac, sig, core, F.when((led >= 1) | (core >= 1), second).otherwise(second * 0.55))
    half = (dom < 1) & (core < 1) & (sig >= 0.5) & (sig < 1) & (jac >= 0.5)
    token = F.when(tok["coreEmpty"] >= 1, 0.0).otherwise(F.when(half, F.greatest(token, F.lit(0.75))).otherwise(token)) * 100
    steps = {
        "_exact": best("exact", "normalizedMatch", "compactMatch", "caseFoldedMatch", "transliterationMatch"),
        "_edit": best("orthographic", "levenshteinSimilarity", "damerauLevenshteinSimilarity", "weightedEditSimilarity"),
        "_wide": best("orthographic", "levenshteinSimilarity", "damerauLevenshteinSimilarity", "weightedEditSimilarity", "jaroWinklerSimilarity", "trigramDice", "lcsSimilarity"),
        "_token": token,
        "_sound": best("phonetic", "primaryKeyMatch", "secondaryKeyMatch", "pronunciationSimilarity", "skeletonMatch"),
        "_idea": best("conceptual", "translationProximity", "lexiconOverlap"),
        "_signal": F.greatest(dom, jac, sig, core),
        "_noise": (tok["noiseOnlyOverlap"] >= 0.5) & (sig < 0.25) & (core < 1) & (dom < 1),
    }
    df = rows.withColumns(steps)
    c = F.col
    df = df.withColumn("_ortho", F.when(c("_signal") < 0.25, c("_edit")).otherwise(c("_wide")))
    jw, affix = _z(v["orthographic"]["jaroWinklerSimilarity"]) * 100, F.greatest(tok["prefixOverlap"], tok["suffixOverlap"])
    strong = (core >= 1) | (dom >= 1) | (c("_signal") >= 0.5)
    alone = (c("_sound") >= 80) & ~strong & (c("_edit") < 80) & ~((jw >= 85) & (affix >= 0.4) & (c("_edit") >= 70))
    surface = F.greatest(_z(v["orthographic"]["lcsSimilarity"]), _z(v["orthographic"]["trigramDice"])) * 100
    df = df.withColumn("_alone", alone).withColumn("_surface", (c("_signal") < 0.25) & (surface >= 80) & (c("_edit") < 75))
    ranked = F.sort_array(F.array("_exact", "_ortho", "_token", "_sound"), asc=False)
    first, next_ = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    df = df.withColumn("_base", F.when((first >= 95) & (next_ >= 70), _clamp(first + next_ * 0.15)).otherwise(first))
    overlap = _z(F.col(goods)["class_overlap"]) if goods else _z(v["goodsServices"]["niceClassOverlap"])
    concrete = F.col(goods)["concrete_similarity"] if goods else F.lit(None).cast("double")
    df = df.withColumn("_worth", F.when(concrete.isNull(), overlap * 60).otherwise(_clamp(overlap * 40 + concrete * 60)))
    df = df.withColumn("_base", F.when(c("_worth") > 0, _clamp(c("_base") * 0.85 + c("_worth") * 0.15)).otherwise(c("_base")))
    only_idea = (c("_idea") > 0) & (c("_exact") < 50) & (c("_ortho") < 50) & (c("_sound") < 50)
    capped = (tok["coreEmpty"] >= 1) | c("_noise") | c("_alone") | c("_surface")
    df = df.withColumn("_base", F.least(c("_base"), F.when(only_idea, 44.0), F.when(capped, 55.0)))
    bland = (c("_signal") < 0.25) & (c("_edit") < 80) & (tok["sharedRareTokenCount"] == 0) & (dom < 0.2)
    base = _clamp(c("_base") - F.when(c("_noise"), 25.0).when(bland, 20.0).otherwise(0.0))
    same = c("_exact") >= 95
    df = df.withColumn("_score", F.when(same, 100.0).otherwise(F.floor(base * 100 + 0.5) / 100))
    missing = F.size(F.col(goods)["warnings"]) > 0 if goods else v["goodsServices"]["coverage"] == "unknown"
    held = F.when(c("_score") >= 70, "medium").otherwise("low")
    confidence = (
        F.when((tok["coreEmpty"] >= 1) & ~same, "low")
        .when(~same & (c("_alone") | c("_surface")), "low")
        .when(((tok["noiseOnlyOverlap"] >= 0.5) & (sig < 0.25)) | missing, held)
        .otherwise(_ladder(c("_score"), ((80, "high"), (50, "medium")), "low"))
    )
    df = df.withColumn(out, F.struct(c("_score").alias("score"), band(c("_score")).alias("risk_band"), confidence.alias("confidence")))
    return df.drop(*steps, "_ortho", "_alone", "_surface", "_base", "_worth", "_score")


def with_plain_score(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with the older score of two texts by spelling alone: exact, levenshtein, jaro,
    jaro_winkler and combined (4 decimals) and its band. Texts are compared in upper case with single
    blanks; empty texts are never exact."""
    clean = lambda c: F.upper(fold_blanks(F.col(c)))
    df = rows.withColumns({"_a": clean(a), "_b": clean(b)}).withColumn("_m", string_metrics("_a", "_b"))
    longest = F.greatest(F.length("_a"), F.length("_b"))
    exact = ((F.col("_a") != "") & (F.col("_a") == F.col("_b"))).cast("int")
    lev = F.when(longest > 0, 1 - F.col("_m.levenshtein") / longest).otherwise(1.0)
    df = df.withColumns({"exact": exact, "_lev": lev, "_jaro": F.col("_m.jaro"), "_jw": F.col("_m.jaro_winkler")})
    df = df.withColumn("_c", F.when(F.col("exact") == 1, 1.0).otherwise(F.col("_lev") * 0.35 + F.col("_jaro") * 0.25 + F.col("_jw") * 0.4))
    named = _ladder(
        F.col("_c"),
        ((0.95, "critical"), (0.85, "strong"), (0.7, "relevant"), (0.55, "borderline"), (0.35, "weak")),
        "irrelevant",
    )
    out = df.withColumns(
        {
            "levenshtein": F.round("_lev", 4),
            "jaro": F.round("_jaro", 4),
            "jaro_winkler": F.round("_jw", 4),
            "combined": F.round("_c", 4),
            "band": named,
        }
    )
    return out.drop("_a", "_b", "_m", "_lev", "_jaro", "_jw", "_c")


# -- explanations ------------------------------------------------------------------------------------


def explain(codes: Column, proposed: Column, candidate: Column, locale: str = "en") -> Column:
    """Sentences of the known codes, in order; an unknown mark shows as a dash."""
    table = F.create_map(*[F.lit(x) for kv in SENTENCES.get(locale, SENTENCES["en"]).items() for x in kv])
    shown = lambda c: F.coalesce(c, F.lit("—"))
    known = F.filter(F.transform(codes, lambda k: F.try_element_at(table, k)), lambda s: s.isNotNull())
    return F.transform(
        known,
        lambda s: F.replace(F.replace(s, F.lit("{proposedMark}"), shown(proposed)), F.lit("{candidateMark}"), shown(candidate)),
    )


def known_evidence_codes() -> list[str]:
    return list(SENTENCES["en"])
