"""Candidate retrieval: keys against keys, capped per strategy, united with evidence.

A corpus is kept as key tables (one row per key), so that every strategy is an equi-join from the
query side. ``queries`` holds query_id and the derived struct ``r``; hits are
(query_id, id, strategy, score, mark_text) and ranked hits add rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.functions import strings as S

FORMS = ("compact", "case_folded", "diacritics_folded", "ascii_folded")


def exact_key_table(marks: DataFrame) -> DataFrame:
    """(id, key): each distinct form of a searchable mark."""
    forms = F.array_distinct(F.filter(F.array(*[F.col(f"r.{f}") for f in FORMS]), lambda k: k.isNotNull() & (k != "")))
    return marks.select("id", F.explode(forms).alias("key"))


def trigram_set(c: Column) -> Column:
    """Set of the trigrams of a word padded with two blanks before and one after."""
    return F.array_distinct(F.filter(S.char_ngrams(F.concat(F.lit("  "), c, F.lit(" ")), 3), lambda g: c != ""))


def trigram_table(marks: DataFrame) -> DataFrame:
    """(id, n, gram): n is the size of the mark's set."""
    sets = marks.select("id", trigram_set(F.col("r.compact")).alias("g"))
    return sets.withColumn("n", F.size("g")).select("id", "n", F.explode("g").alias("gram"))


def query_keys(queries: DataFrame) -> DataFrame:
    """``queries`` with the keys each strategy looks up.

    exact: compacted folds and the core keys; translit: Latin spellings not among the exact keys;
    trigram: those spellings or else the compact form; core: core keys not among the former;
    sound: keys of the spoken form and of every core key.
    """
    r = lambda f: F.col(f"r.{f}")
    folds = F.array(r("compact"), *[S.alnum(F.lower(r(f))) for f in FORMS[1:]])
    exact = F.array_distinct(F.filter(F.concat(folds, r("core_keys")), lambda k: k.isNotNull() & (k != "")))
    out = queries.withColumn("exact_keys", exact).withColumn("translit_keys", F.array_except("r.translit_keys", "exact_keys"))
    full = F.when(F.size("translit_keys") > 0, F.col("translit_keys")).otherwise(F.filter(F.array(r("compact")), lambda k: k != ""))
    out = out.withColumn("full_grams", full).withColumn("core_grams", F.array_except("r.core_keys", "full_grams"))
    other = F.get(F.filter("r.translit_keys", lambda k: k != F.col("r.compact")), F.lit(0))
    said = F.coalesce(other, F.when(r("diacritics_folded") != "", r("diacritics_folded")).otherwise(r("compact")))
    spoken = F.array_distinct(F.filter(F.concat(F.array(said), r("core_keys")), lambda k: k.isNotNull() & (k != "")))
    return out.withColumn("spoken", spoken).withColumn("cap", S.strategy_cap(F.length("r.compact")))


def key_hits(queries: DataFrame, keys: str, table: DataFrame, strategy: str) -> DataFrame:
    """Marks that share one of the query's keys; a mark comes once, with score 1."""
    asked = queries.select("query_id", F.explode(keys).alias("key")).distinct()
    return table.join(asked, "key").select("query_id", "id").distinct().select(
        "query_id",
        "id",
        F.lit(strategy).alias("strategy"),
        F.lit(1.0).alias("score"),
    )


def sound_hits(queries: DataFrame, phonetic: DataFrame, strategy: str = "phonetic") -> DataFrame:
    """Marks with any sound key of the query, whatever the algorithm; ``phonetic`` is (id, algorithm, key)."""
    return key_hits(queries, "sound_keys", phonetic.filter("algorithm <> 'unencodable'"), strategy)


def trigram_hits(queries: DataFrame, keys: str, table: DataFrame, least: float = 0.3, strategy: str = "trigram") -> DataFrame:
    """Marks whose trigram set is at least ``least`` similar (shared / united) to that of a key; the
    best key counts. Two texts of any similarity share a trigram, so the join on trigrams is exact."""
    asked = queries.select("query_id", F.explode(keys).alias("key")).select("query_id", "key", trigram_set(F.col("key")).alias("g"))
    grams = asked.withColumn("m", F.size("g")).select("query_id", "key", "m", F.explode("g").alias("gram"))
    # Sets whose sizes are further apart than ``least`` allows are gone before anything is counted.
    met = table.join(grams, "gram").filter((F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9))
    shared = met.groupBy("query_id", "key", "id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    similar = shared.withColumn("score", F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).filter(F.col("score") >= least)
    return similar.groupBy("query_id", "id").agg(F.max("score").alias("score")).select(
        "query_id",
        "id",
        F.lit(strategy).alias("strategy"),
        "score",
    )


def trigram_containment(queries: DataFrame, keys: str, table: DataFrame, least: float = 0.15) -> DataFrame:
    """As ``trigram_hits``, with the share of the query's trigrams as the score."""
    asked = queries.select("query_id", F.explode(keys).alias("key")).select("query_id", "key", trigram_set(F.col("key")).alias("g"))
    grams = asked.withColumn("m", F.size("g")).select("query_id", "key", "m", F.explode("g").alias("gram"))
    found = table.join(grams, "gram").groupBy("query_id", "key", "id").agg((F.count(F.lit(1)) / F.first("m")).alias("score"))
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score")).filter(F.col("score") >= least)


def cap_hits(hits: DataFrame, order: list[Column], cap: Column, keys: list[str] = ["query_id", "strategy"], most: int | None = None) -> DataFrame:  # noqa: B006
    """The first ``cap`` hits of each query and strategy with rank, count before the cap and whether it
    was reached. Where ``cap`` is a column, ``most`` may name a bound that it never exceeds, so that hits
    beyond are dropped before the exchange; without it any cap is kept to."""
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("pre_cap"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = (ranked if most is None else ranked.filter(F.col("rank") <= most)).filter(F.col("rank") <= cap)
    return ranked.join(counts, keys).withColumn("cap_reached", F.col("pre_cap") > cap)


def reserve_core(full: DataFrame, core: DataFrame, cap: Column, fraction: float = 0.4) -> DataFrame:
    """Full-form and core hits (query_id, id, score) in one list of at most ``cap``: the best core hits
    take their reserved places first, then full hits, then the other core hits; a mark counts once.
    ``cap`` may use the columns of both tables and is LAST_CAP at most, so that of either list only the
    first hits can matter."""
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    first = lambda hits: hits.withColumn("_p", F.row_number().over(by_score)).filter(F.col("_p") <= 2 * S.LAST_CAP)
    placed, full = first(core), first(full).drop("_p")
    places = F.least(cap, F.greatest(F.lit(1), F.floor(cap * fraction)))
    tagged = placed.withColumn(
        "_class",
        F.when(F.col("_p") <= places, 0).otherwise(2),
    ).drop("_p").unionByName(full.withColumn("_class", F.lit(1)))
    once = tagged.withColumn(
        "_k",
        F.row_number().over(Window.partitionBy("query_id", "id").orderBy("_class", F.col("score").desc())),
    ).filter("_k = 1")
    order = Window.partitionBy("query_id").orderBy("_class", F.col("score").desc(), "id")
    return once.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n", "_k", "_class")


def unite(hits: DataFrame) -> DataFrame:
    """(query_id, id, evidence, strategies, ranks, best_rank): one row per candidate; evidence by rank,
    then by strategy."""
    items = F.array_sort(F.collect_list(F.struct("rank", "strategy", "score")))
    grouped = hits.groupBy("query_id", "id").agg(items.alias("e"))
    evidence = F.transform("e", lambda x: F.struct(x["strategy"], x["rank"], x["score"]))
    return grouped.select(
        "query_id",
        "id",
        evidence.alias("evidence"),
        F.transform("e", lambda x: x["strategy"]).alias("strategies"),
        F.transform("e", lambda x: x["rank"]).alias("ranks"),
        F.get("e", F.lit(0))["rank"].alias("best_rank"),
    )


def fetch_by_ids(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """Searchable marks whose id is among ``ids``."""
    return marks.filter("is_text_searchable").join(ids.select("id").distinct(), "id", "left_semi")


def readiness(marks: DataFrame, represented: DataFrame) -> DataFrame:
    """One row: searchable and normalized counts, whether scans can run, and why not."""
    searchable = marks.filter("is_text_searchable").select("id")
    n = searchable.agg(F.count(F.lit(1)).alias("searchable"))
    m = searchable.join(represented.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("normalized"))
    both = n.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")
    why = F.when(F.col("searchable") == 0, "corpus_empty").when(F.col("normalized") == 0, "corpus_not_preprocessed")
    return both.withColumn("ready", why.isNull()).withColumn("reason", why)
