"""Whole scans: many proposed names against a corpus in one plan."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions.lexicons import LAST_CAP, STRATEGIES
from markloom.functions.scalars import _stem_only, jaro_winkler
from markloom.functions.strings import char_ngrams, strategy_cap, trim_blanks
from markloom.operators import retrieve as R
from markloom.operators.compare import cheap_features, explain, prune, with_features, with_score
from markloom.operators.rank import families, family_key
from markloom.operators.represent import phonetic_keys, represent
from markloom.operators.skew import small_first
from markloom.runtime import cut

#: Proposed names are taken in blocks of so many against all rows of the corpus.
QUERY_BLOCK = 500

#: From these similarities on two forms are alike, by trigrams or by Jaro-Winkler.
LEAST_DICE, LEAST_NEAR = 0.25, 0.85

#: Forms meet by so many first letters.
PREFIX = 3


def propose(names: DataFrame) -> DataFrame:
    """(query_id, mark_text, nice_classes) with the derived struct; blank names are left out."""
    return represent(names.filter(F.length(trim_blanks(F.col("mark_text"))) > 0))


def split_names(text: Column) -> Column:
    """Names of a comma-separated text: trimmed, first spelling of each kept, ten at most."""
    named = F.filter(F.transform(F.split(text, ","), trim_blanks), lambda x: x != "")
    low = F.transform(named, F.lower)
    firsts = F.filter(
        F.transform(named, lambda x, i: F.struct(x.alias("x"), (F.array_position(low, F.lower(x)) == i + 1).alias("f"))),
        lambda s: s["f"],
    )
    return F.slice(F.transform(firsts, lambda s: s["x"]), 1, 10)


SIDES = ("forms", "significant_tokens", "dominant_token", "primary_key", "skeleton", "compact", "transliterations")


def _bag(x: str) -> tuple:
    return x, Counter(x), frozenset(x[i : i + 3] for i in range(len(x) - 2))


def _could_reach(a: tuple, b: tuple) -> bool:
    """Whether the letters in common allow a Jaro-Winkler similarity of 0.85: with four equal first
    letters that takes a Jaro similarity of 0.75."""
    shared = sum(min(n, b[1][c]) for c, n in a[1].items() if c in b[1])
    return shared * (1 / len(a[0]) + 1 / len(b[0])) >= 1.25 - 1e-9


def _asked(r) -> dict:
    """A proposed name as it is held against marks."""
    return {
        "bags": [_bag(f) for f in r["forms"]],
        "sig": set(r["significant_tokens"]),
        "dom": r["dominant_token"],
        "key": r["primary_key"],
        "bones": r["skeleton"],
        "compact": r["compact"],
        "variants": {v.lower() for v in r["transliterations"]},
    }


def _matches(q: dict, m: dict) -> tuple[list[str], float]:
    """Channels by which a mark is a candidate of a name, and their best Jaro-Winkler similarity."""
    exact = q["compact"] != "" and q["compact"] == m["compact"]
    latin = not m["variants"].isdisjoint(q["variants"])
    word = not m["sig"].isdisjoint(q["sig"]) or bool(m["dom"] and m["dom"] == q["dom"])
    sound = bool((m["key"] and m["key"] == q["key"]) or (m["bones"] and m["bones"] == q["bones"]))
    sure, like, near, pairs = exact or latin or word or sound, False, 0.0, []
    for x in q["bags"]:
        for y in m["bags"]:
            down = 0.7 if _stem_only(x[0], y[0]) else 1.0
            n = len(x[2]) + len(y[2])
            like = like or (2 * len(x[2] & y[2]) / n if n else 1.0) * down >= LEAST_DICE
            pairs.append((x, y, down))
    if sure or like or any(_could_reach(x, y) for x, y, _ in pairs):
        near = max((jaro_winkler(x[0], y[0]) * d for x, y, d in pairs), default=0.0)
    tests = (exact, latin, like or near >= LEAST_NEAR, word, sound)
    return [s for s, t in zip(STRATEGIES, tests, strict=True) if t], near


def _channels(queries):
    """Function of one block of corpus rows: which names each row is a candidate of, and by what.
    ``queries`` is a broadcast block of names."""

    def match(batches):
        block = queries.value
        for b in batches:
            rows = []
            for id_, *sides in zip(b["id"], *[b[s] for s in SIDES], strict=True):
                mark = _asked(dict(zip(SIDES, sides, strict=True)))
                for query_id, q in block:
                    found, near = _matches(q, mark)
                    rows += [(query_id, id_, s, near) for s in found]
            yield pd.DataFrame(rows, columns=["query_id", "id", "strategy", "score"])

    return match


def channel_hits(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, id, strategy, score): every corpus row against every proposed name, in blocks of
    names. Equal compact forms, shared Latin spellings, similar letters, shared words or equal sounds
    make a row a candidate; the score is its best Jaro-Winkler similarity."""
    asked = queries.select("query_id", *[F.col(f"r.{s}").alias(s) for s in SIDES]).orderBy("query_id").toLocalIterator()
    block, out = [], None
    rows = corpus.select("id", *[F.col(f"r.{s}").alias(s) for s in SIDES])
    kind = corpus.schema["id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()

    def add(block: list, out: DataFrame | None) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInPandas(_channels(shared), f"query_id {qkind}, id {kind}, strategy string, score double")
        return part if out is None else out.unionByName(part)

    for q in asked:
        block.append((q["query_id"], _asked(q)))
        if len(block) == QUERY_BLOCK:
            block, out = [], add(block, out)
    return add(block, out) if block or out is None else out


def _sure_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, k): what two sides share if they are candidates by anything but similar letters, and the start
    of each form, which forms of high Jaro-Winkler similarity nearly always share."""
    r = lambda f: F.col(f"r.{f}")
    tag = lambda t, c: F.transform(c, lambda x: F.concat(F.lit(t), x))
    one = lambda c: F.array(c)
    starts = F.transform(r("forms"), lambda x: F.left(x, F.lit(PREFIX)))
    short = F.filter(r("forms"), lambda x: F.length(x) < 3)
    kinds = [
        tag("e:", one(r("compact"))),
        tag("l:", F.transform(r("transliterations"), F.lower)),
        tag("w:", F.concat(r("significant_tokens"), one(r("dominant_token")))),
        tag("s:", one(r("primary_key"))),
        tag("b:", one(r("skeleton"))),
        tag("p:", starts),
        F.when(F.size(short) > 0, one(F.lit("short:"))).otherwise(F.array().cast("array<string>")),
    ]
    keys = F.array_distinct(F.filter(F.concat(*kinds), lambda k: k.isNotNull() & ((F.length(k) > 2) | (k == "short:"))))
    return rows.select(key, F.explode(keys).alias("k"))


def _form_grams(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, form, n, gram): trigrams of each form and their number."""
    forms = rows.select(key, F.explode("r.forms").alias("form"))
    sets = forms.select(key, "form", F.array_distinct(char_ngrams(F.col("form"), 3)).alias("g"))
    return sets.withColumn(n, F.size("g")).select(key, F.col("form").alias(f"form_{n}"), n, F.explode("g").alias("gram"))


def keyed_hits(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``channel_hits`` through keys: only pairs that share a key, or enough trigrams of a form, are looked at.

    The channels are decided by the same test, so no hit is made that the whole comparison doesn't make.
    It misses pairs that are alike by Jaro-Winkler similarity alone and begin with other letters.
    """
    sure = small_first(_sure_keys(corpus, "id"), _sure_keys(queries, "query_id"), ["k"]).select("query_id", "id")
    met = small_first(_form_grams(corpus, "id", "n"), _form_grams(queries, "query_id", "m"), ["gram"])
    met = met.filter(2 * F.least("n", "m") >= LEAST_DICE * (F.col("n") + F.col("m")) - 1e-9)
    shared = met.groupBy("query_id", "id", "form_m", "form_n").agg((2 * F.count(F.lit(1)) / F.first(F.col("n") + F.col("m"))).alias("dice"))
    like = shared.filter(F.col("dice") >= LEAST_DICE - 1e-9).select("query_id", "id")
    side = lambda d, key, x: d.select(key, F.struct(*[F.col(f"r.{s}").alias(s) for s in SIDES]).alias(x))
    pairs = sure.unionByName(like).distinct()
    pairs = pairs.join(side(queries, "query_id", "q"), "query_id").join(side(corpus, "id", "m"), "id")

    @F.pandas_udf("strategies array<string>, near double")
    def channels(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = [_matches(_asked(a), _asked(b)) for a, b in zip(q.to_dict("records"), m.to_dict("records"), strict=True)]
        return pd.DataFrame(found, columns=["strategies", "near"])

    found = pairs.select("query_id", "id", channels.asNondeterministic()("q", "m").alias("c"))
    return found.select("query_id", "id", F.explode("c.strategies").alias("strategy"), F.col("c.near").alias("score"))


def assess(united: DataFrame, queries: DataFrame, corpus: DataFrame, with_context: bool = True) -> DataFrame:
    """Features, evidence, pruning decision, score and explanations of united candidates.

    ``queries`` has nice_classes, ``corpus`` id, mark_text, nice_classes, status and owner.
    """
    q = queries.select(
        "query_id",
        F.col("mark_text").alias("proposed"),
        F.col("nice_classes").alias("proposed_classes"),
        F.col("r").alias("p"),
    )
    c = corpus.select("id", "mark_text", "nice_classes", "status", "owner", "priority_date", F.col("r").alias("c"))
    pairs = united.join(q, "query_id").join(c, "id")
    context = ("strategies", "ranks") if with_context else (None, None)
    seen = with_features(pairs, left_classes="proposed_classes", right_classes="nice_classes", strategies=context[0], ranks=context[1])
    seen = seen.withColumn("cheap", cheap_features(F.col("features"), F.col("p"), F.col("c")))
    seen = seen.withColumn("pruning", prune(F.col("cheap"), F.col("strategies"), F.length("p.compact"), F.length("c.compact")))
    # Written once: else the filter on the decision is pushed below every derived column, which
    # repeats all of their expressions inside it.
    seen = cut(seen.drop("metrics", "cheap"))
    scored = with_score(seen).withColumn("explanations", explain(F.col("evidence_codes"), F.col("proposed"), F.col("mark_text")))
    return scored.withColumn("family", family_key(F.col("c.family_key"), F.col("owner"), F.col("id").cast("string")))


def results(assessed: DataFrame) -> DataFrame:
    """Kept candidates as ranked families."""
    flat = assessed.filter("pruning.decision <> 'discard'").select(
        "query_id", "id", "mark_text", "status", "family", "evidence_codes", "explanations", F.col("score.score").alias("score"), F.col("score.risk_band").alias("risk_band"),
        F.col("score.confidence").alias("confidence"), F.size("strategies").alias("channel_count"), (F.col("status") == "registered").alias("active_right"), "priority_date", "strategies",
    )
    return families(flat, ["query_id"])


def _named(corpus: DataFrame) -> DataFrame:
    """Marks with a text, represented; a corpus that was represented and written before is taken as it is."""
    named = corpus.filter(F.length(trim_blanks(F.col("mark_text"))) > 0)
    return named if "r" in corpus.columns else cut(represent(named))


def _scan(names: DataFrame, corpus: DataFrame, hits) -> DataFrame:
    queries, marks = cut(propose(names)), _named(corpus)
    caps = queries.select("query_id", strategy_cap(F.length("r.compact")).alias("cap"))
    capped = R.cap_hits(hits(queries, marks).join(caps, "query_id"), [F.col("score").desc(), F.col("id")], F.col("cap"), most=LAST_CAP)
    return results(assess(R.unite(capped), queries, marks))


def logical_scan(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """The exhaustive scan: each name against all rows, capped per channel by length, united, pruned,
    scored, ranked and grouped into families."""
    return _scan(names, corpus, channel_hits)


def keyed_scan(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same scan where candidates are found through keys, for a corpus of any size."""
    return _scan(names, corpus, keyed_hits)


def index(marks: DataFrame) -> dict[str, DataFrame]:
    """Key tables of represented marks."""
    spoken = marks.select(
        "id",
        F.when(F.col("r.diacritics_folded") != "", F.col("r.diacritics_folded")).otherwise(F.col("r.compact")).alias("t"),
    )
    return {"exact": R.exact_key_table(marks), "trigram": R.trigram_table(marks), "phonetic": phonetic_keys(spoken, "id", "t")}


def with_sound_keys(queries: DataFrame) -> DataFrame:
    spoken = queries.select("query_id", F.explode("spoken").alias("t"))
    keys = phonetic_keys(spoken, "query_id", "t").filter("algorithm <> 'unencodable'").groupBy("query_id").agg(
        F.collect_set("key").alias("sound_keys")
    )
    return queries.join(keys, "query_id", "left").withColumn("sound_keys", F.coalesce("sound_keys", F.array().cast("array<string>")))


def index_hits(queries: DataFrame, marks: DataFrame, keys: dict[str, DataFrame], least: float = 0.3) -> DataFrame:
    """Capped hits of all strategies through the key tables, with rank."""
    caps = queries.select("query_id", "cap")
    named = marks.select("id", "mark_text")
    exact = R.key_hits(queries, "exact_keys", keys["exact"], "exact_forms").unionByName(
        R.key_hits(queries, "translit_keys", keys["exact"], "transliteration")
    )
    equal = exact.unionByName(R.sound_hits(queries, keys["phonetic"])).join(named, "id").join(caps, "query_id")
    equal = R.cap_hits(
        equal,
        [F.col("mark_text"), F.col("id")],
        F.col("cap"),
        most=LAST_CAP,
    ).select("query_id", "id", "strategy", "score", "rank")
    full, core = (R.trigram_hits(queries, k, keys["trigram"], least).join(caps, "query_id") for k in ("full_grams", "core_grams"))
    similar = R.reserve_core(full, core, F.col("cap"))
    similar = R.cap_hits(
        similar,
        [F.col("score").desc(), F.col("id")],
        F.col("cap"),
        most=LAST_CAP,
    ).select("query_id", "id", "strategy", "score", "rank")
    return equal.unionByName(similar)


def index_scan(names: DataFrame, corpus: DataFrame, least: float = 0.3) -> DataFrame:
    """The scan by stored key tables, with strategies, keys and caps of their own (``index_hits``)."""
    queries = cut(with_sound_keys(cut(R.query_keys(cut(propose(names))))))
    marks = _named(corpus)
    united = R.unite(index_hits(queries, marks, index(marks), least))
    return results(assess(united, queries, marks, with_context=False))
