"""All pairs of set-valued records whose Jaccard similarity reaches a threshold.

Two sets of a and b values reach the threshold t only if they share at least
c(a, b) = ceil(t / (1 + t) * (a + b)) values. Sets are treated by size:

* both small: every c(a, b)-subset is enumerated for each partner size b that can qualify, and sets
  meet where a subset is equal, so that only true pairs meet;
* one of them large: the large set scans inverted lists of its rarest values, as many as are needed
  so that a qualifying partner must be found in one of them.

The union of both is filtered by the similarity itself. Equal sets are collapsed before all this and
multiplied out at the end.

Defined results
* null key, null or empty set: in no pair; null and empty values are ignored, repeats count once;
* several rows of a key: each row's set counts; a pair of keys comes out once;
* a record never pairs with its own key; keys of a pair are ordered as strings;
* very large sets: handled through the inverted lists; empty tables: no pairs; extra columns: ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.operators.skew import lookup_join, split_join
from markloom.runtime import cut, strip_blanks

EPS = 1e-9


def clean_set(values: Column, trim: bool = True) -> Column:
    """Sorted distinct lower-cased values without nulls and empty ones."""
    one = (lambda v: F.lower(strip_blanks(v))) if trim else F.lower
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, one), lambda v: v != "")))


def least_shared(a: int, b: int, t: float) -> int:
    return math.ceil(t / (1 + t) * (a + b) - EPS)


def partner_sizes(a: int, t: float) -> range:
    return range(max(1, math.ceil(t * a - EPS)), math.floor(a / t + EPS) + 1)


def _subsets(small: int, t: float) -> list[tuple]:
    """(size, low, high, role, positions) of every subset to enumerate; role 0 low, 1 high, 2 equal.

    Where all values must be shared only equal sets qualify, which are collapsed already.
    """
    out = []
    for a in range(1, small + 1):
        for b in partner_sizes(a, t):
            c = least_shared(a, b, t)
            if b <= small and c < max(a, b) and c <= min(a, b):
                role = 2 if a == b else int(a > b)
                out += [(a, min(a, b), max(a, b), role, list(p)) for p in combinations(range(a), c)]
    return out


def _similarity(shared: Column, a: Column, b: Column) -> Column:
    return shared / (F.size(a) + F.size(b) - shared)


#: So many sets of an inverted list, or with one subset, may meet so many others in one task; more are cut into blocks.
LIST_BLOCK = 10_000


def _small_pairs(sets: DataFrame, t: float, small: int) -> DataFrame:
    plan = _subsets(small, t)
    if not plan:
        return sets.limit(0).select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    by_size = {a: [p for p in plan if p[0] == a] for a in {p[0] for p in plan}}
    entry = lambda p: F.struct(F.lit(p[1]).alias("lo"), F.lit(p[2]).alias("hi"), F.lit(p[3]).alias("role"), F.array(*[F.lit(i) for i in p[4]]).alias("at"))
    choice = F.coalesce(*[F.when(F.size("values") == a, F.array(*map(entry, ps))) for a, ps in by_size.items()])
    rows = sets.filter(F.size("values") <= small).select("sid", "left", "right", "values", F.explode(choice).alias("p"))
    signature = F.xxhash64("p.lo", "p.hi", F.array_join(F.transform("p.at", lambda i: F.get("values", i)), "\x01"))
    signed = rows.select("sid", "left", "right", F.col("p.role").alias("role"), signature.alias("sig"))
    a = signed.filter("role <> 1").select("sig", F.col("sid").alias("a"), F.col("left").alias("la"), F.col("right").alias("ra"), "role")
    b = signed.filter("role <> 0").select("sig", F.col("sid").alias("b"), F.col("left").alias("lb"), F.col("right").alias("rb"))
    # A subset that very many sets hold is met in blocks too; all of its pairs are similar ones.
    in_a, in_b = F.count_if(F.col("role") != 1).alias("in_a"), F.count_if(F.col("role") != 0).alias("in_b")
    counts = signed.groupBy("sig").agg(in_a, in_b)
    met = split_join(a, b, ["sig"], counts, "in_a", "in_b", limit=LIST_BLOCK).filter((F.col("role") == 0) | (F.col("a") < F.col("b"))).filter("(la and rb) or (ra and lb)")
    return met.select("a", "b")


def _large_pairs(sets: DataFrame, t: float, small: int) -> DataFrame:
    able = sets.filter(F.size("values") >= math.ceil(t * (small + 1) - EPS))
    flat = able.select("sid", F.explode("values").alias("value"))
    often = flat.groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    ranked = lookup_join(flat, often, ["value"], "often")
    rare_first = ranked.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("s"))
    # Size and slice are columns before the set is flattened, else each row would carry the whole set.
    sized = rare_first.withColumn("size", F.size("s"))
    cut_off = (F.col("size") - F.ceil(F.lit(t) * F.col("size") - EPS) + 1).cast("int")
    probes = sized.select("sid", "size", F.slice("s", F.lit(1), cut_off).alias("p")).select("sid", "size", F.explode("p").alias("v"))
    # An inverted list is kept by bands of set size, so that only sets in a band or its neighbours meet.
    width = -math.log(t) * (1 + EPS) if t < 1 else 1.0
    band = F.floor(F.log("size") / width) if t < 1 else F.col("size").cast("long")
    flags = able.select("sid", "left", "right")
    lists = cut(probes.select(F.col("v.value").alias("value"), "sid", "size", band.alias("band")).join(flags, "sid"))
    side = lambda d, x, bands: d.select("value", bands.alias("band"), F.col("sid").alias(x), F.col("size").alias(f"n{x}"), F.col("left").alias(f"l{x}"), F.col("right").alias(f"r{x}"))
    a = side(lists.filter(F.col("size") > small), "a", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    b = side(lists, "b", F.col("band"))
    many = lambda d, n: d.groupBy("value", "band").agg(F.count(F.lit(1)).alias(n))
    counts = many(a, "in_a").join(many(b, "in_b"), ["value", "band"])
    near = (F.col("nb") >= F.col("na") * t - EPS) & (F.col("na") >= F.col("nb") * t - EPS)
    once = (F.col("nb") <= small) | (F.col("a") < F.col("b"))
    met = split_join(a, b, ["value", "band"], counts, "in_a", "in_b", limit=LIST_BLOCK)
    return met.filter(near & once & (F.col("a") != F.col("b"))).filter("(la and rb) or (ra and lb)").select("a", "b")


def _members(rows: DataFrame, key: str, values: Column) -> DataFrame:
    sets = rows.select(F.col(key).cast("string").alias("key"), values.alias("values")).filter("key is not null and size(values) > 0")
    return sets.withColumn("sid", F.unhex(F.md5(F.array_join("values", "\x01"))))


def similar_sets(
    left: DataFrame, right: DataFrame | None, t: float, small: int = 6, large: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (sid, values, left, right) and pairs (a, b, shared, similarity) of different sets;
    without ``large`` of those of at most ``small`` values."""
    rows = left.select("sid", "values", F.lit(True).alias("left"), F.lit(right is None).alias("right"))
    if right is not None:
        rows = rows.unionByName(right.select("sid", "values", F.lit(False).alias("left"), F.lit(True).alias("right")))
    sets = cut(rows.groupBy("sid").agg(F.first("values").alias("values"), F.max("left").alias("left"), F.max("right").alias("right")))
    met = _small_pairs(sets, t, small)
    met = (met.unionByName(_large_pairs(sets, t, small)) if large else met).distinct()
    va, vb = sets.select(
        F.col("sid").alias("a"),
        F.col("values").alias("va"),
    ), sets.select(F.col("sid").alias("b"), F.col("values").alias("vb"))
    both = met.join(va, "a").join(vb, "b").withColumn("shared", F.size(F.array_intersect("va", "vb")))
    pairs = both.withColumn("similarity", _similarity(F.col("shared"), F.col("va"), F.col("vb"))).filter(F.col("similarity") >= t)
    return sets, pairs.select("a", "b", "shared", "similarity")


def overlap_pairs(rows: DataFrame, key: str, values: Column, t: float, small: int = 6) -> DataFrame:
    """(key_a, key_b) of all pairs of records of one table with similarity >= t."""
    members = cut(_members(rows, key, values).select("key", "sid", "values").distinct())
    _, pairs = similar_sets(members, None, t, small)
    who = members.select("key", "sid")
    a, b = who.select(F.col("sid").alias("a"), F.col("key").alias("x")), who.select(F.col("sid").alias("b"), F.col("key").alias("y"))
    unlike = pairs.join(a, "a").join(b, "b").select("x", "y")
    alike = a.join(b, F.col("a") == F.col("b")).filter(F.col("x") < F.col("y")).select("x", "y")
    return unlike.unionByName(alike).filter("x <> y").select(
        F.least("x", "y").alias("key_a"),
        F.greatest("x", "y").alias("key_b"),
    ).distinct()


def overlap_classes(rows: DataFrame, key: str, values: Column, t: float, small: int = 6) -> DataFrame:
    """(key, set_id, copies, links): for each record its class of equal sets, how many keys share the
    class, and how many other classes are similar to it. Linear in the input, whatever the copies."""
    members = cut(_members(rows, key, values).select("key", "sid", "values").distinct())
    _, pairs = similar_sets(members, None, t, small)
    links = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("sid").agg(F.countDistinct("key").alias("copies"))
    info = copies.join(links, copies["sid"] == links["a"], "left").select("sid", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return lookup_join(members.select("key", "sid"), info, ["sid"], "copies").select(
        "key",
        F.lower(F.hex("sid")).alias("set_id"),
        "copies",
        "links",
    )


#: Up to this many postings and characters the right side is sent to every task.
MAX_POSTINGS, MAX_CHARS = 1_000_000, 32_000_000


def overlap_pairs_between(
    left: DataFrame,
    left_key: str,
    left_values: Column,
    right: DataFrame,
    right_key: str,
    right_values: Column,
    t: float,
    small: int = 6,
    most: int = MAX_POSTINGS,
) -> DataFrame:
    """(key_a, key_b) of all pairs of a left and a right record with similarity >= t.

    Two small sets meet by their subsets. For the pairs with a large set, while the right side has at
    most ``most`` postings and MAX_CHARS characters (counted first), its inverted lists are broadcast and
    each left set scans them where it lies, without a shuffle; beyond, the lists of both sides are joined.
    """
    lm, rm = _members(left, left_key, left_values), _members(right, right_key, right_values)
    ordered = lambda x, y: (F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b"))
    chars = F.sum(F.length("key") + F.length(F.array_join("values", "")))
    n, m = rm.agg(F.coalesce(F.sum(F.size("values")), F.lit(0)), F.coalesce(chars, F.lit(0))).first()
    if n > most or m > MAX_CHARS:
        return _joined(lm, rm, t, small).filter("x <> y").select(*ordered("x", "y")).distinct()
    index = left.sparkSession.sparkContext.broadcast(_index(rm.select("key", "values").distinct().collect()))
    sizes = index.value["sizes"] or [0]
    low, high = math.ceil(t * min(sizes) - EPS), math.floor(max(sizes) / t + EPS)
    fit = lm.filter(F.size("values").between(low, high)).select("key", "values")
    found = fit.mapInArrow(lambda batches: _scan(batches, index.value, t, small), "x string, y string")
    if min(sizes) <= small:
        few = lambda m: m.filter(F.size("values").between(low, small))
        found = found.unionByName(_joined(few(lm), few(rm), t, small, large=False))
    return found.filter("x <> y").select(*ordered("x", "y")).distinct()


def _joined(lm: DataFrame, rm: DataFrame, t: float, small: int, large: bool = True) -> DataFrame:
    """(x, y): left and right keys of similar or equal sets, by the distributed join."""
    lm, rm = cut(lm.distinct()), cut(rm.distinct())
    _, pairs = similar_sets(lm, rm, t, small, large)
    sids = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sids = sids.unionByName(lm.select(F.col("sid").alias("a"), F.col("sid").alias("b")).distinct())
    x, y = lm.select(F.col("sid").alias("a"), F.col("key").alias("x")), rm.select(F.col("sid").alias("b"), F.col("key").alias("y"))
    return sids.join(x, "a").join(y, "b").select("x", "y")


def _index(rows: list) -> dict:
    lists: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for v in r["values"]:
            lists.setdefault(v, []).append(i)
    return {
        "keys": [r["key"] for r in rows],
        "sets": [frozenset(r["values"]) for r in rows],
        "sizes": [len(r["values"]) for r in rows],
        "lists": lists,
    }


def _scan(batches, index: dict, t: float, small: int):
    """Each set probes its rarest values: so many that a qualifying partner must be in their lists. Pairs
    of two small sets are left out."""
    import pyarrow as pa

    lists, sets, sizes, keys = index["lists"], index["sets"], index["sizes"], index["keys"]
    for batch in batches:
        xs, ys = [], []
        for key, values in zip(batch.column("key").to_pylist(), batch.column("values").to_pylist(), strict=True):
            a = len(values)
            known = [v for v in values if v in lists]
            least = math.ceil(t * a - EPS)
            if len(known) < least:
                continue
            known.sort(key=lambda v: len(lists[v]))
            own, seen = frozenset(values), set()
            for v in known[: len(known) - least + 1]:
                seen.update(lists[v])
            for i in seen:
                b = sizes[i]
                if max(a, b) > small and b >= a * t - EPS and a >= b * t - EPS:
                    shared = len(own & sets[i])
                    if shared / (a + b - shared) >= t:
                        xs.append(key)
                        ys.append(keys[i])
        yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.string()), "y": pa.array(ys, pa.string())})
