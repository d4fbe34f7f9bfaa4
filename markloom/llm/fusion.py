"""One ranking per group from several scores on unlike scales.

Each score becomes its empirical percentile within the group (ties share the mean rank), the
percentile its normal quantile, and the quantiles are averaged by weight. Ranges and shapes of the
scores thus have no influence, only the orders they give.

Defined results
* null group or item: left out; repeated rows of an item: one counts, the greatest in ``prefer``
  and then in its scores;
* null or NaN score: unknown. With ``unknown="skip"`` it has no percentile and its weight is left
  out of the mean (an item without any score gets a null mean and comes last); with
  ``unknown="lowest"`` unknown scores tie below all known ones;
* equal means (to 9 decimals): by item ascending; a group of one: percentile 0.5, mean 0;
* empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.operators.skew import lookup_join, running_count, split_join
from markloom.runtime import cut

#: Wichura's AS 241 (PPND16): rational approximations of the normal quantile, coefficients from
#: the lowest power up, numerator then denominator, for the centre, the tails and the far tails.
CENTRE = (
    (
        3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
        45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727,
    ),
    (
        1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
        21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610,
    ),
)
TAIL = (
    (
        1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
        1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640,
    ),
    (
        1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
        0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9,
    ),
)
FAR = (
    (
        6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
        0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
    ),
    (
        1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
        0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
    ),
)


def _ratio(parts: tuple, x: Column) -> Column:
    horner = [reduce(lambda acc, c: acc * x + F.lit(c), reversed(side[:-1]), F.lit(side[-1])) for side in parts]
    return horner[0] / horner[1]


def _root(p: Column) -> Column:
    return F.sqrt(-F.log(F.when(p < 0.5, p).otherwise(1 - p)))


def _quantile(q: Column, r: Column) -> Column:
    side = F.when(r <= 5, _ratio(TAIL, r - 1.6)).otherwise(_ratio(FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, F.lit(0.180625) - q * q)).otherwise(F.when(q < 0, -side).otherwise(side))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, for 0 < p < 1; about 1e-15 exact."""
    return _quantile(p - 0.5, _root(p))


def with_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """``df`` with the normal quantile of ``p``. Its two inputs are columns first, else each of the some
    fifty places that use them repeats them, and the generated code outgrows a method."""
    inputs = df.withColumns({"_q": F.col(p) - 0.5, "_r": _root(F.col(p))})
    return inputs.withColumn(out, _quantile(F.col("_q"), F.col("_r"))).drop("_q", "_r")


#: Groups of at most so many items are ranked by windows in one task, whatever the size of the input.
IN_ONE_TASK = 50_000


def _weigh(df: DataFrame, z: Column, weight: float) -> DataFrame:
    """``df`` with a quantile added to the running sums of the weighted mean."""
    known = lambda x: F.when(z.isNotNull(), x).otherwise(0.0)
    return df.withColumns({"_top": F.col("_top") + known(z * weight), "_mass": F.col("_mass") + known(F.lit(weight))})


def _mean(df: DataFrame) -> DataFrame:
    return df.withColumn("fused", F.when(F.col("_mass") > 0, F.round(F.col("_top") / F.col("_mass"), 9) + 0.0)).drop("_top", "_mass")


def _no_sums(df: DataFrame) -> DataFrame:
    return df.withColumns({"_top": F.lit(0.0), "_mass": F.lit(0.0)})


def _small_groups(base: DataFrame, weights: list[float], unknown: str) -> DataFrame:
    """(g, i, n, s, p, fused) for groups that fit a task: all windows share one shuffle by group, and each
    score takes one sort, whose running count and rank give the number of ties too."""
    m = len(weights)
    group = Window.partitionBy("g")
    known = {f"k{k}": F.count(f"s{k}").over(group) for k in range(m)} if unknown == "skip" else {}
    df = _no_sums(base).withColumns({"n": F.count(F.lit(1)).over(group)} | known)
    for k in range(m):
        s = F.col(f"s{k}")
        up = group.orderBy(s.asc_nulls_first())
        df = df.withColumns({"_r": F.rank().over(up), "_c": F.count(F.lit(1)).over(up)})
        middle = (F.col("_r") - 1 + F.col("_c")) / 2
        p = middle / F.col("n") if unknown == "lowest" else F.when(s.isNotNull(), (middle - F.col("n") + F.col(f"k{k}")) / F.col(f"k{k}"))
        df = with_quantile(df.withColumn(f"p{k}", p).drop("_r", "_c", f"k{k}"), f"p{k}", "_z")
        df = _weigh(df, F.col("_z"), weights[k]).drop("_z")
    return _mean(df)


def _large_groups(base: DataFrame, weights: list[float], unknown: str) -> DataFrame:
    """The same for groups of any size: counts of distinct values, running sums in value ranges."""
    m = len(weights)
    cell = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"s{k}").isNotNull().alias("known"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("v"))
    cells = F.explode(F.array(*map(cell, range(m))))
    long = base.select("g", "i", cells.alias("c")).select("g", "i", "c.k", "c.known", "c.v")
    counts = long.groupBy("g", "k", "known", "v").agg(F.count(F.lit(1)).alias("same"))
    counted = F.col("same") if unknown == "lowest" else F.when(F.col("known"), F.col("same")).otherwise(0)
    ranks = running_count(counts, ["g", "k"], [F.col("known").asc(), F.col("v").asc()], counted, "below", "n")
    pct = (F.col("below") + F.col("same") / 2) / F.col("n")
    ranks = ranks.select("g", "k", "known", "v", "same", (pct if unknown == "lowest" else F.when(F.col("known"), pct)).alias("p"))
    ranks = cut(with_quantile(ranks, "p", "z"))
    found = lookup_join(long, ranks, ["g", "k", "known", "v"], "same")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    value = lambda k: F.max(F.when((F.col("k") == k) & F.col("known"), F.col("v")))
    columns = [c for k in range(m) for c in (at("p", k).alias(f"p{k}"), at("z", k).alias(f"z{k}"), value(k).alias(f"s{k}"))]
    out = _no_sums(found.groupBy("g", "i").agg(*columns))
    for k in range(m):
        out = _weigh(out, F.col(f"z{k}"), weights[k])
    return _mean(out)


def fuse(
    rows: DataFrame,
    group: str,
    item: str,
    scores: dict[str, Column],
    weights: dict[str, float] | None = None,
    unknown: str = "skip",
    prefer: list[Column] = (),
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """(group, item, n, <score>, <score>_pct, fused, place); place 1 is the best, n the group's items.

    Where no group has more than ``in_one_task`` rows (counted first, over the group column alone) one
    shuffle by group serves everything. Else items are made distinct by group and item, larger groups
    are split by value ranges, for the percentiles and for the places alike, and both ways give the same.
    """
    names = list(scores)
    m = len(names)
    load = [float((weights or {}).get(s, 1.0)) for s in names]
    real = {s: F.when(~F.isnan(c.cast("double")), c.cast("double")) for s, c in scores.items()}
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(prefer)], F.struct(*[c.alias(s) for s, c in real.items()]).alias("s"))
    flat = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), packed.alias("m")).dropna(subset=["g", "i"])
    some = not flat.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > in_one_task).isEmpty()
    one = (flat if some else flat.repartition("g")).groupBy("g", "i").agg(F.max("m").alias("m"))
    base = one.select("g", "i", *[F.col(f"m.s.{s}").alias(f"s{k}") for k, s in enumerate(names)])
    order = [F.col("fused").desc_nulls_last(), F.col("i").asc()]
    keep = ["g", "i", "n", *[f"s{k}" for k in range(m)], *[f"p{k}" for k in range(m)], "fused", "place"]
    place = F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint")
    within = lambda d: _small_groups(d, load, unknown).withColumn("place", place).select(*keep)
    if some:
        base = cut(base)
        sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        sized = split_join(base, sizes, ["g"], sizes, "n", limit=in_one_task or 1)
        large = _large_groups(sized.filter(F.col("n") > in_one_task).drop("n"), load, unknown)
        placed = running_count(large, ["g"], order, F.lit(1), "before", "n")
        placed = placed.withColumn("place", (F.col("before") + 1).cast("bigint")).select(*keep)
        out = within(sized.filter(F.col("n") <= in_one_task).drop("n")).unionByName(placed)
    else:
        out = within(base)
    values = [F.col(f"s{k}").alias(s) for k, s in enumerate(names)]
    shares = [F.col(f"p{k}").alias(f"{s}_pct") for k, s in enumerate(names)]
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "n", *values, *shares, "fused", "place")


def _beats(a: Column, b: Column, names: list[str], least: int) -> Column:
    """Whether a is strictly higher than b in at least ``least`` scores, unknown below all."""
    wins = [F.coalesce(a[s] > b[s], a[s].isNotNull() & b[s].isNull()).cast("int") for s in names]
    return sum(wins[1:], wins[0]) >= least


def clear_winners(
    rows: DataFrame,
    group: str,
    item: str,
    scores: dict[str, Column],
    least: int,
    smallest: int = 3,
    prefer: list[Column] = (),
    chunk: int = 1024,
    in_one_task: int = IN_ONE_TASK,
) -> DataFrame:
    """(group, item) of the item that beats every other of its group in at least ``least`` scores.

    The fused ranking gives a short list. Of m scores the winner may lose l = m - least to any rival, so
    over its n - 1 rivals at most (n - 1) * l places in all scores together. While l is at most a quarter
    of m the mean of its quantiles is least where these places are spread evenly over the scores (a
    test goes through all splits), so nobody below the quantile of 1 - ((n - 1) * l / m + 0.5) / n can
    have won; else the list holds everybody. Then an exact check: a knock-out in chunks, which a true
    winner survives in any order, leaves one item for a group, and this is held against all of the group.
    """
    names = list(scores)
    lost = (len(names) - least) / len(names)
    ranked = fuse(rows, group, item, scores, unknown="lowest", prefer=prefer, in_one_task=in_one_task).filter(F.col("n") >= smallest)
    ranked = cut(ranked.select(group, item, "n", *names, "fused"))
    most = ranked.agg(F.max("n")).first()[0] or 0
    short = ranked
    if 4 * lost <= 1:
        even = with_quantile(ranked.withColumn("_e", 1 - ((F.col("n") - 1) * lost + 0.5) / F.col("n")), "_e", "_floor")
        short = even.filter(F.col("fused") >= F.col("_floor") - 1e-6)
    one = F.struct(F.col(item).alias("i"), *[F.col(s) for s in names])
    nothing = F.lit(None).cast(short.select(one.alias("x")).schema["x"].dataType)
    duel = lambda a, b: F.when(a.isNull(), b).when(_beats(a, b, names, least), a).when(_beats(b, a, names, least), b).otherwise(nothing)

    def knock(d: DataFrame, keys: list[str]) -> DataFrame:
        met = d.groupBy(*keys).agg(F.collect_list("x").alias("xs"), F.max("n").alias("n"))
        return met.select(*keys, "n", F.aggregate("xs", nothing, duel).alias("x")).filter("x is not null")

    left = short.select(group, "n", one.alias("x"), F.pmod(F.xxhash64(item), F.ceil(F.col("n") / chunk)).alias("_b"))
    while most > chunk:
        left = knock(left, [group, "_b"]).withColumn("_b", F.floor(F.col("_b") / chunk))
        most = -(-most // chunk)
    left = cut(knock(left, [group]))
    held = lookup_join(ranked.drop("n", "fused"), left, [group], "n").filter(F.col(item) != F.col("x.i"))
    sound = held.groupBy(group, F.col("x.i").alias(item)).agg(F.min(_beats(F.col("x"), F.struct(*names), names, least)).alias("ok"))
    return sound.filter("ok").select(group, item)
