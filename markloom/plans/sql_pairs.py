"""Metrics, features and scores of pairs of texts in SQL, as lists of common table expressions."""

from __future__ import annotations

from markloom.functions.lexicons import RELATED_CLASSES, SENTENCES, TRANSLATIONS
from markloom.functions.scalars import RULES
from markloom.plans import sql_texts as X


def _spelled(x: str) -> str:
    """A text in an alphabet of one byte a character, as the engine's distances are of bytes."""
    return f"array_to_string(list_transform({X.LETTERS.format(x)}, lambda c: chr(CAST(32 + list_position(l, c) AS INT))), '')"


def _rule(x: str, y: str, locale: str, m: int, n: int) -> str:
    """Cost of equating two stretches of m and n letters, null where no rule does."""
    cases = [
        f"WHEN {x} = '{a}' AND {y} = '{b}' THEN {found[0][0]}" for (a, b), found in RULES[locale].items() if (len(a), len(b)) == (m, n)
    ]
    return f"CASE {' '.join(cases)} END" if cases else "NULL"


def jaro(source: str, name: str) -> str:
    """CTEs from a table of (a, b) to ``name``(a, b, jw) alone."""
    p = f"{name}_p"
    return f"""{p} AS (SELECT *, len(la) AS na, len(lb) AS nb, greatest(greatest(len(la), len(lb)) // 2 - 1, 0) AS reach FROM (
  SELECT a, b, row_number() OVER () AS id, {X.LETTERS.format("a")} AS la, {X.LETTERS.format("b")} AS lb FROM (SELECT DISTINCT a, b
  FROM {source}))),
{name}_r AS (SELECT id, 0 AS i, CAST([] AS BIGINT[]) AS used FROM {p} UNION ALL
  SELECT r.id, i + 1, list_append(used, coalesce(list_filter(generate_series(greatest(1, i + 1 - reach), least(nb, i + 1 + reach)),
  lambda j: lb[j] = la[i + 1] AND NOT list_contains(used, j))[1], 0))
  FROM {name}_r r JOIN {p} p USING (id) WHERE i < na),
{name}_k AS (SELECT p.*, list_filter(generate_series(1, na), lambda k: used[k] > 0) AS ka, list_sort(list_filter(used,
  lambda j: j > 0)) AS kb FROM {name}_r JOIN {p} p USING (id) WHERE i = na),
{name}_j AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN len(ka) = 0 THEN 0.0 ELSE (len(ka) / CAST(na AS DOUBLE) + len(ka) / CAST(nb AS DOUBLE)
  + (len(ka) - len(list_filter(generate_series(1, len(ka)),
  lambda k: la[ka[k]] <> lb[kb[k]])) / CAST(2 AS DOUBLE)) / len(ka)) / 3 END AS jaro,
  len(list_filter(generate_series(1, least(4, na, nb)), lambda k: la[1:k] = lb[1:k])) AS start FROM {name}_k),
{name} AS (SELECT a, b, jaro + start * CAST(0.1 AS DOUBLE) * (1 - jaro) AS jw FROM {name}_j)"""


def metrics(source: str, locale: str, name: str = "metrics") -> str:
    """CTEs (recursive ones among them) from a table of (a, b) to ``name``(a, b, levenshtein, damerau, jaro, jw, lcs, cost, similarity,
  dice).

    jaro: letters of a take the first free equal letter of b in reach, in order. lcs and cost: one row of the
    table for each letter of a; ``cost`` is of lower-case texts without marks.
    """
    one = _rule("x1", "wb[j]", locale, 1, 1)
    steps = [
        "p1[j + 1] + 1",
        f"CASE WHEN j >= 1 THEN p1[j] + CASE WHEN x1 = wb[j] THEN 0 ELSE {one} END END",
        f"CASE WHEN j >= 2 THEN p1[j - 1] + {_rule('x1', 'wb[j - 1] || wb[j]', locale, 1, 2)} END",
        f"CASE WHEN j >= 1 AND i >= 1 THEN p2[j] + {_rule('x2', 'wb[j]', locale, 2, 1)} END",
        f"CASE WHEN j >= 2 AND i >= 1 THEN p2[j - 1] + {_rule('x2', 'wb[j - 1] || wb[j]', locale, 2, 2)} END",
    ]
    base = f"list_transform(generate_series(0, nw), lambda j: least({', '.join(steps)}))"
    return f"""m0 AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT a, b FROM {source} WHERE a IS NOT NULL AND b IS NOT NULL)),
m1 AS (SELECT *, {X.LETTERS.format("a")} AS la, {X.LETTERS.format("b")} AS lb, {X.LETTERS.format(f"strip_accents({X.lowered('a')})")} AS wa,
  {X.LETTERS.format(f"strip_accents({X.lowered('b')})")} AS wb,
  list_distinct({X.LETTERS.format("a || b")}) AS l FROM m0),
mp AS (SELECT *, len(la) AS na, len(lb) AS nb, len(wb) AS nw, greatest(greatest(len(la), len(lb)) // 2 - 1, 0) AS reach,
  {_spelled("a")} AS sa, {_spelled("b")} AS sb,
  list_distinct({X.grams("a", 3)}) AS ga, list_distinct({X.grams("b", 3)}) AS gb FROM m1),
jr AS (SELECT id, 0 AS i, CAST([] AS BIGINT[]) AS used FROM mp UNION ALL
  SELECT jr.id, i + 1, list_append(used, coalesce(list_filter(generate_series(greatest(1, i + 1 - reach), least(nb, i + 1 + reach)),
  lambda j: lb[j] = la[i + 1] AND NOT list_contains(used, j))[1], 0))
  FROM jr JOIN mp USING (id) WHERE i < na),
ja AS (SELECT id, list_filter(generate_series(1, na), lambda k: used[k] > 0) AS ka, list_sort(list_filter(used, lambda j: j > 0)) AS kb
  FROM jr JOIN mp USING (id) WHERE i = na),
jm AS (SELECT id, len(ka) AS m, len(list_filter(generate_series(1, len(ka)),
  lambda k: la[ka[k]] <> lb[kb[k]])) / CAST(2 AS DOUBLE) AS moved FROM ja JOIN mp USING (id)),
lr AS (SELECT id, 0 AS i, list_transform(generate_series(0, nb), lambda j: 0) AS r FROM mp UNION ALL
  SELECT id, i + 1, list_transform(generate_series(1, nb + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT lr.id, i, nb, [0] || list_transform(generate_series(1, nb), lambda j: CASE WHEN la[i + 1] = lb[j] THEN r[j] + 1
  ELSE r[j + 1] END) AS c FROM lr JOIN mp USING (id) WHERE i < na)),
ll AS (SELECT id, r[nb + 1] AS lcs FROM lr JOIN mp USING (id) WHERE i = na),
wr AS (SELECT id, 0 AS i, CAST([] AS DOUBLE[]) AS p2, list_transform(generate_series(0, nw), lambda j: CAST(j AS DOUBLE)) AS p1 FROM mp
  UNION ALL
  SELECT id, i + 1, p1, list_transform(generate_series(0, nw), lambda j: list_min(list_transform(generate_series(0, j),
  lambda k: c[k + 1] + (j - k)))) FROM (
    SELECT id, i, p1, nw, {base} AS c FROM (SELECT wr.id, i, p1, p2, nw, wb, wa[i + 1] AS x1, wa[i] || wa[i + 1] AS x2 FROM wr
  JOIN mp USING (id) WHERE i < len(wa)))),
wl AS (SELECT id, p1[nw + 1] AS cost, greatest(len(wa), nw) AS longest FROM wr JOIN mp USING (id) WHERE i = len(wa)),
mj AS (SELECT mp.*, lcs, cost, longest, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0
  ELSE (m / CAST(na AS DOUBLE) + m / CAST(nb AS DOUBLE) + (m - moved) / m) / 3 END AS jaro,
  CASE WHEN la[1] IS DISTINCT FROM lb[1] OR la[1] IS NULL THEN 0 WHEN la[2] IS DISTINCT FROM lb[2] OR la[2] IS NULL THEN 1
    WHEN la[3] IS DISTINCT FROM lb[3] OR la[3] IS NULL THEN 2 WHEN la[4] IS DISTINCT FROM lb[4] OR la[4] IS NULL THEN 3 ELSE 4 END AS start
  FROM mp JOIN jm USING (id) JOIN ll USING (id) JOIN wl USING (id)),
{name} AS (SELECT a, b, na, nb, levenshtein(sa, sb) AS levenshtein, damerau_levenshtein(sa, sb) AS damerau, jaro,
  jaro + start * CAST(0.1 AS DOUBLE) * (1 - jaro) AS jw, lcs, cost,
  CASE WHEN longest > 0 THEN greatest(0.0, least(1.0, 1 - cost / longest)) ELSE 1.0 END AS similarity,
  CASE WHEN len(ga) + len(gb) > 0 THEN 2 * len(list_intersect(ga, gb)) / CAST(len(ga) + len(gb) AS DOUBLE) ELSE 1.0 END AS dice FROM mj)"""


def _same(x: str, y: str) -> str:
    return f"CASE WHEN {x} <> '' AND {y} <> '' THEN CAST({x} = {y} AS INT)::DOUBLE END"


def _glued(x: str) -> str:
    return X.sub(x, (f"{X.B}+", ""))


def _jaccard(x: str, y: str) -> str:
    both = f"len(list_intersect(list_distinct({x}), list_distinct({y})))"
    n = f"(len(list_distinct({x})) + len(list_distinct({y})))"
    return f"CASE WHEN {n} > 0 THEN {both} / CAST({n} - {both} AS DOUBLE) END"


_MEANS = "CASE x " + " ".join(f"WHEN '{k}' THEN [{X.listed(v)}]" for k, v in TRANSLATIONS.items()) + " ELSE CAST([] AS VARCHAR[]) END"

#: From said, cores, variants, keyed and second: sides(t, ...), what pairs are compared by.
SIDES = f"""off AS (SELECT *, core <> '' AND latin <> '' AND core <> latin AND NOT regexp_full_match(core,
  '[\\p{{Latin}}\\p{{N}}]*') AS off FROM said),
sides AS (SELECT o.t, o.dia, o.low, o.compact, o.core, c.sig, c.noise, c.weak, c.n, c.dominant, list_transform(v.v,
  lambda x: lower(x)) AS v, k.key, z.key2,
  {X.sub("lower(o.spoken)", ("[^b-df-hj-np-tv-xz]", ""))} AS bones, CASE WHEN off OR o.core = '' THEN latin ELSE o.core END AS stem,
  list_filter(list_distinct([o.compact, latin, o.core]), lambda x: x <> '') AS forms
  FROM off o JOIN cores c ON c.t = o.t JOIN variants v ON v.t = o.t LEFT JOIN keyed k ON k.t = o.spoken LEFT
  JOIN second z ON z.spoken = o.spoken)"""

#: From sides and pairs: measured(a, b), all that metrics are needed of.
MEASURED = """met AS (SELECT p.a AS pa, p.b AS pb, unnest(x.forms) AS a, y.forms AS ys FROM pairs p JOIN sides x ON x.t = p.a
  JOIN sides y ON y.t = p.b),
formed AS (SELECT pa, pb, a, unnest(ys) AS b FROM met),
spoken_pairs AS (SELECT x.key AS a, y.key AS b FROM pairs p JOIN sides x ON x.t = p.a JOIN sides y ON y.t = p.b WHERE x.key <> ''
  AND y.key <> ''),
measured AS (SELECT a, b FROM formed UNION SELECT a, b FROM spoken_pairs)"""

_DOWN = """CASE WHEN least(length(a), length(b)) >= 4 AND length(a) <> length(b)
  AND ((length(a) < length(b) AND starts_with(b, a)) OR (length(b) < length(a) AND starts_with(a, b))) THEN CAST(0.7 AS DOUBLE)
  ELSE 1.0 END"""


def _common(x: str, y: str) -> str:
    """Length of the common start."""
    return f"len(list_filter(generate_series(1, least(length({x}), length({y}))), lambda k: left({x}, k) = left({y}, k)))"


def _related() -> str:
    pairs = ", ".join(f"{x * 100 + y}, {y * 100 + x}" for x, y in RELATED_CLASSES)
    cells = "flatten(list_transform(list_distinct(ca), lambda x: list_transform(list_filter(list_distinct(cb), lambda y: y <> x), lambda y: x * 100 + y)))"
    return f"CASE WHEN len({cells}) > 0 THEN len(list_filter({cells}, lambda z: z IN ({pairs}))) / CAST(len({cells}) AS DOUBLE) ELSE 0.0 END"


RELATED = _related()

#: From sides and the texts of either side asked(t) and held(t): channels(a, b, strategy, score) of the whole scan.
CHANNELS = f"""sq AS (SELECT s.* FROM sides s JOIN asked USING (t)), sm AS (SELECT s.* FROM sides s JOIN held USING (t)),
qf AS (SELECT DISTINCT t, unnest(forms) AS f FROM sq), mf AS (SELECT DISTINCT t, unnest(forms) AS f FROM sm),
fs AS (SELECT f, list_distinct({X.grams("f", 3)}) AS g, {X.LETTERS.format("f")} AS l FROM (SELECT f FROM qf UNION SELECT f FROM mf)),
fl AS (SELECT f, l[i] AS ch, row_number() OVER (PARTITION BY f, l[i] ORDER BY i) AS o FROM (SELECT f, l, unnest(generate_series(1,
  len(l))) AS i FROM fs)),
fb AS (SELECT f, list(ch || o) AS bag FROM fl GROUP BY f),
fp AS (SELECT x.f AS a, y.f AS b, bx.bag AS ba, by_.bag AS bb, gx.g AS ga, gy.g AS gb FROM (SELECT DISTINCT f FROM qf) x CROSS
  JOIN (SELECT DISTINCT f FROM mf) y
  JOIN fb bx ON bx.f = x.f JOIN fb by_ ON by_.f = y.f JOIN fs gx ON gx.f = x.f JOIN fs gy ON gy.f = y.f),
fd AS (SELECT a, b, {_DOWN} AS d, CASE WHEN len(ga) + len(gb) > 0 THEN 2 * len(list_intersect(ga, gb)) / CAST(len(ga) + len(gb) AS DOUBLE)
  ELSE 1.0 END AS dice,
  len(list_intersect(ba, bb)) * (1 / CAST(len(ba) AS DOUBLE) + 1 / CAST(len(bb) AS DOUBLE)) >= CAST(1.25 AS DOUBLE) - 1e-9 AS reach
  FROM fp),
ft AS (SELECT q.t AS a, m.t AS b, q.f AS fa, m.f AS fb, d, dice * d >= CAST(0.25 AS DOUBLE) AS alike, reach FROM fd JOIN qf q ON q.f = fd.a
  JOIN mf m ON m.f = fd.b WHERE dice * d >= CAST(0.25 AS DOUBLE) OR reach),
sure AS (SELECT q.t AS a, m.t AS b, 1 AS s FROM sq q JOIN sm m ON q.compact = m.compact WHERE q.compact <> ''
  UNION SELECT q.t, m.t, 2 FROM (SELECT t, unnest(v) AS v FROM sq) q JOIN (SELECT t, unnest(v) AS v FROM sm) m USING (v)
  UNION SELECT a, b, 3 FROM ft WHERE alike
  UNION SELECT q.t, m.t, 4 FROM (SELECT t, unnest(sig) AS w FROM sq) q JOIN (SELECT t, unnest(sig) AS w FROM sm) m USING (w)
  UNION SELECT q.t, m.t, 5 FROM sq q JOIN sm m ON (q.key = m.key AND q.key <> '') OR (q.bones = m.bones AND q.bones <> '')),
cand AS (SELECT a, b FROM sure UNION SELECT a, b FROM ft WHERE reach),
nf AS (SELECT c.a AS ta, c.b AS tb, q.f AS a, m.f AS b FROM cand c JOIN qf q ON q.t = c.a JOIN mf m ON m.t = c.b), {jaro("nf", "near")},
best_near AS (SELECT ta AS a, tb AS b, max(jw * {_DOWN.replace("(a", "(nf.a").replace("(b", "(nf.b").replace(", a)", ", nf.a)").replace(", b)", ", nf.b)")}) AS score FROM nf JOIN near USING (a, b) GROUP BY ta, tb),
channels AS (SELECT a, b, ['exact_forms', 'transliteration', 'trigram', 'token', 'phonetic'][s] AS strategy, coalesce(score, 0.0) AS score
  FROM (SELECT a, b, s FROM sure UNION SELECT a, b, 3 FROM best_near WHERE score >= CAST(0.85 AS DOUBLE)) LEFT JOIN best_near USING (a,
  b))"""

#: From sides and metrics: features(a, b, ...), one row for each pair; classes of either side are ca and cb.
FEATURES = f"""best AS (SELECT pa, pb, max((1 - levenshtein / CAST(greatest(na, nb) AS DOUBLE)) * d) AS lev,
  max((1 - damerau / CAST(greatest(na, nb) AS DOUBLE)) * d) AS dam, max(jaro * d) AS jaro,
  max(jw * d) AS jw, max(similarity * d) AS wed, max(dice * d) AS dice, max(lcs / CAST(greatest(na, nb) AS DOUBLE) * d) AS lcs
  FROM (SELECT f.pa, f.pb, m.*, {_DOWN.replace("(a", "(m.a").replace("(b", "(m.b").replace(", a)", ", m.a)").replace(", b)", ", m.b)")} AS d FROM formed f JOIN metrics m USING (a, b)) GROUP BY pa, pb),
features AS (SELECT p.a, p.b, p.ca, p.cb, {_same(_glued("x.dia"), _glued("y.dia"))} AS normalized,
  {_same("x.compact", "y.compact")} AS compact, {_same(_glued("x.low"), _glued("y.low"))} AS folded,
  CASE WHEN len(x.v) > 0 AND len(y.v) > 0 THEN CAST(list_has_any(x.v, y.v) AS INT)::DOUBLE END AS translit, lev, dam, t.jaro, t.jw, wed,
  t.dice, t.lcs,
  {_same("coalesce(x.dominant, '')", "coalesce(y.dominant, '')")} AS dom, {_jaccard("x.sig", "y.sig")} AS sig,
  {_jaccard("x.noise", "y.noise")} AS noise0,
  {_jaccard("list_filter(x.sig, lambda w: w IS DISTINCT FROM x.dominant)", "list_filter(y.sig, lambda w: w IS DISTINCT FROM y.dominant)")} AS second,
  CASE WHEN len(x.sig) > 0 AND len(y.sig) > 0 THEN CAST(len(list_filter(x.sig, lambda w: list_contains(y.sig, w))) AS DOUBLE) END AS shared,
  CASE WHEN x.stem <> '' AND y.stem <> '' THEN {_common("x.stem", "y.stem")} / CAST(greatest(length(x.stem),
  length(y.stem)) AS DOUBLE) END AS pre,
  CASE WHEN x.stem <> '' AND y.stem <> '' THEN {_common("reverse(x.stem)", "reverse(y.stem)")} / CAST(greatest(length(x.stem),
  length(y.stem)) AS DOUBLE) END AS suf,
  len(x.sig) = 0 OR len(y.sig) = 0 AS bare, x.core = y.core AS cores, {_same("x.key", "y.key")} AS key1,
  {_same("x.key2", "y.key2")} AS key2, {_same("x.bones", "y.bones")} AS bones,
  CASE WHEN x.key <> '' AND y.key <> '' THEN CASE WHEN x.key = y.key THEN 1.0 ELSE k.jw END END AS sound,
  CASE WHEN len(x.sig) = 0 OR len(y.sig) = 0 THEN CASE WHEN list_contains({_MEANS.replace("CASE x", "CASE x.compact")},
  y.compact) THEN 1.0 END
    ELSE CAST(len(list_filter(x.sig, lambda x: list_contains(y.sig, x) OR list_has_any({_MEANS},
  y.sig))) > 0 AS INT)::DOUBLE END AS meaning,
  CASE WHEN len(x.weak) > 0 OR len(y.weak) > 0 THEN least(len(x.weak) / CAST(greatest(x.n, 1) AS DOUBLE), len(y.weak) / CAST(greatest(y.n,
  1) AS DOUBLE)) END AS plain,
  coalesce({_jaccard("p.ca", "p.cb")}, 0.0) AS classes
  FROM pairs p JOIN sides x ON x.t = p.a JOIN sides y ON y.t = p.b LEFT JOIN best t ON t.pa = p.a AND t.pb = p.b LEFT
  JOIN metrics k ON k.a = x.key AND k.b = y.key)"""

_TESTS = {
    "exact_normalized": "normalized = 1",
    "exact_compact": "compact = 1",
    "exact_transliteration": "translit = 1",
    "orthographic_high": "coalesce(jw, 0) >= 0.85",
    "orthographic_medium": "coalesce(jw, 0) >= 0.65 AND coalesce(jw, 0) < 0.85",
    "phonetic_primary_match": "key1 = 1",
    "phonetic_secondary_match": "key2 = 1",
    "phonetic_similar": "sound >= 0.7",
    "token_dominant_overlap": "dom = 1",
    "token_core_overlap": "sig >= 0.5",
    "token_noise_only": "noise >= 0.5",
    "token_core_empty": "bare",
    "token_secondary_overlap": "second > 0",
    "token_prefix_overlap": "pre >= 0.8",
    "token_suffix_overlap": "suf >= 0.8",
    "conceptual_translation": "meaning = 1",
    "goods_missing": "true",
}
MULTI_CODES = "list_filter([" + ", ".join(
    f"CASE WHEN {t} THEN '{c}' END" for c, t in [*_TESTS.items(), ("retrieval_multi_strategy", "channels >= 2")]
) + "], lambda c: c IS NOT NULL)"
CODES = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in _TESTS.items()) + "], lambda c: c IS NOT NULL)"


def sentences(codes: str, a: str, b: str, locale: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {X.quoted(v)}" for k, v in SENTENCES[locale].items())
    return f"array_to_string(list_transform({codes}, lambda c: replace(replace(CASE c {cases} END, '{{proposedMark}}', {a}), '{{candidateMark}}', {b})), '|')"


#: From features: scored(..., score, risk_band, confidence) without goods texts.
SCORED = """noted AS (SELECT *, CASE WHEN sig > 0 THEN 0.0 ELSE noise0 END AS noise, CASE
  WHEN NOT bare THEN CAST(cores AS INT)::DOUBLE END AS core FROM features),
q1 AS (SELECT *, coalesce(dom, 0) AS d, coalesce(sig, 0) AS j, coalesce(core, 0) AS k, coalesce(second, 0) AS s2, coalesce(noise, 0) AS nz,
  CAST(bare AS INT) AS em, coalesce(shared, 0) AS sh,
  coalesce(greatest(normalized, compact, folded, translit), 0) * 100 AS exact, coalesce(greatest(lev, dam, wed), 0) * 100 AS edit,
  coalesce(greatest(lev, dam, wed, jw, dice, lcs), 0) * 100 AS wide,
  coalesce(greatest(key1, key2, sound, bones), 0) * 100 AS heard, coalesce(greatest(meaning, sig), 0) * 100 AS idea, greatest(coalesce(pre,
  0), coalesce(suf, 0)) AS affix FROM noted),
q2 AS (SELECT *, CASE WHEN d >= 1 AND j > 0 AND j < 1 AND k < 1 THEN j ELSE d END AS led, greatest(d, j, k) AS signal, nz >= 0.5
  AND j < 0.25 AND k < 1 AND d < 1 AS noisy FROM q1),
q3 AS (SELECT *, greatest(led, j, k, CASE WHEN led >= 1 OR k >= 1 THEN s2 ELSE s2 * 0.55 END) AS tok, CASE WHEN signal < 0.25 THEN edit
  ELSE wide END AS ortho,
  heard >= 80 AND NOT (k >= 1 OR d >= 1 OR signal >= 0.5) AND edit < 80 AND NOT (coalesce(jw, 0) * 100 >= 85 AND affix >= 0.4
  AND edit >= 70) AS alone,
  signal < 0.25 AND greatest(coalesce(lcs, 0), coalesce(dice, 0)) * 100 >= 80 AND edit < 75 AS surface FROM q2),
q4 AS (SELECT *, CASE WHEN em >= 1 THEN 0.0 WHEN d < 1 AND k < 1 AND j >= 0.5 AND j < 1 THEN greatest(tok, CAST(0.75 AS DOUBLE))
  ELSE tok END * 100 AS token FROM q3),
q5 AS (SELECT *, list_reverse_sort([exact, ortho, token, heard]) AS r FROM q4),
q6 AS (SELECT *, CASE WHEN r[1] >= 95 AND r[2] >= 70 THEN least(r[1] + r[2] * CAST(0.15 AS DOUBLE), 100) ELSE r[1] END AS b0 FROM q5),
q7 AS (SELECT *, CASE WHEN classes > 0 THEN greatest(least(b0 * CAST(0.85 AS DOUBLE) + classes * 60 * CAST(0.15 AS DOUBLE), 100), 0)
  ELSE b0 END AS b1 FROM q6),
q8 AS (SELECT *, least(b1, CASE WHEN idea > 0 AND exact < 50 AND ortho < 50 AND heard < 50 THEN 44.0 END, CASE WHEN em >= 1 OR noisy
  OR alone OR surface THEN 55.0 END) AS b2 FROM q7),
q9 AS (SELECT *, greatest(b2 - CASE WHEN noisy THEN 25.0 WHEN signal < 0.25 AND edit < 80 AND sh = 0 AND d < 0.2 THEN 20.0 ELSE 0.0 END,
  0) AS b3 FROM q8),
q10 AS (SELECT *, CASE WHEN exact >= 95 THEN 100.0 ELSE floor(b3 * 100 + CAST(0.5 AS DOUBLE)) / 100 END AS score FROM q9),
scored AS (SELECT *, CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong' WHEN score >= 45 THEN 'relevant'
  WHEN score >= 25 THEN 'weak' ELSE 'low' END AS risk_band,
  CASE WHEN em >= 1 AND exact < 95 THEN 'low' WHEN exact < 95 AND (alone OR surface) THEN 'low' WHEN score >= 70 THEN 'medium'
  ELSE 'low' END AS confidence FROM q10)"""
