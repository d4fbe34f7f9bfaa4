"""The core's queries in SQL, over whole tables, where SQL can express them."""

from __future__ import annotations

from functools import reduce

from markloom.functions.lexicons import (
    FUNCTION_WORDS,
    LAST_CAP,
    LEGAL_FORMS,
    LOCALE_PATTERNS,
    LOCALE_SCRIPTS,
    RELATED_CLASSES,
    SENTENCES,
    SOURCE_STATUSES,
    STAGE_WEIGHTS,
    STATUS_GROUPS,
    STRATEGY_CAPS,
    VERSIONS,
    WEAK_WORDS,
)

from markloom.plans import sql_pairs as P
from markloom.plans import sql_texts as X

R = "trademark_normalized_representation"
B = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _sub(x: str, *steps: tuple[str, str]) -> str:
    return reduce(lambda acc, s: f"regexp_replace({acc}, '{s[0]}', '{s[1]}', 'g')", steps, x)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def _fold_blanks(x: str) -> str:
    return _trim(_sub(x, (f"{B}+", " ")))


def _in(words: list) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _cap(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {k} THEN {v}" for k, v in STRATEGY_CAPS) + f" ELSE {LAST_CAP} END"


def _grams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_transform(generate_series(1, length({x}) - {n - 1}), lambda i: substring({x}, i, {n})) ELSE [] END"


PUNCT = _sub("lower(concat_ws(' ', p_name, p_type, p_brand))", (r"[\p{P}\p{S}]+", " "))
SHORT = _sub(f"regexp_replace(ws, '^(\\S.*?)(?: (?:{'|'.join(LEGAL_FORMS)}))+$', '\\1')", (r"[^\p{L}\p{N}]+", ""))
WHOLE = _sub("ws", (r"[^\p{L}\p{N}]+", ""))

FOLD_PARTS = f"""
WITH f AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS low, {PUNCT} AS pf, {_fold_blanks(PUNCT)} AS ws FROM part)
SELECT p_partkey, pf AS punctuation_folded, ws AS whitespace_folded, {_sub("low", (r"[^\x00-\x7F]", ""))} AS ascii_folded,
       CASE WHEN length({SHORT}) < 2 AND length({WHOLE}) >= 2 THEN {WHOLE} ELSE {SHORT} END AS compact FROM f
"""

_SCRIPT_CLASSES = {
    "Latn": "Latin",
    "Cyrl": "Cyrillic",
    "Grek": "Greek",
    "Arab": "Arabic",
    "Hebr": "Hebrew",
    "Deva": "Devanagari",
    "Hani": "Han",
}
_FOUND = ", ".join(f"CASE WHEN regexp_matches(mark_text, '\\p{{{c}}}') THEN '{s}' END" for s, c in _SCRIPT_CLASSES.items())
DETECT_SCRIPTS = f"""
SELECT id, coalesce(nullif(concat_ws(',', {_FOUND}, CASE WHEN regexp_matches(mark_text, '[\\p{{Common}}\\p{{Inherited}}]') THEN 'Zyyy' END),
  ''), 'Zyyy') AS scripts
FROM (SELECT DISTINCT id, mark_text FROM trademark)
"""

COMPACT_NGRAMS = f"""
SELECT trademark_id, array_to_string({_grams("compact", 2)}, ',') AS bigrams, array_to_string({_grams("compact", 3)}, ',') AS trigrams,
       concat_ws(',', {", ".join(f"CASE WHEN length(compact) >= {n} THEN left(compact, {n}) END" for n in (2, 3, 4))}) AS prefixes,
       concat_ws(',', {", ".join(f"CASE WHEN length(compact) >= {n} THEN right(compact, {n}) END" for n in (2, 3, 4))}) AS suffixes
FROM (SELECT DISTINCT trademark_id, compact FROM {R})
"""

NAME_PAIRS = """
n AS (SELECT DISTINCT h.scan_id, h.mark_text FROM retrieval_hit h WHERE mark_text IS NOT NULL),
pairs AS (SELECT DISTINCT r.input_text AS a0, n.mark_text AS b0 FROM n JOIN (SELECT DISTINCT scan_id, input_text FROM scan_run
  WHERE input_text IS NOT NULL) r USING (scan_id))"""

GRAM_SIMILARITY = f"""
WITH {NAME_PAIRS}, g AS (SELECT a0 AS a, b0 AS b, list_distinct({_grams("a0", 3)}) AS x, list_distinct({_grams("b0", 3)}) AS y FROM pairs),
c AS (SELECT a, b, len(list_intersect(x, y)) AS s, len(x) + len(y) AS n FROM g)
SELECT a, b, round(CASE WHEN n > 0 THEN 2.0 * s / n ELSE 1.0 END, 6) AS dice, round(CASE WHEN n > 0 THEN s / CAST(n - s AS DOUBLE)
  ELSE 1.0 END, 6) AS jaccard FROM c
"""

# The distances of this engine are of bytes, so each pair is spelled in an alphabet of its own of one byte a character.
_LETTERS = "regexp_extract_all({}, '(?s).')"


def _spelled(x: str) -> str:
    return f"array_to_string(list_transform({_LETTERS.format(x)}, lambda c: chr(CAST(32 + list_position(l, c) AS INT))), '')"


EDIT_DISTANCES = f"""
WITH {NAME_PAIRS}, k AS (SELECT a0, b0, list_distinct({_LETTERS.format("a0 || b0")}) AS l FROM pairs),
p AS (SELECT a0, b0, {_spelled("a0")} AS a, {_spelled("b0")} AS b FROM k),
d AS (SELECT *, levenshtein(a, b) AS levenshtein, damerau_levenshtein(a, b) AS damerau, greatest(length(a), length(b)) AS n FROM p)
SELECT a0 AS a, b0 AS b, levenshtein, damerau, round(CASE WHEN n > 0 THEN 1 - levenshtein / CAST(n AS DOUBLE) ELSE 1.0 END,
  6) AS similarity FROM d
"""

_LOW_PAIRS = f"{NAME_PAIRS}, low AS (SELECT a0, b0, lower(a0) AS a, lower(b0) AS b FROM pairs)"
JARO = f"""
WITH RECURSIVE {_LOW_PAIRS}, {P.metrics("low", "nl")}
SELECT a0 AS a, b0 AS b, round(jaro, 6) AS jaro, round(jw, 6) AS jaro_winkler, round(CASE WHEN greatest(na,
  nb) > 0 THEN lcs / CAST(greatest(na, nb) AS DOUBLE) ELSE 1.0 END, 6) AS lcs_similarity
FROM low JOIN metrics USING (a, b)
"""
WEIGHTED = f"""
WITH RECURSIVE {NAME_PAIRS}, given AS (SELECT a0 AS a, b0 AS b FROM pairs), {P.metrics("given", "nl")}
SELECT a, b, round(cost, 6) AS raw_cost, round(similarity, 6) AS similarity FROM metrics
"""
PLAIN_SCORES = f"""
WITH RECURSIVE {NAME_PAIRS}, {X.CAPITALS}, sides AS (SELECT a0 AS x FROM pairs UNION SELECT b0 FROM pairs),
  {X.spelled("sides", "x", "capitals", "big")},
up AS (SELECT a0, b0, upper({_fold_blanks("coalesce(p.s, '')")}) AS a, upper({_fold_blanks("coalesce(q.s, '')")}) AS b FROM pairs LEFT
  JOIN big p ON p.x = a0 LEFT JOIN big q ON q.x = b0), {P.metrics("up", "nl")},
c AS (SELECT a0, b0, CAST(a <> '' AND a = b AS INT) AS exact, CASE WHEN greatest(na, nb) > 0 THEN 1 - levenshtein / CAST(greatest(na,
  nb) AS DOUBLE) ELSE 1.0 END AS lev, jaro, jw FROM up JOIN metrics USING (a, b)),
d AS (SELECT *, CASE WHEN exact = 1 THEN 1.0
  ELSE lev * CAST(0.35 AS DOUBLE) + jaro * CAST(0.25 AS DOUBLE) + jw * CAST(0.4 AS DOUBLE) END AS c FROM c)
SELECT a0 AS a, b0 AS b, exact, round(lev, 4) AS levenshtein, round(jaro, 4) AS jaro, round(jw, 4) AS jaro_winkler, round(c, 4) AS combined,
  CASE WHEN c >= 0.95 THEN 'critical' WHEN c >= 0.85 THEN 'strong' WHEN c >= 0.7 THEN 'relevant' WHEN c >= 0.55 THEN 'borderline'
  WHEN c >= 0.35 THEN 'weak' ELSE 'irrelevant' END AS band FROM d
"""

_ROLE = f"""CASE WHEN word = '' THEN 'unknown' WHEN regexp_full_match(word, '\\p{{N}}+') THEN 'numeral'
  WHEN word IN ({_in(LEGAL_FORMS)}) THEN 'legal_form'
 WHEN word IN ({_in(FUNCTION_WORDS)}) THEN 'function_word' WHEN word IN ({_in(WEAK_WORDS)}) THEN 'descriptive_weak'
  WHEN regexp_matches(word, '\\p{{L}}') THEN 'distinctive' ELSE 'unknown' END"""
TOKEN_ROLES = f"""
SELECT word, {_ROLE} AS role FROM (SELECT DISTINCT lower({_trim("t")}) AS word FROM (SELECT unnest(tokens) AS t FROM {R})
  WHERE t IS NOT NULL)
"""

_CLASS = {"SCRIPT_CYRL": "Cyrillic", "SCRIPT_GREK": "Greek", "SCRIPT_LATN": "Latin", "SCRIPT_HANS": "Han", "SCRIPT_ARAB": "Arabic"}
_HINTS = [
    (loc, code, f"\\p{{{_CLASS[code]}}}") for loc, code, _, _ in LOCALE_SCRIPTS
] + [(loc, code, f"(?i){r}") for loc, code, r in LOCALE_PATTERNS]


def _evidence(locale: str) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN regexp_matches(mark_text, '{r}') THEN '{code}' END" for loc, code, r in _HINTS if loc == locale
    ) + ")"


_LOCALES = list(dict.fromkeys(loc for loc, _, _ in _HINTS))
_PROBABILITY = "CASE WHEN locale IN ('nl', 'de', 'fr') THEN 0.72 WHEN locale = 'und-x-phonetic' THEN 0.55 WHEN evidence = 'FALLBACK_UNKNOWN' THEN 0.25 ELSE 0.35 END"
_SEEN = f"""texts AS (SELECT DISTINCT mark_text FROM trademark WHERE mark_text IS NOT NULL),
every AS ({" UNION ALL ".join(f"SELECT mark_text, {i} AS i, '{loc}' AS locale, {_evidence(loc)} AS evidence FROM texts" for i, loc in enumerate(_LOCALES))}),
found AS (SELECT * FROM every WHERE evidence <> ''),
whole AS (SELECT * FROM found UNION ALL SELECT mark_text, 0, 'und', 'FALLBACK_UNKNOWN' FROM texts WHERE mark_text NOT IN (SELECT mark_text
  FROM found)),
placed AS (SELECT mark_text, CAST(row_number() OVER (PARTITION BY mark_text ORDER BY {_PROBABILITY} DESC, i) - 1 AS INT) AS place, locale,
  CAST({_PROBABILITY} AS DOUBLE) AS probability, evidence FROM whole)"""
LANGUAGES = f"WITH {_SEEN} SELECT * FROM placed"
EXPLICIT = f"""
WITH {_SEEN}, m AS (SELECT DISTINCT mark_text, source_languages AS g FROM trademark WHERE mark_text IS NOT NULL),
h AS (SELECT mark_text, string_agg(locale || ':' || replace(evidence, ',', ':'), '|' ORDER BY place) AS h FROM placed GROUP BY mark_text),
e AS (SELECT mark_text, g, list_filter(list_transform(generate_series(1, len(g)), lambda i: CASE WHEN list_position(g,
  g[i]) = i THEN g[i] END), lambda x: x IS NOT NULL) AS d FROM m)
SELECT e.mark_text, array_to_string(list_transform(g, lambda x: coalesce(x, '?')), ',') AS given,
  CASE WHEN len(g) > 0 THEN array_to_string(list_transform(d, lambda x: x || ':EXPLICIT_LOCALE'), '|') ELSE h END AS hypotheses FROM e
  JOIN h USING (mark_text)
"""

TOKEN_CORES = f"""
WITH t AS (SELECT row_number() OVER () AS r, trademark_id, tokens FROM (SELECT DISTINCT trademark_id, tokens FROM {R}
  WHERE tokens IS NOT NULL)),
u AS (SELECT r, i, {_sub("lower(tokens[i])", (r"[^\p{L}\p{N}]+", ""))} AS w FROM (SELECT r, tokens, unnest(generate_series(1,
  len(tokens))) AS i FROM t)),
k AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY r) AS n, {X.role("w")} AS role
  FROM u WHERE w <> ''),
g AS (SELECT r, string_agg(w, ',' ORDER BY idx) FILTER (role IN ('distinctive', 'unknown')) AS significant,
  string_agg(w, ',' ORDER BY idx) FILTER (role IN ('descriptive_weak', 'legal_form', 'function_word', 'numeral')) AS noise,
  string_agg(w, '' ORDER BY idx) FILTER (role IN ('distinctive', 'unknown')) AS core, count(*) FILTER (role IN ('distinctive',
  'unknown')) AS ns FROM k GROUP BY r),
s AS (SELECT r, w, idx, n, CASE WHEN role = 'distinctive' THEN CAST(1 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS x FROM k
  WHERE role IN ('distinctive', 'unknown')),
v AS (SELECT r, w, idx, length(w) * 3 * x + (n - idx) * CAST(0.35 AS DOUBLE) * x - CASE WHEN length(w) <= 3 THEN 5 * x ELSE 0 END AS weight
  FROM s),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY r ORDER BY weight DESC, idx) <= 5),
d AS (SELECT r, string_agg(w, ',' ORDER BY weight DESC, idx) AS dominant, string_agg(printf('%.4f', weight), ',' ORDER BY weight DESC,
  idx) AS weights FROM b GROUP BY r),
q AS (SELECT g.r, g.core AS w, -1 AS idx FROM g WHERE length(core) >= 2 UNION ALL SELECT s.r, s.w, s.idx FROM s JOIN g USING (r)
  WHERE length(s.w) >= CASE WHEN g.ns >= 2 THEN 6 ELSE 3 END),
f AS (SELECT r, w, min(idx) AS idx FROM q GROUP BY r, w), c AS (SELECT r, string_agg(w, ',' ORDER BY idx) AS core_keys FROM f GROUP BY r)
SELECT DISTINCT t.trademark_id, coalesce(significant, '') AS significant, coalesce(noise, '') AS noise, coalesce(dominant, '') AS dominant,
  coalesce(weights, '') AS weights, coalesce(core, '') AS core_compact, coalesce(core_keys, '') AS core_keys
FROM t LEFT JOIN g USING (r) LEFT JOIN d USING (r) LEFT JOIN c USING (r)
"""

_W = _sub("upper(t)", ("[^A-Z]", ""))
_HEAD = "CASE WHEN w LIKE 'MAC%' THEN 'MCC' || substring(w, 4) WHEN w LIKE 'KN%' THEN 'NN' || substring(w, 3) WHEN w LIKE 'K%' THEN 'C' || substring(w, 2) WHEN w LIKE 'PH%' OR w LIKE 'PF%' THEN 'FF' || substring(w, 3) WHEN w LIKE 'SCH%' THEN 'SSS' || substring(w, 4) ELSE w END"
_BODY = _sub(
    "translate(" + _sub(_HEAD, ("EV", "AF"), ("[AEIOU]", "A")) + ", 'QZM', 'GSN')",
    ("KN", "N"),
    ("K", "C"),
    ("PH", "F"),
    ("SH", "S"),
    ("TH", "T"),
    ("(DT|RT|RD|NT)$", "D"),
)
_ONCE = _sub("left(body, 1) || " + _sub("substring(body, 2)", ("A", "")), *[(f"{c}+", c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
_NYSIIS = _sub("once", ("S$", ""), ("AY$", "Y"), ("A$", ""))


def _nysiis(source: str) -> str:
    """CTEs from a table with t to s(t, w, nysiis)."""
    return f"w0 AS (SELECT t, {_W} AS w FROM {source}), w1 AS (SELECT t, w, {_BODY} AS body FROM w0), w2 AS (SELECT t, w, {_ONCE} AS once FROM w1), s AS (SELECT t, w, {_NYSIIS} AS nysiis FROM w2)"


_SECOND = "upper(translate(" + _sub("w", ("CH|SH", "x"), ("PH", "f"), ("DG", "j"), ("^[AEIOU]", "a"), ("[AEIOU]", "")) + ", 'CGZ', 'KKS'))"
_COLOGNE = _sub(
    "translate(" + _sub(
        "w",
        ("C([AHKLOUQX])", "4\\1"),
        ("C", "8"),
        ("X", "48"),
        ("H", ""),
    ) + ", 'DTZPGQYAEIOUBFVWJKSLMNR', '88834410000013334445667')",
    *[(f"{d}+", str(d)) for d in range(9)],
    ("0+$", ""),
)
_DUTCH = _sub(
    "lower(t)",
    ("[^a-z]", ""),
    ("ij", "y"),
    ("ph", "f"),
    ("oe", "u"),
    ("eu", "u"),
    ("ui", "uy"),
    ("ch", "g"),
    ("z", "s"),
    ("[aeiouy]", ""),
)
SOUND_CODES = f"""
WITH src AS (SELECT DISTINCT ascii_folded AS t FROM {R} WHERE ascii_folded IS NOT NULL), {_nysiis("src")}
SELECT t, CASE WHEN w = '' THEN '' ELSE left(rpad({_SECOND}, 200, '0'), 4) END AS second_key, nysiis, {_COLOGNE} AS cologne,
  {_DUTCH} AS dutch,
       {_sub("lower(t)", ("[^b-df-hj-np-tv-xz]", ""))} AS skeleton, translate({_sub("lower(t)", ("[^a-z]", ""))}, 'y', 'i') AS phonemes
  FROM s
"""

_SPOKEN_KEY = f"CASE WHEN w = '' THEN '' ELSE left(rpad({_SECOND}, 200, '0'), 4) END"

#: From forms, cores and variants: said(t, spoken, latin, core) with the form that is spoken and the Latin one.
SAID = f"""s0 AS (SELECT forms.*, core, sig, {_sub("lower(v[1])", (X.ALNUM, ""))} AS first FROM forms JOIN cores USING (t)
  JOIN variants USING (t)),
said AS (SELECT *, CASE WHEN core <> '' AND regexp_full_match(core, '[\\p{{Latin}}\\p{{N}}]*') THEN core WHEN first <> '' THEN first
  WHEN dia <> '' THEN dia ELSE compact END AS spoken,
  CASE WHEN first = '' OR (length(first) < length(compact) AND contains(compact, first)) THEN compact ELSE first END AS latin FROM s0)"""
DERIVED = f"""{X.WORDS},
{X.VARIANTS},
{SAID},
{X.sound_keys("said", "spoken")},
second AS (SELECT spoken, {_SPOKEN_KEY} AS key2 FROM (SELECT DISTINCT spoken, {_sub("upper(spoken)", ("[^A-Z]", ""))} AS w FROM said))"""

_MARKS = "marks_in AS (SELECT DISTINCT id, mark_text FROM trademark)"
REPRESENT = f"""
WITH RECURSIVE {_MARKS}, {X.forms("marks_in", "mark_text")}, {DERIVED}
SELECT m.id, nfc_normalize(m.mark_text) AS unicode_nfc, s.nfkc AS unicode_nfkc, {_sub("s.dia", (r"[\p{P}\p{S}]+", " "))} AS punctuation_folded, s.low AS case_folded, s.dia AS diacritics_folded, s.ws AS whitespace_folded, s.ascii AS ascii_folded,
  s.compact,
  c.dominant AS dominant_token, c.core AS core_compact, k.key AS primary_key, z.key2 AS secondary_key,
  {_sub("lower(s.spoken)", ("[^b-df-hj-np-tv-xz]", ""))} AS skeleton,
  d.scripts, array_to_string(c.tokens, ',') AS tokens, array_to_string(c.sig, ',') AS significant_tokens, array_to_string(c.noise,
  ',') AS noise_tokens,
  array_to_string(v.v, '|') AS transliterations
FROM marks_in m LEFT JOIN said s ON s.t = m.mark_text LEFT JOIN cores c ON c.t = m.mark_text LEFT JOIN variants v ON v.t = m.mark_text LEFT
  JOIN keyed k ON k.t = s.spoken
LEFT JOIN second z ON z.spoken = s.spoken LEFT JOIN ({DETECT_SCRIPTS}) d ON d.id = m.id
"""
_ONCE = "list_filter({0}, lambda x, i: x <> '' AND list_position({0}, x) = i)"
_FOLDS = ", ".join(["compact", *[_sub(c, (X.ALNUM, "")) for c in ("low", "dia", "ascii")]])
LOOKUP_KEYS = f"""
WITH {X.forms("scan_run", "input_text")}, {X.WORDS}, {X.VARIANTS},
a AS (SELECT f.t, compact, dia, [{_FOLDS}] AS folds, list_transform(v, lambda x: {_sub("lower(x)", (X.ALNUM, ""))}) AS tk,
  CASE WHEN length(core) >= 2 THEN [core] ELSE [] END || list_filter(sig, lambda w: length(w) >= CASE WHEN len(sig) >= 2 THEN 6 ELSE 3 END) AS ck
  FROM forms f JOIN cores USING (t) JOIN variants USING (t)),
b AS (SELECT t, compact, dia, folds, {_ONCE.format("tk")} AS tk, {_ONCE.format("ck")} AS ck FROM a),
c AS (SELECT *, folds || ck AS e0 FROM b), d AS (SELECT *, {_ONCE.format("e0")} AS e FROM c),
f AS (SELECT *, list_filter(tk, lambda x: NOT list_contains(e, x)) AS tr FROM d),
g AS (SELECT *, CASE WHEN len(tr) > 0 THEN tr WHEN compact <> '' THEN [compact] ELSE [] END AS fg,
  [coalesce(list_filter(tk, lambda x: x <> compact)[1], CASE WHEN dia <> '' THEN dia ELSE compact END)] || ck AS s0 FROM f)
SELECT t AS mark_text, array_to_string(e, ',') AS exact_keys, array_to_string(tr, ',') AS translit_keys, array_to_string(fg, ',') AS full_grams,
  array_to_string(list_filter(ck, lambda x: NOT list_contains(fg, x)), ',') AS core_grams, array_to_string({_ONCE.format("s0")}, ',') AS spoken,
  CAST({_cap("length(compact)")} AS BIGINT) AS cap FROM g
"""
TRANSLITERATIONS = f"""
WITH {X.forms("trademark", "mark_text")}, {X.VARIANTS}
SELECT mark_text, array_to_string(v, '|') AS variants FROM (SELECT DISTINCT mark_text FROM trademark) LEFT JOIN variants ON t = mark_text
"""
HYPOTHESES = f"""
WITH {_MARKS}, {X.forms("marks_in", "mark_text")}, {X.WORDS}, {X.split_hypotheses()}
SELECT id, tokens, merged, reason FROM marks_in JOIN hypos ON t = mark_text
"""


def _sounds(source: str) -> str:
    """CTEs from a table of (id, t) to sounds(id, algorithm, key), without the sentinel."""
    return f"""spoken AS (SELECT DISTINCT id, {_sub("lower(t)", (X.ALNUM, ""))} AS t FROM {source}), {X.sound_keys("spoken")},
  {_nysiis("(SELECT DISTINCT t FROM spoken WHERE t IS NOT NULL)")},
sounds AS (SELECT DISTINCT id, algorithm, key FROM (
  SELECT id, 'double_metaphone' AS algorithm, key FROM spoken JOIN keyed USING (t)
  UNION ALL SELECT id, 'double_metaphone', {_SPOKEN_KEY} FROM spoken JOIN s USING (t) UNION ALL SELECT id, 'nysiis', nysiis FROM spoken
  JOIN s USING (t)) WHERE key <> '')"""


PHONETIC_KEYS = f"""
WITH RECURSIVE given AS (SELECT DISTINCT trademark_id AS id, coalesce(nullif(diacritics_folded, ''), compact) AS t FROM {R}),
  {_sounds("given")}
SELECT id AS trademark_id, 'und' AS locale, algorithm, key FROM sounds
UNION ALL SELECT DISTINCT id, 'und', 'unencodable', '_' FROM spoken g WHERE NOT EXISTS (SELECT 1 FROM keyed k JOIN s USING (t)
  WHERE k.t = g.t AND k.key <> '')
"""

_GROUP = "CASE " + " ".join(f"WHEN s IN ({_in(c)}) THEN '{n}'" for n, c in STATUS_GROUPS.items()) + " ELSE 'unknown' END"
STATUS_SQL = f"SELECT status_code, {_GROUP} AS normalized, coalesce(s IN ({_in(SOURCE_STATUSES)}), false) AS allowed FROM (SELECT DISTINCT status_code, upper({_trim('status_code')}) AS s FROM trademark)"

def _day(x: str) -> str:
    return f"strftime(CAST({x} AS TIMESTAMP), '%Y-%m-%d')"


READ = f"""
WITH r AS (SELECT DISTINCT source_record_id, mark_text, status_code, nice_classes, {_day("filing_date")} AS f, {_day("registration_date")} AS g FROM trademark)
SELECT source_record_id AS application_number, mark_text AS mark_name, status_code AS status, array_to_string(nice_classes, ',') AS nice_classes,
  f AS application_date, g AS registration_date, kind FROM r, (VALUES ('parquet'), ('orc'), ('json')) AS k(kind)
"""

SOURCE_HASH = f"""sha256(CAST(to_json({{'application_date': {_day("filing_date")}, 'mark_name': coalesce(mark_text, ''),
  'nice_classes': list_sort(coalesce(nice_classes, [])),
  'registration_date': {_day("registration_date")}, 'status': coalesce(status_code, 'unknown')}}) AS VARCHAR))"""
SOURCE_HASHES = f"SELECT DISTINCT source_record_id AS application_number, {SOURCE_HASH} AS hash FROM trademark"

INTAKE = f"""
SELECT DISTINCT 'corpus:' || source_record_id AS id, coalesce(mark_text, '') AS mark_text, {_GROUP} AS normalized_status,
  length({_trim("coalesce(mark_text, '')")}) > 0 AS is_text_searchable,
       coalesce(len(nice_classes), 0) AS goods, {_day("filing_date")} AS filing_date
FROM (SELECT *, upper({_trim("status_code")}) AS s FROM trademark) WHERE s IN ({_in(SOURCE_STATUSES)})
"""

DELIVERIES = """
d AS (SELECT id, lower(source_hash) AS hash, mapped_at, created_at, mapped_at < TIMESTAMPTZ '2026-02-01 00:00:00+00' AS old FROM trademark
  WHERE mapped_at IS NOT NULL AND id IS NOT NULL),
l AS (SELECT id, hash, old FROM d QUALIFY row_number() OVER (PARTITION BY id, old ORDER BY mapped_at DESC, created_at DESC NULLS LAST,
  hash DESC NULLS LAST) = 1),
o AS (SELECT id, hash FROM l WHERE old), n AS (SELECT id, hash FROM l WHERE NOT old)"""
DELIVERY_ACTIONS = f"WITH {DELIVERIES} SELECT n.id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.hash IS NOT DISTINCT FROM o.hash THEN 'unchanged' ELSE 'update' END AS action FROM n LEFT JOIN o ON n.id = o.id"
AFTER_UPSERT = f"WITH {DELIVERIES} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.hash ELSE n.hash END AS hash FROM n FULL JOIN o ON n.id = o.id"

_KEPT = f"SELECT * FROM trademark WHERE status_code IN ({_in(SOURCE_STATUSES)})"
PURGE = f"""
WITH k AS ({_KEPT})
SELECT 'trademark' AS part, id, count(*) AS rows FROM k GROUP BY id
UNION ALL SELECT 'representation', trademark_id, count(*) FROM {R} WHERE trademark_id IN (SELECT id FROM k) GROUP BY trademark_id
"""
INTAKE_LOG = f"""
WITH s AS (SELECT *, mapped_at < TIMESTAMPTZ '2026-02-01 00:00:00+00' AS old,
  upper({_trim("status_code")}) IN ({_in(SOURCE_STATUSES)}) AS ok
  FROM trademark WHERE mapped_at IS NOT NULL),
h AS (SELECT *, {SOURCE_HASH} AS hash FROM s),
l AS (SELECT source_record_id AS id, old, hash FROM h WHERE ok QUALIFY row_number() OVER (PARTITION BY source_record_id,
  old ORDER BY mapped_at DESC, created_at DESC NULLS LAST, hash DESC) = 1),
n AS (SELECT c.hash, o.hash AS was FROM (SELECT * FROM l WHERE NOT old) c LEFT JOIN (SELECT * FROM l WHERE old) o USING (id))
SELECT 'batch-1' AS run, count(*) AS read, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT coalesce(ok, false)) AS refused,
  (SELECT count(*) FROM l WHERE old) AS inserted, 0 AS updated, 0 AS unchanged FROM s WHERE old
UNION ALL SELECT 'batch-2', count(*), count(*) FILTER (ok), count(*) FILTER (NOT coalesce(ok, false)), (SELECT count(*) FROM n
  WHERE was IS NULL), (SELECT count(*) FROM n WHERE was <> hash), (SELECT count(*) FROM n WHERE was = hash) FROM s WHERE NOT old
"""
BACKFILL = f"SELECT DISTINCT trademark_id FROM {R} r WHERE NOT EXISTS (SELECT 1 FROM {R} k WHERE k.trademark_id = r.trademark_id AND len(k.consonant_skeletons) > 0 AND k.normalization_version < '1.0.3')"
TO_PREPROCESS = f"SELECT DISTINCT id FROM trademark t WHERE is_text_searchable AND NOT EXISTS (SELECT 1 FROM {R} r WHERE r.trademark_id = t.id)"

LATEST = """
latest AS (SELECT * FROM trademark WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC NULLS LAST,
  created_at DESC NULLS LAST, source_hash DESC NULLS LAST, mark_text DESC NULLS LAST, status_code DESC NULLS LAST,
  normalized_status DESC NULLS LAST) = 1)"""
FOLDED = f"""{LATEST},
folds AS (SELECT trademark_id AS id, compact, case_folded, diacritics_folded, ascii_folded
  FROM {R} QUALIFY row_number() OVER (PARTITION BY trademark_id ORDER BY normalization_version DESC, created_at DESC NULLS LAST,
  compact DESC NULLS LAST, case_folded DESC NULLS LAST, diacritics_folded DESC NULLS LAST, ascii_folded DESC NULLS LAST) = 1),
marks AS (SELECT f.*, l.mark_text FROM folds f JOIN latest l USING (id) WHERE l.is_text_searchable),
w AS (SELECT watch_id AS query_id, {_sub(X.lowered("watch_text"), (X.ALNUM, ""))} AS key FROM watch_name),
asked AS (SELECT query_id, key, {_cap("length(key)")} AS cap FROM w)"""
SCANNED = FOLDED.replace(
    "SELECT watch_id AS query_id",
    "SELECT DISTINCT scan_id AS query_id",
).replace("watch_text", "input_text").replace("FROM watch_name", "FROM scan_run WHERE input_text IS NOT NULL")

RETRIEVE_EXACT = f"""
WITH {SCANNED}, keys AS (SELECT DISTINCT id, mark_text, unnest([compact, case_folded, diacritics_folded, ascii_folded]) AS key FROM marks),
hits AS (SELECT DISTINCT query_id, id, mark_text, cap FROM asked JOIN keys USING (key) WHERE key <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mark_text, id) AS rank, count(*) OVER (PARTITION BY query_id) AS pre_cap
  FROM hits)
SELECT query_id, id, rank, pre_cap FROM r WHERE rank <= cap
"""

def _padded(x: str) -> str:
    return "list_distinct(" + _grams(f"('  ' || {x} || ' ')", 3) + ")"


TRIGRAM_PAIRS = f"""{FOLDED}, ms AS (SELECT id, {_padded("compact")} AS g FROM marks WHERE compact <> ''), mg AS (SELECT id, len(g) AS n,
  unnest(g) AS gram FROM ms),
qs AS (SELECT query_id, cap, {_padded("key")} AS g FROM asked WHERE key <> ''), qg AS (SELECT query_id, cap, len(g) AS m, unnest(g) AS gram
  FROM qs),
shared AS (SELECT query_id, id, cap, any_value(n) AS n, any_value(m) AS m, count(*) AS c FROM mg JOIN qg USING (gram) GROUP BY query_id, id,
  cap)"""
RETRIEVE_TRIGRAM = f"""
WITH {TRIGRAM_PAIRS}, hits AS (SELECT query_id, id, cap, round(CAST(c AS DOUBLE) / (n + m - c), 6) AS score FROM shared
  WHERE CAST(c AS DOUBLE) / (n + m - c) >= CAST(0.3 AS DOUBLE)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS pre_cap
  FROM hits)
SELECT query_id, id, score, rank, pre_cap FROM r WHERE rank <= cap
"""


def _share(least: float) -> str:
    return f"WITH {TRIGRAM_PAIRS} SELECT query_id, id, round(CAST(c AS DOUBLE) / m, 6) AS score FROM shared WHERE CAST(c AS DOUBLE) / m >= CAST({least} AS DOUBLE)"



RETRIEVE_NYSIIS = f"""
WITH {SCANNED}, src AS (SELECT DISTINCT t FROM (SELECT ascii_folded AS t FROM marks UNION ALL SELECT key FROM asked) WHERE t IS NOT NULL),
  {_nysiis("src")}
SELECT DISTINCT query_id, id FROM asked a JOIN s sa ON sa.t = a.key JOIN s sm ON sm.nysiis = sa.nysiis
  JOIN marks m ON m.ascii_folded = sm.t WHERE sa.nysiis <> ''
"""

RETRIEVE_PHONETIC = f"""
WITH RECURSIVE {FOLDED}, given AS (SELECT 'm' || id AS id, coalesce(nullif(diacritics_folded, ''), compact) AS t FROM marks
  UNION ALL SELECT 'q' || query_id, key FROM asked), {_sounds("given")},
met AS (SELECT DISTINCT a.query_id, a.cap, m.id, m.mark_text FROM asked a JOIN sounds q ON q.id = 'q' || a.query_id
  JOIN sounds c ON c.key = q.key JOIN marks m ON 'm' || m.id = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mark_text, id) AS rank, count(*) OVER (PARTITION BY query_id) AS pre_cap
  FROM met)
SELECT query_id, id, rank, pre_cap FROM r WHERE rank <= cap
"""
PREPROCESS = f"""
WITH {LATEST}, able AS (SELECT id, mark_text FROM latest WHERE is_text_searchable), {X.forms("able", "mark_text")}, {X.WORDS}
SELECT id AS trademark_id, compact, array_to_string(tokens, ',') AS tokens, array_to_string(sig, ',') AS significant_tokens,
  array_to_string(weak, ',') AS descriptive_tokens,
  array_to_string({_grams("compact", 3)}, ',') AS trigrams, dominant AS dominant_token,
  '{VERSIONS["normalization"]}' AS normalization_version
FROM able LEFT JOIN forms ON forms.t = mark_text LEFT JOIN cores ON cores.t = mark_text
"""

HITS = """
h AS (SELECT scan_id AS query_id, trademark_id AS id, strategy, max(score) AS score FROM retrieval_hit
      WHERE trademark_id IS NOT NULL AND scan_id IS NOT NULL AND strategy IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id,
  strategy) AS pre_cap FROM h)"""
CAP = f"WITH {HITS} SELECT query_id, strategy, count(*) AS kept, max(pre_cap) AS pre_cap, max(pre_cap) > 100 AS cap_reached FROM r WHERE rank <= 100 GROUP BY ALL"
UNITE = f"WITH {HITS} SELECT query_id, id, count(*) AS evidence, string_agg(strategy, ',' ORDER BY rank, strategy) AS strategies, min(rank) AS best_rank FROM r WHERE rank <= 100 GROUP BY ALL"
RESERVE = f"""
WITH {HITS}, core AS (SELECT query_id, id, score, CASE WHEN rank <= 10 THEN 0 ELSE 2 END AS k FROM r WHERE strategy = 'phonetic'),
a AS (SELECT * FROM core UNION ALL SELECT query_id, id, score, 1 FROM r WHERE strategy = 'trigram'),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY k, score DESC) = 1)
SELECT query_id, id, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k, score DESC, id) <= 25
"""
FETCH = f"WITH {LATEST} SELECT id, mark_text FROM latest WHERE is_text_searchable AND id IN (SELECT trademark_id FROM retrieval_hit)"
READY = f"""
WITH {LATEST}, c AS (SELECT count(*) AS searchable, count(*) FILTER (id IN (SELECT trademark_id FROM {R})) AS normalized FROM latest
  WHERE is_text_searchable)
SELECT searchable, normalized, searchable > 0 AND normalized > 0 AS ready, CASE WHEN searchable = 0 THEN 'corpus_empty'
  WHEN normalized = 0 THEN 'corpus_not_preprocessed' END AS reason FROM c
"""
NAMES = f"""
WITH r AS (SELECT DISTINCT scan_id, input_text FROM scan_run WHERE input_text IS NOT NULL), l AS (SELECT scan_id,
  list_filter(list_transform(string_split(input_text, ','), lambda x: {_trim("x")}), lambda x: x <> '') AS n FROM r),
u AS (SELECT scan_id, unnest(n) AS name, unnest(generate_series(1, len(n))) AS i FROM l), f AS (SELECT scan_id, name, i
  FROM u QUALIFY row_number() OVER (PARTITION BY scan_id, lower(name) ORDER BY i) = 1)
SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY i) - 1 AS INT) AS place, name
  FROM f QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY i) <= 10
"""

_REL = ", ".join(f"{x * 100 + y}, {y * 100 + x}" for x, y in RELATED_CLASSES)
CLASSES = f"""
WITH f AS (SELECT id, nice_classes AS c FROM trademark QUALIFY row_number() OVER (PARTITION BY id ORDER BY mapped_at NULLS FIRST,
  created_at NULLS FIRST, source_hash NULLS FIRST, nice_classes NULLS FIRST) = 1),
l AS (SELECT id, nice_classes AS c FROM trademark QUALIFY row_number() OVER (PARTITION BY id ORDER BY mapped_at DESC NULLS LAST,
  created_at DESC NULLS LAST, source_hash DESC NULLS LAST, nice_classes DESC NULLS LAST) = 1),
p AS (SELECT f.id, list_distinct(coalesce(f.c, [])) AS a, list_distinct(coalesce(l.c, [])) AS b FROM f JOIN l USING (id)),
u AS (SELECT id, unnest(a) AS x, b FROM p), v AS (SELECT id, x, unnest(b) AS y FROM u),
rel AS (SELECT id, count(*) FILTER (x <> y AND x * 100 + y IN ({_REL})) AS hits, count(*) FILTER (x <> y) AS n FROM v GROUP BY id),
o AS (SELECT p.id, len(a) + len(b) AS n, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a,
  b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) ELSE 0.0 END AS ov, CASE
  WHEN rel.n > 0 THEN rel.hits / CAST(rel.n AS DOUBLE) ELSE 0.0 END AS rl FROM p LEFT JOIN rel USING (id))
SELECT id, round(ov, 6) AS class_overlap, round(rl, 6) AS related,
       CASE WHEN n = 0 THEN 'unknown' WHEN ov >= 0.75 THEN 'high' WHEN ov >= 0.5 AND rl >= 0.5 THEN 'medium' WHEN rl >= 0.5 OR ov >= 0.25
  OR ov > 0 OR rl > 0 THEN 'low' ELSE 'none' END AS relationship,
       CASE WHEN ov > 0 THEN 'medium' ELSE 'low' END AS confidence FROM o
"""

_ROUNDED = "lev dam jaro jw wed dice lcs pre suf sig noise second sound plain classes".split()
_WHOLE = "normalized compact folded translit dom shared core key1 key2 bones meaning".split()
PAIR_FEATURES = f"""
WITH RECURSIVE hits AS (SELECT scan_id, mark_text, max(nice_classes) AS c FROM retrieval_hit WHERE mark_text IS NOT NULL GROUP BY ALL),
pairs AS (SELECT input_text AS a, mark_text AS b, [9, 32, 35] AS ca, coalesce(max(c), []) AS cb FROM hits JOIN (SELECT DISTINCT scan_id,
  input_text FROM scan_run WHERE input_text IS NOT NULL) r USING (scan_id) GROUP BY input_text, mark_text),
texts_in AS (SELECT a AS x FROM pairs UNION SELECT b FROM pairs), {X.forms("texts_in", "x")}, {DERIVED}, {P.SIDES}, {P.MEASURED},
  {P.metrics("measured", "en")}, {P.FEATURES}, {P.SCORED},
coded AS (SELECT *, {P.CODES} AS codes FROM scored)
SELECT a, b, {", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)}, {", ".join(_WHOLE)}, CAST(em AS DOUBLE) AS bare, score, risk_band,
  confidence, array_to_string(codes, ',') AS evidence,
  {P.sentences("codes", "a", "b", "nl")} AS explanations
FROM coded
"""
_GOODS = r"list_distinct(list_filter(string_split_regex(regexp_replace(strip_accents(lower(array_to_string({}, chr(1)))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2))"
_KNOWN = "ta IS NOT NULL AND tb IS NOT NULL"
GOODS = f"""
WITH own AS (SELECT p_partkey, [p_size, 35] AS c, CASE WHEN p_partkey % 7 > 0 THEN [concat_ws(' ', p_name, p_type), ' - ',
  'Cafés & more'] END AS t FROM part),
near AS (SELECT p_partkey - CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS k, c, t FROM own),
p AS (SELECT DISTINCT p_partkey, o.c AS ca, CASE WHEN p_partkey % 3 > 0 THEN n.c ELSE [] END AS cb, o.t AS ta, n.t AS tb FROM own o
  JOIN near n ON k = p_partkey),
w AS (SELECT *, coalesce({_GOODS.format("ta")}, []) AS wa, coalesce({_GOODS.format("tb")}, []) AS wb, {P._jaccard("ca", "cb")} AS ov,
  {P.RELATED} AS rl FROM p),
g AS (SELECT *, CASE WHEN {_KNOWN} THEN coalesce({P._jaccard("wa", "wb")}, 1.0) END AS cs, CASE WHEN {_KNOWN} THEN CASE
  WHEN len(wa) > 0 THEN len(list_intersect(wa, wb)) / CAST(len(wa) AS DOUBLE) ELSE 0.0 END END AS cv FROM w)
SELECT p_partkey, round(ov, 6) AS class_overlap, round(rl, 6) AS related_signal, round(cs, 6) AS concrete_similarity, round(cv,
  6) AS coverage,
  CASE WHEN cs >= 0.9 AND ov >= 0.5 THEN 'identical' WHEN ov >= 0.75 OR (ov >= 0.5 AND rl >= 0.5)
      THEN CASE WHEN cs IS NULL THEN CASE WHEN ov >= 0.75 THEN 'high' ELSE 'medium' END WHEN cs >= 0.7 THEN 'high'
  WHEN cs >= 0.4 THEN 'medium' WHEN cs >= 0.15 THEN 'low' ELSE 'none' END
    WHEN rl >= 0.5 OR ov >= 0.25 THEN CASE WHEN cs >= 0.4 THEN 'medium' ELSE 'low' END WHEN ov > 0 OR rl > 0 OR coalesce(cs,
  0) > 0 THEN 'low' ELSE 'none' END AS relationship,
  CASE WHEN cs IS NOT NULL THEN 'high' WHEN ov > 0 THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(',', CASE WHEN ta IS NULL THEN 'missing_proposed_goods_text' END, CASE
  WHEN tb IS NULL THEN 'missing_candidate_goods_text' END) AS warnings FROM g
"""

SCORES = """
WITH c AS (SELECT DISTINCT scan_id, trademark_id, created_at, coalesce(strongest_retrieval_score, 0) * 100 AS edit,
  greatest(coalesce(strongest_retrieval_score, 0), coalesce(orthographic.jaro_winkler_similarity, 0), coalesce(orthographic.trigram_dice,
  0)) * 100 AS wide,
  coalesce(orthographic.trigram_dice, 0) * 100 AS tri, coalesce(token_family.significant_overlap, 0) AS sig,
  coalesce(token_family.shared_rare_token_count, 0) AS shared,
  coalesce(CASE WHEN feature_version = 'features-1' THEN phonetic.pronunciation_similarity ELSE phonetic.pronunciation_similarity / 100 END,
  0) * 100 AS sound
  FROM scan_candidate WHERE scan_id IS NOT NULL AND trademark_id IS NOT NULL),
d AS (SELECT *, CASE WHEN sig < 0.25 THEN edit ELSE wide END AS ortho, CASE WHEN sig >= 0.5 AND sig < 1 THEN greatest(sig, 0.75)
  ELSE sig END * 100 AS token,
  sound >= 80 AND sig < 0.5 AND edit < 80 AS alone, sig < 0.25 AND tri >= 80 AND edit < 75 AS surface FROM c),
e AS (SELECT *, list_reverse_sort([0.0, ortho, token, sound]) AS r FROM d),
f AS (SELECT *, CASE WHEN r[1] >= 95 AND r[2] >= 70 THEN least(greatest(r[1] + r[2] * CAST(0.15 AS DOUBLE), 0), 100) ELSE r[1] END AS base
  FROM e),
g AS (SELECT *, CASE WHEN alone OR surface THEN least(base, 55.0) ELSE base END - CASE WHEN sig < 0.25 AND edit < 80
  AND shared = 0 THEN 20.0 ELSE 0.0 END AS b FROM f),
s AS (SELECT *, floor(least(greatest(b, 0.0), 100.0) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS score FROM g)
SELECT DISTINCT scan_id, trademark_id, score, CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong'
  WHEN score >= 45 THEN 'relevant' WHEN score >= 25 THEN 'weak' ELSE 'low' END AS risk_band,
  CASE WHEN alone OR surface THEN 'low' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence FROM s
"""

_V = VERSIONS["pruning_profile"]
_NAME = (r"[^\p{L}\p{N}]+", "")
PRUNE = f"""
WITH {LATEST}, names AS (SELECT scan_id, max(length({_sub("lower(input_text)", _NAME)})) AS p FROM scan_run GROUP BY scan_id),
  marks AS (SELECT id, length({_sub("lower(mark_text)", _NAME)}) AS q FROM latest),
hits AS (SELECT scan_id, trademark_id, count(DISTINCT strategy) AS n, coalesce(bool_or(strategy = 'transliteration' AND score >= 1),
  false) AS latin FROM retrieval_hit GROUP BY ALL),
c AS (SELECT DISTINCT c.scan_id, c.trademark_id, c.created_at, coalesce(orthographic.jaro_winkler_similarity, 0) AS jw,
  coalesce(phonetic.pronunciation_similarity, 0) >= 0.7 AS ph, coalesce(orthographic.trigram_dice, 0) AS tri,
  coalesce(token_family.significant_overlap, 0) > 0 AS core, coalesce(token_family.significant_overlap, 0) = 0
  AND coalesce(token_family.shared_rare_token_count, 0) = 0 AND coalesce(orthographic.jaro_winkler_similarity, 0) >= 0.7 AS noise,
  orthographic.jaro_winkler_similarity IS NULL AND orthographic.trigram_dice IS NULL AS missing, coalesce(hits.n, 0) >= 2 AS multi,
  coalesce(latin, false) AS latin, coalesce(p, 0) AS p, coalesce(q, 0) AS q
  FROM scan_candidate c LEFT JOIN names USING (scan_id) LEFT JOIN marks ON marks.id = c.trademark_id LEFT
  JOIN hits ON hits.scan_id = c.scan_id AND hits.trademark_id = c.trademark_id
  WHERE c.scan_id IS NOT NULL AND c.trademark_id IS NOT NULL),
d AS (SELECT *, jw >= 1 AS ex, greatest(jw, tri) AS affix, least(p, q) AS short, greatest(p, q, 1) AS long FROM c),
e AS (SELECT *, NOT (ex OR latin) AND short > 0 AND short / CAST(long AS DOUBLE) <= 0.5 AND short <= 5 AS unlike,
  concat_ws(',', CASE WHEN ex THEN 'protect:exact_match' END, CASE WHEN ph AND (core OR ex OR latin) THEN 'protect:phonetic_key' END, CASE
  WHEN multi THEN 'protect:multi_family' END,
    CASE WHEN short <= 5 AND affix >= 0.85 THEN 'protect:short_mark_affix' END, CASE WHEN latin THEN 'protect:transliteration_exact' END,
  CASE WHEN core THEN 'protect:core_token' END, CASE WHEN missing THEN 'protect:missing_data' END) AS g,
  list_filter([CASE WHEN tri < 0.12 THEN 'weak:low_trigram' END, CASE WHEN affix < 0.2 THEN 'weak:low_affix' END, CASE WHEN NOT ph
  AND NOT ex THEN 'weak:no_exact_or_phonetic' END,
    CASE WHEN ph AND NOT core AND NOT ex THEN 'weak:phonetic_only' END, CASE WHEN noise AND NOT core AND NOT ex THEN 'weak:noise_only' END],
  lambda x: x IS NOT NULL) AS w FROM d)
SELECT DISTINCT scan_id, trademark_id, CASE WHEN unlike THEN 'discard' WHEN multi THEN 'promote' WHEN g <> '' THEN 'keep'
  WHEN len(w) >= 2 THEN 'discard' ELSE 'keep' END AS decision,
  '{_V}:' || CASE WHEN unlike THEN 'discard_length_ratio' WHEN multi THEN 'promote_multi_family' WHEN g <> '' THEN 'keep_protected'
  WHEN len(w) >= 2 THEN 'discard_multi_weak' ELSE 'keep_default' END AS rule,
  CASE WHEN unlike THEN 'weak:length_ratio' WHEN multi OR g <> '' THEN g WHEN len(w) >= 2 THEN array_to_string(w, ',')
  ELSE 'default:insufficient_discard_signals' END AS reasons FROM e
"""



def _rankable(more: str = "") -> str:
    """CTEs up to x: the newest row of each candidate with what it is ranked by, and ``more`` columns."""
    return f"""{LATEST},
c AS (SELECT * FROM scan_candidate WHERE scan_id IS NOT NULL AND trademark_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id,
  trademark_id ORDER BY created_at DESC NULLS LAST, strongest_retrieval_score DESC NULLS LAST, retrieval_strategy_count DESC NULLS LAST,
  decision DESC NULLS LAST) = 1),
x AS (SELECT c.scan_id, c.trademark_id AS id, round(coalesce(strongest_retrieval_score, 0) * 100, 2) AS score, CASE decision
  WHEN 'promote' THEN 3 WHEN 'keep' THEN 2 ELSE 1 END AS level, coalesce(retrieval_strategy_count, 0) AS channels,
  coalesce(normalized_status = 'registered', false) AS active, coalesce({_day("filing_date")}, '9999-99-99') AS day, mark_text{more} FROM c
  JOIN latest l ON l.id = c.trademark_id)"""


RANKABLE = _rankable()
_ORDER = "score DESC, level DESC, active DESC, channels DESC, day, id"
RANK = f"WITH {RANKABLE} SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY {_ORDER}) AS position FROM x"
FAMILIES = f"""
WITH {RANKABLE}, y AS (SELECT *, coalesce(nullif({_sub("lower(mark_text)", (r"[^\p{L}\p{N}]+", ""))}, ''), 'singleton:' || id) AS fam
  FROM x),
b AS (SELECT *, count(*) OVER (PARTITION BY scan_id, fam) AS member_count, row_number() OVER (PARTITION BY scan_id,
  fam ORDER BY {_ORDER}) AS k FROM y)
SELECT scan_id, id, member_count, row_number() OVER (PARTITION BY scan_id ORDER BY {_ORDER}) AS position FROM b WHERE k = 1
"""
RECALL = f"""
WITH {RANKABLE}, t AS (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, id) AS k FROM x),
w AS (SELECT DISTINCT scan_id, trademark_id AS id FROM scan_candidate WHERE decision = 'promote' AND scan_id IS NOT NULL
  AND trademark_id IS NOT NULL)
SELECT w.scan_id AS query_id, round(count(t.id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM w LEFT JOIN t ON t.scan_id = w.scan_id
  AND t.id = w.id AND t.k <= 10 GROUP BY w.scan_id
"""
CRITICAL = """
WITH w AS (SELECT DISTINCT scan_id, trademark_id FROM scan_candidate WHERE decision = 'promote' AND scan_id IS NOT NULL
  AND trademark_id IS NOT NULL),
h AS (SELECT DISTINCT scan_id, trademark_id, 1 AS hit FROM retrieval_hit)
SELECT round(coalesce(count(hit) / CAST(nullif(count(*), 0) AS DOUBLE), 1.0), 6) AS recall FROM w LEFT JOIN h USING (scan_id, trademark_id)
"""
DURATIONS = """
WITH d AS (SELECT engine_version, status, epoch_us(completed_at) - epoch_us(started_at) AS us FROM (SELECT DISTINCT * FROM scan_run)),
r AS (SELECT *, row_number() OVER (PARTITION BY engine_version, status ORDER BY us) AS k, count(*) OVER (PARTITION BY engine_version,
  status) AS n FROM d WHERE us IS NOT NULL)
SELECT engine_version, status, count(*) AS n, round(avg(us), 1) AS mean, max(us) FILTER (k = greatest(ceil(n * CAST(0.5 AS DOUBLE)),
  1)) AS p50, max(us) FILTER (k = greatest(ceil(n * CAST(0.95 AS DOUBLE)), 1)) AS p95, min(us) AS least, max(us) AS greatest FROM r
  GROUP BY engine_version, status
"""
COUNTS = f"""
SELECT count(*) AS marks, count(*) FILTER (is_text_searchable) AS searchable, count(DISTINCT source) AS sources,
  (SELECT count(DISTINCT trademark_id) FROM {R}) AS represented,
       (SELECT count(DISTINCT trademark_id) FROM {R} WHERE len(consonant_skeletons) > 0) AS with_sound_key,
  count(*) FILTER (is_text_searchable) > 0 AND (SELECT count(*) FROM {R}) > 0 AS ready FROM trademark
"""
_TOTAL = float(sum(STAGE_WEIGHTS.values()))
PROGRESS = f"""
WITH r AS (SELECT scan_id, bool_or(status = 'completed') AS ended, max(epoch_us(coalesce(completed_at,
  started_at + INTERVAL 5 SECOND)) - epoch_us(started_at)) / CAST(1000 AS DOUBLE) AS took FROM scan_run GROUP BY scan_id),
s AS (SELECT DISTINCT scan_id, current_stage, coalesce(list_position(['retrieved', 'pruned', 'compared', 'scored'], current_stage), 0) AS n
  FROM scan_candidate WHERE scan_id IS NOT NULL),
w AS (SELECT s.*, [0, {STAGE_WEIGHTS["union"]}, {STAGE_WEIGHTS["pruning"]}, {STAGE_WEIGHTS["comparison"]},
  {STAGE_WEIGHTS["scoring"]}][n + 1] * CASE WHEN coalesce(ended, false) OR n < max(n) OVER (PARTITION BY scan_id) THEN CAST(1 AS DOUBLE)
  ELSE 0.5 END AS x, coalesce(took, 0) AS took
  FROM s LEFT JOIN r USING (scan_id)),
d AS (SELECT scan_id, sum(x) / CAST({_TOTAL} AS DOUBLE) AS p, max(took) AS e FROM w GROUP BY scan_id)
SELECT scan_id, CAST(least(100, floor(p * 100 + CAST(0.5 AS DOUBLE))) AS BIGINT) AS percent, CASE WHEN p > 0
  AND e > 0 THEN CAST(greatest(floor(e / p - e + CAST(0.5 AS DOUBLE)), 0) AS BIGINT) END AS ms_left FROM d
"""
NEWEST = f"""
WITH m AS (SELECT run_mode FROM preprocessing_run UNION SELECT 'never'), done AS (SELECT DISTINCT * FROM preprocessing_run
  WHERE lower({_trim("status")}) = 'completed'),
b AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY run_mode ORDER BY completed_at DESC NULLS LAST, id DESC) = 1)
SELECT m.run_mode, coalesce(b.processed, CASE WHEN b.id IS NULL THEN (SELECT count(*) FROM trademark) END) AS marks,
  coalesce(b.succeeded, CASE WHEN b.id IS NULL THEN (SELECT count(DISTINCT trademark_id) FROM {R}) END) AS represented, b.id IS NULL AS live
FROM m LEFT JOIN b ON b.run_mode IS NOT DISTINCT FROM m.run_mode
"""
_PAYLOAD_CODES = """list_filter([CASE WHEN orthographic.jaro_winkler_similarity >= 1 THEN 'exact_compact' END, CASE
  WHEN orthographic.jaro_winkler_similarity >= 0.85 THEN 'orthographic_high' END,
  CASE WHEN phonetic.pronunciation_similarity >= 0.7 THEN 'phonetic_similar' END, CASE
  WHEN token_family.significant_overlap >= 0.5 THEN 'token_core_overlap' END, 'goods_missing', 'unknown_code'], lambda c: c IS NOT NULL)"""
_SAID = "CASE c " + " ".join(f"WHEN '{k}' THEN {X.quoted(v)}" for k, v in SENTENCES["en"].items()) + " END"
PAYLOADS = f"""
WITH {_rankable(f", normalized_status, l.nice_classes AS classes, {_PAYLOAD_CODES} AS codes")},
k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, id) AS k FROM x),
p AS (SELECT scan_id, k, {{'candidateId': id, 'markText': mark_text, 'niceClasses': classes, 'status': normalized_status,
  'score': {{'score': score, 'riskBand': CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong'
  WHEN score >= 45 THEN 'relevant' WHEN score >= 25 THEN 'weak' ELSE 'low' END,
  'confidence': CASE level WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END}}, 'evidenceCodes': codes[1:8],
  'explanations': list_filter(list_transform(codes, lambda c: {_SAID}), lambda s: s IS NOT NULL)[1:2]}} AS one FROM k WHERE k <= 10)
SELECT scan_id, CAST(count(*) AS INT) AS n, CAST(to_json(list(one ORDER BY k)) AS VARCHAR) AS payload FROM p GROUP BY scan_id
"""
REPLIES = """
WITH c AS (SELECT DISTINCT scan_id, trademark_id FROM scan_candidate WHERE scan_id IS NOT NULL AND trademark_id IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY trademark_id) AS n, CAST('0x' || right(md5(scan_id),
  4) AS INT) % 5 AS kind FROM c QUALIFY n <= 4),
g AS (SELECT scan_id, any_value(kind) AS kind, (list(trademark_id ORDER BY n) FILTER (n <> 2))[1:2] AS kept FROM f GROUP BY scan_id)
SELECT scan_id, CASE kind WHEN 2 THEN 'not a JSON object' WHEN 3 THEN 'broken or truncated JSON'
  WHEN 4 THEN 'fields missing or out of range' END AS error,
  CAST(CASE WHEN kind < 2 THEN len(kept) END AS DOUBLE) AS risks, CASE WHEN kind < 2 THEN array_to_string(kept, ',') END AS kept, CASE
  WHEN kind < 2 THEN CAST(159 AS DOUBLE) END AS summary_length FROM g
"""
STORE = f"""
WITH RECURSIVE {LATEST}, stored AS (SELECT trademark_id, compact FROM {R}
  WHERE trademark_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trademark_id ORDER BY normalization_version DESC NULLS LAST,
  created_at DESC NULLS LAST, compact DESC NULLS LAST) = 1),
todo AS (SELECT id, mark_text FROM latest l WHERE is_text_searchable AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.trademark_id = l.id)),
  {X.forms("todo", "mark_text")},
said_in AS (SELECT id, CASE WHEN dia <> '' THEN dia ELSE compact END AS t FROM todo JOIN forms ON forms.t = mark_text),
  {_sounds("said_in")}, n AS (SELECT id, count(DISTINCT algorithm || key) AS c FROM sounds GROUP BY id)
SELECT trademark_id, compact, 1 AS sound_keys FROM stored UNION ALL SELECT todo.id, compact, coalesce(c, 1) FROM todo
  JOIN forms ON forms.t = mark_text LEFT JOIN n ON n.id = todo.id
"""

_SCAN_IN = f"""{LATEST}, names AS (SELECT DISTINCT watch_id AS query_id, watch_text AS t FROM watch_name
  WHERE length({_trim("watch_text")}) > 0),
corpus AS (SELECT id, mark_text AS t, coalesce(nice_classes, []) AS cb, normalized_status AS status, {_day("filing_date")} AS day
  FROM latest WHERE is_text_searchable AND length({_trim("mark_text")}) > 0),
asked AS (SELECT DISTINCT t FROM names), held AS (SELECT DISTINCT t FROM corpus), texts_in AS (SELECT t AS x FROM names UNION SELECT t
  FROM corpus),
{X.forms("texts_in", "x")}, {DERIVED}, {P.SIDES}, {P.CHANNELS},
hits AS (SELECT query_id, id, a, b, cb, strategy, score, {_cap("length(s.compact)")} AS cap FROM channels JOIN names n ON n.t = a
  JOIN corpus c ON c.t = b JOIN sides s ON s.t = a)"""
SCAN_CHANNELS = f"WITH RECURSIVE {_SCAN_IN} SELECT query_id, id, strategy, round(score, 6) AS score FROM hits"
SCAN = f"""
WITH RECURSIVE {_SCAN_IN},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, id) AS rank FROM hits),
united AS (SELECT query_id, id, a, b, cb, string_agg(strategy, ',' ORDER BY rank, strategy) AS strategies, count(*) AS channels FROM ranked
  WHERE rank <= cap GROUP BY ALL),
pairs AS (SELECT DISTINCT a, b, CAST([] AS INT[]) AS ca, cb FROM united), {P.MEASURED}, {P.metrics("measured", "en")}, {P.FEATURES},
  {P.SCORED},
o AS (SELECT u.query_id, u.id, u.strategies, u.channels, s.*, x.compact = y.compact AS same, length(x.compact) AS px,
  length(y.compact) AS py, y.t AS mark_text,
  {_sub(X.lowered("strip_accents(z.nfkc)"), (X.ALNUM, ""))} AS fam FROM united u JOIN scored s USING (a, b, cb) JOIN sides x ON x.t = u.a
  JOIN sides y ON y.t = u.b JOIN forms z ON z.t = u.b),
g AS (SELECT *, least(px, py) AS short, coalesce(key1, 0) > 0 AS ph, coalesce(translit, 0) >= 1 AS latin, coalesce(sig, 0) > 0
  OR coalesce(core, 0) >= 1 OR coalesce(dom, 0) >= 1 AS hit FROM o),
w AS (SELECT *, (CASE WHEN coalesce(dice, 0) < 0.12 THEN 1 ELSE 0 END) + (CASE WHEN affix < 0.2 THEN 1 ELSE 0 END) + (CASE WHEN NOT ph
  AND NOT same THEN 1 ELSE 0 END) + (CASE WHEN ph AND NOT (hit OR same) THEN 1 ELSE 0 END)
    + (CASE WHEN coalesce(noise, 0) >= 0.5 AND NOT (hit OR same) THEN 1 ELSE 0 END) AS weak,
  same OR (ph AND (hit OR same OR latin)) OR (short <= 5 AND affix >= 0.85) OR latin OR hit AS held_back, NOT (same OR latin) AND short > 0
  AND short / CAST(greatest(px, py, 1) AS DOUBLE) <= 0.5 AND short <= 5 AS unlike FROM g),
k AS (SELECT w.*, {P.MULTI_CODES} AS codes, CASE WHEN fam = '' THEN 'singleton:' || w.id ELSE fam END AS family, CASE confidence
  WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS level, coalesce(c.status = 'registered', false) AS active,
  coalesce(c.day, '9999-99-99') AS day FROM w JOIN corpus c ON c.id = w.id WHERE NOT unlike AND (channels >= 2 OR held_back OR weak < 2)),
f AS (SELECT *, count(*) OVER (PARTITION BY query_id, family) AS member_count, row_number() OVER (PARTITION BY query_id,
  family ORDER BY score DESC, level DESC, active DESC, channels DESC, day, id) AS n FROM k)
SELECT query_id, id, mark_text, score, risk_band, confidence, strategies, array_to_string(codes, ',') AS evidence_codes,
  {P.sentences("codes", "a", "mark_text", "en")} AS explanations, member_count,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level DESC, active DESC, channels DESC, day, id) AS position FROM f
  WHERE n = 1
"""

SQL = {
    "scan_channels": SCAN_CHANNELS,
    "scan_all_rows": SCAN,
    "scan_by_keys": SCAN,
    "fold_part_names": FOLD_PARTS,
    "detect_scripts": DETECT_SCRIPTS,
    "compact_ngrams": COMPACT_NGRAMS,
    "gram_similarity": GRAM_SIMILARITY,
    "edit_distances": EDIT_DISTANCES,
    "represent_marks": REPRESENT,
    "transliterations": TRANSLITERATIONS,
    "token_hypotheses": HYPOTHESES,
    "phonetic_key_rows": PHONETIC_KEYS,
    "preprocess_marks": PREPROCESS,
    "retrieve_phonetic": RETRIEVE_PHONETIC,
    "jaro_similarities": JARO,
    "weighted_edits": WEIGHTED,
    "plain_scores": PLAIN_SCORES,
    "pair_features": PAIR_FEATURES,
    "goods_relations": GOODS,
    "read_sources": READ,
    "lookup_keys": LOOKUP_KEYS,
    "intake_log": INTAKE_LOG,
    "representation_store": STORE,
    "sound_key_backfill": BACKFILL,
    "newest_statistics": NEWEST,
    "candidate_payloads": PAYLOADS,
    "parsed_replies": REPLIES,
    "token_roles": TOKEN_ROLES,
    "token_cores": TOKEN_CORES,
    "sound_codes": SOUND_CODES,
    "languages": LANGUAGES,
    "status_groups": STATUS_SQL,
    "source_hashes": SOURCE_HASHES,
    "intake_marks": INTAKE,
    "delivery_actions": DELIVERY_ACTIONS,
    "register_after_upsert": AFTER_UPSERT,
    "purge_statuses": PURGE,
    "marks_to_preprocess": TO_PREPROCESS,
    "retrieve_exact": RETRIEVE_EXACT,
    "retrieve_trigram": RETRIEVE_TRIGRAM,
    "retrieve_trigram_share": _share(0.5),
    "retrieve_trigram_share_all": _share(0.15),
    "explicit_languages": EXPLICIT,
    "retrieve_nysiis": RETRIEVE_NYSIIS,
    "cap_strategies": CAP,
    "unite_candidates": UNITE,
    "reserve_core_places": RESERVE,
    "fetch_hits": FETCH,
    "corpus_ready": READY,
    "names_of_input": NAMES,
    "class_relations": CLASSES,
    "stored_scores": SCORES,
    "prune_stored": PRUNE,
    "rank_candidates": RANK,
    "group_families": FAMILIES,
    "scan_recall": RECALL,
    "critical_recall": CRITICAL,
    "scan_durations": DURATIONS,
    "corpus_counts": COUNTS,
    "scan_progress": PROGRESS,
}
