"""Text forms, tokens, Latin spellings and sound keys in SQL, as lists of common table expressions.

SQL has no compatibility or decomposed normal forms, so characters are looked up in tables made by rule
from the Unicode data of Python, and matching with memory goes by recursion.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from markloom.functions.lexicons import CYRILLIC, FUNCTION_WORDS, GREEK, LEGAL_FORMS, SPECIAL_LATIN, WEAK_WORDS
from markloom.functions.tokens import ENDINGS

B = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LETTERS = "regexp_extract_all({}, '(?s).')"
ALNUM = r"[^\p{L}\p{N}]+"


def sub(x: str, *steps: tuple[str, str]) -> str:
    return reduce(lambda acc, s: f"regexp_replace({acc}, '{s[0]}', '{s[1]}', 'g')", steps, x)


def trim_blanks(x: str) -> str:
    return sub(x, (f"^{B}+|{B}+$", ""))


def fold_blanks(x: str) -> str:
    return trim_blanks(sub(x, (f"{B}+", " ")))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words: list) -> str:
    return ", ".join(map(quoted, words))


def grams(x: str, n: int) -> str:
    cut = f"list_transform(generate_series(1, length({x}) - {n - 1}), lambda i: substring({x}, i, {n}))"
    return f"CASE WHEN length({x}) >= {n} THEN {cut} ELSE [] END"


def _codes() -> list[int]:
    return [*range(0xA0, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1F300)]


def _table(name: str, form: str, plain) -> str:
    forms = ((code, unicodedata.normalize(form, chr(code))) for code in _codes())
    return f"{name}(code, s) AS (VALUES {', '.join(f'({c}, {quoted(f)})' for c, f in forms if f != plain(chr(c)))})"


#: Characters with a compatibility form, and those that come apart.
COMPAT = _table("compat", "NFKD", lambda ch: unicodedata.normalize("NFD", ch))
CANON = _table("canon", "NFD", lambda ch: ch)


#: Characters whose capitals are several characters.
CAPITALS = "capitals(code, s) AS (VALUES " + ", ".join(
    f"({c}, {quoted(chr(c).upper())})" for c in _codes() if len(chr(c).upper()) > 1
) + ")"


def spelled(source: str, column: str, table: str, out: str) -> str:
    """CTE ``out``(column, s): the texts of a column with each character looked up in a table."""
    return f"""{out}_c AS (SELECT {column}, unnest(l) AS ch, unnest(generate_series(1, len(l))) AS i
  FROM (SELECT {column}, {LETTERS.format(column)} AS l FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL))),
{out} AS (SELECT {column}, string_agg(coalesce(s, ch), '' ORDER BY i) AS s FROM {out}_c LEFT JOIN {table} ON code = unicode(ch)
  GROUP BY {column})"""


def special_latin(x: str) -> str:
    return reduce(lambda acc, kv: f"replace({acc}, '{kv[0]}', '{kv[1]}')", SPECIAL_LATIN.items(), x)


def lowered(x: str) -> str:
    """Lower case with the sigma of word ends."""
    ends = sub(x, (r"(\p{L})Σ(\P{L}|$)", r"\1ς\2"), (r"(\p{L})Σ(\P{L}|$)", r"\1ς\2"))
    return f"lower({ends})"


_LEGAL = "|".join(LEGAL_FORMS)
_SHORT = sub(f"regexp_replace(ws, '^(\\S.*?)(?: (?:{_LEGAL}))+$', '\\1')", (ALNUM, ""))
_WHOLE = sub("ws", (ALNUM, ""))
COMPACT = f"CASE WHEN length({_SHORT}) < 2 AND length({_WHOLE}) >= 2 THEN {_WHOLE} ELSE {_SHORT} END"


def forms(source: str, column: str = "t") -> str:
    """CTEs up to forms(t, nfkc, low, dia, ws, ascii, compact) of the distinct texts of a source."""
    return f"""src AS (SELECT DISTINCT {column} AS t FROM {source} WHERE {column} IS NOT NULL), {COMPAT},
  {spelled("src", "t", "compat", "nk")},
f0 AS (SELECT src.t, nfc_normalize(coalesce(s, '')) AS nfkc FROM src LEFT JOIN nk USING (t)),
f1 AS (SELECT *, {lowered("nfkc")} AS low FROM f0),
f2 AS (SELECT *, {special_latin("strip_accents(low)")} AS dia FROM f1),
f3 AS (SELECT *, {fold_blanks(sub("dia", (r"[\p{P}\p{S}]+", " ")))} AS ws FROM f2),
forms AS (SELECT *, {sub("dia", (r"[^\x00-\x7F]", ""))} AS ascii, {COMPACT} AS compact FROM f3)"""


def role(w: str) -> str:
    return f"""CASE WHEN {w} = '' THEN 'unknown' WHEN regexp_full_match({w}, '\\p{{N}}+') THEN 'numeral'
  WHEN {w} IN ({listed(LEGAL_FORMS)}) THEN 'legal_form'
 WHEN {w} IN ({listed(FUNCTION_WORDS)}) THEN 'function_word' WHEN {w} IN ({listed(WEAK_WORDS)}) THEN 'descriptive_weak'
 WHEN regexp_matches({w}, '\\p{{L}}') THEN 'distinctive' ELSE 'unknown' END"""


_SPLIT = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}/\\|,;:\x{2010}-\x{2015}\x{2212}]+"
_JOIN = (r"([\p{L}\p{N}])[-‐‑‒–—―=+〜～∼≈_·⋅•⋆×÷±]([\p{L}\p{N}])", r"\1 \2")
_WORD = sub(special_latin(lowered("strip_accents(raw)")), (ALNUM, ""))

#: From ``forms``: words(t, idx, word, role) and per text tokens, significant and other words, the dominant one, the joined core.
WORDS = f"""w0 AS (SELECT t, {sub(sub("nfkc", (_SPLIT, " ")), _JOIN, _JOIN)} AS s FROM forms),
w1 AS (SELECT t, unnest(l) AS raw, unnest(generate_series(1, len(l))) AS i FROM (SELECT t, string_split(s, ' ') AS l FROM w0)),
w2 AS (SELECT t, i, {sub("raw", (r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))} AS raw FROM w1),
w3 AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY t) AS n, {_WORD} AS word FROM w2
  WHERE raw <> ''),
words AS (SELECT *, {role("word")} AS role FROM w3),
weighed AS (SELECT *, CASE WHEN role = 'distinctive' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS share FROM words
  WHERE role IN ('distinctive', 'unknown') AND word <> ''),
doms AS (SELECT t, arg_max(word, struct_pack(w := length(word) * 3 * share + (n - idx) * CAST(0.35 AS DOUBLE) * share - CASE
  WHEN length(word) <= 3 THEN 5 * share ELSE 0 END, i := -idx)) AS dominant FROM weighed GROUP BY t),
bags AS (SELECT t, list(word ORDER BY idx) FILTER (word <> '') AS tokens, coalesce(list(word ORDER BY idx) FILTER (role IN ('distinctive',
  'unknown') AND word <> ''), []) AS sig,
  coalesce(list(word ORDER BY idx) FILTER (role IN ('descriptive_weak', 'legal_form', 'function_word', 'numeral')), []) AS noise,
  coalesce(list(word ORDER BY idx) FILTER (role = 'descriptive_weak'), []) AS weak, count(*) AS n FROM words GROUP BY t),
cores AS (SELECT forms.t, coalesce(tokens, []) AS tokens, coalesce(sig, []) AS sig, coalesce(noise, []) AS noise, coalesce(weak,
  []) AS weak, coalesce(n, 0) AS n,
  dominant, array_to_string(coalesce(sig, []), '') AS core FROM forms LEFT JOIN bags USING (t) LEFT JOIN doms USING (t))"""


def _mapped(x: str, table: dict) -> str:
    return reduce(lambda acc, kv: f"replace(replace({acc}, '{kv[0]}', '{kv[1]}'), '{kv[0].upper()}', '{kv[1]}')", table.items(), x)


_STRIP = r"^[ \t\n\r\x0b\x0c\x{feff}\x{a0}]+|[ \t\n\r\x0b\x0c\x{feff}\x{a0}]+$"


def _upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


#: From ``forms``: variants(t, v), the Latin spellings of each text, upper case, the mapped one first.
VARIANTS = f"""{CANON},
v0 AS (SELECT t, nfkc, regexp_matches(nfkc, '\\p{{Cyrillic}}') AS cyr, regexp_matches(nfkc, '\\p{{Greek}}') AS grk FROM forms),
v1 AS (SELECT t, nfkc, CASE WHEN cyr THEN {_mapped("nfkc", CYRILLIC)} WHEN grk THEN {_mapped("nfkc", GREEK)} ELSE nfkc END AS mapped
  FROM v0),
v2 AS (SELECT mapped AS x FROM v1 UNION SELECT nfkc FROM v1), {spelled("v2", "x", "canon", "apart")},
v3 AS (SELECT x, regexp_replace(s, '\\p{{M}}', '') AS once FROM apart),
v4 AS (SELECT t, nfkc, mapped, coalesce(a.once, '') AS m1, coalesce(b.once, '') AS p1, regexp_extract_all(nfkc, '\\p{{Han}}') AS han
  FROM v1 LEFT JOIN v3 a ON a.x = mapped LEFT JOIN v3 b ON b.x = nfkc),
v5 AS (SELECT t, [{_upper("mapped")}, {_upper("m1")}] || CASE WHEN len(han) > 0
  THEN [nfkc, array_to_string(list_transform(han, lambda c: 'U+' || printf('%X', unicode(c))), '-'),
  {sub("nfkc", (r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", ""))}] ELSE [] END
  || CASE WHEN regexp_full_match(p1, '[\\p{{Latin}}\\p{{N}}\\p{{P}}\\p{{Zs}}]+') THEN [{_upper("p1")}] ELSE [] END AS l FROM v4),
v6 AS (SELECT t, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM v5),
v7 AS (SELECT t, {sub("x", (_STRIP, ""))} AS x, min(i) AS i FROM v6 GROUP BY ALL),
v8 AS (SELECT t, list(x ORDER BY i) AS v FROM v7 WHERE x <> '' GROUP BY t),
variants AS (SELECT forms.t, CASE WHEN forms.t = '' THEN [''] ELSE coalesce(v, []) END AS v FROM forms LEFT JOIN v8 USING (t))"""

_REST = "substring(w, length(u) + 1)"
_CODE = f"""CASE WHEN u = 'CH' OR u = 'SH' THEN 'X' WHEN u IN ('GH', 'GN') THEN '' WHEN u = 'PH' THEN 'F' WHEN u = 'TH' THEN '0'
  WHEN u = 'D' THEN 'T' WHEN u = 'Q' THEN 'K' WHEN u = 'V' THEN 'F'
 WHEN u = 'X' THEN 'KS' WHEN u = 'Z' THEN 'S' WHEN u IN ('F', 'J', 'K', 'L', 'M', 'N', 'P', 'R') THEN u
 WHEN u = 'C' THEN CASE WHEN left(rest, 1) IN ('I', 'E', 'Y') THEN 'S' ELSE 'K' END WHEN u = 'G' THEN CASE WHEN left(rest, 1) IN ('I', 'E',
  'Y') THEN 'J' ELSE 'K' END
 WHEN u IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN first THEN u ELSE '' END WHEN u = 'B' THEN CASE WHEN last = 'M' AND rest = '' THEN ''
  ELSE 'P' END
 WHEN u = 'H' THEN CASE WHEN free AND last IN ('', 'A', 'E', 'I', 'O', 'U') THEN 'H' ELSE '' END WHEN u IN ('S', 'T') THEN CASE
  WHEN left(rest, 2) IN ('IO', 'IA') THEN 'X' ELSE u END
 WHEN u = 'W' THEN CASE WHEN free THEN 'W' ELSE '' END WHEN u = 'Y' THEN CASE WHEN free OR first THEN 'Y' ELSE '' END ELSE 'J' END"""
_UNIT = """CASE WHEN regexp_matches(w, '^(CH|PH|SH|TH)') THEN left(w, 2) WHEN regexp_matches(w, '^DG[EIY]') THEN left(w, 3)
  WHEN regexp_matches(w, '^GH[^AEIOU]') THEN 'GH'
 WHEN w = 'GN' THEN 'GN' ELSE left(w, 1) END"""


def sound_keys(source: str, column: str = "t") -> str:
    """CTEs up to keyed(t, key): the sound key of each distinct text, empty without a letter A-Z."""
    return f"""k0 AS (SELECT DISTINCT {column} AS t, {sub(f"upper({column})", ("[^A-Z]", ""))} AS w FROM {source}
  WHERE {column} IS NOT NULL),
k1 AS (SELECT DISTINCT CASE WHEN w LIKE 'X%' THEN 'S' || substring(w, 2) ELSE w END AS full_w FROM k0 WHERE w <> ''),
k2 AS (
  SELECT full_w, CASE WHEN regexp_matches(full_w, '^(GN|KN|PN|WR|PS)') THEN substring(full_w, 2) ELSE full_w END AS w,
  NOT regexp_matches(full_w, '^(GN|KN|PN|WR|PS)') AS first, 0 AS n, '' AS out, '' AS last FROM k1
  UNION ALL
  SELECT full_w, sub_w AS w, false, n + CASE WHEN code <> '' THEN 1 ELSE 0 END, out || code, CASE WHEN code <> '' THEN code ELSE last END
  FROM (SELECT *, {_CODE} AS code, regexp_replace(rest, '^' || left(w, 1) || '+', '') AS sub_w
        FROM (SELECT *, rest = '' OR left(rest, 1) IN ('A', 'E', 'I', 'O', 'U') AS free FROM (SELECT *, {_REST} AS rest FROM (SELECT *,
  {_UNIT} AS u FROM k2 WHERE w <> '' AND n < 4))))
),
k3 AS (SELECT full_w, arg_max(out, -length(w)) AS out FROM k2 GROUP BY full_w),
keyed AS (SELECT k0.t, CASE WHEN k0.w = '' THEN '' ELSE left(rpad(out, 4, '0'), 4) END AS key
  FROM k0 LEFT JOIN k3 ON full_w = CASE WHEN w LIKE 'X%' THEN 'S' || substring(w, 2) ELSE w END)"""


def split_hypotheses() -> str:
    """From ``words`` and ``cores``: hypos(t, tokens, merged, reason)."""
    head = "left(word, length(word) - length(e))"
    able = f"suffix(word, e) AND length(word) - length(e) >= 3 AND ({role(head)}) = 'distinctive'"
    return f"""c0 AS (SELECT t, word, list_filter([{listed(ENDINGS)}], lambda e: {able}) AS es FROM words WHERE length(word) >= 6
  AND (n = 1 OR role = 'distinctive')),
hypos AS (SELECT t, left(word, length(word) - length(es[1])) || ',' || es[1] AS tokens, word AS merged,
  'agglutinated-noise-suffix-split' AS reason FROM c0 WHERE len(es) > 0
  UNION ALL SELECT t, array_to_string(tokens[1:2], ','), array_to_string(tokens[1:2], ''), 'adjacent-token-merge' FROM cores
  WHERE len(tokens) >= 2
  UNION ALL SELECT t, array_to_string(sig, ','), core, 'significant-merge' FROM cores WHERE len(sig) >= 2)"""
