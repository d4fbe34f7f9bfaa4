"""The queries of this package in SQL, where SQL can express them on whole tables."""

from __future__ import annotations

import unicodedata

from markloom.llm.fusion import CENTRE, FAR, TAIL
from markloom.llm.lookalike import LOOKS
from markloom.llm.quality import COMMON_WORDS, SENTENCE_WORDS

R = "trademark_normalized_representation"


def _tokens(column: str) -> str:
    return f"""
rows AS (SELECT trademark_id, row_number() OVER () AS r, {column} AS a FROM {R} WHERE trademark_id IS NOT NULL AND {column} IS NOT NULL),
flat AS (SELECT trademark_id, r, lower(trim(u.t)) AS token FROM rows, unnest(a) AS u(t)),
counted AS (SELECT trademark_id, r, token, count(*) AS tf FROM flat WHERE token <> '' GROUP BY ALL),
post AS (SELECT trademark_id, token, max(tf) AS tf FROM counted GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
len AS (SELECT trademark_id, sum(tf) AS len FROM post GROUP BY trademark_id),
tot AS (SELECT count(*) AS n, avg(len) AS mean FROM len)"""


def _weights(column: str) -> str:
    return f"""
WITH {_tokens(column)}
SELECT p.trademark_id, p.token, p.tf, d.df,
       round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS weight
FROM post p JOIN df d USING (token) JOIN len l USING (trademark_id) CROSS JOIN tot
"""


P2_FOUND = f"WITH {_tokens('tokens')} SELECT p.trademark_id, p.token FROM post p JOIN df d USING (token) WHERE df BETWEEN 2 AND 5"


def _horner(parts: tuple, x: str) -> str:
    def side(cs: tuple) -> str:
        text = repr(cs[-1])
        for c in reversed(cs[:-1]):
            text = f"({text} * {x} + {c!r})"
        return text

    return f"({side(parts[0])} / {side(parts[1])})"


def _quantile(p: str) -> str:
    q, r = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    tail = f"(CASE WHEN {r} <= 5 THEN {_horner(TAIL, f'({r} - 1.6)')} ELSE {_horner(FAR, f'({r} - 5.0)')} END)"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(CENTRE, f'(0.180625 - {q} * {q})')} WHEN {q} < 0 THEN -{tail} ELSE {tail} END"


CANDIDATES = """
c AS (
  SELECT scan_id, trademark_id, orthographic.jaro_winkler_similarity AS s0, orthographic.trigram_dice AS s1,
         phonetic.pronunciation_similarity AS s2, token_family.significant_overlap AS s3
  FROM scan_candidate WHERE scan_id IS NOT NULL AND trademark_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scan_id, trademark_id ORDER BY created_at DESC NULLS LAST, s0 DESC NULLS LAST, s1 DESC NULLS LAST,
  s2 DESC NULLS LAST, s3 DESC NULLS LAST) = 1
)"""

_WIN = " + ".join(f"CAST(coalesce(a.s{k} > b.s{k}, a.s{k} IS NOT NULL AND b.s{k} IS NULL) AS INT)" for k in range(4))

P3_FOUND = f"""
WITH {CANDIDATES}, d AS (SELECT *, coalesce(s0, -1e300) AS v0, coalesce(s1, -1e300) AS v1, coalesce(s2, -1e300) AS v2, coalesce(s3,
  -1e300) AS v3, count(*) OVER (PARTITION BY scan_id) AS n FROM c),
k AS (SELECT *, {" + ".join(f"(n - rank() OVER (PARTITION BY scan_id ORDER BY v{k}) - count(*) OVER (PARTITION BY scan_id, v{k}) + count(*) OVER (PARTITION BY scan_id, v{k}))" for k in range(4))} AS beside FROM d),
a AS (SELECT * FROM k WHERE n >= 3 AND beside <= n - 1)
SELECT a.scan_id, a.trademark_id FROM a JOIN d AS b ON a.scan_id = b.scan_id AND a.trademark_id <> b.trademark_id
GROUP BY a.scan_id, a.trademark_id HAVING min({_WIN}) >= 3
"""

P3_RANKING = f"""
WITH {CANDIDATES}, long AS (
  SELECT scan_id, trademark_id, k, v FROM (SELECT scan_id, trademark_id, unnest([0, 1, 2, 3]) AS k, unnest([s0, s1, s2, s3]) AS v FROM c)
), p AS (
  SELECT scan_id, trademark_id, k, v,
         (rank() OVER w - 1 + count(*) OVER (PARTITION BY scan_id, k, v) / 2.0) / count(*) OVER (PARTITION BY scan_id, k) AS p
  FROM long WHERE v IS NOT NULL WINDOW w AS (PARTITION BY scan_id, k ORDER BY v)
), z AS (SELECT scan_id, trademark_id, avg({_quantile("p")}) AS z FROM p GROUP BY ALL),
f AS (SELECT c.scan_id, c.trademark_id, round(z, 9) + 0.0 AS z FROM c LEFT JOIN z USING (scan_id, trademark_id))
SELECT scan_id, trademark_id, round(z, 6) + 0.0 AS fused, row_number() OVER (PARTITION BY scan_id ORDER BY z DESC NULLS LAST,
  trademark_id) AS place FROM f
"""


def _looks() -> str:
    """(code, shown) of every character that looks like something else, by rule from the table of the operator."""
    found = []
    for code in (*range(0xD800), *range(0xE000, 0x10000), *range(0x1D000, 0x1D800), *range(0xE0000, 0xE0200)):
        ch = chr(code)
        shown = " " if ch.isspace() else "".join(LOOKS[x] for x in unicodedata.normalize("NFD", ch))
        if unicodedata.normalize("NFC", shown) != unicodedata.normalize("NFC", ch):
            found.append(f"({code}, '{shown.replace(chr(39), chr(39) * 2)}')")
    return ", ".join(found)


LOOK_FORMS = f"""
look(code, shown) AS (VALUES {_looks()}),
texts AS (SELECT DISTINCT mark_text FROM trademark WHERE mark_text IS NOT NULL),
chars AS (SELECT mark_text, unnest(l) AS ch, unnest(generate_series(1, len(l))) AS i FROM (SELECT mark_text, regexp_extract_all(mark_text,
  '(?s).') AS l FROM texts)),
shown AS (SELECT mark_text, string_agg(coalesce(shown, ch), '' ORDER BY i) AS s FROM chars LEFT JOIN look ON look.code = unicode(ch)
  GROUP BY mark_text),
forms AS (SELECT mark_text, trim(regexp_replace(nfc_normalize(s), ' +', ' ', 'g')) AS form FROM shown),
marks AS (SELECT DISTINCT id, mark_text, form FROM trademark JOIN forms USING (mark_text) WHERE id IS NOT NULL AND form <> '')"""

P4_FOUND = f"""
WITH {LOOK_FORMS}
SELECT DISTINCT least(a.id, b.id) AS trademark_id_a, greatest(a.id, b.id) AS trademark_id_b
FROM marks a JOIN marks b ON a.form = b.form AND a.mark_text <> b.mark_text AND a.id <> b.id
"""

P4_CLASSES = f"""
WITH {LOOK_FORMS}, c AS (SELECT form, count(DISTINCT mark_text) AS texts, count(DISTINCT id) AS keys FROM marks GROUP BY form)
SELECT id AS trademark_id, mark_text, texts, keys FROM marks JOIN c USING (form)
"""


def _set(column: str, trim: bool) -> str:
    one = "lower(trim(x))" if trim else "lower(x)"
    return f"list_sort(list_distinct(list_filter(list_transform({column}, lambda x: {one}), lambda x: x <> '')))"


P5_FOUND = f"""
WITH s AS (SELECT DISTINCT trademark_id AS id, {_set("significant_tokens", True)} AS s FROM {R} WHERE trademark_id IS NOT NULL),
f AS (SELECT id, s, unnest(s) AS t FROM s),
sp AS (SELECT a.id AS x, b.id AS y, count(*) AS c, any_value(len(a.s)) AS na, any_value(len(b.s)) AS nb FROM f a JOIN f b ON a.t = b.t
  AND a.id < b.id GROUP BY a.id, b.id, a.s, b.s),
g AS (SELECT DISTINCT trademark_id AS id, {_set("trigrams", False)} AS s FROM {R} WHERE trademark_id IS NOT NULL),
w AS (SELECT DISTINCT watch_id AS id, {_set("trigrams", False)} AS s FROM watch_name WHERE watch_id IS NOT NULL),
gf AS (SELECT id, s, unnest(s) AS t FROM g), wf AS (SELECT id, s, unnest(s) AS t FROM w),
gp AS (SELECT a.id AS x, b.id AS y, count(*) AS c, any_value(len(a.s)) AS na, any_value(len(b.s)) AS nb FROM gf a JOIN wf b ON a.t = b.t
  GROUP BY a.id, b.id, a.s, b.s)
SELECT DISTINCT 'significant_tokens' AS set_field, x AS key_a, y AS key_b FROM sp
  WHERE CAST(c AS DOUBLE) / (na + nb - c) >= CAST(0.6 AS DOUBLE)
UNION ALL
SELECT DISTINCT 'trigrams' AS set_field, least(x, y) AS key_a, greatest(x, y) AS key_b FROM gp
  WHERE CAST(c AS DOUBLE) / (na + nb - c) >= CAST(0.5 AS DOUBLE)
"""

P5_TRIGRAMS = "SELECT key_a, key_b FROM (" + P5_FOUND + ") WHERE set_field = 'trigrams'"

P5_CLASSES = f"""
WITH m AS (SELECT DISTINCT trademark_id AS id, {_set("significant_tokens", True)} AS s FROM {R} WHERE trademark_id IS NOT NULL),
d AS (SELECT s, count(DISTINCT id) AS copies, row_number() OVER () AS i FROM m WHERE len(s) > 0 GROUP BY s),
f AS (SELECT i, s, unnest(s) AS t FROM d),
p AS (SELECT a.i AS x, b.i AS y FROM f a JOIN f b ON a.t = b.t AND a.i <> b.i GROUP BY a.i, b.i, a.s,
  b.s HAVING CAST(count(*) AS DOUBLE) / (len(a.s) + len(b.s) - count(*)) >= CAST(0.6 AS DOUBLE)),
l AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT m.id AS trademark_id, d.copies, coalesce(l.links, 0) AS links FROM m JOIN d ON m.s = d.s LEFT JOIN l ON l.x = d.i
"""

_BEST = """
WITH b AS (SELECT scan_id, strategy, trademark_id, max(score) AS score FROM retrieval_hit
           WHERE scan_id IS NOT NULL AND strategy IS NOT NULL AND trademark_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, strategy ORDER BY score DESC, trademark_id) AS place FROM b)
"""

_WORDS = r"list_filter(list_transform(string_split_regex(lower({}), '[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: regexp_replace(strip_accents(x), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '')"
_GRAMS = "CASE WHEN len({w}) >= 13 THEN list_transform(generate_series(1, len({w}) - 12), lambda i: array_to_string({w}[i:i + 12], ' ')) ELSE [] END"

P8_FOUND = f"""
WITH i AS (SELECT item_id, {_WORDS.format("item_text")} AS w FROM eval_item WHERE item_text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, unnest({_GRAMS.format(w="w")}) AS g FROM i),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest({_GRAMS.format(w="w")}) AS g FROM d)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g
"""

_BLANK = r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Texts are taken apart into pieces with the blanks before them; a leaked word goes, and with it what stands between it and the leaked word before.
P8_CLEANED = rf"""
WITH i AS (SELECT {_WORDS.format("item_text")} AS w FROM eval_item WHERE item_text IS NOT NULL),
  ig AS (SELECT DISTINCT unnest({_GRAMS.format(w="w")}) AS g FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS.format("text")} AS w FROM documents),
dg AS (SELECT r, unnest({_GRAMS.format(w="w")}) AS g, unnest(generate_series(1, greatest(len(w) - 12, 0))) AS k FROM d),
leaked AS (SELECT DISTINCT r, k + o AS k FROM (SELECT r, k FROM dg JOIN ig USING (g)), (SELECT unnest(generate_series(0, 12)) AS o)),
hit AS (SELECT d.r, text, w FROM d JOIN (SELECT DISTINCT r FROM leaked) USING (r)),
p AS (SELECT r, unnest(l) AS piece, unnest(generate_series(1, len(l))) AS i FROM (SELECT r, regexp_extract_all(text,
  '[{_BLANK}]*[^{_BLANK}]+') AS l FROM hit)),
q AS (SELECT *, regexp_replace(strip_accents(lower(piece)), '[^\p{{L}}\p{{N}}]', '', 'g') <> '' AS word FROM p),
k AS (SELECT *, sum(CAST(word AS INT)) OVER (PARTITION BY r ORDER BY i) AS k FROM q),
f AS (SELECT k.*, a.k IS NOT NULL AS own, b.k IS NOT NULL AS next, c.k IS NOT NULL AS prev FROM k LEFT JOIN leaked a ON a.r = k.r
  AND a.k = k.k LEFT JOIN leaked b ON b.r = k.r AND b.k = k.k + 1 LEFT JOIN leaked c ON c.r = k.r AND c.k = k.k - 1),
o AS (SELECT r, string_agg(CASE WHEN word AND own THEN CASE WHEN prev THEN '' ELSE regexp_extract(piece, '^[{_BLANK}]*') END WHEN NOT word
  AND own AND next THEN '' ELSE piece END, '' ORDER BY i) AS body,
  count(*) FILTER (word AND own) / CAST(count(*) FILTER (word) AS DOUBLE) AS share FROM f GROUP BY r)
SELECT doc_id, CASE WHEN o.r IS NULL THEN text ELSE body || regexp_extract(text, '[{_BLANK}]*$') END AS text FROM d LEFT JOIN o USING (r)
  WHERE coalesce(share, 0) <= 0.5
"""

_SENTENCE, _COMMON = (", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) for words in (SENTENCE_WORDS, COMMON_WORDS))
_PLAIN = r"""["''«»“”„‘’(\[¿¡]*[\p{L}\p{N}_]["''»”’)\]]*[.,;:!?…]*["''»”’)\]]*"""
_PARTS = r"list_filter(list_transform(string_split_regex(low, '[''’]'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '')"

P9_STATISTICS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l0 AS (SELECT r, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM (SELECT r, string_split_regex(text, '\r\n?|\n') AS l
  FROM d WHERE text IS NOT NULL)),
p0 AS (SELECT r, i, unnest(regexp_extract_all(line, '[^{_BLANK}]+')) AS p FROM l0),
p1 AS (SELECT DISTINCT p, lower(left(p, 64)) AS low FROM p0),
p2 AS (SELECT p, low, {_PARTS} AS parts, length(p) AS visible, length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(p, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum FROM p1),
p3 AS (SELECT p, visible, letters, alnum - letters AS digits, CAST(alnum > 0 AS INT) AS word, alnum,
  CASE WHEN alnum > 0 AND length(p) < 64 AND len(list_filter(parts, lambda x: x IN ({_COMMON}))) > 0 THEN 1 ELSE 0 END AS common,
  CASE WHEN alnum > 0 AND length(p) < 64 AND len(list_filter(parts, lambda x: x IN ({_SENTENCE}) AND (length(x) > 1
  OR regexp_full_match(low, '{_PLAIN}')
    OR (len(parts) > 1 AND list_bool_and(list_transform(parts, lambda y: regexp_full_match(y, '\p{{L}}+')))
  AND list_max(list_transform(parts, lambda y: length(y))) > 1)))) > 0 THEN 1 ELSE 0 END AS sentence,
  CASE WHEN regexp_matches(left(p, 64), '\p{{N}}') AND regexp_matches(left(p, 64), '\p{{L}}') THEN 1 ELSE 0 END AS mixed FROM p2),
l1 AS (SELECT r, i, sum(visible) AS visible, sum(letters) AS letters, sum(digits) AS digits, sum(word) AS words, sum(alnum) AS word_chars,
  sum(common) AS common, sum(sentence) AS sentence, sum(mixed) AS mixed FROM p0 JOIN p3 USING (p) GROUP BY r, i),
l2 AS (SELECT l0.r, l0.i, coalesce(visible, 0) AS visible, letters, digits, words, word_chars, common, sentence, regexp_matches(line,
  '[.!?:;…"''»”’)\]][{_BLANK}]*$') AND visible > 0 AS ended,
  regexp_matches(line, '^[{_BLANK}]*[\p{{Ll}}ªº]') AS small, regexp_matches(line, '^[{_BLANK}]*[\p{{L}}\p{{N}}]') AS plain,
  coalesce(visible, 0) = 0 OR visible - letters - digits > CAST(0.25 AS DOUBLE) * visible OR mixed > greatest(1,
  CAST(0.15 AS DOUBLE) * words) AS noise FROM l0 LEFT JOIN l1 ON l1.r = l0.r AND l1.i = l0.i),
l3 AS (SELECT *, NOT noise AND (small OR (ended AND plain)) AND NOT coalesce(lag(noise OR ended) OVER (PARTITION BY r ORDER BY i),
  true) AS goes_on FROM l2),
l4 AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS para FROM l3),
para AS (SELECT r, para, sum(visible) AS v FROM l4 WHERE NOT noise GROUP BY r, para HAVING sum(words) >= 3
  AND sum(sentence) >= CAST(0.1 AS DOUBLE) * sum(words)),
run AS (SELECT r, sum(v) AS running FROM para GROUP BY r),
t AS (SELECT r, sum(visible) AS visible, sum(letters) AS letters, sum(digits) AS digits, sum(words) AS words, sum(word_chars) AS word_chars,
  sum(common) AS common, count(*) FILTER (visible > 0) AS lines, count(*) FILTER (ended) AS ended FROM l4 GROUP BY r),
c AS (SELECT d.doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(CASE WHEN text IS NOT NULL THEN coalesce(t.visible,
  0) END AS DOUBLE) AS visible, CAST(CASE WHEN text IS NOT NULL THEN coalesce(words, 0) END AS DOUBLE) AS words,
  CAST(CASE WHEN text IS NOT NULL THEN coalesce(lines, 0) END AS DOUBLE) AS lines, word_chars / CAST(nullif(words,
  0) AS DOUBLE) AS mean_word_length, (t.visible - letters - digits) / CAST(nullif(t.visible, 0) AS DOUBLE) AS symbol_ratio,
  digits / CAST(nullif(t.visible, 0) AS DOUBLE) AS digit_ratio, ended / CAST(nullif(lines, 0) AS DOUBLE) AS ended_line_share,
  common / CAST(nullif(words, 0) AS DOUBLE) AS common_word_share,
  CASE WHEN t.visible > 0 THEN coalesce(running, 0) / CAST(t.visible AS DOUBLE) END AS prose_share FROM d LEFT JOIN t USING (r) LEFT
  JOIN run USING (r))
SELECT doc_id, chars, visible, words, lines, round(mean_word_length, 6) AS mean_word_length, round(symbol_ratio, 6) AS symbol_ratio,
  round(digit_ratio, 6) AS digit_ratio, round(ended_line_share, 6) AS ended_line_share,
  round(common_word_share, 6) AS common_word_share, round(prose_share, 6) AS prose_share,
  CASE WHEN prose_share IS NULL THEN NULL WHEN prose_share >= 0.5 THEN 'prose' WHEN symbol_ratio > 0.5 OR mean_word_length > 40
  OR words = 0 THEN 'junk' WHEN digit_ratio > 0.15 OR symbol_ratio > 0.15 THEN 'table' ELSE 'list' END AS kind FROM c
"""

SQL = {
    "p2_found": P2_FOUND,
    "p2_weights": _weights("tokens"),
    "p2_descriptive_weights": _weights("descriptive_tokens"),
    "p3_found": P3_FOUND,
    "p3_ranking": P3_RANKING,
    "p4_found": P4_FOUND,
    "p4_classes": P4_CLASSES,
    "p5_found": P5_FOUND,
    "p5_trigrams_joined": P5_TRIGRAMS,
    "p5_classes": P5_CLASSES,
    "p6_found": _BEST + "SELECT scan_id, strategy, trademark_id FROM r WHERE place <= 5",
    "p6_top20": _BEST + "SELECT scan_id, strategy, trademark_id, round(score, 6) AS score, place FROM r WHERE place <= 20",
    "p8_found": P8_FOUND,
    "p8_cleaned": P8_CLEANED,
    "p9_found": "SELECT doc_id FROM (" + P9_STATISTICS + ") WHERE kind <> 'prose'",
    "p9_statistics": P9_STATISTICS,
}
