"""Per-string algorithms that Spark has no expression for, as plain functions and as Arrow UDFs.

Everything here needs Unicode normal forms or a scan with memory; all other functions are Column
expressions in the sister modules.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from markloom.functions.lexicons import CYRILLIC, EDIT_RULES, GREEK, SPECIAL_LATIN


def series_udf(kind: str):
    """An Arrow UDF that is made at its first use, so that modules load without a session."""

    def wrap(f):
        return functools.wraps(f)(lambda *cols: F.pandas_udf(kind)(f)(*cols))

    return wrap


MARKS_OUT = str.maketrans(SPECIAL_LATIN)


def _both_cases(table: dict) -> dict:
    return str.maketrans(table | {k.upper(): v for k, v in table.items() if len(k.upper()) == 1})


TO_LATIN = {"Cyrillic": _both_cases(CYRILLIC), "Greek": _both_cases(GREEK)}

NOT_ALNUM = re.compile(r"[\W_]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SEPARATORS = re.compile(r"[\s﻿/\\|,;:‐-―−]+")
JOINERS = re.compile(r"(?<=[^\W_])[-‐‑‒–—―=+〜～∼≈_·⋅•⋆×÷±](?=[^\W_])")


def bare(text: str) -> str:
    """Without combining marks, decomposed."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")


def split_tokens(nfkc: str) -> list[tuple[str, str]]:
    """(raw, folded) tokens of compatibility-normalised text."""
    out = []
    for part in SEPARATORS.split(nfkc):
        for piece in JOINERS.split(part):
            raw = EDGES.sub("", piece)
            if raw:
                out.append((raw, NOT_ALNUM.sub("", bare(raw).lower().translate(MARKS_OUT))))
    return out


def latin_variants(text: str) -> list[str]:
    """Upper-case Latin spellings, the mapped form first; Han text also as it is and in code points."""
    import regex

    if not text:
        return [""]
    nfkc = unicodedata.normalize("NFKC", text)
    script = next((s for s in TO_LATIN if regex.search(rf"\p{{Script={s}}}", nfkc)), None)
    mapped = nfkc.translate(TO_LATIN[script]) if script else nfkc
    first_mark_out = lambda s: regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", s), count=1)
    found = [mapped.upper(), first_mark_out(mapped).upper()]
    han = regex.findall(r"\p{Script=Han}", nfkc)
    if han:
        found += [nfkc, "-".join(f"U+{ord(c):X}" for c in han), re.sub(r"[\s﻿]+", "", nfkc)]
    plain = first_mark_out(nfkc)
    if regex.fullmatch(r"[\p{Script=Latin}\p{N}\p{P}\p{Zs}]+", plain):
        found.append(plain.upper())
    return list(dict.fromkeys(s for s in (v.strip(" \t\n\r\v\f﻿ ") for v in found) if s))


@series_udf("nfc string, nfkc string, lower string, bare string, family string, tokens array<struct<raw:string,normalized:string>>, variants array<string>")
def text_forms(texts: pd.Series) -> pd.DataFrame:
    """All forms of a text that need Unicode normalisation, in one pass."""
    norm, rows = unicodedata.normalize, []
    for t in texts:
        if t is None:
            rows.append([None] * 7)
            continue
        nfkc = norm("NFKC", t)
        low = nfkc.lower()
        family = NOT_ALNUM.sub("", "".join(c for c in norm("NFKD", t) if unicodedata.category(c)[0] != "M").lower())
        tokens = [{"raw": r, "normalized": n} for r, n in split_tokens(nfkc)]
        rows.append([norm("NFC", t), nfkc, low, bare(low), family, tokens, latin_variants(t)])
    return pd.DataFrame(rows, columns=["nfc", "nfkc", "lower", "bare", "family", "tokens", "variants"])


@series_udf("string")
def bare_udf(texts: pd.Series) -> pd.Series:
    return texts.map(bare, na_action="ignore")


# -- primary sound key -----------------------------------------------------------------------------

#: A unit of spelling, then every repeat of the letter that it began with.
UNIT = re.compile(r"(?=(?P<first>.))(?P<unit>CH|DG[EIY]|GH(?=[^AEIOU])|GN$|PH|SH|TH|.)(?P=first)*")
FIXED = {
    "CH": "X",
    "GH": "",
    "GN": "",
    "PH": "F",
    "SH": "X",
    "TH": "0",
    "D": "T",
    "F": "F",
    "J": "J",
    "K": "K",
    "L": "L",
    "M": "M",
    "N": "N",
    "P": "P",
    "Q": "K",
    "R": "R",
    "V": "F",
    "X": "KS",
    "Z": "S",
}
SOFT = {"C": ("S", "K"), "G": ("J", "K")}


def sound_key(text: str) -> str:
    """Four symbols at most, filled up with 0; empty without a letter A-Z."""
    word = re.sub("[^A-Z]", "", text.upper())
    if not word:
        return ""
    if word[0] == "X":
        word = "S" + word[1:]
    out: list[str] = []
    for m in UNIT.finditer(word, 1 if word[:2] in ("GN", "KN", "PN", "WR", "PS") else 0):
        if len(out) >= 4:
            break
        unit, rest, last = m["unit"], word[m.end("unit") :], out[-1] if out else ""
        vowel_next = not rest or rest[0] in "AEIOU"
        if unit in FIXED:
            code = FIXED[unit]
        elif unit in SOFT:
            code = SOFT[unit][rest[:1] not in ("I", "E", "Y")]
        elif unit in "AEIOU":
            code = unit if m.start() == 0 else ""
        elif unit == "B":
            code = "" if last == "M" and not rest else "P"
        elif unit == "H":
            code = "H" if vowel_next and last in ("", *"AEIOU") else ""
        elif unit in "ST":
            code = "X" if rest[:2] in ("IO", "IA") else unit
        elif unit == "W":
            code = "W" if vowel_next else ""
        elif unit == "Y":
            code = "Y" if vowel_next or m.start() == 0 else ""
        else:
            code = "J"
        if code:
            out.append(code)
    return "".join(out).ljust(4, "0")[:4]


@series_udf("string")
def sound_key_udf(texts: pd.Series) -> pd.Series:
    return texts.map(sound_key, na_action="ignore")


# -- pair metrics ----------------------------------------------------------------------------------


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def levenshtein(a: str, b: str) -> int:
    """Bit-parallel edit distance: one column of the table is two integers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, score = full, 0, len(b)
    for c in a:
        eq = where.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        up, down = (((minus << 1) & full) | ~(diagonal | plus)) & full, plus & diagonal
    return score


def damerau(a: str, b: str) -> int:
    """Edit distance in which two letters may swap places with edits between them.

    Common ends don't matter and are cut off first.
    """
    if a == b:
        return 0
    start = _common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = _common_prefix(a[::-1], b[::-1])
    if end:
        a, b = a[:-end], b[:-end]
    if not a or not b:
        return len(a) + len(b)
    width = len(b)
    seen: dict[str, int] = {}
    rows = [list(range(width + 1))]
    for i, x in enumerate(a, 1):
        above, left, last = rows[-1], i, 0
        row = [i]
        for j, y in enumerate(b, 1):
            if x == y:
                left = above[j - 1]
                last_here = j
            else:
                left = 1 + min(above[j - 1], left, above[j])
                last_here = 0
            if last and y in seen:
                k = seen[y]
                swap = rows[k - 1][last - 1] + (i - k) + (j - last) - 1
                if swap < left:
                    left = swap
            row.append(left)
            if last_here:
                last = last_here
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


def jaro(a: str, b: str) -> float:
    """Transposed matches count half each, unrounded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left, right = [True] * len(b), [], []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            left.append(c)
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def with_prefix(j: float, a: str, b: str) -> float:
    """A Jaro similarity raised by a tenth of what it lacks for each of the first four equal letters."""
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def jaro_winkler(a: str, b: str) -> float:
    return with_prefix(jaro(a, b), a, b)


def lcs(a: str, b: str) -> int:
    """Longest common subsequence, one integer for a row of the table."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def dice(a: str, b: str, n: int = 3) -> float:
    x, y = ({s[i : i + n] for i in range(len(s) - n + 1)} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def _rules(locale: str) -> dict:
    found: dict = {}
    for name, x, y, cost, locales in EDIT_RULES:
        if locales is None or locale in locales:
            for pair in ((x, y), (y, x)):
                found.setdefault(pair, []).append((cost, name))
    return found


RULES = {locale: _rules(locale) for locale in ("nl", "de", "en", "generic")}
SPANS = sorted({(len(x), len(y)) for r in RULES.values() for x, y in r} | {(1, 1)})


def weighted_edit(a: str, b: str, locale: str = "generic") -> tuple[float, float, list, list]:
    """(cost, similarity, operations, rules): insertions and deletions cost 1, equal stretches nothing,
    stretches that a rule equates the rule's cost; nothing else can be substituted.

    Operations are (kind, place in a, place in b, from, to, rule). Of equal costs the first wins:
    deletion, insertion, then stretches from the shortest in a, then in b, then by rule.
    """
    a, b = bare(a.lower()), bare(b.lower())
    rules = RULES.get(locale) or _rules(locale)
    cost = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    how: list[list] = [[None] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            best, step = float("inf"), None
            if i:
                best, step = cost[i - 1][j] + 1, (1, 0, None)
            if j and cost[i][j - 1] + 1 < best:
                best, step = cost[i][j - 1] + 1, (0, 1, None)
            for m, n in SPANS:
                if m <= i and n <= j:
                    x, y = a[i - m : i], b[j - n : j]
                    for c, name in [(0.0, None)] if x == y else rules.get((x, y), ()):
                        if cost[i - m][j - n] + c < best:
                            best, step = cost[i - m][j - n] + c, (m, n, name)
            cost[i][j], how[i][j] = best, step
    ops, i, j = [], len(a), len(b)
    while i or j:
        m, n, name = how[i][j]
        i, j = i - m, j - n
        kind = "substitute" if name else "match" if m and n else "delete" if m else "insert"
        ops.append((kind, i, j, a[i : i + m], b[j : j + n], name))
    ops.reverse()
    total, longest = cost[len(a)][len(b)], max(len(a), len(b))
    used = list(dict.fromkeys(o[5] for o in ops if o[5]))
    return total, max(0.0, min(1.0, 1 - total / longest)) if longest else 1.0, ops, used


#: Cells of the cost tables that are filled together; a block is one pair where that alone has more.
BLOCK_CELLS = 1 << 20
#: Texts whose lengths differ by less than this may share a block.
BAND = 8
#: Pairs that are gathered before they are sorted into blocks.
GATHERED = 40_000
#: A bit for each rule of a locale.
RULE_BITS = np.uint16 if max(map(len, RULES.values())) <= 16 else np.uint64


def _letters(texts: list[str], width: int) -> np.ndarray:
    """Code points, a column for each text; row 0 and the rows beyond a text's end hold zeros."""
    padded = np.array(texts, dtype=f"U{width or 1}").view(np.uint32).reshape(len(texts), -1)[:, :width]
    return np.concatenate([np.zeros((1, len(texts)), np.uint32), padded.T])


def _mark_ends(letters: np.ndarray, part: str, marks: np.ndarray, bit: int) -> None:
    """Set ``bit`` in ``marks`` wherever ``part`` ends."""
    rows = len(letters) - len(part)
    if rows > 0:
        ends = letters[1 : 1 + rows] == ord(part[0])
        for k, c in enumerate(part[1:], 2):
            ends &= letters[k : k + rows] == ord(c)
        marks[len(part) :] |= ends.astype(marks.dtype) << bit


def _trace_block(a: list[str], b: list[str], locale: str) -> tuple[list[list[str]], list[int]]:
    """Rules and number of operations of each pair, all tables filled together by diagonals.

    Cell (i, j) of a table lies on the diagonal i + j. It takes the sums of ``weighted_edit`` in the same
    order, so that equal costs are equal here too and the same way comes first. Equal stretches of two
    letters are never better than their letters one by one.

    Steps are 0 for a deletion, 1 for an insertion, 2 or 3 for equal letters, then the rules.
    """
    rules = sorted(((x, y, *min(found, key=lambda r: r[0])) for (x, y), found in RULES[locale].items()), key=lambda r: (len(r[0]), len(r[1])))
    spans: dict = {}
    for k, (s, t, _, _) in enumerate(rules):
        spans[len(s), len(t)] = spans.get((len(s), len(t)), 0) | 1 << k
    n, la, lb = len(a), np.array([*map(len, a)]), np.array([*map(len, b)])
    high, wide = int(la.max()), int(lb.max())
    x, y = _letters(a, high), _letters(b, wide)
    left, right = np.zeros(x.shape, RULE_BITS), np.zeros(y.shape, RULE_BITS)
    for k, (s, t, _, _) in enumerate(rules):
        _mark_ends(x, s, left, k)
        _mark_ends(y, t, right, k)
    if max(x.max(), y.max()) < 1 << 16:
        x, y = x.astype(np.uint16), y.astype(np.uint16)
    y, right = np.ascontiguousarray(y[::-1]), np.ascontiguousarray(right[::-1])
    down = np.array([1, 0, 1, 1, *(len(r[0]) for r in rules)])
    both = down + [0, 1, 1, 1, *(len(r[1]) for r in rules)]
    price = np.array([r[2] for r in rules])
    margin, kept = int(down.max()), int(both.max()) + 1
    costs = [np.full((margin + high + 1, n), np.inf) for _ in range(kept)]
    costs[0][margin] = 0
    how = np.empty((high + 1) * (wide + 1) * n, np.int8)
    diagonals = np.arange(high + wide + 1)
    low, top = np.maximum(0, diagonals - wide), np.minimum(diagonals, high)
    begin = (np.cumsum(top - low + 1) - (top - low + 1)) * n
    for d in range(1, high + wide + 1):
        lo, hi = int(low[d]), int(top[d]) + 1
        of_a, of_b = slice(lo, hi), slice(lo + wide - d, hi + wide - d)
        back = lambda steps, rows: costs[(d - steps) % kept][margin + lo - rows : margin + hi - rows]  # noqa: B023, E731
        now = costs[d % kept]
        now[: margin + lo] = now[margin + hi :] = np.inf
        best = np.add(back(1, 1), 1, out=back(0, 0))
        step = how[begin[d] : begin[d] + best.size].reshape(best.shape)
        insertion = back(1, 0) + 1
        np.less(insertion, best, out=step.view(np.bool_))
        np.minimum(best, insertion, out=best)
        same = back(2, 1) < best
        same &= x[of_a] == y[of_b]
        np.putmask(best, same, back(2, 1))
        same = same.view(np.int8)
        same <<= 1
        step |= same
        met = left[of_a] & right[of_b]
        cells = np.flatnonzero(met != 0)
        if not cells.size:
            continue
        which, best, step = met.ravel()[cells], best.ravel(), step.ravel()
        present = int(np.bitwise_or.reduce(which))
        for (m, k), bits in spans.items():
            if present & bits:
                one = which & RULE_BITS(bits)
                some = np.flatnonzero(one)
                at, rule = cells[some], np.frexp(one[some])[1] - 1
                cost = back(m + k, m).ravel()[at] + price[rule]
                less = np.flatnonzero(cost < best[at])
                at = at[less]
                best[at], step[at] = cost[less], rule[less] + 4
    found: list[list[str]] = [[] for _ in a]
    operations = np.zeros(n, np.int64)
    base = begin - low * n
    at = np.flatnonzero(la + lb)
    i, d = la[at], (la + lb)[at]
    done = 0
    while at.size:
        step = how[base[d] + i * n + at].astype(np.int64)
        ruled = np.flatnonzero(step > 3)
        for p, k in zip(at[ruled].tolist(), step[ruled].tolist(), strict=True):
            found[p].append(rules[k - 4][3])
        i -= down[step]
        d -= both[step]
        done += 1
        if not d.all():
            operations[at[d == 0]] = done
            more = np.flatnonzero(d)
            at, i, d = at[more], i[more], d[more]
    return [list(dict.fromkeys(reversed(f))) for f in found], operations.tolist()


def weighted_traces(a: list[str], b: list[str], locale: str = "generic") -> list[tuple[list[str], int]]:
    """(rules, number of operations) of ``weighted_edit`` for each pair of texts in lower case without
    marks; pairs of like lengths share a block."""
    la, lb = np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64)
    band = la // BAND
    order = np.lexsort((-lb, band))
    found: list = [None] * len(a)
    start = 0
    while start < len(order):
        first = order[start]
        most = max(1, BLOCK_CELLS // int((band[first] + 1) * BAND * (lb[first] + 1)))
        block = order[start : start + most]
        block = block[band[block] == band[first]].tolist()
        traces = zip(*_trace_block([a[p] for p in block], [b[p] for p in block], locale), strict=True)
        for p, trace in zip(block, traces, strict=True):
            found[p] = trace
        start += len(block)
    return found


def weighted_cost(a: str, b: str, locale: str) -> float:
    """Cost of ``weighted_edit`` without its trace, of texts in lower case without marks.

    Where no rule has one side in ``a`` and the other in ``b`` all letters outside of a longest common
    subsequence are deleted or inserted.

    A row starts from deletions everywhere, is lowered where a stretch that ends here meets an equal or
    equated one in ``b``, and is then swept for insertions.
    """
    if a == b:
        return 0.0
    if not any(x in a and y in b for x, y in RULES[locale]):
        return float(len(a) + len(b) - 2 * lcs(a, b))
    width, ends = len(b), {}
    for j, y in enumerate(b, 1):
        ends.setdefault(y, []).append((j, 1, 0.0))
    meets = {x: list(e) for x, e in ends.items()}
    for (x, y), costs in RULES[locale].items():
        j = b.find(y)
        while j >= 0:
            meets.setdefault(x, []).append((j + len(y), len(y), costs[0][0]))
            j = b.find(y, j + 1)
    pairs = {x for x in meets if len(x) == 2}
    rows = [[float(j) for j in range(width + 1)]]
    for i, x in enumerate(a, 1):
        row = [v + 1 for v in rows[-1]]
        before = rows[-1]
        for j, n, c in meets.get(x, ()):
            v = before[j - n] + c
            if v < row[j]:
                row[j] = v
        if i > 1 and a[i - 2 : i] in pairs:
            before = rows[-2]
            for j, n, c in meets[a[i - 2 : i]]:
                v = before[j - n] + c
                if v < row[j]:
                    row[j] = v
        least = row[0]
        for j in range(1, width + 1):
            least += 1
            if row[j] < least:
                least = row[j]
            else:
                row[j] = least
        rows = [rows[-1], row]
    return rows[-1][-1]


def weighted_similarity(a: str, b: str, locale: str) -> float:
    a, b = bare(a), bare(b)
    longest = max(len(a), len(b))
    return max(0.0, min(1.0, 1 - weighted_cost(a, b, locale) / longest)) if longest else 1.0


def _share(part: int, a: str, b: str) -> float:
    return part / max(len(a), len(b))


METRICS = ("levenshtein", "damerau_levenshtein", "jaro", "jaro_winkler", "weighted_edit", "trigram_dice", "lcs")


def all_metrics(a: str, b: str) -> list[float]:
    """Similarities of METRICS, for non-empty strings."""
    near = jaro(a, b)
    return [
        1 - _share(levenshtein(a, b), a, b),
        1 - _share(damerau(a, b), a, b),
        near,
        with_prefix(near, a, b),
        weighted_similarity(a.lower(), b.lower(), "en"),
        dice(a, b),
        _share(lcs(a, b), a, b),
    ]


def _stem_only(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return len(short) >= 4 and len(long) > len(short) and long.startswith(short)


PAIR_FIELDS = ", ".join(f"{m} double" for m in (*METRICS, "prefix", "suffix", "sound"))


@series_udf(PAIR_FIELDS)
def pair_metrics(left: pd.Series, right: pd.Series, left_core: pd.Series, right_core: pd.Series, left_key: pd.Series, right_key: pd.Series) -> pd.DataFrame:
    """Best value of each metric over all pairs of the two sides' forms, with a bare stem marked down
    to 0.7; shared affixes of the cores; similarity of the sound keys. Unknown where a side is empty."""
    rows, memory = [], {}
    for xs, ys, cx, cy, kx, ky in zip(left, right, left_core, right_core, left_key, right_key, strict=True):
        best = None
        for a in xs if xs is not None else ():
            for b in ys if ys is not None else ():
                values = memory.get((a, b))
                if values is None:
                    if len(memory) > 50_000:
                        memory.clear()
                    down = 0.7 if _stem_only(a, b) else 1.0
                    values = memory[a, b] = [v * down for v in all_metrics(a, b)]
                best = values if best is None else list(map(max, best, values))
        affix = (None, None)
        if cx and cy:
            affix = _share(_common_prefix(cx, cy), cx, cy), _share(_common_prefix(cx[::-1], cy[::-1]), cx, cy)
        sound = None if not kx or not ky else 1.0 if kx == ky else jaro_winkler(kx, ky)
        rows.append([*(best or [None] * len(METRICS)), *affix, sound])
    return pd.DataFrame(rows, columns=[*METRICS, "prefix", "suffix", "sound"], dtype="float64")


@series_udf("levenshtein int, damerau int, jaro double, jaro_winkler double, lcs int, lcs_similarity double")
def string_metrics(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The plain metrics of two strings; two empty strings are alike, null gives nulls."""
    rows = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            rows.append([None] * 6)
        else:
            n = lcs(x, y)
            rows.append([levenshtein(x, y), damerau(x, y), jaro(x, y), jaro_winkler(x, y), n, n / max(len(x), len(y)) if x or y else 1.0])
    return pd.DataFrame(
        rows,
        columns=["levenshtein", "damerau", "jaro", "jaro_winkler", "lcs", "lcs_similarity"],
    ).astype({"levenshtein": "Int32", "damerau": "Int32", "lcs": "Int32"})


@series_udf("levenshtein int, damerau int")
def edit_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Edit distances in characters; null gives nulls."""
    rows = [(None, None) if x is None or y is None else (levenshtein(x, y), damerau(x, y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["levenshtein", "damerau"]).astype("Int32")


def weighted_cost_udf(locale: str = "generic"):
    """Cost and similarity of ``weighted_edit`` alone, several times as fast as with its trace."""

    @F.pandas_udf("raw_cost double, similarity double")
    def weighted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                rows.append((None, None))
                continue
            x, y = bare(x.lower()), bare(y.lower())
            cost, longest = weighted_cost(x, y, locale), max(len(x), len(y))
            rows.append((cost, max(0.0, min(1.0, 1 - cost / longest)) if longest else 1.0))
        return pd.DataFrame(rows, columns=["raw_cost", "similarity"], dtype="float64")

    return weighted


WEIGHTED_FIELDS = "raw_cost double, similarity double, operations array<struct<kind:string,a_index:int,b_index:int,source:string,target:string,rule:string>>, rules array<string>"


def weighted_edit_udf(locale: str = "generic"):
    @F.pandas_udf(WEIGHTED_FIELDS)
    def weighted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = ("kind", "a_index", "b_index", "source", "target", "rule")
        rows = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                rows.append([None] * 4)
            else:
                cost, similarity, ops, used = weighted_edit(x, y, locale)
                rows.append([cost, similarity, [dict(zip(names, o, strict=True)) for o in ops], used])
        return pd.DataFrame(rows, columns=["raw_cost", "similarity", "operations", "rules"])

    return weighted


def weighted_trace_udf(locale: str = "generic"):
    """Rules, joined by commas, and number of operations of ``weighted_edit``, of many pairs at a time;
    null gives nulls."""

    def traced(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known = (a.notna() & b.notna()).to_numpy(dtype=bool)
        plain = {t: bare(t.lower()) for side in (a, b) for t in side[known].unique()}
        rows: list = [(None, None)] * len(a)
        traces = weighted_traces([plain[t] for t in a[known]], [plain[t] for t in b[known]], locale)
        for p, (rules, operations) in zip(np.flatnonzero(known).tolist(), traces, strict=True):
            rows[p] = (",".join(rules), operations)
        return pd.DataFrame(rows, columns=["rules", "operations"]).astype({"operations": "Int32"})

    @F.pandas_udf("rules string, operations int")
    def weighted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gathered: list = []
        for batch in batches:
            gathered.append(batch)
            if sum(len(a) for a, _ in gathered) >= GATHERED:
                yield traced(*(pd.concat(side, ignore_index=True) for side in zip(*gathered, strict=True)))
                gathered = []
        if gathered:
            yield traced(*(pd.concat(side, ignore_index=True) for side in zip(*gathered, strict=True)))

    return weighted
