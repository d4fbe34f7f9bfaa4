"""Text statistics for each document that tell prose from lists, tables and junk.

A text is cut into chunks at fixed places. Each chunk gives partial counts and boundary states: the
open line at either end with the open word at either end of that, and the open paragraphs of the lines
between. States join associatively, so the chunks of a huge text are merged in a tree; ratios and rule
outcomes are derived at the end.

Definitions
* words: pieces between blanks; their length is in letters and digits; a piece without any isn't a word;
* symbols: visible characters that are neither letters nor digits;
* lines: pieces between line ends (CR LF, CR and LF count alike) with a visible character; a line ends
  in punctuation if its last visible character is one of . ! ? : ; … or a closing quote or bracket;
* common words: the most usual words of five languages, as listed;
* paragraphs: lines of which each after the first goes on with a sentence that was wrapped: the line before
  doesn't end in punctuation, and the line starts with a small letter, or starts with a letter or digit
  and ends in punctuation; a line of noise, as below, stands alone;
* running text: paragraphs with at least three words of which at least ``PROSE_SHARE`` are sentence words,
  the words that hold sentences together and don't stand in names of goods; a word of one letter is one
  only if it stands plainly or is elided (l'eau, owner's). Lines of noise are never running text: those
  with more than ``NOISE_SYMBOLS`` of symbols, or with several words that mix letters and digits which
  make up more than ``NOISE_MIXED`` of the words.

Defined results
* null text: null statistics and no outcome; empty or blank text: zero counts, null ratios, ``prose`` null;
* ties at a limit: the outcome holds from the limit on; repeated rows: each gets its statistics;
* very long words: they count in full, but are never common; very long texts: counted whole;
* empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.runtime import cut

#: Words that join sentences, by language (our own choice); goods and names rarely hold them.
SENTENCE_WORDS = frozenset(
    (
        # en
        "the a an is are was were be been being has have had that which who whom whose it its this these those not no nor but if than then when while because although though whether "
        "will would can could may might must should does did do he she they we you his her their our your by at on as from into before after about there here what how so such any all only also now never "
        "am i my me him them us very just more most some without "
        # de
        "der die das den dem des ein eine einer eines einem einen ist sind war waren sei hat haben hatte hatten wird werden wurde wurden dass daß ob nicht kein keine nie nur auch aber oder denn weil wenn als wie "
        "es er sie wir ich sich auf im am zum zur vom beim nach bei durch über unter zwischen gegen man noch schon so da dann daher jedoch dennoch diese dieser dieses diesem kann können muss soll niemand "
        # fr
        "le la les l une est sont était étaient a ont avait que qu qui ne n pas plus se s sa son ses ce c cette ces il elle ils elles nous vous on dans par sur au aux selon lors même mais ou où si comme donc car "
        "être fut furent leur leurs y peut doit bien très sans entre avant après "
        # es
        "el la los las una es son era fue ha han había que no se su sus lo le les este esta ese esa eso al por si sí como pero aunque según cuando donde más ya muy sin sobre entre antes después ni o nadie está "
        # nl
        "het een is zijn was waren heeft hebben had dat die dit deze niet geen bij op om te ook maar of wel als dan door aan uit over naar tot nog al er hij zij wij ze men wordt worden werd werden kan moet zal hoe wat waar volgens "
    ).split()
)

#: The most usual words of the same languages: those above and the joining words of noun phrases.
COMMON_WORDS = SENTENCE_WORDS | frozenset(
    "of and or to in for with de du des d et en à pour avec un y con para del und in mit für von zu van en voor met tegen in de".split()
)

PROSE_SHARE = 0.1
NOISE_SYMBOLS = 0.25
NOISE_MIXED = 0.15

#: Share of visible characters in running text from which a document is prose.
PROSE_DOCUMENT = 0.5
PROSE_WORDS = 3
WORD_CAP = 64
ENDS = frozenset(".!?:;…\"'»”’)]")
LINE_END = re.compile(r"\r\n?|\n")
APOSTROPHE = re.compile("['’]")
#: One letter with nothing but the punctuation of sentences around it.
PLAIN = re.compile(r"[\"'«»“”„‘’(\[¿¡]*\w[\"'»”’)\]]*[.,;:!?…]*[\"'»”’)\]]*")

COUNTS = ("chars", "visible", "letters", "digits", "words", "word_chars", "common", "lines", "ended", "prose_lines", "prose_visible")
PARAGRAPH = ("words", "sentence", "lines", "visible")
LINE = ("visible", "letters", "digits", "words", "word_chars", "common", "sentence", "mixed")


#: Sentence words and common words in use in this process.
_IN_USE = [SENTENCE_WORDS, COMMON_WORDS]


def use_words(sentence: frozenset, common: frozenset) -> None:
    """Count with these words from here on; what is remembered of pieces belongs to a pair of lists."""
    if _IN_USE[0] != sentence or _IN_USE[1] != common:
        _IN_USE[:] = [sentence, common]
        PIECES.clear()


def _word(prefix: str, alnum: int) -> tuple[int, int, int, int, int]:
    """words, word_chars, common, sentence, mixed of one finished word."""
    if not alnum:
        return 0, 0, 0, 0, 0
    mixed = int(any(map(str.isdigit, prefix)) and any(map(str.isalpha, prefix)))
    if len(prefix) >= WORD_CAP:
        return 1, alnum, 0, 0, mixed
    low = prefix.lower()
    parts = [p for p in (x.strip("".join(c for c in x if not c.isalnum())) for x in APOSTROPHE.split(low)) if p]
    plain = PLAIN.fullmatch(low) or (len(parts) > 1 and all(map(str.isalpha, parts)) and max(map(len, parts)) > 1)
    sentence, common = _IN_USE
    joins = any(p in sentence and (len(p) > 1 or plain) for p in parts)
    return 1, alnum, int(any(p in common for p in parts)), int(joins), mixed


def _alnum(s: str) -> int:
    return len(s) if s.isalnum() else sum(map(str.isalnum, s))


class _Pieces(dict):
    """What each piece between blanks adds to a line: visible, letters, digits, then its word."""

    def __missing__(self, p: str) -> tuple:
        letters, alnum = sum(map(str.isalpha, p)), _alnum(p)
        found = (len(p), letters, alnum - letters, *_word(p[:WORD_CAP], alnum))
        if len(p) <= WORD_CAP and len(self) < 200_000:
            self[p] = found
        return found


PIECES = _Pieces()


def line_state(s: str) -> list:
    """[counts of LINE, head, tail, open, last, first]: open is whether no blank was seen, head then is
    the word so far; head and tail are [prefix, alnum] of the open words at either end; first and last
    are visible characters."""
    pieces, none = s.split(), ["", 0]
    if not pieces:
        return [[0] * len(LINE), none, none, not s, "", ""]
    visible = letters = digits = words = word_chars = common = sentence = mixed = 0
    for a, b, c, d, e, f, g, h in map(PIECES.__getitem__, pieces):
        visible += a
        letters += b
        digits += c
        words += d
        word_chars += e
        common += f
        sentence += g
        mixed += h
    left, right = not s[0].isspace(), not s[-1].isspace()
    ends = [pieces[0]] * left + [pieces[-1]] * (right and not (left and len(pieces) == 1))
    for p in ends:
        _, _, _, d, e, f, g, h = PIECES[p]
        words, word_chars, common, sentence, mixed = words - d, word_chars - e, common - f, sentence - g, mixed - h
    bits = [[p[:WORD_CAP], _alnum(p)] for p in ends]
    head = bits.pop(0) if left else none
    whole = left and right and len(pieces) == 1
    return [
        [visible, letters, digits, words, word_chars, common, sentence, mixed],
        head,
        bits.pop() if bits else none,
        whole,
        pieces[-1][-1],
        pieces[0][0],
    ]


def _glue(a: list, b: list) -> list:
    return [(a[0] + b[0])[:WORD_CAP], a[1] + b[1]]


def join_lines(a: list, b: list) -> list:
    """State of two stretches of one line, one after the other."""
    counts, last, first = [x + y for x, y in zip(a[0], b[0], strict=True)], b[4] or a[4], a[5] or b[5]
    if a[3] and b[3]:
        return [counts, _glue(a[1], b[1]), ["", 0], True, last, first]
    if a[3]:
        return [counts, _glue(a[1], b[1]), b[2], False, last, first]
    if b[3]:
        return [counts, a[1], _glue(a[2], b[1]), False, last, first]
    for k, v in enumerate(_word(*_glue(a[2], b[1]))):
        counts[3 + k] += v
    return [counts, a[1], b[2], False, last, first]


def _close(line: list, total: list) -> list:
    """Add a finished line to the totals (the characters themselves are counted with the chunk); returns
    it as paragraphs."""
    visible, letters, digits, words, word_chars, common, sentence, mixed = line[0]
    if not visible:
        return [False, True, [0] * len(PARAGRAPH), None]
    for bit in (line[1], line[2]):
        w, c, m, s, x = _word(*bit)
        words, word_chars, common, sentence, mixed = words + w, word_chars + c, common + m, sentence + s, mixed + x
    ended = line[4] in ENDS
    for k, v in enumerate((0, visible, letters, digits, words, word_chars, common, 1, int(ended))):
        total[k] += v
    if visible - letters - digits > NOISE_SYMBOLS * visible or mixed > max(1, NOISE_MIXED * words):
        return [False, True, [0] * len(PARAGRAPH), None]
    return [line[5].islower() or (ended and line[5].isalnum()), ended, [words, sentence, 1, visible], None]


def _judge(paragraph: list, total: list) -> None:
    """Add a finished paragraph to the totals if it is running text."""
    words, sentence, lines, visible = paragraph
    if words >= PROSE_WORDS and sentence >= PROSE_SHARE * words:
        total[-2] += lines
        total[-1] += visible


def join_paragraphs(a: list | None, b: list | None, total: list) -> list | None:
    """Paragraphs of neighbouring lines: [whether the first line can go on with a sentence, whether the
    last line ends one, first paragraph, last paragraph or None if it is the first]. Those that are
    finished go to the totals."""
    if a is None or b is None:
        return a or b
    left, right = a[3] or a[2], b[2]
    if b[0] and not a[1]:
        both = [x + y for x, y in zip(left, right, strict=True)]
        if a[3] is None:
            return [a[0], b[1], both, b[3]]
        if b[3] is None:
            return [a[0], b[1], a[2], both]
        _judge(both, total)
        return [a[0], b[1], a[2], b[3]]
    if a[3] is not None:
        _judge(left, total)
    if b[3] is not None:
        _judge(right, total)
    return [a[0], b[1], a[2], b[3] or right]


def chunk_state(s: str) -> list:
    """[totals of closed lines, first line, last line or None, paragraphs of the lines between or None,
    whether it starts with LF, whether it ends in CR]; the first line is still open to the left, the last
    to the right; without a line end there is only the first."""
    lines = LINE_END.split(s)
    total, between = [0] * len(COUNTS), None
    total[0] = len(s)
    for x in lines[1:-1]:
        between = join_paragraphs(between, _close(line_state(x), total), total)
    return [total, line_state(lines[0]), line_state(lines[-1]) if len(lines) > 1 else None, between, s[:1] == "\n", s[-1:] == "\r"]


def join_chunks(a: list, b: list) -> list:
    """State of two neighbouring stretches. A line end split between CR and LF makes no line."""
    if not a[0][0] or not b[0][0]:
        return a if a[0][0] else b
    total = [x + y for x, y in zip(a[0], b[0], strict=True)]
    if a[2] is None and b[2] is None:
        return [total, join_lines(a[1], b[1]), None, None, a[4], b[5]]
    if a[2] is None:
        return [total, join_lines(a[1], b[1]), b[2], b[3], a[4], b[5]]
    if b[2] is None:
        return [total, a[1], join_lines(a[2], b[1]), a[3], a[4], b[5]]
    middle = None if a[5] and b[4] else _close(join_lines(a[2], b[1]), total)
    between = join_paragraphs(join_paragraphs(a[3], middle, total), b[3], total)
    return [total, a[1], b[2], between, a[4], b[5]]


def finish(state: list) -> list:
    """The totals with all lines and paragraphs closed."""
    total = list(state[0])
    found = join_paragraphs(_close(state[1], total), state[3], total)
    if state[2] is not None:
        found = join_paragraphs(found, _close(state[2], total), total)
    for paragraph in found[2:]:
        if paragraph is not None:
            _judge(paragraph, total)
    return total


def text_counts(
    rows: DataFrame, key: str, text: str, chunk: int = 16_384, fan_in: int = 64, words: tuple[frozenset, frozenset] | None = None
) -> DataFrame:
    """(key, COUNTS...), one row per row of ``rows``; ``key`` may repeat or be null.

    ``words`` are the sentence words and the common words, by default those of five languages.

    One scan cuts every text into chunks of at most ``chunk`` characters and counts them where they lie. A
    text of one chunk is finished there; of the others only the states are written down, under a number
    of their row, and merged ``fan_in`` at a time. The texts themselves never move.
    """
    fields = ", ".join(f"{c} long" for c in COUNTS)
    none = [None] * len(COUNTS)
    sentence, common = words or (SENTENCE_WORDS, COMMON_WORDS)

    @F.pandas_udf(f"{fields}, state string")
    def counted(texts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        use_words(sentence, common)
        out = []
        for t, alone in zip(texts, whole, strict=True):
            if t is None:
                out.append([*none, None])
            elif alone:
                out.append([*finish(chunk_state(t)), None])
            else:
                out.append([*none, json.dumps(chunk_state(t))])
        return pd.DataFrame(out, columns=[*COUNTS, "state"]).astype(dict.fromkeys(COUNTS, "Int64"))

    @F.pandas_udf(fields)
    def closed(states: pd.Series) -> pd.DataFrame:
        use_words(sentence, common)
        return pd.DataFrame([finish(json.loads(s)) for s in states], columns=list(COUNTS)).astype("Int64")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        use_words(sentence, common)
        states = [json.loads(s) for s in pdf.sort_values("i")["s"]]
        joined = states[0]
        for s in states[1:]:
            joined = join_chunks(joined, s)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "i": [pdf["i"].min() // fan_in], "s": [json.dumps(joined)]})

    piece = lambda i, t: F.struct(i.cast("long").alias("i"), t.alias("t"))
    places = F.sequence(F.lit(0), F.ceil(F.length("t") / chunk).cast("int") - 1)
    pieces = F.transform(places, lambda i: piece(i, F.substring(F.col("t"), i * chunk + 1, F.lit(chunk))))
    base = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumns({
        "id": F.monotonically_increasing_id(), "parts": F.greatest(F.ceil(F.length("t") / chunk), F.lit(1)),
    })
    cells = F.when(F.col("parts") > 1, pieces).otherwise(F.array(piece(F.lit(0), F.col("t"))))
    flat = base.select("k", "id", "parts", F.explode(cells).alias("x"))
    seen = cut(flat.select("k", "id", "parts", "x.i", counted("x.t", F.col("parts") <= 1).alias("c")))
    done = seen.filter("parts <= 1").select("k", *[f"c.{c}" for c in COUNTS])
    long = seen.filter("parts > 1")
    parts = long.agg(F.max("parts")).first()[0] or 1
    if parts > 1:
        states = long.select("id", "i", F.col("c.state").alias("s"))
        while parts > 1:
            group = states.groupBy("id", F.floor(F.col("i") / fan_in).alias("g"))
            states = group.applyInPandas(merge, "id long, i long, s string")
            parts = -(-parts // fan_in)
        whole = states.select("id", closed("s").alias("c")).join(long.filter("i = 0").select("id", "k"), "id")
        done = done.unionByName(whole.select("k", "c.*"))
    return done.withColumnRenamed("k", key)


def text_quality(
    rows: DataFrame, key: str, text: str, chunk: int = 16_384, words: tuple[frozenset, frozenset] | None = None
) -> DataFrame:
    """Counts, ratios and the rule outcomes; ``words`` as in ``text_counts``, for texts in other languages.

    ``prose``: at least PROSE_DOCUMENT of the visible characters stand in running text. ``kind`` names what
    else it is: ``junk`` (symbols, endless or repeated words, hardly any letters), ``table`` (many
    digits or separators in short lines) or ``list``.
    """
    c = text_counts(rows, key, text, chunk, words=words)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = c.withColumns({
        "mean_word_length": ratio("word_chars", "words"),
        "symbol_ratio": F.when(F.col("visible") > 0, (F.col("visible") - F.col("letters") - F.col("digits")) / F.col("visible")),
        "digit_ratio": ratio("digits", "visible"),
        "ended_line_share": ratio("ended", "lines"),
        "common_word_share": ratio("common", "words"),
        "prose_share": ratio("prose_visible", "visible"),
    })
    prose = F.when(F.col("visible") > 0, F.col("prose_share") >= PROSE_DOCUMENT)
    junk = (F.col("symbol_ratio") > 0.5) | (F.col("mean_word_length") > 40) | F.col("words").isin(0)
    kind = F.when(prose, "prose").when(junk, "junk").when(
        (F.col("digit_ratio") > 0.15) | (F.col("symbol_ratio") > 0.15),
        "table",
    ).otherwise("list")
    return out.withColumn("prose", prose).withColumn("kind", F.when(prose.isNotNull(), kind))
