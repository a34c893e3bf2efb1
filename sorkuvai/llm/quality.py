"""Problem 5: statistics of each text, and which texts aren't natural prose or verse.

Length, symbol, punctuation, bullet and common-word statistics of a batch of texts are taken at once, from
arrays of its code points; then the fixed thresholds of published web-corpus filters are applied, and each
failure is recorded by its reason. A rule's name says where its value was published:

- gopher (Rae et al. 2021, MassiveText): symbols a word, lines that start with a bullet or end in an
  ellipsis, words with a letter, stop words, repeated lines and characters, mean word length;
- fineweb (Penedo et al. 2024): lines that end in punctuation, short lines, lines a word.

Some of them refuse what is natural here: verse has neither line ends nor long lines, agglutinated words are
long, and many texts are short. So stop words and line ends only count together, short lines only where
common words are rare too, words may be up to 20 letters long instead of 10, and no text is refused for
having fewer than 50 words. Rules without a published value (own) are for what the others let through:
heaps and tables that keep words and line ends, dumps, unreadable characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import code_points, mix64, pieces
from .unify import present

# Published thresholds.
SYMBOLS_A_WORD, BULLET_LINES, ELLIPSIS_LINES, WORDS_WITH_LETTER, STOP_WORDS = 0.1, 0.9, 0.3, 0.8, 2
DUPLICATE_LINES, DUPLICATE_CHARACTERS, SHORTEST_MEAN = 0.3, 0.2, 3
LINE_ENDS, SHORT_LINES, SHORT_LINE, LINES_A_WORD = 0.12, 0.67, 30, 0.3
#: Published as 10, for English.
LONGEST_MEAN = 20
#: Texts of fewer words, or lines, aren't judged by the rules on words, or lines.
LEAST_WORDS, LEAST_LINES, LEAST_ELLIPSES = 20, 4, 10
#: Short lines are refused unless this share of the words is common; those of hardly more than one word anyway.
LINES_COMMON, ONE_WORD = 0.1, 1.5
#: Words a line as in verse. Such lines without common words or ends are a heap only if hardly a word comes again.
VERSE_LINE, HEAP_DISTINCT = (3, 12), 0.95
#: Own values, shares of the text: characters in lines with separators, words that are numbers or mix letters and digits, special characters, letters of another encoding.
TABLE, NUMBERS, SPECIAL, GARBLED = 0.5, 0.35, 0.1, 0.3
#: Hardly a sentence end, and a comma after nearly every other word.
HEAP_ENDS, HEAP_COMMAS = 0.02, 0.45
#: Common words that are looked up at most.
WORDS_AT_MOST = 1_000_000

BULLETS = "•‣▶◀◦■□▪▫●○◆◇–—-*·→+#»>"
ENDS = ".?!।…\"”)'"
SENTENCE_ENDS = ".?!。！？؟۔።։।"
STRIP = ".,;:!?()[]\"'|।…-"
ORDINARY = ".,?!।:;'\"()-–—…’‘“”"
SEPARATORS = "|\t;»¦·•"
BY_WORDS = frozenset(("gopher stop words, fineweb line ends", "fineweb lines", "gopher word length"))
#: Letters of scripts that don't part words by blanks, by the names of their code points; a text mostly in those isn't judged by its words.
UNPARTED = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))

LETTER, BLANK, DIGIT, END, SENTENCE, BULLET, STRIPPED, ODD, LATIN1, SEPARATOR, UNPARTED_LETTER, HEX_LETTER = (1 << k for k in range(12))
STATISTICS = (
    "words int, mean_word_length double, symbols_a_word double, bullet_lines double, ellipsis_lines double, words_with_letter double, common_words int, common_share double, "
    "ends_in_punctuation double, duplicate_lines double, duplicate_characters double, short_lines double, lines_a_word double, line_words double, "
    "sentence_ends double, comma_share double, distinct_share double, table_share double, number_share double, special_share double, garbled_share double, unparted_share double"
)
NAMES = [x.split()[0] for x in STATISTICS.split(", ")]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point the classes above, and the small letter."""
    flags, low = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        kind = category(ch)
        if kind == "Cn":
            continue
        if kind[0] == "L":
            flags[cp] |= LETTER
            if len(small := ch.lower()) == 1:
                low[cp] = ord(small)
        if ch.isspace():
            flags[cp] |= BLANK
        if kind == "Nd":
            flags[cp] |= DIGIT
        if kind == "Co" or cp == 0xFFFD or kind[0] not in "LMN" and kind not in ("So", "Cf") and not ch.isspace() and ch not in ORDINARY:
            flags[cp] |= ODD
        if 0xA1 <= cp <= 0xFF:
            flags[cp] |= LATIN1
    for mark, characters in ((END, ENDS), (SENTENCE, SENTENCE_ENDS), (BULLET, BULLETS), (STRIPPED, STRIP), (SEPARATOR, SEPARATORS), (HEX_LETTER, "abcdefABCDEF")):
        for ch in characters:
            flags[ord(ch)] |= mark
    for first, last in UNPARTED:
        flags[first : last + 1] |= np.where(flags[first : last + 1] & LETTER, UNPARTED_LETTER, 0).astype(np.uint16)
    return flags, low


class Hashes:
    """Hashes of stretches of an array of code points, alike for stretches alike."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, points: np.ndarray) -> None:
        powers = np.full(len(points) + 1, self.BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers[:-1], out=self.sums[1:])
        back = np.full(len(points) + 1, self.BACK, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words in small letters."""
    points, starts = code_points(words)
    return np.unique(Hashes(points)(starts[:-1], starts[1:])) if len(points) else np.zeros(0, np.uint64)


def _new(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a stretch is the first of its kind in its text; owner is ascending."""
    order = np.lexsort((h, owner))
    first = np.ones(len(h), bool)
    first[order[1:]] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return first


def statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The STATISTICS of texts; of one of nothing but blanks all are 0. common: word_hashes of the common words."""
    n = len(texts)
    points, starts = code_points([x + "\n" for x in texts])
    table, low = tables()
    flags = table[points]
    blank = (flags & BLANK) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(starts, start, "right") - 1
    by_text = lambda x, of=owner: np.bincount(of, x, n)
    upto = lambda x: np.concatenate(([0], np.cumsum(x)))

    def held(mark: int) -> np.ndarray:
        """How many characters of a class each word has."""
        s = upto((flags & mark) > 0)
        return s[end] - s[start]

    is_comma, is_dot = points == ord(","), points == ord(".")
    length, letters, digits = end - start, held(LETTER), held(DIGIT)
    words = by_text(None)
    per_word, signs = np.maximum(words, 1), np.maximum(by_text(length), 1)

    # Words as they are looked up: small letters, without the punctuation around them.
    kept = np.flatnonzero((flags & STRIPPED) == 0)
    a = np.searchsorted(kept, start)
    b = np.searchsorted(kept, end)
    bare = b > a
    first, last = start.copy(), start.copy()
    first[bare], last[bare] = kept[a[bare]], kept[b[bare] - 1] + 1
    h = Hashes(low[points])(first, last)
    is_common = np.isin(h, common) & bare
    other = end - start - letters - digits
    number = (digits > 0) & (((letters == 0) & (other <= np.maximum(digits, 3))) | ((length >= 6) & (digits + held(HEX_LETTER) == length)))

    # Lines that aren't blank, from their first word to their last.
    line = upto(points == 10)[start]
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(line)) - 1
    from_, to = start[head], end[tail] if len(line) else start[head]
    of = owner[head]
    lines, size = by_text(None, of), to - from_
    per_line, in_lines = np.maximum(lines, 1), np.maximum(by_text(size, of), 1)
    new = _new(of, Hashes(points)(from_, to))
    ended = (flags[to - 1] & END) > 0 if len(to) else np.zeros(0, bool)
    dots = upto(is_dot)
    ellipsis = (points[to - 1] == ord("…")) | (dots[to] - dots[np.maximum(to - 3, from_)] == 3) if len(to) else ended
    one = np.minimum(from_ + 1, len(points) - 1)
    bullet = ((flags[from_] & BULLET) > 0) & blank[one] if len(from_) else ended
    # Separators: tabs and bars, and dots or underscores in rows as in a table of contents.
    runs = np.zeros(len(points), bool)
    if len(points) > 3:
        runs[3:] = np.isin(points[3:], (ord("."), ord("_"))) & (points[3:] == points[2:-1]) & (points[2:-1] == points[1:-2]) & (points[1:-2] == points[:-3])
    parts = upto(((flags & SEPARATOR) > 0) | runs)
    between = parts[to] - parts[from_]
    table_line = (between >= 2) | ((points[from_] == ord("|")) if len(from_) else False)

    is_symbol = (points == ord("#")) | (points == ord("…"))
    is_symbol[2:] |= is_dot[2:] & is_dot[1:-1] & is_dot[:-2]
    symbols = upto(is_symbol)
    return {
        "words": words, "mean_word_length": by_text(length) / per_word, "symbols_a_word": by_text(symbols[end] - symbols[start]) / per_word,
        "bullet_lines": by_text(bullet, of) / per_line, "ellipsis_lines": by_text(ellipsis, of) / per_line, "words_with_letter": by_text(letters > 0) / per_word,
        "common_words": by_text(is_common), "common_share": by_text(is_common) / per_word, "ends_in_punctuation": by_text(ended, of) / per_line,
        "duplicate_lines": by_text(~new, of) / per_line, "duplicate_characters": by_text(size * ~new, of) / in_lines,
        "short_lines": by_text(size < SHORT_LINE, of) / per_line, "lines_a_word": lines / per_word, "line_words": words / per_line,
        "sentence_ends": by_text(held(SENTENCE)) / per_word, "comma_share": by_text(upto(is_comma)[end] - upto(is_comma)[start]) / per_word,
        "distinct_share": by_text(_new(owner, h)) / per_word, "table_share": by_text(size * table_line, of) / in_lines,
        "number_share": by_text(length * number) / signs, "special_share": by_text(held(ODD)) / signs, "garbled_share": by_text(held(LATIN1)) / signs, "unparted_share": by_text(held(UNPARTED_LETTER)) / signs,
    }


def failures(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each reason, which texts fail by it; a text without words fails by none."""
    n, line, common = s["words"], s["line_words"], s["common_share"]
    of_lines = n >= LEAST_LINES * np.maximum(line, 1e-9)
    verse = (line >= VERSE_LINE[0]) & (line <= VERSE_LINE[1]) & (s["distinct_share"] <= HEAP_DISTINCT)
    rules = {
        "gopher symbols": s["symbols_a_word"] > SYMBOLS_A_WORD,
        "gopher bullets": s["bullet_lines"] > BULLET_LINES,
        "gopher ellipses": (s["ellipsis_lines"] > ELLIPSIS_LINES) & (n >= LEAST_ELLIPSES * line),
        "gopher words without letters": s["words_with_letter"] < WORDS_WITH_LETTER,
        "gopher duplicate lines": (s["duplicate_lines"] > DUPLICATE_LINES) & of_lines,
        "gopher duplicate characters": (s["duplicate_characters"] > DUPLICATE_CHARACTERS) & of_lines,
        "gopher word length": (n >= LEAST_LINES) & ((s["mean_word_length"] < SHORTEST_MEAN) | (s["mean_word_length"] > LONGEST_MEAN)),
        "gopher stop words, fineweb line ends": (n >= LEAST_WORDS) & (s["common_words"] < STOP_WORDS) & (s["ends_in_punctuation"] <= LINE_ENDS) & (s["sentence_ends"] < HEAP_ENDS) & ~verse,
        "fineweb lines": ((s["short_lines"] >= SHORT_LINES) | (s["lines_a_word"] > LINES_A_WORD)) & of_lines & (s["ends_in_punctuation"] <= 1 - SHORT_LINES) & ((common < LINES_COMMON) | (line <= ONE_WORD)),
        "own word heap": (s["sentence_ends"] < HEAP_ENDS) & (s["comma_share"] > HEAP_COMMAS),
        "own table": s["table_share"] > TABLE,
        "own numbers": s["number_share"] > NUMBERS,
        "own special characters": s["special_share"] > SPECIAL,
        "own garbled": s["garbled_share"] > GARBLED,
    }
    parted = s["unparted_share"] <= 0.5
    return {k: v & (n > 0) & (parted if k in BY_WORDS else True) for k, v in rules.items()}


def natural(texts: list[str], common: np.ndarray) -> np.ndarray:
    """Which texts fail by no rule."""
    return ~np.any(list(failures(statistics(texts, common)).values()), axis=0) if texts else np.zeros(0, bool)


def judge(text: str, common: frozenset[str]) -> tuple[dict[str, float], list[str]]:
    """The statistics and reasons of one text."""
    s = statistics([text], word_hashes(sorted(common)))
    return {k: float(v[0]) for k, v in s.items()}, [k for k, v in failures(s).items() if v[0]]


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The common words in lower case; a list of more than WORDS_AT_MOST is refused, as every task holds it."""
    words = [r[0] for r in common_words.where("word is not null").select(F.lower("word")).distinct().limit(WORDS_AT_MOST + 1).collect()]
    if len(words) > WORDS_AT_MOST:
        raise ValueError(f"more than {WORDS_AT_MOST} common words")
    return frozenset(words)


def common_hashes(common_words: DataFrame) -> np.ndarray:
    return word_hashes(sorted(common_set(common_words)))


def _judged(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            s = statistics(texts, common)
            failed = failures(s)
            reasons = [[k for k, hit in zip(failed, row, strict=True) if hit] for row in np.stack(list(failed.values()), 1)]
            columns = [pa.array(s[x].astype(np.int32)) if x in ("words", "common_words") else pa.array(s[x].astype(np.float64)) for x in NAMES]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(reasons, pa.list_(pa.string()))], ["doc_id", *NAMES, "reasons"])

    return run


def _unnatural(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(~natural(texts, common)))], ["doc_id"])

    return run


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, the STATISTICS, reasons (empty for natural text), for every document with text; repeated rows give repeated rows.

    A text of nothing but blanks has zeros and no reason.
    """
    return present(documents).mapInArrow(_judged(common_hashes(common_words)), f"doc_id bigint, {STATISTICS}, reasons array<string>")


def unnatural_documents(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The distinct doc_ids of the documents that aren't for the most part natural prose or verse."""
    return present(documents).mapInArrow(_unnatural(common_hashes(common_words)), "doc_id bigint").distinct()


def reasons_by_source(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """source, reason, documents; a document counts under each of its reasons. A null source stays null."""
    rows = text_statistics(documents, common_words).select("doc_id", F.explode("reasons").alias("reason")).distinct()
    sources = documents.select("doc_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"])
    return rows.join(sources, "doc_id").groupBy("source", "reason").agg(F.count("*").alias("documents"))
