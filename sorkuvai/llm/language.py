"""Problem 4: the language of each document and of each stretch of another language in it.

Error-correcting output codes: every class has a codeword of bits; one binary classifier on letter n-grams
predicts each bit, and the codeword of least loss is chosen, the bits weighted by how well each is told
apart on training rows that were held out. What lies nearly as close to a second language is ambiguous.

Tamil has three classes: as it is written, in Latin letters, and mixed with English words; the latter two
are trained on Tamil samples spelled in Latin letters, and put together with words of English ones. What
language a document has is told by its lines. Segments go further: sentences within a line that are surely
of another language than the line are segments of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .quality import common_hashes, natural
from .unify import one_form, present

#: Bits of a codeword are one less than this power of two, or the next ones from more classes on.
CODE_ORDER = 16
GRAM_SIZES = (1, 2, 3, 4)
#: A line this long counts as a language of its document, whatever its share.
LINE_CHARS = 40
#: A line of a document's lesser language counts from this confidence on.
SURE = 0.9
#: Confidence below which a line or document is flagged ambiguous.
AMBIGUOUS = 0.6
#: A sentence is a segment of its own from this confidence and so many characters on.
SEGMENT_SURE, SEGMENT_CHARS = 0.95, 20
#: One training row in so many is held out to weight the bits.
HELD_OUT = 5
#: English words put between the Tamil ones of a mixed training row, for each of those.
MIXED_WORDS = (0.5, 2.0, 5.0)
#: Labelled rows that are used for training at most; the first in the order of their text's hash.
TRAINING_ROWS = 50_000
WORDS_KEPT = 200_000
ROMAN, MIXED = "ta-Latn", "ta-en"
LANGUAGE_OF = {ROMAN: "ta", MIXED: "ta"}
SENTENCE = regex.compile(r"[^.?!।…]+[.?!।…]*\s*|[.?!।…]+\s*")
WORD = regex.compile(r"(?:\p{L}\p{M}*)+")
ADDRESS = regex.compile(r"\S*(?:@|://|www\.)\S*")
# Tamil letters as they are commonly written in Latin ones.
CONSONANTS = dict(zip("கஙசஞடணதநபமயரலவழளறனஜஷஸஹ", "k ng s nj t n th n p m y r l v zh l r n j sh s h".split(), strict=True))
VOWELS = dict(zip("அஆஇஈஉஊஎஏஐஒஓ", "a aa i ee u oo e ae ai o oa".split(), strict=True))
SIGNS = dict(zip("ாிீுூெேைொோ", "aa i ee u oo e ae ai o oa".split(), strict=True))
VIRAMA = "்"


def in_latin(text: str) -> str:
    """Tamil spelled in Latin letters."""
    out = []
    for ch in text:
        if ch in CONSONANTS:
            out.append(CONSONANTS[ch] + "a")
        elif ch in SIGNS or ch == VIRAMA:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1] + SIGNS.get(ch, "")
        else:
            out.append(VOWELS.get(ch, ch))
    return "".join(out)


def code_table(n: int) -> np.ndarray:
    """n codewords (-1, 1), rows of a Hadamard matrix: any two differ in half of its order of bits."""
    h = np.array([[1]])
    while len(h) < max(CODE_ORDER, n):
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:].astype(np.int8)


def mixed_rows(tamil: list[str], english: list[str]) -> list[str]:
    """Tamil texts with words of English ones between theirs, in several shares."""
    words = [w for x in english for w in x.split()]
    out, at = [], 0
    for k, x in enumerate(tamil if words else []):
        share, line, due = MIXED_WORDS[k % len(MIXED_WORDS)], [], 0.0
        for w in x.split():
            line.append(w)
            due += share
            while due >= 1:
                line.append(words[at % len(words)])
                at, due = at + 1, due - 1
        out.append(" ".join(line))
    return out


def ngrams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[k : k + n] for n in GRAM_SIZES for k in range(len(w) - n + 1)]


class Classifier:
    """Trained on (language, text) rows."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        rows = [(lang, x.lower()) for lang, x in rows if lang and x]
        tamil, english = ([x for lang, x in rows if lang == name] for name in ("ta", "en"))
        rows += [(ROMAN, in_latin(x)) for x in tamil] + [(MIXED, x) for x in mixed_rows(tamil, english)]
        self.classes = sorted({lang for lang, _ in rows}) or ["und"]
        self.languages = sorted({LANGUAGE_OF.get(c, c) for c in self.classes})
        #: Which language each class is.
        self.of = np.array([self.languages.index(LANGUAGE_OF.get(c, c)) for c in self.classes])
        self.codes = code_table(len(self.classes))
        self.bits = self.codes.shape[1]
        self.index: dict[str, int] = {}
        at = {c: k for k, c in enumerate(self.classes)}
        samples = []
        for lang, x in rows:
            grams = [self.index.setdefault(g, len(self.index)) for w in WORD.findall(x) for g in ngrams(w)]
            samples.append((at[lang], np.array(grams, np.int64)))
        held = [x for k, x in enumerate(samples) if k % HELD_OUT == 0]
        trial = self._fitted([x for k, x in enumerate(samples) if k % HELD_OUT])
        right = np.zeros(self.bits)
        for k, g in held:
            right += (trial[g].sum(0) * self.codes[k]) > 0
        self.bit_weight = (np.maximum(right / max(1, len(held)) - 0.5, 0.01) * 2).astype(np.float32)
        self.weights = self._fitted(samples).astype(np.float32)
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((1024, self.bits + 1), np.float32)

    def _fitted(self, samples: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Of each n-gram, how much it speaks for 1 at each bit."""
        counts = np.zeros((len(self.classes), max(1, len(self.index))))
        for k, g in samples:
            np.add.at(counts[k], g, 1)
        share = counts / np.maximum(1, counts.sum(1, keepdims=True))
        floor = 1 / max(1, counts.sum() / len(self.classes))
        weights = np.zeros((len(self.index) + 1, self.bits))
        for b in range(self.bits):
            one, zero = (share[self.codes[:, b] == s].mean(0) if (self.codes[:, b] == s).any() else np.zeros(counts.shape[1]) for s in (1, -1))
            weights[: counts.shape[1], b] = np.log((one + floor) / (zero + floor))
        return weights

    def _row(self, word: str) -> int:
        k = len(self.known)
        if k == len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        rows = [x for x in map(self.index.get, ngrams(word)) if x is not None]
        self.vectors[k, : self.bits] = self.weights[rows].sum(0)
        self.vectors[k, self.bits] = len(rows)
        self.known[word] = k
        return k

    def sums(self, units: list[list[str]]) -> np.ndarray:
        """What the n-grams of each unit (words in lower case) say about each bit, and how many there are."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known = self.known
        for w in {w for x in units for w in x}.difference(known):
            self._row(w)
        flat = np.fromiter((known[w] for x in units for w in x), np.int64)
        sums = np.zeros((len(units), self.bits + 1), np.float32)
        size = np.array([len(x) for x in units])
        some = np.flatnonzero(size)
        if len(some):
            sums[some] = np.add.reduceat(self.vectors[flat], np.cumsum(size[some]) - size[some], axis=0)
        return sums

    def decided(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language (its number) and confidence of units by their sums; -1 where no n-gram is known."""
        n = np.maximum(sums[:, self.bits :], 1)
        margin = sums[:, : self.bits] / np.sqrt(n)
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.codes[None], -30, 30)))
        loss = (loss * self.bit_weight).sum(2) / self.bit_weight.sum()
        like = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        best = self.of[loss.argmin(1)]
        sure = np.where(self.of[None] == best[:, None], like, 0).sum(1) / like.sum(1)
        return np.where(sums[:, self.bits] == 0, -1, best), sure

    def decide(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        return self.decided(self.sums(units))


def words_of(text: str) -> list[str]:
    """The words that tell the language, in lower case; mail and web addresses don't."""
    return WORD.findall((ADDRESS.sub(" ", text) if "@" in text or "www" in text or "://" in text else text).lower())


Stretch = tuple[int, int, str, float]


def line_languages(texts: list[str], model: Classifier) -> list[tuple[list[Stretch], list[Stretch]]]:
    """Of each text, (start, length, language, confidence) of the lines that have letters, and of their parts by sentences."""
    lines, parts, units = [], [], []
    for k, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            if line.strip():
                lines.append((k, start, len(line), len(units)))
                for m in SENTENCE.finditer(line):
                    parts.append((start + m.start(), len(m.group())))
                    units.append(words_of(m.group()))
            start += len(line) + 1
    out: list[tuple[list[Stretch], list[Stretch]]] = [([], []) for _ in texts]
    if not lines:
        return out
    sums = model.sums(units)
    first = np.array([x[3] for x in lines])
    best, sure = (x.tolist() for x in model.decided(np.add.reduceat(sums, first, axis=0)))
    part_best, part_sure = (x.tolist() for x in model.decided(sums))
    for j, (k, start, n, at) in enumerate(lines):
        if best[j] < 0:
            continue
        lang = model.languages[best[j]]
        out[k][0].append((start, n, lang, sure[j]))
        for i in range(at, lines[j + 1][3] if j + 1 < len(lines) else len(parts)):
            other = part_best[i] >= 0 and part_best[i] != best[j] and part_sure[i] >= SEGMENT_SURE and parts[i][1] >= SEGMENT_CHARS
            out[k][1].append((*parts[i], model.languages[part_best[i]], part_sure[i]) if other else (*parts[i], lang, sure[j]))
    return out


def languages_of(lines: list[tuple[int, int, str, float]]) -> tuple[str | None, float, set[str]]:
    """The main language, its confidence, and all languages of a document's lines."""
    total: dict[str, float] = {}
    weighted: dict[str, float] = {}
    for _, n, lang, p in lines:
        total[lang] = total.get(lang, 0) + n
        weighted[lang] = weighted.get(lang, 0) + n * p
    if not total:
        return None, 0.0, set()
    main = max(sorted(weighted), key=weighted.get)
    whole = sum(total.values())
    found = {lang for lang, n in total.items() if n > whole / 2}
    found |= {lang for _, n, lang, p in lines if n >= LINE_CHARS and (p >= SURE or lang == main)}
    return main, weighted[main] / total[main], found


def segments_of(parts: list[Stretch]) -> list[dict]:
    """Parts of one language that follow each other, put together; the confidence is their mean by characters."""
    runs: list[dict] = []
    for start, n, lang, p in parts:
        if runs and runs[-1]["lang"] == lang:
            last = runs[-1]
            last["confidence"] = (last["confidence"] * last["n"] + p * n) / (last["n"] + n)
            last["n"] += n
            last["length"] = start + n - last["start"]
        else:
            runs.append({"start": start, "length": n, "lang": lang, "confidence": p, "n": n})
    return [{k: x[k] for k in ("start", "length", "lang", "confidence")} for x in runs]


def _classified(rows: list[tuple[str, str]], common: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(rows)
        segment = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for part, texts in pieces(batches):
            if common is not None:
                keep = natural(texts, common)
                part, texts = part.filter(pa.array(keep)), [x for x, ok in zip(texts, keep.tolist(), strict=True) if ok]
            found = line_languages(one_form(texts), model)
            judged = [languages_of(lines) for lines, _ in found]
            mains, sures = [x[0] for x in judged], [x[1] for x in judged]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(mains, pa.string()), pa.array(sures, pa.float64()), pa.array([m is None or s < AMBIGUOUS for m, s in zip(mains, sures, strict=True)], pa.bool_()),
                 pa.array([sorted(x[2]) for x in judged], pa.list_(pa.string())), pa.array([segments_of(parts) for _, parts in found], segment)],
                ["doc_id", "lang", "confidence", "ambiguous", "found", "segments"],
            )

    return run


OUT = "doc_id bigint, lang string, confidence double, ambiguous boolean, found array<string>, segments array<struct<start: int, length: int, lang: string, confidence: double>>"


def _training(samples: DataFrame) -> list[tuple[str, str]]:
    """At most TRAINING_ROWS labelled rows; those with a null take no part."""
    rows = samples.where("lang is not null and length(text) > 0").select("lang", "text").distinct().orderBy(F.xxhash64("text"), "text", "lang").limit(TRAINING_ROWS).collect()
    return [(r.lang, r.text) for r in rows]


def document_languages(documents: DataFrame, samples: DataFrame, common_words: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, confidence, ambiguous, found, segments of each document with text.

    lang is the language of most of the text, found every language that most of it or a line of LINE_CHARS
    characters is in; segments are the runs of sentences of one language (start and length in characters of
    the one form). Without any letters lang is null and found empty. With common_words, documents that aren't
    natural (see quality) give no row. Repeated rows give repeated rows.
    """
    common = common_hashes(common_words) if common_words is not None else None
    return present(documents).mapInArrow(_classified(_training(samples), common), OUT)


def wrong_labels(documents: DataFrame, samples: DataFrame, codes: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, found_lang: the languages of natural documents that their label doesn't name. A label that isn't in codes names none."""
    found = document_languages(documents, samples, common_words).select("doc_id", F.explode("found").alias("found_lang")).distinct()
    labels = documents.select("doc_id", F.lower(F.trim("lang")).alias("label")).where("label is not null")
    names = codes.where("label is not null").select(F.lower(F.trim("label")).alias("label"), F.col("lang").alias("found_lang")).distinct()
    named = labels.join(names, "label").select("doc_id", "found_lang").distinct()
    return found.join(named, ["doc_id", "found_lang"], "left_anti")
