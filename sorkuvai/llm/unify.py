"""Problem 7: one form for text that looks the same.

A table from the Unicode data and a few fixed look-alike lists is checked for conflicts and compiled
into a longest-match transducer over grapheme clusters: one pass replaces invisible characters, odd
blanks, width and compatibility forms, marks written apart, and look-alikes inside a word.

Which texts can change at all is told beforehand by one vectorised table look-up a character, so that
the transducer only runs over the few that do.
"""

from __future__ import annotations

import unicodedata as ucd
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import code_points, pieces

# Letters of other alphabets that look like a Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵԚԜҮүѴӀ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqwvQWYyVI"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυ"
GREEK_AS = "ABEZHIKMNOPTYXovu"
# Small Greek letters that look like a Latin one only among small Latin letters; by themselves they are signs (α, γ), as before capitals (γH2AX).
GREEK_INSIDE = "αγιρϳ"
GREEK_INSIDE_AS = "ayipj"
#: Signs of number that stand around digits and joiners that arrange hieroglyphs: formats by their category, but seen.
SEEN_FORMATS = frozenset((0x110BD, 0x110CD, *range(0x13430, 0x13440)))
# Tamil digits that look like a Tamil letter.
TAMIL_DIGITS = "௧௨௪௭௮"
TAMIL_LETTERS = "கஉசஎஅ"
# Malayalam consonants with virama and joiner, and the letters that look the same.
CHILLU = {"ണ്‍": "ൺ", "ന്‍": "ൻ", "ര്‍": "ർ", "ല്‍": "ൽ", "ള്‍": "ൾ", "ക്‍": "ൿ"}

#: Latin-1 signs that have a compatibility form but a look of their own (²  ª  ½  ´ and so on).
OWN_LOOK = range(0xA8, 0xBF)
#: A text with more than this share of Latin-1 letters and signs above U+00A0 is garbled and left alone.
GARBLED_SHARE = 0.3

BELOW_A1 = bytes(range(0xA1))
TRIGGER, FIRST, SECOND, OTHER_KIND, DIGIT = 1, 2, 4, 8, 16


class Transducer:
    """mapping: what is replaced, longest match first; flags: per code point, the classes above."""

    def __init__(self) -> None:
        mapping: dict[str, str] = {}
        flags = np.zeros(0x110000, np.uint8)
        pairs: set[tuple[str, str]] = set()

        def put(key: str, value: str) -> None:
            if mapping.setdefault(key, value) != value:
                raise ValueError(f"two forms for {key!r}: {mapping[key]!r} and {value!r}")

        for cp in range(0x110000):
            ch = chr(cp)
            kind = ucd.category(ch)
            if kind in ("Cn", "Co", "Cs") or cp in SEEN_FORMATS:
                continue
            if ch == "\r" or kind in ("Zl", "Zp") or cp == 0x85:
                put(ch, "\n")
            elif kind == "Zs" and ch != " " or ch in "\v\f":
                put(ch, " ")
            elif kind in ("Cf", "Cc") and ch not in "\t\n" or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180D:
                put(ch, "")
            elif cp not in OWN_LOOK:
                form = ucd.normalize("NFC", ucd.normalize("NFKC", ch)) if cp >= 0x80 else ch
                if form != ch and ucd.normalize("NFC", ch) != ch or form != ch:
                    put(ch, form.replace(" ", " "))
            parts = ucd.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<" and ucd.normalize("NFC", ch) == ch:
                pairs.add((chr(int(parts[0], 16)), chr(int(parts[1], 16))))
        put("\r\n", "\n")
        for key, value in CHILLU.items():
            put(key, value)
        for value in mapping.values():
            if any(x in mapping for x in value):
                raise ValueError(f"{value!r} would be replaced again")
        self.mapping, self.pairs = mapping, pairs
        for key in mapping:
            if len(key) == 1:
                flags[ord(key)] |= TRIGGER
        for a, b in pairs:
            flags[ord(a)] |= FIRST
            flags[ord(b)] |= SECOND
        for ch in CYRILLIC + GREEK + GREEK_INSIDE:
            flags[ord(ch)] |= OTHER_KIND
        for ch in TAMIL_DIGITS:
            flags[ord(ch)] |= DIGIT
        self.flags = flags
        self.pair_codes = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in pairs], np.int64))
        self.to_latin = str.maketrans(CYRILLIC + GREEK + GREEK_INSIDE, CYRILLIC_AS + GREEK_AS + GREEK_INSIDE_AS)
        self.to_tamil = dict(zip(TAMIL_DIGITS, TAMIL_LETTERS, strict=True))
        single = "".join(regex.escape(x) for x in sorted(mapping) if len(x) == 1)
        many = "|".join(regex.escape(x) for x in sorted(mapping, key=len, reverse=True) if len(x) > 1)
        firsts, seconds = ("".join(sorted({regex.escape(x[k]) for x in pairs})) for k in (0, 1))
        # An emoji with its joiners and selectors is one cluster and stays as it is, and so does a flag with its tags.
        self.cluster = regex.compile(rf"(?P<emoji>\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f|\p{{So}}[\ufe0e\ufe0f\p{{Sk}}]*(?:\u200d\p{{So}}[\ufe0e\ufe0f\p{{Sk}}]*)*)|{many}|[{firsts}][{single}\p{{M}}]*[{seconds}]|[{single}]")
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.tamil_word = regex.compile(rf"(?<![{TAMIL_DIGITS}\p{{Nd}}])[{TAMIL_DIGITS}](?!\p{{Nd}})")
        self.cyrillic = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}]")
        self.odd = regex.compile(rf"[\p{{Script=Cyrillic}}\p{{Script=Greek}}{TAMIL_DIGITS}]")
        self.latin = regex.compile(r"\p{Script=Latin}")
        self.small_latin = regex.compile(r"(?=\p{Ll})\p{Script=Latin}")
        self.single = {k: v for k, v in mapping.items() if len(k) == 1}

    def places(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Of each text that holds something that may be replaced, its number and the places."""
        points, starts = code_points(texts)
        if not len(points):
            return
        f = self.flags[points]
        at = (f & (TRIGGER | OTHER_KIND | DIGIT)) > 0
        second = np.flatnonzero(f[1:] & (f[:-1] << 1) & SECOND) + 1
        if len(second):
            code = points[second - 1].astype(np.int64) << 21 | points[second]
            k = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            at[second[self.pair_codes[k] == code]] = True
        where = np.flatnonzero(at)
        first = np.searchsorted(where, starts)
        for i in np.flatnonzero(first[1:] > first[:-1]):
            yield int(i), (where[first[i] : first[i + 1]] - starts[i]).tolist()

    def garbled(self, text: str) -> bool:
        n = len(text.encode("latin-1", "ignore").translate(None, BELOW_A1))
        return n > GARBLED_SHARE * (len(text) - text.count(" ") - text.count("\n"))

    @lru_cache(maxsize=100_000)
    def out(self, cluster: str) -> str:
        """The form of one cluster."""
        if (whole := self.mapping.get(cluster)) is not None:
            return whole
        return ucd.normalize("NFC", "".join(self.single.get(x, x) for x in cluster))

    def _word(self, m: regex.Match, true_other: bool) -> str:
        word = m.group()
        odd = self.cyrillic.findall(word)
        inside = any(x in GREEK_INSIDE for x in odd)
        if odd and all(x in CYRILLIC or x in GREEK or x in GREEK_INSIDE for x in odd) and (self.small_latin.search(word) if inside else self.latin.search(word) or not true_other):
            return word.translate(self.to_latin)
        if any(x in word for x in TAMIL_DIGITS) and any("அ" <= x <= "்" for x in word):
            return self.tamil_word.sub(lambda d: self.to_tamil[d.group()], word)
        return word

    def whole(self, text: str, true_other: bool) -> str:
        """The form of a text or of a stretch between blanks."""
        text = self.cluster.sub(lambda m: m.group() if m.lastgroup else self.out(m.group()), text)
        if self.odd.search(text):
            text = self.word.sub(lambda m: self._word(m, true_other), text)
        return text

    def true_other(self, text: str) -> bool:
        """Whether the text has Cyrillic or Greek letters that look like no Latin one."""
        return any(x not in CYRILLIC and x not in GREEK for x in self.cyrillic.findall(text))

    def __call__(self, text: str, places: list[int]) -> str:
        """The one form of a text; only the stretches between blanks around the places are rewritten."""
        if self.garbled(text):
            return text
        out, upto, true_other = [], 0, self.true_other(text)
        for at in places:
            if at >= upto:
                start = max(upto, text.rfind(" ", 0, at) + 1)
                end = text.find(" ", at)
                end = len(text) if end < 0 else end
                out += text[upto:start], self.whole(text[start:end], true_other)
                upto = end
        return "".join((*out, text[upto:]))


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def one_form(texts: list[str]) -> list[str]:
    """The one form of each text."""
    t = transducer()
    out = list(texts)
    for i, places in t.places(texts):
        out[i] = t(texts[i], places)
    return out


def _unified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches):
        out = one_form(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array([a != b for a, b in zip(texts, out, strict=True)])], ["doc_id", "text", "changed"])


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer()
    for part, texts in pieces(batches):
        at = [i for i, places in t.places(texts) if t(texts[i], places) != texts[i]]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64()))], ["doc_id"])


def present(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and the columns of the documents whose text is neither null nor empty."""
    return documents.select("doc_id", "text", *columns).where(F.length("text") > 0)


def unify_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text in the one form, changed. Null and empty texts give no row; other columns are ignored."""
    return present(documents).mapInArrow(_unified, "doc_id bigint, text string, changed boolean")


def changed_documents(documents: DataFrame) -> DataFrame:
    """The distinct doc_ids of the documents that aren't in the one form. Null and empty texts give no row."""
    return present(documents).mapInArrow(_changed, "doc_id bigint").distinct()
