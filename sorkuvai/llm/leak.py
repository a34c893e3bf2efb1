"""Problem 9: passages of evaluation items in documents.

Items are cut into windows, and so are documents. A window's fingerprint is the SimHash of its words (and of
their neighbours, in passages). The fingerprints are cut into one block more than the radius: whatever
differs in at most so many bits agrees in one block at least, so that looking up every block finds all
fingerprints within the radius. What is found is compared shingle by shingle, each weighted by the rarity of
its word among the items, and counts from a given similarity on.

Two sizes of windows answer two questions. Passages are windows of WINDOW words at every place of an item:
which documents hold that many consecutive words of it. Whole items with changed words are looked for in
windows of the item's size, the largest of SIZES that it has words for, within a radius that a changed word
doesn't leave (see NEAR_RADIUS).

The items are the query set. They are taken in blocks of at most ITEMS_AT_ONCE, so that what a task
holds has a bound whatever the number of items; up to that many, documents are read once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix64, pieces
from .unify import one_form, present

WINDOW = 8
RADIUS = 3
BITS = 64
ITEMS_AT_ONCE = 20_000
#: Sizes of the windows of whole items.
SIZES = (8, 12, 16, 24, 32, 48, 64)
#: A changed word of 16 moves some 7 bits in the mean, of 24 some 6; of an item's windows one or another stays within 7 in more than nine of ten cases (see the tests).
NEAR_RADIUS, NEAR_SIMILARITY = 7, 0.8
WORDS_KEPT = 400_000
NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{No}]+")


def words_of(texts: list[str]) -> list[list[str]]:
    """The words of each text: one form, lower case, everything but letters, marks and digits as blanks."""
    return [NOT_WORD.sub(" ", x.lower()).split() for x in one_form(texts)]


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each `size` consecutive words (fewer rows than words by size - 1): of the words and of each two neighbours."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for start in range(0, len(out), 100_000):
        part = h[start : start + 100_000 + size - 1]
        pairs = mix64(part[:-1] ^ (part[1:] << np.uint64(1)))
        total = np.zeros((len(part) - size + 1, BITS), np.int8)
        for x, n in ((part, size), (pairs, size - 1)):
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
            for k in range(n):
                total += bits[k : k + len(total)]
        out[start : start + len(total)] = np.packbits(total * 2 > 2 * size - 1, axis=1).view(np.uint64).ravel()
    return out


def word_fingerprints(h: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """SimHash of each so many consecutive words, by their size, from running sums of the words' bits (modulo 256, which no window reaches)."""
    out = {n: np.zeros(max(0, len(h) - n + 1), np.uint64) for n in sizes}
    for start in range(0, len(h) if sizes else 0, 100_000):
        part = h[start : start + 100_000 + max(sizes) - 1]
        total = np.zeros((len(part) + 1, BITS), np.uint8)
        np.cumsum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8, out=total[1:])
        for n in sizes:
            if len(part) >= n:
                prints = np.packbits(total[n:] - total[:-n] > n // 2, axis=1).view(np.uint64).ravel()[:100_000]
                out[n][start : start + len(prints)] = prints
    return out


class Blocks:
    """An index of fingerprints that finds all within a radius."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int).tolist()
        self.cuts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.blocks = []
        for shift, mask in self.cuts:
            key = (prints >> shift & mask).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.blocks.append((order, np.searchsorted(key[order], np.arange(int(mask) + 2))))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the given fingerprints and of the index's that differ in at most `radius` bits, each pair once."""
        found = [np.zeros(0, np.int64)]
        for (shift, mask), (order, cut) in zip(self.cuts, self.blocks, strict=True):
            key = (prints >> shift & mask).astype(np.int64)
            for start in range(0, len(prints), 100_000):
                part = key[start : start + 100_000]
                n = cut[part + 1] - cut[part]
                left = np.repeat(np.arange(start, start + len(part)), n)
                right = order[np.repeat(cut[part], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)]
                close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
                found.append(left[close].astype(np.int64) << 32 | right[close])
        both = np.unique(np.concatenate(found))
        return both >> 32, both & 0xFFFFFFFF


class Items:
    """The windows of some items (passages, or of their own size), with an index of their fingerprints for each size."""

    def __init__(self, items: list[tuple[int, str]], whole: bool = False) -> None:
        self.words = words_of([x for _, x in items])
        self.df = Counter(w for x in self.words for w in set(x))
        self.n = len(items)
        hasher, prints = Words(), {}
        #: By size: the item and the place in it of each fingerprint.
        self.where: dict[int, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in items]
        for k, x in enumerate(self.words):
            size = max((n for n in SIZES if n <= len(x)), default=0) if whole else WINDOW
            if size and len(x) >= size:
                h = hasher(x)
                f = word_fingerprints(h, (size,))[size] if whole else fingerprints(h, size)
                prints.setdefault(size, []).append(f)
                self.where.setdefault(size, []).extend((k, j) for j in range(len(f)))
        self.whole = whole
        self.index = {n: Blocks(np.concatenate(f), NEAR_RADIUS if whole else RADIUS) for n, f in sorted(prints.items())}

    def weight(self, word: str) -> float:
        return log(1 + self.n / (1 + self.df[word]))

    def found(self, flat: list[str], ends: np.ndarray, hasher: Words, least: float) -> Iterator[tuple[int, int, float]]:
        """(number of the text, item, similarity) of the windows in texts whose words are in one list."""
        h = hasher(flat)
        prints = word_fingerprints(h, tuple(self.index)) if self.whole else {n: fingerprints(h, n) for n in self.index}
        for n, index in self.index.items():
            left, right = index.near(prints[n])
            owner, last = np.searchsorted(ends, left, "right"), np.searchsorted(ends, left + n - 1, "right")
            for i, d, e, j in zip(left.tolist(), owner.tolist(), last.tolist(), right.tolist(), strict=True):
                if d == e and (s := self.similarity(flat[i : i + n], n, j)) >= least:
                    yield d, self.ids[self.where[n][j][0]], s

    def similarity(self, window: list[str], size: int, number: int) -> float:
        """Weighted share of the shingles (words, and neighbours) that a window and an item's window have in common."""
        k, j = self.where[size][number]
        mine = self.words[k][j : j + size]
        if mine == window:
            return 1.0
        a, b = (Counter([*x, *zip(x, x[1:], strict=False)]) for x in (mine, window))
        w = {s: self.weight(s) if isinstance(s, str) else (self.weight(s[0]) + self.weight(s[1])) / 2 for s in a | b}
        return sum(n * w[s] for s, n in (a & b).items()) / sum(n * w[s] for s, n in (a | b).items())


def _searched(items: list[tuple[int, str]], whole: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = Items(items, whole), Words()
        for part, texts in pieces(batches):
            docs = part.column(0).to_pylist()
            words = words_of(texts)
            best: dict[tuple[int, int], float] = {}
            for d, item, s in index.found([w for x in words for w in x], np.cumsum([len(x) for x in words]), hasher, least):
                best[docs[d], item] = max(best.get((docs[d], item), 0), s)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(list(best.values()), pa.float64())], ["doc_id", "item_id", "similarity"])

    return run


def _search(documents: DataFrame, items: DataFrame, whole: bool, least: float) -> DataFrame:
    rows = items.select("item_id", "text").where("item_id is not null and length(text) > 0").distinct().orderBy("item_id", "text").toLocalIterator()
    texts, found, block = present(documents), None, []

    def search(block: list) -> DataFrame:
        part = texts.mapInArrow(_searched(block, whole, least), "doc_id bigint, item_id bigint, similarity double")
        return part if found is None else found.union(part)

    for row in rows:
        block.append((row.item_id, row.text))
        if len(block) == ITEMS_AT_ONCE:
            found, block = search(block), []
    if block or found is None:
        found = search(block)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def leaks(documents: DataFrame, items: DataFrame, least: float = 1.0) -> DataFrame:
    """doc_id, item_id, similarity: documents that hold WINDOW consecutive words of an item.

    similarity is that of the best window; with `least` 1 only words in the same order count. Items and
    documents of fewer than WINDOW words hold no window and give no row, nor do null texts. Repeated rows
    give one row.
    """
    return _search(documents, items, False, least)


def near_leaks(documents: DataFrame, items: DataFrame, least: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity: documents that hold an item, or a stretch of its window's size, whole or with words changed.

    The window's size is the largest of SIZES that the item has words for; items of fewer words than the
    least size give no row. similarity is that of the best window.
    """
    return _search(documents, items, True, least)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, split, documents: the items that leaked, with the number of documents that hold a passage of each."""
    n = leaks(documents, items).groupBy("item_id").count().withColumnRenamed("count", "documents")
    return items.select("item_id", "suite", "split").distinct().join(n, "item_id")
