"""Duplicates: the first in an order stays."""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip
from .storage import checkpointed


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, nulls first; rows of a null key all stay.

    An aggregation, not a window: rows of one key are cut down to one where they are read, so that a key with
    a third of all rows never comes together in a task. Rows equal in the order are told apart by their other
    columns, so all columns must have an order.
    """
    keyed = rows.withColumn("_key", key)
    columns = [*order, *(c for c in rows.columns if c not in order)]
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct(*columns)).alias("_row"))
    kept = first.select(*(F.col("_row")[c].alias(c) for c in rows.columns))
    return kept.unionByName(keyed.where("_key is null").drop("_key"))


def line_key(line: Column) -> Column:
    """Lines are the same if they are but for white space at their ends."""
    return F.md5(ustrip(line))


def document_key(text: Column) -> Column:
    """The first 64 bits of a text's hash, in hexadecimal digits."""
    return F.substring(F.md5(text), 1, 16)


def unseen(rows: DataFrame, key: Column, seen: DataFrame) -> DataFrame:
    """The rows whose key isn't in the column `key` of seen; incremental form of first_wins."""
    return rows.withColumn("key", key).join(seen.select("key").distinct(), "key", "left_anti").drop("key")


def dedup_stats(rows: DataFrame, key: Column) -> DataFrame:
    """total, unique_lines, duplicates, ratio; rows of a null key don't count.

    Counted in two steps, so that a key with a third of all rows is pre-aggregated where it is read.
    """
    n = rows.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_lines"))
    return out.select("total", "unique_lines", (F.col("total") - F.col("unique_lines")).alias("duplicates"), ((F.col("total") - F.col("unique_lines")) / F.greatest("total", F.lit(1))).alias("ratio"))


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct runs of `size` characters of a text in lower case; a shorter text is its own only one."""
    low = F.lower(F.trim(text))
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda k: F.substring(low, k, F.lit(size))))
    return F.when(F.length(low) < size, F.array(low)).otherwise(cut)


def _cut(low: str, size: int) -> set[str]:
    return {low[k : k + size] for k in range(len(low) - size + 1)} or {low}


PRIME = (1 << 31) - 1


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """A number below PRIME for each run of `size` characters, all at once; a shorter text has one."""
    return _hashed(text, size) % np.uint64(PRIME)


def _hashed(text: str, size: int) -> np.ndarray:
    points = np.frombuffer(text.ljust(size, "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def minhash(text: Column, hashes: int = 117, size: int = 5, seed: int = 1) -> Column:
    """The least value of each of some universal hash functions over a text's shingles (see shingles); null for null.

    An Arrow function: as built-ins the 117 minima would go over a text's shingles one by one.
    """
    draw = random.Random(seed)
    a, b = (np.array([draw.randrange(1, PRIME) for _ in range(hashes)], np.uint64) for _ in "ab")

    def one(x: str) -> np.ndarray:
        h = np.unique(shingle_hashes(x.lower().strip(), size))
        least = np.full(hashes, PRIME, np.uint64)
        for start in range(0, len(h), 4096):  # bounds the table of a very long text
            least = np.minimum(least, ((h[start : start + 4096, None] * a + b) % PRIME).min(0))
        return least.astype(np.int64)

    @F.arrow_udf("array<bigint>")
    def signature(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in texts.to_pylist()], pa.list_(pa.int64()))

    return signature(text)


def band_keys(signatures: DataFrame, bands: int = 9, rows: int = 13) -> DataFrame:
    """doc_id, band, band_hash of a table with doc_id and signature."""
    keys = F.array(*(F.xxhash64(F.slice("signature", b * rows + 1, rows)) for b in range(bands)))
    return signatures.select("doc_id", F.posexplode(keys).alias("band", "band_hash"))


#: Keys that are gone through in one task at a time.
KEYS_AT_ONCE = 500_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys in the order of doc_id, with the least kept document of the bucket -> doc_id, keep, dup_of of each document."""
    first: dict[tuple[int, int], int] = {}
    doc, mine, met, out = None, [], None, []

    def settle() -> None:
        if doc is not None:
            out.append((doc, met is None, met))
            if met is None:
                for x in mine:
                    first.setdefault(x, doc)

    for batch in batches:
        for d, band, h, kept in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if d != doc:
                settle()
                doc, mine, met = d, [], None
            before = [x for x in (kept, first.get((band, h)), met) if x is not None and x < d]
            met = min(before) if before else None
            mine.append((band, h))
    settle()
    columns = zip(*out, strict=True) if out else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["doc_id", "keep", "dup_of"])


def _settled_in_order(placed: DataFrame, keys: int) -> DataFrame:
    """The least unsettled documents, with about `keys` keys at most but one document at least, settled in one task."""
    still = placed.where("keep is null")
    n = still.count()
    if n > keys:
        last = still.agg(F.percentile_approx("doc_id", keys / n, 10_000).alias("last")).first().last
        still = still.where(F.col("doc_id") <= last)
    kept = placed.where("keep").groupBy("band", "band_hash").agg(F.min("doc_id").alias("kept"))
    rows = still.join(kept, ["band", "band_hash"], "left").select("doc_id", "band", "band_hash", "kept")
    return rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_in_order, "doc_id bigint, keep boolean, dup_of bigint")


def greedy_keep(nodes: DataFrame, keys: DataFrame, rounds: int = 100) -> DataFrame:
    """doc_id, keep, dup_of: a document is dropped if a kept one before it shares one of its buckets.

    nodes: doc_id. keys: doc_id, band, band_hash. The result is that of going through the documents in the
    order of doc_id, dropped ones leaving no trace. Each round settles every document that no unsettled one
    stands before in any of its buckets, or that a kept one does. Only the least kept and the least
    unsettled document of each bucket are worked out, so a bucket of any size costs no more than its rows.
    dup_of is the least kept document that it met when it was settled.

    A chain in which each document shares a bucket only with the next settles one document a round. So after
    `rounds` rounds, or once a round settles less than a tenth of what is open, the least open documents are
    gone through in order, KEYS_AT_ONCE keys in a task at a time, until nothing is open. That is exact, since
    all documents before them are settled then.
    """
    keys = keys.where("doc_id is not null")
    several = keys.groupBy("band", "band_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = checkpointed(keys.join(several, ["band", "band_hash"]).distinct())
    linked = shared.select("doc_id").distinct()
    alone = nodes.select("doc_id").distinct().join(linked, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("keep"), F.lit(None).cast("bigint").alias("dup_of"))
    state = linked.select("doc_id", F.lit(None).cast("boolean").alias("keep"), F.lit(None).cast("bigint").alias("dup_of"))
    was_open, done = None, 0
    while True:
        placed = shared.join(state.select("doc_id", "keep"), "doc_id")
        still_open = state.where("keep is null").count()
        if not still_open:
            return alone.union(state)
        if done >= rounds or was_open is not None and still_open > 0.9 * was_open:
            now = _settled_in_order(placed, KEYS_AT_ONCE).select("doc_id", F.col("keep").alias("now"), F.col("dup_of").alias("of"))
            state = checkpointed(state.join(now, "doc_id", "left").select("doc_id", F.coalesce("keep", "now").alias("keep"), F.coalesce("dup_of", "of").alias("dup_of")))
            was_open = still_open
            continue
        least = placed.groupBy("band", "band_hash").agg(F.min(F.when(F.col("keep"), F.col("doc_id"))).alias("kept"), F.min(F.when(F.col("keep").isNull(), F.col("doc_id"))).alias("open"))
        seen = placed.where("keep is null").join(least, ["band", "band_hash"]).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
        joined = state.join(seen, "doc_id", "left")
        settled = F.when(F.col("keep").isNotNull(), F.col("keep")).when(F.col("kept") < F.col("doc_id"), False).when(F.col("open") >= F.col("doc_id"), True)
        state = checkpointed(joined.select("doc_id", settled.alias("keep"), F.when(F.col("keep").isNull() & (F.col("kept") < F.col("doc_id")), F.col("kept")).otherwise(F.col("dup_of")).alias("dup_of")))
        was_open, done = still_open, done + 1


def shared_pairs(sets: DataFrame, least: float, size: str = "n") -> DataFrame:
    """a < b, similarity of documents whose sets of items are at least so similar (Jaccard).

    sets: doc_id, item, n (the set's size). Only a set's first items in the order of rarity can be the first
    common one of a similar pair, so only those are joined; the pairs found are then counted in full.
    """
    rare = sets.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = sets.join(rare, "item").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "item")))
    unique = sets.groupBy("doc_id").agg(F.max(size).alias("all_n")).join(ranked.groupBy("doc_id").agg(F.count("*").alias("seen")), "doc_id")
    prefix = ranked.join(unique, "doc_id").where(F.col("rank") + F.col("all_n") - F.col("seen") <= F.col("all_n") - F.ceil(F.lit(least) * F.col("all_n")) + 1)
    left, right = (prefix.select("item", F.col("doc_id").alias(x), F.col("all_n").alias(f"n_{x}")) for x in "ab")
    found = left.join(right, "item").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))).select("a", "b", "n_a", "n_b").distinct()
    mine = found.join(sets.select(F.col("doc_id").alias("a"), "item"), "a")
    both = mine.join(sets.select(F.col("doc_id").alias("b"), "item"), ["b", "item"]).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    return both.withColumn("similarity", F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


#: Classes of set sizes: each begins at so many items.
CLASSES = [1.25**c for c in range(120)]
#: Pairs of documents of a slot that are held and counted at a time, about.
PAIRS_HELD = 500_000


def _groups(c: int) -> tuple[int, int, int]:
    """Blocks, groups a block, and groups that a pair at 0.8 has in common in one block at least, of the sets compared in a class.

    Sets of sizes a and b at 0.8 differ in (a + b) / 9 items at most, here in a quarter of the class's upper bound, and
    in one of the blocks in no more than their mean. Each item that differs spoils one group; the others are the same.
    """
    most = int(CLASSES[c + 1] / 4 + 1e-6)
    blocks = min(8, max(1, most // 12))
    shared = 10 if most >= 80 else 7 if most >= 40 else 4 if most >= 20 else 2 if most >= 6 else 1
    return blocks, most // blocks + shared + 2 + most // blocks // 5, shared


def _grouped(low: str, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """class, size (negative in the class below its own), block and name of each group that the text's shingles fall into."""
    h = np.unique(_hashed(low, size))
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    n, own = len(h), bisect_right(CLASSES, len(h)) - 1
    for c in (own, own - 1) if own else (own,):
        blocks, groups, shared = _groups(c)
        high = CLASSES[c + 1]
        differ = int((min(2.25 * n, n + high) if c == own else n + high) / 9 + 1e-9)
        g = ((h >> np.uint64(32)) * np.uint64(blocks * groups)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        g = g[start]
        name = (np.add.reduceat(mixed, start) ^ (g + np.uint64(1)) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        block = (g // np.uint64(groups)).astype(np.int64)
        # Two sets may have just empty groups in common. Where one has too many, they get names as well; sets with few don't need them.
        few = np.flatnonzero(np.bincount(block, minlength=blocks) < differ // blocks + shared)
        if len(few):
            empty = np.setdiff1d((few[:, None] * groups + np.arange(groups)).ravel(), g.astype(np.int64))
            name = np.concatenate((name, (empty.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)))
            block = np.concatenate((block, empty // groups))
        yield c, n if c == own else -n, block, (name >> np.uint64(32)).astype(np.uint32)


def _slots(size: int):
    """doc_id, low -> the names of groups by slot, a block of a class; one row a slot and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            for doc, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c, n, block, name in _grouped(low, size):
                    found.setdefault(c, []).append((doc, n, block, name))
            rows = []
            for c, each in found.items():
                docs, sizes = np.array([x[0] for x in each], np.int64), np.array([x[1] for x in each], np.int64)
                owner = np.repeat(np.arange(len(each), dtype=np.uint32), [len(x[2]) for x in each])
                block, name = (np.concatenate([x[k] for x in each]) for k in (2, 3))
                order = np.argsort(block, kind="stable")
                ends = np.searchsorted(block[order], np.arange(_groups(c)[0] + 1))
                rows += [(c * 8 + b, docs.tobytes(), sizes.tobytes(), owner[at].tobytes(), name[at].tobytes()) for b in range(len(ends) - 1) if len(at := order[ends[b] : ends[b + 1]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["slot", "docs", "sizes", "owner", "name"])

    return run


def _together(table: pa.Table) -> pa.Table:
    """The documents of a slot that have as many groups in common as a pair at 0.8, and may be one by their sizes."""
    columns = [table.column(k).to_pylist() for k in ("docs", "sizes", "owner", "name")]
    docs, sizes = (np.concatenate([np.frombuffer(x, np.int64) for x in c]) for c in columns[:2])
    starts = np.cumsum([0, *(len(x) // 8 for x in columns[0])])
    owner = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + at for x, at in zip(columns[2], starts, strict=False)])
    name = np.concatenate([np.frombuffer(x, np.uint32) for x in columns[3]])
    least = _groups(table.column("slot")[0].as_py() // 8)[2]
    # The postings come by document. Those of a name lie together in the order, by document as well; each meets the ones after it.
    order = np.argsort(name, kind="stable")
    place, listed, name = np.empty(len(order), np.int64), owner[order], name[order]
    place[order] = np.arange(len(order))
    begins = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    ends = np.repeat(np.append(begins[1:], len(name)), np.diff(np.append(begins, len(name))))
    after = ends[place] - place - 1
    meets = np.flatnonzero(after)
    owner, place, after = owner[meets], place[meets], after[meets]
    upto, cuts, found = np.cumsum(after), [0], []
    while cuts[-1] < len(owner):  # whole documents, at least one
        at = np.searchsorted(upto, (upto[cuts[-1] - 1] if cuts[-1] else 0) + PAIRS_HELD)
        cuts.append(int(np.searchsorted(owner, owner[min(max(at, cuts[-1]), len(owner) - 1)], "right")))
    for lo, hi in pairwise(cuts):
        n = after[lo:hi]
        x, y = np.repeat(owner[lo:hi], n), listed[np.repeat(place[lo:hi] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())]
        p, q = sizes[x], sizes[y]
        may = (x != y) & ((p > 0) | (q > 0)) & (5 * np.minimum(np.abs(p), np.abs(q)) >= 4 * np.maximum(np.abs(p), np.abs(q)))
        pairs, times = np.unique(x[may] << 32 | y[may], return_counts=True)
        found.append(pairs[times >= least])
    pairs = np.concatenate([np.zeros(0, np.int64), *found])
    x, y = docs[pairs >> 32], docs[pairs & 0xFFFFFFFF]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _compared(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, one, other in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one, other = _cut(one, size), _cut(other, size)
                common = len(one & other)
                if (similarity := common / (len(one) + len(other) - common)) >= least:
                    out.append((a, b, similarity))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return run


def similar_documents(documents: DataFrame, size: int = 5) -> DataFrame:
    """a < b, similarity of documents whose sets of shingles are at least 0.8 alike (Jaccard); of rows of one doc_id the least text counts.

    Exact. Single shingles of one language are in too many documents to be joined, even the rarest of each, so what
    is joined are groups of a set's shingles, cut by hash so that a pair at 0.8 must have some in common.
    """
    once = documents.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", F.lower(F.trim("text")).alias("low"))
    slots = once.mapInArrow(_slots(size), "slot int, docs binary, sizes binary, owner binary, name binary")
    pairs = slots.groupBy("slot").applyInArrow(_together, "a bigint, b bigint").distinct()
    first, second = (once.select(F.col("doc_id").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "low_a", "low_b")
    return both.mapInArrow(_compared(size, 0.8), "a bigint, b bigint, similarity double")
