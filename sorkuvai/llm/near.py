"""Problems 2 and 6: texts that are the same but for small edits, and those that cross the splits.

T-occurrence search with DivideSkip. A text is its set of five-character sequences in the order of their
hashes, cut into parts; a part with just this content is an inverted list, of the texts that have it so.
Texts that are alike have T lists in common at least. Each text's lists are divided by their length, which
one table of counts tells for all: all but the T - HITS longest are merged, and a pair that comes together
in HITS of them is a candidate; the longest are never merged but binary-searched for the candidates alone,
and those that reach T in all are compared exactly. As all texts order their lists alike, a pair with T
lists in common has HITS of the short ones in common, so that none is lost; and a list that many texts share
is merged only for a text that has no shorter ones.

The merge is a sort-merge join of the short lists, which walks them in order as a heap would, in as many
tasks as it takes; adaptive execution splits a list that is long all the same.

Sets of fewer than 2**SAMPLED_FROM sequences are cut into M groups by hash, empty ones count too. A pair
that differs in d sequences has T = M - d groups in common, so that none is lost. Of larger sets, LISTS to
2 * LISTS runs of RUN neighbouring sequences are the parts, those that begin with a sequence whose second
hash is below the limit of the size class; T is what a pair at exactly 0.8 misses with a chance of MISSED at
most. Runs of single sequences would not do: in texts of one language every sequence has a long list.

Copies are collapsed to one key (a hash of the folded text) before anything is paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed
from .batches import CHARS_AT_ONCE, bitmap, code_points, marked, mix64, pieces
from .unify import one_form, present

GRAM = 5
SIMILARITY = 0.8
#: Short lists in which a pair must come together.
HITS = 2
#: Size classes are powers of two; sets from this one on are cut into runs, smaller ones into groups.
SAMPLED_FROM = 9
LISTS, RUN = 48, 6
MISSED = 1e-5
#: Groups that two sets of the largest difference have in common at least, where no pair may be missed.
SPARE = 4
#: A set differs by this share of its size at most from one alike, and from a smaller one alike.
DIFFER, DIFFER_LARGER = 0.25, 2 / 9
NAME_BITS = 40
#: Buckets of the table of counts: for each text, at least and at most (a byte each, held by every task).
BUCKETS_A_TEXT, FEWEST_BUCKETS, MOST_BUCKETS = 256, 1 << 16, 1 << 24
SLOT = 1 << 16
COUNTED_AT_ONCE = 4_000_000
#: Keys that a task remembers, so as to sketch copies once.
KEYS_KEPT = 1_000_000
#: Copies of one text beyond which they are paired in parts.
MANY_COPIES = 2_000


def fold(texts: list[str]) -> list[str]:
    """The one form, lower case, each run of white space as one blank."""
    return [" ".join(x.lower().split()) for x in one_form(texts)]


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text << 40 | hash of a sequence), sorted and distinct, and the hashes' starts by text.

    A text of fewer than GRAM characters has one sequence, itself.
    """
    points, starts = code_points([x if len(x) >= GRAM else x + "\0" * (GRAM - len(x)) for x in texts])
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    p = points.astype(np.uint64)
    h = p[: len(p) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += p[k : len(p) - GRAM + 1 + k]
    h = mix64(h) >> np.uint64(24)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts))
    h |= owner[: len(h)] << np.uint64(40)
    h = h[owner[: len(h)] == owner[GRAM - 1 :]]
    h.sort()
    h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h, np.searchsorted(h, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(40))


def size_class(size: np.ndarray) -> np.ndarray:
    return (np.frexp(np.maximum(size, 1))[1] - 1).astype(np.int64)


def reaches_down(size: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Whether a set can be similar to one of the class below."""
    return (size * SIMILARITY <= np.left_shift(1, power)) & (power > 0)


def groups_in_class(power: np.ndarray) -> np.ndarray:
    """M of a size class whose sets are cut into groups."""
    return (DIFFER_LARGER * 2.5 * np.exp2(np.minimum(power, SAMPLED_FROM))).astype(np.int64) + SPARE


def _least_runs() -> np.ndarray:
    """T of texts by the number of their runs: each is in a text alike with a chance of SIMILARITY**RUN at least, and fewer than T are with one of MISSED at most."""
    out, p = [], SIMILARITY**RUN
    for n in range(8 * LISTS):
        t, below = 0, 0.0
        while t < n and (below := below + comb(n, t) * p**t * (1 - p) ** (n - t)) <= MISSED:
            t += 1
        out.append(max(1, t))
    return np.array(out, np.int64)


LEAST_RUNS = _least_runs()


def least_shared(size: np.ndarray, lists: np.ndarray, power: np.ndarray, down: int) -> np.ndarray:
    """T of texts with so many lists in a class, their own or (down = 1) the one below."""
    whole = lists - np.floor((DIFFER, DIFFER_LARGER)[down] * size + 1e-9).astype(np.int64)
    return np.where(power < SAMPLED_FROM, whole, LEAST_RUNS[np.minimum(lists, len(LEAST_RUNS) - 1)])


def _groups(h: np.ndarray, owner: np.ndarray, mixed: np.ndarray, groups: np.ndarray, power: np.ndarray) -> np.ndarray:
    """number of the text << NAME_BITS | name of the list, of the groups of each text (0: none)."""
    ends = np.cumsum(groups)
    base = ends - groups
    who = np.repeat(np.arange(len(groups)), groups)
    sums = np.zeros(len(who), np.uint64)
    place = base[owner] + (h * groups[owner].astype(np.uint64) >> np.uint64(40)).astype(np.int64)  # grows with h
    if len(place):
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums[place[first]] = np.add.reduceat(mixed, first)
    part = (np.arange(len(who)) - base[who]) << 6 | power[who]
    return who.astype(np.uint64) << np.uint64(NAME_BITS) | mix64(sums ^ mix64(part.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - NAME_BITS)


def _runs(owner: np.ndarray, mixed: np.ndarray, power: np.ndarray) -> np.ndarray:
    """The same of the runs of each text."""
    limit = (LISTS << 24) >> power
    start = np.flatnonzero((mixed >> np.uint64(40)).astype(np.int64) < limit[owner])
    start = start[start + RUN <= len(owner)]
    start = start[owner[start] == owner[start + RUN - 1]]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    who = owner[start]
    name = mix64(total[start + RUN] - total[start] ^ mix64(power[who].astype(np.uint64) + np.uint64(1)))
    return who.astype(np.uint64) << np.uint64(NAME_BITS) | name >> np.uint64(64 - NAME_BITS)


def sketches_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: the size of its set; how many lists it has, in its class and 16 bits higher in the one below; their names.

    The names in the class are in ascending order, then those in the class below if the text reaches down;
    first the low 32 bits of all, then the high 8.
    """
    h, starts = grams(texts)
    size, n = np.diff(starts), len(texts)
    own = size_class(size)
    owner = (h >> np.uint64(40)).astype(np.int64)
    h &= np.uint64((1 << 40) - 1)
    mixed = mix64(h.copy())
    levels = []
    for power, counts in ((own, np.ones(n, bool)), (own - 1, reaches_down(size, own))):
        in_runs = power >= SAMPLED_FROM
        take = (counts & in_runs)[owner]
        runs = _runs(owner[take], mixed[take], power)
        rest = (counts & ~in_runs)[owner]
        names = np.concatenate((runs, _groups(h[rest], owner[rest], mixed[rest], np.where(counts & ~in_runs, groups_in_class(power), 0), power)))
        names.sort()
        cut = np.searchsorted(names, np.arange(n + 1, dtype=np.uint64) << np.uint64(NAME_BITS))
        levels.append((names.astype(np.uint32), (names >> np.uint64(32)).astype(np.uint8), cut))
    lists = np.diff(levels[0][2]) | np.diff(levels[1][2]) << 16
    (low, high, at), (low_, high_, at_) = levels
    return size, lists, [b"".join((low[a:b].tobytes(), low_[c:d].tobytes(), high[a:b].tobytes(), high_[c:d].tobytes())) for a, b, c, d in zip(at, at[1:], at_, at_[1:], strict=False)]


def _sketched(hashed: Callable[[str], str | None] | None):
    """doc_id, key, size, held, lists, the columns after text, and a hash of the folded text; copies within a task have no lists again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in pieces(batches):
            yield sketch(part, texts, seen)

    def sketch(part: pa.RecordBatch, texts: list[str], seen: set[int]) -> pa.RecordBatch:
        folded = fold(texts)
        keys = [text_key(x) if x else None for x in folded]
        new = {k: x for k, x in zip(keys, folded, strict=True) if k is not None and k not in seen}
        if len(seen) > KEYS_KEPT:
            seen.clear()
        seen.update(new)
        size, held, lists = sketches_of(list(new.values()))
        of = dict(zip(new, zip(size.tolist(), held.tolist(), lists, strict=True), strict=True))
        rows = [of.pop(k, (None, None, None)) for k in keys]
        rest = {n: part.column(n) for n in part.schema.names[2:]}
        if hashed:
            rest["hash"] = pa.array(map(hashed, folded), pa.string())
        return pa.RecordBatch.from_pydict({"doc_id": part.column(0), "key": pa.array(keys, pa.int64()), **{n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("size", pa.int32()), ("held", pa.int32()), ("lists", pa.binary())))}, **rest})

    return run


def sketched(documents: DataFrame, *columns: str, hashed: Callable[[str], str | None] | None = None) -> DataFrame:
    """doc_id, key, size, held, lists of the documents with text, string columns of theirs, and hash if asked for; texts of nothing but blanks have no row."""
    schema = "doc_id bigint, key bigint, size int, held int, lists binary" + "".join(f", {c} string" for c in (*columns, *["hash"] * (hashed is not None)))
    return checkpointed(present(documents, *columns).mapInArrow(_sketched(hashed), schema).where("key is not null"))


def one_a_key(rows: DataFrame) -> DataFrame:
    """key, size, held, lists of each distinct text."""
    return rows.where("lists is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "held", "lists")))


def _names(lists: list[bytes]) -> np.ndarray:
    """The names of the lists of several texts, one text after the other."""
    low = np.frombuffer(b"".join(x[: len(x) // 5 * 4] for x in lists), np.uint32)
    return np.frombuffer(b"".join(x[len(x) // 5 * 4 :] for x in lists), np.uint8).astype(np.int64) << 32 | low


def _lists(sizes: np.ndarray, held: np.ndarray, lists: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, name of the list with its class, lists a text, T of the text) of all lists of each text, in its class and in the one below."""
    names, own = _names(lists), size_class(sizes)
    first, below = held & 0xFFFF, held >> 16
    start = np.cumsum(first + below) - first - below
    for down, n, at in ((0, first, start), (1, below, start + first)):
        who = np.repeat(np.arange(len(sizes)), n)
        power = own - down
        yield who, power[who] << 48 | names[at[who] + np.arange(len(who)) - (np.cumsum(n) - n)[who]], n, least_shared(sizes, n, power, down)


def _bucket(lists: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(lists.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)), batch.column(3).to_pylist()


def _counted(buckets: int):
    """Sketches -> slot, places, counts: how often the lists of a bucket occur."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted(at, np.arange(0, buckets + 1, SLOT))
        slots = np.flatnonzero(np.diff(cut))
        columns = [[x[cut[k] : cut[k + 1]].tobytes() for k in slots] for x in ((at % SLOT).astype(np.uint16), np.minimum(n, 0xFFFF).astype(np.uint16))]
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], ["slot", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            parts += [_bucket(lists, buckets) for _, lists, _, _ in _lists(*_columns(batch))]
            if sum(map(len, parts)) > COUNTED_AT_ONCE:
                yield flush(parts)
                parts = []
        if parts:
            yield flush(parts)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The counts of a slot over all tasks, as a byte: 1 is once, n is less than 2**n times."""
    total = np.zeros(SLOT, np.int64)
    for places, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint16)
    return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([np.frexp(total)[1].astype(np.uint8).tobytes()], pa.binary())})


def list_lengths(sketches: DataFrame) -> bytes:
    """A byte for each bucket of lists: how long they are, see _summed. Its size has the bound MOST_BUCKETS."""
    n, buckets = sketches.count() * BUCKETS_A_TEXT, FEWEST_BUCKETS
    while buckets < min(n, MOST_BUCKETS):
        buckets *= 2
    parts = sketches.select("key", "size", "held", "lists").mapInArrow(_counted(buckets), "slot int, places binary, counts binary").groupBy("slot").applyInArrow(_summed, "slot int, counts binary")
    out = bytearray(buckets)
    for r in parts.toLocalIterator():
        out[r.slot * SLOT : (r.slot + 1) * SLOT] = r.counts
    return bytes(out)


def _short(lengths: bytes):
    """Sketches and more columns -> list, key, meta (size, class and hits that are asked) and the further columns, of each text's short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(lengths, np.uint8)
        for batch in batches:
            sizes, held, packed = _columns(batch)
            own = size_class(sizes)
            for who, lists, n, least in _lists(sizes, held, packed):
                length = table[_bucket(lists, len(table))]
                order = np.lexsort((lists, length, who))
                who, lists, length = who[order], lists[order], length[order]
                place = np.arange(len(who)) - (np.cumsum(n) - n)[who]
                hits = np.minimum(HITS, least)
                # A list that only one text has is a short one of it, but there is nothing to merge.
                keep = (place < (n - least + hits)[who]) & (length > 1)
                who, lists = who[keep], lists[keep]
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int64()), batch.column(0).take(at), pa.array((sizes << 16 | own << 8 | hits)[who], pa.int64()), *(c.take(at) for c in batch.columns[4:])], ["list", "key", "meta", *batch.schema.names[4:]]
                )

    return run


def merged(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
    """a, b of the postings (list, key, meta as a and b) that come together in as many short lists as are asked."""
    size, power, hits = (lambda x: F.shiftright(x, 16)), (lambda x: F.shiftright(x, 8).bitwiseAND(255)), (lambda x: F.col(x).bitwiseAND(255))
    sizes, powers = [size(F.col(x)) for x in ("meta_a", "meta_b")], [power(F.col(x)) for x in ("meta_a", "meta_b")]
    in_class = F.shiftright("list", 48) == F.least(*powers)
    met = left.join(right, "list").where(apart & (F.least(*sizes) >= SIMILARITY * F.greatest(*sizes)) & in_class)
    met = met.select("a", "b", F.least(hits("meta_a"), hits("meta_b")).alias("asked"))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("asked").alias("asked")).where("n >= asked").select("a", "b")


def side(postings: DataFrame, name: str) -> DataFrame:
    return postings.select("list", F.col("key").alias(name), F.col("meta").alias(f"meta_{name}"))


def short_lists(sketches: DataFrame, more: str = "") -> DataFrame:
    """list, key, meta of the lists to merge; more: the sketches' further columns with their types."""
    return sketches.mapInArrow(_short(list_lengths(sketches)), "list bigint, key bigint, meta bigint" + more)


def _in_class(sizes: np.ndarray, held: np.ndarray, lists: list[bytes], power: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The names of the lists and T of texts in a class, their own or the one below."""
    down = size_class(sizes) > power
    first, below = held & 0xFFFF, held >> 16
    least = np.where(down, least_shared(sizes, below, power, 1), least_shared(sizes, first, power, 0))
    at = np.cumsum(first + below) - below
    at, n = np.where(down, at, at - first), np.where(down, below, first)
    names = _names(lists)
    return [names[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)], least


def _in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the ascending a are in the ascending b, by binary search."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates that have T of all lists in common, the long ones too."""
    for batch in batches:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        power = np.minimum(size_class(column("size_a")), size_class(column("size_b")))
        (a, least_a), (b, least_b) = (_in_class(column(f"size_{x}"), column(f"held_{x}"), batch.column(f"lists_{x}").to_pylist(), power) for x in "ab")
        both = np.fromiter((_in_both(x, y) for x, y in zip(a, b, strict=True)), np.int64, len(batch))
        yield batch.select(["a", "b"]).filter(pa.array(both >= np.maximum(least_a, least_b)))


def _kept(keys: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(keys, np.uint8)
        for batch in batches:
            yield marked(batch, bits)

    return run


def keys_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def candidates(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of the pairs that reach T over all their lists. A bitmap of their keys keeps the other texts' lists out of the shuffle."""
    pairs = checkpointed(pairs)
    rows = sketches.select("key", "size", "held", "lists").mapInArrow(_kept(bitmap(keys_in(pairs), F.col("key"))), "key bigint, size int, held int, lists binary")
    one, other = (rows.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "held", "lists"))) for x in "ab")
    return pairs.join(one, "a").join(other, "b").mapInArrow(_probed, "a bigint, b bigint")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of all distinct sequences in either, the share that is in both; the shorter is probed in the longer."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, texts_a, texts_b = (x.to_pylist() for x in batch.columns)
        start = 0
        while start < len(a):
            by, end = {}, start
            chars = 0
            while end < len(a) and chars < CHARS_AT_ONCE:
                by[a[end]], by[b[end]] = texts_a[end], texts_b[end]
                chars += len(texts_a[end]) + len(texts_b[end])
                end += 1
            h, cut = grams(list(by.values()))
            h = h & np.uint64((1 << 40) - 1)
            sets = {k: h[cut[i] : cut[i + 1]] for i, k in enumerate(by)}
            like = np.array([similarity(sets[x], sets[y]) for x, y in zip(a[start:end], b[start:end], strict=True)])
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(like, pa.float64())], ["a", "b", "similarity"]).filter(pa.array(like >= SIMILARITY))
            start = end


def _wanted(documents: bytes):
    """key, text of the documents that are in the bitmap, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(documents, np.uint8)
        for batch in batches:
            for _, texts in pieces(iter([marked(batch, bits)])):
                folded = [x for x in fold(texts) if x]
                yield pa.RecordBatch.from_arrays([pa.array(map(text_key, folded), pa.int64()), pa.array(folded, pa.string())], ["key", "text"])

    return run


def verified(pairs: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs of keys whose texts are at least SIMILARITY alike. rows: doc_id, key, lists.

    A bitmap of the documents concerned keeps the other texts out of the shuffle.
    """
    keys = keys_in(pairs)
    first = rows.where("lists is not null and doc_id is not null").join(keys, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    texts = present(documents).mapInArrow(_wanted(bitmap(first, F.col("doc_id"))), "key bigint, text string").dropDuplicates(["key"])
    with_texts = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a bigint, b bigint, similarity double")


def similar_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the texts at least SIMILARITY alike.

    pairs: a, b (keys of different texts, a < b), similarity. members: doc_id, key; the documents with one
    key are copies. Null and empty texts, and texts of nothing but blanks, are in neither. Repeated rows
    count once. Other columns are ignored.
    """
    rows = sketched(documents)
    sketches = checkpointed(one_a_key(rows))
    postings = short_lists(sketches)
    pairs = merged(side(postings, "a"), side(postings, "b"), F.col("a") < F.col("b"))
    found = checkpointed(candidates(pairs, sketches))
    return verified(found, documents, rows), rows.select("doc_id", "key").distinct()


def in_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left and right of one key, joined; the many rows of a key are cut into parts on the left, each of which meets all on the right."""
    n = left.groupBy("key").agg(F.ceil(F.count("*") / MANY_COPIES).cast("int").alias("parts"))
    cut = left.join(n, "key").withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int")).drop("parts")
    spread = right.join(n, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cut.join(spread, ["key", "part"])


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of every pair of documents whose texts are similar or the same."""
    left, right = members.select("key", F.col("doc_id").alias("x")), members.select("key", F.col("doc_id").alias("y"))
    apart = pairs.select("a", "b").join(left.withColumnRenamed("key", "a"), "a").join(right.withColumnRenamed("key", "b"), "b").select("x", "y")
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    copies = in_parts(left.join(several, "key"), right.join(several, "key")).where("x < y").select("x", "y")
    return apart.union(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b: all pairs of documents at least SIMILARITY alike, copies included."""
    return expanded(*similar_texts(documents))


def near_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its copies), links (similar texts besides its own): one row a document."""
    pairs, members = similar_texts(documents)
    links = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).groupBy("key").agg(F.count("*").alias("links"))
    least = members.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return members.join(least, "key").join(links, "key", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
