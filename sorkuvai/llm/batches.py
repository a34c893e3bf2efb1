"""Arrow batches of texts, cut into pieces that bound a Python worker's memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are held in NumPy arrays at once; a longer text is still taken whole.
CHARS_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 20_000


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, of about CHARS_AT_ONCE characters and TEXTS_AT_ONCE texts at most, with their texts; null counts as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.frombuffer(column.buffers()[1], np.int32, len(batch) + 1, column.offset * 4) if pa.types.is_string(column.type) and len(batch) else None
        start = 0
        while start < len(batch):
            if sizes is None:
                end = min(len(batch), start + 500)
            else:
                end = max(start + 1, min(start + TEXTS_AT_ONCE, int(np.searchsorted(sizes, int(sizes[start]) + 3 * CHARS_AT_ONCE, "right")) - 1))
            part = batch.slice(start, end - start)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            start = end


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bits of a bitmap, for each row and at most; what shares a bit with another row costs work, never a result.
BITS_A_ROW, BITS_AT_MOST, BUCKET = 16, 1 << 27, 32_768


def bitmap(rows: DataFrame, number: Column) -> bytes:
    """A bit for each number, modulo the bits, of which there is a power of two; little end first."""
    bits, n = BUCKET, rows.count()
    while bits < min(BITS_AT_MOST, BITS_A_ROW * n):
        bits *= 2
    at = F.pmod(number, F.lit(bits)) + 1  # Spark's first position is 1
    parts = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("part"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[(r.bucket - 1) * BUCKET // 8 : r.bucket * BUCKET // 8] = r.part
    return bytes(out)


def marked(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose first column is in a bitmap."""
    at = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False) % (8 * len(bits))
    return batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
