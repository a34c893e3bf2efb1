"""Samples, splits and blocks that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def share_of_hash(text: Column, parts: int = 10_000) -> Column:
    """A number from 0 to parts - 1 that only depends on the text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % parts


def train_eval(documents: DataFrame, share: float = 0.02) -> DataFrame:
    """The documents with is_eval, true for about the given share; equal texts fall on the same side."""
    return documents.withColumn("is_eval", share_of_hash(F.col("text")) < int(share * 10_000))


def sampled(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by the least hash of their key and a seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that only depends on their keys and the seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def _cut(placed: DataFrame, size: int, *by: str) -> DataFrame:
    """by, block_id, ids of the full blocks of rows with ids and what is before them; a row is cut where blocks begin."""
    first, last = F.floor(F.col("before") / size), F.floor((F.col("before") + F.size("ids") - 1) / size)
    parts = placed.where(F.size("ids") > 0).select(*by, "before", "ids", F.explode(F.sequence(first, last)).alias("block_id"))
    start = F.greatest(F.col("block_id") * size, F.col("before"))
    length = F.least((F.col("block_id") + 1) * size, F.col("before") + F.size("ids")) - start
    parts = parts.select(*by, "block_id", F.struct(start.alias("at"), F.slice("ids", (start - F.col("before") + 1).cast("int"), length.cast("int")).alias("part")).alias("p"))
    whole = parts.groupBy(*by, "block_id").agg(F.array_sort(F.collect_list("p")).alias("all"))  # at most `size` parts
    return whole.select(*by, "block_id", F.flatten(F.transform("all", lambda x: x["part"])).alias("ids")).where(F.size("ids") == size)


def blocks(tokens: DataFrame, size: int, order: str = "doc_id", end: int | None = None, target: int | None = None) -> DataFrame:
    """block_id, ids: the token ids of all rows, one after the other, cut into full blocks; the rest is dropped.

    tokens: the order column (no value twice) and ids. end is put after each row's ids. With a target no row is
    taken after the one that reaches it. Only the rows' lengths are brought into a global order; ids are
    joined to their places and go to their blocks.
    """
    rows = tokens.withColumn("ids", F.concat("ids", F.array(F.lit(end))) if end is not None else F.col("ids")).where("ids is not null and size(ids) > 0")
    placed = running(rows.select(order, F.size("ids").alias("_n")), [order], before=F.col("_n"))
    if target is not None:
        placed = placed.where(F.col("before") < target)
    return _cut(rows.join(placed.select(order, "before"), order), size)


def blocks_by_batch(tokens: DataFrame, size: int, batch: int = 1000, order: str = "doc_id") -> DataFrame:
    """batch, block_id, ids: as blocks, but for each `batch` rows by themselves; each batch's rest is dropped.

    A batch's ids are cut by its rows' prefix sums, so that no batch has to fit one array.
    """
    sizes = running(tokens.select(order, F.size("ids").alias("_n")), [order], row_no=F.lit(1)).withColumn("batch", F.floor(F.col("row_no") / batch))
    own = Window.partitionBy("batch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(order, "batch", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("before"))
    return _cut(tokens.join(placed, order), size, "batch")


def slices(ids: Column, size: int = 64) -> Column:
    """Slices of an array, without the tail even if that is a full one."""
    n = F.size(ids)
    return F.when(n > size, F.transform(F.sequence(F.lit(0), F.floor((n - size - 1) / size).cast("int")), lambda k: F.slice(ids, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))
