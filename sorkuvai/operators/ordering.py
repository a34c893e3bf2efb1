"""Running sums and positions over all rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed


#: Bytes of a range in the mean, as the plan estimates them, and ranges at most.
RANGE_BYTES, MOST_RANGES = 128 << 20, 100_000


def ranges(rows: DataFrame) -> int:
    """How many ranges rows are spread over: by their estimated size, and no fewer than a shuffle has."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(MOST_RANGES, size // RANGE_BYTES))


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """The rows with, for each name, the sum of its expression over all rows before in the order.

    order must name columns that tell any two rows apart. Rows are spread by range of the order; each range
    is summed up by itself and the ranges' totals, one row each, give where it starts. Nulls count as 0.
    """
    kept = rows.withColumns({f"_{k}": F.coalesce(v, F.lit(0)).cast("bigint") for k, v in sums.items()})
    parts = ranges(kept)
    ranged = checkpointed(kept.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_{k}_all") for k in sums))
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{k}_all").over(before), F.lit(0)).alias(f"_{k}_start") for k in sums))
    out = ranged.join(F.broadcast(starts), "_range").withColumns({k: F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)) + F.col(f"_{k}_start") for k in sums})
    return out.drop("_range", *(f"_{k}" for k in sums), *(f"_{k}_start" for k in sums))


def under_budget(rows: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """The first rows until the budget is used up; the row that crosses it is the last."""
    return running(rows, order, used=size).where(F.col("used") < budget).drop("used")


def head(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order."""
    return rows.orderBy(*order).limit(n)
