"""Problem 1: lines of several sources in the shares that their target_gb ask for.

Every kept line of a source has the same expected number of copies, which makes the source's bytes fill
its share of the whole; a source that would need more than max_repeats copies gets just those and falls
short. Systematic sampling turns expected into whole copies: the expected copies are summed up line by
line, one random offset is added, and a line is emitted once per whole number that the sum crosses.

The running sum is taken in two levels, so that a source of any size spreads over many tasks: lines fall
into buckets by hash, each bucket has its own running sum, and the buckets' totals give where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import checkpointed

#: Lines a bucket holds in the mean.
BUCKET_LINES = 50_000


def source_key(column: str) -> Column:
    """A source's name without regard to case and outer blanks."""
    return F.lower(F.trim(column))


def kept_lines(lines: DataFrame) -> DataFrame:
    """line_id, source, domain, bytes: each line_id once, as merged last, if it was kept then.

    Equal merged_at: the one with the greater text and source counts. Lines without id or text take no part.
    """
    rows = lines.where("line_id is not null and line is not null").select(
        "line_id", F.struct("merged_at", F.octet_length("line").cast("bigint").alias("bytes"), source_key("source").alias("source"), "domain", "reject_reason").alias("row")
    )
    return rows.groupBy("line_id").agg(F.max("row").alias("row")).where("row.reject_reason is null").select("line_id", "row.source", "row.domain", "row.bytes")


def source_sizes(kept: DataFrame) -> DataFrame:
    """source, bytes, lines. A null source has no row."""
    return kept.where("source is not null").groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("lines"))


def source_plan(lines: DataFrame, configs: DataFrame) -> DataFrame:
    """plan_of the kept lines, without most_bytes."""
    return plan_of(kept_lines(lines), configs).drop("most_bytes")


def plan_of(kept: DataFrame, configs: DataFrame) -> DataFrame:
    """Of each source with a target_gb: config_key, source, bytes, lines, share, wanted_bytes, copies, short, most_bytes.

    share is of all target_gb; wanted_bytes is the share of the sum of all sizes; copies is what each line
    is expected to give; short tells that max_repeats doesn't reach; most_bytes is max_repeats times bytes. A null max_repeats sets no bound. A
    source without lines has bytes 0 and is short if it wants any. Keys that are the same source count once,
    with the greatest of their numbers, under the first key in order.
    """
    wanted = configs.where("target_gb is not null").groupBy(source_key("config_key").alias("source")).agg(F.min("config_key").alias("config_key"), F.max("target_gb").alias("target_gb"), F.max("max_repeats").alias("max_repeats"))
    sized = wanted.join(source_sizes(kept), "source", "left").fillna(0, ["bytes", "lines"])
    total = sized.agg(F.sum("target_gb").alias("all_gb"), F.sum("bytes").alias("all_bytes"))
    plan = sized.join(F.broadcast(total)).withColumn("share", F.col("target_gb") / F.col("all_gb"))  # one row
    plan = plan.withColumn("wanted_bytes", F.col("share") * F.col("all_bytes"))
    most = F.col("max_repeats") * F.col("bytes")
    return plan.select(
        "config_key", "source", "bytes", "lines", "share", "wanted_bytes",
        F.when(F.col("bytes") > 0, F.least(F.col("wanted_bytes") / F.col("bytes"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("copies"),
        F.coalesce(F.col("wanted_bytes") > most, F.lit(False)).alias("short"), most.alias("most_bytes"),
    )


def mixed(lines: DataFrame, configs: DataFrame, seed: int = 0) -> DataFrame:
    """line_id, source, domain, bytes, copies: how often each kept line is emitted; lines of no copies have no row.

    copies differs from its expectation by less than one, and a source's sum of copies too.
    """
    kept = checkpointed(kept_lines(lines))
    return emitted(kept, plan_of(kept, configs), seed)


def emitted(kept: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    plan = plan.where("copies > 0")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("lines") / BUCKET_LINES)).cast("int")
    kept = kept.join(plan.select("source", F.col("copies").alias("rate"), buckets.alias("buckets")), "source")
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("line_id", F.lit(seed)), "buckets").cast("int"))
    totals = kept.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("source", "bucket", before.alias("before"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("line_id"))
    numbered = kept.withColumn("place", place).join(starts, ["source", "bucket"]).withColumn("upto", F.col("before") + F.col("place"))
    crossed = F.floor(F.col("upto") * F.col("rate") + offset) - F.floor((F.col("upto") - 1) * F.col("rate") + offset)
    return numbered.select("line_id", "source", "domain", "bytes", crossed.alias("copies")).where("copies > 0")


def mix_report(lines: DataFrame, configs: DataFrame, seed: int = 0) -> DataFrame:
    """config_key, domain, target_share, lines, emitted_lines, emitted_bytes, reached_share: by source and domain, of the whole mix.

    A source that gives nothing has one row with a null domain and zeros.
    """
    kept = checkpointed(kept_lines(lines))
    plan = checkpointed(plan_of(kept, configs))
    out = emitted(kept, plan, seed).groupBy("source", "domain").agg(F.count("*").alias("lines"), F.sum("copies").alias("emitted_lines"), F.sum(F.col("copies") * F.col("bytes")).alias("emitted_bytes"))
    plan = plan.select("config_key", "source", F.col("share").alias("target_share"))
    rows = plan.join(out, "source", "left").fillna(0, ["lines", "emitted_lines", "emitted_bytes"])
    total = rows.agg(F.sum("emitted_bytes").alias("all_emitted"))
    rows = rows.join(F.broadcast(total))  # one row
    return rows.select("config_key", "domain", "target_share", "lines", "emitted_lines", "emitted_bytes", (F.col("emitted_bytes") / F.greatest("all_emitted", F.lit(1))).alias("reached_share"))


def short_sources(lines: DataFrame, configs: DataFrame, seed: int = 0) -> DataFrame:
    """config_key of the sources that fall short of their share even at max_repeats, as the emitted lines show.

    Found is a source whose emitted lines amount to all that max_repeats allows, which is less than it wants.
    The seed doesn't matter: each line of such a source has just max_repeats copies at any offset.
    """
    kept = checkpointed(kept_lines(lines))
    plan = checkpointed(plan_of(kept, configs))
    out = emitted(kept, plan, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("bytes")).alias("emitted_bytes"))
    rows = plan.join(out, "source", "left").fillna(0, ["emitted_bytes"])
    return rows.where("emitted_bytes >= most_bytes and most_bytes < wanted_bytes").select("config_key")
