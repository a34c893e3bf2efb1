"""The same work on streams of lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_quality_line
from ..functions.text import normalize_basic
from ..operators.dedup import line_key


def clean_lines(stream: DataFrame, **limits) -> DataFrame:
    """The good lines of a stream with a column line."""
    rows = stream.withColumn("line", normalize_basic(F.col("line")))
    return rows.where(is_quality_line(F.col("line"), **limits))


def first_lines(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each line once. Without an event time the state keeps every key; with one, keys older than the delay are forgotten."""
    keyed = stream.withColumn("key", line_key(F.col("line")))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["key"]).drop("key")
    return keyed.dropDuplicates(["key"]).drop("key")


def windowed(stream: DataFrame, event_time: str, length: str, slide: str | None = None, delay: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, the columns by, events, of tumbling or sliding windows with late rows up to the delay."""
    w = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    counted = stream.withWatermark(event_time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "events")


def sessions(rows: DataFrame, event_time: str, key: str, gap: str) -> DataFrame:
    """key, session_start, events of runs of events without a longer gap."""
    out = rows.groupBy(key, F.session_window(event_time, gap).alias("s")).agg(F.count("*").alias("events"))
    return out.select(key, F.col("s.start").alias("session_start"), "events")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a table; a later run with the same checkpoint folder goes on after it."""
    spark: SparkSession = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def budgeted(stream: DataFrame, folder: str, checkpoint: str, budget: int) -> None:
    """Appends the stream's lines to folder/lines until they fill `budget` bytes; the line that crosses it is the last.

    Copies count as often as they come. How many bytes each batch wrote stands in folder/totals, so that the
    lines are never read again, and a batch that is repeated writes over what it wrote.
    """
    from ..operators.ordering import under_budget
    from ..operators.storage import checkpointed

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        totals = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/totals")
        used = 0
        if totals.getFileSystem(spark._jsc.hadoopConfiguration()).exists(totals):
            before = spark.read.schema("batch bigint, bytes bigint").parquet(f"{folder}/totals").where(F.col("batch") < number)
            used = before.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        rows = checkpointed(batch.select("line").where("line is not null").withColumn("_at", F.monotonically_increasing_id()))
        size = F.octet_length("line") + 1
        kept = under_budget(rows, ["_at"], size, max(0, budget - used)) if used < budget else rows.limit(0)
        kept.select("line").write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")
        written = spark.read.schema("line string").parquet(f"{folder}/lines/batch={number}").agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
        written.select(F.lit(number).cast("bigint").alias("batch"), "bytes").coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals/part={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def near_duplicates_left_out(stream: DataFrame, index: str, out: str, checkpoint: str, bands: int = 9, rows: int = 13) -> None:
    """Appends the stream's documents (doc_id, text) to out that share no bucket with one kept before, within the batch too.

    index holds the band keys of all kept documents; a batch is joined with it by bucket, never by pair.
    """
    from ..operators.dedup import band_keys, greedy_keep, minhash
    from ..operators.storage import checkpointed

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        docs = checkpointed(batch.select("doc_id", "text").where("doc_id is not null and text is not null"))
        keys = checkpointed(band_keys(docs.select("doc_id", minhash(F.col("text"), bands * rows).alias("signature")), bands, rows))
        path = spark._jvm.org.apache.hadoop.fs.Path(index)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.schema("band int, band_hash bigint, batch bigint").parquet(index).where(F.col("batch") < number)
            seen = keys.join(held.select("band", "band_hash"), ["band", "band_hash"], "left_semi").select("doc_id").distinct()
            docs, keys = docs.join(seen, "doc_id", "left_anti"), keys.join(seen, "doc_id", "left_anti")
        kept = checkpointed(greedy_keep(docs, keys).where("keep").select("doc_id"))
        keys.join(kept, "doc_id", "left_semi").select("band", "band_hash").write.mode("overwrite").parquet(f"{index}/batch={number}")
        docs.join(kept, "doc_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
