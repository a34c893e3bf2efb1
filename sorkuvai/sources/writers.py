"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(rows: DataFrame, folder: str, column: str = "line") -> None:
    """Adds the lines to the text files of a folder."""
    rows.select(column).write.mode("append").text(folder)


def write_documents(rows: DataFrame, folder: str, shortest: int = 50, at_most: int | None = None) -> None:
    """Documents of more than `shortest` characters, an empty line after each."""
    rows = rows.select(F.trim("text").alias("text")).where(F.length("text") > shortest)
    (rows.limit(at_most) if at_most is not None else rows).write.mode("overwrite").option("lineSep", "\n\n").text(folder)


def write_split(rows: DataFrame, folder: str) -> None:
    """Documents with is_eval, one folder for each side."""
    rows.write.mode("overwrite").partitionBy("is_eval").parquet(folder)


def write_report(rows: DataFrame, folder: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(folder)


def write_tokenizer(vocab: DataFrame, merges: DataFrame, folder: str) -> None:
    """A byte-pair tokenizer's pieces and merges as one JSON object in one line, as tokenizer files have them. Meant for a vocabulary, which one row must hold."""
    pieces = vocab.where("token is not null").groupBy("token").agg(F.min("token_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "id")))).alias("vocab"))
    pairs = merges.where("left_piece is not null and right_piece is not null").agg(F.array_sort(F.collect_list(F.struct("merge_rank", "left_piece", "right_piece"))).alias("m"))
    both = pieces.join(pairs).select(F.struct(F.lit("BPE").alias("type"), "vocab", F.transform("m", lambda x: F.concat_ws(" ", x["left_piece"], x["right_piece"])).alias("merges")).alias("model"))
    both.select(F.to_json(F.struct("model")).alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
