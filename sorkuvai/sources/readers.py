"""Text files, wiki dumps, JSON lines and Parquet as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.profiles import WS
from ..functions.text import ustrip
from ..operators.merge import passes_language, priority

PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("revision", T.StructType([T.StructField("text", T.StringType())]))])
REDIRECT = r"(?i)^\s*#(?:redirect|வழிமாற்று)"


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """domain, file_name, line of all *.txt under a folder but empty lines. domain is the first part of the path below it."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    path = F.col("_metadata.file_path")
    below = F.regexp_extract(path, r"/" + folder.rstrip("/").rsplit("/", 1)[-1] + r"/(.+)$", 1)
    rows = rows.select(F.regexp_replace(F.split(below, "/")[0], r"\.txt$", "").alias("domain"), below.alias("file_name"), F.regexp_replace("value", r"\r+$", "").alias("line"))
    return rows.where(F.length("line") > 0)


def in_priority(files: DataFrame) -> DataFrame:
    """The distinct files in the order of their domains."""
    return files.select("domain", "file_name").distinct().orderBy(priority(F.col("domain")), "domain", "file_name")


def paragraphs(texts: DataFrame, joint: str = "\n") -> DataFrame:
    """source, doc_seq, text of the paragraphs of whole texts (source, value): what stands between blank lines.

    Lines are joined by `joint`, stripped at their ends.
    """
    each = texts.select("source", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), rf"\n[{WS}]*\n")).alias("doc_seq", "text"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, rf"[{WS}]+\z", "") if joint == "\n" else ustrip(x)), lambda x: x != "")
    return each.select("source", "doc_seq", ustrip(F.array_join(lines, joint)).alias("text")).where(F.length("text") > 0)


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """source (the file's stem), value of the *.txt in a folder; for files that fit a task."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("source"), "value")


def paragraph_file(spark: SparkSession, path: str) -> DataFrame:
    """text of the paragraphs of a file of any size, cut by the reader at empty lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(ustrip(F.col("value")).alias("text")).where(F.length("text") > 0)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the articles of a dump (also .bz2): namespace 0 or none given, no redirects, whatever the dump's version."""
    pages = spark.read.format("xml").option("rowTag", "page").option("mode", "PERMISSIVE").schema(PAGE).load(path)
    return pages.where("coalesce(ns, '0') = '0'").select("title", F.col("revision.text").alias("text")).where(F.col("text").isNotNull() & ~F.col("text").rlike(REDIRECT))


def records(rows: DataFrame, text_field: str = "text", language_field: str | None = None, language: str | None = None, shortest: int = 50) -> DataFrame:
    """text of delivered records: text_field, else 'text'; of the wanted language or none; of `shortest` characters or more."""
    text = F.coalesce(*(F.col(x) for x in dict.fromkeys((text_field, "text")) if x in rows.columns))
    if language_field and language is not None and language_field in rows.columns:
        rows = rows.where(passes_language(F.col(language_field), language))
    return rows.select(text.alias("text")).where(F.length("text") >= shortest)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def scanned(rows: DataFrame, n: int, keep) -> DataFrame:
    """Of the first n rows read those that are kept."""
    return rows.limit(n).where(keep)


def collected(rows: DataFrame, n: int, keep) -> DataFrame:
    """The first n rows that are kept."""
    return rows.where(keep).limit(n)


class Registry:
    """Named sources: a function of the session and options that gives rows with text."""

    def __init__(self) -> None:
        self.sources: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, reader: Callable[..., DataFrame]) -> None:
        self.sources[name] = reader

    def union(self, spark: SparkSession, names: list[str], **options) -> DataFrame:
        """source, text of several sources in the order given; an unknown name is an error before anything is read."""
        if unknown := [n for n in names if n not in self.sources]:
            raise KeyError(f"no such source: {unknown}")
        out = None
        for n in names:
            part = self.sources[n](spark, **options.get(n, {})).select(F.lit(n).alias("source"), "text")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no sources")
        return out
