"""Problem 3: how many tokens each source, language and domain amounts to.

The tokenizer is a table of pieces and a table of merges. A table of counts is kept by the hash of a
text and the hash of the tokenizer; only texts that aren't in it are encoded. The cubes are updated by
signed deltas: a document that is gone or changed gives its old count with a minus sign, a new or
changed one its new count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bpe import Bpe, tables
from ..operators.storage import checkpointed
from .batches import bitmap, marked, pieces
from .unify import present


def text_hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches):
        yield part.drop_columns(["text"]).append_column("text_hash", pa.array(map(text_hash, texts), pa.string()))


def _encoded(vocab: list[str], merges: list[tuple[str, str]], unseen: bytes):
    """text_hash, tokens of the texts of the documents in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bits = Bpe(vocab, merges), np.frombuffer(unseen, np.uint8)
        for batch in batches:
            for _, texts in pieces(iter([marked(batch, bits)])):
                yield pa.RecordBatch.from_arrays([pa.array(map(text_hash, texts), pa.string()), pa.array(map(bpe.count, texts), pa.int64())], ["text_hash", "tokens"])

    return run


def tokenizer(vocab: DataFrame, merges: DataFrame) -> tuple[list[str], list[tuple[str, str]], str]:
    """The pieces, the merges in order, and the tokenizer's hash."""
    both = tables(vocab, merges)
    return *both, hashlib.sha256(repr(both).encode()).hexdigest()[:32]


#: The table of counts: one row for each text, by its hash, and tokenizer.
COUNTS = "text_hash string, tokenizer_hash string, tokens bigint"


def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The table of counts in a folder; without rows if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(folder)


def store_counts(fresh: DataFrame, folder: str) -> None:
    """Adds counts to the table in a folder, which holds those of one tokenizer together."""
    fresh.select("text_hash", "tokenizer_hash", "tokens").write.mode("append").partitionBy("tokenizer_hash").parquet(folder)


def hashed_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash of the documents with text, each once; written once."""
    return checkpointed(present(documents).mapInArrow(_hashed, "doc_id bigint, text_hash string").distinct())


def fresh_counts(documents: DataFrame, hashes: DataFrame, known: DataFrame | None, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """text_hash, tokenizer_hash, tokens of the texts that the table of counts `known` doesn't have under this tokenizer.

    Each text is encoded once, however many documents hold it: by a bitmap of one document for each.
    """
    vocab_, merges_, name = tokenizer(vocab, merges)
    firsts = hashes.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    if known is not None:
        firsts = firsts.join(known.where(F.col("tokenizer_hash") == name).select("text_hash"), "text_hash", "left_anti")
    firsts = checkpointed(firsts.where("doc_id is not null"))
    counted = present(documents).mapInArrow(_encoded(vocab_, merges_, bitmap(firsts, F.col("doc_id"))), "text_hash string, tokens bigint")
    return counted.groupBy("text_hash").agg(F.max("tokens").alias("tokens")).select("text_hash", F.lit(name).alias("tokenizer_hash"), "tokens")


def token_counts(documents: DataFrame, vocab: DataFrame, merges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, tokenizer_hash, tokens of the documents with text.

    known: a table of counts; texts whose hash it has under this tokenizer aren't encoded again. Repeated rows
    count once. A text of nothing but blanks has no tokens.
    """
    hashes = hashed_documents(documents.where("doc_id is not null"))
    counts = fresh_counts(documents.where("doc_id is not null"), hashes, known, vocab, merges)
    if known is not None:
        name = tokenizer(vocab, merges)[2]
        old = known.where(F.col("tokenizer_hash") == name).groupBy("text_hash", "tokenizer_hash").agg(F.max("tokens").alias("tokens"))
        counts = counts.unionByName(old).groupBy("text_hash", "tokenizer_hash").agg(F.max("tokens").alias("tokens"))
    return hashes.join(counts, "text_hash").select("doc_id", "text_hash", "tokenizer_hash", "tokens")


def document_slices(documents: DataFrame, lines: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_id, source, lang, domain of the documents with text; one row each.

    source without regard to case and outer blanks; lang as lang_codes names the label, else 'und'; domain
    as most of the document's lines have it, the first in order among equals. What is missing is 'unknown'.
    """
    per_line = lines.where("domain is not null and doc_id is not null").groupBy("doc_id", "domain").agg(F.countDistinct("line_id").alias("n"))
    domains = per_line.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "domain"))["domain"].alias("domain"))
    names = codes.select(F.lower(F.trim("label")).alias("label"), F.col("lang").alias("code")).where("label is not null").groupBy("label").agg(F.max("code").alias("code"))
    rows = present(documents, "source", "lang").groupBy("doc_id").agg(F.max("source").alias("source"), F.max("lang").alias("lang"))
    rows = rows.withColumn("label", F.lower(F.trim("lang"))).join(names, "label", "left").join(domains, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), F.coalesce("code", F.lit("und")).alias("lang"), F.coalesce("domain", F.lit("unknown")).alias("domain"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, lang, domain, documents, tokens: what to add to the cubes of `before` to get those of `after`.

    Both: doc_id, text_hash, tokens, source, lang, domain. Documents that are the same in both cancel out;
    removed ones count with a minus sign.
    """
    signed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    return cubes(signed)


def cubes(rows: DataFrame) -> DataFrame:
    """source, lang, domain, documents, tokens by their signs (1 where there is no column sign); all-zero cells have no row."""
    sign = F.col("sign") if "sign" in rows.columns else F.lit(1)
    out = rows.groupBy("source", "lang", "domain").agg(F.sum(sign).alias("documents"), F.sum(sign * F.col("tokens")).alias("tokens"))
    return out.where("documents <> 0 or tokens <> 0")


def updated(cube: DataFrame, delta: DataFrame) -> DataFrame:
    """A cube with the deltas added."""
    out = cube.unionByName(delta).groupBy("source", "lang", "domain").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return out.where("documents <> 0 or tokens <> 0")


def token_cube(documents: DataFrame, lines: DataFrame, codes: DataFrame, vocab: DataFrame, merges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """source, lang, domain, documents, tokens, and tokens_of_source as the source's total."""
    counts = token_counts(documents, vocab, merges, known).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    cube = cubes(document_slices(documents, lines, codes).join(counts, "doc_id"))
    return cube.withColumn("tokens_of_source", F.sum("tokens").over(Window.partitionBy("source")))


def token_cube_in_steps(documents: DataFrame, earlier: DataFrame, lines: DataFrame, codes: DataFrame, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """The cube of documents, made from that of an earlier state by signed deltas; texts of that state aren't encoded again.

    earlier: documents as they were. The columns are those of cubes.
    """
    columns = "doc_id", "text_hash", "tokens", "source", "lang", "domain"
    old_counts = checkpointed(token_counts(earlier, vocab, merges))
    before = old_counts.join(document_slices(earlier, lines, codes), "doc_id").select(*columns)
    after = token_counts(documents, vocab, merges, old_counts).join(document_slices(documents, lines, codes), "doc_id").select(*columns)
    return updated(cubes(before), deltas(before, after))
