"""Problem 6: records of the evaluation splits that are also in the training split.

Records are canonicalised (the one form, lower case, neither punctuation nor white space) and hashed;
the hashes of the evaluation splits are joined with those of the training split, and for the report
counted by split and source before anything is paired. A hash only finds records that are the same but
for case, punctuation and blanks; those with small edits come from the T-occurrence search of `near`, and
both kinds are held to the same similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed
from .batches import pieces
from .near import candidates, in_parts, merged, one_a_key, short_lists, side, sketched, verified
from .unify import one_form, present

TRAIN, EVALUATION = "train", ("validation", "test")
NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def canonical_hash(text: str) -> str | None:
    """Of a text in the one form; null if nothing is left of it."""
    bare = NOT_WORD.sub("", text.lower())
    return xxhash.xxh3_128_hexdigest(bare) if bare else None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in pieces(batches):
        hashes = pa.array([canonical_hash(x) for x in one_form(texts)], pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), hashes], ["doc_id", "split", "source", "hash"])


def split_of(column: str = "split"):
    """The split without regard to case and outer blanks."""
    return F.lower(F.trim(column))


def records(documents: DataFrame) -> DataFrame:
    """doc_id, split, source, hash of the documents with text; a null split or source stays null."""
    rows = present(documents, "split", "source").mapInArrow(_hashed, "doc_id bigint, split string, source string, hash string")
    return rows.withColumns({"split": split_of(), "source": F.lower(F.trim("source"))}).where("hash is not null").distinct()


def overlap_counts(documents: DataFrame) -> DataFrame:
    """split, source, train_source, records, train_records: canonical hashes of an evaluation split and source that a training source holds.

    records counts the evaluation rows. Rows of a null split take no part; a null source is a source of its own.
    """
    counted = records(documents).groupBy("hash", "split", "source").agg(F.count("*").alias("n"))
    evaluation = counted.where(F.col("split").isin(*EVALUATION))
    train = counted.where(F.col("split") == TRAIN).select("hash", F.col("source").alias("train_source"), F.col("n").alias("train_n"))
    return evaluation.join(train, "hash").groupBy("split", "source", "train_source").agg(F.sum("n").alias("records"), F.sum("train_n").alias("train_records"))


def across_splits(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: similar documents (see near), one in train and one in an evaluation split.

    Copies and near copies alike. The lists of the evaluation texts are the index, those of the train texts
    are looked up in it; pairs within train or within the evaluation splits are never made.
    """
    kind = F.when(split_of() == TRAIN, 1).when(split_of().isin(*EVALUATION), 2)
    documents = documents.where(kind.isNotNull())  # before copies are sketched once
    rows = sketched(documents, "split", hashed=canonical_hash).withColumn("side", kind)
    sides = rows.groupBy("key").agg(F.bit_or("side").alias("sides"))
    sketches = checkpointed(one_a_key(rows).join(sides, "key"))
    postings = short_lists(sketches.select("key", "size", "held", "lists", "sides"), ", sides int")
    index, train = side(postings.where("sides & 2 > 0"), "a"), side(postings.where("sides & 1 > 0"), "b")
    found = candidates(merged(index, train, F.col("a") != F.col("b")), sketches)
    hashes, wanted = rows.where("hash is not null").select("hash", "key", "side").distinct(), F.col("side")
    held, seen = hashes.where(wanted == 2).select("hash", F.col("key").alias("a")), hashes.where(wanted == 1).select("hash", F.col("key").alias("b"))
    same = held.join(seen, "hash").where("a <> b").select("a", "b")
    pairs = verified(checkpointed(found.union(same).distinct()), documents, rows)
    members = rows.select("doc_id", "key", "side").distinct()
    x, y = (members.where(wanted == k).select("key", F.col("doc_id").alias(n)) for k, n in ((2, "x"), (1, "y")))
    near = pairs.join(x.withColumnRenamed("key", "a"), "a").join(y.withColumnRenamed("key", "b"), "b").select("x", "y")
    both = sides.where("sides = 3").select("key")
    copies = in_parts(x.join(both, "key"), y.join(both, "key")).select("x", "y")
    return near.union(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def overlap_report(documents: DataFrame) -> DataFrame:
    """split, source, documents, overlapping: of each evaluation split and source, how many documents are also in train, exactly or almost."""
    pairs = across_splits(documents)
    hit = pairs.select(F.col("doc_id_a").alias("doc_id")).union(pairs.select("doc_id_b")).distinct().withColumn("hit", F.lit(1))
    rows = present(documents, "split", "source").select("doc_id", split_of().alias("split"), F.lower(F.trim("source")).alias("source")).where(F.col("split").isin(*EVALUATION)).distinct()
    return rows.join(hit, "doc_id", "left").groupBy("split", "source").agg(F.count("*").alias("documents"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))
