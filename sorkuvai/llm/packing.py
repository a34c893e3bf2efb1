"""Problem 8: documents packed into blocks of a fixed number of tokens.

Cost-balanced packing: what a sequence costs is taken as linear in its tokens plus, for each document in
it, quadratic in that document's tokens (attention doesn't cross documents). Documents are assigned in
descending order to the sequence of lowest cost that has room; a new one is opened where none has. Only a
document larger than the block is cut, into full blocks and a rest that is packed as a document.

Documents spread by hash over shards of about SHARD_DOCS, each packed on its own; a shard leaves at most
a few blocks partly filled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed
from .batches import pieces
from .unify import present

SHARD_DOCS = 20_000
SPECS_AT_MOST = 1_000
#: Cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1 / 512


def pack(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the sequence of each item; every item is 1 to capacity tokens large."""
    out = np.zeros(len(tokens), np.int64)
    whole = np.flatnonzero(tokens == capacity)
    out[whole] = np.arange(len(whole))
    rest = np.flatnonzero(tokens < capacity)
    rest = rest[np.argsort(-tokens[rest], kind="stable")]
    first = len(whole)
    opened = -(-int(tokens[rest].sum()) // capacity)
    heap = [(0.0, k) for k in range(opened)]  # by cost
    room = [capacity] * opened
    tight: list[tuple[int, float, int]] = []  # too little room for the present item, by room
    for i, n in zip(rest.tolist(), tokens[rest].tolist(), strict=True):
        while tight and -tight[0][0] >= n:
            _, cost, k = heapq.heappop(tight)
            heapq.heappush(heap, (cost, k))
        while heap and room[heap[0][1]] < n:
            cost, k = heapq.heappop(heap)
            heapq.heappush(tight, (-room[k], cost, k))
        if heap:
            cost, k = heapq.heappop(heap)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= n
        out[i] = first + k
        heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, k))
    return out


def _packed(one: pd.DataFrame) -> pd.DataFrame:
    capacity = int(one["capacity"].iloc[0])
    one = one.sort_values("doc_id", kind="stable")
    n = one["tokens"].to_numpy(np.int64)
    pieces = -(-n // capacity)
    doc = np.repeat(np.arange(len(one)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, n[doc] - piece * capacity)
    return pd.DataFrame({
        "spec_id": one["spec_id"].iloc[0], "shard": one["shard"].iloc[0], "block": pack(size, capacity),
        "doc_id": one["doc_id"].to_numpy()[doc], "start": piece * capacity, "tokens": size,
    })


def packed(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, shard, block, doc_id, start, tokens: the pieces in the blocks (named by spec, shard and block) of each capacity.

    sizes: doc_id, tokens. Rows of null or no tokens are in no block; repeated doc_ids count once, with the
    most tokens. Specs without a positive capacity give no row. start counts tokens from the document's
    first. Equal sizes are taken in the order of doc_id.
    """
    rows = sizes.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max("tokens").cast("bigint").alias("tokens"))
    rows = checkpointed(rows)
    n = max(1, -(-rows.count() // SHARD_DOCS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    wanted = specs.where("spec_id is not null and capacity > 0").groupBy("spec_id").agg(F.max("capacity").alias("capacity")).orderBy("spec_id").limit(SPECS_AT_MOST + 1).collect()
    if len(wanted) > SPECS_AT_MOST:
        raise ValueError(f"more than {SPECS_AT_MOST} capacities")
    specs_of = F.array(*(F.struct(F.lit(s.spec_id).alias("spec_id"), F.lit(s.capacity).alias("capacity")) for s in wanted))
    each = rows.withColumn("spec", F.explode(specs_of.cast("array<struct<spec_id: int, capacity: int>>"))).select("doc_id", "tokens", "shard", "spec.spec_id", "spec.capacity")
    return each.groupBy("spec_id", "shard").applyInPandas(_packed, "spec_id int, shard int, block bigint, doc_id bigint, start bigint, tokens bigint")


def packing_report(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, spec_name, capacity, blocks, pieces, tokens, unused_share by capacity; a spec in no use has no row."""
    blocks = packed(sizes, specs).groupBy("spec_id", "shard", "block").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    total = blocks.groupBy("spec_id").agg(F.count("*").alias("blocks"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    named = specs.groupBy("spec_id").agg(F.max("spec_name").alias("spec_name"), F.max("capacity").alias("capacity"))
    return total.join(named, "spec_id").select("spec_id", "spec_name", "capacity", "blocks", "pieces", "tokens", (1 - F.col("tokens") / (F.col("blocks") * F.col("capacity"))).alias("unused_share"))


#: A public tokenizer's file; found at the same place on every executor.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def encoder(path: str, kind: str):
    """A function from texts to the number of tokens of each."""
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no such kind of tokenizer: {kind}")


def _counted(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path, kind)
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(texts), pa.int64())], ["doc_id", "tokens"])

    return run


def public_sizes(documents: DataFrame, path: str = TOKENIZER, kind: str = "sentencepiece") -> DataFrame:
    """doc_id, tokens of the documents with text: each text is encoded whole under a public tokenizer.

    kind: sentencepiece or tokenizers. Repeated rows give repeated rows.
    """
    return present(documents).mapInArrow(_counted(path, kind), "doc_id bigint, tokens bigint")


def packing_invariants(sizes: DataFrame, specs: DataFrame, slack: float = 0.02) -> DataFrame:
    """spec_id, documents, tokens_lost, blocks_over, needless_cuts, tight, for each capacity in use.

    What must hold of any packing: no token is lost or doubled, no block is over its capacity, only documents
    larger than a block are cut, and (tight) there are at most `slack` more blocks than the tokens need, a
    block for each shard aside.
    """
    sizes = checkpointed(sizes.where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("all_tokens")))
    rows = checkpointed(packed(sizes.withColumnRenamed("all_tokens", "tokens"), specs))
    capacity = specs.groupBy("spec_id").agg(F.max("capacity").alias("capacity"))
    blocks = rows.groupBy("spec_id", "shard", "block").agg(F.sum("tokens").alias("n")).join(capacity, "spec_id")
    blocks = blocks.groupBy("spec_id").agg(
        F.count_if(F.col("n") > F.col("capacity")).alias("blocks_over"),
        (F.count("*") <= (1 + slack) * F.ceil(F.sum("n") / F.max("capacity")) + F.countDistinct("shard")).alias("tight"),
    )
    documents = rows.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces")).join(sizes, "doc_id").join(capacity, "spec_id")
    documents = documents.groupBy("spec_id").agg(
        F.count("*").alias("documents"), F.sum(F.abs(F.col("n") - F.col("all_tokens"))).alias("tokens_lost"),
        F.count_if(F.col("pieces") > F.ceil(F.col("all_tokens") / F.col("capacity"))).alias("needless_cuts"),
    )
    return documents.join(blocks, "spec_id").select("spec_id", "documents", "tokens_lost", "blocks_over", "needless_cuts", "tight")
