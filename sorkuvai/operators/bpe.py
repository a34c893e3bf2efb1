"""Applying a byte-pair tokenizer that is given as tables. Tokenizers are never trained here."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_START = "▁"
WORDS_KEPT = 300_000
#: Rows of a vocabulary or of merges that are sent to every executor; larger tokenizers are refused.
TABLE_ROWS = 2_000_000


class Bpe:
    """White space splits words, ▁ before each; adjacent pieces join in the order of the merges.

    A character that isn't in the vocabulary becomes its UTF-8 bytes, <0x00> to <0xFF>.
    """

    def __init__(self, vocab: list[str], merges: list[tuple[str, str]]) -> None:
        self.vocab = frozenset(vocab)
        self.ranks: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(merges):
            self.ranks.setdefault(pair, k)
        self.counts: dict[str, int] = {}
        self.cuts: dict[str, list[str]] = {}

    def _joined(self, word: str) -> list[str]:
        parts, ranks, never = list(word), self.ranks, len(self.ranks)
        while len(parts) > 1:
            rank, k = min((ranks.get(pair, never), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == never:
                break
            a, b = parts[k], parts[k + 1]
            out, k = [], 0
            while k < len(parts):
                if parts[k] == a and k + 1 < len(parts) and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def pieces(self, word: str) -> list[str]:
        """The tokens of a word."""
        out: list[str] = []
        for part in self._joined(WORD_START + word):
            for x in [part] if part in self.vocab else part:
                out += [x] if x in self.vocab else [f"<0x{b:02X}>" for b in x.encode("utf-8", "surrogatepass")]
        return out

    def count(self, text: str) -> int:
        """How many tokens a text has."""
        known, words = self.counts, text.split()
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = len(self.pieces(w))
        return sum(map(known.__getitem__, words))

    def encode(self, text: str) -> list[str]:
        known, words = self.cuts, text.split()
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.pieces(w)
        return [p for w in words for p in known[w]]


def decode(pieces: list[str]) -> str:
    """The text of tokens: bytes are put together, ▁ is a blank, none before the first word."""
    out = bytearray()
    for p in pieces:
        out += bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.encode()
    return out.decode("utf-8", "replace").replace(WORD_START, " ").removeprefix(" ")


def tables(vocab: DataFrame, merges: DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    """The pieces and the merges in order. Rows with a null piece and special tokens take no part; equal ranks count in the order of their pieces."""
    pieces = [r[0] for r in vocab.where("token is not null and not coalesce(is_special, false)").select("token").distinct().orderBy("token").limit(TABLE_ROWS + 1).collect()]
    pairs = merges.where("left_piece is not null and right_piece is not null").select("merge_rank", "left_piece", "right_piece").distinct()
    rows = pairs.orderBy("merge_rank", "left_piece", "right_piece").limit(TABLE_ROWS + 1).collect()
    if max(len(pieces), len(rows)) > TABLE_ROWS:
        raise ValueError(f"a tokenizer of more than {TABLE_ROWS} pieces or merges")
    return pieces, [(r[1], r[2]) for r in rows]


def _encoded(vocab: list[str], merges: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocab, merges)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                cut = [bpe.encode(x or "") for x in part.column(part.schema.get_field_index("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cut, pa.list_(pa.string())), pa.array(map(decode, cut), pa.string())], [*part.schema.names, "pieces", "decoded"])

    return run


def encoded(documents: DataFrame, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """The documents' columns, pieces, decoded; a null text has no pieces. Columns named so in the documents are replaced."""
    rest = documents.drop("pieces", "decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("decoded", T.StringType())])
    return rest.mapInArrow(_encoded(*tables(vocab, merges)), schema)


def token_table(documents: DataFrame, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """doc_id, pos, token_id, piece; token_id is null for bytes that the vocabulary has no token for."""
    ids = vocab.where("token is not null").groupBy(F.col("token").alias("piece")).agg(F.min("token_id").alias("token_id"))
    rows = encoded(documents.select("doc_id", "text"), vocab, merges).select("doc_id", F.posexplode("pieces").alias("pos", "piece"))
    return rows.join(ids, "piece", "left").select("doc_id", "pos", "token_id", "piece")


def pair_counts(words: DataFrame, pieces: Column) -> DataFrame:
    """left_piece, right_piece, n: how often two pieces stand side by side, words weighted by their count n.

    What would be merged next is the first row by n, then by the pieces.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: F.struct(F.element_at("_p", k).alias("left_piece"), F.element_at("_p", k + 1).alias("right_piece")))
    rows = words.withColumn("_p", pieces).where(F.size("_p") > 1).select("n", F.explode(pairs).alias("pair"))
    return rows.groupBy("pair.left_piece", "pair.right_piece").agg(F.sum("n").alias("n"))
