"""Joining a new vocabulary to a base one, and first embeddings for what was added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import has, is_special
from ..functions.profiles import TAMIL, ScriptProfile
from ..functions.text import clean_piece
from .ordering import running


def script_tokens(vocab: DataFrame, script: ScriptProfile = TAMIL) -> DataFrame:
    """token, piece of the tokens that hold letters of the script; special ones are left out."""
    piece = clean_piece(F.col("token"))
    return vocab.where(~is_special(F.col("token")) & has(piece, script.letters)).select("token", piece.alias("piece"))


def variants(token):
    """The spellings under which another vocabulary may have a token."""
    return F.array_distinct(F.array(token, F.regexp_replace(token, "^▁+", ""), F.concat(F.lit("▁"), token), F.regexp_replace(token, "^Ġ+", ""), F.concat(F.lit("Ġ"), token)))


def new_tokens(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens of which the base has no spelling, each once."""
    each = candidates.select("token").where("token is not null").distinct()
    known = each.select("token", F.explode(variants(F.col("token"))).alias("spelled")).join(base.select(F.col("token").alias("spelled")).distinct(), "spelled", "left_semi").select("token").distinct()
    return each.join(known, "token", "left_anti")


def joined(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """token_id, token, added: the base's tokens, then the new ones in the order of their text.

    New ones are numbered range by range, so that any number of them spreads over the tasks.
    """
    last = base.agg(F.coalesce(F.max("token_id"), F.lit(-1)).alias("last"))
    fresh = running(new_tokens(candidates, base), ["token"], k=F.lit(1)).join(F.broadcast(last))  # one row
    fresh = fresh.select((F.col("last") + F.col("k") + 1).cast("int").alias("token_id"), "token", F.lit(True).alias("added"))
    return base.select("token_id", "token", F.lit(False).alias("added")).unionByName(fresh)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tokens of a that b doesn't have."""
    return a.select("token").distinct().join(b.select("token"), "token", "left_anti")


def mean_embeddings(parts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """token, embedding: for each token the mean, dimension by dimension, of the vectors of its old pieces.

    parts: token, vec_ids (array). embeddings: vec_id, embedding. Pieces without a vector don't count; a
    token with none gets the mean of all vectors.
    """
    dims = embeddings.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    overall = dims.groupBy("dim").agg(F.avg("x").alias("mean"))
    wanted = parts.select("token", F.explode_outer("vec_ids").alias("vec_id"))
    found = wanted.join(dims, "vec_id").groupBy("token", "dim").agg(F.avg("x").alias("mean"))
    rest = parts.select("token").distinct().join(found.select("token").distinct(), "token", "left_anti").join(F.broadcast(overall))  # a row for each dimension
    both = found.select("token", "dim", "mean").unionByName(rest.select("token", "dim", "mean"))
    return both.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("all")).select("token", F.transform("all", lambda v: v["mean"]).alias("embedding"))


def with_noise(vectors: DataFrame, deviation: float = 0.02, seed: int = 42) -> DataFrame:
    """The vectors with normal noise that only depends on the token and the seed."""
    uniform = lambda k, name: (F.pmod(F.xxhash64("token", k, F.lit(f"{name}{seed}")), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = lambda k: F.sqrt(-2 * F.ln(uniform(k, "a"))) * F.cos(2 * F.pi() * uniform(k, "b"))
    return vectors.withColumn("embedding", F.transform("embedding", lambda x, k: x + deviation * normal(k)))


def random_embeddings(tokens: DataFrame, embeddings: DataFrame, seed: int = 42) -> DataFrame:
    """token, embedding: normal numbers with the mean and deviation that each dimension has in the given vectors."""
    dims = embeddings.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    shape = dims.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("dims"))  # a row of as many entries as dimensions
    zero = tokens.select("token").distinct().join(shape).select("token", "dims", F.transform("dims", lambda d: F.lit(0.0)).alias("embedding"))
    noisy = with_noise(zero, 1.0, seed)
    return noisy.select("token", F.zip_with("embedding", "dims", lambda x, d: d["mean"] + x * d["sd"]).alias("embedding"))


def norm(vector):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def norm_report(embeddings: DataFrame, group: str = "label") -> DataFrame:
    """group, vectors, mean_norm, std_norm and ratio to the mean of all; warn if the ratio is under 0.1 or over 10."""
    rows = embeddings.select(group, norm(F.col("embedding")).alias("norm"))
    all_ = rows.agg(F.avg("norm").alias("all_mean"))
    out = rows.groupBy(group).agg(F.count("*").alias("vectors"), F.avg("norm").alias("mean_norm"), F.stddev_samp("norm").alias("std_norm")).join(F.broadcast(all_))
    ratio = F.col("mean_norm") / F.col("all_mean")
    return out.select(group, "vectors", "mean_norm", "std_norm", ratio.alias("ratio"), ((ratio < 0.1) | (ratio > 10)).alias("warn"))
