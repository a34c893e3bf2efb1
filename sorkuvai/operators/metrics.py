"""How well a tokenizer fits a corpus: aggregations over token tables and arrays of pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.profiles import LATIN, TAMIL, WS
from ..functions.text import clean_piece, ustrip
from .ordering import running


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{WS}]*[^{WS}]+"))


def size_of(rows: DataFrame, tokens: str) -> Column:
    """How many tokens a row has, of an array of them or a column of their number."""
    return F.size(tokens) if dict(rows.dtypes)[tokens].startswith("array") else F.col(tokens)


def fertility(rows: DataFrame, *by: str, tokens: str = "pieces") -> DataFrame:
    """avg_fertility (all tokens over all words), median_fertility (the upper one), words, tokens of the rows with words.

    rows: text and an array of pieces, or their number. The median is taken by rank over the counts of equal values.
    """
    sized = rows.select(*by, word_count(F.col("text")).alias("_w"), size_of(rows, tokens).alias("_t"))
    counts = sized.where("_w > 0").groupBy(*by, "_w", "_t").agg(F.count("*").alias("_c"))  # rows of one size count once
    counts = counts.groupBy(*by, (F.col("_t") / F.col("_w")).alias("_f")).agg(F.sum("_c").alias("_c"), F.sum(F.col("_t") * F.col("_c")).alias("_t"), F.sum(F.col("_w") * F.col("_c")).alias("_w"))
    if by:
        own = Window.partitionBy(*by)
        before = F.coalesce(F.sum("_c").over(own.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = counts.withColumns({"_before": before, "_n": F.sum("_c").over(own)})
    else:
        ranked = running(counts, ["_f"], _before=F.col("_c")).join(F.broadcast(counts.agg(F.sum("_c").alias("_n"))))  # one row
    upper = F.max(F.when(F.col("_before") <= F.floor(F.col("_n") / 2), F.col("_f")))
    out = ranked.groupBy(*by).agg(F.sum("_t").alias("tokens"), F.sum("_w").alias("words"), upper.alias("median_fertility"))
    return out.where("words > 0").select(*by, "tokens", "words", (F.col("tokens") / F.col("words")).alias("avg_fertility"), "median_fertility")


def compression(rows: DataFrame, *by: str, tokens: str = "pieces") -> DataFrame:
    """bytes, tokens, bytes_per_token."""
    out = rows.groupBy(*by).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(size_of(rows, tokens)).cast("bigint").alias("tokens"))
    return out.withColumn("bytes_per_token", F.col("bytes") / F.greatest("tokens", F.lit(1)))


def roundtrip(rows: DataFrame) -> DataFrame:
    """documents, accuracy: the share of texts that come back the same but for white space, of rows with text and decoded."""
    same = F.regexp_replace(ustrip(F.col("text")), f"[{WS}]+", " ") == ustrip(F.col("decoded"))
    return rows.where("text is not null").agg(F.count("*").alias("documents"), F.avg(same.cast("int")).alias("accuracy"))


def roundtrip_failures(rows: DataFrame, n: int = 5, longest: int = 200) -> DataFrame:
    """doc_id, text, decoded of the first n texts that don't come back, each cut at `longest` characters."""
    bad = rows.where(F.regexp_replace(ustrip(F.col("text")), f"[{WS}]+", " ") != ustrip(F.col("decoded")))
    return bad.orderBy("doc_id", "text").limit(n).select("doc_id", *(F.substring(c, 1, longest).alias(c) for c in ("text", "decoded")))


def coverage(units: DataFrame, vocab: DataFrame, unit: str = "syllable", token: str = "token") -> DataFrame:
    """total, covered, share: units that are a token by themselves, with or without the mark of a word's start."""
    tokens = vocab.select(clean_piece(F.col(token)).alias(unit)).where(F.length(unit) > 0).distinct().withColumn("_in", F.lit(1))
    return units.join(tokens, unit, "left").agg(F.count("*").alias("total"), F.coalesce(F.sum("_in"), F.lit(0)).alias("covered")).withColumn("share", F.col("covered") / F.greatest("total", F.lit(1)))


def missing_units(units: DataFrame, vocab: DataFrame, unit: str = "syllable", token: str = "token") -> DataFrame:
    """The units that no token is."""
    return units.join(vocab.select(clean_piece(F.col(token)).alias(unit)).distinct(), unit, "left_anti")


def boundaries(pieces: Column) -> Column:
    """Where pieces begin in the joined text, without 0."""
    lengths = F.transform(pieces, lambda x: F.length(x))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x))


def boundary_accuracy(rows: DataFrame) -> DataFrame:
    """word, accuracy: the share of expected boundaries that the pieces have; 1 or 0 for a word that shouldn't be cut.

    rows: word, expected, pieces (arrays of at least one piece).
    """
    hit = F.size(F.array_intersect(boundaries(F.col("expected")), F.when(F.size("pieces") > 1, boundaries(F.col("pieces"))).otherwise(F.array().cast("array<int>"))))
    whole = (F.size("pieces") == 1).cast("double")
    return rows.select("word", F.when(F.size("expected") > 1, hit / F.size(F.array_distinct(boundaries(F.col("expected"))))).otherwise(whole).alias("accuracy"))


def leakage(vocab: DataFrame, token: str = "token", strict: bool = False) -> DataFrame:
    """The tokens that hold letters of the script and Latin ones; special tokens don't count. strict: digits of any script beside the script's letters leak too."""
    piece = clean_piece(F.col(token))
    leaks = predicates.is_cross_script(piece)
    if strict:
        leaks = leaks | predicates.has(piece, TAMIL.letters) & piece.rlike(r"\p{Nd}")
    return vocab.where(~predicates.is_special(F.col(token)) & leaks)


def composition(vocab: DataFrame, token: str = "token") -> DataFrame:
    """kind, tokens: special, mixed, tamil, english, number or punctuation, the first that fits; blank tokens have no kind."""
    t, piece = F.col(token), clean_piece(F.col(token))
    kind = (
        F.when(predicates.is_special(t), "special").when(F.length(piece) == 0, None).when(predicates.is_cross_script(piece), "mixed")
        .when(predicates.has(piece, TAMIL.letters), "tamil").when(predicates.has(piece, LATIN), "english").when(piece.rlike(r"\p{Nd}"), "number").otherwise("punctuation")
    )
    return vocab.where(t.isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("tokens"))


def length_distribution(tokens: DataFrame, token: str = "piece", n: str | None = None) -> DataFrame:
    """length, tokens, share of all; n names a column of counts."""
    weight = F.sum(n) if n else F.count("*")
    counts = tokens.groupBy(F.length(token).alias("length")).agg(weight.cast("bigint").alias("tokens"))
    return counts.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))  # a row for each length


def shredding(tokens: DataFrame, token: str = "piece") -> DataFrame:
    """tokens, shredded, share of tokens that begin inside a letter; empty tokens count among all."""
    bad = predicates.starts_with_mark(clean_piece(F.col(token))).cast("int")
    return tokens.agg(F.count("*").alias("tokens"), F.sum(bad).alias("shredded")).withColumn("share", F.col("shredded") / F.greatest("tokens", F.lit(1)))


def unigram_counts(tokens: DataFrame, token: str = "piece", most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """token, n of all tokens, or of the `most` first ones in an order that tells any two rows apart."""
    if most is not None:
        tokens = running(tokens.select(token, *order), order, _place=F.lit(1)).where(F.col("_place") < most)
    return tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """tokens, types, entropy in bits of a table of counts."""
    total = counts.agg(F.sum("n").alias("_all"))
    p = F.col("n") / F.col("_all")
    return counts.join(F.broadcast(total)).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), (-F.sum(p * F.log2(p))).alias("entropy"))


def unigram_perplexity(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """perplexity of held-out counts (token, n) under the add-one model of the train counts.

    The vocabulary is that of train, plus one for all else.
    """
    size = train.agg(F.sum("n").alias("_n"), F.count("*").alias("_v"))
    rows = held_out.select("token", F.col("n").alias("_m")).join(train, "token", "left").join(F.broadcast(size))
    log_p = F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.col("_n") + F.col("_v") + 1))
    return rows.agg(F.exp(-F.sum(F.col("_m") * log_p) / F.sum("_m")).alias("perplexity"), F.sum("_m").alias("tokens"))


def bigram_perplexity(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """perplexity, tokens of the add-one bigram model; both: rows with an array of pieces, whose neighbours are paired where they are."""

    def pairs(t: DataFrame) -> DataFrame:
        two = F.transform(F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda x, k: F.struct(x.alias("piece"), F.get("pieces", k + 1).alias("next")))
        return t.where(F.size("pieces") > 1).select(F.explode(two).alias("p")).groupBy("p.piece", "p.next").agg(F.count("*").alias("n"))

    pair, size = pairs(train), train.select(F.explode("pieces").alias("piece")).agg(F.countDistinct("piece").alias("_v"))
    first = pair.groupBy("piece").agg(F.sum("n").alias("_first"))
    rows = pairs(held_out).withColumnRenamed("n", "_m").join(pair, ["piece", "next"], "left").join(first, "piece", "left").join(F.broadcast(size))
    log_p = F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("_first", F.lit(0)) + F.col("_v") + 1))
    return rows.agg(F.exp(-F.sum(F.col("_m") * log_p) / F.sum("_m")).alias("perplexity"), F.sum("_m").alias("tokens"))


def token_stats(rows: DataFrame, *by: str, tokens: str = "pieces") -> DataFrame:
    """tokens_per_word, bytes_per_token, bits_per_token (eight for each byte) of rows with text."""
    n = rows.groupBy(*by).agg(F.sum(size_of(rows, tokens)).alias("_t"), F.sum(word_count(F.col("text"))).alias("_w"), F.sum(F.octet_length("text")).alias("_b"))
    each = F.col("_b") / F.greatest("_t", F.lit(1))
    return n.select(*by, (F.col("_t") / F.greatest("_w", F.lit(1))).alias("tokens_per_word"), each.alias("bytes_per_token"), (each * 8).alias("bits_per_token"))


def bits_per_character(loss: Column, bytes_per_token: Column) -> Column:
    """A model's loss a token (natural logarithm) as bits a byte."""
    return loss * F.lit(1.4426950408889634) / bytes_per_token


def perplexity_per_word(perplexity: Column, tokens_per_word: Column) -> Column:
    return F.pow(perplexity, tokens_per_word)


def improvement(base: Column, own: Column) -> Column:
    """Percent by which own is below base."""
    return (base - own) / base * 100


# Metric, target and the side of it that passes.
TARGETS = (
    ("avg_fertility", 1.5, "<="), ("bytes_per_token", 4.0, ">="), ("roundtrip_accuracy", 1.0, ">="),
    ("tamil_syllable_coverage", 0.95, ">="), ("morpheme_boundary_accuracy", 0.7, ">="), ("cross_script_leakage_count", 0.0, "<="),
)


def target_check(metrics: DataFrame, targets=TARGETS) -> DataFrame:
    """metric, value, target, op, status (PASS, FAIL or SKIP), and a row overall that fails if any does. metrics: metric, value."""
    spark = metrics.sparkSession
    rows = spark.createDataFrame(list(targets), "metric string, target double, op string").join(metrics, "metric", "left")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    rows = rows.select("metric", "value", "target", "op", F.when(F.col("value").isNull() | F.col("target").isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL").alias("status"))
    none = F.lit(None)
    overall = rows.agg(F.max((F.col("status") == "FAIL").cast("int")).alias("bad")).select(F.lit("overall").alias("metric"), none.cast("double").alias("value"), none.cast("double").alias("target"), none.cast("string").alias("op"), F.when(F.col("bad") == 1, "FAIL").otherwise("PASS").alias("status"))
    return rows.union(overall)
