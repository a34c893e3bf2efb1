"""Aksharas: the syllables that readers of Tamil take as one letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profiles as P

C, V = P.CONSONANTS, P.VOWEL_SIGNS
#: A consonant, up to four more joined by pulli, then signs or a pulli; or any other character.
AKSHARA = rf"([{C}](?:{P.PULLI}[{C}]){{0,4}}(?:[{V}][{V}]?|{P.PULLI})?|(?s:.))"
PUNCTUATION = r"""^[.,;:!?"'()\-–—…/\\@#$%^&*_+=\[\]{}|<>~`]$"""
KINDS = ("vowel", "aytham", "digit", "symbol", "conjunct", "consonant_pulli", "consonant_vowel", "space", "latin", "punctuation", "other")


def aksharas(text: Column) -> Column:
    """The units of a text in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(AKSHARA), F.lit(1))


def kind(unit: Column) -> Column:
    """The kind of a unit, one of KINDS."""
    return (
        F.when(unit.rlike(f"^[{P.VOWELS}]$"), "vowel").when(unit == P.AYTHAM, "aytham").when(unit.rlike(f"^[{P.TAMIL_DIGITS}]$"), "digit")
        .when(unit.rlike(f"^[{P.SYMBOLS}]$"), "symbol").when(unit.rlike(f"^[{C}]{P.PULLI}[{C}]"), "conjunct")
        .when(unit.rlike(f"^[{C}]{P.PULLI}$"), "consonant_pulli").when(unit.rlike(f"^[{C}]"), "consonant_vowel")
        .when(unit.rlike(f"^[{P.WS}]$"), "space").when(unit.rlike("^[A-Za-z]$"), "latin").when(unit.rlike(PUNCTUATION), "punctuation").otherwise("other")
    )


def is_tamil_unit(unit: Column) -> Column:
    return kind(unit).isin("vowel", "aytham", "conjunct", "consonant_pulli", "consonant_vowel")


def parts(unit: Column) -> Column:
    """base consonant, vowel sign, whether it ends in pulli."""
    first = lambda inside: F.nullif(F.regexp_extract(unit, f"([{inside}])", 1), F.lit(""))
    return F.struct(first(C).alias("base_consonant"), first(V).alias("vowel_sign"), unit.endswith(P.PULLI).alias("has_pulli"))


def akshara_table(documents: DataFrame) -> DataFrame:
    """doc_id, pos, text, type: a row for each unit."""
    units = documents.select("doc_id", F.posexplode(aksharas(F.col("text"))).alias("pos", "text"))
    return units.withColumn("type", kind(F.col("text")))


def akshara_stats(documents: DataFrame) -> DataFrame:
    """type, total, distinct_units. Units are counted first, so that each kind of unit is classified once."""
    n = documents.select(F.explode(aksharas(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return n.groupBy(kind(F.col("unit")).alias("type")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_units"))


def _column(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(values)], f"{name}_no int, {name} string")


def inventory(spark: SparkSession) -> DataFrame:
    """text, type of all units of the script: vowels, consonants with each sign or pulli, aytham, common conjuncts."""
    single = _column(spark, P.VOWELS, "text").select("text", F.lit("vowel").alias("type"))
    formed = _column(spark, P.CONSONANTS, "base").join(F.broadcast(_column(spark, ["", P.PULLI, *V], "sign")))
    formed = formed.select(F.concat("base", "sign").alias("text"), F.when(F.col("sign") == P.PULLI, "consonant_pulli").otherwise("consonant_vowel").alias("type"))
    rest = _column(spark, [P.AYTHAM, *P.CONJUNCTS], "text").select("text", F.when(F.col("text_no") == 0, "aytham").otherwise("conjunct").alias("type"))
    return single.union(formed).union(rest)


def syllables(spark: SparkSession) -> DataFrame:
    """syllable: the 247 of the native script."""
    formed = _column(spark, P.NATIVE_CONSONANTS, "base").join(F.broadcast(_column(spark, [P.PULLI, "", *V], "sign")))
    return _column(spark, [*P.VOWELS, P.AYTHAM], "syllable").select("syllable").union(formed.select(F.concat("base", "sign")))
