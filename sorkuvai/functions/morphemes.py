"""Rule-based morphemes: suffixes are taken off a word's end, the longest first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiles import WS

# Suffixes that are split off, by family. Those that begin with a sign can never be split off and are left out.
PLURALS = "கள் க்கள் ங்கள் ற்கள் ட்கள் களி க்களி ங்களி ற்களி ட்களி ளை ணை றை க்கள ச்சள த்தள".split()
CASES = """
ஐ யை வை எய் ையை ஆல் வால் லால் ஆளை கு க்கு உக்கு க்கே க்கம் க்கள் க்ககம் இன் வின் னின் அது வது னது ஆந்தை ஆன
இல் வில் லில் யில் கம் ளிறமு ஐல் செல் இருந்து லிருந்து விலிருந்து திலிருந்து ளிலிருந்து உடன் வுடன் னுடன் ளோடு
அளவு அளவிற்கு ஆய ஆக வும்
""".split()
CLITICS = "ஏ ஓ ஆ உம் தான் ஆவது".split()
VERBS = """
கின்றன கின்றாய் கின்றேன் கின்றோம் கின்றீர் கிறான் கிறாள் கிறது கிற கிறேன் கிறோம் கார் கியே கையே
ந்தன ந்தாய் ந்தேன் ந்தோம் ந்தீர் ந்தான் ந்தாள் ந்தது த்தன த்தாய் த்தேன் த்தோம் த்தீர் த்தான் த்தாள் த்தது
டன டாய் டேன் டோம் டீர் ட்டான் ட்டாள் ட்டது
ப்பார்கள் ப்பான் ப்பாள் ப்பு ப்ப ப்போம் ப்பீர் ப்பீர்கள் ப்பேன் ப்போமா ப்பீர்க ப்பார்க ப்பாய்
க்கிற க்கின்ற க்க க்கவு க்கும் க்கை வும் வக வதா
மாட்டான் மாட்டாள் மாட்டோம் மாட்டார் மாட்டது மாட்டே மாட்டுமா வில்லை விட்டீர்
முடியும் முடியாது முடியான் முடிந்த முடியாமை முடியவில்லை கிறவன கிறவள
வேண்டும் வேண்டிய வேண்டுகிற வேண்டாம் வேண்டான் வேண்டாத கொண்ட கொண்டு கொள்ள கொண்டே கொள்
விட்டு விப்ப விய ப்படு ப்படுகிற ப்படுவ ப்பட்ட ப்படும் ங்கள் மார் வார் த்
க்கக க்கலாம் க்கலை க்கல avai iye
""".split()
# Consonants that join morphemes.
SANDHI = "க் ச் த் ப்".split()

ROUNDS = 5
SHORTEST_STEM = 4
SUFFIXES = tuple(dict.fromkeys(x for x in (*PLURALS, *CASES, *CLITICS, *VERBS) if not re.match("[ா-்]", x)))


def suffix_pattern(suffixes=SUFFIXES) -> str:
    """Matches the longest suffix at the end: of the matches that reach the end the leftmost is the longest."""
    return "(" + "|".join(sorted(suffixes, key=lambda x: (-len(x), x))) + r")\z"


SANDHI_PATTERN = "(" + "|".join(SANDHI) + r")\z"


def segmented(words: DataFrame, word: str = "word", suffixes=SUFFIXES, rounds: int = ROUNDS, shortest_stem: int = SHORTEST_STEM) -> DataFrame:
    """The words with their morphemes in an array; joined they give the word.

    Meant for distinct words, so that each is cut once. A round takes the longest suffix off; if that would
    leave a stem of less than shortest_stem characters it ends the cutting, no shorter one is tried. After
    a suffix one joining consonant goes too. A null or empty word has no morphemes.
    """
    pattern = suffix_pattern(suffixes)
    out = words.withColumns({"_stem": F.coalesce(F.col(word), F.lit("")), "_cut": F.array().cast("array<string>"), "_on": F.lit(True)})
    for _ in range(rounds):
        out = out.withColumn("_suffix", F.when(F.col("_on"), F.regexp_extract("_stem", pattern, 1)).otherwise(""))
        left = F.length("_stem") - F.length("_suffix")
        out = out.withColumn("_on", (F.col("_suffix") != "") & (left >= shortest_stem))
        out = out.withColumn("_stem", F.when(F.col("_on"), F.expr("left(_stem, length(_stem) - length(_suffix))")).otherwise(F.col("_stem")))
        out = out.withColumn("_joint", F.when(F.col("_on"), F.regexp_extract("_stem", SANDHI_PATTERN, 1)).otherwise(""))
        out = out.withColumn("_cut", F.when(F.col("_on"), F.concat(F.array("_joint", "_suffix"), F.col("_cut"))).otherwise(F.col("_cut")))
        out = out.withColumn("_stem", F.expr("left(_stem, length(_stem) - length(_joint))"))
    out = out.withColumn("morphemes", F.filter(F.concat(F.array("_stem"), F.col("_cut")), lambda x: x != ""))
    return out.drop("_stem", "_cut", "_on", "_suffix", "_joint")


def marked(morphemes: Column, separator: str = "@@ ") -> Column:
    """Morphemes as one string; training uses the separators ' @@ ' and '@@' as well."""
    return F.array_join(morphemes, separator)


def word_counts(documents: DataFrame, inside: str | None = None) -> DataFrame:
    """word, n over all documents; with `inside` only words wholly of that character class."""
    each = documents.select(F.explode(F.regexp_extract_all("text", F.lit(f"([^{WS}]+)"), F.lit(1))).alias("word"))
    if inside:
        each = each.where(F.col("word").rlike(rf"^[{inside}]+\z"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


def segmented_texts(documents: DataFrame, separator: str = " @@ ", word_separator: str = " ") -> DataFrame:
    """doc_id, text with the morphemes of every word set apart; words are cut once each and joined back."""
    words = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"([^{WS}]+)"), F.lit(1))).alias("pos", "word"))
    cut = segmented(words.select("word").distinct()).select("word", marked(F.col("morphemes"), separator).alias("cut"))
    placed = words.join(cut, "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cut"))).alias("all"))
    return placed.select("doc_id", F.array_join(F.transform("all", lambda x: x["cut"]), word_separator).alias("text"))
