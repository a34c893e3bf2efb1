"""Which lines, documents, characters and tokens are taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profiles as P
from .profiles import TAMIL, ScriptProfile
from .text import count, isolate_scripts, lines, normalize_basic, normalize_corpus, script_share, ustrip

RUNS = r"([\p{L}\p{N}_]+)"
ENGLISH = "^[A-Za-z]{2,}$"
CONSECUTIVE = rf"(^|[^\p{{L}}\p{{N}}_])([A-Za-z]+[{P.WS},;:]+){{5,}}"


def words(text: Column) -> Column:
    """How many words between white space: how many begin, since Java is slow at runs of what isn't in a class."""
    return F.regexp_count(text, F.lit(f"(?:^|[{P.WS}])[^{P.WS}]"))


def english_words(text: Column) -> Column:
    """How many runs of letters and digits are two or more Latin letters."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(RUNS), F.lit(1)), lambda w: w.rlike(ENGLISH)))


def line_reason(line: Column, least_share: float = 0.6, most_english: float = 0.4, shortest: int = 20, longest: int = 50_000, script: ScriptProfile = TAMIL) -> Column:
    """Why a line isn't kept: too_short, too_long, no_tamil, low_tamil, consecutive_english, english_words; null if it is."""
    line = ustrip(line)
    # What several conditions need is worked out once, as the fields of a struct.
    measured = F.struct(line.alias("line"), count(line, script.letters).alias("own"), count(line, P.LATIN).alias("latin"))

    def reason(m: Column) -> Column:
        x, own, n = m["line"], m["own"], F.length(m["line"])
        english = F.when(m["latin"] > 0, english_words(x) / words(x)).otherwise(0.0)
        return (
            F.when(n < shortest, "too_short").when(n > longest, "too_long")
            .when(own == 0, f"no_{script.name}").when(own / (own + m["latin"]) < least_share, f"low_{script.name}")
            .when((m["latin"] > 0) & x.rlike(CONSECUTIVE), "consecutive_english").when(english > most_english, "english_words")
        )

    return F.transform(F.array(measured), reason)[0]


def is_quality_line(line: Column, **limits) -> Column:
    return line_reason(line, **limits).isNull() & line.isNotNull()


def clean_and_filter(text: Column, least_share: float = 0.6) -> Column:
    """The good lines of a text, an empty one between paragraphs."""
    good = F.filter(F.transform(lines(normalize_basic(text)), ustrip), lambda x: (x == "") | is_quality_line(x, least_share=least_share))
    # An empty line stays if there is one before it and that isn't empty.
    kept = F.aggregate(good, F.array().cast("array<string>"), lambda out, x: F.when((x == "") & (F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")) == ""), out).otherwise(F.concat(out, F.array(x))))
    return F.array_join(kept, "\n")


def document_reason(text: Column, shortest: int = 20, longest: int = 100_000, most_latin: float = 0.3, least_share: float = 0.4) -> Column:
    """Of a text that is prepared already: too_short, english, tamil, or null. Texts are judged by their first `longest` characters."""
    cut = F.substring(text, 1, longest)
    return F.when(F.length(text) < shortest, "too_short").when(script_share(cut, P.LATIN) > most_latin, "english").when(script_share(cut) < least_share, "tamil")


def prepared(text: Column, longest: int = 100_000) -> Column:
    """The corpus form with scripts apart, cut at `longest` characters."""
    return F.substring(isolate_scripts(normalize_corpus(text)), 1, longest)


def is_language(text: Column, script: ScriptProfile = TAMIL, least: float = 0.5) -> Column:
    """Language by script alone."""
    return script_share(text, script.letters) > least


def has(text: Column, inside: str) -> Column:
    return text.rlike(f"[{inside}]")


def is_cross_script(token: Column, script: ScriptProfile = TAMIL) -> Column:
    return has(token, script.letters) & has(token, P.LATIN)


def is_special(token: Column) -> Column:
    return token.startswith("<") & token.endswith(">")


#: Kinds of Tamil characters by name.
CHARACTER_KINDS = {"vowel": P.VOWELS, "consonant": P.CONSONANTS, "sign": P.VOWEL_SIGNS, "pulli": P.PULLI, "grantha": P.GRANTHA, "aytham": P.AYTHAM}


def is_kind(character: Column, kind: str) -> Column:
    """Whether one character is of a kind of CHARACTER_KINDS, or with `tamil` of the script at all."""
    return character.rlike(rf"^[{TAMIL.letters if kind == 'tamil' else CHARACTER_KINDS[kind]}]\z")


def is_invalid_boundary(word: Column, at: Column) -> Column:
    """Whether a cut after `at` characters, inside the word, would part a mark from its letter."""
    return (at > 0) & (at < F.length(word)) & starts_with_mark(F.substring(word, at + 1, F.lit(1)))


def starts_with_mark(text: Column) -> Column:
    """Whether a piece begins with a sign that belongs to a letter before it."""
    return text.rlike(r"^[\p{Mn}\p{Mc}]")
