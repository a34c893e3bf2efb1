"""Normalising and cleaning of text. Every function takes and gives a column; null stays null."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profiles as P
from .profiles import TAMIL, ScriptProfile


@F.arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it, and Arrow's only decomposes. ASCII never changes and doesn't go to Python.

    Python looks a text up in the Unicode data faster than Java goes through a regular expression of all characters that compose.
    """
    return F.coalesce(_composed(F.when(F.octet_length(text) > F.length(text), text)), text)


def ustrip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(text, F.lit(P.WS_CHARACTERS))


def replace_all(text: Column, *rules: tuple[str, str]) -> Column:
    """Regular expressions and replacements, one after the other."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def delete(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


URL = rf"https?://[^{P.WS}]+|www\.[^{P.WS}]+"
EMAIL = rf"[^{P.WS}]+@[^{P.WS}]+\.[^{P.WS}]+"
#: The same; tried once for each run between blanks, not at each of its characters.
EMAIL_ONCE = rf"(?<![^{P.WS}]){EMAIL}"
CONTROL = r"[^\P{C}\n\t]"
SQUEEZE = ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"))


#: Matches what the rules of normalize_basic change, but for white space at the ends.
UNTIDY = r"[\x00-\x09\x0b-\x1f\x7f]|\n{3}"


def normalize_basic(text: Column) -> Column:
    """Composed; tabs and carriage returns as a blank; at most one empty line; no control characters."""
    return tidied(nfc(text))


def tidied(text: Column) -> Column:
    return ustrip(replace_all(text, (r"[\t\r]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")))


def fix_joiners(text: Column, script: ScriptProfile = TAMIL) -> Column:
    """Joiners between two letters of the script go, in one pass for each of the two joiners."""
    return replace_all(text, *((rf"([{script.letters}])\x{{{j}}}([{script.letters}])", "$1$2") for j in ("200D", "200C")))


def fix_sequences(text: Column) -> Column:
    """Of several pullis one stays, of several vowel signs the last."""
    return replace_all(text, (P.PULLI + "{2,}", P.PULLI), (r"([\x{0BBE}-\x{0BCC}]){2,}", "$1"))


def numerals(text: Column, mode: str = "preserve") -> Column:
    """Digits as arabic or tamil ones, or as they are."""
    if mode == "arabic":
        return F.translate(text, P.TAMIL_DIGITS, "0123456789")
    return F.translate(text, "0123456789", P.TAMIL_DIGITS) if mode == "tamil" else text


def strip_links(text: Column) -> Column:
    """Web and mail addresses as a blank."""
    return replace_all(text, (URL, " "), (EMAIL_ONCE, " "))


def squeeze_repeats(text: Column, marks: str = "!?.,;:") -> Column:
    """Runs of four or more marks, and of ten or more of any character, as three."""
    return replace_all(text, (rf"([{marks}]){{4,}}", "$1$1$1"), (r"([^\n])\1{9,}", "$1$1$1"))


def normalize_unicode_only(text: Column) -> Column:
    """The part of normalize_deep that is safe when a tokenizer is applied: no stripping, no squeezing."""
    text = delete(nfc(replace_all(text, (r"\r\n?", "\n"))), P.INVISIBLE)
    return fix_sequences(fix_joiners(F.translate(text, P.BLANKS, " " * len(P.BLANKS))))


def normalize_deep(text: Column, mode: str = "preserve") -> Column:
    """All steps of normalising for training; scripts and numbers end up set apart by blanks."""
    text = squeeze_repeats(strip_links(numerals(normalize_unicode_only(text), mode)), "!?.,;:…")
    text = replace_all(text, (CONTROL, ""), *SQUEEZE)
    text = replace_all(text, *((rf"([{x}]+)", " $1 ") for x in (TAMIL.letters, P.LATIN, "0-9")), (r"[ \t]+", " "))
    return ustrip(replace_all(text, (rf"[{P.WS_IN_LINE}]*\n[{P.WS_IN_LINE}]*", "\n")))


def normalize_corpus(text: Column) -> Column:
    """Corpus form: zero-width characters go everywhere, links become blanks, runs are squeezed."""
    text = squeeze_repeats(strip_links(delete(nfc(text), P.ZERO_WIDTH)))
    return ustrip(replace_all(text, *SQUEEZE, (CONTROL, "")))


def isolate_scripts(text: Column, script: ScriptProfile = TAMIL) -> Column:
    """A blank wherever a letter of the script, a Latin letter and a digit meet each other."""
    s, a, d = script.letters, P.LATIN, P.DIGIT
    return F.regexp_replace(text, rf"(?<=[{s}])(?=[{a}{d}])|(?<=[{a}])(?=[{s}{d}])|(?<=[{d}])(?=[{s}{a}])", " ")


def count(text: Column, inside: str) -> Column:
    """How many characters of a class; the others go in runs, which is cheaper than a match for each character."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def script_share(text: Column, inside: str = TAMIL.letters) -> Column:
    """Characters of the class over letters of any script, 0 without letters; signs count above the line only."""
    letters = count(text, r"\p{L}")
    return F.when(letters > 0, count(text, inside) / letters).otherwise(F.lit(0.0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# --- HTML and wiki markup -------------------------------------------------------------------------------

# Lines of a text archive that aren't text.
BOILERPLATE = r"(?i)Project Madurai|www\.projectmadurai\.org|This file was last|Etext preparation|Proof reading|©\s*\d{4}|This e-text"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for name, ch in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def without_elements(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return html


def kept_lines(text: Column, unless: str) -> Column:
    """The stripped lines that are neither empty nor match."""
    return F.array_join(F.filter(F.transform(lines(text), ustrip), lambda x: (F.length(x) > 0) & ~x.rlike(unless)), "\n")


def tags_as_breaks(html: Column) -> Column:
    return unescape(replace_all(html, (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", "\n")))


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles, navigation and the archive's own lines."""
    return kept_lines(normalize_basic(tags_as_breaks(without_elements(html, "script", "style", "nav", "header", "footer"))), BOILERPLATE)


def html_article(html: Column) -> Column:
    """The text of a page's article: <article>, else a <div> of such a class, else <main>, else all; null if not over 100 characters."""
    html = without_elements(html, "script", "style", "nav", "header", "footer", "aside", "iframe", "form")
    ladder = [r"(?is)<article[^>]*>(.*?)</article>", r'(?is)<div[^>]*class="[^"]*(?:article|content|story|body)[^"]*"[^>]*>(.*?)</div>', r"(?is)<main[^>]*>(.*?)</main>"]
    part = F.coalesce(*(F.when(html.rlike(p), F.regexp_extract(html, p, 1)) for p in ladder), html)
    text = normalize_basic(tags_as_breaks(part))
    return F.when(F.length(text) > 100, text)


def links(html: Column) -> Column:
    """The targets of the links, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))


_BRACES, _BRACKETS = re.compile(r"\{\{|\}\}"), re.compile(r"\[\[|\]\]")
_MEDIA = re.compile(r"\[\[\s*(?:file|image|media|படிமம்)\s*:", re.IGNORECASE)


def outermost(text: str, marks: re.Pattern, begins: re.Pattern | None = None) -> list[tuple[int, int]]:
    """The stretches from an opening mark to the one that closes it, at any depth and of a given beginning, that lie in no other such stretch."""
    open_, spans = [], []
    for m in marks.finditer(text):
        if m.group() in ("{{", "[["):
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            if begins is None or begins.match(text, start):
                while spans and spans[-1][0] > start:
                    spans.pop()
                spans.append((start, m.end()))
    return spans


def _without(marks: re.Pattern, begins: re.Pattern | None = None):
    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array) -> pa.Array:
        out = []
        for x in text.to_pylist():
            if x is not None:
                upto, kept = 0, []
                for start, end in outermost(x, marks, begins):
                    kept.append(x[upto:start])
                    upto = end
                x = "".join((*kept, x[upto:]))
            out.append(x)
        return pa.array(out, pa.string())

    return cut


def without_templates(text: Column) -> Column:
    """Templates go, however deep they are nested; a mark without its counterpart stays. Only texts that have any go to Python."""
    return F.coalesce(_without(_BRACES)(F.when(text.contains("{{"), text)), text)


def without_media(text: Column) -> Column:
    """Links to files, images and media go, with all links inside them."""
    return F.coalesce(_without(_BRACKETS, _MEDIA)(F.when(text.rlike(r"(?i)\[\[\s*(?:file|image|media|படிமம்)\s*:"), text)), text)


#: Constructs of wiki markup, and what stays of them. Each is one pass; a reader of the markup takes them in this order.
CONSTRUCTS = {
    "category": (r"(?i)\[\[\s*(?:category|பகுப்பு)\s*:[^\[\]]*\]\]", ""),
    "table": (r"(?s)\{\|.*?\|\}", ""),
    "note": (r"(?s)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", ""),
    "link": (r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", "$1"),
    "outer link": (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
    "tag": (r"</?[a-zA-Z!][^>]*>", ""),
    "emphasis": (r"'{2,}", ""),
    "item": (r"(?m)^[*#]+[ \t]*", ""),
    "heading": (r"(?m)^={2,6}[ \t]*(.*?)[ \t]*={2,6}[ \t]*$", "$1"),
    "break": (r"={2,}\s*", "\n"),
    "gap": (r"\n{3,}", "\n\n"),
}


def wiki(text: Column, *constructs: str) -> Column:
    """The text without templates, and with the named constructs as plain text."""
    return replace_all(without_templates(text), *(rule for name, rule in CONSTRUCTS.items() if name in constructs))


def wiki_plain(text: Column) -> Column:
    """A page as text: no media, notes, tags, emphasis or item marks; links as their labels."""
    return wiki(without_media(text), "note", "link", "outer link", "tag", "emphasis", "item")


def wiki_tidy(text: Column) -> Column:
    """What is left of a parsed page: no categories and tables; the marks of headings are line breaks."""
    return ustrip(wiki(text, "category", "table", "break", "gap"))


def wiki_inline(text: Column) -> Column:
    """A short stretch of markup as text: links as their labels, headings as lines."""
    return wiki(text, "link", "tag", "emphasis", "heading")


def wiki_flat(text: Column) -> Column:
    """wiki_inline without categories and addresses of links to the outside."""
    return wiki(text, "category", "link", "outer link", "tag", "emphasis", "heading")


def clean_piece(piece: Column) -> Column:
    """A tokenizer's piece without its marks for word starts and line ends."""
    return ustrip(delete(piece, "▁ĠĊ"))
