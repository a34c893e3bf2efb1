"""Cutting text into the pieces inside which a tokenizer may join characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import TAMIL, WS

T = TAMIL.letters
#: Contractions, runs of Tamil, Latin and digits, symbols with a blank before, blanks one by one.
PRETOKEN = rf"('s|'t|'re|'ve|'m|'ll|'d|[{T}]+|[a-zA-Z]+|[0-9]+| ?[^{WS}{T}a-zA-Z0-9]+|[{WS}]+(?![^{WS}])|[{WS}])"
#: The same without look-ahead: blanks at the end are single pieces.
PRETOKEN_PLAIN = rf"('s|'t|'re|'ve|'m|'ll|'d|[{T}]+|[a-zA-Z]+|[0-9]+| ?[^{WS}{T}a-zA-Z0-9]+|[{WS}])"
#: Numbers, letters without their signs, symbols; what lies between is a piece too.
SCRIPT_SPLIT = rf"(\p{{Nd}}+|\p{{L}}+|[^{WS}\p{{L}}\p{{N}}_]+)"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(1))


def plain_pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PLAIN), F.lit(1))


def script_pieces(text: Column) -> Column:
    """Cut by script: every match and every gap is a piece."""
    return F.regexp_extract_all(text, F.lit(SCRIPT_SPLIT[:-1] + rf"|[{WS}_\p{{N}}]+?(?=\p{{Nd}}|\p{{L}}|[^{WS}\p{{L}}\p{{N}}_]|\z))"), F.lit(1))


#: Bytes that are shown as the character of their number; the others as those from U+0100 on, in order.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
HIDDEN = [b for b in range(256) if b not in SHOWN]
#: Contractions, words and numbers with the blank before them, other signs, blanks.
BYTE_LEVEL_SPLIT = rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+)"


def byte_level(text: Column) -> Column:
    """The UTF-8 bytes of a text, each as a character that can be seen. As Latin-1 every byte is a character, so that this stays in the JVM."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(map(chr, HIDDEN)), "".join(chr(256 + k) for k in range(len(HIDDEN))))


def byte_level_pieces(pieces: Column, split: bool = True) -> Column:
    """Pieces as bytes, cut before as a byte-level tokenizer cuts them, or not."""
    each = F.flatten(F.transform(pieces, lambda x: F.regexp_extract_all(x, F.lit(BYTE_LEVEL_SPLIT), F.lit(1)))) if split else pieces
    return F.transform(each, byte_level)


def at_marker(text: Column, marker: str = " @@ ", keep: bool = True) -> Column:
    """Cut at a marker, which stays as a piece of its own or goes."""
    if not keep:
        return F.split(text, marker, -1)
    return F.filter(F.split(text, f"(?={marker})|(?<={marker})", -1), lambda x: x != "")


def marked_script_pieces(text: Column, marker: str = "@@", keep: bool = True) -> Column:
    """Cut at the marker, then by script."""
    return F.flatten(F.transform(at_marker(text, marker, keep), lambda x: F.when(x == marker, F.array(x)).otherwise(script_pieces(x))))
