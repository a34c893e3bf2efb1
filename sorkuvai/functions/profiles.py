"""Character classes, written so that Java's and RE2's regular expressions read them alike."""

from __future__ import annotations

from dataclasses import dataclass

#: White space as Python's str.split and str.strip have it.
WS = r"\x09-\x0d\x1c-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The characters themselves.
WS_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: WS without the line feed.
WS_IN_LINE = r"\x09\x0b-\x0d\x1c-\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LATIN = "A-Za-z"
#: Decimal digits other than Tamil ones, and superscripts.
DIGIT = r"0-9\x{B2}\x{B3}\x{B9}\x{0966}-\x{096F}\x{0C66}-\x{0C6F}\x{0CE6}-\x{0CEF}\x{0D66}-\x{0D6F}\x{FF10}-\x{FF19}"

# Tamil letters by kind.
VOWELS = "அஆஇஈஉஊஎஏஐஒஓஔ"
NATIVE_CONSONANTS = "கஙசஞடணதநபமயரலவழளறன"
GRANTHA = "ஜஶஷஸஹ"
VOWEL_SIGNS = "ாிீுூெேைொோௌ"
PULLI = "்"
AYTHAM = "ஃ"
TAMIL_DIGITS = "௦௧௨௩௪௫௬௭௮௯"
SYMBOLS = "௰௱௲ௐௗ"
CONSONANTS = "".join(sorted(NATIVE_CONSONANTS + GRANTHA))
# Conjuncts of the inventory.
CONJUNCTS = ("க்ஷ", "க்ஷி", "க்ஷை", "ஸ்ர", "ஸ்ரீ", "த்ர", "த்ரி")

# Invisible characters that are always removed, and blanks that become a space.
INVISIBLE = "\u200B\uFEFF\u00AD\u200E\u200F\u2028\u2029\u2060\u180E\u034F"
BLANKS = "\u00A0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
# Zero-width characters of corpus normalisation.
ZERO_WIDTH = "\u200B\u200C\u200D\uFEFF\u00AD\u200E\u200F\u2028\u2029"


@dataclass(frozen=True)
class ScriptProfile:
    """What an operator needs to know of its script: name, and the inside of its character class."""

    name: str
    letters: str


TAMIL = ScriptProfile("tamil", r"\x{0B80}-\x{0BFF}")
DEVANAGARI = ScriptProfile("devanagari", r"\x{0900}-\x{097F}")
TELUGU = ScriptProfile("telugu", r"\x{0C00}-\x{0C7F}")
KANNADA = ScriptProfile("kannada", r"\x{0C80}-\x{0CFF}")
MALAYALAM = ScriptProfile("malayalam", r"\x{0D00}-\x{0D7F}")
