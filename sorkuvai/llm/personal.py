"""Problem 10: personal details in free text, and the text with typed placeholders instead.

Information-theoretic sanitisation. Patterns only suggest what may be a detail: mail addresses, numbers that
a telephone or identity card may have, a house number with a street, parts of names from a list. Whether it
is one is decided by what the whole corpus tells, in two steps:

- A term (the one or two words before a suggestion) reveals a kind if of all its places a share of SHARE or
  more is followed by a suggestion of the kind, and that is INFORMATION bits or more above the kind's share
  in general.
- A form (the layout of a number, the spelling of a mail address, a name itself) reveals a kind if a share of
  SHARE or more of its places, and so many bits more than in general, stand after such terms. A form that was
  hardly seen is judged as all forms of its kind together.

What stands after a revealing term, or has a revealing form, is replaced, and so is a name in no list after
a term that reveals persons. A layout that many numbers have, which are mostly none, thus counts only after
terms; one that is hardly ever anything else counts wherever it stands.

Two passes over the corpus count: the suggestions by form and terms, then all places of those terms. A third
replaces. Terms, forms and their places stay tables; only a bitmap of the terms' hashes, which says what
places to count, and the terms and forms beyond the thresholds are ever brought together.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import checkpointed
from .batches import bitmap, pieces
from .unify import one_form, present

KINDS = ("email", "phone", "id_number", "address", "person")
#: Thresholds of disclosure of a term or form: share of its places, bits more than in general, and how often it must have been seen.
SHARE, INFORMATION, SEEN = 0.25, 3.0, 2
TERM_EDGE = " .,:;<>()[]{}\"'=-–"
#: Words and terms that a task remembers at once.
COUNTED_AT_ONCE = 100_000
NAME_PARTS_AT_MOST = 1_000_000

TAMIL_DIGITS = str.maketrans("௦௧௨௩௪௫௬௭௮௯", "0123456789")
_AT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|@)"
_DOT = r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\.)"
EMAIL = regex.compile(rf"(?i)[a-z0-9][a-z0-9._+\-]*(?:{_AT}[a-z0-9\-]+(?:{_DOT}[a-z0-9\-]+)+|\sat\s[a-z0-9\-]+(?:\sdot\s[a-z0-9\-]+)+)")
_NO, _END = r"(?<![\p{L}\d+(]|\d[\-.,/ ])", r"(?![\p{L}\d]|[\-./,:]\d| \d)"
#: Layouts of numbers: with a country or area code, telephone numbers without, identity numbers.
PHONE_SURE = regex.compile(rf"{_NO}(?:(?:\+|00)91[ \-.]?\(?\d{{3,5}}\)?[ \-.]?\d{{3,5}}(?:[ \-.]?\d{{3,4}})?|\(0\d{{2,4}}\) ?\d{{3,4}}[ \-]?\d{{3,4}}){_END}")
PHONE_LIKE = regex.compile(rf"{_NO}(?:\d{{10}}|0\d{{2,4}}[ \-]\d{{6,8}}|\d{{3}}([ .\-])\d{{3}}\1\d{{4}}|\d{{5}}[ \-]\d{{5}}){_END}")
ID_LIKE = regex.compile(rf"{_NO}(?:\d{{4}}([ \-])\d{{4}}\1\d{{4}}|\d{{12}}|[A-Z]{{5}}\d{{4}}[A-Z]|[A-Z]{{3}}\d{{7}}|[A-Z]\d{{7}}){_END}")
# Words for a street or quarter, and for a house or plot.
STREETS = "தெரு|வீதி|சாலை|நகர்|சந்து|காலனி|குடியிருப்பு|Street|St\\.|Lane|Road|Rd\\.|Nagar|Colony|Avenue|Layout|Cross|Towers|Apartments"
HOUSES = "கதவு எண்|வீட்டு எண்|மனை எண்|பழைய எண்|புதிய எண்|எண்|Door No|House No|Flat No|Plot No|No|Flat|Plot|House|Door|H\\.No|D\\.No"
_NUMBER = r"\d{1,4}(?:/\d{1,3})?[A-Z]?"
_HOUSE = rf"(?:(?:{HOUSES})\s?[.:]?\s?{_NUMBER}(?:,?\s)"
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{M}}\d/])(?:{_HOUSE}){{1,2}}|{_NUMBER},\s|\d{{1,4}}/\d{{1,3}}\s)(?:[\p{{L}}\p{{M}}\d]+[ ,]\s?){{0,4}}?(?:{STREETS})(?: (?:{STREETS}))*(?![\p{{L}}\p{{M}}])"
    rf"|(?<![\p{{L}}\p{{M}}])[\p{{L}}\p{{M}}]+ (?:{STREETS}),\s(?:{HOUSES})\s?[.:]?\s?{_NUMBER}"
)
ADDRESS_REST = regex.compile(r"(?:, [\p{L}\p{M}]+(?: (?:Main Road|அஞ்சல்|Post))?){0,2}(?: ?- ?| )?(?:\d{6})?")
STREET_WORDS = tuple(STREETS.replace("\\", "").split("|"))
#: A number with what may stand between its digits; every number shape lies in one, but for capitals around it.
NUMBER_RUN = re.compile(r"[+(]*\d(?:[\d ().\-+/]*\d)?")
FEWEST_DIGITS, CAPITALS_AROUND = 8, 5
TAMIL_DIGIT = re.compile("[௦-௯]")
MAIL_RUN = re.compile(r"[A-Za-z0-9._+\-@]*")
AT_SIGN = re.compile(r"[\[({<] ?[aA][tT] ?[\])}>]")
MAIL_SIGNS = re.compile(r"@| ?[\[({<] ?at ?[\])}>]| at \S+ dot ", re.I)
_INITIALS = r"(?:(?:\p{Lu}|[க-ஹஅ-ஔ][ா-்]?)\. ?)+"
_NAME = r"(?:\p{Lu}\p{Ll}+|[஀-௥]{3,})"
NAME = regex.compile(rf"({_NAME})(?: {_INITIALS})?(?![\p{{L}}\p{{M}}@])")
BEFORE_NAME = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{_INITIALS})$")
NAME_INITIALS = regex.compile(_INITIALS)
AFTER_TERM = re.compile(r"[.,:;]* ")
NAME_END = regex.compile(r"[,.;:!?\n]|$")
HOUSE = regex.compile(f"(?:{HOUSES})(?![\\p{{L}}\\p{{M}}])")
DIGIT, LETTER = re.compile(r"\d"), re.compile("[A-Z]")
NAME_MARK, TERM_MARK, STREET_MARK = 1, 2, 4


def _digits(text: str) -> str:
    return text.translate(TAMIL_DIGITS) if TAMIL_DIGIT.search(text) else text


def as_term(word: str) -> str:
    return word.lower().strip(TERM_EDGE)


def terms_before(text: str, at: int) -> list[str]:
    """The word before a place on its line, and the last two, in lower case without punctuation at their ends."""
    start, words = text.rfind("\n", 0, at) + 1, []
    while at > start and len(words) < 2:
        cut = max(text.rfind(" ", start, at), start - 1)
        if t := as_term(text[cut + 1 : at]):
            words.insert(0, t)
        at = cut
    return [words[-1], " ".join(words)] if len(words) == 2 else words


class Scanner:
    """One automaton for known parts of names, the last words of revealing terms, and street words."""

    def __init__(self, parts: list[str], terms: frozenset[str] = frozenset()) -> None:
        self.parts = frozenset(x.lower() for x in one_form(parts))
        marks: dict[str, int] = {}
        for mark, words in ((NAME_MARK, self.parts), (TERM_MARK, {t.split(" ")[-1].lower() for t in terms}), (STREET_MARK, {x.lower() for x in STREET_WORDS})):
            for w in words:
                marks[w] = marks.get(w, 0) | mark
        self.automaton = ahocorasick.Automaton()
        for w, mark in marks.items():
            self.automaton.add_word(w, (len(w), mark))
        self.automaton.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, marks) of the words of the automaton, wherever they stand."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose small form is longer
            low = "".join(x if len(x.lower()) != 1 else x.lower() for x in text)
        for end, (n, mark) in self.automaton.iter(low):
            yield end + 1 - n, end + 1, mark

    def numbers(self, text: str) -> Iterator[tuple[str, int, int, bool]]:
        """(kind, start, end, sure) of what has the shape of a telephone or identity number."""
        plain = _digits(text)
        for run in NUMBER_RUN.finditer(plain):
            start, end = run.span()
            if not plain[start - 1 : start].isupper() and (end - start < FEWEST_DIGITS or sum(map(str.isdigit, run.group())) < FEWEST_DIGITS):
                continue
            # Two characters more on either side, for what must not stand there.
            start, end = max(0, start - CAPITALS_AROUND - 2), end + 3
            for kind, sure, shape in (("phone", True, PHONE_SURE), ("phone", False, PHONE_LIKE), ("id_number", False, ID_LIKE)):
                for m in shape.finditer(plain, start, end):
                    yield kind, m.start(), m.end(), sure

    def is_name(self, word: str) -> bool:
        return word.lower() in self.parts


def _whole(text: str, start: int, end: int) -> bool:
    """Whether no letter or mark goes on before or after, and the word is no part of a mail address."""
    if start and text[start - 1].isalpha() or end < len(text) and (text[end].isalpha() or unicodedata.category(text[end])[0] == "M"):
        return False
    run = MAIL_RUN.match(text, end)
    if run.end() > end and "@" in run.group() or MAIL_SIGNS.match(text, run.end()):
        return False
    return text.find("@", text.rfind(" ", 0, start) + 1, start) < 0


def _with_initials(text: str, start: int) -> int:
    back = 16
    while m := BEFORE_NAME.search(text, max(0, start - back), start):
        if start - back <= 0 or m.start() - (start - back) > 4:
            return m.start()
        back *= 2  # the initials may go on before
    return start


def _suggested(parts: list[str]):
    """Texts -> kind, form, one, two (the term of one word and of two before it), n."""

    def counts(found: Counter) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(found.values()), pa.int64())], ["kind", "form", "one", "two", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = Finder(parts), Counter()
        for _, texts in pieces(batches):
            for text in one_form(texts):
                for start, _end, kind, form in find.suggestions(text):
                    found[kind, form, *(*terms_before(text, start), "", "")[:2]] += 1
            if len(found) > COUNTED_AT_ONCE:
                yield counts(found)
                found.clear()
        yield counts(found)

    return run


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "kind", "n"])


def _in_bitmap(bitmap: bytes, term: str) -> bool:
    at = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42) & (len(bitmap) * 8 - 1)  # as Spark's xxhash64
    return bitmap[at >> 3] >> (at & 7) & 1 > 0


def _places(bitmap: bytes):
    """Counts all places of the terms of a bitmap, and of words at all under the empty term.

    A term's last word stands before an entity as often as the term, so it is a term itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        known: dict[str, bool] = {}
        n = 0
        for _, texts in pieces(batches):
            for text in one_form(texts):
                for line in text.lower().split("\n"):
                    words = [t for w in line.split(" ") if (t := w.strip(TERM_EDGE))]
                    n += len(words)
                    for k, w in enumerate(words):
                        if (is_term := known.get(w)) is None:
                            is_term = known[w] = _in_bitmap(bitmap, w)
                        if is_term:
                            found[w, ""] += 1
                            if k:
                                two = f"{words[k - 1]} {w}"
                                if (is_term := known.get(two)) is None:
                                    is_term = known[two] = _in_bitmap(bitmap, two)
                                if is_term:
                                    found[two, ""] += 1
                if len(known) > COUNTED_AT_ONCE:
                    known.clear()
                if len(found) > COUNTED_AT_ONCE:
                    yield _counts(found)
                    found.clear()
        found["", ""] = n
        yield _counts(found)

    return run


Term = tuple[str, str, float, float]


def revealing(documents: DataFrame, name_parts: DataFrame) -> tuple[list[Term], list[Term]]:
    """(term, kind, share, bits) beyond the disclosure thresholds, and (form, kind, share, bits) of all forms seen often enough, "*" for all of a kind."""
    texts = present(documents).select("text")
    seen = checkpointed(texts.mapInArrow(_suggested(_names(name_parts)), "kind string, form string, one string, two string, n bigint").groupBy("kind", "form", "one", "two").agg(F.sum("n").alias("n")))
    of_kind = {r.kind: r.n for r in seen.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    terms = seen.select("kind", F.explode(F.array_distinct(F.array("one", "two"))).alias("term"), "n").where("term <> ''")
    terms = checkpointed(terms.groupBy("term", "kind").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN))
    if terms.isEmpty():
        return [], []
    marked = bitmap(terms.select("term").distinct(), F.xxhash64("term"))
    places = checkpointed(texts.mapInArrow(_places(marked), "term string, kind string, n bigint").groupBy("term").agg(F.sum("n").alias("places")))
    words = max(1, places.where("term = ''").agg(F.sum("places").alias("n")).first().n or 0)
    share = F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1), F.coalesce("places", F.lit(0))))
    general = F.create_map(*(F.lit(x) for k, n in of_kind.items() for x in (k, n / words)))[F.col("kind")]
    bits = lambda share, kind: log2(share / (of_kind[kind] / words)) if share > 0 else 0.0
    # The bound on information is a hair lower here, so that its exact value is told by one logarithm, below.
    beyond = terms.join(places, "term", "left").withColumn("share", share).where((F.col("share") >= SHARE) & (F.col("share") >= general * (2**INFORMATION * (1 - 1e-9))))
    out = [(r.term, r.kind, r.share, bits(r.share, r.kind)) for r in beyond.orderBy(F.desc("n"), "term", "kind").collect()]
    out = [x for x in out if x[3] >= INFORMATION]
    told = documents.sparkSession.createDataFrame([x[:2] for x in out], "term string, kind string")
    one, two = (told.select("kind", F.col("term").alias(c), F.lit(True).alias(f"by_{c}")) for c in ("one", "two"))
    after = seen.join(one, ["kind", "one"], "left").join(two, ["kind", "two"], "left").withColumn("after", F.when(F.coalesce("by_one", "by_two", F.lit(False)), F.col("n")).otherwise(0))
    forms = after.select("kind", F.explode(F.array("form", F.lit("*"))).alias("form"), "n", "after").groupBy("kind", "form").agg(F.sum("n").alias("n"), F.sum("after").alias("after")).where(F.col("n") >= SEEN)
    return out, [(r.form, r.kind, r.after / r.n, bits(r.after / r.n, r.kind)) for r in forms.orderBy("kind", "form").collect()]


def revealing_terms(documents: DataFrame, name_parts: DataFrame) -> list[Term]:
    """(term, kind, share, bits) beyond the disclosure thresholds, from the co-occurrence in the whole corpus."""
    return revealing(documents, name_parts)[0]


def _names(name_parts: DataFrame) -> list[str]:
    rows = name_parts.where("length(name_part) > 1").select("name_part").distinct().limit(NAME_PARTS_AT_MOST + 1).collect()
    if len(rows) > NAME_PARTS_AT_MOST:
        raise ValueError(f"more than {NAME_PARTS_AT_MOST} name parts")
    return [r[0] for r in rows]


class Finder:
    """Finds the details of a text in the one form."""

    def __init__(self, parts: list[str], terms: list[Term] = (), forms: list[Term] = (), common: frozenset[str] = frozenset()) -> None:
        self.common = common
        self.terms = {k: frozenset(t for t, kind, *_ in terms if kind == k) for k in KINDS}
        self.forms = {(kind, form): share >= SHARE and bits >= INFORMATION for form, kind, share, bits in forms}
        self.scan = Scanner(parts, self.terms["person"])

    def revealed(self, kind: str, text: str, at: int) -> bool:
        return any(t in self.terms[kind] for t in terms_before(text, at))

    def tells(self, kind: str, form: str) -> bool:
        """Whether a form reveals a kind."""
        return self.forms[kind, form] if (kind, form) in self.forms else self.forms.get((kind, "*"), False)

    def _person(self, text: str, start: int) -> tuple[int, int] | None:
        """The name that starts here, with initials and a second part."""
        m = NAME.match(text, start)
        if not m:
            return None
        end = m.end()
        if end < len(text) and text[end] == " " and (second := NAME.match(text, end + 1)):
            word = second[1]
            if self.scan.is_name(word) or word.isascii() or NAME_END.match(text, second.end(1)) and word not in self.common:
                end = second.end()
        return _with_initials(text, start), end

    def suggestions(self, text: str, after: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, kind, form) of what may be a detail, in no order. after: gets the names in no list after terms that reveal persons."""
        upto = 0
        for start, end, mark in self.scan.hits(text):
            if mark & NAME_MARK and _whole(text, start, end) and (span := self._person(text, start)):
                yield *span, "person", text[start:end].lower()
            if mark & STREET_MARK and start >= upto:  # each line once
                line, upto = text.rfind("\n", 0, start) + 1, text.find("\n", end)
                upto = upto if upto >= 0 else len(text)
                plain = _digits(text[line:upto])
                for m in ADDRESS.finditer(plain):
                    rest = ADDRESS_REST.match(plain, m.end())
                    yield line + m.start(), line + (rest.end() if rest else m.end()), "address", "house" if HOUSE.match(m.group()) else "number"
            if after is not None and mark & TERM_MARK and (gap := AFTER_TERM.match(text, end)):
                at = gap.end()
                initials = NAME_INITIALS.match(text, at)
                at = initials.end() if initials else at
                m = NAME.match(text, at)
                if m and m[1].lower() not in self.common and self.revealed("person", text, initials.start() if initials else at) and (span := self._person(text, at)):
                    after.append((*span, "person"))
        yield from self._others(text)

    def _others(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        if "@" in text or AT_SIGN.search(text) or " dot " in text or " DOT " in text:
            for m in EMAIL.finditer(text):
                yield *m.span(), "email", "@" if "@" in m.group() else "at"
        for kind, start, end, coded in self.scan.numbers(text):
            yield start, end, kind, "coded" if coded else LETTER.sub("A", DIGIT.sub("9", _digits(text[start:end])))

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the details, apart from each other and in order."""
        out: list[tuple[int, int, str]] = []
        suggested = list(self.suggestions(text, out))
        out += [(a, b, kind) for a, b, kind, form in suggested if self.tells(kind, form) or self.revealed(kind, text, a)]
        out.sort(key=lambda x: (x[0], -x[1]))
        kept: list[tuple[int, int, str]] = []
        for x in out:
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        return kept


def replaced(text: str, details: list[tuple[int, int, str]]) -> str:
    out, upto = [], 0
    for start, end, kind in details:
        out += text[upto:start], f"[{kind.upper()}]"
        upto = end
    return "".join((*out, text[upto:]))


def _sanitised(names: list[str], terms: list[Term], forms: list[Term], common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(names, terms, forms, common)
        detail = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())]))
        for part, texts in pieces(batches):
            unified = one_form(texts)
            details = [find(x) for x in unified]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(replaced, unified, details), pa.string()), pa.array([[{"start": a, "length": b - a, "kind": k} for a, b, k in x] for x in details], detail)],
                ["doc_id", "text", "details"],
            )

    return run


def _kinds(names: list[str], terms: list[Term], forms: list[Term], common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(names, terms, forms, common)
        for part, texts in pieces(batches):
            rows = [(d, k) for d, x in zip(part.column(0).to_pylist(), one_form(texts), strict=True) for k in {k for *_, k in find(x)}]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())], ["doc_id", "kind"])

    return run


def _prepared(documents: DataFrame, name_parts: DataFrame, common_words: DataFrame) -> tuple:
    from .quality import common_set

    return _names(name_parts), *revealing(documents, name_parts), common_set(common_words)


def sanitised(documents: DataFrame, name_parts: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, text with placeholders such as [PHONE], details (start and length in characters of the one form, kind).

    Null and empty texts give no row; repeated rows give repeated rows. Of details that overlap the one that
    starts first is taken, the longer one among equals.
    """
    return present(documents).mapInArrow(_sanitised(*_prepared(documents, name_parts, common_words)), "doc_id bigint, text string, details array<struct<start: int, length: int, kind: string>>")


def personal_details(documents: DataFrame, name_parts: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, kind: the kinds of personal detail of each document, each once."""
    return present(documents).mapInArrow(_kinds(*_prepared(documents, name_parts, common_words)), "doc_id bigint, kind string").distinct()
