import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sorkuvai.functions import aksharas, morphemes, predicates, pretokens, text
from sorkuvai.functions.profiles import TELUGU

LINES = [
    ("தமிழ் ஒரு அழகான மொழி", None), ("This is a fully English sentence", "no_tamil"), ("தமிழ் and English mixed text here now yes", "low_tamil"),
    ("இன்றைய செய்திகளில் AI பற்றி பேசுவோம்", None), ("hi", "too_short"), (None, None), ("", "too_short"),
    ("நம் நாட்டின் வரலாறு மிகவும் பழமையானது " * 20 + "one two three four five, ", "consecutive_english"), ("அ" * 50_001, "too_long"),
]


def apply(spark, f, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_line_reasons(spark):
    assert apply(spark, predicates.line_reason, *(x for x, _ in LINES)) == [None if x is None else r for x, r in LINES]
    assert apply(spark, predicates.is_quality_line, None, LINES[0][0]) == [False, True]


@pytest.mark.parametrize(
    ("f", "raw", "out"),
    [
        (text.normalize_basic, "\t\tஅ\r\n\n\n\nஆ   இ\x00", "அ \n\nஆ   இ"),
        (text.normalize_basic, "கொ", "கொ"), (text.normalize_basic, None, None), (text.normalize_basic, "", ""),
        (text.fix_joiners, "க‍ம‍ல 👨‍👩", "கம‍ல 👨‍👩"), (text.fix_sequences, "க்்் காி", "க் கி"),
        (text.normalize_deep, "தமிழ்AI2024 http://x.y/z a@b.cd!!!!!!", "தமிழ் AI 2024 "[:-1]), (text.normalize_corpus, "aaaaaaaaaaaa ????  ​x", "aaa ??? x"),
        (text.isolate_scripts, "தமிழ்AI2024அ x", "தமிழ் AI 2024 அ x"), (text.squeeze_repeats, "!!!!! aaaaaaaaaa bbb", "!!! aaa bbb"),
        (lambda c: text.numerals(c, "arabic"), "௧௨ 3", "12 3"), (lambda c: text.numerals(c, "tamil"), "12", "௧௨"),
        (text.wiki_plain, "{{a|{{b}}}}[[File:x.png|thumb|[[y]] z]]'''[[c|d]]''' [[e]] [http://u v]<ref>r</ref>\n* f", "d e v\nf"),
        (text.wiki_tidy, "[[Category:x]]== h ==\n{|t|}k", "h \nk"), (text.wiki_inline, "{{x}}[[a|b]] [[c]] ''d''\n== e ==\nf", "b c d\ne\nf"),
        (text.without_templates, "a{{b{{c{{d{{e{{f{{g{{h}}}}}}}}}}}}}}i {{j", "ai {{j"), (text.without_templates, "{{a {{b}} c", "{{a  c"), (text.without_media, "[[File:x|[[a|[[b]] c]] d]]e [[f]]", "e [[f]]"), (text.nfc, "e\u0301 கொ a\u0323\u0302 Å 각", "é கொ ậ Å 각"), (text.wiki_flat, "[[பகுப்பு:x]][[a|b]]", "b"),
        (text.html_text, "<html><script>x()</script><nav>n</nav><p>அ &amp; ஆ</p><!-- c --><p>Project Madurai</p></html>", "அ & ஆ"),
        (text.clean_piece, "▁Ġஅ", "அ"),
    ],
)
def test_text(spark, f, raw, out):
    assert apply(spark, f, raw) == [out]


def test_article(spark):
    body = "தமிழ் " * 40
    for page in (f"<article>{body}</article><p>no</p>", f'<div class="main-content x">{body}</div>', f"<main>{body}</main>"):
        assert apply(spark, text.html_article, f"<html><form>f</form>{page}</html>") == [body.strip()]
    assert apply(spark, text.html_article, "<p>short</p>", None) == [None, None]
    assert apply(spark, text.links, '<a href="/a">x</a><a href="/b"><a href="/a">') == [["/a", "/b"]]


def test_trimming_and_counting_are_those_of_regular_expressions(spark):
    from sorkuvai.functions.profiles import LATIN, TAMIL, WS

    x = F.concat(F.col("c"), F.lit("a"), "c", F.lit(" b"), "c", "c")
    rows = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    same = [
        (text.ustrip(x), F.regexp_replace(x, rf"^[{WS}]+|[{WS}]+\z", "")), (predicates.words(x), F.regexp_count(x, F.lit(f"[^{WS}]+"))),
        *((text.count(x, y), F.regexp_count(x, F.lit(f"[{y}]"))) for y in (TAMIL.letters, LATIN, r"\p{L}", *predicates.CHARACTER_KINDS.values())),
    ]
    assert rows.select(F.count_distinct("c"), *(F.count_if(~a.eqNullSafe(b)) for a, b in same)).first() == (0x30000 - 1 - 2048, *[0] * len(same))
    assert apply(spark, predicates.words, "", " ", "a", " a  b\n", None) == [0, 0, 1, 2, None]


def test_composition_is_that_of_unicode(spark):
    values = ["".join(random.Random(k).choices("aéௌெொகड़्0é", k=20)) for k in range(50)]
    assert apply(spark, text.nfc, *values, None) == [*(unicodedata.normalize("NFC", x) for x in values), None]


def test_clean_and_filter(spark):
    good = "தமிழ் ஒரு அழகான மொழி ஆகும்"
    assert apply(spark, predicates.clean_and_filter, f"\n{good}\nbad\n\n \n{good}\n\n", None) == [f"{good}\n\n{good}", None]


def test_document_reasons(spark):
    tamil = "தமிழ் ஒரு அழகான மொழி ஆகும்"
    assert apply(spark, predicates.document_reason, tamil, "x", tamil + " and some more english words", "1234567890 1234567890") == [None, "too_short", "english", "tamil"]
    assert apply(spark, lambda c: predicates.is_language(c, TELUGU), "తెలుగు", tamil) == [True, False]


@pytest.mark.parametrize(("word", "units"), [("தமிழ்", "த மி ழ்"), ("அம்மா", "அ ம்மா"), ("ஸ்ரீ", "ஸ்ரீ"), ("க்ஷ", "க்ஷ"), ("ா1", "ா 1"), ("a ௧", "a |  |௧")])
def test_aksharas(spark, word, units):
    units = units.split("|") if "|" in units else units.split()
    assert apply(spark, aksharas.aksharas, word) == [[u.strip() or " " for u in units]]


def test_akshara_kinds_and_parts(spark):
    assert apply(spark, aksharas.kind, *"அ ஃ ௧ ௰ க்ஷ க் கி a . ா".split(), " ") == ["vowel", "aytham", "digit", "symbol", "conjunct", "consonant_pulli", "consonant_vowel", "latin", "punctuation", "other", "space"]
    assert [tuple(r) for r in apply(spark, aksharas.parts, "கி", "க்", "அ")] == [("க", "ி", False), ("க", None, True), (None, None, False)]


def test_morphemes_join_to_the_word(spark):
    words = ["வீடுகளிலிருந்து", "படிக்கிறான்", "போகவேண்டியிருந்தது", "கள்", "", None, "abc", "முடியவில்லை", "செய்யப்படுகிறது"]
    rows = morphemes.segmented(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert all("".join(r.morphemes) == (r.word or "") for r in rows)
    cut = {r.word: r.morphemes for r in rows}
    assert cut["வீடுகளிலிருந்து"] == ["வீடுக", "ளிலிருந்து"] and cut["கள்"] == ["கள்"] and cut[None] == []


def test_segmented_texts(spark):
    rows = morphemes.segmented_texts(spark.createDataFrame([(1, "சொல்லவில்லை a சொல்லவில்லை")], "doc_id bigint, text string")).collect()
    assert rows[0].text == "சொல்ல @@ வில்லை a சொல்ல @@ வில்லை"


def test_pretokens_cover_the_text(spark):
    value = "It's தமிழ்AI 2024, ok!  \n"
    assert "".join(apply(spark, pretokens.pretokens, value)[0]) == value
    assert apply(spark, pretokens.pretokens, value)[0][:4] == ["It", "'s", " ", "தமிழ்"]
    assert "".join(apply(spark, pretokens.script_pieces, value)[0]) == value
    assert apply(spark, pretokens.at_marker, "a @@ b") == [["a", " @@ ", "b"]] and apply(spark, lambda c: pretokens.at_marker(c, "@@", False), "a@@b") == [["a", "b"]]
    assert apply(spark, pretokens.marked_script_pieces, "a@@b1") == [["a", "@@", "b", "1"]]
