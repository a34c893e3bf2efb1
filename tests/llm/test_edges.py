"""Every operator takes nulls, empty and very long texts, repeated rows, empty tables and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from sorkuvai.llm import language, leak, mixing, near, overlap, packing, personal, quality, tokens, unify

TAMIL = "பல ஆண்டுகளாக மக்கள் இந்த ஊரில் புதிய பாலத்தை கட்ட முயன்றனர். "
ENGLISH = "The old potter carried the second lamp near the canal before the rains. "
DOCS = "doc_id bigint, text string, lang string, source string, split string, key string, hash string, n int, a int, b int, side int, term string, kind string, size int, sign int, shard int, tokens bigint, pieces string"
REST = ("k", "h", 1, 2, 3, 4, "t", "p", 5, 6, 7, None, "x")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, "ta", "s", "train"), (2, "", None, None, None), (3, TAMIL * 4, "ta", "s", "train"), (4, TAMIL * 4, "TA ", None, " TEST"),
        (5, ENGLISH * 5, None, "s", "validation"), (6, " ".join(f"சொல்{k} word{k}" for k in range(20_000)), "ta", "t", "train"), (7, "  \n\t ", "ta", "t", "train"), (8, "x", "en", "t", "test"), (None, TAMIL, "ta", "t", "train"),
    ]
    rows += [rows[2], rows[2]]
    return spark.createDataFrame([(*r, *REST) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rest(spark):
    return {
        "items": spark.createDataFrame([(1, "q", "test", ENGLISH * 2), (2, "q", "test", None), (None, "q", "test", ENGLISH), (3, "q", "test", "too few words")], "item_id bigint, suite string, split string, text string"),
        "samples": spark.createDataFrame([(1, "ta", TAMIL), (2, "en", ENGLISH), (3, None, "x"), (4, "fr", None)], "sample_id bigint, lang string, text string"),
        "codes": spark.createDataFrame([("ta", "ta"), ("en", "en"), (None, "fr"), ("x", None)], "label string, lang string"),
        "common": spark.createDataFrame([("ta", 1, "இந்த"), ("en", 1, "the"), (None, None, None)], "lang string, word_no int, word string"),
        "names": spark.createDataFrame([(1, "Madinaran", "Latn"), (2, None, None), (3, "", "Latn")], "name_id int, name_part string, script string"),
        "vocab": spark.createDataFrame([(0, "t", False), (1, "h", False), (2, "▁", False), (3, "th", None), (4, None, False), (5, "<x>", True)], "token_id int, token string, is_special boolean"),
        "merges": spark.createDataFrame([(0, "t", "h"), (1, "▁", "th"), (None, None, "x")], "merge_rank int, left_piece string, right_piece string"),
        "specs": spark.createDataFrame([(1, "a", 8), (2, "b", None), (3, "c", 0), (None, "d", 5)], "spec_id int, spec_name string, capacity int"),
        "configs": spark.createDataFrame([("s", 1.0, 2), ("t", 3.0, 1), ("none", 1.0, 2), ("u", None, None), ("v", 1.0, None)], "config_key string, target_gb double, max_repeats int"),
        "lines": spark.createDataFrame(
            [(k % 40, "d" if k % 3 else None, [" S ", "t", None, "v"][k % 4], k % 7, "line" * (k % 5), None if k % 6 else "bad", k) for k in range(80)] + [(None, "d", "s", 1, "x", None, 1), (900, "d", "s", None, None, None, None)],
            "line_id bigint, domain string, source string, doc_id bigint, line string, reject_reason string, merged_at int",
        ),
    }


OPERATORS = {
    "mixed": lambda d, r: mixing.mixed(r["lines"], r["configs"]), "mix_report": lambda d, r: mixing.mix_report(r["lines"], r["configs"]), "short": lambda d, r: mixing.short_sources(r["lines"], r["configs"]),
    "near": lambda d, r: near.near_duplicates(d), "classes": lambda d, r: near.near_classes(d),
    "cube": lambda d, r: tokens.token_cube(d, r["lines"], r["codes"], r["vocab"], r["merges"]),
    "languages": lambda d, r: language.document_languages(d, r["samples"], r["common"]), "labels": lambda d, r: language.wrong_labels(d, r["samples"], r["codes"], r["common"]),
    "quality": lambda d, r: quality.text_statistics(d, r["common"]), "reasons": lambda d, r: quality.reasons_by_source(d, r["common"]),
    "across": lambda d, r: overlap.across_splits(d), "counts": lambda d, r: overlap.overlap_counts(d), "overlaps": lambda d, r: overlap.overlap_report(d),
    "unify": lambda d, r: unify.unify_documents(d), "changed": lambda d, r: unify.changed_documents(d),
    "packing": lambda d, r: packing.packing_report(d, r["specs"]), "public": lambda d, r: packing.public_sizes(d),
    "leaks": lambda d, r: leak.leaks(d, r["items"]), "leaked": lambda d, r: leak.leaked_items(d, r["items"]), "near_leaks": lambda d, r: leak.near_leaks(d, r["items"]),
    "updated_cube": lambda d, r: tokens.token_cube_in_steps(d, d.where("doc_id < 5"), r["lines"], r["codes"], r["vocab"], r["merges"]), "invariants": lambda d, r: packing.packing_invariants(d, r["specs"]),
    "personal": lambda d, r: personal.personal_details(d, r["names"], r["common"]), "sanitised": lambda d, r: personal.sanitised(d, r["names"], r["common"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, docs, rest):
    rows = OPERATORS[name](docs, rest).collect()
    if name not in ("mixed", "mix_report", "short", "packing", "invariants", "labels", "reasons", "changed", "personal"):
        assert rows
    assert not any(getattr(r, "doc_id", 0) in (1, 2) for r in rows)  # no text, no row


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(name, docs, rest):
    lines = {**rest, "lines": rest["lines"].limit(0)}
    rows = OPERATORS[name](docs.limit(0), lines).collect()
    assert name in ("mix_report", "leaked") or not rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_side_tables(name, docs, rest):
    OPERATORS[name](docs, {k: v.limit(0) for k, v in rest.items()}).collect()


def test_copies_and_ties(docs, rest):
    assert {(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(docs).collect()} == {(3, 4)}
    assert {(r.doc_id_a, r.doc_id_b) for r in overlap.across_splits(docs).collect()} == {(3, 4)}
    assert {r.doc_id: r.class_id for r in near.near_classes(docs.where("doc_id is not null")).collect()} == {3: 3, 4: 3, 5: 5, 6: 6, 8: 8}


def test_leaks_hold_eight_words(docs, rest):
    assert {(r.doc_id, r.item_id) for r in leak.leaks(docs, rest["items"]).collect()} == {(5, 1)}


def test_counts_of_splits(docs):
    rows = overlap.overlap_counts(docs).collect()
    assert [(r.split, r.source, r.train_source, r.records, r.train_records) for r in rows] == [("test", None, "s", 1, 1)]
    report = {(r.split, r.source): (r.documents, r.overlapping) for r in overlap.overlap_report(docs).collect()}
    assert report[("test", None)] == (1, 1) and report[("validation", "s")] == (1, 0)


def test_sizes_of_extra_columns(docs):
    assert {f.name for f in unify.unify_documents(docs.withColumn("changed", F.lit(1))).schema} == {"doc_id", "text", "changed"}
