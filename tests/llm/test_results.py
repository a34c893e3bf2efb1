"""Operators against brute force, exact round trips and held-out rows, on small tables."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sorkuvai.llm import batches, language, leak, mixing, near, overlap, packing, personal, quality, tokens, unify
from sorkuvai.operators.bpe import Bpe, decode

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# --- one form ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("a​b", "ab"), ("ｆｕｌｌ１", "full1"), ("été", "été"), ("கொ", "கொ"), ("ப௧ுதி", "பகுதி"), ("௧௯௪௭", "௧௯௪௭"), ("௧௯௪௭ல்", "௧௯௪௭ல்"),
        ("thе", "the"), ("Привет", "Привет"), ("👨‍👩‍👧 ❤️", "👨‍👩‍👧 ❤️"), ("ﬁn", "fin"),
        ("a b　c\td\ne", "a b c\td\ne"), ("കന്‍", "കൻ"), ("ದೋ", "ದೋ"), ("a\r\nb\rc", "a\nb\nc"), ("", ""),
    ],
)
def test_one_form(text, form):
    assert unify.one_form([text]) == [form]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=40))
def test_one_form_is_stable(text):
    once = unify.one_form([text])
    assert unify.one_form(once) == once


def test_mapping_has_no_conflict_and_composes():
    t = unify.transducer()
    assert all(not any(x in t.mapping for x in v) for v in t.mapping.values())
    assert all(unicodedata.normalize("NFC", v) == v for v in t.mapping.values())


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("a\U000e0041\U000e0062b", "ab"), ("葛\U000e0100城", "葛城"), ("a\U0001d173b", "ab"), ("\U0002f800\U0002fa1d", "丽𪘀"), ("\U0001ee00\U0001ee01", "اب"), ("\U0001fbf0\U0001fbf9", "09"),
        ("pαsswοrd pοrtαl gιft pαρer", "password portal gift paper"), ("the α and γ of γH2AX", "the α and γ of γH2AX"), ("και αρι", "και αρι"), ("\U00011099\U000110ba", "\U0001109a"),
        ("\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f!", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f!"), ("\U000110bd", "\U000110bd"),
    ],
)
def test_one_form_beyond_the_first_plane(text, form):
    assert unify.one_form([text]) == [form] and unify.one_form([form]) == [form]


def test_garbled_text_stays():
    text = "Ã\u0083Â¤Ã\u0083Â¶ ÚxÕÞwÞ~ ÚxÖ~Õ{Û ÛzÙzÜÕ"
    assert unify.one_form([text]) == [text]


# --- near duplicates --------------------------------------------------------------------------------------


def edited(text, draw, n):
    words = text.split()
    for _ in range(n):
        k = draw.randrange(len(words))
        words[k : k + 1] = draw.choice([[], [words[k], "சேர்ந்த"], ["மாறிய"]])
    return " ".join(words)


def made_documents(seed=3):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("கஙசடதநபமயரலவழளறன", k=draw.randrange(3, 9))) for _ in range(700)]
    out = []
    for base in range(60):
        text = " ".join(draw.choices(vocabulary, k=draw.choice([15, 60, 200, 700])))
        out += [text, *(edited(text, draw, draw.choice([0, 1, 2, 8])) for _ in range(base % 4))]
    return list(enumerate(out))


def brute_pairs(rows, least=near.SIMILARITY):
    sets = [(i, {f[k : k + 5] for k in range(max(1, len(f) - 4))}) for i, f in zip((i for i, _ in rows), near.fold([x for _, x in rows]), strict=True)]
    return {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if len(a & b) >= least * len(a | b)}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near, "MANY_COPIES", 2)
    rows = made_documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(df).collect()]
    true = brute_pairs(rows)
    assert set(found) == true and len(true) > 60 and len(found) == len(true)


def short_pairs(draw, n, lengths):
    """Texts, each with some that differ in a few characters."""
    out = []
    for _ in range(n):
        x = "".join(draw.choices("abcdefgh ", k=draw.randrange(*lengths)))
        out.append(x)
        for _ in range(3):
            y = list(x)
            for _ in range(draw.choice([0, 1, 1, 2])):
                k = draw.randrange(len(y)) if y else 0
                y[k : k + 1] = draw.choice([[], ["z"], [*y[k : k + 1], "q"]])
            out.append("".join(y))
    return list(enumerate(out))


@pytest.mark.parametrize("lengths", [(1, 8), (5, 41), (60, 300)])
def test_short_texts_lose_no_pair(spark, lengths):
    rows = [r for r in short_pairs(random.Random(11), 120, lengths) if r[1].strip()]
    rows += [(10_000 + k, "-" * (5 + k)) for k in range(3)] + [(20_000 + k, "abc" * (4 + k)) for k in range(3)]
    found = {(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    true = brute_pairs(rows)
    assert found == true and len(true) > 60


def test_long_texts_at_the_threshold(spark):
    """Pairs of sampled texts that are just at 0.8 and beyond."""
    draw, rows = random.Random(4), []
    for k in range(40):
        text = "".join(draw.choices("கஙசடதநபமயரலவழளறன ", k=draw.choice([300, 700, 2600])))
        cut = int(len(text) * 0.805)
        rows += [(2 * k, text), (2 * k + 1, text[:cut] if k % 2 else "".join(c if draw.random() > 0.018 else "x" for c in text))]
    found = {(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == brute_pairs(rows) and len(found) >= 20


def test_near_duplicates_of_the_tables(spark):
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) > 0").collect()]
    assert {(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(docs).collect()} == brute_pairs(sorted(rows))


def test_lists_in_common_are_at_least_those_asked():
    power = np.arange(0, near.SAMPLED_FROM)
    for down, largest in ((0, 2 ** (power + 1) - 1), (1, np.floor(2.5 * 2.0**power).astype(int))):
        assert (near.least_shared(largest, near.groups_in_class(power), power, down) >= near.SPARE).all()
    assert near.LEAST_RUNS[near.LISTS] >= near.HITS


def test_overlaps_cross_the_splits(spark):
    rows = [(i, x, ("train", "Validation ", "test", None)[i % 4]) for i, x in made_documents(5)]
    df = spark.createDataFrame([(i, x, s, None) for i, x, s in rows], "doc_id bigint, text string, split string, source string")
    side = {i: {"train": 0, "validation": 1, "test": 1}.get((s or "").strip().lower()) for i, _, s in rows}
    want = {(a, b) for a, b in brute_pairs([(i, x) for i, x, _ in rows]) if {side[a], side[b]} == {0, 1}}
    assert {(r.doc_id_a, r.doc_id_b) for r in overlap.across_splits(df).collect()} == want and want


# --- leaks ------------------------------------------------------------------------------------------------


def test_leaks(spark):
    docs, items = table(spark, "documents"), table(spark, "eval_items")
    windows = {}
    item_rows = items.collect()
    for r, words in zip(item_rows, leak.words_of([r.text for r in item_rows]), strict=True):
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), set()).add(r.item_id)
    doc_rows = docs.where("length(text) > 0").collect()
    true = {(r.doc_id, i) for r, words in zip(doc_rows, leak.words_of([r.text for r in doc_rows]), strict=True) for k in range(len(words) - 7) for i in windows.get(tuple(words[k : k + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in leak.leaks(docs, items).collect()} == true


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leak, "ITEMS_AT_ONCE", 1)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "x " + text), (2, text.replace(" ", ", ").upper())], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text), (8, text + " eleven")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leak.leaks(docs, items).collect()} == {(1, 7), (2, 7), (1, 8), (2, 8)}


@pytest.mark.parametrize("whole", [False, True])
def test_blocks_find_all_fingerprints_in_the_radius(whole):
    draw = random.Random(1)
    items = leak.Items([(k, " ".join(f"w{draw.randrange(50)}" for _ in range(30))) for k in range(40)], whole)
    for index in items.index.values():
        probes = np.array([int(p) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(12))) for p in index.prints], np.uint64)
        left, right = index.near(probes)
        want = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= index.radius}
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_word_fingerprints_are_majorities():
    h = leak.Words()([f"w{k}" for k in range(300)])
    for n, prints in leak.word_fingerprints(h, (8, 24)).items():
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        want = [np.packbits(bits[k : k + n].sum(0) > n // 2).view(np.uint64)[0] for k in range(len(h) - n + 1)]
        assert prints.tolist() == [int(x) for x in want]


def test_items_with_a_changed_word_are_found(spark):
    """Recall on planted items of which one word is changed."""
    draw = random.Random(2)
    items = [r for r in table(spark, "eval_items").collect() if len(leak.words_of([r.text])[0]) >= 16]
    hosts = [r.text for r in table(spark, "documents").where("length(text) between 200 and 3000").collect()]
    docs = []
    for k, r in enumerate(items):
        words = r.text.split()
        words[draw.randrange(len(words))] = "changedword"
        docs.append((k, hosts[k % len(hosts)] + "\n" + " ".join(words) + "\n" + hosts[(k + 7) % len(hosts)]))
    found = {(r.doc_id, r.item_id) for r in leak.near_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id bigint, text string")).collect()}
    hit = sum((k, r.item_id) in found for k, r in enumerate(items))
    assert hit >= 0.9 * len(items)


# --- tokens and packing -----------------------------------------------------------------------------------


def test_counts_agree_with_a_plain_encoder(spark):
    vocab = [r.token for r in table(spark, "vocab").collect()]
    merges = [(r.left_piece, r.right_piece) for r in table(spark, "merges").orderBy("merge_rank").collect()]
    bpe = Bpe([v for v in vocab if not v.startswith("<|")], merges)
    for r in table(spark, "documents").where("length(text) > 0").limit(20).collect():
        n = 0
        for word in r.text.split():
            parts = list("▁" + word)
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == a and parts[k + 1] == b:
                        parts[k : k + 2] = [a + b]
                    k += 1
            n += sum(1 if p in bpe.vocab else len(p.encode()) for p in parts)
        assert bpe.count(r.text) == n == len(bpe.encode(r.text))
        assert decode(bpe.encode(r.text)) == " ".join(r.text.split())


def test_cube_by_deltas(spark, monkeypatch):
    t = {n: table(spark, n) for n in ("documents", "merge_gold", "lang_codes", "vocab", "merges")}
    earlier = t["documents"].where("fetched_at < timestamp '2024-06-01 00:00:00'").union(t["documents"].where("doc_id < 10").selectExpr("doc_id + 100000", "concat(text, ' x')", *t["documents"].columns[2:]))
    rest = [t[n] for n in ("merge_gold", "lang_codes", "vocab", "merges")]
    columns = ["source", "lang", "domain", "documents", "tokens"]
    full = tokens.token_cube(t["documents"], *rest).select(*columns).collect()
    assert sorted(map(tuple, tokens.token_cube_in_steps(t["documents"], earlier, *rest).select(*columns).collect())) == sorted(map(tuple, full)) and full


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_packing_keeps_the_capacity(sizes):
    sizes = np.array(sizes, np.int64)
    blocks = packing.pack(sizes, 64)
    if len(sizes):
        assert np.bincount(blocks, sizes).max() <= 64
        assert len(np.unique(blocks)) <= 2 * -(-sizes.sum() // 64)


def test_packing_covers_every_token(spark):
    sizes = {k: (k * 37) % 5000 for k in range(500)}
    specs = spark.createDataFrame([(1, "a", 512), (2, "b", 1024)], "spec_id int, spec_name string, capacity int")
    rows = packing.packed(spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint"), specs).collect()
    for spec, capacity in ((1, 512), (2, 1024)):
        mine = [r for r in rows if r.spec_id == spec]
        got, full = Counter(), Counter()
        for r in mine:
            got[r.doc_id] += r.tokens
            full[r.shard, r.block] += r.tokens
            assert sizes[r.doc_id] > capacity or r.tokens == sizes[r.doc_id]
        assert got == {k: v for k, v in sizes.items() if v} and max(full.values()) <= capacity
        assert sum(full.values()) > 0.9 * capacity * len(full)


def test_sizes_are_those_of_whole_texts(spark):
    import sentencepiece

    docs = table(spark, "documents")
    model = sentencepiece.SentencePieceProcessor(model_file=packing.TOKENIZER)
    want = {r.doc_id: len(model.encode(r.text)) for r in docs.where("length(text) > 0").collect()}
    assert {r.doc_id: r.tokens for r in packing.public_sizes(docs).collect()} == want


# --- mixing -----------------------------------------------------------------------------------------------


def test_mix_keeps_its_expectation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_LINES", 7)
    lines, configs = table(spark, "merge_gold"), table(spark, "dataset_configs")
    plan = {r.source: r for r in mixing.source_plan(lines, configs).collect()}
    by = {}
    for r in mixing.mixed(lines, configs).collect():
        by.setdefault(r.source, []).append(r)
    for source, p in plan.items():
        got = by.get(source, [])
        assert abs(sum(r.copies for r in got) - p.copies * p.lines) < 1
        assert all(abs(r.copies - p.copies) < 1 for r in got)
        assert p.copies < p.__getitem__("copies") + 1e-9 and (not p.short or p.bytes == 0 or p.copies == int(p.copies))
    assert sum(r.reached_share for r in mixing.mix_report(lines, configs).collect()) == pytest.approx(1)


def test_short_sources_by_the_emitted_lines(spark, monkeypatch):
    lines, configs = table(spark, "merge_gold"), table(spark, "dataset_configs")
    plan = {r.config_key: r for r in mixing.source_plan(lines, configs).collect()}
    short = {key for key, p in plan.items() if p.short}
    assert {p.bytes > 0 for p in plan.values() if p.short} == {True, False}
    assert {r.config_key for r in mixing.short_sources(lines, configs).collect()} == short
    whole = mixing.emitted
    monkeypatch.setattr(mixing, "emitted", lambda *a: whole(*a).withColumn("copies", F.col("copies") - 1))
    assert {r.config_key for r in mixing.short_sources(lines, configs).collect()} == {key for key in short if not plan[key].bytes}


def test_short_sources_at_any_offset(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_LINES", 2)
    sizes = {"long": 39, "just": 8, "over": 7, "free": 1, "never": 5, "empty": 0, "less": 4}
    rows = [(100 * k + j, " " + source.upper(), "d", "x" * n, None, 1) for k, (source, n) in enumerate(sizes.items()) for j in range(5)]
    lines = spark.createDataFrame(rows, "line_id bigint, source string, domain string, line string, reject_reason string, merged_at int")
    # 320 bytes in eight equal shares of 40: "just" has 40 bytes, "over" 35
    wants = [("long", 1.0, 1), ("just", 1.0, 1), ("over", 1.0, 1), ("free", 1.0, None), ("never", 1.0, 0), ("empty", 1.0, 3), ("less", 0.0, -1), ("none", 1.0, 2), ("unset", None, 1), ("nothing", 0.0, 1), ("other", 1.0, None)]
    configs = spark.createDataFrame(wants, "config_key string, target_gb double, max_repeats int")
    short = {r.config_key for r in mixing.source_plan(lines, configs).where("short").collect()}
    assert short == {"over", "never", "empty", "less", "none"}
    for seed in range(3):
        assert {r.config_key for r in mixing.short_sources(lines, configs, seed).collect()} == short


def test_copies_beyond_32_bits(spark):
    kept = spark.createDataFrame([(1, "s", "d", 1)], "line_id bigint, source string, domain string, bytes bigint")
    plan = spark.createDataFrame([("s", 3e9, 1)], "source string, copies double, lines bigint")
    assert [r.copies for r in mixing.emitted(kept, plan, 0).collect()] == [3_000_000_000]


# --- languages, quality, personal details -----------------------------------------------------------------


def test_language_of_held_out_samples(spark):
    rows = [(r.lang, r.text) for r in table(spark, "lang_samples").orderBy("sample_id").collect()]
    model = language.Classifier([r for k, r in enumerate(rows) if k % 3])
    held = [r for k, r in enumerate(rows) if not k % 3]
    best, _ = model.decide([language.WORD.findall(x.lower()) for _, x in held])
    right = sum(model.languages[k] == lang for k, (lang, _) in zip(best, held, strict=True))
    assert right >= 0.97 * len(held)


def test_mixed_lines_and_segments(spark):
    model = language.Classifier([(r.lang, r.text) for r in table(spark, "lang_samples").collect()])
    text = "நான் office-ல report பண்ணலாம் இன்னைக்கு meeting\nThe forest guard repaired the narrow kitchen during the festival.\nmakkal puthiya paalaththai katta muyanranar"
    assert [x[2] for x in language.line_languages([text], model)[0][0]] == ["ta", "en", "ta"]
    text = "The forest guard repaired the narrow kitchen during the festival. La maison est près de la rivière et les enfants jouent dans le jardin. The teacher wrote a letter."
    segments = language.segments_of(language.line_languages([text], model)[0][1])
    assert [x["lang"] for x in segments] == ["en", "fr", "en"] and text[segments[1]["start"] :].startswith("La maison") and sum(x["length"] for x in segments) == len(text)


def test_more_classes_than_sixteen():
    rows = [(f"l{k}", " ".join(chr(0x4E00 + 40 * k + j) * 3 + chr(0x4E00 + 40 * k + (j * 7) % 30) for j in range(30))) for k in range(20)]
    model = language.Classifier(rows)
    best, sure = model.decide([language.WORD.findall(x) for _, x in rows])
    assert [model.languages[k] for k in best] == [lang for lang, _ in rows] and (sure > 0.5).all()


def test_codewords_are_far_apart():
    codes = language.code_table(17)
    assert min((a != b).sum() for k, a in enumerate(codes) for b in codes[k + 1 :]) >= 8


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("• one\n• two\n• three\n• four", "gopher bullets"), ("a | b | c\nd | e | f", "own table"), ("12 34 567\n89 1011 12", "own numbers"), ("12 34 567\n89 1011 12", "gopher words without letters"),
        ("The lamp is here.\n" * 6, "gopher duplicate lines"), ("The lamp is here.\n" * 6, "gopher duplicate characters"), ("lamp, roof, tank, boat, song, well, map, fence, loom, road", "own word heap"),
        ("#@!$ %^&* ~~~ ab", "own special characters"), ("# one # two # three", "gopher symbols"), ("\n".join(f"the w{k}..." for k in range(12)), "gopher ellipses"), ("ÂfÎzØ ÎxÓ{ÛzÞ~ gÜxÚzØÕ~ÕwÞ~ ÂßÎ~Î ÂÕ~ÕxÓØ~", "own garbled"),
    ],
)
def test_unnatural(text, reason):
    assert reason in quality.judge(text, frozenset({"the"}))[1]


@pytest.mark.parametrize("text", ["The lamp is old. It stands near the well.\n- one\n- two\nThe rains came after that, and nobody saw the lamp again.", "1. The owner shall repair the roof before the rains.\n2. The owner shall pay for the lamp.", "அந்த ஊரில் ஒரு\nபெரிய மரம் இருந்தது\nஅதன் கீழே"])
def test_natural(text):
    assert quality.judge(text, frozenset({"the"}))[1] == []


ITEMS = "lamp roof tank boat song well map fence loom road wheel pot kite drum shelf rope bell oar net jar".split()
VERSE = "அந்த ஊரில் ஒரு\nபெரிய மரம் இருந்தது\nஅதன் கீழே\nஒரு கிணறு இருந்தது\nஅந்த நீர் இனித்தது"


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("Home\nAbout us\nContact\nLogin", "fineweb lines"), ("Red lamps\nBlue pots\nOld maps\nNew ropes\nBig drums", "fineweb lines"), (" ".join(ITEMS), "gopher stop words, fineweb line ends"), ("\n".join(" ".join(ITEMS[k : k + 5]) for k in (0, 5, 10, 15)), "gopher stop words, fineweb line ends"),
        ("a b c d e f g h i j", "gopher word length"), ("QmFzZTY0IGRhdGEgaGVyZQ aW4gYSBsb25nIGR1bXAgb2Y bm90aGluZyBidXQgbGV0dGVycw dGhhdCBubyBvbmUgY2FuIHJlYWQ b3IgZXZlciB3aWxsIGFnYWlu", "gopher word length"),
    ],
)
def test_unnatural_by_words_and_lines(text, reason):
    assert reason in quality.judge(text, frozenset({"the", "us", "about"}))[1]


@pytest.mark.parametrize("text", [VERSE, "\n".join(["我们昨天去了河边的老磨坊", "那里没有人", "水很清", "我们坐了很久", "天黑才回家"] * 5), "so we went down to the well and the water was cold and she said that it was good and we sat there until the evening came " * 2])
def test_natural_without_line_ends(text):
    assert not quality.BY_WORDS & set(quality.judge(text, frozenset({"the", "and", "we", "it", "to", "அந்த", "ஒரு"}))[1])


def plain_statistics(text, common):
    words, lines = text.split(), [x for x in map(str.strip, text.split("\n")) if x]
    bare, n, seen = [w.lower().strip(quality.STRIP) for w in words], len(words), Counter(lines)
    return {
        "words": n, "mean_word_length": sum(map(len, words)) / n, "words_with_letter": sum(any(c.isalpha() for c in w) for w in words) / n, "common_words": sum(w in common for w in bare if w),
        "ends_in_punctuation": sum(x[-1] in quality.ENDS for x in lines) / len(lines), "duplicate_lines": 1 - len(seen) / len(lines), "duplicate_characters": sum(len(x) * (k - 1) for x, k in seen.items()) / sum(map(len, lines)),
        "short_lines": sum(len(x) < 30 for x in lines) / len(lines), "lines_a_word": len(lines) / n, "distinct_share": len(set(bare)) / n, "comma_share": text.count(",") / n,
        "bullet_lines": sum(x[0] in quality.BULLETS and (len(x) == 1 or x[1].isspace()) for x in lines) / len(lines), "ellipsis_lines": sum(x.endswith(("...", "…")) for x in lines) / len(lines),
    }


def test_statistics_agree_with_plain_ones(spark):
    texts = [r.text for r in table(spark, "documents").where("length(text) > 0").collect()] + ["x", " \n a\n\na ", "...\n…", "•\n- b", "İstanbul ΑΣ, ſ"]
    common = {r.word.lower() for r in table(spark, "common_words").where("word is not null").collect()}
    got = quality.statistics(texts, quality.word_hashes(sorted(common)))
    for k, x in enumerate(texts):
        for name, value in plain_statistics(x, common).items():
            assert got[name][k] == pytest.approx(value), (name, x[:60])


REVEALING = [("phone", "phone", 1.0, 9.0), ("id is", "id_number", 1.0, 9.0), ("ms", "person", 1.0, 9.0), ("திருமதி", "person", 1.0, 9.0)]

FORMS = [(form, kind, 1.0, 9.0) for form, kind in (("@", "email"), ("at", "email"), ("coded", "phone"), ("house", "address"), ("number", "address"), ("*", "person"))] + [("9999999999", "phone", 0.1, 9.0)]


@pytest.mark.parametrize(
    ("text", "out"),
    [
        ("write to a.b+c@host.example today", "write to [EMAIL] today"), ("write to ab [at] host [dot] example now", "write to [EMAIL] now"), ("sold 20 @ 25 rupees, see @page", "sold 20 @ 25 rupees, see @page"),
        ("call +91-55274-34828 now", "call [PHONE] now"), ("Phone: 5031167863.", "Phone: [PHONE]."), ("The count was 5031167863.", "The count was 5031167863."), ("File 049585/844/2018, ISBN 978-0-2480-8266-0", "File 049585/844/2018, ISBN 978-0-2480-8266-0"),
        ("Her voter ID is VCY0419961", "Her voter ID is [ID_NUMBER]"), ("at Door No: 155, Casbay Lane, Bamis 671024 please", "at [ADDRESS] please"), ("பொருளை கதவு எண் 40/5, வரகந்தோப்பு தெரு, சாமைவாடி - 619455 க்கு", "பொருளை [ADDRESS] க்கு"),
        ("Ms. K. Unknownname spoke. Madinaran came.", "Ms. [PERSON] spoke. [PERSON] came."), ("திருமதி ப. கயல்நலாழி நன்றி கூறினார்", "திருமதி [PERSON] நன்றி கூறினார்"), ("கைபேசி +91 ௫௧௧௭௭ ௯௧௧௩௬", "கைபேசி [PHONE]"),
        ("call +91 123 456 789, (044) 234 567 or +91 (552) 748-282 now", "call [PHONE], [PHONE] or [PHONE] now"), ("9-12, 1990-2018 and 12.05.2019 of 3 455 200", "9-12, 1990-2018 and 12.05.2019 of 3 455 200"),
        ("near Door No: 155, " + "Kamarajarnagarvilvanathanpuram" * 4 + " Street, Bamis 671024", "near [ADDRESS]"), ("by " + "K. R. " * 12 + "Madinaran.", "by [PERSON]."),
    ],
)
def test_personal_details(text, out):
    find = personal.Finder(["Madinaran"], REVEALING, FORMS)
    assert personal.replaced(text, find(text)) == out


def test_terms_that_reveal_are_learned(spark):
    rows = [(k, f"Call me on 50{k:08d} after six. The sum was {k}. Signed by Ms. {'Madinaran' if k % 2 else 'Otherwise'} there.") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = spark.createDataFrame([("Madinaran",)], "name_part string")
    terms = {(t, k) for t, k, *_ in personal.revealing_terms(docs, names)}
    assert {("me on", "phone"), ("ms", "person")} <= terms and not any(t == "was" for t, _ in terms)
    common = spark.createDataFrame([("the",)], "word string")
    assert {r.kind for r in personal.personal_details(docs, names, common).where("doc_id = 2").collect()} == {"phone", "person"}


def test_forms_that_reveal_are_learned(spark):
    """A layout that stands after revealing terms counts without them too; one that stands anywhere doesn't."""
    rows = [(k, f"Call me on 50{k:08d} after six. Order 1234567{k:05d} came, then 1234{k:04d}9876 went and {k} stayed. The mail to me is x{k}@host.example now.") for k in range(40)]
    rows += [(100, "It was 5031167863."), (101, "It was 123456700001."), (102, "Then y@host.example said so.")]
    docs, names, common = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("Madinaran",)], "name_part string"), spark.createDataFrame([("the",)], "word string")
    forms = {(f, k): share for f, k, share, _ in personal.revealing(docs, names)[1]}
    assert forms["9999999999", "phone"] > 0.9 and forms["@", "email"] > 0.9
    assert {(r.doc_id, r.kind) for r in personal.personal_details(docs, names, common).where("doc_id >= 100").collect()} >= {(100, "phone"), (102, "email")}


def plain_revealing_terms(texts, names):
    find, before, places, words = personal.Finder(names), Counter(), Counter(), 0
    for text in unify.one_form(texts):
        at = [(kind, start) for start, _, kind, _ in find.suggestions(text)]
        before.update((t, kind) for kind, start in at for t in ["", *personal.terms_before(text, start)])
        for line in text.lower().split("\n"):
            line = [t for w in line.split(" ") if (t := w.strip(personal.TERM_EDGE))]
            words += len(line)
            places.update(line)
            places.update(map(" ".join, zip(line, line[1:])))
    out = {}
    for (t, kind), n in before.items():
        if t and n >= personal.SEEN:
            share = min(1.0, n / max(1, places[t]))
            bits = np.log2(share / (before["", kind] / words))
            if share >= personal.SHARE and bits >= personal.INFORMATION:
                out[t, kind] = (share, bits)
    return out


@pytest.mark.parametrize("bits", [batches.BUCKET, 1 << 27])
def test_any_number_of_terms(spark, monkeypatch, bits):
    monkeypatch.setattr(batches, "BITS_AT_MOST", bits)
    rows = [(k, f"Call w{k // 3}x on 50{k:08d} after six, and wait. The sum was {k}. Signed by Ms. {'Madinaran' if k % 2 else 'Otherwise'} there, w{k // 2}x too.") for k in range(300)]
    rows += [(900 + r.doc_id, r.text) for r in table(spark, "documents").where("length(text) > 0").select("doc_id", "text").collect()]
    docs, names = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("Madinaran",)], "name_part string")
    got = {(t, k): (share, n) for t, k, share, n in personal.revealing_terms(docs, names)}
    want = plain_revealing_terms([x for _, x in rows], ["Madinaran"])
    assert got.keys() == want.keys() and len(want) > 90 and all(got[x] == pytest.approx(want[x]) for x in want)


def test_many_short_texts(spark):
    rows = [(k, f"{k:06d} {'short' if k % 50 else 'short one, of a few'} text") for k in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id_a, r.doc_id_b) for r in near.near_duplicates(df).collect()}
    sample = [r for r in rows if r[0] % 50 == 0]
    true = brute_pairs(sample)
    assert true and true == {(a, b) for a, b in found if a % 50 == 0 and b % 50 == 0}
