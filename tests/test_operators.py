import random

import pytest
from pyspark.sql import functions as F

from sorkuvai.operators import bpe, dedup, merge, metrics, ordering, splits, vocabularies
from sorkuvai.plans.pipeline import Pipeline
from sorkuvai.sources import readers, writers
from sorkuvai.streaming import streams

TAMIL = "தமிழ் ஒரு அழகான மொழி ஆகும்"


def test_first_wins(spark):
    rows = spark.createDataFrame([(1, " a"), (2, "a "), (3, None), (4, None), (5, "b")], "k int, line string")
    assert sorted(r.k for r in dedup.first_wins(rows, dedup.line_key(F.col("line")), ["k"]).collect()) == [1, 3, 4, 5]
    assert dedup.dedup_stats(rows, dedup.line_key(F.col("line"))).first()[:3] == (3, 2, 1)
    assert dedup.dedup_stats(rows.limit(0), F.col("line")).first()[:3] == (0, 0, 0)


def test_greedy_keep_is_that_of_going_in_order(spark):
    draw = random.Random(4)
    keys = {(d, draw.randrange(3), draw.randrange(25)) for d in range(80) for _ in range(2)}
    want, kept = {}, []
    for d in range(80):
        mine = {(b, h) for x, b, h in keys if x == d}
        hit = [k for k in kept if mine & {(b, h) for x, b, h in keys if x == k}]
        want[d] = not hit
        kept += [] if hit else [d]
    nodes = spark.range(80).select(F.col("id").alias("doc_id"))
    rows = dedup.greedy_keep(nodes, spark.createDataFrame(sorted(keys), "doc_id bigint, band int, band_hash bigint")).collect()
    assert {r.doc_id: r.keep for r in rows} == want
    assert all((r.dup_of is None) == r.keep for r in rows)


@pytest.mark.parametrize("at_once", [500_000, 40])
def test_greedy_keep_settles_long_chains(spark, monkeypatch, at_once):
    monkeypatch.setattr(dedup, "KEYS_AT_ONCE", at_once)
    keys = [(d, 0, h) for d in range(150) for h in (d, d + 1)] + [(None, 0, 5)]  # each shares a bucket only with the next
    nodes = spark.range(150).select(F.col("id").alias("doc_id"))
    rows = dedup.greedy_keep(nodes, spark.createDataFrame(keys, "doc_id bigint, band int, band_hash bigint")).collect()
    assert sorted((r.doc_id, r.keep, r.dup_of) for r in rows) == [(d, d % 2 == 0, d - 1 if d % 2 else None) for d in range(150)]


def test_greedy_keep_in_order_alone(spark, monkeypatch):
    monkeypatch.setattr(dedup, "KEYS_AT_ONCE", 30)
    draw = random.Random(5)
    keys = {(d, draw.randrange(3), draw.randrange(25)) for d in range(80) for _ in range(2)}
    nodes, table = spark.range(80).select(F.col("id").alias("doc_id")), spark.createDataFrame(sorted(keys), "doc_id bigint, band int, band_hash bigint")
    keep = [{r.doc_id: r.keep for r in dedup.greedy_keep(nodes, table, rounds).collect()} for rounds in (0, 1, 100)]
    assert keep[0] == keep[1] == keep[2] and len(keep[0]) == 80


def test_minhash_finds_what_is_alike(spark):
    base = " ".join(f"சொல்{k}" for k in range(200))
    docs = spark.createDataFrame([(1, base), (2, base.replace("சொல்7 ", "")), (3, "something else altogether " * 9), (4, None)], "doc_id bigint, text string")
    sig = {r.doc_id: r.s for r in docs.select("doc_id", dedup.minhash(F.col("text")).alias("s")).collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / 117
    assert agree(1, 2) > 0.85 and agree(1, 3) < 0.2 and sig[4] is None
    keep = dedup.greedy_keep(docs, dedup.band_keys(docs.where("text is not null").select("doc_id", dedup.minhash(F.col("text")).alias("signature")))).collect()
    assert {r.doc_id: r.dup_of for r in keep} == {1: None, 2: 1, 3: None, 4: None}


def test_shared_pairs(spark):
    draw = random.Random(2)
    sets = {d: set(draw.sample(range(30), 12)) for d in range(40)}
    rows = spark.createDataFrame([(d, len(s), str(x)) for d, s in sets.items() for x in s], "doc_id bigint, n int, item string")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in dedup.shared_pairs(rows, 0.5).collect()} == want


@pytest.mark.parametrize("name", ["q_merge_with_budget", "q_priority_merge"])
def test_lines_are_read_and_composed_once(spark, name):
    from sorkuvai.plans.queries import QUERIES

    plans, checkpoint = [], ordering.checkpointed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordering, "checkpointed", lambda rows: plans.append(rows) or checkpoint(rows))
        plans.append(QUERIES[name](spark, "/root/testdata/sf0.001"))
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("ArrowEvalPython") == 1


def test_merged_with_and_without_text(spark):
    lines = spark.createDataFrame([("own", "f", k, f"{TAMIL} {k // 2}" + " \t" * (k % 2)) for k in range(40)] + [("wiki", "g", 40, f" {TAMIL} 7"), ("wiki", None, 41, f"{TAMIL} 9\x00"), ("own", "f", 42, None), ("own", "f", 43, "short")], "domain string, file_name string, line_no long, line string")
    for budget in (None, 500):
        rows = merge.merged(lines, budget).collect()
        assert {r[:3] for r in rows} == {tuple(r) for r in merge.merged(lines, budget, text=False).collect()}
        assert {r.line for r in rows} >= {f"{TAMIL} 7", f"{TAMIL} 9"} and {(r.domain, r.line_no) for r in rows} >= {("wiki", 40), ("wiki", 41)}
    assert merge.merged(lines).count() == 20


def test_document_shingle_pairs(spark, tmp_path):
    from sorkuvai.plans.queries import QUERIES

    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(3, 9))) for _ in range(200)]
    texts = []
    for base in range(25):
        text = draw.choices(words, k=draw.choice([2, 10, 80, 600]))
        texts += [" ".join(text), " ".join(text[:-1]), " ".join(["The same", *text]) + " "]
    texts += ["aaaaaaaaaaaa", "aaaaa", "AAAAAA", "ab", "AB ", None]
    rows = [(d, x) for d, x in enumerate(texts)]
    spark.createDataFrame([*rows, *rows[:5]], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    low = {d: x.strip(" ").lower() for d, x in rows if x is not None}
    sets = {d: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for d, x in low.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {(r.a, r.b): r.similarity for r in QUERIES["q_document_shingle_pairs"](spark, str(tmp_path)).collect()} == want and len(want) > 20


@pytest.mark.parametrize("held", [500_000, 300])
def test_similar_documents_are_those_of_brute_force(held):
    import pyarrow as pa
    import pyarrow.compute

    draw, texts = random.Random(9), []
    for size in (5, 8, 12, 20, 40, 90, 200, 500, 1500):
        for _ in range(12):
            text = draw.choices("abcdefghijklmnop", k=size)
            for share in (0.03, 0.08, 0.1, 0.11, 0.12):  # cut short and with a stretch put in, so that many are just at 0.8
                copy = text[: round(size * (1 - share))] + draw.choices("xyz", k=round(size * draw.choice([0, share])))
                texts.append("".join(copy))
            texts += ["".join(text)] * 2
    sets = [dedup._cut(x, 5) for x in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    slots = pa.Table.from_batches(dedup._slots(5)(iter(pa.table({"d": pa.array(range(len(texts)), pa.int64()), "low": texts}).to_batches())))
    found = set()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dedup, "PAIRS_HELD", held)
        for slot in set(slots.column("slot").to_pylist()):
            pairs = dedup._together(slots.filter(pa.compute.equal(slots.column("slot"), slot)))
            found |= set(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True))
    assert want <= found and len(want) > 500


def test_large_side_tables_are_not_cut(spark, tmp_path):
    from sorkuvai.plans.queries import QUERIES

    n = 100_050
    ids = spark.range(0, n, 1, 1)
    ids.selectExpr("id as doc_id", "'x' as text", "concat('l', id) as lang", "concat('s', id) as source").write.parquet(f"{tmp_path}/documents.parquet")
    ids.selectExpr("concat('l', id) as label", "'known' as lang").write.parquet(f"{tmp_path}/lang_codes.parquet")
    ids.selectExpr("concat('s', id) as config_key", "'d' as domain").write.parquet(f"{tmp_path}/dataset_configs.parquet")
    assert [tuple(r) for r in QUERIES["q_label_counts"](spark, str(tmp_path)).select("code", "documents").collect()] == [("known", n)]
    joined = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(merge, "thresholded", lambda rows: joined.append(rows.count()) or rows)
        QUERIES["q_source_thresholds"](spark, str(tmp_path))
    assert joined == [n]


def test_running_sums(spark):
    values = [(k, (k * 7) % 11 if k % 5 else None) for k in range(100)]
    random.Random(1).shuffle(values)
    rows = {r.k: r.before for r in ordering.running(spark.createDataFrame(values, "k int, v int"), ["k"], before=F.col("v")).collect()}
    total = 0
    for k, v in sorted(values):
        assert rows[k] == total
        total += v or 0
    kept = ordering.under_budget(spark.createDataFrame(values, "k int, v int"), ["k"], F.col("v"), 30)
    assert sorted(r.k for r in kept.collect()) == [k for k in range(100) if rows[k] < 30]


@pytest.mark.parametrize("end", [None, -1])
def test_blocks(spark, end):
    draw = random.Random(3)
    rows = [(d, [draw.randrange(99) for _ in range(draw.choice([0, 3, 17, 50]))]) for d in range(30)]
    flat = [x for _, ids in rows for x in (ids + ([end] if end is not None else []))]
    got = splits.blocks(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), 16, end=end).orderBy("block_id").collect()
    assert [x for r in got for x in r.ids] == flat[: len(flat) // 16 * 16]
    one = spark.createDataFrame([([*range(n)],) for n in (0, 64, 65, 128, 129)], "ids array<int>").select(splits.slices(F.col("ids")).alias("s")).collect()
    assert sorted(len(r.s) for r in one) == [0, 0, 1, 1, 2]


def test_split_is_the_same_for_equal_texts(spark):
    rows = spark.createDataFrame([(k, f"t{k % 500}") for k in range(1000)], "doc_id bigint, text string")
    sides = {}
    for r in splits.train_eval(rows, 0.2).collect():
        sides.setdefault(r.text, set()).add(r.is_eval)
    assert all(len(s) == 1 for s in sides.values()) and 0.1 < sum(True in s for s in sides.values()) / 500 < 0.3
    assert [r.doc_id for r in splits.sampled(rows, 5, "doc_id").collect()] == [r.doc_id for r in splits.shuffled(rows, "doc_id").limit(5).collect()]


def test_merge(spark):
    lines = spark.createDataFrame([("news", "f", 1, TAMIL), ("wiki", "g", 1, TAMIL + " "), ("news", "f", 2, "short"), ("own", "h", 1, TAMIL + " ஆம்"), (None, None, 3, None)], "domain string, file_name string, line_no int, line string")
    assert {(r.domain, r.line_no) for r in merge.merged(lines).collect()} == {("wiki", 1), ("own", 1)}
    assert merge.merged(lines, 10).count() == 1
    stats = {r.domain: r for r in merge.merge_stats(lines).collect()}
    assert (stats["news"].lines_read, stats["news"].filtered, stats["news"].duplicates) == (2, 1, 1) and stats[None].lines_written == 2
    assert merge.merged(lines.limit(0)).count() == 0


def test_bpe_tables(spark):
    vocab = spark.createDataFrame([(0, "▁", False), (1, "a", False), (2, "▁a", False), (3, "<s>", True), (4, None, None)], "token_id int, token string, is_special boolean")
    merges = spark.createDataFrame([(0, "▁", "a"), (1, None, "a")], "merge_rank int, left_piece string, right_piece string")
    docs = spark.createDataFrame([(1, "a aé"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in bpe.encoded(docs, vocab, merges).collect()}
    assert rows[1].pieces == ["▁a", "▁a", "<0xC3>", "<0xA9>"] and rows[1].decoded == "a aé" and rows[2].pieces == []
    assert bpe.token_table(docs, vocab, merges).where("token_id is null").count() == 2


def test_metrics(spark):
    rows = spark.createDataFrame([("a b", ["x"] * 4), ("a", ["x"]), ("a b c", ["x"] * 9), ("", ["x"])], "text string, pieces array<string>")
    r = metrics.fertility(rows).first()
    assert (r.tokens, r.words, r.median_fertility) == (14, 6, 2.0)
    acc = metrics.boundary_accuracy(spark.createDataFrame([("abcd", ["ab", "cd"], ["a", "b", "cd"]), ("ab", ["ab"], ["ab"]), ("xy", ["xy"], ["x", "y"]), ("pqr", ["p", "q", "r"], ["pq", "r"])], "word string, expected array<string>, pieces array<string>"))
    assert {x.word: x.accuracy for x in acc.collect()} == {"abcd": 1.0, "ab": 1.0, "xy": 0.0, "pqr": 0.5}
    one = spark.range(1).select(metrics.bits_per_character(F.lit(4.0014), F.lit(3.7075)).alias("b"), metrics.perplexity_per_word(F.lit(2.0), F.lit(3.0)).alias("p"), metrics.improvement(F.lit(10.0), F.lit(4.0)).alias("i")).first()
    assert one.b == pytest.approx(1.557, abs=0.001) and one.p == 8 and one.i == 60
    status = {r.metric: r.status for r in metrics.target_check(spark.createDataFrame([("avg_fertility", 2.07), ("bytes_per_token", 10.5)], "metric string, value double")).collect()}
    assert status["avg_fertility"] == "FAIL" and status["bytes_per_token"] == "PASS" and status["roundtrip_accuracy"] == "SKIP" and status["overall"] == "FAIL"


def test_vocabularies(spark):
    base = spark.createDataFrame([(0, "a"), (1, "▁b")], "token_id int, token string")
    fresh = spark.createDataFrame([("▁a",), ("b",), ("c",), (None,)], "token string")
    assert [tuple(r) for r in vocabularies.joined(base, fresh).orderBy("token_id").collect()] == [(0, "a", False), (1, "▁b", False), (2, "c", True)]
    vectors = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "vec_id bigint, embedding array<float>")
    parts = spark.createDataFrame([("x", [1, 2]), ("y", [1]), ("z", []), ("w", [9])], "token string, vec_ids array<bigint>")
    means = vocabularies.mean_embeddings(parts, vectors)
    assert {r.token: r.embedding for r in means.collect()} == {"x": [2.0, 4.0], "y": [1.0, 3.0], "z": [2.0, 4.0], "w": [2.0, 4.0]}
    noisy = vocabularies.with_noise(means)
    assert sorted(noisy.collect()) == sorted(vocabularies.with_noise(means).collect()) != sorted(means.collect())


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "corpus/wiki").mkdir(parents=True)
    (tmp_path / "corpus/wiki/a.txt").write_text("one\r\n\n two\n \nthree\n", encoding="utf-8")
    (tmp_path / "corpus/zeta.txt").write_text("four\n", encoding="utf-8")
    lines = readers.text_lines(spark, str(tmp_path / "corpus"))
    assert sorted((r.domain, r.line) for r in lines.collect()) == [("wiki", " "), ("wiki", " two"), ("wiki", "one"), ("wiki", "three"), ("zeta", "four")]
    assert [r.domain for r in readers.in_priority(lines).collect()] == ["wiki", "zeta"]
    docs = readers.paragraphs(readers.whole_files(spark, str(tmp_path / "corpus/wiki")), " ")
    assert [r.text for r in docs.orderBy("doc_seq").collect()] == ["one", "two", "three"]
    assert [r.text for r in readers.paragraph_file(spark, str(tmp_path / "corpus/zeta.txt")).collect()] == ["four"]
    (tmp_path / "dump.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/"><page><title>A</title><ns>0</ns><revision><text>body</text></revision></page><page><title>B</title><ns>1</ns><revision><text>x</text></revision></page><page><title>C</title><revision><text>#redirect [[A]]</text></revision></page></mediawiki>')
    assert [tuple(r) for r in readers.wiki_pages(spark, str(tmp_path / "dump.xml")).collect()] == [("A", "body")]
    (tmp_path / "r.json").write_text('{"tgt": "x", "lang": "ta"}\nnot json\n{"text": "y", "lang": ""}\n{"text": "z", "lang": "en"}\n')
    rows = readers.json_records(spark, str(tmp_path / "r.json"), "text string, tgt string, lang string")
    assert sorted(r.text for r in readers.records(rows, "tgt", "lang", "ta", 1).collect()) == ["x", "y"]
    out = spark.createDataFrame([("a" * 60, True), ("b", False)], "text string, is_eval boolean")
    writers.write_documents(out, str(tmp_path / "docs"))
    assert readers.paragraph_file(spark, str(tmp_path / "docs")).count() == 1
    writers.write_split(out, str(tmp_path / "split"))
    writers.write_report(out, str(tmp_path / "report"))
    for _ in range(2):
        writers.append_lines(out.withColumnRenamed("text", "line"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 4 and writers.as_json(out).count() == 2
    registry = readers.Registry()
    registry.register("own", lambda s: out)
    assert registry.union(spark, ["own"]).columns == ["source", "text"]
    with pytest.raises(KeyError):
        registry.union(spark, ["other"])


def test_scanned_and_collected(spark):
    rows = spark.range(10).coalesce(1)
    assert readers.scanned(rows, 4, F.col("id") % 2 == 0).count() == 2 and readers.collected(rows, 4, F.col("id") % 2 == 0).count() == 4


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(TAMIL,), (TAMIL + " ",), ("short",), (TAMIL + " ஆம்",)], "line string").coalesce(1).write.text(folder)
    stream = spark.readStream.schema("line string").text(folder)
    table = streams.run_available(streams.first_lines(streams.clean_lines(stream)), "firsts", str(tmp_path / "c1"))
    assert sorted(r.line for r in table.collect()) == sorted([TAMIL, TAMIL + " ஆம்"])
    streams.budgeted(spark.readStream.schema("line string").text(folder), str(tmp_path / "out"), str(tmp_path / "c2"), 5)
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 1
    spark.createDataFrame([("a" * 9,), ("a" * 9,)], "line string").coalesce(1).write.mode("append").text(folder)
    streams.budgeted(spark.readStream.schema("line string").text(folder), str(tmp_path / "out"), str(tmp_path / "c2"), 5)
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 1
    streams.budgeted(spark.readStream.schema("line string").text(folder), str(tmp_path / "more"), str(tmp_path / "c3"), 1 << 20)
    assert spark.read.parquet(str(tmp_path / "more" / "lines")).count() == 6  # copies count


def test_near_duplicates_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in ([(1, "one two three four five six"), (2, "one two three four five six"), (3, "something else altogether")], [(4, "something else altogether"), (5, "new words here, quite new")]):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").json(folder)
        streams.near_duplicates_left_out(spark.readStream.schema("doc_id bigint, text string").json(folder), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5]


def test_links_join_as_in_the_library(spark):
    from urllib.parse import urljoin

    from sorkuvai.functions import urls

    pairs = [(b, x) for b in ("http://a.example/b/c/d?q#f", "https://a.example", "http://u@h.example:80/x/") for x in ("e", "../e", "../../../e", "/e/./f/../g", "//h/i", "http://j/k", "?l", "#m", "", "./", "..", "e/..?n#o", "mailto:x@y")]
    rows = spark.createDataFrame(pairs, "base string, link string").select("base", "link", urls.joined(F.col("base"), F.col("link")).alias("got"), urls.host(F.col("base")).alias("host")).collect()
    assert [(r.base, r.link, r.got) for r in rows] == [(b, x, urljoin(b, x)) for b, x in pairs] and {r.host for r in rows} == {"a.example", "h.example"}


def test_classifier_of_hashed_words(spark):
    from sorkuvai.operators import classify

    good, bad = ("a fine day", "the meal was fine", "fine work indeed"), ("a poor day", "the meal was poor", "poor work indeed")
    rows = spark.createDataFrame([(x, "good") for x in good] + [(x, "bad") for x in bad] + [(None, "bad"), ("x", None)], "text string, label string")
    model = classify.trained(rows, 1 << 10)
    out = classify.classified(model, spark.createDataFrame([("such fine weather",), ("such poor weather",)], "text string")).collect()
    assert [r.predicted for r in out] == ["good", "bad"]


def test_tokenizer_file(spark, tmp_path):
    import json

    from sorkuvai.sources import writers

    writers.write_tokenizer(spark.createDataFrame([(0, "a"), (1, "b"), (2, "ab")], "token_id int, token string"), spark.createDataFrame([(0, "a", "b")], "merge_rank int, left_piece string, right_piece string"), str(tmp_path / "t"))
    assert json.loads(spark.read.text(str(tmp_path / "t")).first()[0]) == {"model": {"type": "BPE", "vocab": {"a": 0, "ab": 2, "b": 1}, "merges": ["a b"]}}


def test_random_embeddings(spark):
    from sorkuvai.operators import vocabularies

    given = spark.createDataFrame([(k, [float(k), 5.0]) for k in range(3)], "vec_id int, embedding array<double>")
    tokens = spark.createDataFrame([(f"t{k}",) for k in range(2000)], "token string")
    rows = [r.embedding for r in vocabularies.random_embeddings(tokens, given).collect()]
    assert abs(sum(x for x, _ in rows) / 2000 - 1) < 0.1 and all(y == 5 for _, y in rows)


def test_pipeline(spark):
    p = Pipeline().then("even", lambda d: d.where("id % 2 = 0")).then("big", lambda d: d.where("id > 4"))
    rows = spark.range(10)
    assert [r.id for r in p.run(rows).collect()] == [6, 8] and p.skip("even").run(rows).count() == 5 and p.only("even").run(rows).count() == 5
    assert p.explain(rows).startswith("even\nbig")
