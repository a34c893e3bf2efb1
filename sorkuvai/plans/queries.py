"""The engine's queries by name. Each reads whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import aksharas, morphemes, predicates, pretokens, sql, text, urls
from ..functions.gold import GOLD
from ..functions.profiles import DEVANAGARI, LATIN, TAMIL
from ..operators import bpe, dedup, merge, metrics, ordering, splits, vocabularies
from ..operators.storage import checkpointed
from ..sources import tables
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.read(spark, folder, "documents", "doc_id", "text", *columns).where("text is not null")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return merge.document_lines(_documents(spark, folder, "source"))


def _gold_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each line_id's row that was merged last; of equal ones the greatest by text, domain and file."""
    rows = tables.read(spark, folder, "merge_gold", "line_id", "domain", "file_name", "line", "merged_at").where("line_id is not null")
    last = rows.groupBy("line_id").agg(F.max(F.struct("merged_at", "line", "domain", "file_name")).alias("r"))
    return last.select(F.col("line_id").alias("line_no"), "r.domain", "r.file_name", "r.line")


def _code_points():
    return F.transform(F.regexp_extract_all("text", F.lit("((?s:.))"), F.lit(1)), lambda c: F.ascii(c))


def _number_of_pretokens():
    return F.regexp_count("text", F.lit(pretokens.PRETOKEN_PLAIN))


def _md5(c: str = "text"):
    return F.md5(c).alias("hash")


@query
def q_line_quality_by_source(spark, folder):
    rows = merge.judged(_lines(spark, folder))
    return rows.groupBy("source", "reject_reason").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))


@query
def q_line_measures(spark, folder):
    n = F.col("line")
    return _lines(spark, folder).select("doc_id", "line_no", text.count(n, TAMIL.letters).alias("n_tamil"), text.count(n, LATIN).alias("n_latin"), predicates.words(n).alias("n_words"), predicates.english_words(n).alias("n_eng"), n.rlike(predicates.CONSECUTIVE).alias("consecutive"))


@query
def q_line_dedup_first_wins(spark, folder):
    once = dedup.first_wins(_lines(spark, folder), dedup.line_key(F.col("line")), ["source", "doc_id", "line_no"])
    return once.select("doc_id", "line_no")


@query
def q_line_dedup_stats(spark, folder):
    lines = _lines(spark, folder).where(F.length(text.ustrip(F.col("line"))) > 0)
    return dedup.dedup_stats(lines, dedup.line_key(F.col("line")))


@query
def q_unseen_lines(spark, folder):
    lines = Tables(spark, folder).merge_gold.where("line is not null")
    late = lines.where("merged_at >= timestamp '2025-02-10 00:00:00'").select("line_id", "line").distinct()
    seen = lines.where("merged_at < timestamp '2025-02-10 00:00:00'").select(dedup.line_key(F.col("line")).alias("key"))
    return dedup.unseen(late, dedup.line_key(F.col("line")), seen).select("line_id").distinct()


@query
def q_doc_exact_dedup(spark, folder):
    return dedup.first_wins(_documents(spark, folder), dedup.document_key(F.col("text")), ["doc_id"]).select("doc_id")


@query
def q_clean_and_filter_docs(spark, folder):
    return _documents(spark, folder).select("doc_id", predicates.clean_and_filter(F.col("text")).alias("text")).select("doc_id", F.length("text").alias("n"), _md5())


@query
def q_reject_reasons(spark, folder):
    ready = _documents(spark, folder, "source").select("source", predicates.prepared(F.col("text")).alias("text"))
    return ready.groupBy("source", predicates.document_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("documents"))


@query
def q_source_thresholds(spark, folder):
    t = Tables(spark, folder)
    domains = t.dataset_configs.select(F.col("config_key").alias("source"), "domain")
    return merge.thresholded(_documents(spark, folder, "source").join(domains, "source")).select("doc_id", "domain")


@query
def q_language_pass(spark, folder):
    rows = Tables(spark, folder).documents.where(merge.passes_language(F.col("lang"), "ta") & (F.length("text") >= 50))
    return rows.select("doc_id")


@query
def q_script_ratios(spark, folder):
    c = F.col("text")
    return _documents(spark, folder).select("doc_id", *(text.script_share(c, k).alias(n) for n, k in (("tamil", TAMIL.letters), ("latin", LATIN), ("devanagari", DEVANAGARI.letters))))


@query
def q_langid_fallback(spark, folder):
    return _documents(spark, folder, "source").groupBy("source").agg(F.count_if(predicates.is_language(F.col("text"))).alias("tamil"), F.count("*").alias("documents"))


@query
def q_normalize_basic(spark, folder):
    return _documents(spark, folder).select("doc_id", text.normalize_basic(F.col("text")).alias("text")).select("doc_id", _md5())


@query
def q_normalize_unicode_only(spark, folder):
    return _documents(spark, folder).select("doc_id", text.normalize_unicode_only(F.col("text")).alias("text")).select("doc_id", _md5())


@query
def q_normalize_deep(spark, folder):
    return _documents(spark, folder).select("doc_id", text.normalize_deep(F.col("text")).alias("text")).select("doc_id", _md5())


@query
def q_normalize_corpus(spark, folder):
    return _documents(spark, folder).select("doc_id", text.normalize_corpus(F.col("text")).alias("text")).select("doc_id", _md5())


@query
def q_isolate_scripts(spark, folder):
    return _documents(spark, folder).select("doc_id", text.isolate_scripts(F.col("text")).alias("text")).select("doc_id", F.length("text").alias("n"), _md5())


@query
def q_strip_links(spark, folder):
    rows = _documents(spark, folder).select("doc_id", F.col("text").alias("old"), text.strip_links(F.col("text")).alias("text"))
    return rows.where("old <> text").select("doc_id", _md5())


@query
def q_numerals(spark, folder):
    rows = _documents(spark, folder).select("doc_id", text.numerals(F.col("text"), "arabic").alias("a"), text.numerals(F.col("text"), "tamil").alias("t"))
    return rows.select("doc_id", F.md5("a").alias("arabic"), F.md5("t").alias("tamil"))


@query
def q_wiki_headings(spark, folder):
    rows = _documents(spark, folder).where(F.col("text").contains("=="))
    return rows.select("doc_id", text.wiki_tidy(F.col("text")).alias("text")).select("doc_id", _md5())


@query
def q_link_targets(spark, folder):
    each = _documents(spark, folder).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({text.URL})"), F.lit(1)))).alias("url"))
    return each.select("doc_id", "url")


@query
def q_akshara_segments(spark, folder):
    return _documents(spark, folder).select("doc_id", aksharas.aksharas(F.col("text")).alias("u")).select("doc_id", F.size("u").alias("units"), F.md5(F.array_join("u", "|")).alias("hash"))


@query
def q_akshara_stats(spark, folder):
    return aksharas.akshara_stats(_documents(spark, folder))


@query
def q_akshara_inventory(spark, folder):
    return aksharas.inventory(spark)


@query
def q_syllables(spark, folder):
    return aksharas.syllables(spark)


@query
def q_morphemes(spark, folder):
    words = morphemes.segmented(morphemes.word_counts(_documents(spark, folder), TAMIL.letters))
    return words.select("word", "n", morphemes.marked(F.col("morphemes"), " @@ ").alias("cut"))


@query
def q_avg_morphemes(spark, folder):
    words = morphemes.segmented(morphemes.word_counts(_documents(spark, folder), TAMIL.letters))
    return words.agg(F.count("*").alias("words"), F.sum(F.size("morphemes")).cast("bigint").alias("morphemes"), (F.sum(F.size("morphemes") * F.col("n")) / F.sum("n")).alias("avg_morphemes"))


@query
def q_pretokens(spark, folder):
    each = _documents(spark, folder).select(F.explode(pretokens.plain_pretokens(F.col("text"))).alias("piece"))
    return metrics.unigram_counts(each)


@query
def q_script_pieces(spark, folder):
    rows = _documents(spark, folder).select("doc_id", "text", pretokens.script_pieces(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("whole"))


@query
def q_token_length_distribution(spark, folder):
    each = _documents(spark, folder).select(F.explode(pretokens.plain_pretokens(F.col("text"))).alias("piece"))
    return metrics.length_distribution(metrics.unigram_counts(each), "token", "n").orderBy("length").limit(20)


@query
def q_unigram_entropy(spark, folder):
    each = _documents(spark, folder).select(F.explode(pretokens.plain_pretokens(F.col("text"))).alias("piece"))
    return metrics.entropy(metrics.unigram_counts(each))


def _train_and_rest(spark, folder):
    rows = _documents(spark, folder, "split").select(F.lower(F.trim("split")).alias("split"), pretokens.plain_pretokens(F.col("text")).alias("pieces"))
    return rows.where("split = 'train'"), rows.where("split in ('validation', 'test')")


@query
def q_unigram_perplexity(spark, folder):
    train, rest = _train_and_rest(spark, folder)
    train, rest = (metrics.unigram_counts(x.select(F.explode("pieces").alias("piece"))) for x in (train, rest))
    return metrics.unigram_perplexity(train, rest)


@query
def q_bigram_perplexity(spark, folder):
    return metrics.bigram_perplexity(*_train_and_rest(spark, folder))


@query
def q_fertility_by_source(spark, folder):
    rows = _documents(spark, folder, "source").withColumn("pieces", _number_of_pretokens())
    return metrics.fertility(rows, "source").where("source is not null")


@query
def q_fertility(spark, folder):
    return metrics.fertility(_documents(spark, folder).withColumn("pieces", _number_of_pretokens()))


@query
def q_compression_by_source(spark, folder):
    return metrics.compression(_documents(spark, folder, "source").withColumn("pieces", _number_of_pretokens()), "source")


@query
def q_grapheme_shredding(spark, folder):
    each = _documents(spark, folder).select(F.explode(pretokens.script_pieces(F.col("text"))).alias("piece"))
    return metrics.shredding(each)


@query
def q_vocab_composition(spark, folder):
    return metrics.composition(Tables(spark, folder).vocab)


@query
def q_cross_script_leakage(spark, folder):
    return metrics.leakage(Tables(spark, folder).vocab).select("token_id", "token")


@query
def q_script_tokens(spark, folder):
    return vocabularies.script_tokens(Tables(spark, folder).vocab)


@query
def q_vocab_merge(spark, folder):
    t = Tables(spark, folder)
    return vocabularies.joined(t.vocab, t.common_words.select(F.col("word").alias("token")))


@query
def q_vocab_difference(spark, folder):
    t = Tables(spark, folder)
    return vocabularies.difference(t.common_words.select(F.col("word").alias("token")), t.vocab)


@query
def q_syllable_coverage(spark, folder):
    return metrics.coverage(aksharas.syllables(spark), Tables(spark, folder).vocab)


@query
def q_missing_syllables(spark, folder):
    return metrics.missing_units(aksharas.syllables(spark), Tables(spark, folder).vocab)


def _gold(spark):
    words = spark.createDataFrame([(w, list(m)) for w, m in GOLD], "word string, expected array<string>")
    return morphemes.segmented(words).select("word", "expected", F.col("morphemes").alias("pieces"))


@query
def q_boundary_accuracy(spark, folder):
    return metrics.boundary_accuracy(_gold(spark))


@query
def q_target_check(spark, folder):
    t = Tables(spark, folder)
    cover = metrics.coverage(aksharas.syllables(spark), t.vocab).select(F.lit("tamil_syllable_coverage").alias("metric"), F.col("share").cast("double").alias("value"))
    leak = metrics.leakage(t.vocab).agg(F.count("*").cast("double").alias("value")).select(F.lit("cross_script_leakage_count").alias("metric"), "value")
    bound = metrics.boundary_accuracy(_gold(spark)).agg(F.avg("accuracy").alias("value")).select(F.lit("morpheme_boundary_accuracy").alias("metric"), "value")
    return metrics.target_check(cover.union(leak).union(bound))


@query
def q_bpe_fertility_by_source(spark, folder):
    t = Tables(spark, folder)
    return metrics.fertility(bpe.encoded(_documents(spark, folder, "source"), t.vocab, t.merges), "source")


@query
def q_bpe_compression(spark, folder):
    t = Tables(spark, folder)
    return metrics.compression(bpe.encoded(_documents(spark, folder), t.vocab, t.merges))


@query
def q_bpe_roundtrip(spark, folder):
    t = Tables(spark, folder)
    return metrics.roundtrip(bpe.encoded(_documents(spark, folder), t.vocab, t.merges))


@query
def q_bpe_token_table(spark, folder):
    t = Tables(spark, folder)
    rows = bpe.token_table(_documents(spark, folder), t.vocab, t.merges)
    return rows.groupBy("piece").agg(F.max("token_id").alias("token_id"), F.count("*").alias("n"))


@query
def q_tokenizer_comparison(spark, folder):
    t = Tables(spark, folder)
    docs = _documents(spark, folder)
    own = bpe.encoded(docs, t.vocab, t.merges).select("text", "pieces")
    plain = docs.select("text", pretokens.plain_pretokens(F.col("text")).alias("pieces"))
    both = own.withColumn("tokenizer", F.lit("bpe")).unionByName(plain.withColumn("tokenizer", F.lit("pretokens")))
    return metrics.fertility(both, "tokenizer").join(metrics.compression(both, "tokenizer").select("tokenizer", "bytes_per_token"), "tokenizer").orderBy("avg_fertility")


@query
def q_pair_counts(spark, folder):
    words = morphemes.word_counts(_documents(spark, folder))
    return bpe.pair_counts(words, F.regexp_extract_all(F.concat(F.lit("▁"), "word"), F.lit("((?s:.))"), F.lit(1)))


@query
def q_train_eval_split(spark, folder):
    return splits.train_eval(_documents(spark, folder)).select("doc_id", "is_eval")


@query
def q_sample(spark, folder):
    return splits.sampled(_documents(spark, folder), 1000, "doc_id").select("doc_id")


@query
def q_byte_budget(spark, folder):
    rows = _documents(spark, folder)
    return ordering.under_budget(rows, ["doc_id"], F.octet_length("text"), 1_000_000).select("doc_id")


@query
def q_running_bytes(spark, folder):
    return ordering.running(_documents(spark, folder), ["doc_id"], before=F.octet_length("text"), row_no=F.lit(1)).select("doc_id", "before", "row_no")


@query
def q_block_packing(spark, folder):
    rows = _documents(spark, folder).select("doc_id", _code_points().alias("ids"))
    return splits.blocks(rows, 512, end=0).select("block_id", F.md5(F.array_join("ids", ",")).alias("hash"))


@query
def q_block_packing_by_batch(spark, folder):
    rows = _documents(spark, folder).select("doc_id", _code_points().alias("ids"))
    return splits.blocks_by_batch(rows, 512, 100).select("batch", "block_id", F.md5(F.array_join("ids", ",")).alias("hash"))


@query
def q_priority_merge(spark, folder):
    return merge.merged(_gold_lines(spark, folder), text=False).select("domain", "line_no")


@query
def q_merge_with_budget(spark, folder):
    return merge.merged(_gold_lines(spark, folder), 500_000, text=False).select("domain", "line_no")


@query
def q_merge_stats(spark, folder):
    return merge.merge_stats(_gold_lines(spark, folder))


@query
def q_corpus_estimate(spark, folder):
    return merge.corpus_estimate(_lines(spark, folder), TAMIL.letters)


@query
def q_file_summary(spark, folder):
    return merge.file_summary(_gold_lines(spark, folder))


@query
def q_latest_line(spark, folder):
    rows = Tables(spark, folder).merge_gold
    last = rows.groupBy("line_id").agg(F.unix_micros(F.max("merged_at")).alias("merged_us"), F.count("*").alias("rows"))
    return last.where("rows > 1")


@query
def q_late_merges_by_week(spark, folder):
    rows = Tables(spark, folder).merge_gold.where("merged_at > collected_at + interval 30 days")
    return rows.groupBy(F.date_format(F.date_trunc("week", "merged_at"), "yyyy-MM-dd").alias("week"), "domain").agg(F.count("*").alias("lines"))


@query
def q_domain_stats_totals(spark, folder):
    rows = Tables(spark, folder).domain_stats.distinct()
    return rows.rollup("domain").agg(F.count("*").alias("runs"), F.sum("lines_read").alias("lines_read"), F.sum("lines_written").alias("lines_written"), F.sum("bytes").alias("bytes"))


@query
def q_minhash_keep(spark, folder):
    docs = _documents(spark, folder)
    keys = dedup.band_keys(docs.select("doc_id", dedup.minhash(F.col("text")).alias("signature")))
    return dedup.greedy_keep(docs, keys)


@query
def q_shingle_pairs(spark, folder):
    items = Tables(spark, folder).eval_items.select(F.col("item_id").alias("doc_id"), dedup.shingles(F.col("text")).alias("s"))
    sets = items.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("item"))
    return dedup.shared_pairs(sets, 0.15)


@query
def q_document_shingle_pairs(spark, folder):
    return dedup.similar_documents(_documents(spark, folder))


@query
def q_embedding_means(spark, folder):
    rows = Tables(spark, folder).embeddings
    parts = rows.groupBy(F.concat(F.lit("label"), F.col("label").cast("string")).alias("token")).agg(F.collect_list("vec_id").alias("vec_ids"))
    means = vocabularies.mean_embeddings(parts, rows)
    return means.select("token", F.posexplode("embedding").alias("dim", "x")).select("token", "dim", F.round("x", 9).alias("x"))


@query
def q_embedding_norms(spark, folder):
    out = vocabularies.norm_report(Tables(spark, folder).embeddings)
    return out.select("label", "vectors", *(F.round(c, 9).alias(c) for c in ("mean_norm", "std_norm", "ratio")), "warn")


@query
def q_event_windows(spark, folder):
    rows = Tables(spark, folder).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return streams.windowed(rows, "ts", "1 hour", by=("event_type",))


@query
def q_event_sliding_windows(spark, folder):
    rows = Tables(spark, folder).events.select(F.col("ts").cast("timestamp").alias("ts"))
    return streams.windowed(rows, "ts", "1 hour", "30 minutes")


@query
def q_event_sessions(spark, folder):
    return streams.sessions(Tables(spark, folder).events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "ts", "user_id", "30 minutes")


@query
def q_label_counts(spark, folder):
    t = Tables(spark, folder)
    names = t.lang_codes.select(F.lower(F.trim("label")).alias("label"), F.col("lang").alias("code"))
    labels = t.documents.select(F.lower(F.trim("lang")).alias("label"))
    return labels.join(names, "label", "left").groupBy(F.coalesce("code", F.lit("none")).alias("code")).agg(F.count("*").alias("documents"))


@query
def q_publisher_top(spark, folder):
    n = checkpointed(Tables(spark, folder).documents.groupBy("publisher").agg(F.count("*").alias("documents")))
    least = n.orderBy(F.desc("documents"), "publisher").limit(20).agg(F.min("documents").alias("least"))  # ties with the last stay
    top = n.join(F.broadcast(least)).where("documents >= least").select("publisher", "documents")
    return top.withColumn("place", F.rank().over(Window.orderBy(F.desc("documents"))))  # the 20 and their ties


PAGE = ("<html><head><title>t</title><script>var x = '<p>';</script><style>p {}</style></head><body><nav>menu</nav><div class=\"story\"><p>", "</p><!-- end --></div><footer>f</footer></body></html>")


def _pages(spark, folder):
    """The documents as pages of HTML."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _documents(spark, folder).select("doc_id", F.concat(F.lit(PAGE[0]), escaped, F.lit(PAGE[1])).alias("html"))


@query
def q_html_text(spark, folder):
    return _pages(spark, folder).select("doc_id", text.html_text(F.regexp_replace("html", "<title>t</title>", "")).alias("text")).select("doc_id", _md5())


@query
def q_html_article(spark, folder):
    return _pages(spark, folder).select("doc_id", text.html_article(F.col("html")).alias("text")).select("doc_id", F.length("text").alias("n"), _md5())


@query
def q_link_hosts(spark, folder):
    each = _documents(spark, folder).select(F.explode(F.regexp_extract_all("text", F.lit(f"({text.URL})"), F.lit(1))).alias("url"))
    return each.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("links"))


@query
def q_joined_links(spark, folder):
    link = F.element_at(F.array(*map(F.lit, LINKS)), (F.pmod("doc_id", F.lit(len(LINKS))) + 1).cast("int"))
    rows = Tables(spark, folder).documents.where("doc_id is not null").select("doc_id", F.concat(F.lit("https://h.example/"), "doc_id", F.lit("/b/c.html?q=1#f")).alias("base"), link.alias("link"))
    return rows.select("doc_id", urls.joined(F.col("base"), F.col("link")).alias("url"))


LINKS = ("x.html", "../y", "/z?k=2", "//other.example/p", "https://o.example/", "?r=3", "#g", "./", "../../../w")


@query
def q_event_props(spark, folder):
    rows = Tables(spark, folder).events.select("event_type", F.from_json("props", "k int").k.alias("k"), F.get_json_object("props", "$.k").cast("int").alias("again"))
    return rows.groupBy("event_type").agg(F.count("k").alias("given"), F.sum("k").alias("total"), F.max("k").alias("most"), F.sum("again").alias("again"))


@query
def q_corpus_validation(spark, folder):
    return merge.validation(_lines(spark, folder))


@query
def q_first_lines(spark, folder):
    return merge.first_lines(_lines(spark, folder), ["doc_id", "line_no"])


@query
def q_sources_under_budget(spark, folder):
    """By byte budget over sources in a given order, as many corpora are collected."""
    order = [r.config_key for r in Tables(spark, folder).dataset_configs.where("config_key is not null").select("config_key").distinct().orderBy("config_key").limit(1000).collect()]
    return merge.sources_under_budget(_documents(spark, folder, "source"), order, 1_500_000).select("source", "doc_id")


@query
def q_character_kinds(spark, folder):
    kinds = {k: predicates.count(F.col("text"), v) for k, v in predicates.CHARACTER_KINDS.items()}
    return _documents(spark, folder, "source").groupBy("source").agg(*(F.sum(v).alias(k) for k, v in kinds.items()))


@query
def q_invalid_boundaries(spark, folder):
    # Written once: as one plan the cutting would be worked out again for every use of the pieces.
    words = checkpointed(morphemes.segmented(morphemes.word_counts(_documents(spark, folder), TAMIL.letters)).select("word", "morphemes"))
    ends = words.where(F.size("morphemes") > 1).select("word", F.explode(metrics.boundaries(F.col("morphemes"))).alias("at"))
    return ends.groupBy(predicates.is_invalid_boundary(F.col("word"), F.col("at")).alias("invalid")).agg(F.count("*").alias("boundaries"))


@query
def q_strict_leakage(spark, folder):
    return metrics.leakage(Tables(spark, folder).vocab, strict=True).select("token_id", "token")


@query
def q_unigram_counts_capped(spark, folder):
    each = _documents(spark, folder).select("doc_id", F.posexplode(pretokens.plain_pretokens(F.col("text"))).alias("pos", "piece"))
    return metrics.unigram_counts(each, most=50_000, order=["doc_id", "pos"])


@query
def q_token_stats(spark, folder):
    return metrics.token_stats(_documents(spark, folder, "source").withColumn("pieces", _number_of_pretokens()), "source")


@query
def q_tokenizer_delta(spark, folder):
    """Two ways of cutting, side by side."""
    rows = _documents(spark, folder).select("text", _number_of_pretokens().alias("a"), F.size(pretokens.script_pieces(F.col("text"))).alias("b"))
    a, b = (metrics.token_stats(rows, tokens=c).select(*(F.col(x).alias(f"{x}_{c}") for x in ("tokens_per_word", "bytes_per_token"))) for c in "ab")
    both = a.join(F.broadcast(b))  # one row each
    return both.withColumns({f"{x}_delta": F.col(f"{x}_b") - F.col(f"{x}_a") for x in ("tokens_per_word", "bytes_per_token")})


@query
def q_byte_level_pieces(spark, folder):
    each = _documents(spark, folder).select(F.explode(pretokens.script_pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    return each.groupBy(pretokens.byte_level(F.col("piece")).alias("bytes")).agg(F.sum("n").alias("n"))


@query
def q_byte_level_split(spark, folder):
    cut = pretokens.byte_level_pieces(pretokens.marked_script_pieces(F.col("text")))
    return _documents(spark, folder).select("doc_id", F.size(cut).alias("pieces"))


@query
def q_sql_functions(spark, folder):
    sql.register(spark)
    _documents(spark, folder).createOrReplaceTempView("sql_documents")
    return spark.sql("select doc_id, line_key(text) as hash, script_share(text) as share, akshara_count(text) as units from sql_documents")


@query
def q_sql_aksharas(spark, folder):
    sql.register(spark)
    _documents(spark, folder).createOrReplaceTempView("sql_documents")
    return spark.sql("select akshara, count(*) as n from sql_documents, lateral aksharas(text) group by akshara")
