"""The queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.profiles import WS
from ..plans.oracle import BPE, lit, strip
from ..sources.tables import read
from . import language, leak, mixing, near, overlap, packing, personal, quality, tokens, unify


def _of(f: Callable, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return f(*(read(spark, folder, t) if t in ("documents", "merge_gold") else spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))

    return query


def _updated_cube(documents, *tables):
    """From the documents fetched before a day to all of them."""
    return tokens.token_cube_in_steps(documents, documents.where("fetched_at < timestamp '2024-07-01 00:00:00'"), *tables)


#: Statistics of problem 5 that SQL has too.
PLAIN = ("words", "mean_word_length", "words_with_letter", "common_words", "ends_in_punctuation", "lines_a_word", "short_lines", "duplicate_lines", "comma_share")
_WORD, _END, _AROUND = (lit(x) for x in (f"[^{WS}]+", "[.?!।…\"”)']$", r"^[.,;:!?()\[\]\"'|।…\-]+|[.,;:!?()\[\]\"'|।…\-]+$"))
_PLAIN_SQL = f"""with d as (select doc_id, text, regexp_extract_all(text, {_WORD}) as w from documents where length(text) > 0),
    common as (select distinct lower(word) as word from common_words where word is not null),
    w as (select doc_id, count(*) as words, sum(length(x)) / count(*) as mean_word_length, count(*) filter (where regexp_matches(x, '\\p{{L}}')) / count(*) as words_with_letter,
        count(*) filter (where regexp_replace(lower(x), {_AROUND}, '', 'g') in (select word from common)) as common_words from (select doc_id, unnest(w) as x from d) group by doc_id),
    l as (select doc_id, count(*) as n, count(distinct x) as kinds, count(*) filter (where regexp_matches(x, {_END})) as ended, count(*) filter (where length(x) < 30) as short
        from (select doc_id, {strip('x')} as x from (select doc_id, unnest(string_split(text, chr(10))) as x from d)) where x <> '' group by doc_id)
    select doc_id, cast(words as integer) as words, mean_word_length, words_with_letter, cast(common_words as integer) as common_words, ended / n as ends_in_punctuation, n / words as lines_a_word, short / n as short_lines,
        (n - kinds) / n as duplicate_lines, (length(text) - length(replace(text, ',', ''))) / words as comma_share from d join w using (doc_id) join l using (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _of(mixing.short_sources, "merge_gold", "dataset_configs"),
        "p1_mix_report": _of(mixing.mix_report, "merge_gold", "dataset_configs"),
        "p1_source_plan": _of(mixing.source_plan, "merge_gold", "dataset_configs"),
        "p2_found": _of(near.near_duplicates, "documents"),
        "p2_classes": _of(near.near_classes, "documents"),
        "p3_token_cube": _of(tokens.token_cube, "documents", "merge_gold", "lang_codes", "vocab", "merges"),
        "p3_updated_cube": _of(_updated_cube, "documents", "merge_gold", "lang_codes", "vocab", "merges"),
        "p4_found": _of(language.wrong_labels, "documents", "lang_samples", "lang_codes", "common_words"),
        "p4_languages": _of(language.document_languages, "documents", "lang_samples"),
        "p5_found": _of(quality.unnatural_documents, "documents", "common_words"),
        "p5_statistics": _of(quality.text_statistics, "documents", "common_words"),
        "p5_word_and_line_statistics": _of(lambda documents, common: quality.text_statistics(documents, common).select("doc_id", *PLAIN), "documents", "common_words"),
        "p5_reasons_by_source": _of(quality.reasons_by_source, "documents", "common_words"),
        "p6_found": _of(overlap.across_splits, "documents"),
        "p6_overlap_counts": _of(overlap.overlap_counts, "documents"),
        "p6_overlap_report": _of(overlap.overlap_report, "documents"),
        "p7_found": _of(unify.changed_documents, "documents"),
        "p7_texts": _of(unify.unify_documents, "documents"),
        "p8_blocks": _of(lambda documents, specs: packing.packed(packing.public_sizes(documents), specs), "documents", "block_specs"),
        "p8_packing_report": _of(lambda documents, specs: packing.packing_report(packing.public_sizes(documents), specs), "documents", "block_specs"),
        "p8_packing_invariants": _of(lambda documents, specs: packing.packing_invariants(packing.public_sizes(documents), specs), "documents", "block_specs"),
        "p9_found": _of(lambda documents, items: leak.leaks(documents, items).select("doc_id", "item_id"), "documents", "eval_items"),
        "p9_near_leaks": _of(leak.near_leaks, "documents", "eval_items"),
        "p9_leaked_items": _of(leak.leaked_items, "documents", "eval_items"),
        "p10_found": _of(personal.personal_details, "documents", "name_parts", "common_words"),
        "p10_texts": _of(personal.sanitised, "documents", "name_parts", "common_words"),
    }


_PLAN = """
with last as (
    select lower(trim(source)) as source, strlen(line) as bytes, reject_reason,
        row_number() over (partition by line_id order by merged_at desc nulls last, strlen(line) desc,
            lower(trim(source)) desc nulls last, domain desc nulls last, reject_reason desc nulls last) as k
    from merge_gold where line_id is not null and line is not null
), sizes as (
    select source, cast(sum(bytes) as bigint) as bytes, count(*) as lines from last
    where k = 1 and reject_reason is null and source is not null group by source
), wanted as (
    select min(config_key) as config_key, max(target_gb) as target_gb, max(max_repeats) as max_repeats, lower(trim(config_key)) as source
    from dataset_configs where target_gb is not null group by lower(trim(config_key))
), sized as (
    select config_key, w.source, coalesce(bytes, 0) as bytes, coalesce(lines, 0) as lines, max_repeats,
        target_gb / sum(target_gb) over () as share, sum(coalesce(bytes, 0)) over () as all_bytes
    from wanted w left join sizes s on s.source = w.source
), plan as (
    select config_key, source, bytes, lines, share, share * all_bytes as wanted_bytes,
        case when bytes > 0 then least(share * all_bytes / bytes, coalesce(cast(max_repeats as double), 1e300)) else 0.0 end as copies,
        coalesce(share * all_bytes > max_repeats * bytes, false) as short
    from sized
)
"""


#: The cubes of tokens: each document's slice, and its tokens by the byte-pair encoder in SQL.
_CUBE = f"""with recursive {BPE},
    lines as (select doc_id, domain, count(distinct line_id) as n from merge_gold where domain is not null and doc_id is not null group by all),
    domains as (select doc_id, domain from (select *, row_number() over (partition by doc_id order by n desc, encode(domain)) as k from lines) where k = 1),
    names as (select lower(trim(label)) as label, max(lang) as code from lang_codes where label is not null group by 1),
    slices as (select doc_id, coalesce(lower(trim(d.source)), 'unknown') as source, coalesce(code, 'und') as lang, coalesce(domain, 'unknown') as domain
        from (select doc_id, max(source) as source, max(lang) as lang from documents where length(text) > 0 group by doc_id) d left join names on label = lower(trim(d.lang)) left join domains using (doc_id)),
    cube_ as (select s.source, lang, domain, count(*) as documents, cast(sum(t) as bigint) as tokens from slices s join bpe_docs using (doc_id) group by all)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_token_cube": _CUBE + "select *, cast(sum(tokens) over (partition by source) as bigint) as tokens_of_source from cube_ where documents <> 0 or tokens <> 0",
        "p3_updated_cube": _CUBE + "select * from cube_ where documents <> 0 or tokens <> 0",
        "p1_found": _PLAN + "select config_key from plan where short",
        "p1_source_plan": _PLAN + "select * from plan",
        "p5_word_and_line_statistics": _PLAIN_SQL,
        "p8_packing_invariants": """select spec_id, (select count(distinct doc_id) from documents where length(text) > 0) as documents,
            cast(0 as bigint) as tokens_lost, cast(0 as bigint) as blocks_over, cast(0 as bigint) as needless_cuts, true as tight from block_specs where capacity > 0""",
    }
