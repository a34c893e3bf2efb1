"""The same queries in SQL for DuckDB, whose regular expressions have neither look-around nor back-references."""

from __future__ import annotations

from ..functions import aksharas, morphemes, pretokens, text
from ..functions import profiles as P
from ..functions.predicates import CONSECUTIVE
from ..operators.merge import PRIORITY, THRESHOLDS
from ..operators.metrics import TARGETS
from .queries import GOLD, LINKS

T, WS, LATIN = P.TAMIL.letters, P.WS, P.LATIN
ORACLE: dict[str, str] = {}


def lit(x: str) -> str:
    """A SQL string; control characters by their codes."""
    out = "'" + x.replace("'", "''") + "'"
    for ch in "\n\r\t\x00":
        out = out.replace(ch, f"' || chr({ord(ch)}) || '")
    return f"({out})" if "||" in out else out


def sub(x: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"
    return x


def strip(x: str) -> str:
    return sub(x, (rf"^[{WS}]+|[{WS}]+\z", ""))


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def delete(x: str, characters: str) -> str:
    return sub(x, ("[" + "".join(rf"\x{{{ord(c):X}}}" for c in characters) + "]", ""))


DOCS = "select doc_id, text, source, split from documents where text is not null"
LINES = f"""
pieces as (select source, doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as a from ({DOCS})),
lines as (select source, doc_id, line, line_no from (select source, doc_id, unnest(a) as line, unnest(range(len(a))) as line_no from pieces) where length(line) > 0)
"""


def basic(x: str) -> str:
    return strip(sub(f"nfc_normalize({x})", (r"[\t\r]+", " "), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")))


def unicode_only(x: str) -> str:
    x = delete(f"nfc_normalize({sub(x, (chr(92) + 'r' + chr(92) + 'n?', chr(10)))})", P.INVISIBLE)
    x = sub(x, ("[" + "".join(rf"\x{{{ord(c):X}}}" for c in P.BLANKS) + "]", " "))
    x = sub(x, *((rf"([{T}])\x{{{j}}}([{T}])", r"\1\2") for j in ("200D", "200C")))
    return sub(x, (P.PULLI + "{2,}", P.PULLI), (r"([\x{0BBE}-\x{0BCC}]){2,}", r"\1"))


# Without back-references: the characters of which runs of ten or more stand in texts.
RUNS = [(("\\" if c in "-.*+|^" else "") + c + "{10,}", c * 3) for c in "-._=*#~^/;+|0123456789 "]


def squeeze(x: str, marks: str) -> str:
    return sub(x, (rf"([{marks}]){{4,}}", r"\1\1\1"), *RUNS)


def no_links(x: str) -> str:
    return sub(x, (text.URL, " "), (text.EMAIL, " "))


def deep(x: str) -> str:
    x = sub(squeeze(no_links(unicode_only(x)), "!?.,;:…"), (r"[^\P{C}\n\t]", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    x = sub(x, *((rf"([{c}]+)", r" \1 ") for c in (T, LATIN, "0-9")), (r"[ \t]+", " "))
    return strip(sub(x, (rf"[{P.WS_IN_LINE}]*\n[{P.WS_IN_LINE}]*", "\n")))


def corpus(x: str) -> str:
    return strip(sub(squeeze(no_links(delete(f"nfc_normalize({x})", P.ZERO_WIDTH)), "!?.,;:"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[^\P{C}\n\t]", "")))


def isolate(x: str) -> str:
    d = P.DIGIT
    rules = [(rf"([{T}])([{LATIN}{d}])", r"\1 \2"), (rf"([{LATIN}])([{T}{d}])", r"\1 \2"), (rf"([{d}])([{T}{LATIN}])", r"\1 \2")]
    return sub(x, *rules, *rules)


def share(x: str, inside: str) -> str:
    return f"(case when {n_of(x, '[' + chr(92) + 'p{L}]')} > 0 then {n_of(x, '[' + inside + ']')} / {n_of(x, '[' + chr(92) + 'p{L}]')} else 0.0 end)"


def english(x: str) -> str:
    runs = lit(r"[\p{L}\p{N}_]+")
    return f"len(list_filter(regexp_extract_all({x}, {runs}), lambda w: regexp_full_match(w, '[A-Za-z]{{2,}}')))"


def reason(x: str, least: str = "0.6") -> str:
    own, latin = n_of(x, f"[{T}]"), n_of(x, f"[{LATIN}]")
    return f"""case when length({x}) < 20 then 'too_short' when length({x}) > 50000 then 'too_long' when {own} = 0 then 'no_tamil'
        when {own} / ({own} + {latin}) < {least} then 'low_tamil' when regexp_matches({x}, {lit(CONSECUTIVE)}) then 'consecutive_english'
        when {english(x)} / {n_of(x, f"[^{WS}]+")} > 0.4 then 'english_words' end"""


JUDGED = f"judged as (select *, {reason('line')} as reject_reason from (select source, doc_id, line_no, {basic('line')} as line from lines))"
GOLD_LINES = """gold as (select line_id as line_no, domain, file_name, line from (select *, row_number() over (partition by line_id
    order by merged_at desc nulls last, encode(line) desc nulls last, encode(domain) desc nulls last, encode(file_name) desc nulls last) as latest from merge_gold where line_id is not null) where latest = 1)"""
RANK = "case " + " ".join(f"when domain = '{d}' then {k}" for k, d in enumerate(PRIORITY)) + f" else {len(PRIORITY)} end"
ORDER = "priority, domain nulls first, file_name nulls first, line_no"
MERGED = f"""{GOLD_LINES}, clean as (select *, {reason('line')} as reject_reason, {RANK} as priority from (select line_no, domain, file_name, {basic('line')} as line from gold)),
once as (select * from (select *, row_number() over (partition by md5({strip('line')}) order by {ORDER}) as k from clean where reject_reason is null and line is not null) where k = 1)"""
PIECES = f"pieces as (select doc_id, source, split, text, regexp_extract_all(text, {lit(pretokens.PRETOKEN_PLAIN)}) as p from ({DOCS}))"
TOKENS = f"{PIECES}, tokens as (select doc_id, lower(trim(split)) as split, unnest(p) as piece, unnest(range(len(p))) as pos from pieces)"
COUNTS = "counts as (select piece as token, count(*) as n from tokens group by piece)"
WORDS = f"words as (select word, count(*) as n from (select unnest(regexp_extract_all(text, {lit(f'[^{WS}]+')})) as word from ({DOCS})) where regexp_full_match(word, {lit(f'[{T}]+')}) group by word)"

ORACLE["q_line_quality_by_source"] = f"with {LINES}, {JUDGED} select source, reject_reason, count(*) as lines, cast(sum(strlen(line)) as bigint) as bytes from judged group by all"
ORACLE["q_line_measures"] = f"""with {LINES} select doc_id, line_no, {n_of('line', f'[{T}]')} as n_tamil, {n_of('line', f'[{LATIN}]')} as n_latin,
    {n_of('line', f'[^{WS}]+')} as n_words, {english('line')} as n_eng, regexp_matches(line, {lit(CONSECUTIVE)}) as consecutive from lines"""
ORACLE["q_line_dedup_first_wins"] = f"""with {LINES} select doc_id, line_no from (select *, row_number() over (partition by md5({strip('line')})
    order by source nulls first, doc_id, line_no) as k from lines) where k = 1"""
ORACLE["q_line_dedup_stats"] = f"""with {LINES}, n as (select md5({strip('line')}) as key, count(*) as n from lines where length({strip('line')}) > 0 group by 1)
    select cast(sum(n) as bigint) as total, count(*) as unique_lines, cast(sum(n) - count(*) as bigint) as duplicates, (sum(n) - count(*)) / greatest(sum(n), 1) as ratio from n"""
ORACLE["q_unseen_lines"] = f"""select distinct line_id from merge_gold where line is not null and merged_at >= timestamp '2025-02-10 00:00:00'
    and md5({strip('line')}) not in (select md5({strip('line')}) from merge_gold where line is not null and merged_at < timestamp '2025-02-10 00:00:00')"""
ORACLE["q_doc_exact_dedup"] = f"select min(doc_id) as doc_id from ({DOCS}) group by substr(md5(text), 1, 16)"
ORACLE["q_clean_and_filter_docs"] = f"""with lines as (select doc_id, {strip('x')} as line, k from (select doc_id, unnest(string_split(t, chr(10))) as x, unnest(range(len(string_split(t, chr(10))))) as k
        from (select doc_id, {basic('text')} as t from ({DOCS})))),
    kept as (select *, lag(line) over (partition by doc_id order by k) as prev from (select * from lines where line = '' or ({reason('line')}) is null)),
    clean as (select doc_id, string_agg(line, chr(10) order by k) as t from kept where line <> '' or (prev is not null and prev <> '') group by doc_id)
    select doc_id, length(coalesce(t, '')) as n, md5(coalesce(t, '')) as hash from ({DOCS}) left join clean using (doc_id)"""
ORACLE["q_reject_reasons"] = f"""with ready as materialized (select source, {isolate('c')} as t from (select source, {corpus('text')} as c from ({DOCS})))
    select source, case when length(t) < 20 then 'too_short' when {share('substr(t, 1, 100000)', LATIN)} > 0.3 then 'english' when {share('substr(t, 1, 100000)', T)} < 0.4 then 'tamil' end as reason,
    count(*) as documents from ready group by all"""
ORACLE["q_source_thresholds"] = f"""select doc_id, c.domain from ({DOCS}) d join dataset_configs c on d.source = c.config_key where
    {share('text', T)} >= case c.domain {' '.join(f"when '{k}' then {s}" for k, (s, _) in THRESHOLDS.items())} else 0.6 end
    and length(text) > case c.domain {' '.join(f"when '{k}' then {n}" for k, (_, n) in THRESHOLDS.items())} else 100 end"""
ORACLE["q_language_pass"] = "select doc_id from documents where coalesce(lang, '') in ('', 'ta') and length(text) >= 50"
ORACLE["q_script_ratios"] = f"select doc_id, {share('text', T)} as tamil, {share('text', LATIN)} as latin, {share('text', P.DEVANAGARI.letters)} as devanagari from ({DOCS})"
ORACLE["q_langid_fallback"] = f"select source, cast(count(*) filter (where {share('text', T)} > 0.5) as bigint) as tamil, count(*) as documents from ({DOCS}) group by source"
for _name, _f in (("basic", basic), ("unicode_only", unicode_only), ("deep", deep), ("corpus", corpus)):
    ORACLE[f"q_normalize_{_name}"] = f"select doc_id, md5({_f('text')}) as hash from ({DOCS})"
ORACLE["q_isolate_scripts"] = f"select doc_id, length(t) as n, md5(t) as hash from (select doc_id, {isolate('text')} as t from ({DOCS}))"
ORACLE["q_strip_links"] = f"select doc_id, md5(t) as hash from (select doc_id, text, {no_links('text')} as t from ({DOCS})) where t <> text"
ORACLE["q_numerals"] = f"select doc_id, md5(translate(text, '{P.TAMIL_DIGITS}', '0123456789')) as arabic, md5(translate(text, '0123456789', '{P.TAMIL_DIGITS}')) as tamil from ({DOCS})"
_flat = sub("text", *[(r"\{\{[^{}]*\}\}", "")] * 4)  # templates from the inside out, as deep as these texts have them
_tidy = strip(sub(_flat, (r"(?i)\[\[\s*(category|பகுப்பு)\s*:[^\[\]]*\]\]", ""), (r"(?s)\{\|.*?\|\}", ""), (r"={2,}\s*", "\n"), (r"\n{3,}", "\n\n")))
ORACLE["q_wiki_headings"] = f"select doc_id, md5({_tidy}) as hash from ({DOCS}) where contains(text, '==')"
ORACLE["q_link_targets"] = f"select distinct doc_id, unnest(regexp_extract_all(text, {lit(text.URL)})) as url from ({DOCS})"
UNITS = f"units as (select doc_id, regexp_extract_all(text, {lit(aksharas.AKSHARA)}) as u from ({DOCS}))"
ORACLE["q_akshara_segments"] = f"with {UNITS} select doc_id, len(u) as units, md5(array_to_string(u, '|')) as hash from units"


def unit_kind(x: str) -> str:
    c = P.CONSONANTS
    rules = (
        (f"^[{P.VOWELS}]$", "vowel"), (f"^{P.AYTHAM}$", "aytham"), (f"^[{P.TAMIL_DIGITS}]$", "digit"), (f"^[{P.SYMBOLS}]$", "symbol"), (f"^[{c}]{P.PULLI}[{c}]", "conjunct"),
        (f"^[{c}]{P.PULLI}$", "consonant_pulli"), (f"^[{c}]", "consonant_vowel"), (f"^[{WS}]$", "space"), ("^[A-Za-z]$", "latin"), (aksharas.PUNCTUATION, "punctuation"),
    )
    return "case " + " ".join(f"when regexp_matches({x}, {lit(p)}) then '{k}'" for p, k in rules) + " else 'other' end"


ORACLE["q_akshara_stats"] = f"""with {UNITS}, n as (select unnest(u) as unit, count(*) as n from units group by 1)
    select {unit_kind('unit')} as type, cast(sum(n) as bigint) as total, count(*) as distinct_units from n group by 1"""


def values(xs, name: str) -> str:
    return "(values " + ", ".join(f"({lit(x)})" for x in xs) + f") as {name}_t({name})"


ORACLE["q_akshara_inventory"] = f"""select v as text, 'vowel' as type from {values(P.VOWELS, 'v')}
    union all select c || s, case when s = '{P.PULLI}' then 'consonant_pulli' else 'consonant_vowel' end from {values(P.CONSONANTS, 'c')}, {values(['', P.PULLI, *P.VOWEL_SIGNS], 's')}
    union all select '{P.AYTHAM}', 'aytham' union all select j, 'conjunct' from {values(P.CONJUNCTS, 'j')}"""
SYLLABLES = f"""syllables as (select v as syllable from {values([*P.VOWELS, P.AYTHAM], 'v')} union all select c || s from {values(P.NATIVE_CONSONANTS, 'c')}, {values([P.PULLI, '', *P.VOWEL_SIGNS], 's')})"""
ORACLE["q_syllables"] = f"with {SYLLABLES} select syllable from syllables"


def cutting(source: str) -> str:
    """Tables r0 to r5: word, stem, cut and whether the cutting goes on."""
    suffix, joint = lit(morphemes.suffix_pattern()), lit(morphemes.SANDHI_PATTERN)
    out = [f"r0 as (select *, word as stem, cast([] as varchar[]) as cut, true as going from {source})"]
    for k in range(morphemes.ROUNDS):
        out.append(f"""s{k} as (select *, going and sfx <> '' and length(stem) - length(sfx) >= {morphemes.SHORTEST_STEM} as ok from (select *, regexp_extract(stem, {suffix}, 1) as sfx from r{k})),
            j{k} as (select *, case when ok then regexp_extract(rest, {joint}, 1) else '' end as joint from (select *, case when ok then left(stem, length(stem) - length(sfx)) else stem end as rest from s{k})),
            r{k + 1} as (select * exclude (stem, cut, going, sfx, ok, rest, joint), left(rest, length(rest) - length(joint)) as stem, case when ok then list_concat([joint, sfx], cut) else cut end as cut, ok as going from j{k})""")
    out.append(f"cutted as (select * exclude (stem, cut, going), list_filter(list_concat([stem], cut), lambda x: x <> '') as morphemes from r{morphemes.ROUNDS})")
    return ",\n".join(out)


ORACLE["q_morphemes"] = f"with {WORDS}, {cutting('words')} select word, n, array_to_string(morphemes, ' @@ ') as cut from cutted"
ORACLE["q_avg_morphemes"] = f"""with {WORDS}, {cutting('words')} select count(*) as words, cast(sum(len(morphemes)) as bigint) as morphemes,
    sum(len(morphemes) * n) / sum(n) as avg_morphemes from cutted"""
ORACLE["q_pretokens"] = f"with {TOKENS}, {COUNTS} select token, n from counts"
ORACLE["q_token_length_distribution"] = f"""with {TOKENS} select length(piece) as length, count(*) as tokens, count(*) / sum(count(*)) over () as share from tokens group by 1 order by 1 limit 20"""
ORACLE["q_unigram_entropy"] = f"""with {TOKENS}, {COUNTS}, total as (select sum(n) as t from counts) select cast(sum(n) as bigint) as tokens, count(*) as types, -sum(n / t * log2(n / t)) as entropy from counts, total"""
ORACLE["q_unigram_perplexity"] = f"""with {TOKENS}, train as (select piece, count(*) as n from tokens where split = 'train' group by 1), size as (select sum(n) as s, count(*) as v from train),
    rest as (select piece, count(*) as m from tokens where split in ('validation', 'test') group by 1)
    select exp(-sum(m * ln((coalesce(n, 0) + 1) / (s + v + 1))) / sum(m)) as perplexity, cast(sum(m) as bigint) as tokens from rest left join train using (piece), size"""
ORACLE["q_bigram_perplexity"] = f"""with {TOKENS}, p as (select split, piece, lead(piece) over (partition by doc_id order by pos) as next from tokens),
    train as (select piece, next, count(*) as n from p where split = 'train' and next is not null group by all), firsts as (select piece, sum(n) as f from train group by 1),
    rest as (select piece, next, count(*) as m from p where split in ('validation', 'test') and next is not null group by all),
    size as (select count(distinct piece) as v from tokens where split = 'train')
    select exp(-sum(m * ln((coalesce(n, 0) + 1) / (coalesce(f, 0) + v + 1))) / sum(m)) as perplexity, cast(sum(m) as bigint) as tokens
    from rest left join train using (piece, next) left join firsts using (piece), size"""


def fertility(by: str) -> str:
    part, keys = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    return f"""with {PIECES}, f as (select {keys} len(p) as t, {n_of('text', f'[^{WS}]+')} as w from pieces),
    r as (select *, t / w as x, row_number() over ({part}order by t / w) as k, count(*) over ({part}) as c from f where w > 0)
    select {keys} cast(sum(t) as bigint) as tokens, cast(sum(w) as bigint) as words, sum(t) / sum(w) as avg_fertility, max(x) filter (where k = c // 2 + 1) as median_fertility from r {'group by ' + by if by else ''}"""


ORACLE["q_fertility"] = fertility("")
ORACLE["q_fertility_by_source"] = f"select * from ({fertility('source')}) where source is not null"
ORACLE["q_compression_by_source"] = f"with {PIECES} select source, cast(sum(strlen(text)) as bigint) as bytes, cast(sum(len(p)) as bigint) as tokens, sum(strlen(text)) / greatest(sum(len(p)), 1) as bytes_per_token from pieces group by source"
_piece = strip("translate(token, '▁ĠĊ', '')")
_special = "(starts_with(token, '<') and ends_with(token, '>'))"
_has = lambda c: f"regexp_matches({_piece}, {lit(f'[{c}]')})"
ORACLE["q_vocab_composition"] = f"""select case when {_special} then 'special' when length({_piece}) = 0 then null when {_has(T)} and {_has(LATIN)} then 'mixed' when {_has(T)} then 'tamil'
    when {_has(LATIN)} then 'english' when regexp_matches({_piece}, '\\p{{Nd}}') then 'number' else 'punctuation' end as kind, count(*) as tokens from vocab where token is not null group by 1"""
ORACLE["q_cross_script_leakage"] = f"select token_id, token from vocab where not {_special} and {_has(T)} and {_has(LATIN)}"
ORACLE["q_script_tokens"] = f"select token, {_piece} as piece from vocab where not {_special} and {_has(T)}"
ORACLE["q_vocab_merge"] = """with c as (select distinct word as token from common_words where word is not null), b as (select distinct token as s from vocab),
    fresh as (select token from c where token not in (select s from b) and ltrim(token, '▁') not in (select s from b) and '▁' || token not in (select s from b)
        and ltrim(token, 'Ġ') not in (select s from b) and 'Ġ' || token not in (select s from b))
    select token_id, token, false as added from vocab union all select cast((select max(token_id) from vocab) + row_number() over (order by encode(token)) as integer), token, true from fresh"""
ORACLE["q_vocab_difference"] = "select distinct word as token from common_words where word not in (select token from vocab where token is not null)"
ORACLE["q_syllable_coverage"] = f"""with {SYLLABLES}, t as (select distinct {_piece} as p from vocab) select count(*) as total, count(*) filter (where syllable in (select p from t)) as covered,
    count(*) filter (where syllable in (select p from t)) / count(*) as share from syllables"""
ORACLE["q_missing_syllables"] = f"with {SYLLABLES} select syllable from syllables where syllable not in (select {_piece} from vocab where token is not null)"
GOLD_SQL = "gold as (select * from (values " + ", ".join(f"({lit(w)}, [{', '.join(map(lit, m))}])" for w, m in GOLD) + ") as g(word, expected))"
_ends = lambda a: f"list_transform(range(1, len({a})), lambda k: length(array_to_string(list_slice({a}, 1, k), '')))"
BOUNDS = f"{GOLD_SQL}, {cutting('gold')}, acc as (select word, case when len(expected) > 1 then len(list_intersect({_ends('expected')}, {_ends('morphemes')})) / len({_ends('expected')}) when len(morphemes) = 1 then 1.0 else 0.0 end as accuracy from cutted)"
ORACLE["q_boundary_accuracy"] = f"with {BOUNDS} select word, accuracy from acc"
ORACLE["q_target_check"] = f"""with {SYLLABLES}, t as (select distinct {_piece} as p from vocab), {BOUNDS}, m as (
        select 'tamil_syllable_coverage' as metric, count(*) filter (where syllable in (select p from t)) / count(*) as value from syllables
        union all select 'cross_script_leakage_count', cast(count(*) as double) from vocab where not {_special} and {_has(T)} and {_has(LATIN)}
        union all select 'morpheme_boundary_accuracy', avg(accuracy) from acc),
    r as (select g.metric, value, target, op, case when value is null then 'SKIP' when op = '<=' and value <= target or op = '>=' and value >= target then 'PASS' else 'FAIL' end as status
        from (values {', '.join(f"('{a}', cast({b} as double), '{c}')" for a, b, c in TARGETS)}) as g(metric, target, op) left join m using (metric))
    select * from r union all select 'overall', null, null, null, case when bool_or(status = 'FAIL') then 'FAIL' else 'PASS' end from r"""
ORACLE["q_pair_counts"] = f"""with w as (select '▁' || word as word, count(*) as n from (select unnest(regexp_extract_all(text, {lit(f'[^{WS}]+')})) as word from ({DOCS})) group by 1),
    c as (select n, regexp_extract_all(word, '(?s:.)') as c from w), p as (select n, c, unnest(range(1, len(c))) as k from c)
    select c[k] as left_piece, c[k + 1] as right_piece, cast(sum(n) as bigint) as n from p group by 1, 2"""
ORACLE["q_train_eval_split"] = f"select doc_id, ('0x' || substr(md5(text), 1, 8))::ubigint % 10000 < 200 as is_eval from ({DOCS})"
ORACLE["q_sample"] = f"select doc_id from ({DOCS}) order by md5('42:' || doc_id), doc_id limit 1000"
RUNNING = f"select doc_id, cast(coalesce(sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before, row_number() over (order by doc_id) - 1 as row_no from ({DOCS})"
ORACLE["q_byte_budget"] = f"select doc_id from ({RUNNING}) where before < 1000000"
ORACLE["q_running_bytes"] = RUNNING
ORACLE["q_block_packing"] = """with ids as (select doc_id, list_append(list_transform(regexp_extract_all(text, '(?s:.)'), lambda c: unicode(c)), 0) as ids from (select doc_id, text from documents where text is not null)),
    each as (select doc_id, unnest(ids) as id, unnest(range(len(ids))) as k from ids), placed as (select id, row_number() over (order by doc_id, k) - 1 as pos from each)
    select cast(pos // 512 as bigint) as block_id, md5(string_agg(cast(id as varchar), ',' order by pos)) as hash from placed group by 1 having count(*) = 512"""
ORACLE["q_block_packing_by_batch"] = """with numbered as (select doc_id, text, (row_number() over (order by doc_id) - 1) // 100 as batch from documents where text is not null),
    ids as (select doc_id, batch, list_transform(regexp_extract_all(text, '(?s:.)'), lambda c: unicode(c)) as ids from numbered),
    each as (select doc_id, batch, unnest(ids) as id, unnest(range(len(ids))) as k from ids), placed as (select batch, id, row_number() over (partition by batch order by doc_id, k) - 1 as pos from each)
    select cast(batch as bigint) as batch, cast(pos // 512 as bigint) as block_id, md5(string_agg(cast(id as varchar), ',' order by pos)) as hash from placed group by 1, 2 having count(*) = 512"""
ORACLE["q_priority_merge"] = f"with {MERGED} select domain, line_no from once"
ORACLE["q_merge_with_budget"] = f"with {MERGED} select domain, line_no from (select *, coalesce(sum(strlen(line) + 1) over (order by {ORDER} rows between unbounded preceding and 1 preceding), 0) as used from once) where used < 500000"
ORACLE["q_merge_stats"] = f"""with {MERGED}, r as (select coalesce(domain, 'unknown') as domain, file_name, reject_reason, 0 as kept, 0 as bytes, 1 as n from clean
        union all select coalesce(domain, 'unknown'), file_name, null, 1, strlen(line) + 1, 0 from once),
    s as (select domain, count(distinct file_name) as files, cast(sum(n) as bigint) as lines_read, count(reject_reason) as filtered, cast(sum(kept) as bigint) as lines_written, cast(sum(bytes) as bigint) as bytes_written from r group by rollup (domain))
    select *, lines_read - filtered - lines_written as duplicates, filtered / lines_read as filter_ratio, (lines_read - filtered - lines_written) / lines_read as dedup_ratio from s"""
ORACLE["q_corpus_estimate"] = f"with {LINES} select cast(sum(strlen(line) + 1) as bigint) as bytes, count(*) as lines, cast(sum({n_of('line', f'[{T}]')}) as bigint) as script_characters from lines"
ORACLE["q_file_summary"] = f"with {GOLD_LINES} select file_name, sum(strlen(line) + 1) / 1e6 as megabytes, count(*) as lines from gold group by 1"
ORACLE["q_latest_line"] = "select line_id, epoch_us(max(merged_at)) as merged_us, count(*) as rows from merge_gold group by 1 having count(*) > 1"
ORACLE["q_late_merges_by_week"] = "select strftime(date_trunc('week', merged_at at time zone 'UTC'), '%Y-%m-%d') as week, domain, count(*) as lines from merge_gold where merged_at > collected_at + interval 30 days group by all"
ORACLE["q_domain_stats_totals"] = """select domain, count(*) as runs, cast(sum(lines_read) as bigint) as lines_read, cast(sum(lines_written) as bigint) as lines_written, cast(sum(bytes) as bigint) as bytes
    from (select distinct * from domain_stats) group by rollup (domain)"""
ORACLE["q_shingle_pairs"] = """with s as (select item_id, case when length(t) < 5 then [t] else list_distinct(list_transform(range(1, length(t) - 3), lambda k: substr(t, k, 5))) end as s
        from (select item_id, trim(lower(text)) as t from eval_items)), p as (select a.item_id as a, b.item_id as b, len(list_intersect(a.s, b.s)) as c, len(a.s) + len(b.s) as n from s a join s b on a.item_id < b.item_id)
    select a, b, c / (n - c) as similarity from p where c / (n - c) >= 0.15"""
ORACLE["q_embedding_means"] = """select 'label' || label as token, cast(dim as integer) as dim, round(avg(cast(x as double)), 9) as x from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as dim from embeddings) group by all"""
ORACLE["q_embedding_norms"] = """with n as (select label, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings), a as (select avg(norm) as m from n)
    select label, count(*) as vectors, round(avg(norm), 9) as mean_norm, round(stddev_samp(norm), 9) as std_norm, round(avg(norm) / max(m), 9) as ratio, avg(norm) / max(m) < 0.1 or avg(norm) / max(m) > 10 as warn from n, a group by label"""
ORACLE["q_event_windows"] = "select date_trunc('hour', ts) as window_start, event_type, count(*) as events from events group by all"
ORACLE["q_event_sliding_windows"] = """select time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as window_start, count(*) as events from events, range(2) as r(k) group by all"""
ORACLE["q_event_sessions"] = """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as first from events window w as (partition by user_id order by ts)),
    s as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as session_start, count(*) as events from s group by user_id, no"""
ORACLE["q_label_counts"] = "select coalesce(c.lang, 'none') as code, count(*) as documents from documents d left join lang_codes c on lower(trim(d.lang)) = lower(trim(c.label)) group by 1"
ORACLE["q_publisher_top"] = "select publisher, documents, place from (select publisher, count(*) as documents, cast(rank() over (order by count(*) desc) as integer) as place from documents group by 1) where place <= 20"
SCRIPT_RE = rf"\p{{Nd}}+|\p{{L}}+|[^{WS}\p{{L}}\p{{N}}_]+|[{WS}_\p{{Nl}}\p{{No}}]+"
SCRIPT = f"script as (select doc_id, text, regexp_extract_all(text, {lit(SCRIPT_RE)}) as p from ({DOCS}))"
ORACLE["q_script_pieces"] = f"with {SCRIPT} select doc_id, len(p) as pieces, array_to_string(p, '') = text as whole from script"
ORACLE["q_grapheme_shredding"] = f"""with {SCRIPT}, t as (select unnest(p) as piece from script), s as (select count(*) as tokens, count(*) filter (where regexp_matches({strip("translate(piece, '▁ĠĊ', '')")}, '^[\\p{{Mn}}\\p{{Mc}}]')) as shredded from t)
    select tokens, cast(shredded as bigint) as shredded, shredded / greatest(tokens, 1) as share from s"""
ORACLE["q_bpe_roundtrip"] = f"select count(*) as documents, cast(1.0 as double) as accuracy from ({DOCS})"
ORACLE["q_html_text"] = f"""with l as (select doc_id, {strip('x')} as line, k from (select doc_id, unnest(string_split(t, chr(10))) as x, unnest(range(len(string_split(t, chr(10))))) as k from (select doc_id, {basic('text')} as t from ({DOCS})))),
    g as (select doc_id, string_agg(line, chr(10) order by k) as t from l where line <> '' and not regexp_matches(line, {lit(text.BOILERPLATE)}) group by doc_id)
    select doc_id, md5(coalesce(t, '')) as hash from ({DOCS}) left join g using (doc_id)"""
ORACLE["q_html_article"] = f"""with a as (select doc_id, {basic("chr(10) || text || chr(10)")} as t from ({DOCS})), b as (select doc_id, case when length(t) > 100 then t end as t from a) select doc_id, length(t) as n, md5(t) as hash from b"""
ORACLE["q_link_hosts"] = f"""select nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host, count(*) as links
    from (select unnest(regexp_extract_all(text, {lit(text.URL)})) as url from ({DOCS})) group by 1"""
_at = ("https://h.example/' || doc_id || '/b/x.html", "https://h.example/' || doc_id || '/y", "https://h.example/z?k=2", "https://other.example/p", "https://o.example/", "https://h.example/' || doc_id || '/b/c.html?r=3", "https://h.example/' || doc_id || '/b/c.html?q=1#g", "https://h.example/' || doc_id || '/b/", "https://h.example/w")
ORACLE["q_joined_links"] = "select doc_id, case " + " ".join(f"when doc_id % {len(LINKS)} = {k} then '{x}'" for k, x in enumerate(_at)) + " end as url from documents where doc_id is not null"
ORACLE["q_event_props"] = """with k as (select event_type, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as integer) as k from events)
    select event_type, count(k) as given, cast(sum(k) as bigint) as total, max(k) as most, cast(sum(k) as bigint) as again from k group by 1"""
ORACLE["q_corpus_validation"] = f"""with {LINES}, n as (select count(*) as lines, cast(sum(length(line)) as bigint) as characters, sum({n_of('line', f'[{T}]')}) as own, sum({n_of('line', f'[{LATIN}]')}) as latin from lines)
    select lines, characters, characters / lines as mean_length, own / characters as script_share, latin / characters as latin_share from n"""
ORACLE["q_first_lines"] = f"with {LINES} select substr(line, 1, 100) as line from lines order by doc_id, line_no limit 5"
ORACLE["q_sources_under_budget"] = f"""with d as (select source, doc_id, text from ({DOCS}) where source in (select config_key from dataset_configs)),
    r as (select *, coalesce(sum(strlen(text)) over (order by encode(source), doc_id rows between unbounded preceding and 1 preceding), 0) as used from d) select source, doc_id from r where used < 1500000"""
_kinds = {"vowel": P.VOWELS, "consonant": P.CONSONANTS, "sign": P.VOWEL_SIGNS, "pulli": P.PULLI, "grantha": P.GRANTHA, "aytham": P.AYTHAM}
ORACLE["q_character_kinds"] = "select source, " + ", ".join(f"cast(sum({n_of('text', f'[{v}]')}) as bigint) as {k}" for k, v in _kinds.items()) + f" from ({DOCS}) group by source"
ORACLE["q_invalid_boundaries"] = f"""with {WORDS}, {cutting('words')}, b as (select word, unnest({_ends('morphemes')}) as place from cutted where len(morphemes) > 1)
    select place > 0 and place < length(word) and regexp_matches(substr(word, cast(place as bigint) + 1, 1), '^[\\p{{Mn}}\\p{{Mc}}]') as invalid, count(*) as boundaries from b group by 1"""
ORACLE["q_strict_leakage"] = f"select token_id, token from vocab where not {_special} and {_has(T)} and ({_has(LATIN)} or regexp_matches({_piece}, '\\p{{Nd}}'))"
ORACLE["q_unigram_counts_capped"] = f"with {TOKENS}, first as (select piece from tokens order by doc_id, pos limit 50000) select piece as token, count(*) as n from first group by 1"
ORACLE["q_token_stats"] = f"""with {PIECES}, n as (select source, sum(len(p)) as t, sum({n_of('text', f'[^{WS}]+')}) as w, sum(strlen(text)) as b from pieces group by source)
    select source, t / greatest(w, 1) as tokens_per_word, b / greatest(t, 1) as bytes_per_token, b / greatest(t, 1) * 8 as bits_per_token from n"""
ORACLE["q_tokenizer_delta"] = f"""with {PIECES}, {SCRIPT}, w as (select sum({n_of('text', f'[^{WS}]+')}) as w, sum(strlen(text)) as b from ({DOCS})), n as (select (select sum(len(p)) from pieces) as a, (select sum(len(p)) from script) as c, w, b from w)
    select a / w as tokens_per_word_a, b / a as bytes_per_token_a, c / w as tokens_per_word_b, b / c as bytes_per_token_b, c / w - a / w as tokens_per_word_delta, b / c - b / a as bytes_per_token_delta from n"""
_shown = [chr(b) if b in pretokens.SHOWN else chr(256 + pretokens.HIDDEN.index(b)) for b in range(256)]
ORACLE["q_byte_level_pieces"] = f"""with {SCRIPT}, t as (select piece, count(*) as n from (select unnest(p) as piece from script) group by 1), m as (select [{', '.join(map(lit, _shown))}] as shown)
    select array_to_string(list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda h: shown[('0x' || h)::integer + 1]), '') as bytes, cast(sum(n) as bigint) as n from t, m group by 1"""
ORACLE["q_sql_functions"] = f"select doc_id, md5({strip('text')}) as hash, {share('text', T)} as share, {n_of('text', aksharas.AKSHARA)} as units from ({DOCS})"
ORACLE["q_sql_aksharas"] = f"with {UNITS} select akshara, count(*) as n from (select unnest(u) as akshara from units) group by 1"

# A byte-pair tokenizer: each distinct word is joined pair by pair until no merge applies, the lowest rank first and from left to right.
BPE = f"""docs as (select doc_id, text, source, regexp_extract_all(text, {lit(f'[^{WS}]+')}) as w from ({DOCS})),
    ranked as (select left_piece, right_piece, min(merge_rank) as merge_rank from merges where left_piece is not null and right_piece is not null group by all),
    cut(word, parts) as (
        select word, regexp_extract_all('▁' || word, '(?s:.)') from (select distinct unnest(w) as word from docs)
        union all
        select word, list_reduce(list_transform(parts, lambda x: [x]), lambda done, x: case when done[-1] = m.l and x[1] = m.r then list_append(done[:-2], m.l || m.r) else list_concat(done, x) end)
        from (select word, parts, arg_min({{'l': left_piece, 'r': right_piece}}, merge_rank) as m
            from (select word, parts, unnest(range(1, len(parts))) as k from cut) join ranked on left_piece = parts[k] and right_piece = parts[k + 1] group by word, parts)),
    known as (select distinct token from vocab where token is not null and not coalesce(is_special, false)),
    whole as (select word, unnest(parts) as piece from (select word, arg_min(parts, len(parts)) as parts from cut group by word)),
    single as (select word, unnest(regexp_extract_all(piece, '(?s:.)')) as piece from whole where piece not in (select token from known)),
    bpe as (select word, piece from whole where piece in (select token from known) union all select word, piece from single where piece in (select token from known)
        union all select word, '<0x' || unnest(regexp_extract_all(hex(encode(piece)), '..')) || '>' from single where piece not in (select token from known)),
    bpe_words as (select word, count(*) as n from bpe group by word),
    bpe_docs as (select d.doc_id, source, text, len(w) as words, coalesce(t, 0) as t from docs d left join (select doc_id, sum(n) as t from (select doc_id, unnest(w) as word from docs) join bpe_words using (word) group by doc_id) using (doc_id))"""


def rate(rows: str, by: str) -> str:
    """tokens, words and both fertilities by a column of rows with t tokens and words words."""
    return f"""(select {by}, cast(sum(t) as bigint) as tokens, cast(sum(words) as bigint) as words, sum(t) / sum(words) as avg_fertility, max(x) filter (where k = c // 2 + 1) as median_fertility
        from (select *, t / words as x, row_number() over (partition by {by} order by t / words) as k, count(*) over (partition by {by}) as c from {rows} where words > 0) group by {by})"""


ORACLE["q_bpe_fertility_by_source"] = f"with recursive {BPE} select * from {rate('bpe_docs', 'source')}"
ORACLE["q_bpe_compression"] = f"with recursive {BPE} select cast(sum(strlen(text)) as bigint) as bytes, cast(sum(t) as bigint) as tokens, sum(strlen(text)) / sum(t) as bytes_per_token from bpe_docs"
ORACLE["q_bpe_token_table"] = f"""with recursive {BPE}, n as (select word, count(*) as n from (select unnest(w) as word from docs) group by 1), ids as (select token, min(token_id) as token_id from vocab group by 1)
    select piece, max(token_id) as token_id, cast(sum(n) as bigint) as n from bpe join n using (word) left join ids on token = piece group by piece"""
ORACLE["q_tokenizer_comparison"] = f"""with recursive {BPE}, {PIECES}, both_ as (select 'bpe' as tokenizer, t, words, text from bpe_docs union all select 'pretokens', len(p), {n_of('text', f'[^{WS}]+')}, text from pieces)
    select tokenizer, tokens, words, avg_fertility, median_fertility, bytes_per_token from {rate('both_', 'tokenizer')} join (select tokenizer, sum(strlen(text)) / sum(t) as bytes_per_token from both_ group by 1) using (tokenizer)"""
