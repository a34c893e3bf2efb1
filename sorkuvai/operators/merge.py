"""From lines of many sources to one corpus: quality, first wins, priorities, budgets, and what was read and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import line_reason
from ..functions.profiles import LATIN, TAMIL
from ..functions.text import UNTIDY, count, nfc, normalize_basic, tidied, ustrip
from .dedup import line_key
from .ordering import under_budget
from .storage import checkpointed

# The order of the domains; others follow.
PRIORITY = ("classical", "wiki", "legal", "news", "hf_datasets")
# Least share of script and least kept characters by kind of source.
THRESHOLDS = {"archive": (0.5, 100), "wikisource": (0.5, 50), "wiki": (0.45, 100), "news": (0.55, 200), "legal": (0.4, 100), "legal_hf": (0.5, 50), "hf_datasets": (0.6, 100)}


def priority(domain: Column) -> Column:
    out = F.lit(len(PRIORITY))
    for k, name in enumerate(PRIORITY):
        out = F.when(domain == name, k).otherwise(out)
    return out


def document_lines(documents: DataFrame) -> DataFrame:
    """source, doc_id, line_no, line of the lines that aren't empty."""
    each = documents.select("source", "doc_id", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("line_no", "line"))
    return each.where(F.length("line") > 0)


def judged(rows: DataFrame, **limits) -> DataFrame:
    """The lines normalised, with reject_reason (null if kept)."""
    rows = rows.withColumn("line", normalize_basic(F.col("line")))
    return rows.withColumn("reject_reason", line_reason(F.col("line"), **limits))


def quality_lines(rows: DataFrame, **limits) -> DataFrame:
    """The lines normalised, without the rejected ones and the null ones.

    Normalised and judged once a line, in an array that is exploded: a filter on reject_reason would be put below
    the projections, with all of normalising inside it, and again above them.
    """
    each = F.transform(F.array(nfc(F.col("line"))), lambda x: F.when(x.rlike(UNTIDY), tidied(x)).otherwise(ustrip(x)))
    each = F.transform(each, lambda x: F.struct(x.alias("line"), line_reason(x, **limits).alias("reason")))
    return rows.where("line is not null").withColumn("line", F.explode(F.filter(each, lambda m: m["reason"].isNull()))).withColumn("line", F.col("line.line"))


def thresholded(documents: DataFrame, kind: str = "domain") -> DataFrame:
    """Documents that pass their kind's thresholds, by least share of script and least characters; unknown kinds use hf_datasets'."""
    from ..functions.text import script_share

    table = F.create_map(*(F.lit(x) for k, (share, n) in THRESHOLDS.items() for x in (k, share)))
    sizes = F.create_map(*(F.lit(x) for k, (share, n) in THRESHOLDS.items() for x in (k, n)))
    share, n = (F.coalesce(F.get(F.array(m[F.col(kind)]), F.lit(0)), F.lit(THRESHOLDS["hf_datasets"][k])) for k, m in enumerate((table, sizes)))
    return documents.where((script_share(F.col("text")) >= share) & (F.length("text") > n))


def passes_language(delivered: Column, wanted: str) -> Column:
    """Rows of the wanted language and rows without a language."""
    return F.coalesce(delivered, F.lit("")).isin("", wanted)


def merged(lines: DataFrame, budget: int | None = None, text: bool = True, **limits) -> DataFrame:
    """domain, file_name, line_no, line: kept lines, each once, in the order of priority, up to a budget of bytes.

    lines: domain, file_name, line_no, line. Of equal lines that of the domain with the higher priority stays,
    then the first by file and number. The line that crosses the budget is in. Null lines take no part.
    Without text the result has no line, and none is shuffled once its key is known.
    """
    kept = quality_lines(lines, **limits).withColumns({"priority": priority(F.col("domain")), "bytes": F.octet_length("line") + 1})
    order, out = ["priority", "domain", "file_name", "line_no"], ["domain", "file_name", "line_no", *(["line"] if text else [])]
    # As first_wins, but that a key is never null here: looking for null ones would read all lines again.
    once = kept.groupBy(line_key(F.col("line"))).agg(F.min(F.struct(*order, "bytes", *(["line"] if text else []))).alias("r")).select("r.*")
    if budget is not None:
        once = under_budget(once, order, F.col("bytes"), budget)
    return once.select(*out)


def merge_stats(lines: DataFrame, **limits) -> DataFrame:
    """domain (null: all), files, lines_read, filtered, duplicates, lines_written, bytes_written, filter_ratio, dedup_ratio."""
    rows = judged(lines.where("line is not null"), **limits)
    # One pass over the lines: by file and key (null for rejected ones), so that copies are counted where they are read.
    key = F.when(F.col("reject_reason").isNull(), line_key(F.col("line")))
    place = F.struct(priority(F.col("domain")).alias("priority"), "domain", "file_name", "line_no", (F.octet_length("line") + 1).alias("bytes"))
    seen = checkpointed(rows.groupBy("domain", "file_name", key.alias("key")).agg(F.count("*").alias("n"), F.min(place).alias("first")))
    kept = seen.where("key is not null").groupBy("key").agg(F.min("first").alias("first")).groupBy("first.domain", "first.file_name").agg(F.count("*").alias("kept"), F.sum("first.bytes").alias("bytes"))
    read = seen.groupBy("domain", "file_name").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("bad"))
    both = read.join(kept, (read.domain.eqNullSafe(kept.domain)) & (read.file_name.eqNullSafe(kept.file_name)), "left").select(F.coalesce(read.domain, F.lit("unknown")).alias("domain"), read.file_name, "n", "bad", "kept", "bytes")
    total = both.rollup("domain").agg(
        F.countDistinct("file_name").alias("files"), F.sum("n").alias("lines_read"), F.sum("bad").alias("filtered"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("lines_written"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_written"),
    )
    total = total.withColumn("duplicates", F.col("lines_read") - F.col("filtered") - F.col("lines_written"))
    return total.withColumns({"filter_ratio": F.col("filtered") / F.col("lines_read"), "dedup_ratio": F.col("duplicates") / F.col("lines_read")})


def corpus_estimate(lines: DataFrame, inside: str) -> DataFrame:
    """bytes, lines, characters of the script over all lines."""
    return lines.agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count("*").alias("lines"), F.sum(F.regexp_count("line", F.lit(f"[{inside}]"))).alias("script_characters"))


def validation(lines: DataFrame, inside: str = TAMIL.letters) -> DataFrame:
    """lines, characters, mean_length, script_share and latin_share of the characters, over all lines."""
    n = lines.where("line is not null").select(F.length("line").alias("n"), count(F.col("line"), inside).alias("own"), count(F.col("line"), LATIN).alias("latin"))
    total = n.agg(F.count("*").alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"), F.sum("own").alias("own"), F.sum("latin").alias("latin"))
    share = lambda x: F.coalesce(F.col(x) / F.nullif("characters", F.lit(0)), F.lit(0.0))
    return total.select("lines", "characters", (F.col("characters") / F.greatest("lines", F.lit(1))).alias("mean_length"), share("own").alias("script_share"), share("latin").alias("latin_share"))


def first_lines(lines: DataFrame, order: list[str], n: int = 5, longest: int = 100) -> DataFrame:
    """line: the first n lines in the order, each cut at `longest` characters."""
    return lines.where("line is not null").orderBy(*order).limit(n).select(F.substring("line", 1, longest).alias("line"))


def sources_under_budget(documents: DataFrame, sources: list[str], budget: int) -> DataFrame:
    """The documents of the named sources, one source after the other and by doc_id, until their bytes fill the budget; the one that crosses it is the last."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return under_budget(documents.where(F.col("source").isin(*sources)).withColumn("_place", place), ["_place", "doc_id"], F.octet_length("text"), budget).drop("_place")


def file_summary(lines: DataFrame) -> DataFrame:
    """file_name, megabytes, lines."""
    return lines.groupBy("file_name").agg((F.sum(F.octet_length("line") + 1) / 1e6).alias("megabytes"), F.count("*").alias("lines"))


def kept_texts(documents: DataFrame, shortest: int = 50) -> DataFrame:
    """doc_id, text stripped, if longer than `shortest` characters."""
    return documents.select("doc_id", ustrip(F.col("text")).alias("text")).where(F.length("text") > shortest)
