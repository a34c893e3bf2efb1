"""The engine's functions by name in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import aksharas, profiles as P

AKSHARA_RULE = None


@F.udtf(returnType="pos int, akshara string")
class Aksharas:
    """A row for each akshara of a text; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        import regex

        global AKSHARA_RULE
        if AKSHARA_RULE is None:
            AKSHARA_RULE = regex.compile(aksharas.AKSHARA)
        yield from enumerate(AKSHARA_RULE.findall(text or ""))


def register(spark: SparkSession) -> None:
    """Makes line_key, script_share, akshara_count and the table function aksharas known to the session; all but the last stay in the JVM."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    letters = f"regexp_count(x, {quoted('[' + P.TAMIL.letters + ']')})"
    for name, kind, body in (
        ("line_key", "STRING", f"md5(regexp_replace(x, {quoted(f'^[{P.WS}]+|[{P.WS}]+' + chr(92) + 'z')}, ''))"),
        ("script_share", "DOUBLE", f"coalesce({letters} / nullif(regexp_count(x, {quoted(chr(92) + 'p{L}')}), 0), 0.0D)"),
        ("akshara_count", "INT", f"regexp_count(x, {quoted(aksharas.AKSHARA)})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("aksharas", Aksharas)
