"""Web addresses: their parts, and links put together with the page they stand on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def host(url: Column) -> Column:
    """The host in small letters, without user and port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _plain_path(path: Column) -> Column:
    """A path from the root without . and .. in it."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def joined(base: Column, link: Column) -> Column:
    """Where a link leads that stands on the page `base` (an absolute address); null if either is."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    whole = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^(.*/)", 1)
    own, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(SCHEME), link).when(link == "", base).when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("#"), F.concat(whole, link)).when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("/"), F.concat(site, _plain_path(own), rest)).otherwise(F.concat(site, _plain_path(F.concat(folder, own)), rest))
    )
