"""URL expressions: host, path, resolution against a base, shortening."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import cut

ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def host(url: Column) -> Column:
    """Host in lower case, without user and port; NULL when there is none."""
    name = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def path_and_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1)


def _origin(base: Column) -> Column:
    return F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def _without_dots(full_path: Column) -> Column:
    """Fold '.' and '..' path segments."""
    parts = F.split(full_path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.array_append(done, part)),
    )
    joined = F.array_join(kept, "/")
    ends_in_dots = full_path.rlike(r"/\.\.?$")
    return F.when(ends_in_dots, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    origin = _origin(base)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    page_query = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    dotted = target.rlike(r"(^|/)\.\.?(/|$)")
    joined = F.concat(folder, target)
    return (
        F.when((href == "") | href.isNull(), base)
        .when(href.rlike(ABSOLUTE), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/") & ~dotted, F.concat(origin, href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(target), rest))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(page_query, href))
        .when(dotted, F.concat(origin, _without_dots(joined), rest))
        .otherwise(F.concat(origin, joined, rest))
    )


def valid_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def without_query(href: Column) -> Column:
    """Link as kept in a component: cut at '?', else whole."""
    return (
        F.when(href.isNull(), F.lit(""))
        .when(F.contains(href, F.lit("?")), F.substring_index(href, "?", 1))
        .otherwise(href)
    )


def display_url(url: Column) -> Column:
    """Host plus the first 40 characters of path and query."""
    tail = path_and_query(url)
    tail = F.when(tail == "", F.lit("/")).otherwise(tail)
    short = F.when(F.length(tail) > 40, F.concat(cut(tail, 40), F.lit("…"))).otherwise(tail)
    plain = F.when(F.length(url) > 60, F.concat(cut(url, 60), F.lit("…"))).otherwise(url)
    return F.when(host(url).isNotNull(), F.concat(host(url), short)).otherwise(plain)
