"""Normalised form of a capture, volatile parts masked.

One token per line, except that an element holding text only stays on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import attribute, has_class
from tidemark.functions.text import any_of, blank, collapse
from tidemark.operators.tokens import NORMALISE_OPAQUE, element_nodes
from tidemark.rules import normalise as fixed


def asset_url(url: Column) -> Column:
    """Mask data URIs, build ids and content hashes; drop cache-buster parameters."""
    out = F.regexp_replace(url, fixed.BUILD_ID, "/_next/data/[BUILD_ID]/")
    out = F.regexp_replace(out, fixed.ASSET_HASH, "$1[HASH]$2")
    out = F.regexp_replace(out, fixed.CACHE_BUSTER, "")
    return F.when(url.startswith("data:"), "[DATA_URI]").otherwise(out)


def selected(rules: list[tuple], tag: Column, cls: Column, elem_id: Column, attrs: Column) -> Column:
    """Element matches any (tag, class, id, attribute) rule."""
    tests = []
    for want_tag, want_class, want_id, want_attr in rules:
        test = F.lit(True)
        if want_tag:
            test = test & (tag == want_tag)
        if want_class:
            test = test & has_class(cls, want_class)
        if want_id:
            test = test & F.coalesce(elem_id == want_id, F.lit(False))
        if want_attr:
            test = test & F.map_contains_key(attrs, want_attr)
        tests.append(test)
    return F.coalesce(any_of(tests), F.lit(False))


def normalised_attributes(tag: Column, attrs: Column, in_recommend: Column) -> Column:
    """Attribute map with secrets, trackers and rotating links masked."""
    has = lambda name: F.map_contains_key(attrs, name)
    src = asset_url(attribute(attrs, "src"))
    tiny = F.coalesce(
        attribute(attrs, "width").isin("0", "1") & attribute(attrs, "height").isin("0", "1"), F.lit(False)
    )
    tracker = F.coalesce(any_of([F.contains(src, F.lit(word)) for word in fixed.TRACKING_SOURCE]), F.lit(False))
    pixel = (tag == "img") & (tiny | tracker)
    relation = F.coalesce(attribute(attrs, "rel"), F.lit(""))
    preload = (tag == "link") & any_of([F.contains(relation, F.lit(word)) for word in fixed.PRELOAD_RELATION])
    hidden = (tag == "input") & F.coalesce(attribute(attrs, "type") == "hidden", F.lit(False))

    def value_of(name: Column, value: Column) -> Column:
        return (
            F.when((name == "value") & hidden, "[HIDDEN_VALUE]")
            .when((name == "src") & (tag == "img") & in_recommend, "[RECOMMEND_IMG]")
            .when((name == "src") & pixel, "[TRACKING_PIXEL]")
            .when((name == "href") & (tag == "a") & in_recommend, "[RECOMMEND_LINK]")
            .when((name == "href") & preload, "[PRELOAD_URL]")
            .when(name.isin("src", "href") & (value != ""), asset_url(value))
            .when(
                (name == "content") & (tag == "meta"),
                F.regexp_replace(value, fixed.COUNTED_NUMBER, "[NUM]"),
            )
            .otherwise(value)
        )

    def dropped(name: Column) -> Column:
        return name.startswith("on") | any_of([name.startswith(p) for p in fixed.DYNAMIC_ATTRIBUTES])

    kept = F.map_filter(attrs, lambda name, _: ~dropped(name))
    out = F.transform_values(kept, value_of)
    extra = F.create_map(F.lit("src"), F.lit("[TRACKING_PIXEL]"))
    return F.when((tag == "img") & tiny & ~has("src"), F.map_concat(out, extra)).otherwise(out)


def start_tag(tag: Column, attrs: Column) -> Column:
    """Start tag written from its attribute map."""
    quoted = F.transform(
        F.map_entries(attrs),
        lambda e: F.concat(
            F.lit(" "), e["key"], F.lit('="'),
            F.replace(F.replace(collapse(e["value"]), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'),
        ),
    )
    return F.concat(F.lit("<"), tag, F.array_join(quoted, ""), F.lit(">"))


def normalised_lines(
    captures: DataFrame,
    key: str = "capture_id",
    html: str = "html",
    excluded: list[tuple] | None = None,
) -> DataFrame:
    """One row per kept token: key, idx, line, leaf (continues the line before)."""
    rules = fixed.EXCLUDED if excluded is None else excluded
    element = F.col("attrs").isNotNull()
    described = lambda e: F.concat_ws(" ", e["cls"], F.coalesce(e["elem_id"], F.lit("")))
    areas = {
        "excluded": lambda e: selected(rules, e["tag"], e["cls"], e["elem_id"], e["attrs"]),
        "recommend": lambda e: F.map_contains_key(e["attrs"], "class") & described(e).rlike(fixed.RECOMMEND_SECTION),
        "kept_text": tuple(fixed.KEPT_TEXT_TAGS),
    }
    nodes = element_nodes(captures, key, html, NORMALISE_OPAQUE, levels=1, areas=areas, texts=(), whole=True)
    gone = element & selected(rules, F.col("tag"), F.col("cls"), F.col("elem_id"), F.col("attrs"))
    nodes = nodes.filter((F.col("kind") != "opaque") & (F.col("in_excluded") == 0) & ~F.coalesce(gone, F.lit(False)))
    parent_class = F.lower(F.coalesce(F.col("up_1.cls"), F.lit("")))
    kept = (
        (F.col("in_kept_text") > 0)
        | F.coalesce(F.col("up_1.role").isin(*fixed.KEPT_TEXT_ROLES), F.lit(False))
        | any_of([F.contains(parent_class, F.lit(word)) for word in fixed.KEPT_TEXT_CLASS])
    )
    noise = F.col("token").rlike("|".join(fixed.LISTING_NOISE))
    said = collapse(F.col("token"))
    line = (
        F.when(
            F.col("kind").isin("text", "comment"),
            F.when(~kept, "[TEXT]").when(~blank(F.col("token")) & noise, "[PROPERTY_TEXT]").otherwise(said),
        )
        .when(F.col("kind") == "close", F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
        .otherwise(
            start_tag(F.col("tag"), normalised_attributes(F.col("tag"), F.col("attrs"), F.col("in_recommend") > 0))
        )
    )
    return nodes.select(key, "idx", line.alias("line"), "leaf")


def normalise(
    captures: DataFrame,
    key: str = "capture_id",
    html: str = "html",
    excluded: list[tuple] | None = None,
) -> DataFrame:
    """One row per capture: norm_lines, norm_text, norm_length, dom_hash, norm_version."""
    lines = normalised_lines(captures, key, html, excluded)
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "leaf", "line"))),
        lambda x: F.concat(F.when(x["leaf"], "").otherwise("\n"), x["line"]),
    )
    pages = lines.groupBy(key).agg(F.ltrim(F.array_join(ordered, ""), F.lit("\n")).alias("norm_text"))
    return pages.select(
        key, F.split("norm_text", "\n").alias("norm_lines"), "norm_text", F.length("norm_text").alias("norm_length"),
        F.sha2("norm_text", 256).alias("dom_hash"), F.lit(fixed.NORM_VERSION).alias("norm_version"),
    )
