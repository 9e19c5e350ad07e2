"""Feeds, searches, latest-per-key reads and paging.

Per-key tops use ``row_number() <= n``, which Spark cuts down before its shuffle, so a
hot key sends n rows per task. Ties are broken by id everywhere.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import any_of, shorten
from tidemark.rules import scan as scan_rules

PAGE_SIZE = 20


def advice_of(advice: DataFrame) -> DataFrame:
    """Advice columns prefixed for a 0..1 join to changes."""
    return advice.select(
        "change_id", F.col("id").alias("advice_id"),
        *[F.col(c).alias(f"advice_{c}") for c in ("summary", "intent", "proposal", "priority", "expected_effect", "risks") if c in advice.columns],
    )


def with_advice(changes: DataFrame, advice: DataFrame, how: str = "left") -> DataFrame:
    return changes.join(advice_of(advice), changes["id"] == F.col("change_id"), how).drop("change_id")


def newest(rows: DataFrame, moment: str, count: int | None = None, tie: str = "id") -> DataFrame:
    """Newest first, rows without a moment before all others."""
    ordered = rows.orderBy(F.col(moment).desc_nulls_first(), tie)
    return ordered.limit(count) if count is not None else ordered


def recent_changes(changes: DataFrame, advice: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return newest(with_advice(changes.filter(F.col("detected_at") >= since), advice), "detected_at")


def change_detail(changes: DataFrame, advice: DataFrame, pages: DataFrame, services: DataFrame, change_id) -> DataFrame:
    """One change with advice, page and service; empty when there is none."""
    one = with_advice(changes.filter(F.col("id") == change_id), advice)
    page = pages.select(F.col("id").alias("page_id"), "url", "device", "service_id")
    service = services.select(F.col("id").alias("service_id"), F.col("display_name").alias("service_display_name"))
    return one.join(page, "page_id", "left").join(service, "service_id", "left")


def change_diff(changes: DataFrame, pages: DataFrame, change_id) -> DataFrame:
    page = pages.select(F.col("id").alias("page_id"), "url", "device")
    return changes.filter(F.col("id") == change_id).join(page, "page_id", "left").select(
        "id", "service_name", "page_type", "category", "summary", "diff_text", "detected_at", "url", "device"
    )


def latest_per_key(rows: DataFrame, keys: list[str], moment: str, count: int, tie: str = "id") -> DataFrame:
    """Newest ``count`` rows of every key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col(moment).desc_nulls_first(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def service_feed(changes: DataFrame, service: str | None = None, count: int = 20) -> DataFrame:
    """Category, time and summary of the newest changes: of one service, or of each."""
    if service is not None:
        rows = newest(changes.filter(F.col("service_name") == service), "detected_at", count)
        return rows.select("category", "detected_at", "summary")
    return latest_per_key(changes, ["service_name"], "detected_at", count).select(
        "service_name", "rank", "category", "detected_at", "summary"
    )


def search_changes(changes: DataFrame, category: str | None = None, keyword: str | None = None, count: int = 20) -> DataFrame:
    rows = changes
    if category:
        rows = rows.filter(F.col("category") == category)
    if keyword:
        rows = rows.filter(F.contains(F.lower("summary"), F.lit(keyword.lower())))
    return newest(rows, "detected_at", count)


def unanalysed_changes(changes: DataFrame, advice: DataFrame, count: int = 10, mark: str = scan_rules.PLACEHOLDER_MARK) -> DataFrame:
    rows = with_advice(changes, advice.filter(F.contains("proposal", F.lit(mark))), "inner")
    return newest(rows, "detected_at", count)


def without_placeholder(text: Column, mark: str = scan_rules.PLACEHOLDER_MARK) -> Column:
    """Advice text, NULL when empty or still the placeholder."""
    return F.when((text != "") & ~F.contains(text, F.lit(mark)), text)


def has_real_advice(*texts: Column) -> Column:
    return any_of([without_placeholder(t).isNotNull() for t in texts])


def filter_changes(
    changes: DataFrame,
    advice: DataFrame,
    service: str | None = None,
    category: str | None = None,
    reviewed: bool | None = None,
    priority: str = "not_low",
) -> DataFrame:
    """The change list. By default OTHER and low priority are left out, changes without advice stay."""
    rows = with_advice(changes, advice)
    if service:
        rows = rows.filter(F.col("service_name") == service)
    if not category:
        rows = rows.filter(F.col("category") != "OTHER")
    elif category != "all_category":
        rows = rows.filter(F.col("category") == category)
    if reviewed is not None:
        rows = rows.filter(F.col("is_reviewed") == reviewed)
    if priority == "not_low":
        rows = rows.filter((F.col("advice_priority") != "low") | F.col("advice_id").isNull())
    elif priority in ("high", "medium", "low"):
        rows = rows.filter(F.col("advice_priority") == priority)
    return rows


def page_of(rows: DataFrame, moment: str, page: int = 1, size: int = PAGE_SIZE, tie: str = "id") -> DataFrame:
    """One page, newest first, with total_count and total_pages from one scalar subquery."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    window = newest(rows, moment, None, tie).offset((max(1, page) - 1) * size).limit(size)
    return window.withColumn("total_count", total).withColumn(
        "total_pages", F.ceil(F.col("total_count") / F.lit(float(size))).cast("bigint")
    )


class ArgumentError(ValueError):
    """A read was asked for with an argument it cannot take."""


def _checked_day(name: str, text: str) -> date:
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            return date.fromisoformat(text)
        except ValueError:
            pass
    raise ArgumentError(f"parameter '{name}': invalid date format, expected YYYY-MM-DD")


def _known_source(sources: DataFrame, name: str) -> DataFrame:
    found = sources.filter((F.col("name") == name) & F.col("deleted_at").isNull()).select(F.col("id").alias("source_id"))
    if found.isEmpty():
        raise ArgumentError(f"parameter 'source_name': source '{name}' not found")
    return found


ARTICLE_COLUMNS = ["title", "article_url", "published_at", "relevance_category", "summary"]


def press_articles_between(
    articles: DataFrame,
    sources: DataFrame,
    source_name: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    category: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """Live articles by source, inclusive day range (UTC) and category; arguments are checked first."""
    first = _checked_day("date_from", date_from) if date_from is not None else None
    last = _checked_day("date_to", date_to) if date_to is not None else None
    if not 1 <= limit <= 100:
        raise ArgumentError("parameter 'limit': expected 1 to 100")
    rows = articles.filter(F.col("deleted_at").isNull())
    if source_name is not None:
        rows = rows.join(_known_source(sources, source_name), "source_id", "left_semi")
    if first:
        rows = rows.filter(F.col("published_at") >= F.lit(first).cast("timestamp"))
    if last:
        rows = rows.filter(F.col("published_at") < F.date_add(F.lit(last), 1).cast("timestamp"))
    if category:
        rows = rows.filter(F.col("relevance_category") == category)
    return newest(rows, "published_at", limit).select(*ARTICLE_COLUMNS)


def latest_press_articles(articles: DataFrame, sources: DataFrame, source_name: str | None = None, count: int = 10) -> DataFrame:
    """Newest articles of one source, or of each live source when no name is given."""
    if not 1 <= count <= 50:
        raise ArgumentError("parameter 'count': expected 1 to 50")
    rows = articles.filter(F.col("deleted_at").isNull())
    if source_name is not None:
        rows = rows.join(_known_source(sources, source_name), "source_id", "left_semi")
        return newest(rows, "published_at", count).select(*ARTICLE_COLUMNS)
    named = sources.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    top = latest_per_key(rows, ["source_id"], "published_at", count)
    return top.join(named, "source_id").select("source_name", "rank", *ARTICLE_COLUMNS)


def press_list(
    articles: DataFrame, sources: DataFrame, source_id=None, classification=None, relevance_category=None, page: int = 1
) -> DataFrame:
    """A page of live articles with their source name."""
    rows = articles.filter(F.col("deleted_at").isNull())
    for column, value in (
        ("source_id", source_id), ("classification", classification), ("relevance_category", relevance_category)
    ):
        if value:
            rows = rows.filter(F.col(column) == value)
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return newest(page_of(rows, "published_at", page).join(named, "source_id", "left"), "published_at")


def source_list(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("deleted_at").isNull()).select("id", "name", "url", "is_active", "created_at").orderBy(
        F.col("created_at").asc_nulls_last(), "id"
    )


def press_insights(
    insights: DataFrame, articles: DataFrame, sources: DataFrame, insight_type=None, priority=None, status=None,
    source_competitor=None, tag=None, limit: int | None = 20,
) -> DataFrame:
    """Insights with article and source; a tag must be in the tag list as it is."""
    rows = insights
    for column, value in (
        ("insight_type", insight_type), ("priority", priority), ("status", status), ("source_competitor", source_competitor)
    ):
        if value:
            rows = rows.filter(F.col(column) == value)
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if limit is not None:
        rows = newest(rows, "created_at", limit)
    article = articles.select(
        F.col("id").alias("article_id"), F.col("title").alias("article_title"), "article_url", "published_at", "source_id"
    )
    source = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return rows.join(article, "article_id").join(source, "source_id")


def latest_structures(structures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latest structure row per page."""
    return latest_per_key(structures, keys or ["page_id"], "captured_at", 1).drop("rank")


def latest_row(rows: DataFrame, keys: list[str], moment: str, columns: list[str], tie: str = "id") -> DataFrame:
    """Latest values per key by one aggregation, without a sort of the key."""
    top = F.max_by(F.struct(*columns), F.struct(moment, tie))
    return rows.groupBy(*keys).agg(top.alias("_r")).select(*keys, "_r.*")


def first_page(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The live page with the smallest id for every key."""
    live = pages.filter(F.col("is_active") & F.col("deleted_at").isNull())
    return live.groupBy(*keys).agg(F.min_by(F.struct("id", "url"), "id").alias("_p")).select(
        *keys, F.col("_p.id").alias("page_id"), F.col("_p.url").alias("url")
    )


SUMMARY_COLUMNS = ["captured_at", "summary", "cv_points"]


def page_structure(structures: DataFrame, pages: DataFrame, keys: list[str], depth: str = "summary") -> DataFrame:
    """Latest structure of the first live page of each key; ``full`` adds sections and forms."""
    columns = SUMMARY_COLUMNS + (["sections", "forms"] if depth == "full" else [])
    latest = latest_row(structures, ["page_id"], "captured_at", columns)
    return first_page(pages, keys).join(latest, "page_id")


def structure_history(structures: DataFrame, pages: DataFrame, keys: list[str], count: int = 10) -> DataFrame:
    rows = structures.select("id", "page_id", "captured_at", "summary", "hash")
    history = latest_per_key(rows, ["page_id"], "captured_at", count)
    return first_page(pages, keys).join(history, "page_id")


def advice_feed(advice: DataFrame, changes: DataFrame, pages: DataFrame, services: DataFrame, count: int = 30) -> DataFrame:
    """Newest advice with change, page and service; the top is taken before the joins."""
    top = newest(advice, "created_at", count)
    change = changes.select(F.col("id").alias("change_id"), "page_id", "category", "detected_at")
    page = pages.select(F.col("id").alias("page_id"), "url", "device", "service_id")
    service = services.select(F.col("id").alias("service_id"), F.col("display_name").alias("service_display_name"))
    return top.join(change, "change_id").join(page, "page_id", "left").join(service, "service_id", "left")


def services_with_page_counts(services: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.filter(F.col("deleted_at").isNull()).groupBy("service_id").agg(F.count(F.lit(1)).alias("page_count"))
    live = services.filter(F.col("deleted_at").isNull())
    return live.join(counts, live["id"] == counts["service_id"], "left").drop("service_id").withColumn(
        "page_count", F.coalesce("page_count", F.lit(0))
    ).orderBy(F.col("created_at").asc_nulls_last(), "id")


def pages_of_service(pages: DataFrame, service_id) -> DataFrame:
    rows = pages.filter((F.col("service_id") == service_id) & F.col("deleted_at").isNull())
    return rows.orderBy(F.col("created_at").asc_nulls_last(), "id")


def short_title(title: Column) -> Column:
    return shorten(title, 80)


short_url = urls.display_url
