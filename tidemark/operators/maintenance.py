"""Table maintenance: a table and a batch of edits give the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank
from tidemark.functions.urls import valid_http

# What inputs may hold, and the messages.
SERVICE_CATEGORIES = ["real_estate", "other"]
PAGE_TYPES = ["listing", "detail", "search", "form", "visit_booking"]
DEVICES = ["pc", "sp", "both"]
NAME_PATTERN = r"^[a-zA-Z0-9-]+$"
MESSAGES = {
    "name_missing": "サービス名を入力してください",
    "name_pattern": "サービス名は英数字とハイフンのみ使用できます",
    "name_long": "サービス名は50文字以内で入力してください",
    "display_missing": "表示名を入力してください",
    "display_long": "表示名は100文字以内で入力してください",
    "url_missing": "URLを入力してください",
    "url_invalid": "有効なURL形式で入力してください",
    "category": "カテゴリを選択してください",
    "page_type": "ページ種別を選択してください",
    "device": "デバイスを選択してください",
    "source_name": "名前は1〜50文字の英数字とハイフンのみ使用できます",
    "source_url": "有効なHTTPまたはHTTPS URLを入力してください",
}


def _error(field: str, message: Column, partial: bool, value: Column) -> Column:
    """Struct(field, message), NULL when fine; in partial rows an absent field is not looked at."""
    wrong = message.isNotNull() & (value.isNotNull() if partial else F.lit(True))
    return F.when(wrong, F.struct(F.lit(field).alias("field"), message.alias("message")))


def _report(rows: DataFrame, errors: list[Column]) -> DataFrame:
    return rows.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("valid", F.size("errors") == 0)


def _url_message(url: Column) -> Column:
    return F.when(blank(url), MESSAGES["url_missing"]).when(~valid_http(url), MESSAGES["url_invalid"])


def validate_services(rows: DataFrame, partial: bool = False) -> DataFrame:
    """Adds errors (field, message) and valid; columns name, display_name, base_url, category."""
    name, shown, url, category = (F.col(c) for c in ("name", "display_name", "base_url", "category"))
    name_message = (
        F.when(blank(name), MESSAGES["name_missing"]).when(~name.rlike(NAME_PATTERN), MESSAGES["name_pattern"])
        .when(F.length(name) > 50, MESSAGES["name_long"])
    )
    shown_message = F.when(blank(shown), MESSAGES["display_missing"]).when(F.length(shown) > 100, MESSAGES["display_long"])
    category_message = F.when(category.isNotNull() & ~category.isin(*SERVICE_CATEGORIES), MESSAGES["category"])
    return _report(
        rows,
        [
            _error("name", name_message, partial, name), _error("display_name", shown_message, partial, shown),
            _error("base_url", _url_message(url), partial, url), _error("category", category_message, partial, category),
        ],
    )


def validate_pages(rows: DataFrame, partial: bool = False) -> DataFrame:
    url, page_type, device = F.col("url"), F.col("page_type"), F.col("device")
    of = lambda value, allowed, key: F.when(F.coalesce(~value.isin(*allowed), F.lit(True)), MESSAGES[key])
    return _report(
        rows,
        [
            _error("url", _url_message(url), partial, url),
            _error("page_type", of(page_type, PAGE_TYPES, "page_type"), partial, page_type),
            _error("device", of(device, DEVICES, "device"), partial, device),
        ],
    )


def validate_press_sources(rows: DataFrame, partial: bool = False) -> DataFrame:
    name, url = F.col("name"), F.col("url")
    good_name = F.coalesce(name.rlike(r"^[a-zA-Z0-9-]{1,50}$"), F.lit(False))
    return _report(
        rows,
        [
            _error("name", F.when(~good_name, MESSAGES["source_name"]), partial, name),
            _error("url", F.when(blank(url) | ~valid_http(url), MESSAGES["source_url"]), partial, url),
        ],
    )


def conflicts(edits: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Edits whose value another live row already has (the row's own id does not count)."""
    live = stored.filter(F.col("deleted_at").isNull() & F.col(column).isNotNull())
    # Per value at most two holders matter: its smallest and its largest id.
    held = live.groupBy(column).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    return edits.join(held, column).filter((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))).drop("_low", "_high")


def duplicated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def expand_devices(pages: DataFrame) -> DataFrame:
    """``both`` becomes a pc and an sp row."""
    each = F.when(F.col("device") == "both", F.array(F.lit("pc"), F.lit("sp"))).otherwise(F.array(F.col("device")))
    return pages.withColumn("device", F.explode(each))


def latest_edits(edits: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...] = ("edited_at", "edit_no")) -> DataFrame:
    """Edits reduced to one row per key: the latest supplied value of each column."""
    moment = F.struct(*order)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), moment)).alias(c) for c in columns]
    return edits.groupBy(*keys).agg(*latest, F.max(order[0]).alias(order[0]))


def upsert(base: DataFrame, edits: DataFrame, keys: list[str], columns: list[str], order: tuple[str, ...] = ("edited_at", "edit_no")) -> DataFrame:
    """One row per key; supplied values replace stored ones, absent ones keep them."""
    new = latest_edits(edits, keys, columns, order).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, keys, "full_outer")
    rest = [c for c in base.columns if c not in keys and c not in columns]
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns], *rest)


def partial_update(base: DataFrame, edits: DataFrame, columns: list[str], key: str = "id", order: tuple[str, ...] = ("edited_at", "edit_no")) -> tuple[DataFrame, DataFrame]:
    """(next version, edits of unknown ids). Only supplied columns change."""
    new = latest_edits(edits, [key], columns, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    out = joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])
    return out, edits.join(base.select(key), key, "left_anti")


def append_with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rejects)."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def toggle_reviewed(changes: DataFrame, toggles: DataFrame, key: str = "id") -> DataFrame:
    """is_reviewed turned once per toggle: an odd number flips it."""
    odd = toggles.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
    joined = changes.join(odd, key, "left")
    flipped = F.coalesce("_odd", F.lit(False)) != F.col("is_reviewed")
    return joined.select(*[flipped.alias(c) if c == "is_reviewed" else F.col(c) for c in changes.columns])


def soft_delete(rows: DataFrame, deletions: DataFrame, key: str = "id") -> DataFrame:
    """deleted_at set from deletions (key, deleted_at) where it is not set yet."""
    first = deletions.groupBy(key).agg(F.min("deleted_at").alias("_at"))
    joined = rows.join(first, key, "left")
    return joined.select(*[F.coalesce("deleted_at", "_at").alias(c) if c == "deleted_at" else F.col(c) for c in rows.columns])


def soft_delete_services(services: DataFrame, pages: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services and, with them, their pages. Already deleted services delete nothing more."""
    live = services.filter(F.col("deleted_at").isNull()).select("id")
    effective = deletions.join(live, "id", "left_semi")
    of_pages = effective.withColumnRenamed("id", "service_id")
    return soft_delete(services, effective), soft_delete(pages, of_pages, "service_id")


def noise(changes: DataFrame, advice: DataFrame, priority: str | None = None, summary_contains: str | None = None, before=None) -> DataFrame:
    """Changes to purge: by advice priority, advice text and time of detection."""
    rows = changes
    if before is not None:
        rows = rows.filter(F.col("detected_at") < F.lit(before).cast("timestamp"))
    if priority or summary_contains:
        meant = advice
        if priority:
            meant = meant.filter(F.col("priority") == priority)
        if summary_contains:
            meant = meant.filter(F.contains("summary", F.lit(summary_contains)))
        rows = rows.join(meant.select(F.col("change_id").alias("id")), "id", "left_semi")
    return rows


def purge_noise(changes: DataFrame, advice: DataFrame, **what) -> tuple[DataFrame, DataFrame]:
    """(changes, advice) without the noise."""
    gone = noise(changes, advice, **what).select("id")
    return changes.join(gone, "id", "left_anti"), advice.join(gone.withColumnRenamed("id", "change_id"), "change_id", "left_anti")


def purge_counts(changes: DataFrame, advice: DataFrame, **what) -> DataFrame:
    """Dry run: matching_changes and matching_advice."""
    gone = noise(changes, advice, **what).select(F.col("id").alias("change_id"))
    n = F.count(F.lit(1)).cast("bigint")
    return gone.agg(n.alias("matching_changes")).withColumn(
        "matching_advice", advice.join(gone, "change_id", "left_semi").agg(n).scalar()
    )
