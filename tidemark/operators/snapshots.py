"""Snapshot pairing, scan status, save-on-change and structure links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import with_last_two, with_previous

RENDER_RATIO = 0.1


def structure_hash(document: Column) -> Column:
    """SHA-256 of a nested document written with a fixed field order."""
    return F.sha2(F.to_json(document), 256)


def by_day(moment: str = "captured_at") -> Column:
    return F.date_trunc("day", moment)


def pair_snapshots(
    snapshots: DataFrame,
    page: str = "page_id",
    order: tuple[str, ...] = ("captured_at", "capture_id"),
    segment: Column | None = None,
) -> DataFrame:
    """Adds ``prev``: capture_id, dom_hash, norm_length, norm_version of the row stored before."""
    segment = by_day(order[0]) if segment is None else segment
    return with_previous(
        snapshots, [page], list(order), ["capture_id", "dom_hash", "norm_length", "norm_version"], segment
    )


def rendering_failure(new_length: Column, old_length: Column) -> Column:
    return (old_length > 0) & (new_length < old_length * RENDER_RATIO)


def comparison_status(paired: DataFrame) -> DataFrame:
    """Adds status and differs (the pair goes on to the line diff)."""
    prev = F.col("prev")
    same = prev["dom_hash"] == F.col("dom_hash")
    failed = rendering_failure(F.col("norm_length"), prev["norm_length"])
    reset = ~prev["norm_version"].eqNullSafe(F.col("norm_version"))
    status = (
        F.when(prev["capture_id"].isNull(), "first_scan")
        .when(same, "ok")
        .when(failed, "rendering_failure")
        .when(reset, "baseline_reset")
        .otherwise("ok")
    )
    return paired.withColumn("status", status).withColumn(
        "differs", F.coalesce(~same & ~failed & ~reset, F.lit(False))
    )


def scan_outcome(scans: DataFrame, compared: Column | None = None) -> DataFrame:
    """Adds status and url_rotated of whole scans.

    Columns read: page_type, http_status, error, expired, fallback_url, fallback_status,
    fallback_expired. ``compared`` is the status of a scan that reaches the comparison.
    """
    detail = F.col("page_type") == "detail"
    code = F.col("http_status")
    gone = detail & (code == 404)
    expired = detail & F.coalesce(F.col("expired"), F.lit(False))
    no_url = F.col("fallback_url").isNull()
    bad_code = F.coalesce(F.col("fallback_status") >= 400, F.lit(False))
    http = lambda c: F.concat(F.lit("http_"), c.cast("string"))
    status = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))
        .when(gone & no_url, F.concat(http(code), F.lit("_no_fallback")))
        .when(gone & bad_code, http(F.col("fallback_status")))
        .when((code >= 400) & ~gone, http(code))
        .when(~gone & expired & no_url, "expired_no_fallback")
        .when(expired & (bad_code | F.coalesce(F.col("fallback_expired"), F.lit(False))), "expired_no_valid_fallback")
        .otherwise(F.lit("ok") if compared is None else compared)
    )
    rotated = F.col("error").isNull() & ~no_url & (gone | (expired & (code < 400)))
    return scans.withColumn("status", status).withColumn("url_rotated", rotated)


def save_on_change(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    hash_column: str,
    segment: Column,
) -> DataFrame:
    """Rows whose hash differs from the row before of the same key (the first row stays)."""
    paired = with_previous(rows, keys, order, [hash_column], segment, "_before")
    return paired.filter(~F.col("_before")[hash_column].eqNullSafe(F.col(hash_column)) | F.col("_before").isNull()).drop(
        "_before"
    )


def link_structures(
    changes: DataFrame,
    structures: DataFrame,
    page: str = "page_id",
    changed_at: str = "detected_at",
    captured_at: str = "captured_at",
    segment: Column | None = None,
    within: str = "1 hour",
) -> DataFrame:
    """Structure before and after each change; both NULL when no structure was saved with it.

    ``structures`` hold saved (changed) structures only. The one saved at most ``within``
    before the change is the "after", the one saved before that is the "before". Both sides go
    through one exchange by page and segment and one ordering.
    """
    saved = structures.select(
        page, F.col(captured_at).alias("_at"), F.lit(0).alias("_side"), "structure_id",
        F.struct("structure_id", F.col(captured_at).alias("at")).alias("_saved"),
    )
    asked = changes.select(page, F.col(changed_at).alias("_at"), F.lit(1).alias("_side"), "change_id")
    both = saved.unionByName(asked, allowMissingColumns=True)
    segment = by_day("_at") if segment is None else segment
    known = with_last_two(both, [page], ["_at", "_side", "structure_id", "change_id"], F.col("_saved"), segment, ("_after", "_before"))
    fresh = F.col("_after.at") >= F.col("_at") - F.expr(f"INTERVAL {within}")
    return known.filter("_side = 1").select(
        "change_id", page, F.col("_at").alias(changed_at),
        F.when(fresh, F.col("_before.structure_id")).alias("structure_before_id"),
        F.when(fresh, F.col("_after.structure_id")).alias("structure_after_id"),
    )
