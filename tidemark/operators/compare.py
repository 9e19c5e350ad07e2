"""Rival pages against own pages: gaps, side-by-side rows, form comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reads import first_page, latest_row

GAP_PAGE_TYPES = ["detail", "list", "form"]


def _live(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("is_active") & F.col("deleted_at").isNull())


def cv_gaps(
    structures: DataFrame, rival_pages: DataFrame, own_structures: DataFrame, own_pages: DataFrame,
    page_types: list[str] | None = None, points: str = "cv_points",
) -> DataFrame:
    """Per page type and device: conversion types found on rivals but not on the own page.

    All rival pages count, of the own pages the one with the smallest id. Types are made
    distinct before they are listed; their number is that of the known kinds.
    """
    kinds = lambda s: latest_row(s, ["page_id"], "captured_at", [points]).select(
        "page_id", F.explode(F.array_distinct(F.transform(points, lambda p: p["type"]))).alias("kind")
    )
    wanted = F.col("page_type").isin(*(page_types or GAP_PAGE_TYPES))
    rival = _live(rival_pages).filter(wanted).select(F.col("id").alias("page_id"), "page_type", "device")
    own = first_page(own_pages.filter(wanted), ["page_type", "device"]).select("page_id", "page_type", "device")
    rival_kinds = rival.join(kinds(structures), "page_id").select("page_type", "device", "kind").distinct()
    own_kinds = own.join(kinds(own_structures), "page_id").select("page_type", "device", "kind").distinct()
    sides = rival_kinds.withColumn("side", F.lit(0)).unionByName(own_kinds.withColumn("side", F.lit(1)))
    listed = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("kind"))))
    out = sides.groupBy("page_type", "device").agg(listed(0).alias("rival_has"), listed(1).alias("own_has"))
    return out.withColumn("missing", F.array_except("rival_has", "own_has")).filter(F.size("missing") > 0)


def component_gaps(rival_components: DataFrame, own_components: DataFrame, keys: tuple[str, ...] = ("page_type", "type")) -> DataFrame:
    """Component kinds on rival pages that no own page of the page type has."""
    return rival_components.select(*keys).distinct().join(own_components.select(*keys).distinct(), list(keys), "left_anti")


def side_by_side(structures: DataFrame, rival_pages: DataFrame, own_structures: DataFrame, own_pages: DataFrame) -> DataFrame:
    """Latest structures of a rival page and the own page of the same type and device."""
    columns = ["summary", "cv_points", "forms"]
    keys = ["page_type", "device"]
    rival = first_page(rival_pages, ["service_id", *keys]).join(latest_row(structures, ["page_id"], "captured_at", columns), "page_id", "left")
    own = first_page(own_pages, keys).join(latest_row(own_structures, ["page_id"], "captured_at", columns), "page_id", "left")
    named = lambda side, frame, extra: frame.select(
        *extra, *keys, F.col("url").alias(f"{side}_url"), *[F.col(c).alias(f"{side}_{c}") for c in columns],
        F.coalesce(F.col("summary.component_count"), F.lit(0)).alias(f"{side}_component_count"),
    )
    both = named("rival", rival, ["service_id"]).join(named("own", own, []), keys, "full_outer")
    return both.filter(F.col("rival_summary").isNotNull() | F.col("own_summary").isNotNull())


def form_comparison(
    structures: DataFrame, rival_pages: DataFrame, own_structures: DataFrame, own_pages: DataFrame, device: str | None = None
) -> DataFrame:
    """Latest form rows of every service and of the own site, told apart by site_role."""
    of_device = lambda p: p.filter(F.col("page_type") == "form").filter(F.lit(True) if device is None else F.col("device") == device)  # noqa: E731,E501
    columns = ["captured_at", "forms", "cv_points"]
    rival = first_page(of_device(rival_pages), ["service_id", "device"]).join(
        latest_row(structures, ["page_id"], "captured_at", columns), "page_id", "left"
    ).withColumn("site_role", F.lit("rival"))
    own = first_page(of_device(own_pages), ["device"]).join(
        latest_row(own_structures, ["page_id"], "captured_at", columns), "page_id", "left"
    ).withColumn("site_role", F.lit("own"))
    return rival.unionByName(own, allowMissingColumns=True)
