"""Reading and writing the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import cut
from tidemark.operators.snapshots import by_day, save_on_change
from tidemark.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Stored captures: capture_id, page_id, url, device, http_status, captured_at, html."""
    return spark.read.schema(TABLES["capture"]).parquet(path)


def normalised_page_type(pages: DataFrame) -> DataFrame:
    """Page type ``listing`` is read as ``list``; was_listing tells which rows."""
    listing = F.col("page_type") == "listing"
    return pages.withColumn("was_listing", F.coalesce(listing, F.lit(False))).withColumn(
        "page_type", F.when(listing, "list").otherwise(F.col("page_type"))
    )


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_active") & F.col("deleted_at").isNull())


def active_pages(pages: DataFrame, services: DataFrame) -> DataFrame:
    """Active pages of active services, by service, page type and device.

    The join is left to the optimiser, which broadcasts the services while their size
    is below its limit.
    """
    services = live(services).select(
        F.col("id").alias("service_id"), F.col("name").alias("service_name"), F.col("display_name"), "category"
    )
    joined = live(pages).join(services, "service_id")
    return joined.select(
        F.col("id").alias("page_id"), "url", "page_type", "device", "service_id", "service_name", "display_name", "category"
    ).orderBy("service_name", "page_type", "device", "page_id")


def active_own_pages(own_pages: DataFrame) -> DataFrame:
    return live(own_pages).select(
        F.col("id").alias("own_page_id"), "name", "page_type", "url", "device", "category"
    ).orderBy("page_type", "device", "own_page_id")


def active_press_sources(sources: DataFrame) -> DataFrame:
    return live(sources).select("id", "name", "url", "created_at").orderBy(F.col("created_at").asc_nulls_last(), "id")


def pending_articles(articles: DataFrame, sources: DataFrame, source_id: str | None = None) -> DataFrame:
    """Articles waiting for classification with their source name, oldest first."""
    waiting = articles.filter((F.col("classification") == "pending") & F.col("deleted_at").isNull())
    if source_id is not None:
        waiting = waiting.filter(F.col("source_id") == source_id)
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return waiting.join(named, "source_id").select(
        "id", "source_id", "source_name", "title", "article_url", "published_at", "body_text", "created_at"
    ).orderBy(F.col("created_at").asc_nulls_last(), "id")


def undated_articles(articles: DataFrame) -> DataFrame:
    rows = articles.filter(F.col("published_at").isNull() & F.col("deleted_at").isNull())
    return rows.select("id", "source_id", "title", "article_url", "body_text", "created_at").orderBy(
        F.col("created_at").desc_nulls_first(), "id"
    )


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Every capture is stored, changed or not; files are split by capture date."""
    snapshots.withColumn("captured_on", F.to_date("captured_at")).write.mode("append").partitionBy(
        "captured_on"
    ).parquet(path)


def change_rows(changes: DataFrame, diff_chars: int | None = None) -> DataFrame:
    """Changes as stored: whole diff text (or its first ``diff_chars``), not yet reviewed."""
    return changes.withColumn("diff_text", cut(F.col("diff_text"), diff_chars)).withColumn("is_reviewed", F.lit(False))


def append_changes(changes: DataFrame, path: str) -> None:
    change_rows(changes).withColumn("detected_on", F.to_date("detected_at")).write.mode("append").partitionBy(
        "detected_on"
    ).parquet(path)


def changed_structures(arriving: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Arriving structures that differ from the one before of the same page, stored ones included."""
    rows = arriving.withColumn("_new", F.lit(True))
    if stored is not None:
        touched = arriving.select("page_id").distinct()
        latest = stored.join(touched, "page_id", "left_semi").groupBy("page_id").agg(
            F.max_by(F.struct("captured_at", "hash"), F.struct("captured_at", "id")).alias("_last")
        ).select("page_id", "_last.*", F.lit(False).alias("_new"))
        rows = rows.unionByName(latest, allowMissingColumns=True)
    kept = save_on_change(rows, ["page_id"], ["captured_at", "id"], "hash", by_day())
    return kept.filter("_new").drop("_new")


def append_structures(structures: DataFrame, path: str) -> None:
    structures.withColumn("captured_on", F.to_date("captured_at")).write.mode("append").partitionBy(
        "captured_on"
    ).parquet(path)


def unseeded(seed: DataFrame, stored: DataFrame, keys: list[str], live_only: bool = True) -> DataFrame:
    """Seed rows whose key is not there yet; deleted rows do not count unless asked."""
    known = stored.filter(F.col("deleted_at").isNull()) if live_only and "deleted_at" in stored.columns else stored
    return seed.join(known.select(*keys).distinct(), keys, "left_anti")


def write_version(table: DataFrame, root: str, version: int) -> str:
    """A new version of a table goes to a new folder; the one being read is never overwritten."""
    path = f"{root}/v{version:06d}"
    table.write.mode("errorifexists").parquet(path)
    return path
