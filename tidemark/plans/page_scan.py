"""The daily scan as one plan: captures to snapshots, statuses, changes and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.lineage import cut_lineage
from tidemark.operators import change_summary, diff, scoring, snapshots
from tidemark.operators.normalise import normalise


def snapshot_table(captures: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Normalised captures with the ``keep`` columns of the capture."""
    return captures.select("capture_id", *keep).join(normalise(captures), "capture_id")


def capture_status(stored: DataFrame, order: tuple[str, ...], segment: Column) -> DataFrame:
    """Status of every snapshot against the one before of its page; text columns are not touched."""
    narrow = stored.select(*dict.fromkeys(["capture_id", "page_id", *order, "dom_hash", "norm_length", "norm_version"]))
    return snapshots.comparison_status(snapshots.pair_snapshots(narrow, "page_id", order, segment))


def differing_pairs(statuses: DataFrame) -> DataFrame:
    return statuses.filter("differs").select(
        F.col("capture_id").alias("pair_id"), F.col("prev.capture_id").alias("old_id"), F.col("capture_id").alias("new_id"),
        F.col("prev.norm_length").alias("old_length"), F.col("norm_length").alias("new_length"),
    )


def page_changes(captures: DataFrame, order: tuple[str, ...] = ("captured_at", "capture_id"), segment: Column | None = None) -> DataFrame:
    """Changes of all captures: totals, changed lines, unified diff, summary, category, priority.

    The snapshots are read three times (pairing, and both sides of a pair), so they are
    written once.
    """
    keep = tuple(dict.fromkeys(["page_id", *[c for c in order if c != "capture_id"]]))
    stored = cut_lineage(snapshot_table(captures, keep))
    statuses = capture_status(stored, order, snapshots.by_day(order[0]) if segment is None else segment)
    pairs = differing_pairs(statuses)
    diffs = diff.compute_diffs(pairs.select("pair_id", "old_id", "new_id"), stored)
    texts = diff.unified_diffs(pairs, stored).select("pair_id", "unified_text")
    return change_rows(diffs).join(texts, "pair_id", "left")


def change_rows(diffs: DataFrame) -> DataFrame:
    """Summary, category and priority of diffs; only changed lines are scored."""
    rows = change_summary.summarise_changes(diffs)
    rows = rows.withColumn("_scored", F.concat_ws("\n", F.array_join("added", "\n"), F.array_join("removed", "\n")))
    rows = scoring.classify_changes(rows, "_scored").drop("_scored")
    return rows.withColumn("priority", scoring.priority_of(F.col("category")))
