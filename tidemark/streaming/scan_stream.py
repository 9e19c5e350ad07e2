"""Arriving captures and articles as streams with stored state.

The state is a set of tables under ``root``. Each micro-batch writes folders named by its
batch id and reads the others, so a replayed batch overwrites what it wrote before and
gives the same result. Snapshots are split by a hash of their page into ``BUCKETS`` folders; a
batch reads the buckets its pages fall into. ``merge_snapshots`` folds finished batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators import diff, press_pages, scoring
from tidemark.plans import page_scan


# Part of the stored layout: a root keeps the number it was started with.
BUCKETS = 256


def _folder(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def _stored_before(spark: SparkSession, root: str, table: str, batch_id: int, shape: DataFrame) -> DataFrame:
    """Rows of earlier batches; none on the first."""
    if batch_id == 0:
        return shape.limit(0).withColumn("batch_id", F.lit(0).cast("bigint"))
    return _read(spark, root, table).filter(F.col("batch_id") < batch_id)


def _write_bucketed(rows: DataFrame, path: str) -> None:
    """One folder a bucket; a bucket that outgrows a task is split over several."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _read_bucketed(spark: SparkSession, root: str, table: str, shape: StructType) -> DataFrame:
    return spark.read.schema(shape).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def _merged_upto(spark: SparkSession, root: str, batch_id: int) -> int:
    """Last batch of the newest whole merge that ends before ``batch_id``, -1 without one."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/merged/upto=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    ends = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    return max([e for e in ends if e < batch_id], default=-1)


def snapshots_before(spark: SparkSession, root: str, batch_id: int, shape: StructType, buckets: list[int] | None = None) -> DataFrame:
    """Snapshots of the batches before ``batch_id``: the newest merge and the batches after it, in ``buckets`` only."""
    wanted = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
    upto = _merged_upto(spark, root, batch_id)
    later = _read_bucketed(spark, root, "snapshots", StructType([*shape, StructField("batch_id", LongType())]))
    later = later.filter(wanted & (F.col("batch_id") > upto) & (F.col("batch_id") < batch_id)).drop("batch_id")
    if upto < 0:
        return later
    merged = _read_bucketed(spark, root, "merged", StructType([*shape, StructField("upto", LongType())]))
    return merged.filter(wanted & (F.col("upto") == upto)).drop("upto").unionByName(later)


def merge_snapshots(spark: SparkSession, root: str, upto: int) -> None:
    """Folds the batches up to ``upto`` into one table with one row per capture, its latest delivery.

    Later batches read it in place of the folded ones, whose folders stay. Call it between runs with
    a batch that is finished and will not be replayed. A merge that breaks off is not seen.
    """
    shape = StructType([f for f in _read(spark, root, "snapshots").schema if f.name != "batch_id"])
    rows = _current(snapshots_before(spark, root, upto + 1, shape))
    _write_bucketed(rows, f"{root}/merged/upto={upto}")


def _current(rows: DataFrame) -> DataFrame:
    """One row per capture: the one delivered by the latest batch."""
    return _first(rows, F.col("delivered").desc())


def _first(rows: DataFrame, order: Column) -> DataFrame:
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("capture_id").orderBy(order)))
    return ranked.filter("_n = 1").drop("_n")


def scan_batch(captures: DataFrame, batch_id: int, root: str, order: tuple[str, ...], segment: Column) -> None:
    """One micro-batch of the scan.

    The pages touched by the batch are paired anew from their stored narrow rows, so a
    capture that arrives out of order corrects the status of the one after it. Line
    diffs are worked out for the pairs that the batch takes part in. Several deliveries of
    one capture in one batch have no order; the one whose markup sorts last counts.
    """
    spark = captures.sparkSession
    keep = tuple(dict.fromkeys(["page_id", *[c for c in order if c != "capture_id"]]))
    bucket = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(BUCKETS)).cast("int")
    arriving = page_scan.snapshot_table(_first(captures, F.col("html").desc()), keep).withColumn(
        "delivered", F.lit(batch_id).cast("bigint")
    ).withColumn("bucket", bucket)
    _write_bucketed(arriving, _folder(root, "snapshots", batch_id))
    own = spark.read.schema(arriving.schema).parquet(_folder(root, "snapshots", batch_id))
    narrow = list(dict.fromkeys(["capture_id", "page_id", *order, "dom_hash", "norm_length", "norm_version", "delivered"]))
    touched = own.select("page_id").distinct()
    buckets = [r.bucket for r in own.select("bucket").distinct().collect()]
    earlier = snapshots_before(spark, root, batch_id, arriving.schema, buckets)
    # Captures without a page are a page of their own.
    history = earlier.alias("h").join(touched.alias("t"), F.expr("h.page_id <=> t.page_id"), "left_semi").select(*narrow)
    # A capture that is delivered again counts once, as the later delivery.
    rows = _current(history.unionByName(own.select(*narrow)))
    statuses = page_scan.capture_status(rows, order, segment)
    arrived = own.select("capture_id").distinct()
    concerned = statuses.join(arrived, "capture_id", "left_semi").unionByName(
        statuses.join(arrived.withColumnRenamed("capture_id", "_id"), F.col("prev.capture_id") == F.col("_id"), "left_semi")
    ).dropDuplicates(["capture_id"])
    concerned.select(
        "capture_id", "page_id", "status", "differs", "dom_hash", "norm_length", F.col("prev.capture_id").alias("prev_id")
    ).write.mode("overwrite").parquet(_folder(root, "statuses", batch_id))
    written = spark.read.parquet(_folder(root, "statuses", batch_id))
    pairs = written.filter("differs").select(
        F.col("capture_id").alias("pair_id"), F.col("prev_id").alias("old_id"), F.col("capture_id").alias("new_id")
    )
    asked = pairs.select(F.explode(F.array("old_id", "new_id")).alias("capture_id")).distinct()
    texts = ["capture_id", "delivered", "norm_lines"]
    lines = _current(earlier.select(*texts).unionByName(own.select(*texts)).join(asked, "capture_id", "left_semi"))
    page_scan.change_rows(diff.compute_diffs(pairs, lines)).write.mode("overwrite").parquet(_folder(root, "changes", batch_id))


def latest_statuses(spark: SparkSession, root: str) -> DataFrame:
    """Current status per capture: the one from the latest batch that worked it out."""
    rows = _read(spark, root, "statuses")
    columns = [c for c in rows.columns if c not in ("capture_id", "batch_id")]
    return rows.groupBy("capture_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_r")).select("capture_id", "_r.*")


def latest_changes(spark: SparkSession, root: str) -> DataFrame:
    """Current changes: those of the latest batch that worked out the status of their capture.

    A pair that no longer differs has a later status and no change beside it, so its older
    change does not show.
    """
    decided = _read(spark, root, "statuses").groupBy(F.col("capture_id").alias("pair_id")).agg(F.max("batch_id").alias("batch_id"))
    return _read(spark, root, "changes").join(decided, ["pair_id", "batch_id"]).drop("batch_id")


def start_scan(captures: DataFrame, root: str, order: tuple[str, ...], segment: Column) -> StreamingQuery:
    """Work through all arrived captures of a streaming table and stop."""
    return (
        captures.writeStream.foreachBatch(lambda batch, batch_id: scan_batch(batch, batch_id, root, order, segment))
        .option("checkpointLocation", f"{root}/_progress_scan").trigger(availableNow=True).start()
    )


def press_batch(found: DataFrame, batch_id: int, root: str, classify: dict, summarise: dict) -> None:
    """One micro-batch of found articles: dedup against the store, classify, summarise, keep."""
    spark = found.sparkSession
    stored = _stored_before(spark, root, "articles", batch_id, found.select("source_id", "article_url"))
    fresh = press_pages.new_articles(found, stored)
    rows = scoring.written_back(scoring.classify_articles(fresh, **classify), **summarise)
    rows.write.mode("overwrite").parquet(_folder(root, "articles", batch_id))


def stored_articles(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "articles")


def start_press(
    found: DataFrame, root: str, classify: dict | None = None, summarise: dict | None = None
) -> StreamingQuery:
    """Work through all arrived articles of a streaming table and stop."""
    return (
        found.writeStream.foreachBatch(
            lambda batch, batch_id: press_batch(batch, batch_id, root, classify or {}, summarise or {})
        )
        .option("checkpointLocation", f"{root}/_progress_press").trigger(availableNow=True).start()
    )
