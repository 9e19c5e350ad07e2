"""The streams run to their end over the sample tables, in several drops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import markup_queries, sample
from tidemark.streaming import scan_stream

DROPS = 3


def work_folder(spark: SparkSession) -> str:
    """A new folder for stream state in the cluster's shared folder; only one machine may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared}/tidemark-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidemark-stream-")


def in_drops(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows in many files, mixed, and reads them back as a stream in about ``DROPS`` batches."""
    spark = rows.sparkSession
    files = max(DROPS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files).write.parquet(f"{root}/drops")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // DROPS)).parquet(f"{root}/drops")


def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark)
    captures = sample.captures(spark, sf_dir)
    stream = in_drops(captures, root)
    scan_stream.start_scan(stream, root, markup_queries.PAGE_ORDER, F.floor(F.col("capture_id") / 4096)).awaitTermination()
    rows = scan_stream.latest_statuses(spark, root)
    return rows.select("capture_id", "page_id", "status", "dom_hash", F.col("norm_length").cast("bigint"))


def incremental_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article once, whatever the batches in which its copies arrive, classified and summarised."""
    root = work_folder(spark)
    found = sample.articles(spark, sf_dir).select(
        "id", "source_id", F.substring("title", 1, 90).alias("title"), "article_url", F.col("title").alias("body_text"),
        F.col("created_at").alias("found_at"), F.col("id").alias("idx"),
    )
    stream = in_drops(found, root)
    options = {"relevant": markup_queries.SAMPLE_RELEVANT, "irrelevant": markup_queries.SAMPLE_IRRELEVANT}
    scan_stream.start_press(stream, root, options, {"ends": ".!?", "keywords": markup_queries.SAMPLE_RELEVANT}).awaitTermination()
    rows = scan_stream.stored_articles(spark, root)
    return rows.select(
        "source_id", "article_url", "classification", "relevance_category", F.round("confidence", 4).alias("confidence"),
        "needs_manual_review", "summary",
    )


QUERIES = {"incremental_status": incremental_status, "incremental_articles": incremental_articles}
ORACLES = {
    # The streams must end where the whole table read at once ends.
    "incremental_status": markup_queries.ORACLES["page_change_status"],
    "incremental_articles": f"""
WITH r AS ({markup_queries.ORACLES["relevance_class"]}), d AS (SELECT * FROM documents JOIN r ON id = doc_id),
m AS ({markup_queries.sql_summary("d", "relevance_category", markup_queries.SAMPLE_RELEVANT)})
SELECT DISTINCT source AS source_id, 'https://' || source || '.example.com/a/' || n_chars || '-' || md5(text) AS article_url,
 classification, relevance_category, confidence, needs_manual_review, CASE WHEN classification = 'relevant' AND summary <> '' THEN summary END AS summary
FROM d JOIN m USING (doc_id)""",
}
