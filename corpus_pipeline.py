"""From raw documents to token ids: five stages, each written and read again by its caller."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_windows, quality, sentencepiece_fst, simhash, tiling
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import checkpoint_folder, checkpointed, document_key, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ratio = quality.fit_ratio(docs, table(spark, sf_dir, "labels"))
    judged = quality.judged(docs.select(*COLUMNS), ratio).withColumn("_row", F.monotonically_increasing_id())
    # A filter on the verdict alone would be moved below the columns it is made of, and they
    # would be put into it over and over; it stays above a column of row numbers.
    return judged.where("kept and _row >= 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows found earlier; those left without a word go."""
    out = line_windows.without_repeated_lines(docs, carried=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select("doc_id", "text", "lang", "source", size)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest id, then hash of the row.

    Different rows of one id are decided apart. Rows without an id cannot be told apart by a
    decision and stay.
    """
    absent = [F.col(c).isNull() for c in COLUMNS]
    keys = [F.xxhash64(F.lit(seed), *COLUMNS, *absent).alias(name) for seed, name in ((0, "_h0"), (1, "_h1"))]
    rows = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_key"), *keys)
    prints = checkpointed(simhash.fingerprints(rows, ("_h0", "_h1")))
    # Only equal rows share all three; no struct for rows without an id, as it would name a class.
    order = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("_key"), "_h0", "_h1"))
    chosen = simhash.near_classes(prints, order).where("first is not null").select("first.*").distinct()
    first = rows.where("_key is not null").join(chosen, ["_key", "_h0", "_h1"], "left_semi").dropDuplicates(["_key", "_h0", "_h1"])
    return first.unionByName(rows.where("_key is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = tiling.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaked = found.select(document_key(F.col("doc_id")).alias("_key")).distinct()
    rows = docs.select(*COLUMNS, document_key(F.col("doc_id")).alias("_key"))
    return rows.join(leaked, "_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_pieces, decoded`` of every document."""
    return sentencepiece_fst.encode_texts(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: The quality model, the fingerprints and the encoding have no SQL; tests compare each stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
