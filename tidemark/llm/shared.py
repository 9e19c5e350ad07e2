"""What several operators of this package need: folders, lineage, batches of whole texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and the controls 9 to 13. Everything else belongs to a word.
WORD_SPACE = "\\x20\\x09-\\x0D"

#: Bytes of text that one step inside a task works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only a session on one machine may lack that setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-llm-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame as written to the checkpoint folder, its lineage cut."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a table at ``path`` below the checkpoint folder, with the sizes of its files.

    A checkpoint hands on estimated sizes, and those of joins multiply: after a dozen rounds
    of a loop the planner would work on numbers of a million digits.
    """
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that is not read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-source-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on every executor."""
    ship_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def map_frames(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with this package at hand on every executor."""
    ship_package(frame.sparkSession)
    return frame.mapInPandas(run, schema)


def document_key(doc_id: Column) -> Column:
    """Document order as a long without nulls: a null id comes before every other one."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


def document_id(key: Column) -> Column:
    """The id that ``document_key`` was made of."""
    return F.when(key != F.lit(-(2**63)), key)


def text_steps(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``STEP_BYTES`` of text each, at least one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > STEP_BYTES:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        yield batch.slice(start)
