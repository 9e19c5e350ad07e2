"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_SPACE, document_key, map_batches, text_steps

LINES = 3


def line_windows(texts: DataFrame, lines: int = LINES) -> DataFrame:
    """``key, version, place, h1, h2``: 128-bit hashes of each run of ``lines`` lines with a word."""
    held = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{WORD_SPACE}]"))
    rows = texts.where("text is not null").select("key", "version", held.alias("held"))
    starts = F.when(F.size("held") >= lines, F.sequence(F.lit(1), F.size("held") - (lines - 1)))
    rows = rows.select("key", "version", F.posexplode_outer(F.transform(starts, lambda i: F.slice("held", i, lines))).alias("place", "run"))
    rows = rows.where("place is not null")
    return rows.select("key", "version", "place", F.xxhash64("run").alias("h1"), F.xxhash64(F.lit("second"), "run").alias("h2"))


def without_repeated_lines(docs: DataFrame, lines: int = LINES, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` and the ``carried`` columns: each text without lines of windows found earlier.

    A window is ``lines`` consecutive lines that hold a word (lines without one are passed
    over and always stay). It is removed if the same lines also stand in a document with a
    smaller ``doc_id``, or earlier in the same one; lines covered by such windows go, each
    once. ``text`` joins the other lines by line feeds; a text that loses nothing stays as it
    is, null too. A null ``doc_id`` comes before all others. Rows with one ``doc_id`` are
    versions of one document: equal rows leave each other alone. Other columns are not read.
    An empty table gives an empty result.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), document_key(F.col("doc_id")).alias("key"),
        F.xxhash64(F.col("text")).alias("version"), F.col("text").cast("string").alias("text"), *carried,
    )
    windows = line_windows(texts, lines)
    firsts = windows.groupBy("h1", "h2").agg(
        F.min(F.struct("key", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("h1", "h2", "first")
    later = windows.join(firsts, ["h1", "h2"]).where("key <> first.key or place <> first.place")
    places = later.groupBy("key", "version").agg(F.collect_list("place").alias("places"))
    joined = texts.join(places, ["key", "version"], "left").select("doc_id", "text", "places", *carried)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            n_lines, n_removed, out = [], [], []
            for text, found in zip(step.column("text").cast(pa.binary()).to_pylist(), step.column("places").to_pylist()):
                rows = [] if text is None else text.split(b"\n")
                n_lines.append(len(rows))
                n_removed.append(0)
                if found:
                    held = [i for i, line in enumerate(rows) if line.split()]
                    covered = np.zeros(len(held), bool)
                    for place in found:
                        covered[place : place + lines] = True
                    gone = {held[i] for i in np.flatnonzero(covered).tolist()}
                    n_removed[-1] = len(gone)
                    text = b"\n".join([line for i, line in enumerate(rows) if i not in gone])
                out.append(text)
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(out, pa.binary()).cast(pa.string()), *[step.column(c) for c in carried]],
                ["doc_id", "n_lines", "n_removed", "text", *carried],
            )

    schema = "doc_id long, n_lines long, n_removed long, text string"
    return map_batches(joined, run, ", ".join([schema, *(f"`{c}` {kind}" for c, kind in joined.dtypes if c in carried)]))
