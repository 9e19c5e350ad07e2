"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most four bits differ in at most one bit in one of
four segments. The first segment is 26 bits. If two or more of the differing bits lie in it,
the other 38 bits hold at most two; these are cut into thirds, and without the third that
holds most of them at most one is left. Each two of the thirds make a segment. Every segment
is indexed once per bit with that bit wiped out: two segments with at most one differing bit
share such a variant. An equality join on variants finds all candidates; every candidate is
verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import component_roots
from tidemark.llm.shared import checkpointed, map_batches, map_frames, text_steps
from tidemark.llm.words import WordBatch

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Bit ranges of each segment; one of them differs by at most one bit if all differ by ``MAX_BITS``.
SEGMENTS = [[(0, 26)], [(26, 39), (39, 52)], [(26, 39), (52, 64)], [(39, 52), (52, 64)]]
#: Fingerprints of one bucket that one block compares with each other or with another chunk.
CHUNK = 512


def text_fingerprints(texts: list[bytes | None], words: int = SHINGLE_WORDS) -> np.ndarray:
    """One unsigned 64-bit SimHash per text; zero for a text without words."""
    batch = WordBatch([t.lower() if t else t for t in texts])
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        a, b = int(batch.first[i]), int(batch.first[i + 1])
        if a == b:
            continue
        joined = b" ".join(batch.buffer[batch.starts[a] : batch.ends[b - 1]].split())
        lengths = batch.ends[a:b] - batch.starts[a:b]
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        n = max(1, b - a - words + 1)
        pieces = zip(starts[:n].tolist(), ends[min(words, b - a) - 1 :].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in pieces), np.uint64, n)
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (fingerprint as a signed long) and the ``carried`` columns for every row of ``docs``."""
    names = ["doc_id", "fp", *carried]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            values = text_fingerprints(step.column("text").cast(pa.binary()).to_pylist())
            others = [step.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array(values.view(np.int64)), *others], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return map_batches(rows, run, "doc_id long, fp long" + kept)


def signatures(distinct: DataFrame) -> DataFrame:
    """``sig, fp``: one row per fingerprint, segment and bit of it, the segment without that bit."""
    variants = []
    for number, pieces in enumerate(SEGMENTS):
        part, size = F.lit(0).cast("long"), 0
        for low, high in pieces:
            piece = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            part, size = part.bitwiseOR(F.shiftleft(piece, size)), size + high - low
        for bit in range(size):
            variants.append(part.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((number * 64 + bit) << 40)))
    return distinct.select("fp", F.explode(F.array(*variants)).alias("sig"))


def _forest(keys: list[np.ndarray], fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal keys."""
    n = len(fp)
    label = np.arange(n)
    alive, lag, left, right = np.arange(n), 1, [], []
    while len(alive):
        alive = alive[alive + lag < n]
        for key in keys:
            alive = alive[key[alive] == key[alive + lag]]
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + lag]) <= max_bits]
        left.append(near)
        right.append(near + lag)
        lag += 1
    a, b = np.concatenate(left or [label[:0]]), np.concatenate(right or [label[:0]])
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    child = np.flatnonzero(label != np.arange(n))
    return label[child], child


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect all near-duplicates.

    Buckets of equal signatures are counted first. Members of a bucket are dealt into chunks
    of about ``chunk`` by hash, and a block holds two chunks, so that no task meets a whole
    large bucket. A block yields a spanning forest of its links, not all of its pairs.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the segments find links of at most four differing bits")
    # A fixed number of tasks: fingerprints are small beside their hundred variants, and the
    # adaptive planner would put them into a few tasks. A hash of another form than that of the
    # grouping before, as an equal one would be taken out.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = signatures(distinct.repartition(tasks, F.xxhash64("fp")))
    sizes = variants.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    # Spark sizes the exploded variants as hardly more than the fingerprints and would broadcast them.
    members = variants.hint("merge").join(sizes, "sig").select("sig", "fp", chunks.alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    members = members.withColumn("own", own).select(
        "sig", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    blocks = members.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    blocks = blocks.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in _with_end(frames):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
                last = rest.iloc[-1]
                open_rows = (rest["sig"] == last["sig"]) & (rest["i"] == last["i"]) & (rest["j"] == last["j"])
                cut = int(np.argmax(open_rows.to_numpy()))
                whole, rest = rest.iloc[:cut], rest.iloc[cut:]
            else:
                whole, rest = rest, None
            if whole is None or not len(whole):
                continue
            fp = whole["fp"].to_numpy().view(np.uint64)
            a, b = _forest([whole[c].to_numpy() for c in ("sig", "i", "j")], fp, max_bits)
            pairs = pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})
            yield pairs.drop_duplicates()

    return map_frames(blocks, run, "a long, b long")


def _with_end(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Rows are linked if their fingerprints differ in at most ``max_bits`` bits; components
    are the classes of that relation's closure, named by their smallest ``doc_id``. Null,
    empty and blank texts have fingerprint zero and are linked like any other. A null
    ``doc_id`` never names a class while another member has one. Repeated rows stay
    repeated. Other columns are not read. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs))
    classes = near_classes(prints, F.col("doc_id"), max_bits).withColumnRenamed("first", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_classes(prints: DataFrame, order: Column, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, first``: each fingerprint with the smallest ``order`` of the rows in its class."""
    distinct = prints.groupBy("fp").agg(F.min(order).alias("first_id"))
    roots = component_roots(links(distinct.select("fp"), max_bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("first"))
    return named.join(smallest, "root").select("fp", "first")
