"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated to principal dimensions and sorted by their grid cells, cells of
epsilon's width on the leading dimensions, compared dimension by dimension. The sequence is
cut into intervals of ``CHUNK`` vectors, these are bundled level by level, and each interval
knows the least box around its vectors. Pairs of intervals are joined from the top down: a pair
whose boxes are more than epsilon apart is provably without a link and goes, any other is
replaced by the pairs of its parts. Inside the last pairs the same recursion goes on in memory
down to blocks, whose vectors are compared in double precision.

A rotation keeps distances, so a box on some of the dimensions and on the length of the rest
never parts two vectors that are near; the principal dimensions only decide how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import component_roots
from tidemark.llm.shared import checkpointed, map_batches

MIN_COSINE = 0.95
#: Vectors that the principal dimensions are fitted on, those with the smallest hashes.
FITTED = 4096
#: Principal dimensions in the sort order and in the boxes.
LEADING = 8
BOXED = 24
#: Vectors of one interval, intervals of one bundle, partners of an interval in one task's group.
CHUNK = 4096
FAN = 16
PARTNERS = 32
#: Vectors of one block of the recursion in memory.
BLOCK = 256
#: Rounding of sums in double precision stays far below this.
SLACK = 1e-9


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square leaves the range of doubles."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    scaled = _scaled(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones with zeros behind."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[row, : b - a] = values[a:b]
    return out


def principal_axes(classes: DataFrame, width: int, fitted: int = FITTED) -> np.ndarray:
    """Orthonormal columns, the directions of greatest variance of a bounded sample first."""
    rows = classes.orderBy("h0", "h1").limit(fitted).select("vector").toArrow()
    if not rows.num_rows:
        return np.eye(width)
    sample = _unit(_matrix(rows.column(0).combine_chunks(), width))
    return np.linalg.eigh(np.cov(sample, rowvar=False, bias=True).reshape(width, width))[1][:, ::-1].copy()


def _boxed(units: np.ndarray, axes: np.ndarray, boxed: int) -> np.ndarray:
    """Leading coordinates of each vector and the length of the rest."""
    lead = units @ axes[:, :boxed]
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))
    return np.column_stack([lead, rest])


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > (epsilon + SLACK) ** 2


class Block:
    """Consecutive vectors of the sequence with their boxes, halved on demand."""

    def __init__(self, data: dict[str, np.ndarray], first: int, last: int):
        self.data, self.first, self.last = data, first, last
        box = data["box"][first:last]
        self.low, self.high = box.min(axis=0), box.max(axis=0)
        self._halves: tuple[Block, Block] | None = None

    def halves(self) -> tuple[Block, Block]:
        if self._halves is None:
            middle = (self.first + self.last) // 2
            self._halves = Block(self.data, self.first, middle), Block(self.data, middle, self.last)
        return self._halves


def block_links(a: Block, b: Block, min_cosine: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked vectors, one of ``a`` and one of ``b`` each; every pair once."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is not b and _apart(a.low, a.high, b.low, b.high, epsilon):
            continue
        size_a, size_b = a.last - a.first, b.last - b.first
        if a is b and size_a > BLOCK:
            left, right = a.halves()
            stack += [(left, left), (left, right), (right, right)]
        elif max(size_a, size_b) > BLOCK:
            stack += [(half, b) for half in a.halves()] if size_a >= size_b else [(a, half) for half in b.halves()]
        else:
            x, y = a.data["unit"][a.first : a.last], b.data["unit"][b.first : b.last]
            i, j = np.nonzero(x @ y.T >= min_cosine - SLACK)
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                x, y = a.data["vector"][a.first + i], b.data["vector"][b.first + j]
                near = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= min_cosine
                if near.any():
                    yield a.first + i[near], b.first + j[near]


class Forest:
    """Spanning forest of links that come in batches: who is joined with whom, links that joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        path = []
        while (above := self.parent.get(node, node)) != node:
            path.append(node)
            node = above
        for below in path:
            self.parent[below] = node
        return node

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        new = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def _chunks(sequence: DataFrame, width: int, axes: np.ndarray, boxed: int) -> DataFrame:
    """One row per interval: its vectors one after another, how many copies of each, its box."""
    grouped = sequence.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "copies", "vector"))).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows").slice(k, 1).flatten()
                place, copies, vector = (rows.field(x) for x in range(3))
                vectors = _matrix(vector, width)
                box = _boxed(_unit(vectors), axes, boxed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("chunk").slice(k, 1), pa.array([place[0].as_py()], pa.int64()), pa.array([len(vectors)], pa.int32()),
                        pa.array([copies.to_numpy().tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()),
                        pa.array([box.min(axis=0).tolist()]), pa.array([box.max(axis=0).tolist()]),
                    ],
                    ["chunk", "first", "size", "copies", "vectors", "low", "high"],
                )

    schema = "chunk long, first long, size int, copies binary, vectors binary, low array<double>, high array<double>"
    return map_batches(grouped, run, schema)


def _near_intervals(chunks: DataFrame, epsilon: float, fan: int) -> DataFrame:
    """``a, b`` (``a <= b``): intervals whose boxes are at most epsilon apart, found from the top down."""
    levels = [checkpointed(chunks.select(F.col("chunk").alias("node"), "low", "high"))]
    top = levels[0].agg(F.max("node")).head()[0]
    while top:
        sides = levels[-1].select(F.expr(f"node div {fan}").alias("node"), F.posexplode(F.arrays_zip("low", "high")).alias("_k", "_side"))
        edges = sides.groupBy("node", "_k").agg(F.min("_side.low").alias("low"), F.max("_side.high").alias("high"))
        box = edges.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_k", "low", "high"))).alias("_box"))
        levels.append(checkpointed(box.select("node", F.col("_box.low").alias("low"), F.col("_box.high").alias("high"))))
        top //= fan
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    side = lambda level, name: level.select(
        F.expr(f"node div {fan}").alias(f"{name}_above"), F.col("node").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high")
    )
    below = lambda high, low: F.zip_with(high, low, lambda h, l: F.greatest(F.lit(0.0), l - h))  # noqa: E731, E741
    gaps = F.zip_with(below("a_high", "b_low"), below("b_high", "a_low"), lambda x, y: x * x + y * y)
    distance = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)
    for level in levels[-2::-1]:
        above = pairs.select(F.col("a").alias("a_above"), F.col("b").alias("b_above"))
        both = above.join(side(level, "a"), "a_above").join(side(level, "b"), "b_above")
        pairs = checkpointed(both.where((F.col("a") <= F.col("b")) & (distance <= (epsilon + SLACK) ** 2)).select("a", "b"))
    return pairs


def grid_links(classes: DataFrame, width: int, min_cosine: float = MIN_COSINE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The sequence (``place, h0, h1, first_id, copies``), and what its links give.

    The latter has rows ``a, b, n``: a link between two places that joined what was apart in
    its task, ``n`` null; or ``a`` and the number ``n`` of vectors it is linked with among the
    partners of its task, copies counted, ``b`` null.
    """
    epsilon = math.sqrt(2 - 2 * min_cosine)
    axes = principal_axes(classes, width)
    boxed = min(BOXED, width)
    keys = [f"c{k}" for k in range(min(LEADING, width))]

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.floor(_unit(_matrix(batch.column("vector"), width)) @ axes[:, : len(keys)] / epsilon).astype(np.int32)
            columns = [pa.array(lead[:, k]) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *keys])

    with_cells = map_batches(classes, cells, "h0 long, h1 long, vector array<double>, first_id long, copies long, " + ", ".join(f"{k} int" for k in keys))
    ordered = with_cells.orderBy(*keys, "h0", "h1").drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    ordered = checkpointed(ordered.select(F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"), *classes.columns))
    # One number a partition goes to the driver.
    sizes, start, starts = sorted(map(tuple, ordered.groupBy("_part").count().collect())), 0, []
    for part, size in sizes:
        starts.append((part, start))
        start += size
    offsets = ordered.sparkSession.createDataFrame(starts, "_part long, _start long")
    sequence = ordered.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_start") + F.col("_row")).drop("_part", "_start", "_row")
    chunks = checkpointed(_chunks(sequence.withColumn("chunk", F.expr(f"place div {chunk}")), width, axes, boxed))
    pairs = _near_intervals(chunks, epsilon, FAN)

    # One side of each pair owns it, in turn, so that all own about as many. The owner's own
    # vectors come first into each of its groups, then those of its partners, one at a time.
    odd = (F.col("a") + F.col("b")) % 2 == 1
    owned = pairs.select(F.when(odd, F.col("b")).otherwise(F.col("a")).alias("owner"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("chunk"))
    owned = owned.withColumn("slot", F.expr(f"chunk div {PARTNERS}"))
    own = owned.select("owner", "slot").distinct().select("owner", "slot", F.lit(0).alias("turn"), F.col("owner").alias("chunk"))
    visits = owned.select("owner", "slot", F.lit(1).alias("turn"), "chunk").unionByName(own)
    carried = chunks.select("chunk", "first", "size", "copies", "vectors")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = visits.join(carried, "chunk").repartition(tasks, "owner", "slot").sortWithinPartitions("owner", "slot", "turn", "chunk")

    def load(batch: pa.RecordBatch, k: int) -> Block:
        size = batch.column("size")[k].as_py()
        vectors = np.frombuffer(batch.column("vectors")[k].as_py(), np.float64).reshape(size, width)
        units = _unit(vectors)
        copies = np.frombuffer(batch.column("copies")[k].as_py(), np.int64)
        data = {"vector": _scaled(vectors), "unit": units, "box": _boxed(units, axes, boxed), "copies": copies, "place": np.arange(size) + batch.column("first")[k].as_py()}
        return Block(data, 0, size)

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = None
        for batch in batches:
            for k in range(batch.num_rows):
                block = load(batch, k)
                if not batch.column("turn")[k].as_py():
                    owner, forest, number = block, Forest(), batch.column("chunk")[k].as_py()
                    continue
                other = owner if batch.column("chunk")[k].as_py() == number else block
                mine, theirs = np.zeros(owner.last, np.int64), np.zeros(other.last, np.int64)
                edges: list[tuple[int, int]] = []
                for i, j in block_links(owner, other, min_cosine, epsilon):
                    np.add.at(mine, i, other.data["copies"][j])
                    np.add.at(theirs, j, owner.data["copies"][i])
                    edges += forest.join(owner.data["place"][i], other.data["place"][j])
                a = [e[0] for e in edges]
                b = [e[1] for e in edges]
                counts = [(owner, mine), (other, theirs)]
                places = np.concatenate([x.data["place"][n > 0] for x, n in counts])
                numbers = np.concatenate([n[n > 0] for _, n in counts])
                if len(places):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.array(a, np.int64), places])), pa.array([*b, *[None] * len(places)], pa.int64()),
                            pa.array([*[None] * len(a), *numbers.tolist()], pa.int64()),
                        ],
                        ["a", "b", "n"],
                    )

    return sequence.select("place", "h0", "h1", "first_id", "copies"), map_batches(dealt, links, "a long, b long, n long")


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Two rows are linked if the cosine of their vectors is ``min_cosine`` or more, labels
    never read. ``n_links`` counts the other rows a row is linked with, equal vectors among them;
    ``component_id`` is the smallest ``vec_id`` reachable, ``kept`` whether it is the row's own.
    A null, empty or zero vector and one with a null or non-finite component is linked with
    nothing. A shorter vector is read as one with zeros behind. Equal vectors are compared
    once, whatever their number. Repeated rows are rows of their own, linked with each other;
    a null ``vec_id`` names a component only if no other id is in it, and such a row is not
    kept. Other columns are not read. An empty table gives an empty result.
    """
    if not 0 < min_cosine < 1:
        raise ValueError("min_cosine lies between 0 and 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = _usable(F.col("vector"))
    keys = [F.when(usable, F.xxhash64(F.lit(seed), "vector")).alias(name) for seed, name in ((0, "h0"), (1, "h1"))]
    named = checkpointed(rows.where(usable).groupBy(*keys, "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    width = named.agg(F.max(F.size("vector"))).head()[0]
    alone = F.col("vec_id") == F.col("component_id")
    marked = rows.select("vec_id", *keys)
    if width is None:
        none = marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return none.withColumn("kept", F.coalesce(alone, F.lit(False)))
    sequence, found = grid_links(named, width, min_cosine, chunk)
    found = checkpointed(found)
    roots = component_roots(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "place")
    counts = found.where("n is not null").groupBy(F.col("a").alias("place")).agg(F.sum("n").alias("n"))
    placed = sequence.join(roots, "place", "left").join(counts, "place", "left").withColumn("root", F.coalesce("root", "place"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(smallest, "root").select("h0", "h1", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    joined = marked.join(classes, ["h0", "h1"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h0").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(alone, F.lit(False)))
