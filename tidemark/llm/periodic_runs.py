"""Runs of repeated words: Lyndon roots extended both ways by suffix-tree LCE.

A run is a longest stretch of words with smallest period q. Under one of two orders, an order
of the words and its reverse, some longest Lyndon word inside the run is one period long and
starts in the run (the runs theorem). So the candidates of a text are, for every place i, the
stretches from i to the next smaller and to the next greater suffix. Each candidate is extended
to the right by the longest common extension of its two ends, read from Ukkonen's suffix tree
of the text, and to the left by that of the reversed text's tree. A common extension is the
depth of two leaves' lowest common ancestor, the minimum of a stretch of the Euler tour, found
in constant time from block minima.

A run of ``length >= max(24, 3 q)`` repeats each of its windows of 16 words q words on or
before, and these windows cover it. So the trees hold only the stretches of a document that
repeated 16-word windows cover, parted by symbols that occur once; nothing else can be in a run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, text_steps
from tidemark.llm.words import WordBatch, mix

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Entries of the Euler tour in one block of the range-minimum table.
BLOCK = 16


class SuffixTree:
    """Ukkonen's tree of integer symbols, the last of which occurs once.

    ``start`` and ``end`` bound the edge above each node; leaf ``k`` in order of creation is
    suffix ``k``. ``kids`` maps first symbols to nodes, None for leaves.
    """

    def __init__(self, symbols: list[int]):
        n = len(symbols)
        start, end, link, kids, leaves = [0], [0], [0], [{}], []
        node = edge = length = remainder = 0
        for i, symbol in enumerate(symbols):
            fresh = 0
            remainder += 1
            while remainder:
                if not length:
                    edge = i
                below = kids[node].get(symbols[edge])
                if below is None:
                    kids[node][symbols[edge]] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if fresh:
                        link[fresh] = node
                    fresh = 0
                else:
                    size = end[below] - start[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    at = start[below]
                    if symbols[at + length] == symbol:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(start)
                    kids[node][symbols[edge]] = inner
                    kids.append({symbol: inner + 1, symbols[at + length]: below})
                    kids.append(None)
                    leaves.append(inner + 1)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    start[below] = at + length
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                remainder -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remainder + 1
        self.start, self.end, self.kids, self.leaves = start, end, kids, leaves

    def tour(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """String depths along the Euler tour, each suffix's place in it, suffixes in order."""
        start, end, kids = self.start, self.end, self.kids
        suffix = dict(zip(self.leaves, range(len(self.leaves))))
        depths, place, order = [0], [0] * len(self.leaves), []
        stack = [(0, iter([k for _, k in sorted(kids[0].items())]))]
        while stack:
            depth, children = stack[-1]
            for child in children:
                below = depth + end[child] - start[child]
                if kids[child] is None:
                    k = suffix[child]
                    place[k] = len(depths)
                    order.append(k)
                    depths += (below, depth)
                else:
                    depths.append(below)
                    stack.append((below, iter([k for _, k in sorted(kids[child].items())])))
                    break
            else:
                stack.pop()
                if stack:
                    depths.append(stack[-1][0])
        return np.array(depths, np.int32), np.array(place, np.int64), order


class CommonExtension:
    """Longest common extension of two suffixes in constant time."""

    def __init__(self, symbols: list[int]):
        depths, self.place, self.order = SuffixTree(symbols).tour()
        blocks = -(-len(depths) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        grid = padded.reshape(blocks, BLOCK)
        self.depths = padded
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.before = np.minimum.accumulate(grid, axis=1).ravel()
        self.levels = [grid.min(axis=1)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of the suffixes from ``i`` and from ``j``; ``i`` and ``j`` differ."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        first, last = a // BLOCK, b // BLOCK
        out = np.minimum(self.after[a], self.before[b])
        near = first == last
        if near.any():
            x, y = a[near], b[near]
            low = self.depths[x]
            for step in range(1, BLOCK):
                low = np.minimum(low, self.depths[np.minimum(x + step, y)])
            out[near] = low
        gap = last - first - 1
        far = np.flatnonzero(gap > 0)
        if len(far):
            level = np.frexp(gap[far])[1] - 1
            for k in np.unique(level):
                at = far[level == k]
                table, step = self.levels[k], 1 << int(k)
                inner = np.minimum(table[first[at] + 1], table[last[at] - step])
                out[at] = np.minimum(out[at], inner)
        return out


def _next(rank: list[int], greater: bool) -> np.ndarray:
    """For each place the next one with a smaller (or greater) rank, -1 where there is none."""
    out, stack = [-1] * len(rank), []
    if greater:
        rank = [-r for r in rank]
    for j, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = j
        stack.append(j)
    return np.array(out, np.int64)


def symbol_runs(symbols: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period; the last symbol occurs once."""
    n = len(symbols)
    ahead, behind = CommonExtension(symbols), CommonExtension([*symbols[-2::-1], symbols[-1]])
    rank = np.empty(n, np.int64)
    rank[ahead.order] = np.arange(n)
    ranks, found = rank.tolist(), []
    for greater in (False, True):
        j = _next(ranks, greater)
        i = np.flatnonzero(j >= 0)
        j = j[i]
        right = ahead.of(i, j).astype(np.int64)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        # Place x of the text is place n - 2 - x of the reversed one.
        left[inner] = behind.of(n - 1 - i[inner], n - 1 - j[inner])
        q, length = j - i, right + left + j - i
        good = (length >= min_length) & (length >= min_exponent * q)
        found.append(np.stack([i - left, length, q], axis=1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(batch: WordBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges, each within one text, that windows found twice in that text cover."""
    hashes, whole = batch.runs(window)
    keys = mix(hashes ^ mix(batch.document[: len(hashes)].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(whole)
    order = at[np.argsort(keys[at], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(batch.starts) + 1, np.int64)
    np.add.at(change, order[twice], 1)
    np.add.at(change, order[twice] + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    new = np.ones(len(covered), bool)
    new[1:] = (covered[1:] != covered[:-1]) | (batch.document[1:] != batch.document[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(covered))
    held = covered[begins] if len(begins) else np.zeros(0, bool)
    return begins[held], ends[held]


def text_runs(
    texts: list[bytes | None], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, np.ndarray, bytes]]:
    """For each text its number of words, its runs, and the words outside repeats, space-joined."""
    batch = WordBatch(texts)
    # A run of length L has L - q >= L (e - 1) / e words that recur q further on.
    window = max(1, min_length * (min_exponent - 1) // min_exponent)
    begins, ends = _stretches(batch, window)
    long_enough = ends - begins >= min_length
    begins, ends = begins[long_enough], ends[long_enough]
    owner = batch.document[begins] if len(begins) else np.zeros(0, np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for d, text in enumerate(texts):
        a, b = int(batch.first[d]), int(batch.first[d + 1])
        runs = np.zeros((0, 3), np.int64)
        words = None
        if bounds[d] < bounds[d + 1]:
            words = text.split()
            known: dict[bytes, int] = {}
            symbols, places, single = [], [], -1
            for k in range(bounds[d], bounds[d + 1]):
                part = range(int(begins[k]) - a, int(ends[k]) - a)
                symbols += [known.setdefault(words[w], len(known)) for w in part]
                symbols.append(single)
                places += [*part, -1]
                single -= 1
            runs = symbol_runs(symbols, min_length, min_exponent)
            runs[:, 0] = np.array(places)[runs[:, 0]]
        if len(runs):
            gone = np.zeros(b - a + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            kept = b" ".join([words[w] for w in stay.tolist()])
        else:
            kept = b" ".join((text or b"").split())
        out.append((b - a, runs, kept))
    return out


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs`` (``doc_id``, ``text``).

    ``runs`` are all maximal stretches of words with smallest period q, ``min_length`` words
    and ``min_exponent`` periods at least, as ``start, length, period`` by start, then period.
    ``collapsed`` has the words outside all runs and of each run's first period, space-joined.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Repeated
    rows and repeated or null ids each get their own row. Texts are read whole; one text's
    trees are in memory at a time. Other columns are not read. An empty table gives an empty
    result.
    """
    if min_length < 1 or min_exponent < 2:
        raise ValueError("runs have a word and two periods at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            found = text_runs(step.column("text").cast(pa.binary()).to_pylist(), min_length, min_exponent)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in f[1].tolist()] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    step.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array(runs, run_type),
                    pa.array([f[2] for f in found], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return map_batches(rows, run, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length over period; of equal ones the first in the array."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a periodic tail in every tenth document, by the hash of its id.

    With h the CRC-32 of the decimal id and g = h div 10, documents of h mod 10 = 0 with n > 0
    words get from word a = g mod n on the words of a's first p = 1 + (n - a) div (3 + g mod 8)
    over and over; their words are then parted by one space. Documents without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.floor(h / 10).cast("long").alias("_g"), chosen.alias("_words"))
    n, g = F.size("_words").cast("long"), F.col("_g")
    rows = rows.withColumn("_a", F.when(n > 0, g % n))
    a = F.col("_a")
    rows = rows.withColumn("_p", F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long"))
    again = F.transform(F.sequence(a, n - 1), lambda i: F.get(F.col("_words"), (a + F.pmod(i - a, F.col("_p"))).cast("int")))
    tail = F.concat(F.slice(F.col("_words"), F.lit(1), a.cast("int")), again)
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
