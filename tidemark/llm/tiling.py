"""Benchmark decontamination by greedy string tiling.

Test items are cut into seeds of a few tokens. A document and an item whose shared seeds reach
the wanted coverage of the item are tiled: the longest token run common to both, found by running Karp-Rabin hashes, is marked in
both, again and again, until no run of seed length is left. The share of the item's tokens
under tiles is its coverage, which does not depend on the order of the passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, text_steps
from tidemark.llm.words import WordBatch

SEED_TOKENS = 5
COVERAGE = 0.8
#: Bytes of test text in one broadcast block; more text means more blocks, each a pass over
#: the documents.
BLOCK_BYTES = 8 << 20
_MOD = (1 << 61) - 1
_BASE = 1_000_003

#: ASCII letters in lower case, digits and bytes of other scripts as they are, the rest blank.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """Text in lower case with ASCII punctuation as blanks: what tokens are taken from."""
    return text.lower().encode().translate(_FOLD) if text else b""


def _rolling(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Position and Karp-Rabin hash of every run of ``size`` free tokens."""
    top = pow(_BASE, size - 1, _MOD)
    value = count = 0
    for i, token in enumerate(tokens):
        if not free[i]:
            value = count = 0
            continue
        if count == size:
            value = (value - tokens[i - size] * top) % _MOD
        else:
            count += 1
        value = (value * _BASE + token) % _MOD
        if count == size:
            yield i - size + 1, value


def _common(item: list[int], free_item: list[bool], text: list[int], free_text: list[bool], size: int) -> list[tuple[int, int]]:
    """Non-overlapping equal runs of ``size`` free tokens, leftmost first, each checked."""
    places: dict[int, list[int]] = {}
    for at, value in _rolling(item, free_item, size):
        places.setdefault(value, []).append(at)
    out, used, text_end = [], set(), 0
    for at, value in _rolling(text, free_text, size):
        if at < text_end or value not in places:
            continue
        for start in places[value]:
            if used.isdisjoint(range(start, start + size)) and item[start : start + size] == text[at : at + size]:
                used.update(range(start, start + size))
                out.append((start, at))
                text_end = at + size
                break
    return out


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, text start, size)`` of at least ``least`` tokens.

    ``text`` may hold several stretches parted by a token that the item does not have.
    """
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    high = min(len(item), len(text))
    while high >= least:
        # A common run of some size means one of every smaller size: search for the longest.
        low, found = least, []
        while low <= high:
            size = (low + high) // 2
            matches = _common(item, free_item, text, free_text, size)
            if matches:
                low, found, best = size + 1, matches, size
            else:
                high = size - 1
        if not found:
            break
        for start, at in found:
            free_item[start : start + best] = [False] * best
            free_text[at : at + best] = [False] * best
            out.append((start, at, best))
        high = best
    return out


@dataclass
class Block:
    """Items of one block: ids, token hashes, and by seed length the sorted seeds, their items and places."""

    ids: list[int]
    tokens: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], seed: int = SEED_TOKENS) -> Block:
        batch = WordBatch([folded(t) for _, t in items])
        hashes = batch.hashes
        tokens = [hashes[a:b] for a, b in zip(batch.first, batch.first[1:])]
        sizes = {i: min(seed, len(t)) for i, t in enumerate(tokens) if len(t)}
        seeds = {}
        for size in sorted(set(sizes.values())):
            runs, inside = batch.runs(size)
            owner = batch.document[: len(runs)]
            mine = np.array([sizes.get(i) == size for i in range(len(items))])
            keep = inside & mine[owner]
            order = np.argsort(runs[keep], kind="stable")
            places = np.flatnonzero(keep) - np.asarray(batch.first)[owner[keep]]
            seeds[size] = (runs[keep][order], owner[keep][order], places[order])
        return cls([i for i, _ in items], tokens, seeds)

    def promising(self, size: int, left: np.ndarray, right: np.ndarray, coverage: float) -> list[int]:
        """Items whose shared seeds reach ``coverage``; tiles lie on shared seeds, so others can't.

        ``left`` and ``right`` bound the entries of each different seed of one text, so an entry
        is looked at once a text, however often its seed stands there.
        """
        _, owners, places = self.seeds[size]
        lengths = right - left
        entries = np.repeat(left - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        item, place = owners[entries], places[entries]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        reach = np.full(len(item), size)
        same = item[1:] == item[:-1]
        reach[:-1][same] = np.minimum(size, np.diff(place)[same])
        seen, at = np.unique(item, return_index=True)
        covered = np.add.reduceat(reach, at)
        return [i for i, n in zip(seen.tolist(), covered.tolist()) if n >= coverage * len(self.tokens[i])]

    def matches(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """``text index, item index, covered tokens, tiles`` of pairs whose shared seeds reach ``coverage``."""
        batch = WordBatch([folded(t) for t in texts])
        hashes = batch.hashes
        for size, (keys, owners, _) in self.seeds.items():
            runs, inside = batch.runs(size)
            left = np.searchsorted(keys, runs)
            found = np.flatnonzero(inside & (keys[np.minimum(left, len(keys) - 1)] == runs))
            for part in np.split(found, np.flatnonzero(np.diff(batch.document[found])) + 1):
                if not len(part):
                    continue
                starts = np.unique(left[part])
                for item in self.promising(size, starts, np.searchsorted(keys, keys[starts], "right"), coverage):
                    stretch: list[int] = []
                    end = -1
                    for a in part[np.isin(runs[part], keys[owners == item])].tolist():
                        if a > end and end >= 0:
                            stretch.append(-1)
                        stretch += hashes[max(a, end) : a + size].tolist()
                        end = a + size
                    wanted = self.tokens[item].tolist()
                    tiled = tiles(wanted, stretch, min(SEED_TOKENS, len(wanted)))
                    if tiled:
                        yield int(batch.document[part[0]]), item, sum(n for _, _, n in tiled), len(tiled)


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-int(total) // block_bytes))
    for number in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        yield Block.of([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toLocalIterator()])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, item_tokens, covered_tokens, tiles, coverage``: documents that hold an item.

    One row per document and item whose tiles cover at least ``coverage`` of the item's
    tokens. Items of fewer than five tokens must occur whole; null items and items without a
    token match nothing. Null texts hold nothing. Repeated rows and null ids are reported row
    by row, items of one id and different texts each on their own. Other columns are not
    read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, item_tokens int, covered_tokens int, tiles int, coverage double"
    out = None
    for block in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for step in text_steps(batches):
                ids = step.column("doc_id").to_pylist()
                found = []
                for text, item, covered, count in block.matches(step.column("text").to_pylist(), coverage):
                    size = len(block.tokens[item])
                    if covered >= coverage * size:
                        found.append((ids[text], block.ids[item], size, covered, count, covered / size))
                columns = list(zip(*found)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    ["doc_id", "item_id", "item_tokens", "covered_tokens", "tiles", "coverage"],
                )

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out
