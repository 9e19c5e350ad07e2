"""Removal of word passages that already occur earlier in the corpus.

The corpus is its own reference. Its passages are dealt into shards such that equal windows
of words meet in the same shard: a window belongs to the run of words in it whose hash is
smallest (its anchor), and only anchors found at two places or more can belong to a repeated
window. In each shard passages are streamed, in document order, through a suffix automaton of
all earlier passages of the shard. Where the matching statistic reaches the window length,
the maximal matched span is marked. A task that has sent a passage marks its own later copies at
once, so that a group of copies is at most a row or two of each task in its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import document_id, document_key, map_batches, map_frames, text_steps
from tidemark.llm.words import WordBatch

WINDOW_WORDS = 20
ANCHOR_WORDS = 6
#: Places of an anchor up to which its passages go to one shard; beyond it, each window goes
#: to a shard by its own content, which spreads passages that many documents share.
SHARED_PLACES = 256


class SuffixAutomaton:
    """Suffix automaton over any hashable symbols, for several sequences one after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def _clone(self, p: int, q: int, symbol) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Iterable) -> None:
        """Adds a sequence; its substrings are then matched, but none across two sequences."""
        self.last = 0
        for symbol in sequence:
            self._extend(symbol)

    def _extend(self, symbol) -> None:
        p = self.last
        known = self.next[p].get(symbol)
        if known is not None:
            self.last = known if self.length[known] == self.length[p] + 1 else self._clone(p, known, symbol)
            return
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
        self.last = state

    def matching(self, sequence: Iterable) -> list[int]:
        """For each position, how many symbols ending there occur in what was added."""
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            out.append(matched)
        return out


def matched_spans(matching: list[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans (end exclusive) covered by matches of at least ``least`` symbols."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(matching, 1):
        if size >= least:
            start = end - size
            if spans and start <= spans[-1][1]:
                spans[-1] = (min(start, spans[-1][0]), end)
            else:
                spans.append((start, end))
    return spans


def _anchors(batch: WordBatch, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text: first word, anchor's first word, and the anchor hashes by word."""
    hashes, _ = batch.runs(anchor)
    n = max(0, len(batch.hashes) - window + 1)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    size = window - anchor + 1
    # Smallest hash and its leftmost place over `size` entries, by doubling.
    low, at, reach = hashes, np.arange(len(hashes)), 1
    while reach < size:
        by = min(reach, size - reach)
        right = low[by:] < low[: len(low) - by]
        low, at = np.where(right, low[by:], low[: len(low) - by]), np.where(right, at[by:], at[: len(at) - by])
        reach += by
    inside = np.flatnonzero(batch.document[:n] == batch.document[window - 1 :])
    return inside, at[inside], hashes


#: Least number of times that a step must show an anchor for its task to count it, and how many
#: anchors a task counts before it starts anew.
COUNTED_FROM = 4
COUNTED_ANCHORS = 100_000


def anchor_places(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``key, version, anchor, salt, place``: every run of words that is the anchor of a window.

    ``salt`` is zero for the first places of an anchor in a task. Once a task has sent more than
    ``SHARED_PLACES`` of them the anchor is known to be shared, and its further places carry
    salts that spread them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for step in text_steps(batches):
            batch = WordBatch(step.column("text").cast(pa.binary()).to_pylist())
            _, at, hashes = _anchors(batch, window, anchor)
            # Places do not decrease from window to window, so each anchor is one stretch.
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            row = batch.document[at]
            values, group, counts = np.unique(hashes[at], return_inverse=True, return_counts=True)
            rank = np.empty(len(at), np.int64)
            rank[np.argsort(group, kind="stable")] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            before = np.zeros(len(values), np.int64)
            for i in np.flatnonzero(counts >= COUNTED_FROM).tolist():
                before[i] = seen.get(value := int(values[i]), 0)
                seen[value] = int(before[i] + counts[i])
            if len(seen) > COUNTED_ANCHORS:
                seen.clear()
            rank += before[group]
            salt = np.where(rank > SHARED_PLACES, rank, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [step.column("key").take(pa.array(row)), step.column("version").take(pa.array(row)),
                 pa.array(hashes[at].view(np.int64)), pa.array(salt), pa.array((at - batch.first[row]).astype(np.int32))],
                ["key", "version", "anchor", "salt", "place"],
            )

    return map_batches(docs, run, "key long, version long, anchor long, salt int, place int")


#: Passages that a task remembers as already sent before it starts anew.
SENT_PASSAGES = 100_000


def passages(joined: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``shard, key, version, start, passage, spans``: words of the windows of repeated anchors.

    ``joined`` has ``key, version, packed, places`` with ``places`` an array of ``place, shared``.
    A task sends a passage with its text at the first place it meets and at every earlier one, so
    the first place of all is among those sent. Other places are known to be later ones: a text's
    are put together as ``spans``, in a row without ``passage`` and with a shard of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple[int, int, int]] = {}
        unpack = zstandard.ZstdDecompressor()
        for rows in text_steps(batches, "packed"):
            step = rows.filter(pc.is_valid(rows.column("places")))
            batch = WordBatch([unpack.decompress(t) if t else t for t in step.column("packed").to_pylist()])
            inside, at, hashes = _anchors(batch, window, anchor)
            mark = np.zeros(len(batch.starts) + 1, np.int8)
            for i, found in enumerate(step.column("places").to_pylist()):
                for p in found:
                    mark[batch.first[i] + p["place"]] = 2 if p["shared"] else 1
            kind = mark[at]
            begins = np.flatnonzero((kind > 0) & ((kind == 2) | (np.diff(at, prepend=-1) != 0)))
            ends = np.flatnonzero((kind > 0) & ((kind == 2) | (np.diff(at, append=-1) != 0)))
            first, last = inside[begins], inside[ends] + window
            texts = [batch.text(a, b) for a, b in zip(first.tolist(), last.tolist())]
            content = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            row = batch.document[first]
            start = (first - batch.first[row]).astype(np.int32)
            keys, versions = (step.column(c).to_numpy() for c in ("key", "version"))
            new, later = [], []
            for i, (c, place) in enumerate(zip(content, zip(keys[row].tolist(), start.tolist(), versions[row].tolist()))):
                known = sent.get(c)
                if known is None or place[:2] < known[:2] or (place[:2] == known[:2] and place != known):
                    sent[c] = place
                    new.append(i)
                elif place != known:
                    later.append(i)
            if len(sent) > SENT_PASSAGES:
                sent.clear()
            names = np.frombuffer(b"".join(content), np.int64)[::2]
            shard = np.where(kind[begins] == 2, names, hashes[at[begins]].view(np.int64))[new]
            # A text's later places follow each other by start: overlapping ones become one span.
            covered: dict[int, list[list[int]]] = {}
            length = last - first
            for i, a, n in zip(row[later].tolist(), start[later].tolist(), length[later].tolist()):
                spans = covered.setdefault(i, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], a + n)
                else:
                    spans.append([a, a + n])
            whole = np.fromiter(covered, np.int64, len(covered))
            none = [None] * len(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((shard, versions[whole]))), pa.array(np.concatenate((keys[row[new]], keys[whole]))),
                 pa.array(np.concatenate((versions[row[new]], versions[whole]))),
                 pa.array(np.concatenate((start[new], np.zeros(len(whole), np.int32)))),
                 pa.array([texts[i] for i in new] + [None] * len(whole), pa.binary()),
                 pa.array(none + [[x for span in s for x in span] for s in covered.values()], pa.list_(pa.int32()))],
                ["shard", "key", "version", "start", "passage", "spans"],
            )

    return map_batches(joined, run, "shard long, key long, version long, start int, passage binary, spans array<int>")


def earlier_spans(joined: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``key, version, spans``: word spans (starts and stops in turn) covered by windows that occur earlier."""
    sent = passages(joined, window, anchor).repartition("shard").sortWithinPartitions("shard", "key", "start")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for r in zip(f["shard"], f["key"], f["version"], f["start"], f["passage"], f["spans"]))
        columns = ["key", "version", "spans"]
        out: list[tuple[int, int, list[int]]] = []
        for _, shard in groupby(rows, key=itemgetter(0)):
            automaton, waiting = SuffixAutomaton(), None
            known: dict[bytes, tuple[int, int, list[int]]] = {}
            for _, key, version, start, passage, later in shard:
                if passage is None:
                    out.append((key, version, list(later)))
                    continue
                words = bytes(passage).split()
                first = known.get(passage)
                if first is None:
                    matched: list[tuple[int, int]] = []
                    if waiting is not None:
                        automaton.add(waiting)
                        matched = matched_spans(automaton.matching(words), window)
                    waiting = words
                    first = known[passage] = (key, start, [start + x for span in matched for x in span])
                # Every place of a passage but its first is covered as a whole.
                spans = first[2] if first[:2] == (key, start) else [start, start + len(words)]
                if spans:
                    out.append((key, version, spans))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    return map_frames(sent, run, "key long, version long, spans array<int>")


def packed_texts(texts: DataFrame) -> DataFrame:
    """``key, version, packed``: texts compressed before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7)
        for step in text_steps(batches):
            packed = [t if t is None else pack.compress(t) for t in step.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("version"), pa.array(packed, pa.binary())], ["key", "version", "packed"])

    return map_batches(texts, run, "key long, version long, packed binary")


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text's words without those covered by an
    earlier window.

    A window is ``window`` consecutive words of one text; it is earlier if its text has the
    smaller ``doc_id`` or is the same and the window starts before. ``kept`` holds the other
    words joined by one space. Null, empty and blank texts have no words. A null ``doc_id``
    comes before all others. Rows with the same ``doc_id`` are one document's versions: equal
    rows leave each other alone, and of different texts neither is earlier at the same start.
    Other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(
        document_key(F.col("doc_id")).alias("key"), F.xxhash64(F.col("text")).alias("version"), F.col("text").cast("string").alias("text")
    )
    # One shuffle of the places: equal anchors meet, but for places already known as shared.
    together = Window.partitionBy("anchor", "salt")
    places = anchor_places(texts, window, anchor).withColumn("n", F.count(F.lit(1)).over(together))
    shared = ((F.col("n") > SHARED_PLACES) | (F.col("salt") > 0)).alias("shared")
    repeated = places.where("n > 1 or salt > 0").select("key", "version", "place", shared)
    by_text = repeated.groupBy("key", "version").agg(F.collect_list(F.struct("place", "shared")).alias("places"))
    # Both joins keep all texts, so that they share one shuffle of them.
    packed = packed_texts(texts)
    found = earlier_spans(packed.join(by_text, ["key", "version"], "left"), window, anchor)
    spans = found.groupBy("key", "version").agg(F.collect_list("spans").alias("spans"))
    joined = packed.join(spans, ["key", "version"], "left").select("key", "packed", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for step in text_steps(batches, "packed"):
            total, removed, kept = [], [], []
            for text, found in zip(step.column("packed").to_pylist(), step.column("spans").to_pylist()):
                words = unpack.decompress(text).split() if text else []
                stay = np.ones(len(words), bool)
                for spans in found or ():
                    for a, b in zip(spans[::2], spans[1::2]):
                        stay[a:b] = False
                total.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(words if removed[-1] == 0 else [words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [step.column("key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["key", "n_words", "n_removed", "kept"],
            )

    out = map_batches(joined, run, "key long, n_words long, n_removed long, kept string")
    return out.select(document_id(F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")
