"""Token counts of a byte-level BPE vocabulary, by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged array of symbols. Each round finds the lowest-ranked
pair of every sequence and merges all its places at once; sequences without a ranked pair are
done and what is left of them is counted. Vocabularies are read, never trained.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, text_steps

#: Fixed value: how this family of vocabularies parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts of pre-tokens that a worker remembers; beyond it the store starts anew.
REMEMBERED = 400_000
#: Bytes of new pre-tokens that are merged together.
MERGED_BYTES = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such a vocabulary file.

    Visible Latin-1 characters stand for themselves, all others for those from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in visible else next(rest)) for b in range(256)]


class RankMerger:
    """Merge table as sorted arrays, and the counting of symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.letters = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known: dict[str, int] = {}

    def symbol_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each token after all merges."""
        out = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.letters[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        none = np.int64(1 << 60)
        while len(symbols):
            rank = np.full(len(symbols), none)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            key = symbols[inner] << 32 | symbols[inner + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            rank[inner[hit]] = self.ranks[at[hit]]
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(begins, append=len(owner))
            low = np.minimum.reduceat(rank, begins)
            done = low == none
            out[owner[begins[done]]] = sizes[done]
            chosen = (rank == np.repeat(low, sizes)) & (rank < none)
            # Of overlapping places (runs of one symbol) every other one, from the left.
            places = np.flatnonzero(chosen)
            run = np.cumsum(np.diff(places, prepend=-2) != 1)
            offset = np.arange(len(places)) - np.searchsorted(run, run)
            places = places[offset % 2 == 0]
            symbols[places] = self.merged[rank[places]]
            stay = np.repeat(~done, sizes)
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out

    def _learn(self, tokens: Iterable[str]) -> None:
        batch: list[str] = []
        size = 0
        for token in [*tokens, None]:
            if batch and (token is None or size > MERGED_BYTES):
                self.known.update(zip(batch, self.symbol_counts([t.encode() for t in batch]).tolist()))
                batch, size = [], 0
            if token is not None:
                batch.append(token)
                size += len(token)

    def text_counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; pre-tokens that are new in any of the texts are merged together."""
        special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        parts = regex.compile(PATTERN)
        split, out = [], []
        for text in texts:
            pieces = [text or ""]
            if special is not None and text and any(s in text for s in self.specials):
                pieces = special.split(text)
            split.append([parts.findall(piece) for piece in pieces])
            out.append(len(pieces) - 1)
        found = set(chain.from_iterable(chain.from_iterable(split)))
        new = found.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = found
        self._learn(new)
        count = self.known.__getitem__
        return [n + sum(sum(map(count, tokens)) for tokens in pieces) for n, pieces in zip(out, split)]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Special strings inside a text count as
    one token each. Repeated rows and repeated or null ids each get their own row. Other
    columns are not read. An empty table gives an empty result.
    """
    merger = docs.sparkSession.sparkContext.broadcast(RankMerger(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            texts = step.column("text")
            counts = np.array(merger.value.text_counts(texts.to_pylist()), np.int64)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
