"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser rewrites blanks. The piece
machine is a trie that reads characters and writes a piece, with byte pieces for characters
that no piece holds. For a BPE model a bigram machine whose state is the last piece weighs a
pair zero if merging leaves it apart and infinity otherwise: a sequence is what merging gives
exactly if each of its neighbouring pairs is. Composing them with an input gives a lattice
over (position, last piece); the tropical shortest path through it is the encoding.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, text_steps

BLANK = "▁"
#: Encodings of stretches and weights of pairs that a worker remembers before it starts anew.
REMEMBERED = 400_000
REMEMBERED_PAIRS = 500_000

# Fixed values of the model file's format: field numbers and piece types.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


class PieceTransducer:
    """The compiled machines of one model."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        trainer = dict(next((_fields(v) for f, v in fields if f == _TRAINER), ()))
        normaliser = dict(next((_fields(v) for f, v in fields if f == _NORMALISER), ()))
        if trainer.get(3, 1) != _BPE or trainer.get(35, 0) != 1:
            raise ValueError("only BPE models with byte fallback are compiled")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only the identity normaliser, without removal of blanks, is compiled")
        self.prefix = BLANK if normaliser.get(3, 1) else ""
        self.pieces: list[str] = []
        self.cost: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for field, value in fields:
            if field != _PIECES:
                continue
            entry = dict(_fields(value))
            piece, kind = entry[1].decode(), entry.get(3, _NORMAL)
            if kind == _USER or kind == _UNUSED:
                raise ValueError("user-defined and unused pieces are not compiled")
            i = len(self.pieces)
            self.pieces.append(piece)
            self.raw.append(b"")
            if kind == _BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif kind == _NORMAL:
                self.number[piece] = i
                self.cost[piece] = -struct.unpack("<f", entry.get(2, bytes(4)))[0]
                self.raw[i] = piece.replace(BLANK, " ").encode()
            elif kind == _UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
        self._compile()

    def _compile(self) -> None:
        # Piece machine: a trie of dictionaries by character; "" holds the piece that ends there.
        self.trie: dict = {}
        self.letters = frozenset(p for p in self.number if len(p) == 1)
        for piece in self.number:
            if self.merged(piece) != [piece]:
                continue  # merging never makes it
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        # A blank after another character is in no piece: no path crosses such a place, and
        # what lies between is composed on its own.
        inside = any(BLANK in p.lstrip(BLANK) for p in self.number)
        self.stretch = regex.compile("(?s).+" if inside else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", BLANK) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: lowest cost first, then leftmost."""
        parts, cost, none = list(text), self.cost.get, np.inf
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            low = min(costs)
            if low == none:
                break
            at = costs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = cost(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = cost(parts[at] + parts[at + 1], none)
        return parts

    def joins(self, left: str, right: str) -> bool:
        """Bigram machine: whether the weight of this pair is zero (else infinite)."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(left + right) == [left, right]
        return known

    def arcs(self, text: str, start: int) -> list[str]:
        """Pieces that the trie reads from a position, shortest first."""
        out, node = [], self.trie
        for at in range(start, len(text)):
            node = node.get(text[at])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out

    def shortest_path(self, text: str) -> list[str]:
        """Pieces of the lattice's shortest path over a text of characters that pieces hold.

        Every finite arc weighs zero, so the first path to the end is a shortest one, and
        states may be settled in any order: longest pieces first, arcs composed as they are
        needed. A state (position, last piece) that leads nowhere is not entered again, so
        that the work is bounded by the lattice's arcs.
        """
        path: list[str] = []
        open_arcs: list[tuple[int, list[str]]] = []
        closed: set[tuple[int, str]] = set()
        at, last, arcs = 0, None, self.arcs(text, 0)
        while True:
            while arcs:
                piece = arcs.pop()
                if (last is None or self.joins(last, piece)) and (at + len(piece), piece) not in closed:
                    break
            else:
                if last is None:
                    raise ValueError("the lattice has no finite path")
                closed.add((at, last))
                path.pop()
                at, arcs = open_arcs.pop()
                last = path[-1] if path else None
                continue
            path.append(piece)
            open_arcs.append((at, arcs))
            at, last = at + len(piece), piece
            if at == len(text):
                return path
            arcs = self.arcs(text, at)

    def encode_stretch(self, stretch: str) -> list[int]:
        """Ids of a stretch; characters of no piece part it and become byte pieces."""
        if self.letters.issuperset(stretch):
            return [self.number[p] for p in self.shortest_path(stretch)]
        out: list[int] = []
        start = 0
        for at, c in enumerate([*stretch, None]):
            if c is not None and c in self.letters:
                continue
            if at > start:
                out += [self.number[p] for p in self.shortest_path(stretch[start:at])]
            if c is not None:
                out += [self.bytes[b] for b in c.encode()]
            start = at + 1
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, as the library gives them without begin and end."""
        known = self.known
        stretches = self.stretch.findall(self.normalise(text or ""))
        for new in set(stretches).difference(known):
            if len(new) <= 64:
                if len(known) >= REMEMBERED:
                    known.clear()
                    return self.encode(text) if len(set(stretches)) < REMEMBERED else self._encode_apart(stretches)
                known[new] = array("i", self.encode_stretch(new)).tobytes()
        return np.frombuffer(b"".join([known[s] if s in known else array("i", self.encode_stretch(s)).tobytes() for s in stretches]), np.int32)

    def _encode_apart(self, stretches: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(array("i", self.encode_stretch(s)).tobytes() for s in stretches), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces and bytes joined, the added first blank taken away."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, n_pieces, decoded`` for every row of ``docs``.

    ``ids`` is what the library gives for the model at ``path``; ``decoded`` is the text of
    those ids, equal to the input but for characters that stand for blanks themselves. Null
    and empty texts have no ids and decode to the empty text. Repeated rows and repeated or
    null ids each get their own row. Other columns are not read. An empty table gives an
    empty result.
    """
    machine = docs.sparkSession.sparkContext.broadcast(PieceTransducer(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            ids = [machine.value.encode(t) for t in step.column("text").to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            decoded = [machine.value.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]))),
                 pa.array(sizes), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "n_pieces", "decoded"],
            )

    return map_batches(rows, run, "doc_id long, ids array<int>, n_pieces long, decoded string")
