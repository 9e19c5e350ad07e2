"""Cheapest repair of conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of turns read and the state of the grammar
``(system? (user assistant)+)?`` over the initials written so far. Edges keep, rerole or delete
a turn, or insert one. A forward heap starts at the empty conversation, a reverse heap at the
accepting ends; both settle nodes by cost until their least costs together exceed the best
crossing, so that every crossing of equal cost has been met. Each label carries its edits'
initials, the least string of its cost; the least concatenation at a crossing is the audit.

Two strings of equal cost that lead to one node are never prefixes of each other (what one has
more would be insertions, which cost), so the least whole is made of least parts. Hence long
conversations are searched in parts of ``PART`` turns, from every state to every state, and the
parts are joined in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed, document_id, document_key, map_batches

RELABEL, REMOVE, ADD, CUT_OFF = 3, 4, 3, 3
#: States: nothing written, system, user, assistant written last. What user or assistant comes next.
AHEAD = (2, 2, 3, 2)
ACCEPTING = (0, 3)
#: Initials that a kept turn may have, as the state that they lead to.
INITIALS = {"s": 1, "u": 2, "a": 3}
ROLES = {2: "user", 3: "assistant"}
#: Faults of a turn: none, must go, cut off.
SOUND, LOST, OPEN = 0, 1, 2
#: Turns that one search reads at most.
PART = 1024
#: Turn sequences whose answer a worker remembers.
REMEMBERED = 50_000

Label = tuple[int, str]


def _kept(state: int, initial: int) -> bool:
    """Whether a turn whose initial leads to ``initial`` may follow ``state``."""
    return initial == 1 and state == 0 or initial > 1 and AHEAD[state] == initial


def _steps(turns: bytes, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges out of a node: cost, initial of the edit, next node."""
    yield ADD, "I", i, AHEAD[state]
    if i < len(turns):
        fault, initial = divmod(turns[i], 4)
        yield REMOVE, "D", i + 1, state
        if fault != LOST:
            extra = CUT_OFF if fault == OPEN else 0
            yield RELABEL + extra, "R", i + 1, AHEAD[state]
            if _kept(state, initial):
                yield extra, "K", i + 1, initial


def _back_steps(turns: bytes, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges into a node: cost, initial of the edit, node before."""
    before = [s for s in range(4) if AHEAD[s] == state]
    for s in before:
        yield ADD, "I", i, s
    if i:
        fault, initial = divmod(turns[i - 1], 4)
        yield REMOVE, "D", i - 1, state
        if fault != LOST:
            extra = CUT_OFF if fault == OPEN else 0
            for s in before:
                yield RELABEL + extra, "R", i - 1, s
            for s in range(4):
                if initial == state and _kept(s, initial):
                    yield extra, "K", i - 1, s


def search(turns: bytes, start: int, goals: tuple[int, ...]) -> Label | None:
    """Least cost, then audit, from ``start`` before the turns to one of ``goals`` behind them.

    ``turns`` has a byte a turn: four times its fault, plus the state that its initial leads to
    (0 for any other initial). None where no goal can be reached.
    """
    n = len(turns)
    ahead: dict[tuple[int, int], Label] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Label] = {(n, goal): (0, "") for goal in goals}
    # Edges that cost nothing keep a turn; so labels of one cost are final in the order of turns
    # on the way out, and in the reverse order on the way back.
    forward = [(0, 0, "", start)]
    reverse = [(0, -n, "", goal) for goal in goals]
    heapq.heapify(reverse)
    best = None
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            cost, i, audit, state = heapq.heappop(forward)
            if ahead[i, state] != (cost, audit):
                continue
            for price, letter, j, after in _steps(turns, i, state):
                label = (cost + price, audit + letter)
                if (j, after) not in ahead or label < ahead[j, after]:
                    ahead[j, after] = label
                    heapq.heappush(forward, (label[0], j, label[1], after))
                if (j, after) in back and (best is None or label[0] + back[j, after][0] < best):
                    best = label[0] + back[j, after][0]
            node = (i, state)
        else:
            cost, i, audit, state = heapq.heappop(reverse)
            if back[-i, state] != (cost, audit):
                continue
            for price, letter, j, before in _back_steps(turns, -i, state):
                label = (cost + price, letter + audit)
                if (j, before) not in back or label < back[j, before]:
                    back[j, before] = label
                    heapq.heappush(reverse, (label[0], -j, label[1], before))
                if (j, before) in ahead and (best is None or label[0] + ahead[j, before][0] < best):
                    best = label[0] + ahead[j, before][0]
            node = (-i, state)
        if node in ahead and node in back and (best is None or ahead[node][0] + back[node][0] < best):
            best = ahead[node][0] + back[node][0]
    crossings = [ahead[v][1] + back[v][1] for v in ahead.keys() & back.keys() if ahead[v][0] + back[v][0] == best]
    return (best, min(crossings)) if crossings else None


@lru_cache(REMEMBERED)
def _searched(turns: bytes, start: int, goals: tuple[int, ...]) -> Label | None:
    return search(turns, start, goals)


def cheapest(turns: bytes, part: int = PART) -> Label:
    """Least cost and audit of a whole conversation."""
    if len(turns) <= part:
        return _searched(turns, 0, ACCEPTING)
    labels: dict[int, Label] = {0: (0, "")}
    for at in range(0, len(turns), part):
        piece, reached = turns[at : at + part], {}
        for state, (cost, audit) in labels.items():
            for goal in range(4):
                found = search(piece, state, (goal,))
                if found is not None:
                    label = (cost + found[0], audit + found[1])
                    reached[goal] = min(label, reached.get(goal, label))
        labels = reached
    return min(labels[goal] for goal in ACCEPTING if goal in labels)


def written(turns: bytes, audit: str) -> tuple[list[int | None], list[str | None]]:
    """Of every turn left: its place among the turns (None if inserted), its new role (None if kept)."""
    places, roles, i, state = [], [], 0, 0
    for letter in audit:
        if letter in "KRI":
            state = turns[i] % 4 if letter == "K" else AHEAD[state]
            places.append(None if letter == "I" else i)
            roles.append(None if letter == "K" else ROLES[state])
        i += letter != "I"
    return places, roles


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Each key of the sorted rows with the bytes of its turns."""
    key, parts = None, []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        codes = batch.column("code").to_numpy().astype(np.uint8)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if key is not None and keys[a] != key:
                yield key, b"".join(parts)
                parts = []
            key = int(keys[a])
            parts.append(codes[a:b].tobytes())
    if key is not None:
        yield key, b"".join(parts)


def examined(conversations: DataFrame) -> DataFrame:
    """``key, place, turn, role, text, fault, code, illegal``: the turns in order, with what is wrong.

    Turns of a conversation come by ``turn``, nulls first; equal ones by role and text. Null
    roles and texts are one space. ``fault`` is the first of ``blank`` (no word), ``duplicate``
    (role and text of an earlier turn) and ``truncated`` (no sentence end), or null.
    """
    blanks = "".join(map(chr, [32, *range(9, 14)]))
    rows = conversations.select(
        document_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    in_order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(in_order) - 1)
    same = Window.partitionBy("key", "role", "text").orderBy("place")
    rows = rows.withColumn("_nth", F.row_number().over(same))
    initial = F.substring("role", 1, 1)
    previous = F.lag(initial).over(Window.partitionBy("key").orderBy("place"))
    stripped = F.rtrim("text", F.lit(blanks))
    fault = (
        F.when(stripped == "", "blank").when(F.col("_nth") > 1, "duplicate")
        .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated")
    )
    level = F.when(F.col("fault").isin("blank", "duplicate"), LOST).when(F.col("fault") == "truncated", OPEN).otherwise(SOUND)
    state = F.lit(0)
    for letter, number in INITIALS.items():
        state = F.when(initial == letter, number).otherwise(state)
    return rows.withColumn("fault", fault).select(
        "key", "place", "turn", "role", "text", "fault", (level * 4 + state).cast("int").alias("code"),
        (previous.isNotNull() & ~F.concat(previous, initial).isin("su", "ua", "au")).alias("illegal"),
    )


def repairs(turns: DataFrame, part: int = PART) -> DataFrame:
    """``key, cost, audit, places, roles`` of every conversation in ``turns`` as ``examined`` gives them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, codes in _groups(batches):
            cost, audit = cheapest(codes, part)
            places, roles = written(codes, audit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit]),
                    pa.array([places], pa.list_(pa.int32())), pa.array([roles], pa.list_(pa.string())),
                ],
                ["key", "cost", "audit", "places", "roles"],
            )

    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_turns = turns.select("key", "place", "code").repartition(tasks, "key").sortWithinPartitions("key", "place")
    return map_batches(sorted_turns, run, "key long, cost long, audit string, places array<int>, roles array<string>")


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """``key, number, role, text`` of every repaired conversation, numbered from 0."""
    lines = repaired.select("key", F.posexplode(F.arrays_zip("places", "roles")).alias("number", "_line"))
    lines = lines.select("key", "number", F.coalesce("_line.places", -1 - F.col("number")).alias("place"), F.col("_line.roles").alias("_role"))
    old = turns.select("key", "place", F.col("role").alias("_old"), "text")
    return lines.join(old, ["key", "place"], "left").select(
        "key", "number", F.coalesce("_role", "_old").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: hash of each conversation's ``role:text`` lines, one after another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], ["key", "repaired_sha256"])
        for batch in batches:
            for now, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                if now != key:
                    if state is not None:
                        yield give()
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield give()

    tasks = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(repaired.repartition(tasks, "key").sortWithinPartitions("key", "number"), run, "key long, repaired_sha256 string")


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``: faults of its rows in ``turns``, their repair.

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. A conversation without rows in ``turns`` has zeros, an empty audit and
    the hash of the empty string. Rows without a ``conv_id`` are one conversation. Null turns
    come first and count for no gap; null roles and texts are one space, a role that starts
    with none of s, u, a can't be kept. Ties of ``turn`` go by role and text; repeated rows are
    duplicates. Other columns are not read. An empty table gives an empty result.

    A search holds a byte a turn and the labels of ``PART`` turns; texts and repaired rows stay
    rows, and only the hash, which is one chain, reads a conversation's rows in one task.
    """
    marked = checkpointed(examined(turns))
    found = checkpointed(repairs(marked))
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = marked.groupBy("key").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal")
    )
    hashes = conversation_hashes(repaired_turns(marked, found))
    ids = conversations.select(document_key(F.col("conv_id")).alias("key")).distinct()
    joined = ids.join(stats, "key", "left").join(found.select("key", "cost", "audit"), "key", "left").join(hashes, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        document_id(F.col("key")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats the row, 4 makes
    the role ``user``. Nulls are one space, in the hash as well.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
