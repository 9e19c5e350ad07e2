"""Conversation repair, embedding near-dedup and periodic runs against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import grid_join, periodic_runs, queries, turn_repair

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- conversations ----

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def brute_repair(rows):
    """Least (cost, audit, repaired lines) by going through all edits of ``(initial, role, text, fault)`` rows."""
    best: dict = {}

    def go(i, last, inserted):
        if (i, last, inserted) in best:
            return best[i, last, inserted]
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        follow = NEXT[last]
        name = {"u": "user", "a": "assistant"}[follow]
        add = lambda cost, letter, line, rest: rest and ways.append((rest[0] + cost, letter + rest[1], (line, *rest[2]) if line is not None else rest[2]))
        if inserted < 3:
            add(3, "I", f"{name}:", go(i, follow, inserted + 1))
        if i < len(rows):
            initial, role, text, fault = rows[i]
            add(4, "D", None, go(i + 1, last, 0))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                add(3 + cut, "R", f"{name}:{text}", go(i + 1, follow, 0))
                if initial == follow or (initial == "s" and last == ""):
                    add(cut, "K", f"{role}:{text}", go(i + 1, initial, 0))
        best[i, last, inserted] = min(ways) if ways else None
        return best[i, last, inserted]

    return go(0, "", 0)


def brute_report(conversations, damage=True):
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in conversations:
        groups[conv]  # every original id
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 99
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, faults = set(), [], Counter()
        for _, role, text in rows:
            held = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role[:1], role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = brute_repair(marked)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report_rows(frame):
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in frame.collect()}


def test_conversations_of_the_sample(spark):
    got = report_rows(queries.op11_conversations(spark, "/root/testdata/sf0.01"))
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == brute_report([tuple(r) for r in rows])


def test_odd_conversations(spark):
    dice = random.Random(5)
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hm"), (1, 0, "tool", "x."), (2, 0, "", ""), (2, 1, "user", "\x0b\t "),
        (3, 1, "user", "A?"), (3, 1, "user", "A?"), (3, 1, "assistant", "B! "), (3, None, "system", "S."), (3, 9, "assistant", "後。"), (4, 2, "assistant", "x" * 30000),
    ]
    for conv in range(10, 60):
        rows += [
            (conv, dice.choice([None, *range(9)]), dice.choice(["system", "user", "assistant", "user", "assistant", "other", None]), dice.choice(["Yes.", "No", "", None, "Why? ", "So.\n"]))
            for _ in range(dice.randint(1, 9))
        ]
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, key long, place string, code int")
    plain = turn_repair.repair_report(frame, frame)
    assert report_rows(plain) == brute_report(rows, damage=False)
    assert report_rows(turn_repair.repair_report(turn_repair.damaged(frame), frame)) == brute_report(rows)
    none = frame.where("false")
    assert turn_repair.repair_report(none, none).collect() == []
    gone = report_rows(turn_repair.repair_report(none, frame.where("conv_id = 3")))
    assert gone == {3: (0, 0, 0, 0, 0, 0, "", sha(""))}


def test_searches_in_parts(spark):
    dice = random.Random(7)
    code = lambda: bytes(dice.choice([0, 0, 0, 1, 2]) * 4 + dice.choice([0, 1, 2, 3, 2, 3]) for _ in range(dice.randint(0, 40)))
    for _ in range(300):
        turns = code()
        names = {0: "x", 1: "s", 2: "u", 3: "a"}
        faults = {0: None, 1: "blank", 2: "truncated"}
        want = brute_repair([(names[t % 4], names[t % 4], "", faults[t // 4]) for t in turns])[:2]
        assert turn_repair.search(turns, 0, turn_repair.ACCEPTING) == turn_repair.cheapest(turns, 4) == want
    cost, audit = turn_repair.cheapest(bytes(dice.choice([2, 3, 3, 6, 10]) for _ in range(6000)))
    assert len(audit) >= 6000 and cost > 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (2, 0, "assistant", "Only.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marked = turn_repair.examined(frame)
    got = turn_repair.repaired_turns(marked, turn_repair.repairs(marked)).orderBy("key", "number").collect()
    assert [(r.key, r.role, r.text) for r in got] == [(1, "user", "Hi."), (1, "assistant", "More?"), (2, "user", ""), (2, "assistant", "Only.")]


# ---- vectors ----


def brute_vectors(rows, min_cosine=0.95):
    """``(vec_id, n_links, component_id, kept)`` of every row, sorted."""
    width = max((len(v) for _, v in rows if v), default=1)
    usable = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    filled = np.array([[*v, *[0.0] * (width - len(v))] if ok else [0.0] * width for (_, v), ok in zip(rows, usable)], np.float64).reshape(-1, width)
    norm = np.sqrt((filled * filled).sum(axis=1))
    norm[~np.array(usable, bool)] = np.inf
    near = (filled @ filled.T) / np.outer(norm, norm) >= min_cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    a, b = np.nonzero(near)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        if np.array_equal(label, old):
            break
    smallest = {}
    for (vec_id, _), l in zip(rows, label):
        if vec_id is not None:
            smallest[l] = min(vec_id, smallest.get(l, vec_id))
    out = [(i, int(near[k].sum()), smallest.get(label[k]), i is not None and i == smallest.get(label[k])) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def vector_rows(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def planted_vectors(n=900, width=12, seed=3):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(9, width)) * np.linspace(2, 0.2, width)
    vectors = centres[dice.integers(0, 9, n)] + dice.normal(size=(n, width)) * dice.choice([0.02, 0.15, 0.8], n)[:, None]
    vectors[:80] = vectors[0]
    vectors[100:120] = vectors[100] * dice.uniform(0.01, 90, 20)[:, None]
    return [(int(i), [float(x) for x in v]) for i, v in zip(dice.permutation(n), vectors)]


@pytest.mark.parametrize("chunk", [16, 50, 4096])
def test_planted_vectors(spark, chunk):
    rows = planted_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_rows(grid_join.near_vectors(frame, chunk=chunk))
    assert got == brute_vectors(rows) and max(r[1] for r in got) > 100


def test_other_cosine(spark):
    rows = planted_vectors(200, 3, 8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rounded = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert vector_rows(grid_join.near_vectors(frame, 0.7, 16)) == brute_vectors(rounded, 0.7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [2.0, 0.0]),
        (9, [1.0]), (10, [-1.0, 0.0]), (11, [0.0, 3.0]), (None, [0.0, -5.0]), (12, [1e-200, 1e-202]), (13, [1e200, 1e198]), (3, [-0.0, 1.0]), (14, [0.95, 0.6]),
    ]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, place long, h0 long, component_id int")
    tame = [(i, [1.0, 0.01] if v and v[0] in (1e-200, 1e200) else v) for i, v in rows]
    assert vector_rows(grid_join.near_vectors(frame)) == brute_vectors(tame)
    assert grid_join.near_vectors(frame.where("false")).collect() == []
    alone = grid_join.near_vectors(frame.where("vec_id < 5")).collect()
    assert sorted(r.n_links for r in alone)[:3] == [0, 0, 0]


def test_vectors_of_the_sample(spark):
    got = vector_rows(queries.op12_embeddings(spark, "/root/testdata/sf0.01"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == brute_vectors(rows)


# ---- periodic runs ----


def brute_runs(words, min_length=24, min_exponent=3):
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        k, last = 0, len(words) - q
        while k < last:
            s = k
            while k < last and words[k] == words[k + q]:
                k += 1
            length = k - s + q
            if k > s and length >= max(min_length, min_exponent * q):
                part = words[s : s + length]
                if not any(part[:-p] == part[p:] for p in range(1, q)):
                    found.append((s, length, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {w for s, length, q in runs for w in range(s + q, s + length)}
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_runs_of_the_sample(spark):
    got = [tuple(r) for r in queries.op13_periodic(spark, FOLDER).collect()]
    texts = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = [brute_digest(*t) for t in texts if len(WORD.findall(t[1] or "")) <= 2500]
    assert len(want) > 150 and set(want) <= set(got) and len(got) == len(texts)
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_runs(spark):
    loop = lambda words, n: " ".join((words * n)[:n])
    texts = [
        (1, None), (2, ""), (3, " \n\x0b "), (4, loop(["a"], 23)), (5, loop(["a"], 24)), (5, loop(["a"], 24)), (None, loop(["x", "y"], 40)),
        (6, "p " + loop(list("abcdefgh"), 24) + " q"), (7, loop(list("abcdefghi"), 26)), (8, loop(list("aab"), 30) + " " + loop(list("aaab"), 40) + "  z"),
        (9, loop(["é", "　", "😀"], 50)), (16, loop([f"w{i % 11}" for i in range(37)], 2000)), (10, "x" * 40000), (11, "a b c\nd"), (12, loop(["s"], 3000)),
    ]
    frame = spark.createDataFrame([(i, t, [1], 2, "c") for i, t in texts], "doc_id long, text string, runs array<int>, n_words long, collapsed string")
    got = periodic_runs.periodic_runs(frame).collect()
    plain = lambda t: WORD.findall(t or "")
    want = Counter((i, len(plain(t)), tuple(brute_runs(plain(t)))) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs)) for r in got) == want
    assert {r.doc_id: r.collapsed for r in got}[12] == "s"
    assert periodic_runs.periodic_runs(frame.where("false")).collect() == []
    planted = {(r.doc_id, r.text) for r in periodic_runs.with_planted_runs(frame).collect()}
    assert (None, texts[6][1]) in planted and len(planted) == len(set(texts))


def test_runs_of_short_alphabets():
    dice = random.Random(1)
    for k in range(250):
        words = []
        for _ in range(dice.randint(0, 6)):
            base = [dice.choice("abc"[: dice.randint(1, 3)]) for _ in range(dice.randint(1, 12))]
            words += (base * dice.randint(1, 9))[: dice.randint(1, 80)]
        length, exponent = (24, 3) if k % 2 else (dice.randint(4, 10), dice.randint(2, 3))
        (_, runs, kept), none, _ = periodic_runs.text_runs([" ".join(words).encode(), None, b"a b"], length, exponent)
        assert [tuple(r) for r in runs.tolist()] == brute_runs(words, length, exponent) and none[0] == 0
        gone = {w for s, n, q in runs.tolist() for w in range(s + q, s + n)}
        assert kept.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
