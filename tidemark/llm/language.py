"""Language identification: averaged hashed subword embeddings and a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled documents;
a part of the sample is held back to fit the temperature and the rejection threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, map_frames, text_steps

SUBWORD_BYTES = (2, 3, 4)
BUCKETS = 1 << 14
DIMENSIONS = 16
#: Training sample: at most so many documents of a language (smallest hash of the id), and
#: at most so many in all.
PER_LANGUAGE = 300
MOST_DOCUMENTS = 2000
EPOCHS = 6
RATE = 0.5
#: Share of the held-back documents that the rejection threshold lets pass.
ACCEPTED = 0.995

HELD_OUT = 2


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, one text after another, and their counts by text.

    Subwords are runs of 2 to 4 bytes of the lower-case text, white space as one space.
    """
    codes = [b" %b " % " ".join(t.lower().split()).encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(codes), np.uint8)
    sizes = np.fromiter((len(c) for c in codes), np.int64, len(codes))
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    value = data.astype(np.uint32)
    out, owner = [], []
    document = np.repeat(np.arange(len(codes)), sizes)
    grams = np.zeros(len(data), np.uint32)
    for n in range(1, max(SUBWORD_BYTES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        grams = grams[:m] * np.uint32(0x01000193) + value[n - 1 :] + np.uint32(1)
        if n in SUBWORD_BYTES:
            fits = np.flatnonzero(at[:m] + n <= ends[:m])
            h = grams[fits] * np.uint32(0x9E3779B1) + np.uint32(n)
            out.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32))
            owner.append(document[fits])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(codes), np.int64)
    owner, ids = np.concatenate(owner), np.concatenate(out)
    order = np.argsort(owner, kind="stable") if len(codes) > 1 else slice(None)
    return ids[order], np.bincount(owner, minlength=len(codes))


@dataclass
class Model:
    """``scores`` holds embedding times softmax weights per bucket, ``bias`` one number a language."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index and its probability for each text."""
        ids, counts = subwords(texts)
        sums = np.zeros((len(texts), len(self.languages)), np.float64)
        ends = np.cumsum(counts)
        full = np.flatnonzero(counts)
        if len(full):
            starts = (ends - counts)[full]
            for k in range(len(self.languages)):
                sums[full, k] = np.add.reduceat(self.scores[:, k][ids], starts, dtype=np.float64)
        logits = sums / np.maximum(counts, 1)[:, None] + self.bias
        chance = softmax(logits / self.temperature)
        best = chance.argmax(axis=1)
        return best, chance[np.arange(len(texts)), best]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """``samples``: language, buckets and their counts. Every fifth one calibrates."""
    languages = sorted({s[0] for s in samples})
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(17)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    held = samples[::5] if len(samples) >= 5 * len(languages) else []
    learnt = [s for i, s in enumerate(samples) if i % 5] if held else samples
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(learnt)):
            name, ids, counts = learnt[i]
            share = counts / counts.sum()
            mean = share @ embedding[ids]
            error = softmax(mean @ weights + bias)
            error[number[name]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # The mean's gradient is spread thin over many buckets; the count undoes that.
            embedding[ids] -= rate * len(ids) ** 0.5 * np.outer(share, back)
    scores = embedding @ weights
    model = Model(languages, scores.astype(np.float32), bias, 1.0, 0.0)
    if held:
        logits = np.array([(c / c.sum()) @ scores[ids] + bias for _, ids, c in held])
        right = np.array([number[name] for name, _, _ in held])
        chance = lambda t: softmax(logits / t)[np.arange(len(right)), right]
        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(chance(t) + 1e-12).sum())
        best = softmax(logits / model.temperature).max(axis=1)
        model.reject_below = float(np.quantile(best, 1 - ACCEPTED))
    return model


def fit(docs: DataFrame) -> Model | None:
    """Model from documents outside the held-out fold whose ``lang`` is known; None without any."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold_of(F.col("doc_id")) != HELD_OUT)
    from pyspark.sql import Window

    order = Window.partitionBy("name").orderBy(F.xxhash64("chosen_id"), "chosen_id")
    ids = known.select(F.col("doc_id").alias("chosen_id"), F.col("lang").cast("string").alias("name"))
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    ids = ids.orderBy("rank", "name").limit(MOST_DOCUMENTS).select("chosen_id", "name")
    chosen = known.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id")).where("lang = name").select("doc_id", "name", "text")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, name, text in zip(frame["doc_id"], frame["name"], frame["text"]):
                buckets, counts = np.unique(subwords([text])[0], return_counts=True)
                if len(buckets):
                    rows.append((doc_id, name, buckets.astype(np.int32), counts.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "buckets", "counts"])

    features = map_frames(chosen, run, "doc_id long, name string, buckets array<int>, counts array<float>").dropDuplicates(["doc_id"])
    rows = sorted(features.collect(), key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    samples = [(r["name"], np.array(r["buckets"]), np.array(r["counts"], np.float64)) for r in rows]
    return train(samples) if samples else None


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row of ``docs``.

    The model sees ``text`` and ``lang`` of the documents outside the held-out fold only. A
    text that is null or has no letter is ``und`` with score zero; so is every text if there
    is nothing to learn from. ``accepted`` is false below the calibrated threshold. A null
    ``doc_id`` is in no fold: not held out and not learnt from. Repeated rows each get their
    own row. Other columns are not read. An empty table gives an empty result.
    """
    model = fit(docs)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            texts = step.column("text").to_pylist()
            worded = np.array([bool(t) and (t.isalpha() or any(map(str.isalpha, t))) for t in texts])
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if model is not None and worded.any():
                best, chance = model.predict(texts)
                names = [model.languages[b] if w else "und" for b, w in zip(best, worded)]
                scores = np.where(worded, chance, 0.0)
            accepted = worded & (scores >= (model.reject_below if model else 0.0))
            yield pa.RecordBatch.from_arrays(
                [step.column("doc_id"), step.column("held_out"), pa.array(names), pa.array(scores), pa.array(accepted)],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
