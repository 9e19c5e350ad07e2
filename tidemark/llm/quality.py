"""Quality rules: plain counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed token n-grams are counted: one over trusted documents, one over
all documents. A document's score is the mean log ratio of its n-grams; documents below a
fixed threshold are rejected. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_SPACE

#: Hash buckets of n-grams; the model is one number per bucket.
BUCKETS = 8192
#: Trusted documents whose n-grams are counted: at most so many, those with the smallest hash
#: of the id. This bounds the broadcast list of ids; the raw counts cover every document.
TRUSTED_DOCUMENTS = 20_000
#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.25

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), "")


def _next(array: Column | str, by: int = 1) -> Column:
    """The array without its first ``by`` entries; an operand of ``zip_with`` beside the array itself.

    Lambdas see neighbours this way only: an array that a lambda looks up by position could be
    put into the lambda by the optimiser and computed for every entry.
    """
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array) - by, F.lit(0)))


def _whole(array: Column, size: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(size, F.lit(0)))


def with_gram_buckets(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``grams``: buckets of all token unigrams and bigrams of ``text``.

    Tokens are runs of letters and digits, and runs of other visible characters.
    """
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKEN), F.lit(0))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    frame = texts.withColumn("_tokens", F.transform(tokens, lambda t: F.xxhash64(t)))
    pairs = F.zip_with("_tokens", _next("_tokens"), lambda a, b: bucket(F.xxhash64(a, b)))
    grams = F.concat(F.transform("_tokens", bucket), _whole(pairs, F.size("_tokens") - 1))
    return frame.withColumn("grams", grams).drop("_tokens")


def base_counts(texts: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` to rows with ``text``."""
    size = REPEAT_WINDOW
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(f"[^{WORD_SPACE}]"))
    frame = texts.withColumn("_words", words_of(F.col("text")))
    frame = frame.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    both = lambda a, b: F.xxhash64(a, b)
    frame = frame.withColumn("_two", F.zip_with("_hashes", _next("_hashes"), both))
    frame = frame.withColumn("_four", F.zip_with("_two", _next("_two", 2), both))
    five = F.zip_with("_four", _next("_hashes", 4), both)
    frame = frame.withColumn("_windows", _whole(five, F.size("_hashes") - (size - 1)))
    # Only where some window repeats: windows sorted by hash stand beside their equals.
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    same = F.zip_with("_ordered", _next("_ordered"), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    frame = frame.withColumn("_same", same)
    either = F.zip_with("_same", F.concat(F.array(F.lit(False)), "_same"), lambda a, b: a | b)
    places = F.zip_with("_ordered", either, lambda x, found: F.when(found, x["i"]))
    frame = frame.withColumn("_places", F.sort_array(F.array_compact(places)))
    covered = F.aggregate(
        F.zip_with("_places", _next("_places"), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return frame.select(
        *texts.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCUMENTS) -> DataFrame:
    """``doc_id`` of at most ``most`` documents labelled good and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select(F.col("doc_id").cast("long").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of trusted to raw probability per bucket, with add-one smoothing.

    Counts run over all of ``docs``; only one row per bucket leaves the executors. With no
    trusted document every ratio is zero, so that nothing is rejected for want of labels.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left"
    )
    grams = with_gram_buckets(marked.select("text", F.col("trusted_id").isNotNull().cast("int").alias("good")), buckets)
    # The outer form: the plain one adds a filter on the array's size that computes it twice.
    grams = grams.select("good", F.explode_outer("grams").alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).where("b is not null").collect()
    raw_total = sum(r["raw"] for r in counts) + buckets
    good_total = sum(r["good"] for r in counts) + buckets
    ratio = [0.0] * buckets
    if good_total > buckets:
        ratio = [math.log(raw_total / good_total)] * buckets
        for r in counts:
            ratio[r["b"]] = math.log((r["good"] + 1) / good_total) - math.log((r["raw"] + 1) / raw_total)
    return ratio


def with_ratio_score(texts: DataFrame, ratio: list[float]) -> DataFrame:
    """Adds ``score``: mean log ratio of the n-grams of ``text``; null for a text without any."""
    model = F.split(F.lit(",".join(f"{r:.6f}" for r in ratio)), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(model, b))
    frame = with_gram_buckets(texts, len(ratio))
    return frame.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams"))).drop("grams")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` for every row.

    Null, empty and blank texts have no words, fail the base rule and have a null score.
    Repeated rows and repeated or null ids each get their own row. Labels may be empty: the
    score is then zero and only the base rule decides. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judged(texts, fit_ratio(docs, labels), threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def judged(texts: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Rows with ``text`` and the counts, ``score``, ``base_failed`` and ``kept`` beside their columns."""
    scored = base_counts(with_ratio_score(texts, ratio))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(F.col("score") >= threshold, F.lit(True)))
