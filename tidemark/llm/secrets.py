"""Secret scans: fixed patterns, and character Markov models for strings that look random.

Both models are first-order chains over ASCII characters: one trained on random strings, one
on ordinary words and identifiers. A long run of key characters is a finding if it is far
more likely under the first. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns. The second and third state their least length in the
# pattern, which finds the same spans as a longest match that is then measured.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Runs that the Markov models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}

#: Labelled samples: so many random strings, and the words of so many documents (those with
#: the smallest hash of the id). Both bounds are parameters; the scan itself covers all rows.
RANDOM_SAMPLES = 3000
WORD_DOCUMENTS = 500
#: Least log-likelihood ratio of a finding: odds of about one in a million against chance.
LEAST_RATIO = 14.0
_CHARS = 128


#: Elements of an array that are worked on together where each needs those before it.
PART = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def _parts(values: Column) -> Column:
    """The array in arrays of at most ``PART`` elements."""
    last = F.greatest(F.floor((F.size(values) - 1) / PART), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * PART + 1, F.lit(PART)))


def _running(values: Column) -> Column:
    """Sums of an array's elements before each one, as array and total."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))


def _before(values: Column) -> Column:
    """Sum of the elements before each one; each array that grows is short, so many elements cost little."""
    sums = lambda parts: F.zip_with(parts, _running(F.transform(parts, lambda p: p["total"]))["before"],
                                    lambda p, at: F.transform(p["before"], lambda x: x + at))
    return _once(values, lambda v: F.flatten(_once(F.transform(_parts(v), _running), sums)))


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of ``start, ord, stop, kind, value`` of all matches, positions in characters.

    What lies between matches comes from a split on the same pattern, so that lengths of
    pieces and matches add up to positions.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values
    # The gap before a match counts to the match; the last gap stands behind all of them.
    sizes = lambda v: F.zip_with(
        v, F.slice(F.split(text, pattern), F.lit(1), F.size(v)), lambda hit, gap: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(hit).alias("size"), hit.alias("value")))
    placed = _once(values, sizes)
    starts = lambda p: F.zip_with(p, _before(F.transform(p, lambda x: x["gap"] + x["size"])), lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), x["size"].alias("size"), x["value"].alias("value")))
    rows = F.zip_with(_once(placed, starts), F.transform(measured, F.char_length), lambda x, m: F.struct(
        x["start"].alias("start"), F.lit(ORDER[kind]).alias("ord"), (x["start"] + x["size"]).alias("stop"),
        F.lit(kind).alias("kind"), x["value"].alias("value"), m.alias("measured")))
    rows = F.filter(rows, lambda r: r["measured"] >= least)
    none = F.array().cast("array<struct<start:int,ord:int,stop:int,kind:string,value:string,measured:int>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _pairs(value: Column) -> Column:
    """Codes of neighbouring characters of an ASCII string."""
    codes = F.transform(F.split(value, ""), F.ascii)
    last = F.greatest(F.char_length(value) - 2, F.lit(0))
    return _once(codes, lambda c: F.transform(F.sequence(F.lit(0), last), lambda i: F.get(c, i) * _CHARS + F.coalesce(F.get(c, i + 1), F.lit(0))))


def random_samples(spark: SparkSession, count: int = RANDOM_SAMPLES) -> DataFrame:
    """``value``: strings labelled random, from digests: hexadecimal, base 64, capitals and digits."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    capitals = F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))
    kinds = F.array(F.substring(digest, 1, 40), base64, capitals)
    return spark.range(count).select(F.get(kinds, (F.col("id") % 3).cast("int")).alias("value"))


def ordinary_samples(docs: DataFrame, documents: int = WORD_DOCUMENTS) -> DataFrame:
    """``value``: words labelled ordinary, as they stand and joined to identifiers.

    Words with a digit or of a base pattern are not taken.
    """
    chosen = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("chosen_id")).distinct()
    chosen = chosen.orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(documents)
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("text")
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: ~w.rlike(f"(?i){HEX}"))
    near = lambda i, j: F.coalesce(F.get("words", i + j), F.lit("value"))
    names = F.transform("words", lambda w, i: F.element_at(F.array(
        w, F.concat_ws("_", F.lower(w), F.lower(near(i, 1))), F.concat(w, F.initcap(near(i, 1)), F.initcap(near(i, 2))),
        F.concat_ws("-", F.lower(w), F.lower(near(i, 1)), F.lower(near(i, 2))), F.concat_ws("/", w, near(i, 1)),
        F.concat(F.upper(w), F.lit("_"), F.upper(near(i, 1))), F.concat(w, F.lit("_2024"))), i % 7 + 1))
    return texts.select(words.alias("words")).select(F.explode_outer(names).alias("value"))


def fit_models(docs: DataFrame) -> list[float]:
    """Log ratio of the two chains' transitions, ``128 * first + second``; add-half smoothing."""
    spark = docs.sparkSession
    both = random_samples(spark).select(F.lit(1).alias("random"), "value").unionByName(
        ordinary_samples(docs).select(F.lit(0).alias("random"), "value"))
    pairs = both.where("char_length(value) > 1").select("random", F.explode_outer(_pairs(F.col("value"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).where("pair is not null").collect()}
    ratio = [0.0] * (_CHARS * _CHARS)
    letters = [c for c in range(_CHARS) if chr(c).isalnum() or chr(c) in "+/_=-"]
    for a in letters:
        totals = [sum(counts.get((k, a * _CHARS + b), 0) for b in letters) + len(letters) / 2 for k in (0, 1)]
        for b in letters:
            ordinary, rand = ((counts.get((k, a * _CHARS + b), 0) + 0.5) / totals[k] for k in (0, 1))
            ratio[a * _CHARS + b] = math.log(rand / ordinary)
    return ratio


def secret_scan(docs: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, findings`` for every row of ``docs``.

    ``findings`` is an array of ``start, ord, stop, kind, value`` sorted by start and kind;
    kind ``random`` is the models' and never overlaps another finding. Null text counts as
    empty. Repeated rows and repeated or null ids each get their own row. Other columns are
    not read. An empty table gives an empty result.
    """
    ratio = fit_models(docs)
    model = F.split(F.lit(",".join(f"{r:.4f}" for r in ratio)), ",").cast("array<double>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select(
        "doc_id", _spans(text, ASSIGN, "assign", 2, ASSIGN_LEAST).alias("assign"), _spans(text, ACCESS, "access").alias("access"),
        _spans(text, HEX, "hex").alias("hex"), _spans(text, RUN, "random").alias("runs"),
    )
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    score = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda s, p: s + F.get(model, p))
    apart = lambda r, spans: ~F.exists(spans, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))
    # Runs come in order, so a part of them meets only the base spans between its ends.
    near = lambda part: F.filter("base", lambda b: (b["stop"] > part[0]["start"]) & (b["start"] < F.element_at(part, -1)["stop"]))
    alone = lambda part: _once(near(part), lambda spans: F.filter(part, lambda r: apart(r, spans)))
    free = F.when(F.size("runs") > 0, F.flatten(F.transform(_parts(F.col("runs")), alone))).otherwise(F.col("runs"))
    likely = F.filter(free, lambda r: score(r["value"]) >= least_ratio)
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        "base", F.sort_array(F.concat("base", likely)).alias("findings"),
    )


def span_list(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
