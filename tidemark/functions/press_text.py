"""Sentences and extractive summaries of article bodies, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import chain, cut, strip
from tidemark.rules import press as fixed


def sentences(text: Column, ends: str = fixed.SENTENCE_ENDS) -> Column:
    """Trimmed sentences with their end mark; a tail without one is a sentence too."""
    found = F.regexp_extract_all(text, F.lit(rf"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def key_sentences(
    parts: Column, category: Column, keywords: dict[str, list[str]] | None = None
) -> Column:
    """Sentences holding any keyword of the category, in order."""
    words = fixed.SUMMARY_KEYWORDS if keywords is None else keywords
    none = F.array().cast("array<string>")
    of_category = chain(
        [(category == name, F.array(*[F.lit(w) for w in each])) for name, each in words.items() if each], none
    )
    return F.filter(parts, lambda s: F.exists(of_category, lambda w: F.contains(s, w)))


def cut_at_sentence(text: Column, length: int, ends: str = fixed.SENTENCE_ENDS) -> Column:
    """At most ``length`` characters, up to the last sentence end inside when there is one."""
    head = cut(text, length)
    whole = F.regexp_extract(head, rf"(?s)^.*[{ends}]", 0)
    return F.when(F.length(text) <= length, text).when(whole != "", whole).otherwise(head)


def add_press_summary(
    articles: DataFrame,
    body: str = "body_text",
    category: str = "relevance_category",
    name: str = "summary",
    keywords: dict[str, list[str]] | None = None,
    ends: str = fixed.SENTENCE_ENDS,
    least: int = fixed.SUMMARY_MIN,
    most: int = fixed.SUMMARY_MAX,
) -> DataFrame:
    """Adds lead sentence plus key sentences within ``most`` characters, padded to ``least``.

    The sentences are split in a column of their own, so the folds below read an array
    instead of running the pattern again for every sentence.
    """
    state = lambda t, d: F.struct(t.alias("text"), d.alias("done"))
    data = articles.withColumn("_text", F.coalesce(strip(F.col(body)), F.lit("")))
    data = data.withColumn("_parts", F.when(F.length("_text") > most, sentences(F.col("_text"), ends)))
    data = data.withColumn("_lead", F.get("_parts", F.lit(0)))
    data = data.withColumn(
        "_keys", key_sentences(F.col("_parts"), F.coalesce(F.col(category), F.lit("other")), keywords)
    )

    def add_key(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["text"], s)
        return (
            F.when(acc["done"] | (s == F.col("_lead")), acc)
            .when(F.length(longer) <= most, state(longer, F.lit(False)))
            .otherwise(state(acc["text"], F.lit(True)))
        )

    def pad(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["text"], s)
        return (
            F.when(acc["done"] | F.contains(acc["text"], s), acc)
            .when(F.length(longer) <= most, state(longer, F.length(longer) >= least))
            .otherwise(state(cut_at_sentence(longer, most, ends), F.lit(True)))
        )

    data = data.withColumn("_keyed", F.aggregate("_keys", state(F.col("_lead"), F.lit(False)), add_key)["text"])
    rest = F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))
    padded = F.aggregate(rest, state(F.col("_keyed"), F.length("_keyed") >= least), pad)["text"]
    summary = (
        F.when(F.length("_text") <= most, F.col("_text"))
        .when(F.length("_lead") > most, cut_at_sentence(F.col("_lead"), most, ends))
        .otherwise(padded)
    )
    return data.withColumn(name, summary).drop("_text", "_parts", "_lead", "_keys", "_keyed")
