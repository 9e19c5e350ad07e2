"""The registered queries of this package, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    grid_join, html_text, language, line_windows, periodic_runs, quality, secrets, sentencepiece_fst, simhash, substrings, tiling, token_counts,
    turn_repair,
)
from tidemark.llm.shared import table


def tokenizer_path(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.without_repeated_lines(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        sha256(secrets.span_list(F.col("base"))).alias("base_sha256"), secrets.span_list(F.col("findings")).alias("spans"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damaged(conversations), conversations)


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_sentencepiece, op3_quality, op4_html, op5_line_windows, op6_secrets, op7_language, op8_substrings,
        op9_token_counts, op10_tiling, op11_conversations, op12_embeddings, op13_periodic,
    )
}

#: Numbered lines with a word, windows of three, and the first place of each window.
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS rows FROM documents
), held AS (
  SELECT doc_id, u.line, u.pos, row_number() OVER (PARTITION BY doc_id ORDER BY u.pos) AS place
  FROM lines, LATERAL (SELECT unnest(rows) AS line, generate_subscripts(rows, 1) AS pos) u
  WHERE regexp_matches(u.line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, place, [line, lead(line) OVER w, lead(line, 2) OVER w] AS run, lead(place, 2) OVER w AS third
  FROM held WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS nth FROM windows WHERE third IS NOT NULL
), gone AS (
  SELECT DISTINCT h.doc_id, h.pos FROM held h JOIN ranked r ON h.doc_id = r.doc_id AND h.place BETWEEN r.place AND r.place + 2 WHERE r.nth > 1
), numbered AS (
  SELECT doc_id, u.line, u.pos FROM lines, LATERAL (SELECT unnest(rows) AS line, generate_subscripts(rows, 1) AS pos) u
), kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) AS text
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.rows), 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN x.n IS NULL THEN l.text ELSE coalesce(k.text, '') END AS text
FROM lines l LEFT JOIN lost x ON l.doc_id = x.doc_id LEFT JOIN kept k ON l.doc_id = k.doc_id
"""

#: Every 20-word window, its first place, and the words under windows that are not first.
OP8_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, u.pos, words[u.pos : u.pos + 19] AS run
  FROM texts, LATERAL (SELECT unnest(generate_series(1, len(words) - 19)) AS pos) u WHERE len(words) >= 20
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, u.pos FROM (SELECT doc_id, pos FROM ranked WHERE nth > 1) r,
    LATERAL (SELECT unnest(generate_series(r.pos, r.pos + 19)) AS pos) u
), words AS (
  SELECT doc_id, u.word, u.pos FROM texts, LATERAL (SELECT unnest(words) AS word, generate_subscripts(words, 1) AS pos) u
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS text, count(*) AS n
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, CAST(len(t.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""

ORACLES = {"op5_line_windows": OP5_SQL, "op8_substrings": OP8_SQL}
