"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle_check
from test_operators import FOLDER, brute_components, brute_fingerprint, brute_lines, library_pieces, odd
from tidemark.llm import quality, queries, tiling


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert oracle_check.compare(spark, oracle_check.duck(FOLDER), FOLDER, name) is None


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "pieces"]
    quality_stage, lines_stage, near_stage, leaks_stage, pieces_stage = [f for _, f in corpus_pipeline.STAGES]

    kept = quality_stage(spark, docs, FOLDER).cache()
    verdict = rows_of(quality.quality_rules(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert kept.columns == docs.columns
    assert set(rows_of(kept)) == {i for i, r in verdict.items() if r["kept"]}

    lines = lines_stage(spark, kept, FOLDER).cache()
    expected = {i: t for i, _, n, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()]) if not n or t.split()}
    assert {i: r["text"] for i, r in rows_of(lines).items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = near_stage(spark, lines, FOLDER).cache()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in lines.collect()}
    roots = brute_components(set(prints.values()))
    smallest = {}
    for i in sorted(prints):
        smallest.setdefault(roots[prints[i]], i)
    assert set(rows_of(near)) == set(smallest.values())

    clean = leaks_stage(spark, near, FOLDER).cache()
    leaks = {r["doc_id"] for r in tiling.contaminated(near, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert leaks and set(rows_of(clean)) == set(rows_of(near)) - leaks

    library = library_pieces()
    pieces = rows_of(pieces_stage(spark, clean, FOLDER))
    assert {i: r["ids"] for i, r in pieces.items()} == {i: library.encode(r["text"]) for i, r in rows_of(clean).items()}
    assert sorted(map(str, rows_of(entry.queries()["pipeline"](spark, FOLDER)).values())) == sorted(map(str, pieces.values()))


def test_near_dedup_of_repeated_ids(spark):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    texts = [(3, b, "en"), *[(7, f"{a} {n}" * 3, "en") for n in range(3)], (7, b, "en"), (7, b, "en"), (7, b, "de"), (9, b, "en"), (None, b, "en")]
    rows = [(i, text, lang, "s", len(text)) for i, text, lang in texts]
    near_stage = corpus_pipeline.STAGES[2][1]
    prints = {t: brute_fingerprint(t) for _, t, *_ in rows}
    roots = brute_components(set(prints.values()))
    heads = len({roots[f] for f in prints.values()})
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        out = near_stage(spark, docs, FOLDER).collect()
        assert sorted((r["doc_id"] or 0, r["text"] == b) for r in out if r["text"] == b) == [(0, True), (3, True)]
        kept = [r for r in out if r["text"] != b]
        assert all(r["doc_id"] == 7 for r in kept) and len(kept) == heads - 1
        assert len({roots[prints[r["text"]]] for r in kept}) == heads - 1


def test_odd_rows(spark):
    for frame in (odd(spark), odd(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, FOLDER)
            frame.count()
