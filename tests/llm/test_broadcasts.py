"""Tables that an explode makes larger than Spark's estimate are not broadcast."""

import numpy as np

import corpus_pipeline
from tidemark.llm import simhash


def executed_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_variants_of_fingerprints_are_not_broadcast(spark):
    prints = np.random.default_rng(5).integers(-(2**63), 2**63, 4000).tolist()
    prints += [p ^ 5 for p in prints[:50]]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    pairs = {frozenset((r["a"], r["b"])) for r in found.collect()}
    assert {frozenset((p, p ^ 5)) for p in prints[:50]} <= pairs
    assert "Broadcast" not in executed_plan(found)


def test_near_dedup_of_the_pipeline_does_not_broadcast_variants(spark, monkeypatch, tmp_path):
    plans, roots = [], simhash.component_roots

    def seen(edges):
        edges.collect()
        plans.append(executed_plan(edges))
        return roots(edges)

    monkeypatch.setattr(simhash, "component_roots", seen)
    texts = [" ".join(f"w{i * j % 97}" for j in range(1, 30)) for i in range(1, 60)]
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(texts + texts[:20])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == set(range(59))
    assert len(plans) == 1 and "Broadcast" not in plans[0]
