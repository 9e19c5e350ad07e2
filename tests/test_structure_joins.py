"""Page structures: joins of parts far larger than the table that the pages come from, pages without markup."""

from pyspark.sql import functions as F

from tidemark.plans.markup_queries import QUERIES
from tidemark.plans.structure_scan import structure_documents

PAGE = '<body><header><a href="tel:1">Call</a></header><main class="container"><form action="/buy"><input name="a" required></form></main></body>'


def test_parts_of_structure_documents_are_not_broadcast(spark):
    pages = spark.createDataFrame([(1, "p", PAGE), (2, "p", PAGE), (2, "p", PAGE), (3, "q", "text"), (None, None, PAGE), (4, None, None)], "capture_id long, page_id string, html string")
    docs = structure_documents(pages.withColumn("captured_at", F.timestamp_seconds("capture_id")))
    found = sorted((r["id"] or 0, r["summary"]["component_count"], len(r["cv_points"]), len(r["forms"])) for r in docs.collect())
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert [x[0] for x in found] == [0, 1, 2, 2, 3, 4]
    assert found[1][1:] == (2, 1, 1) and found[4][1:] == found[5][1:] == found[0][1:] == (0, 0, 0)
    assert "Broadcast" not in plan


def test_page_without_markup_has_a_row(spark, tmp_path):
    rows = [(1, "AUTO"), (2, None)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r["id"]: r for r in QUERIES["page_structure_full"](spark, str(tmp_path)).collect()}
    assert (found[1]["section_count"], found[1]["main_components"], found[1]["form_action"], found[1]["form_fields"]) == (2, 6, "/buy/1", 4)
    assert (found[2]["section_count"], found[2]["component_count"], found[2]["section_types"], found[2]["points"]) == (0, 0, "", "")
    assert [found[2][c] for c in ("main_components", "form_action", "form_fields", "field_types")] == [None] * 4
