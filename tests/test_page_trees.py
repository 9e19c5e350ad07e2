"""Page trees, findings of round 3."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.tokens import element_nodes, spanned_tokens, token_table


def test_page_trees_equal_the_windowed_spans(spark):
    """ends, depth and texts of the page arrays on broken markup, against windows over token rows."""
    random.seed(5)
    bits = [f"<{t}>" for t in "div p ul li table tr td b a span form label option x-y".split()]
    bits += [b.replace("<", "</") for b in bits] + ["<br>", "<img>", "t ", " ", "&nbsp;", "<!-- c -->", "<script>x</script>", "u"]
    pages = spark.createDataFrame(
        [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "")],
        "capture_id long, html string",
    ).repartition(3)
    spans = spanned_tokens(token_table(pages)).cache()
    starts = spans.filter("kind = 'open'").select("capture_id", F.col("idx").alias("s"), F.col("cover_end").alias("e"))
    nodes = spans.filter("kind IN ('open', 'void')").select("capture_id", "idx", "end_idx", "texts_before", "texts_end")
    over = (F.col("s") < F.col("idx")) & (F.col("e") > F.col("idx"))
    depth = nodes.join(starts, "capture_id", "left").groupBy("capture_id", "idx").agg((F.count_if(over) + 1).cast("int").alias("depth"))
    want = {tuple(r) for r in nodes.join(depth, ["capture_id", "idx"]).collect()}
    found = element_nodes(pages, levels=1).filter("kind <> 'text'")
    got = {tuple(r) for r in found.select("capture_id", "idx", "end_idx", "texts_before", "texts_end", "depth").collect()}
    assert want and got == want
    # The parent is the last element one level up.
    before = Window.partitionBy("capture_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.select("capture_id", "idx", "kind", "depth", "up_1.idx", F.collect_list(F.struct("idx", "depth", "kind")).over(before).alias("all"))
    for _, _, _, level, parent, earlier in rows.collect():
        above = [e.idx for e in earlier if e.depth == level - 1 and e.kind == "open"]
        assert parent == (above[-1] if above else None)


def test_element_nodes_add_no_window(spark):
    """ends and parents take no sort over token rows, only the whole pages are exchanged."""
    pages = spark.createDataFrame([(1, "<p>a</p>")], "capture_id long, html string")
    plan = element_nodes(pages, levels=3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1
