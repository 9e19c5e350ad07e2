"""Sources, sinks, streams and argument checks."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintenance, reads
from tidemark.sources import tables


def stamps(frame, *columns):
    for c in columns:
        frame = frame.withColumn(c, F.to_timestamp(c))
    return frame


def test_append_and_read_back(spark, tmp_path):
    rows = stamps(spark.createDataFrame(
        [("c1", "p", "h", "t", 1, "v2", "2024-01-01 00:00:00"), ("c2", "p", "h", "t", 1, "v2", "2024-01-02 00:00:00")],
        "capture_id string, page_id string, dom_hash string, norm_text string, norm_length int, norm_version string, captured_at string",
    ), "captured_at")
    path = str(tmp_path / "snapshot")
    tables.append_snapshots(rows, path)
    tables.append_snapshots(rows.withColumn("capture_id", F.concat("capture_id", F.lit("x"))), path)
    assert tables.read_table(spark, str(tmp_path), "snapshot").count() == 4
    assert {r.captured_on.isoformat() for r in spark.read.parquet(path).select("captured_on").distinct().collect()} == {"2024-01-01", "2024-01-02"}


def test_structures_are_kept_on_change(spark):
    make = lambda rows: stamps(spark.createDataFrame(rows, "id string, page_id string, hash string, captured_at string"), "captured_at")
    stored = make([("s1", "p", "a", "2024-01-01 00:00:00"), ("s2", "p", "b", "2024-01-02 00:00:00")])
    arriving = make([("n1", "p", "b", "2024-01-03 00:00:00"), ("n2", "p", "c", "2024-01-04 00:00:00"), ("n3", "q", "c", "2024-01-04 00:00:00"), ("n4", "q", "c", "2024-01-05 00:00:00")])
    assert {r.id for r in tables.changed_structures(arriving, stored).collect()} == {"n2", "n3"}


def test_versions_are_never_overwritten(spark, tmp_path):
    path = tables.write_version(spark.range(3), str(tmp_path), 1)
    with pytest.raises(Exception):
        tables.write_version(spark.range(4), str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 3


def test_argument_checks(spark):
    articles = spark.createDataFrame([], "id int, source_id int, title string, article_url string, published_at timestamp, relevance_category string, summary string, deleted_at timestamp")
    sources = spark.createDataFrame([(1, "s", None)], "id int, name string, deleted_at timestamp")
    for bad in ({"date_from": "2024-1-1"}, {"date_to": "2024-02-31"}, {"source_name": "nope"}, {"limit": 0}):
        with pytest.raises(reads.ArgumentError):
            reads.press_articles_between(articles, sources, **bad)
    with pytest.raises(reads.ArgumentError):
        reads.latest_press_articles(articles, sources, "s", 51)
    assert reads.press_articles_between(articles, sources, "s", "2024-01-01", "2024-01-31").count() == 0


def test_partial_validation(spark):
    rows = spark.createDataFrame([(1, None, "bad url"), (2, "ok-name", None), (3, "no_good", None)], "id int, name string, url string")
    full = {r.id: [e.field for e in r.errors] for r in maintenance.validate_press_sources(rows).collect()}
    part = {r.id: [e.field for e in r.errors] for r in maintenance.validate_press_sources(rows, partial=True).collect()}
    assert full == {1: ["name", "url"], 2: ["url"], 3: ["name", "url"]} and part == {1: ["url"], 2: [], 3: ["name"]}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    from tidemark.streaming.scan_stream import latest_statuses, scan_batch

    rows = spark.createDataFrame(
        [(1, "p", "<a>one</a>"), (2, "p", "<a>two</a>"), (4, "p", "<a>two</a>")], "capture_id int, page_id string, html string"
    )
    late = spark.createDataFrame([(3, "p", "<a>three</a>")], rows.schema)
    root, args = str(tmp_path), (("capture_id",), F.col("capture_id") % 1)
    scan_batch(rows, 0, root, *args)
    before = {r.capture_id: (r.status, r.differs) for r in latest_statuses(spark, root).collect()}
    assert before == {1: ("first_scan", False), 2: ("ok", True), 4: ("ok", False)}
    for _ in range(2):
        scan_batch(late, 1, root, *args)
        after = {r.capture_id: (r.status, r.differs) for r in latest_statuses(spark, root).collect()}
        assert after == {1: ("first_scan", False), 2: ("ok", True), 3: ("ok", True), 4: ("ok", True)}


def test_redelivered_capture_replaces_its_lines_and_its_change(spark, tmp_path):
    from tidemark.streaming.scan_stream import latest_changes, scan_batch

    page = lambda *words: "".join(f"<h2>{w}</h2>" for w in words)
    rows = spark.createDataFrame(
        [(1, "p", page("a", "b")), (2, "p", page("a", "c", "d"))], "capture_id int, page_id string, html string"
    )
    root, args = str(tmp_path), (("capture_id",), F.col("capture_id") % 1)
    show = lambda: [(r.pair_id, r.additions, r.deletions, r.old_lines, r.new_lines) for r in latest_changes(spark, root).collect()]
    scan_batch(rows, 0, root, *args)
    first = show()
    assert [r[0] for r in first] == [2] and first[0][1:3] == (2, 1)
    scan_batch(rows.filter("capture_id = 2"), 1, root, *args)
    assert show() == first
    # Twice in one batch, then with the body of the capture before.
    again = rows.filter("capture_id = 2")
    scan_batch(again.unionByName(again), 2, root, *args)
    assert show() == first
    scan_batch(spark.createDataFrame([(2, "p", page("a", "b"))], rows.schema), 3, root, *args)
    assert show() == []


def test_batches_and_merges_end_where_one_batch_ends(spark, tmp_path):
    from tidemark.streaming.scan_stream import latest_changes, latest_statuses, merge_snapshots, scan_batch, snapshots_before

    shape = "capture_id int, page_id string, html string"
    page = lambda *words: "".join(f"<h2>{w}</h2>" for w in words)
    make = lambda rows: spark.createDataFrame([(i, p, page(*w)) for i, p, w in rows], shape)
    first = [(10 * i + j, f"p{i}", "abc"[: 1 + j]) for i in range(6) for j in (1, 2)] + [(900, None, "ab"), (901, None, "ad")]
    late, corrected, same = (25, "p2", "xyz"), (11, "p1", "abq"), (31, "p3", "ab")
    last = [(13, "p1", "abc"), (26, "p2", "xy"), (902, None, "ad")]
    args = (("capture_id",), F.col("capture_id") % 1)
    steps, whole = str(tmp_path / "steps"), str(tmp_path / "whole")
    for batch, rows in enumerate([first, [late, same, corrected], [(20, "p2", "k"), *last]]):
        scan_batch(make(rows), batch, steps, *args)
        if batch == 1:
            merge_snapshots(spark, steps, batch)
    final = {r[0]: r for r in [*first, late, same, corrected, (20, "p2", "k"), *last]}
    scan_batch(make(list(final.values())), 0, whole, *args)
    shown = lambda root: (
        sorted((r.capture_id, r.page_id or "", r.status, r.differs, r.dom_hash, r.prev_id or 0) for r in latest_statuses(spark, root).collect()),
        sorted((r.pair_id, r.additions, r.deletions, r.diff_text, r.summary, r.category) for r in latest_changes(spark, root).collect()),
    )
    assert shown(steps) == shown(whole) and len(shown(whole)[0]) == len(final) and len(shown(whole)[1]) > 6
    stored = spark.read.parquet(f"{steps}/snapshots/batch_id=2")
    asked = [r.bucket for r in stored.select("bucket").distinct().collect()]
    before = snapshots_before(spark, steps, 2, stored.schema, asked)
    assert {r.page_id for r in before.collect()} == {"p1", "p2", None}
    files = {r[0].split("/merged/")[1].split("/")[0] for r in before.select(F.input_file_name()).collect()}
    assert files == {"upto=1"}


def test_structure_documents_are_stored_on_change(spark, tmp_path):
    from tidemark.plans import structure_scan

    form = '<form action="/go"><input name="a"><input type="email" name="b"><button type="submit">Send</button></form>'
    body = lambda inner: f"<html><body><main>{inner}</main></body></html>"
    rows = [
        ("c1", "p", "2024-01-01 00:00:00", body(form)), ("c2", "p", "2024-01-02 00:00:00", body(form)),
        ("c3", "p", "2024-01-03 00:00:00", body(form + '<a href="tel:1">Call</a>')), ("c4", "q", "2024-01-01 00:00:00", None),
        ("c5", "q", "2024-01-02 00:00:00", ""), ("c6", "r", "2024-01-01 00:00:00", body("<input><input><input><select></select>")),
    ]
    captures = stamps(spark.createDataFrame(rows, "capture_id string, page_id string, captured_at string, html string"), "captured_at")
    root = str(tmp_path)
    tables.append_structures(structure_scan.changed_documents(captures), f"{root}/page_structure")
    stored = tables.read_table(spark, root, "page_structure")
    got = {r.id: r for r in stored.collect()}
    assert set(got) == {"c1", "c3", "c4", "c6"}
    assert [f.total_fields for f in got["c1"].forms] == [2] and [p.type for p in got["c3"].cv_points] == ["primary_cta", "tel_cta"]
    assert got["c6"].forms[0].id == "form-implicit" and got["c1"].sections[0].components
    assert (got["c4"].sections, got["c4"].cv_points, got["c4"].forms, got["c4"].summary.section_count) == ([], [], [], 0)
    again = captures.filter("capture_id IN ('c3', 'c5')").withColumn("capture_id", F.concat("capture_id", F.lit("x"))).withColumn("captured_at", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    assert structure_scan.changed_documents(again, stored).count() == 0
    assert {r.id for r in structure_scan.changed_documents(again, stored, "own").collect()} == {"c3x", "c5x"}
