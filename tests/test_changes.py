"""Pairing, status, line diff, summaries, scoring."""

import collections
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import alignment
from tidemark.functions.ordered import with_last_known, with_last_two, with_previous
from tidemark.operators import change_summary, diff, scoring, snapshots


def test_look_back_equals_plain_windows_with_a_hot_key(spark):
    random.seed(5)
    rows = [(i, "hot" if random.random() < 0.5 else f"k{random.randint(0, 9)}", random.randint(0, 400), random.choice([None, "v%d" % i])) for i in range(600)]
    data = spark.createDataFrame(rows, "id int, k string, t int, v string")
    order = Window.partitionBy("k").orderBy("t", "id")
    want = {r.id: (r.p, r.l) for r in data.select(
        "id", F.lag("id").over(order).alias("p"), F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("l")
    ).collect()}
    seg = F.floor(F.col("t") / 20)
    prev = {r.id: r.p for r in with_previous(data, ["k"], ["t", "id"], ["id"], seg).select("id", F.col("prev.id").alias("p")).collect()}
    last = {r.id: r.last_known for r in with_last_known(data, ["k"], ["t", "id"], F.col("v"), seg).collect()}
    assert {i: (prev[i], last[i]) for i in want} == want
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    two = {r.id: (r.v or [])[-2:][::-1] for r in data.select("id", F.collect_list("v").over(earlier).alias("v")).collect()}
    got = {r.id: [x for x in (r.last_known, r.one_before) if x] for r in with_last_two(data, ["k"], ["t", "id"], F.col("v"), seg).collect()}
    assert got == two


def test_status_flow(spark):
    rows = [
        (1, "a", 1, "h1", 100, "v2"), (2, "a", 2, "h1", 100, "v2"), (3, "a", 3, "h2", 100, "v2"), (4, "a", 4, "h3", 9, "v2"),
        (5, "b", 1, "h1", 100, "v1"), (6, "b", 2, "h2", 100, "v2"), (7, "b", 3, "h2", 100, "v2"),
    ]
    data = spark.createDataFrame(rows, "capture_id int, page_id string, captured_at int, dom_hash string, norm_length int, norm_version string")
    paired = snapshots.pair_snapshots(data, segment=F.col("captured_at") % 1)
    got = {r.capture_id: (r.status, r.differs) for r in snapshots.comparison_status(paired).collect()}
    assert got == {
        1: ("first_scan", False), 2: ("ok", False), 3: ("ok", True), 4: ("rendering_failure", False),
        5: ("first_scan", False), 6: ("baseline_reset", False), 7: ("ok", False),
    }


def test_structure_links(spark):
    saved = spark.createDataFrame(
        [("p", "s1", "2024-01-01 00:00:00"), ("p", "s2", "2024-01-05 06:00:00")], "page_id string, structure_id string, t string"
    ).withColumn("captured_at", F.to_timestamp("t"))
    changed = spark.createDataFrame(
        [("p", "c1", "2024-01-05 06:00:10"), ("p", "c2", "2024-01-06 06:00:10"), ("q", "c3", "2024-01-06 06:00:10")],
        "page_id string, change_id string, t string",
    ).withColumn("detected_at", F.to_timestamp("t"))
    got = {r.change_id: (r.structure_before_id, r.structure_after_id) for r in snapshots.link_structures(changed, saved).collect()}
    assert got == {"c1": ("s1", "s2"), "c2": (None, None), "c3": (None, None)}


def test_line_diff_against_brute_force(spark):
    random.seed(9)
    texts = [[random.choice("abcdefgh") * random.randint(1, 2) for _ in range(random.randint(1, 80))] for _ in range(40)]
    lines = spark.createDataFrame(list(enumerate(texts)), "capture_id int, norm_lines array<string>")
    pairs = [(i, i - 1, i) for i in range(1, 40)]
    frame = spark.createDataFrame(pairs, "pair_id int, old_id int, new_id int")
    got = {r.pair_id: (r.additions, r.deletions) for r in diff.diff_totals(diff.line_changes(frame, lines)).collect()}
    for pair, old, new in pairs:
        before, after = collections.Counter(texts[old]), collections.Counter(texts[new])
        assert got[pair] == (sum((after - before).values()), sum((before - after).values()))
        assert got[pair][0] - got[pair][1] == len(texts[new]) - len(texts[old])


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(now[-1], row[j + 1]))
        row = now
    return row[-1]


def carried_out(old, text):
    """The old lines with a unified diff carried out; fails where a header or line does not fit."""
    out, at = [], 0
    for line in text.split("\n")[2:] if text else []:
        if line.startswith("@@"):
            start, size, there, length = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@$", line).groups()
            base = int(start) - (size != "0")
            out, at = out + old[at:base], base
            assert len(out) == int(there) - (length != "0")
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert old[at] == line[1:]
            out += [old[at]] * (line[0] == " ")
            at += 1
    return out + old[at:]


def test_alignment():
    dice = random.Random(4)
    for k in range(1500):
        old = [dice.choice("abcdefghij"[: dice.randint(1, 10)]) for _ in range(dice.randint(0, 40))]
        new = list(old) if k % 3 else [dice.choice("abc") for _ in range(dice.randint(0, 30))]
        for _ in range(dice.randint(0, 8)):
            if new and dice.random() < 0.5:
                new.pop(dice.randrange(len(new)))
            else:
                new.insert(dice.randint(0, len(new)), dice.choice("abcxyz"))
        added, gone, text = alignment.unified(old, new, dice.randint(0, 4))
        assert carried_out(old, text) == new and len(old) + added - gone == len(new) and (text == "") == (old == new)
        a, b = dice.sample(range(60), dice.randint(0, 50)), dice.sample(range(60), dice.randint(0, 50))
        assert len(alignment.matches(a, b)) == common_length(a, b)
    lines = [str(k) for k in range(20)]
    assert alignment.unified(lines, lines[:9] + ["x"] + lines[10:])[2].split("\n")[2:4] == ["@@ -7,7 +7,7 @@", " 6"]
    assert alignment.unified([], ["a"])[2] == "--- before\n+++ after\n@@ -0,0 +1 @@\n+a"
    assert alignment.unified(["a", "b"], [])[2] == "--- before\n+++ after\n@@ -1,2 +0,0 @@\n-a\n-b"


def test_unified_diffs(spark):
    dice = random.Random(6)
    texts = [[dice.choice(["", "a", "b", "++c", "--d", "@@ e", "wide 後"]) + str(dice.randint(0, 2)) for _ in range(dice.randint(0, 60))] for _ in range(30)]
    texts[7] = texts[6]
    lines = spark.createDataFrame([*enumerate(texts), (30, None)], "capture_id int, norm_lines array<string>")
    pairs = spark.createDataFrame([(i, i - 1, i) for i in range(1, 31)] + [(99, 1, 98)], "pair_id int, old_id int, new_id int")
    diffs = diff.unified_diffs(pairs, lines)
    got = {r.pair_id: r for r in diffs.collect()}
    sides = {i: (texts[i - 1], texts[i] if i < 30 else []) for i in range(1, 31)}
    assert set(got) == {i for i, (old, new) in sides.items() if old != new} and 7 not in got
    for i, r in got.items():
        assert carried_out(sides[i][0], r.unified_text) == sides[i][1]
    olds = pairs.filter("pair_id < 90").join(lines.withColumnRenamed("capture_id", "old_id"), "old_id")
    assert {r.pair_id: r.lines for r in diff.apply_unified(olds, diffs).collect()} == {i: new for i, (_, new) in sides.items()}
    assert diff.unified_diffs(pairs.filter("false"), lines).count() == 0


def test_read_back(spark):
    old, new = [f"l{i}" for i in range(30)], [f"l{i}" for i in range(30) if i != 4] + ["end"]
    lines = spark.createDataFrame([(0, old), (1, new)], "capture_id int, norm_lines array<string>")
    pairs = spark.createDataFrame([(5, 0, 1)], "pair_id int, old_id int, new_id int")
    rows = diff.fold_context(diff.read_unified(diff.unified_diffs(pairs, lines), "pair_id", "unified_text"), "pair_id").orderBy("line_no").collect()
    assert [r.type for r in rows].count("header") == 2 and [r.content for r in rows if r.type == "remove"] == ["l4"]
    assert all(new[r.new_line - 1] == r.content for r in rows if r.new_line)


def test_partial_render_gate(spark):
    base = [f"l{i}" for i in range(100)]
    texts = [base, base[:98], base[:97], base + ["n1", "n2"], ["x"] + base[1:99], base]
    lines = spark.createDataFrame(list(enumerate(texts)), "capture_id int, norm_lines array<string>")
    pairs = spark.createDataFrame([(i, 0, i) for i in range(1, 6)], "pair_id int, old_id int, new_id int")
    rows = {r.pair_id: r for r in diff.compute_diffs(pairs, lines).collect()}
    assert set(rows) == {2, 4}
    assert rows[4].added == ["x"] and rows[4].removed == ["l0", "l99"] and rows[4].diff_text.split("\n")[0] == "-l0"


def test_read_and_fold(spark):
    text = "\n".join([" c%d" % i for i in range(6)] + ["+a", "-b"] + [" d%d" % i for i in range(6)] + ["@@ -1 +40,2 @@", " e", "+f"])
    rows = diff.fold_context(diff.read_unified(spark.createDataFrame([(1, "--- x\n+++ y\n" + text)], "change_id int, diff_text string"))).orderBy("line_no").collect()
    assert [r.fold for r in rows] == ["hidden"] * 2 + ["collapsed"] * 2 + ["shown"] * 2 + ["shown"] * 2 + ["shown"] * 2 + ["collapsed"] * 2 + ["shown"] * 2 + ["shown"] * 3
    assert [r.new_line for r in rows][-2:] == [40, 41] and rows[6].new_line == 7 and rows[7].new_line is None


def test_summaries(spark):
    cases = [
        (['<a href="x">New</a>', "<h1>T2</h1>"], ["<a>Old</a>", "<h1>T1</h1>"], "・リンクテキスト変更:「Old」→「New」\n・大見出し(H1)テキスト変更:「T1」→「T2」"),
        (["<label>A1</label>", "<label>B1</label>", "<label>C1</label>", "<label>D1</label>"], [], "・ラベル追加:「A1」\n・ラベル追加:「B1」\n・ラベル追加:「C1」\n・他1件の変更"),
        ([], ['<nav id="main-nav">'], "・ナビゲーションが削除 [main-nav]"),
        (['<div class="carousel wide-one">'] * 3, ['<div class="carousel">'], "・カルーセル/スライダーが追加 (+2) [carousel]"),
        (['<p aria-a="1">', '<p role="b">', '<p aria-c="1">'], [], "・アクセシビリティ属性（aria/role）が追加"),
        (["<button>[TEXT]</button>"], [], "ボタン周辺の構造変更（1行）— 詳細はDOM差分を参照"),
        (["xyz"], ["q"], "DOM構造の変更（2行）— 詳細はDOM差分を参照"), ([], [], "DOM構造に変更を検知"),
        ([f"<th>H{i}x</th><label>L{i}y</label><legend>G{i}z</legend>" for i in range(3)], [], None),
    ]
    data = spark.createDataFrame([(i, a, r) for i, (a, r, _) in enumerate(cases)], "id int, added array<string>, removed array<string>")
    got = {r.id: r.summary for r in change_summary.summarise_changes(data).collect()}
    for i, (_, _, want) in enumerate(cases):
        if want is not None:
            assert got[i] == want
    assert got[8].count("\n") == 8 and got[8].endswith("・他1件の変更")


def test_change_category(spark):
    cases = [
        ("<form><input> banner", "CRO", 0.4), ("x", "OTHER", 0.3), ("canonical hreflang", "SEO", 0.5),
        ("form input submit select form", "CRO", 0.6), ("gpt llm ai-x", "AI", 0.75),
    ]
    data = spark.createDataFrame([(t,) for t, *_ in cases], "t string")
    got = {r.t: (r.category, r.confidence) for r in scoring.classify_changes(data, "t").collect()}
    assert got == {t: (c, v) for t, c, v in cases}


def test_advice_stub(spark):
    data = spark.createDataFrame([(1, "CRO", "s" * 300), (2, "OTHER", None)], "change_id int, category string, summary string")
    got = {r.change_id: r for r in scoring.advice_stub(data).collect()}
    assert got[1].priority == "high" and len(got[1].summary) == 300 and got[2].priority == "low" and got[2].summary == "変更を検知しました"


def test_all_changes(spark):
    heads = [f"<h2>Heading {i} {'x' * 40}</h2>" for i in range(40)]
    mixed = [f"<h3>L{i}x</h3><h4>M{i}x</h4><label>N{i}x</label>" for i in range(4)]
    cases = [(1, heads, []), (2, mixed, []), (3, ["<a>New1</a>", "<a>Same</a>"], ["<a>Old1</a>", "<a>Same</a>", "<a>Old2</a>"])]
    data = spark.createDataFrame(cases, "id int, added array<string>, removed array<string>")
    got = {r.id: r for r in change_summary.summarise_changes(data).collect()}
    assert len(got[1].summary_items) == 40 and all("x" * 40 in x for x in got[1].summary_items)
    assert len(got[2].summary_items) == 12 and got[2].summary.endswith("・他4件の変更")
    assert got[3].summary_items == ["リンクテキスト変更:「Old1」→「New1」", "リンク削除:「Old2」"]
    assert got[1].summary.endswith("・他37件の変更")


def test_every_copy_and_name_is_an_item(spark):
    fields = [f'<input name="field-number-{i}">' for i in range(9)]
    cases = [
        (1, ["<button>Buy</button>"] * 2, ["<button>Buy</button>"]), (2, ["<button>Buy</button>"] * 3, []), (3, ["<a>X1</a>", "<a>X1</a>"], ["<a>X1</a>", "<a>Y1</a>"]),
        (4, fields, []), (5, ["<form>"] + [f"<button>Press button {i} {'y' * 30}</button>" for i in range(6)], []),
    ]
    data = spark.createDataFrame(cases, "id int, added array<string>, removed array<string>")
    got = {r.id: r for r in change_summary.summarise_changes(data).collect()}
    items = lambda i, word: [x for x in got[i].summary_items if word in x]
    assert items(1, "ボタン追加") == ["ボタン追加:「Buy」"] and items(2, "ボタン追加") == ["ボタン追加:「Buy」"] * 3
    assert items(3, "リンク") == ["リンクテキスト変更:「Y1」→「X1」"]
    assert all(f"「field-number-{i}」" in items(4, "フィールド")[0] for i in range(9)) and "など9項目" in got[4].summary
    assert len(items(5, "ボタン追加")) == 6 and any(x.startswith("フォームが新規追加 [") and x.count("y" * 30) == 6 for x in got[5].summary_items)


def test_keyword_borders_in_any_script(spark):
    data = spark.createDataFrame([(1, "ボタンform form"), (2, "検索form"), (3, "form"), (4, None)], "id int, t string")
    rows = data.select("id", change_summary.keyword_counts(F.col("t"), ["form"]).alias("k")).collect()
    assert {r.id: [(k.keyword, k.n) for k in r.k or []] for r in rows} == {1: [("form", 1)], 2: [("form", 1)], 3: [("form", 1)], 4: []}
