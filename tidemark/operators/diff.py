"""Line differences of snapshot pairs, and reading of unified diff texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import alignment

# Workers get the alignment with the task; they need no copy of this package.
register_pickle_by_value(alignment)

SMALL_SHARE = 0.03


def line_changes(pairs: DataFrame, lines: DataFrame, array: str = "norm_lines") -> DataFrame:
    """Lines whose number of copies differs between the two sides of a pair.

    ``pairs``: pair_id, old_id, new_id. ``lines``: capture_id and an array of lines.
    Returns pair_id, line, old_n, new_n, old_at, new_at. Copies are counted per side in
    one aggregation (no join of lines with lines), so a line repeated on both sides
    costs one row. Moved lines keep their counts and do not appear as changes.
    """
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.col("old_id").alias("capture_id"), F.lit(0).alias("side")),
                F.struct(F.col("new_id").alias("capture_id"), F.lit(1).alias("side")),
            )
        ).alias("_s"),
    ).select("pair_id", "_s.*")
    rows = sides.join(lines.select("capture_id", array), "capture_id").select(
        "pair_id", "side", F.posexplode(array).alias("at", "line")
    )
    old, new = F.col("side") == 0, F.col("side") == 1
    return rows.groupBy("pair_id", "line").agg(
        F.count_if(old).alias("old_n"), F.count_if(new).alias("new_n"),
        F.min(F.when(old, F.col("at"))).alias("old_at"), F.min(F.when(new, F.col("at"))).alias("new_at"),
    )


def signed_lines(changes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Added (+) and removed (-) lines, one row per line with its number of copies."""
    added, removed = F.col("new_n") - F.col("old_n"), F.col("old_n") - F.col("new_n")
    differing = changes.filter(F.col("new_n") != F.col("old_n"))
    return differing.select(
        "pair_id", *keep, F.when(added > 0, "+").otherwise("-").alias("sign"), "line",
        F.greatest(added, removed).alias("copies"),
        F.when(added > 0, F.col("new_at")).otherwise(F.col("old_at")).alias("at"),
    )


def diff_totals(changes: DataFrame) -> DataFrame:
    """Per pair: additions, deletions, old_lines, new_lines."""
    gain = F.col("new_n") - F.col("old_n")
    return changes.groupBy("pair_id").agg(
        F.sum(F.greatest(gain, F.lit(0))).alias("additions"),
        F.sum(F.greatest(-gain, F.lit(0))).alias("deletions"),
        F.sum("old_n").alias("old_lines"),
        F.sum("new_n").alias("new_lines"),
    )


def moved_lines(changes: DataFrame) -> DataFrame:
    """Per pair, how many lines found on both sides changed their place among those lines."""
    shared = changes.filter((F.col("old_n") > 0) & (F.col("new_n") > 0))
    old_rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("old_at"))
    new_rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("new_at"))
    ranked = shared.select("pair_id", old_rank.alias("_o"), new_rank.alias("_n"))
    return ranked.groupBy("pair_id").agg(F.count_if(F.col("_o") != F.col("_n")).alias("moved"))


def is_partial_render(additions, deletions, old_lines, share: float = SMALL_SHARE):
    """Only deletions or only additions, below the share of the old lines."""
    total = F.greatest(old_lines, F.lit(1))
    only_gone = (additions == 0) & (deletions > 0) & (deletions / total < share)
    only_new = (deletions == 0) & (additions > 0) & (additions / total < share)
    return only_gone | only_new


def diff_texts(signed: DataFrame, first: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per pair: the signed lines in page order (the ``first`` ones, if given), as arrays and as text."""
    each = signed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    order = Window.partitionBy("pair_id").orderBy("at", F.col("sign").desc(), "line", "_copy")
    each = each.withColumn("_no", F.row_number().over(order))
    if first is not None:
        each = each.filter(F.col("_no") <= first)
    listed = F.array_sort(F.collect_list(F.struct("_no", "sign", "line")))
    out = each.groupBy("pair_id").agg(*[F.first(c).alias(c) for c in keep], listed.alias("_all"))
    of = lambda sign: F.transform(F.filter("_all", lambda x: x["sign"] == sign), lambda x: x["line"])
    text = F.array_join(F.transform("_all", lambda x: F.concat(x["sign"], x["line"])), "\n")
    return out.select("pair_id", *keep, of("+").alias("added"), of("-").alias("removed"), text.alias("diff_text"))


def compute_diffs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs with real changes: totals, added/removed line arrays and diff text.

    Totals and texts come from one pass over the counted lines of a pair.
    """
    pair = Window.partitionBy("pair_id")
    gain = F.col("new_n") - F.col("old_n")
    marked = line_changes(pairs, lines).select(
        "*", F.sum(F.greatest(gain, F.lit(0))).over(pair).alias("additions"),
        F.sum(F.greatest(-gain, F.lit(0))).over(pair).alias("deletions"),
        F.sum("old_n").over(pair).alias("old_lines"), F.sum("new_n").over(pair).alias("new_lines"),
    )
    real = marked.filter(~is_partial_render(F.col("additions"), F.col("deletions"), F.col("old_lines")))
    totals = ("additions", "deletions", "old_lines", "new_lines")
    return diff_texts(signed_lines(real, totals), keep=totals)


def unified_diffs(pairs: DataFrame, lines: DataFrame, array: str = "norm_lines", context: int = alignment.CONTEXT) -> DataFrame:
    """Per pair with a difference: line_additions, line_deletions, and unified_text with hunk headers.

    ``pairs``: pair_id, old_id, new_id. The two sides of a pair are aligned line by line, so a
    moved line counts as deleted and added, as a reader of the text sees it; ``line_changes``
    leaves such lines out. One pair is in memory at a time. A capture without lines (null)
    has none; pairs of an unknown capture are left out.
    """
    side = lambda name: lines.select(F.col("capture_id").alias(f"{name}_id"), F.coalesce(array, F.array().cast("array<string>")).alias(name))
    both = pairs.select("pair_id", "old_id", "new_id").join(side("old"), "old_id").join(side("new"), "new_id").select("pair_id", "old", "new")
    unified = alignment.unified

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                added, gone, text = unified(batch.column("old")[k].as_py(), batch.column("new")[k].as_py(), context)
                if text:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("pair_id").slice(k, 1), pa.array([added], pa.int64()), pa.array([gone], pa.int64()), pa.array([text])],
                        ["pair_id", "line_additions", "line_deletions", "unified_text"],
                    )

    kind = both.schema["pair_id"].dataType.simpleString()
    return both.mapInArrow(run, f"pair_id {kind}, line_additions long, line_deletions long, unified_text string")


def apply_unified(olds: DataFrame, diffs: DataFrame, key: str = "pair_id", array: str = "norm_lines", text: str = "unified_text") -> DataFrame:
    """``key`` and ``lines``: the old lines of each key with its unified diff carried out.

    ``olds`` has the key and the array of old lines; a key without a diff keeps its lines. The
    lines of old and diff stay rows until a key's new lines are put in order.
    """
    base = diffs.select(key, text).repartition(F.col(key))
    rows = base.select(key, F.posexplode(F.split(text, "\n")).alias("_no", "_l"))
    line = F.col("_l")
    rows = rows.withColumn("_hunk", F.count_if(line.startswith("@@")).over(Window.partitionBy(key).orderBy("_no")))
    inside = Window.partitionBy(key, "_hunk").orderBy("_no")
    header = F.first("_l").over(inside)
    start = F.regexp_extract(header, r"@@ -([0-9]+)", 1).cast("int")
    empty = F.regexp_extract(header, r"@@ -[0-9]+,([0-9]+)", 1) == "0"
    body = rows.withColumn("_before", F.when(empty, start).otherwise(start - 1)).withColumn(
        "_at", F.col("_before") + F.count_if(line.startswith("-") | line.startswith(" ")).over(inside)
    ).filter((F.col("_hunk") > 0) & ~line.startswith("@@"))
    content = F.substring(line, 2, 2_000_000_000)
    added = body.filter(line.startswith("+")).select(key, F.col("_at"), F.col("_no"), content.alias("line"))
    gone = body.filter(line.startswith("-")).select(key, (F.col("_at") - 1).alias("_row"))
    old = olds.select(key, F.posexplode(array).alias("_row", "line")).join(gone, [key, "_row"], "left_anti")
    kept = old.select(key, (F.col("_row") + 1).alias("_at"), F.lit(-1).alias("_no"), "line")
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_no", "line")))
    done = kept.unionByName(added).groupBy(key).agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    return olds.select(key).join(done, key, "left").select(key, F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def read_unified(diffs: DataFrame, key: str = "change_id", text: str = "diff_text") -> DataFrame:
    """Typed lines of a unified diff: key, line_no (in the diff), type, content, new_line."""
    base = diffs.select(key, text).repartition(F.col(key))
    rows = base.select(key, F.posexplode_outer(F.split(text, "\n")).alias("line_no", "_l"))
    line = F.col("_l")
    file_header = line.startswith("---") | line.startswith("+++")
    rows = rows.filter(line.isNotNull() & ~file_header)
    kind = (
        F.when(line.startswith("@@"), "header").when(line.startswith("+"), "add")
        .when(line.startswith("-"), "remove").otherwise("context")
    )
    rows = rows.withColumn("type", kind)
    start = F.regexp_extract(line, r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    rows = rows.withColumn("_start", F.when((F.col("type") == "header") & (start != ""), start.cast("int") - 1))
    order = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("_hunk", F.count("_start").over(order))
    in_hunk = Window.partitionBy(key, "_hunk").orderBy("line_no")
    counted = F.col("type").isin("add", "context")
    rows = rows.withColumn(
        "new_line",
        F.when(
            counted,
            F.coalesce(F.first("_start", ignorenulls=True).over(in_hunk), F.lit(0))
            + F.sum(F.when(counted, 1).otherwise(0)).over(in_hunk),
        ),
    )
    content = (
        F.when(F.col("type").isin("add", "remove"), F.substring(line, 2, 2_000_000_000))
        .when((F.col("type") == "context") & line.startswith(" "), F.substring(line, 2, 2_000_000_000))
        .otherwise(line)
    )
    return rows.select(key, "line_no", "type", content.alias("content"), F.col("new_line").cast("int"))


def fold_context(lines: DataFrame, key: str = "change_id", keep: int = 2, threshold: int = 4) -> DataFrame:
    """Adds fold: shown, collapsed (middle of a long context run) or hidden.

    A long run at the very top shows only its tail; its first lines are hidden.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    context = F.col("type") == "context"
    rows = lines.withColumn("_all", F.row_number().over(order))
    of_type = Window.partitionBy(key, "_ctx").orderBy("line_no")
    rows = rows.withColumn("_ctx", context).withColumn("_run", F.col("_all") - F.row_number().over(of_type))
    run = Window.partitionBy(key, "_ctx", "_run")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn(
        "_pos", F.row_number().over(run.orderBy("line_no"))
    ).withColumn("_top", F.min("_all").over(run) == 1)
    long_run = F.col("_ctx") & (F.col("_n") > threshold)
    fold = (
        F.when(~long_run | (F.col("_pos") > F.col("_n") - keep), "shown")
        .when(F.col("_pos") > keep, "collapsed")
        .when(F.col("_top"), "hidden")
        .otherwise("shown")
    )
    return rows.withColumn("fold", fold).drop("_all", "_ctx", "_run", "_n", "_pos", "_top")
