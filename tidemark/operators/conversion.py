"""Conversion elements of a page: calls to action, social proof, urgency, micro-copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.html import attribute
from tidemark.functions.text import cut
from tidemark.operators.tokens import FORM_OPAQUE, element_nodes
from tidemark.rules import structure as fixed

ANCESTORS = 3
URGENCY_TAGS = ["span", "p", "div", "strong", "em", "small", "li"]
PROOF_TAGS = ["span", "p", "div", "strong", "em", "small"]
COPY_TAGS = ["p", "span", "small", "div", "em", "strong"]


def _attr(name: str) -> Column:
    return F.coalesce(attribute(F.col("attrs"), name), F.lit(""))


def conversion_nodes(captures: DataFrame, key: str = "capture_id", html: str = "html") -> DataFrame:
    """Candidates for conversion elements with position label and the texts beside them."""
    wanted = lambda n: n["tag"].isin(*URGENCY_TAGS) & n["text"].rlike(fixed.URGENCY_TEXT)
    nodes = element_nodes(captures, key, html, FORM_OPAQUE, levels=ANCESTORS, parent_text_for=wanted, up_fields=("idx", "tag", "cls", "style"))
    nodes = nodes.filter(F.col("kind") != "text").withColumn("is_sticky", sticky()).withColumn("position", position_label())
    columns = ["idx", "tag", "attrs", "cls", "text", "up_text", "is_sticky", "position"]
    nodes = nodes.select(key, *columns, F.col("up_1.idx").alias("_parent"))
    siblings = Window.partitionBy(key, "_parent").orderBy("idx")
    family = siblings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    copy = F.when(F.col("text").rlike(fixed.MICRO_COPY_TEXT), F.col("text"))
    proof = F.when(F.col("text").rlike(fixed.PROOF_TEXT), F.col("text"))
    nodes = nodes.withColumn("_copy", copy).withColumn("_proof", proof)
    nodes = nodes.select(
        "*",
        F.coalesce(
            *[F.lead("_copy", k).over(siblings) for k in (1, 2, 3)],
            F.first(F.when(F.col("tag").isin("small", "span", "p"), F.col("_copy")), ignorenulls=True).over(family),
            F.lit(""),
        ).alias("near_copy"),
        F.coalesce(
            F.first(
                F.when(F.col("tag").isin("span", "p", "div", "small"), F.col("_proof")), ignorenulls=True
            ).over(family),
            F.lit(""),
        ).alias("near_proof"),
    ).drop("_copy", "_proof")
    return nodes.filter(_is_candidate()).select(key, *columns, "near_copy", "near_proof")


def _is_candidate() -> Column:
    """What any of the tables below looks at."""
    tag, text = F.col("tag"), F.col("text")
    return tag.isin("button", "input", "a") | _is_proof() | (tag.isin(*URGENCY_TAGS) & text.rlike(fixed.URGENCY_TEXT)) | (
        tag.isin(*COPY_TAGS) & text.rlike(fixed.MICRO_COPY_TEXT)
    )


def _is_proof() -> Column:
    by_text = F.col("tag").isin(*PROOF_TAGS) & F.col("text").rlike(fixed.PROOF_TEXT)
    return (F.col("text") != "") & (F.col("cls").rlike(fixed.PROOF_CLASS) | by_text)


def _levels() -> list[tuple[Column, Column]]:
    """(style, class) of the element and of its nearest ancestors."""
    own = (_attr("style"), F.coalesce(F.col("cls"), F.lit("")))
    ups = [
        (F.coalesce(F.col(f"up_{k}.style"), F.lit("")), F.coalesce(F.col(f"up_{k}.cls"), F.lit("")))
        for k in range(1, ANCESTORS + 1)
    ]
    return [own, *ups]


def sticky() -> Column:
    out = F.lit(False)
    for style, cls in _levels():
        out = out | style.rlike(fixed.STICKY_STYLE) | cls.rlike(fixed.STICKY_CLASS)
    return out


def position_label() -> Column:
    """Where an element stands; for sticky ones the nearest level that says so counts."""
    where = F
    for style, cls in _levels():
        low_style, low_cls = F.lower(style), F.lower(cls)
        where = where.when(
            F.contains(low_style, F.lit("bottom")) | F.contains(low_cls, F.lit("bottom")), "fixed_bottom"
        ).when(F.contains(low_style, F.lit("top")) | F.contains(low_cls, F.lit("header")), "fixed_top")
    return (
        F.when(F.col("is_sticky"), where.otherwise("fixed"))
        .when(F.col("in_form") > 0, "in_form").when(F.col("in_header") > 0, "header")
        .when(F.col("in_footer") > 0, "footer").when(F.col("in_nav") > 0, "navigation").otherwise("body")
    )


def cta_table(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Calls to action; a whole label counts once per page, submits first, then buttons, then links.

    ``display_label`` is the label's short form.
    """
    tag, text = F.col("tag"), F.col("text")
    submit = tag.isin("button", "input") & (_attr("type") == "submit")
    label = F.when(
        tag == "input", F.coalesce(attribute(F.col("attrs"), "value"), F.lit(fixed.SUBMIT_LABEL))
    ).otherwise(text)
    href, cls = _attr("href"), F.col("cls")
    link = (
        F.when(F.contains(href, F.lit("line.me")), "line_cta")
        .when(href.startswith("tel:"), "tel_cta")
        .when(
            cls.rlike(fixed.CTA_CLASS),
            F.when(F.contains(F.lower(cls), F.lit("primary")), "primary_cta").otherwise("secondary_cta"),
        )
        .when(text.rlike(fixed.CTA_TEXT), "secondary_cta")
    )
    kind = (
        F.when(submit, "primary_cta")
        .when((tag == "button") & text.rlike(fixed.CTA_TEXT), "secondary_cta")
        .when(tag == "a", link)
    )
    turn = F.when(submit, 1).when(tag == "button", 2).otherwise(3)
    found = nodes.filter(tag.isin("button", "input", "a")).select(
        key, "idx", kind.alias("type"), tag.alias("element"), label.alias("label"), "position", "is_sticky",
        cls.alias("class_name"), F.col("near_copy").alias("micro_copy"),
        F.col("near_proof").alias("social_proof"), cut(label, 50).alias("display_label"), turn.alias("turn"),
    ).filter(F.col("type").isNotNull() & (F.col("label") != ""))
    first = Window.partitionBy(key, "label").orderBy("turn", "idx")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _numbered(rows: DataFrame, key: str, limit: int | None = fixed.CV_LIMIT) -> DataFrame:
    """The first ``limit`` rows of a page; all of them without a limit."""
    if limit is None:
        return rows
    order = Window.partitionBy(key).orderBy("turn", "idx")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def social_proof_table(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Social proof by class, then by text; at most ten per page."""
    by_class = F.col("cls").rlike(fixed.PROOF_CLASS)
    by_text = F.col("tag").isin(*PROOF_TAGS) & F.col("text").rlike(fixed.PROOF_TEXT)
    both = F.filter(
        F.array(
            F.when(by_class, F.struct(F.lit(1).alias("turn"), F.col("is_sticky").alias("stuck"))),
            F.when(by_text, F.struct(F.lit(2).alias("turn"), F.lit(False).alias("stuck"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = nodes.filter(_is_proof()).select("*", F.explode(both).alias("_p"))
    rows = rows.select(
        key, "idx", F.lit("social_proof").alias("type"), F.col("tag").alias("element"), "text", "position",
        F.col("_p.stuck").alias("is_sticky"), F.col("_p.turn").alias("turn"), F.col("text").alias("_same"),
    )
    first = Window.partitionBy(key, "_same").orderBy("turn", "idx")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_same")
    return _numbered(rows, key)


def micro_copy_table(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Reassuring texts; repeats of a whole text dropped."""
    rows = nodes.filter(
        F.col("tag").isin(*COPY_TAGS) & F.col("text").rlike(fixed.MICRO_COPY_TEXT)
    ).select(
        key, "idx", F.lit("micro_copy").alias("type"), F.col("tag").alias("element"), "text",
        "position", F.lit(False).alias("is_sticky"), F.lit(1).alias("turn"), F.col("text").alias("_same"),
    )
    first = Window.partitionBy(key, "_same").orderBy("idx")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_same")
    return _numbered(rows, key)


def urgency_table(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Urgency texts; a repeat, or the child of an element already kept, is left out.

    Whether an element is kept depends on those kept before it, so the candidates of one
    page (few and short) are folded in document order.
    """
    found = nodes.filter(
        F.col("tag").isin(*URGENCY_TAGS) & F.col("text").rlike(fixed.URGENCY_TEXT)
    )
    item = F.struct(
        "idx", F.col("tag").alias("element"), "text", "position", "is_sticky",
        F.col("text").alias("own"), F.coalesce("up_text", F.lit("\u0000")).alias("up"),
    )
    pages = found.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    start = F.slice("_all", 1, 0)
    kept = F.aggregate(
        "_all", start,
        lambda done, x: F.when(
            F.exists(done, lambda d: (d["own"] == x["own"]) | (d["own"] == x["up"])), done
        ).otherwise(F.array_append(done, x)),
    )
    rows = pages.select(key, F.explode(kept if fixed.CV_LIMIT is None else F.slice(kept, 1, fixed.CV_LIMIT)).alias("_x"))
    return rows.select(
        key, "_x.idx", F.lit("urgency").alias("type"), "_x.element", "_x.text", "_x.position", "_x.is_sticky",
        F.lit(1).alias("turn"),
    )


def cv_points(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """All conversion elements of a page in one wide table."""
    parts = [cta_table(nodes, key), social_proof_table(nodes, key), urgency_table(nodes, key), micro_copy_table(nodes, key)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def cv_summary(points: DataFrame, key: str = "capture_id") -> DataFrame:
    """Counts per page; the CTA count covers the four CTA types, sticky counts CTAs only."""
    cta = F.col("type").isin("primary_cta", "secondary_cta", "line_cta", "tel_cta")
    of = lambda name: F.count_if(F.col("type") == name)
    return points.groupBy(key).agg(
        F.count_if(cta).alias("total_cta_count"), F.count_if(cta & F.col("is_sticky")).alias("sticky_cta_count"),
        of("social_proof").alias("social_proof_count"), of("urgency").alias("urgency_count"),
        of("micro_copy").alias("micro_copy_count"),
    ).withColumn("has_micro_copy", F.col("micro_copy_count") > 0)
