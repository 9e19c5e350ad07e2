"""Form and field tables, implicit forms.

Only captures whose markup holds a form element at all are tokenised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.html import attribute
from tidemark.functions.text import any_of, lookup, strip
from tidemark.operators.labels import field_label, label_sources, with_label_candidates
from tidemark.operators.tokens import FORM_OPAQUE, element_nodes, inside
from tidemark.rules import structure as fixed

FIELD_TAGS = ["input", "textarea", "select"]
TEXT_TAGS = ["p", "span", "small", "div", "em", "strong", "button", "a"]


def _attr(name: str) -> Column:
    return F.coalesce(attribute(F.col("attrs"), name), F.lit(""))


def _has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def form_nodes(captures: DataFrame, key: str = "capture_id", html: str = "html") -> DataFrame:
    """Nodes with the facts of fields, for pages that hold any field."""
    candidates = captures.filter(F.col(html).rlike(r"(?i)<(input|textarea|select)\b"))
    sources = label_sources()
    inside_it = lambda n: (n["tag"] == "select") & (n["next_chosen"] < n["end_idx"])
    is_form = lambda n: n["tag"] == "form"
    # What stands beside a form: the element after it and the elements before it.
    said = {**sources["said"], "chosen_text": ("next_chosen", inside_it), "after": ("next_sib", is_form)}
    bar = lambda n: n["cls"].rlike(fixed.PROGRESS_BEFORE_CLASS)
    nodes = element_nodes(
        candidates, key, html, FORM_OPAQUE, levels=1, counted=("li", "option", "fieldset"),
        parent_text_for=lambda n: n["tag"].isin(*FIELD_TAGS),
        following={"chosen": lambda e: (e["tag"] == "option") & F.map_contains_key(e["attrs"], "selected")},
        up_fields=("idx", "end_idx", "tag", "cls", "seen", "seen_end"),
        **{**sources, "said": said, "family_has": {**sources["family_has"], "bar_before": (bar, is_form, "before")}},
    )
    rows = _field_columns(with_label_candidates(nodes))
    area_items = F.col("up_1.seen_end.li") - F.col("up_1.seen.li") - F.when(F.col("up_1.tag") == "li", 1).otherwise(0)
    area = F.struct(
        F.col("up_1.idx").alias("idx"), F.col("up_1.end_idx").alias("end_idx"), F.col("up_1.cls").alias("cls"), area_items.alias("items")
    )
    return rows.select(
        key, "idx", "end_idx", "kind", "tag", "attrs", "cls", F.when(F.col("tag").isin(*TEXT_TAGS), F.col("text")).alias("text"),
        "children", "seen", "seen_end", "form", F.when(F.col("up_1").isNotNull(), area).alias("area"),
        "after", F.coalesce("bar_before", F.lit(False)).alias("bar_before"),
        F.col("token").rlike(fixed.REALTIME_VALIDATION).alias("realtime"),
        "field_type", "label", "required", "has_validation", "option_count", "default_option",
    )


def _input_type() -> Column:
    return F.lower(F.coalesce(attribute(F.col("attrs"), "type"), F.lit("text")))


def is_field() -> Column:
    return F.when(F.col("tag") == "input", ~_input_type().isin(*fixed.SKIPPED_INPUTS)).otherwise(
        F.col("tag").isin("textarea", "select")
    )


def _field_columns(nodes: DataFrame) -> DataFrame:
    """Adds the field facts to every node; options give their select its default."""
    is_select = F.col("tag") == "select"
    kind = F.when(F.col("tag") == "input", lookup(_input_type(), fixed.INPUT_TYPES, F.lit("input_text"))).otherwise(
        F.col("tag")
    )
    around = F.coalesce(F.col("up_text"), F.lit(""))
    required = (
        _has("required")
        | (_attr("aria-required") == "true")
        | any_of([F.contains(around, F.lit(w)) for w in fixed.REQUIRED_WORDS])
        | F.col("mark_sibling")
    )
    validated = any_of([_has(name) for name in fixed.VALIDATION_ATTRIBUTES]) | F.col("cls").rlike(
        fixed.REALTIME_VALIDATION
    )
    return nodes.select(
        "*", kind.alias("field_type"), field_label().alias("label"), required.alias("required"),
        (validated & ~is_select).alias("has_validation"),
        F.when(is_select, F.greatest(inside("option") - 1, F.lit(0))).alias("option_count"),
        F.when(is_select, F.coalesce("chosen_text", F.lit(""))).alias("default_option"),
    )


def field_table(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Fields of real forms, in the order inputs, text areas, selects.

    Columns: key, form_idx, position, type, name, label, required, placeholder,
    has_validation, option_count, default_option.
    """
    rows = nodes.filter(is_field() & F.col("form").isNotNull())
    return _placed(rows, key, F.col("form.idx"), "form_idx")


def _placed(rows: DataFrame, key: str, group: Column, name: str) -> DataFrame:
    group_no = F.when(F.col("tag") == "input", 0).when(F.col("tag") == "textarea", 1).otherwise(2)
    order = Window.partitionBy(key, name).orderBy(group_no, "idx")
    return rows.withColumn(name, group).select(
        key, name, (F.row_number().over(order) - 1).alias("position"), F.col("field_type").alias("type"),
        _attr("name").alias("name"), "label", "required",
        F.when(F.col("tag") != "select", _attr("placeholder")).alias("placeholder"),
        "has_validation", "option_count", "default_option",
    )


def estimated_minutes(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(seconds / F.lit(60.0), 0).cast("int"))


def field_seconds(field_type: Column) -> Column:
    return lookup(field_type, {k: str(v) for k, v in fixed.FIELD_SECONDS.items()}, F.lit(str(fixed.OTHER_FIELD_SECONDS))).cast("int")


def button_size(cls: Column) -> Column:
    has = lambda *words: any_of([F.contains(cls, F.lit(w)) for w in words])
    return (
        F.when(F.contains(F.lower(cls), F.lit("full")) | has("block"), "full_width")
        .when(has("lg", "large"), "large").when(has("sm", "small"), "small").otherwise("default")
    )


def _first_distinct(texts: Column, count: int | None) -> Column:
    """First ``count`` distinct texts of an array of (idx, text), by idx; all without a count."""
    ordered = F.array_sort(F.filter(texts, lambda x: x["idx"].isNotNull()))
    texts = F.array_distinct(F.transform(ordered, lambda x: x["text"]))
    return texts if count is None else F.slice(texts, 1, count)


def all_forms(
    nodes: DataFrame, key: str = "capture_id", max_copies: int | None = None, max_proofs: int | None = None, max_length: int | None = None
) -> DataFrame:
    """Forms with at least one field, and the implicit form of pages without one, from one grouping of the nodes.

    Columns: those of ``form_table``; what stands outside of forms is a group of its own on each page.
    """
    is_form, own_form = F.col("tag") == "form", F.col("form.idx")
    # A form inside another one counts for itself, and as a step container of the outer one.
    groups = F.when(is_form & own_form.isNotNull(), F.array("idx", own_form)).otherwise(
        F.array(F.when(is_form, F.col("idx")).otherwise(own_form))
    )
    short = lambda c: F.lit(True) if max_length is None else F.length(c) <= max_length
    text_ok = short("text") & (F.col("text") != "")
    proof = F.col("tag").isin("p", "span", "div", "strong") & text_ok & F.col("text").rlike(fixed.FORM_PROOF)
    field = is_field() & (F.col("kind") != "text")
    loose = (
        own_form.isNull() & F.col("tag").isin(*FIELD_TAGS)
        & ~((F.col("tag") == "input") & _input_type().isin(*fixed.LOOSE_SKIPPED_INPUTS))
    )
    rows = nodes.filter(own_form.isNotNull() | is_form | loose | proof).withColumn("form_idx", F.explode(groups))
    copy = F.col("tag").isin("p", "span", "small", "div", "em") & text_ok & F.col("text").rlike(fixed.FORM_MICRO_COPY)
    link_button = (F.col("tag") == "a") & F.col("cls").rlike(fixed.SUBMIT_LINK_CLASS)
    preference = (
        F.when((F.col("tag") == "button") & (_attr("type") == "submit"), 1)
        .when((F.col("tag") == "input") & (_attr("type") == "submit"), 2)
        .when(F.col("tag") == "button", 3).when(link_button, 4)
    )
    colour = strip(F.regexp_extract(_attr("style"), r"(?i)background(?:-color)?\s*:\s*([^;]+)", 1))
    button = F.struct(
        F.when(F.col("tag") == "input", F.coalesce(attribute(F.col("attrs"), "value"), F.lit(fixed.SUBMIT_LABEL)))
        .otherwise(F.col("text")).alias("label"),
        F.col("cls").alias("class_name"), button_size(F.col("cls")).alias("size"), colour.alias("color"),
        F.lit("form_bottom").alias("position"),
    )
    html5 = F.col("tag").isin(*FIELD_TAGS) & (_has("pattern") | _has("required"))
    own = F.struct(
        _attr("action").alias("action"), F.upper(F.coalesce(attribute(F.col("attrs"), "method"), F.lit("GET"))).alias("method"),
        _has("novalidate").alias("novalidate"), inside("fieldset").alias("fieldsets"), "bar_before", "after",
        F.col("area.idx").alias("area_idx"), F.col("area.end_idx").alias("area_end"), F.col("area.cls").alias("area_cls"),
        F.col("area.items").alias("area_items"), F.col("end_idx").alias("end_idx"),
    )
    # Step indicators count list items below them, else their direct children.
    items = F.when(inside("li") > 0, inside("li")).otherwise(F.col("children"))
    steps = F.col("cls").rlike(fixed.STEP_CLASS) & (F.col("kind") != "text") & (own_form == F.col("form_idx")) & (items >= 2)
    own_row = is_form & (F.col("idx") == F.col("form_idx"))
    first_loose = F.struct(F.col("area.idx").alias("start"), F.col("area.end_idx").alias("end"))
    counts = [F.count_if(field & (F.col("field_type") == t)).cast("int").alias(f"_n_{t}") for t in fixed.FIELD_SECONDS]
    outside = F.col("form_idx").isNull()
    joined = rows.groupBy(key, "form_idx").agg(
        F.first(F.when(own_row, own), ignorenulls=True).alias("_own"),
        *counts, F.count_if(field & F.col("required")).cast("int").alias("required_fields"),
        F.sum(F.when(field, field_seconds(F.col("field_type")))).alias("_seconds"),
        F.bool_or(F.col("realtime") & (~is_form | own_row)).alias("_realtime"), F.bool_or(F.coalesce(html5, F.lit(False))).alias("_html5"),
        F.bool_or(
            F.coalesce(
                ~is_form & ((F.col("tag") == "progress") | F.col("cls").rlike(fixed.PROGRESS_CLASS)), F.lit(False)
            )
        ).alias("_bar"),
        F.min_by(
            F.when(preference.isNotNull(), button), F.when(preference.isNotNull(), F.struct(preference, "idx"))
        ).alias("submit"),
        F.collect_list(F.when(copy, F.struct("idx", "text"))).alias("_copies"),
        F.min_by(F.when(steps, items), F.when(steps, F.col("idx"))).alias("_step_items"),
        F.collect_list(F.when(proof, F.struct("idx", "text"))).alias("_page_proofs"),
        F.count_if(loose).alias("_loose"), F.min_by(F.when(loose, first_loose), F.when(loose, F.col("idx"))).alias("_loose_area"),
        F.collect_list(F.when(field & outside, F.struct("idx", "field_type", "required"))).alias("_loose_fields"),
    )
    types = list(fixed.FIELD_SECONDS)
    pairs = F.array_sort(F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"_n_{t}").alias("value")) for t in types]))
    joined = joined.withColumn("field_types", F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0)))
    total = F.aggregate(F.map_values("field_types"), F.lit(0), lambda a, x: a + x)
    # Proof is looked for in the parent of the form, list items there count as steps.
    page = Window.partitionBy(key)
    joined = joined.withColumn("total_fields", total).select(
        "*", "_own.*", (F.row_number().over(page.orderBy(F.col("form_idx").asc_nulls_last())) - 1).alias("form_no"),
        F.flatten(F.collect_list("_page_proofs").over(page)).alias("_near"),
        F.sum(F.when(~outside, F.col("total_fields"))).over(page).alias("_formed"),
    ).drop("_own")
    none = F.array().cast("array<struct<idx:int,text:string>>")
    proofs = F.filter("_near", lambda x: (x["idx"] > F.col("area_idx")) & (x["idx"] < F.col("area_end")))
    after_ok = short("after") & F.col("after").rlike(fixed.FORM_MICRO_COPY)
    copies = F.concat(
        F.coalesce("_copies", none),
        F.when(after_ok, F.array(F.struct(F.col("end_idx").alias("idx"), F.col("after").alias("text")))).otherwise(none),
    )
    area_steps = F.col("area_cls").rlike(fixed.STEP_CLASS) & (F.col("area_items") >= 2)
    # The fields of an implicit form are those below the parent of the first loose one.
    below = F.filter(
        "_loose_fields",
        lambda x: (x["idx"] > F.coalesce(F.col("_loose_area.start"), F.lit(-1)))
        & (x["idx"] < F.coalesce(F.col("_loose_area.end"), F.lit(2_000_000_000))),
    )
    joined = joined.withColumn("_below", F.when(outside & (F.col("_loose") >= 3) & (F.coalesce("_formed", F.lit(0)) == 0), below))
    of_type = lambda t: F.size(F.filter("_below", lambda x: x["field_type"] == t))
    below_types = F.map_from_entries(F.transform(
        F.array_sort(F.array_distinct(F.transform("_below", lambda x: x["field_type"]))), lambda t: F.struct(t, of_type(t))
    ))
    joined = joined.filter((~outside & (F.col("total_fields") > 0)) | (F.size("_below") > 0))
    real = lambda value, other: F.when(~outside, value).otherwise(other)
    return joined.select(
        key, F.when(~outside, F.col("form_no")).alias("form_no"),
        real(F.concat(F.lit("form-"), F.col("form_no")), F.lit("form-implicit")).alias("id"), real(F.col("action"), F.lit("")).alias("action"),
        real(F.col("method"), F.lit("")).alias("method"), real(F.col("total_fields"), F.size("_below")).alias("total_fields"),
        real(F.col("required_fields"), F.size(F.filter("_below", lambda x: x["required"]))).alias("required_fields"),
        real(F.col("field_types"), below_types).alias("field_types"),
        F.coalesce(
            F.col("_step_items"), F.when(area_steps, F.col("area_items")),
            F.when(F.col("fieldsets") >= 2, F.col("fieldsets")), F.lit(1),
        ).cast("int").alias("steps"),
        real(F.col("_bar") | F.col("bar_before"), F.lit(False)).alias("has_progress_bar"),
        real(
            F.when(F.col("novalidate") | F.col("_realtime"), "realtime").when(F.col("_html5"), "onsubmit").otherwise("none"), F.lit("none")
        ).alias("validation_type"),
        F.when(~outside, F.col("submit")).alias("submit"), F.when(~outside, _first_distinct(copies, max_copies)).alias("micro_copy"),
        F.when(~outside, _first_distinct(F.coalesce(proofs, none), max_proofs)).alias("social_proof"),
        real(estimated_minutes(F.col("_seconds")), F.lit(1)).alias("estimated_minutes"), outside.alias("is_implicit"),
    )


def form_table(
    nodes: DataFrame, key: str = "capture_id", max_copies: int | None = None, max_proofs: int | None = None, max_length: int | None = None
) -> DataFrame:
    """One row per form with at least one field.

    Columns: key, form_no, action, method, total_fields, required_fields, field_types,
    steps, has_progress_bar, validation_type, submit (struct), micro_copy, social_proof,
    estimated_minutes. Texts beside a form are kept in any number and length without limits.
    """
    return all_forms(nodes, key, max_copies, max_proofs, max_length).filter(~F.col("is_implicit"))


def implicit_forms(nodes: DataFrame, key: str = "capture_id") -> DataFrame:
    """Pages without a form that has fields, but with three or more loose fields.

    The fields counted are those below the parent of the first loose one.
    """
    return all_forms(nodes, key).filter("is_implicit").drop("form_no", "submit", "micro_copy", "social_proof")


def form_summary(forms: DataFrame, key: str = "capture_id") -> DataFrame:
    """Per page: total_forms, has_multi_step_form, total_fields, total_required_fields."""
    return forms.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("total_forms"), F.bool_or(F.col("steps") > 1).alias("has_multi_step_form"),
        F.sum("total_fields").cast("int").alias("total_fields"),
        F.sum("required_fields").cast("int").alias("total_required_fields"),
    )
