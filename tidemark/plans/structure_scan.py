"""The page-structure document of every capture, stored when it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.lineage import cut_lineage
from tidemark.operators import conversion, forms, structure
from tidemark.sources import tables

CV_GROUPS = {"social_proof": 2, "urgency": 3, "micro_copy": 4}
NO_SUMMARY = "named_struct('section_count', 0, 'component_count', 0, 'form_section_count', 0, 'cta_count', 0, 'has_sticky', false)"


def _or_none(name: str, shape: str) -> Column:
    """An array in its stored shape, empty where the page has none."""
    kind = f"array<{shape}>"
    return F.coalesce(F.col(name).cast(kind), F.array().cast(kind)).alias(name)


def nested_points(points: DataFrame, key: str = "capture_id") -> DataFrame:
    """Conversion elements as one array a page: calls to action, proof, urgency, copy, each in their order."""
    group = F.lit(1)
    for name, rank in CV_GROUPS.items():
        group = F.when(F.col("type") == name, rank).otherwise(group)
    names = ["type", "element", "label", "text", "position", "is_sticky", "class_name", "micro_copy", "social_proof"]
    one = F.struct(group.alias("group"), "turn", "idx", F.struct(*names).alias("point"))
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_p"))
    return rows.select(key, F.col("_p.point").alias("cv_points"))


def nested_forms(rows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Forms as one array a page in page order; counts of field types by name."""
    by_name = F.map_from_entries(F.array_sort(F.map_entries("field_types")))
    one = F.struct(
        F.coalesce("form_no", F.lit(0)).alias("no"),
        F.struct(
            "id", "action", "method", "total_fields", "required_fields", by_name.alias("field_types"), "steps",
            "has_progress_bar", "validation_type", "estimated_minutes",
        ).alias("form"),
    )
    in_order = F.array_sort(F.collect_list(one), lambda a, b: a["no"] - b["no"])
    return rows.groupBy(key).agg(in_order.alias("_f")).select(key, F.col("_f.form").alias("forms"))


def structure_documents(captures: DataFrame, site_role: str = "rival") -> DataFrame:
    """One row of the stored page structures per capture (capture_id, page_id, captured_at, html).

    Sections, conversion elements and forms (the loose-field one included) are worked out apart and meet
    on the capture. Captures without any, and without markup, hold empty arrays and zero counts.
    The hash covers summary and sections; fields stand in a fixed order.
    """
    key = "capture_id"
    sections = structure.page_structures(structure.page_sections(structure.structure_nodes(captures))).drop("hash")
    points = nested_points(conversion.cv_points(cut_lineage(conversion.conversion_nodes(captures))))
    found = nested_forms(forms.all_forms(forms.form_nodes(captures)))
    rows = captures.select(key, "page_id", "captured_at")
    # Spark sizes a part by the table that the pages come from, far below its nested rows, and would
    # broadcast it; the parts lie by capture already.
    for part in (sections, points, found):
        rows = rows.join(part.hint("merge"), key, "left")
    rows = rows.select(
        F.col(key).alias("id"), F.lit(site_role).alias("site_role"), "page_id", "captured_at",
        F.coalesce("summary", F.expr(NO_SUMMARY)).alias("summary"), _or_none("sections", schemas.SECTION),
        _or_none("cv_points", schemas.CV_POINT), _or_none("forms", schemas.FORM),
    )
    return rows.withColumn("hash", F.sha2(F.to_json(F.struct("summary", "sections")), 256))


def changed_documents(captures: DataFrame, stored: DataFrame | None = None, site_role: str = "rival") -> DataFrame:
    """Documents that differ from the one before of their page, stored ones of the same role included."""
    earlier = None if stored is None else stored.filter(F.col("site_role") == site_role)
    return tables.changed_structures(cut_lineage(structure_documents(captures, site_role)), earlier)
