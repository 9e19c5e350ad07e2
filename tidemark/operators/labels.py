"""Labels of form fields, from what stands around and beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import attribute
from tidemark.rules import structure as fixed

FIELD_TAGS = ["input", "textarea", "select"]


def label_sources() -> dict:
    """What ``element_nodes`` has to find for labels: the form and label around, labels by reference."""
    refers = lambda e: F.when(e["tag"] == "label", attribute(e["attrs"], "for")).when(
        e["tag"].isin(*FIELD_TAGS), F.when(e["elem_id"] != "", e["elem_id"])
    )
    is_field = lambda n: n["tag"].isin(*FIELD_TAGS)
    marked = lambda n: n["tag"].isin("span", "em", "strong") & n["text"].isin(*fixed.REQUIRED_MARKS)
    places = {
        "earlier_label": "ref_before", "form_label": "ref_first", "wrap_label": "last_label", "sibling_label": "sib",
        "wide_label": "sib_wide", "child_text": "sib_said",
    }
    return {
        "latest": {"form": "form", "label": "label"}, "refs": refers, "said": {name: (at, is_field) for name, at in places.items()},
        "family_has": {"mark_sibling": (marked, is_field)},
    }


def with_label_candidates(nodes: DataFrame) -> DataFrame:
    """Nodes made with ``label_sources`` with the form (struct or NULL) around them, aria_label and sibling_text."""
    aria = attribute(F.col("attrs"), "aria-label")
    return nodes.select(
        "*", F.when(F.col("last_form").isNotNull(), F.struct(F.col("last_form").alias("idx"))).alias("form"),
        F.when(aria != "", aria).alias("aria_label"), F.when(F.col("wide_label") != "", F.col("wide_label")).alias("sibling_text"),
    )


def component_label():
    """Label kept with a component: earlier ``for`` label, wrapping label, aria, sibling before."""
    return F.coalesce("earlier_label", "wrap_label", "aria_label", "sibling_label", F.lit(""))


def field_label():
    """Label of a form field: own form's ``for`` label, wrapping label, aria, sibling, parent text."""
    return F.coalesce("form_label", "wrap_label", "aria_label", "sibling_text", "child_text", F.lit(""))
