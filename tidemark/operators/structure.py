"""Sections, components and summary of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.html import attribute
from tidemark.functions.text import any_of, lookup
from tidemark.functions.urls import without_query
from tidemark.operators.labels import component_label, label_sources, with_label_candidates
from tidemark.operators.tokens import STRUCTURE_OPAQUE, element_nodes, inside
from tidemark.rules import structure as fixed

URGENCY_TAGS = ["span", "p", "div", "strong", "em"]
HEAD_TAGS = ["html", "head", "body", "title", "meta", "link", "base"]


def _attr(name: str) -> Column:
    return F.coalesce(attribute(F.col("attrs"), name), F.lit(""))


def structure_nodes(captures: DataFrame, key: str = "capture_id", html: str = "html") -> DataFrame:
    """Nodes of the structure analysis, with the open carousel containers counted."""
    sources = label_sources()
    inside_it = lambda n: (n["tag"] == "details") & (n["next_summary"] < n["end_idx"])
    return element_nodes(
        captures, key, html, STRUCTURE_OPAQUE, levels=1, areas={"carousel": lambda e: F.coalesce(e["cls"], F.lit("")).rlike(fixed.CAROUSEL_CLASS)},
        counted=("img", "tr", "th", "td"),
        parent_text_for=lambda n: n["tag"].isin(*URGENCY_TAGS) & n["text"].rlike(fixed.URGENCY_COMPONENT_TEXT),
        following={"summary": "summary"}, roots=("body", "html", tuple(HEAD_TAGS)), up_fields=("idx", "tag"),
        **{**sources, "said": {**sources["said"], "summary_text": ("next_summary", inside_it)}},
    )


def section_type() -> Column:
    cls = F.lower(F.col("cls"))
    has = lambda *words: any_of([F.contains(cls, F.lit(w)) for w in words])
    role = lookup(_attr("role"), fixed.SECTION_ROLES)
    return (
        F.when(F.col("tag").isin(*fixed.SECTION_TAGS), F.col("tag"))
        .when(role.isNotNull(), role)
        .when(~F.col("cls").rlike(fixed.SECTION_CLASS), "div")
        .when(has("hero", "banner"), "hero")
        .when(has("sidebar"), "aside")
        .when(has("modal", "drawer", "overlay"), "modal")
        .when(has("toolbar", "bottom-bar"), "toolbar")
        .when(has("fixed", "sticky"), "fixed_element")
        .otherwise("div")
    )


def component_type() -> Column:
    """Kind of a component, first matching rule; NULL when the element is none."""
    tag, cls, text = F.col("tag"), F.col("cls"), F.col("text")
    kind = F.lower(F.coalesce(attribute(F.col("attrs"), "type"), F.lit("text")))
    href = _attr("href")
    tiny = _attr("width").isin("0", "1") & _attr("height").isin("0", "1")
    fixed_style = F.contains(_attr("style"), F.lit("position: fixed")) | F.contains(
        _attr("style"), F.lit("position: sticky")
    )
    input_kind = F.when(kind == "hidden", F.lit(None)).when(kind == "submit", "button_submit").otherwise(
        lookup(kind, fixed.INPUT_TYPES, F.lit("input_text"))
    )
    link_kind = (
        F.when(F.contains(href, F.lit("line.me")), "cta_line")
        .when(href.startswith("tel:"), "cta_tel")
        .when(cls.rlike(fixed.LINK_CLASS), "cta_link")
        .when(text.rlike(fixed.LINK_TEXT), "cta_link")
    )
    urgent = text.rlike(fixed.URGENCY_COMPONENT_TEXT)
    parent_urgent = ~F.coalesce(F.col("up_1.tag"), F.lit("body")).isin(
        "body", "html", "section", "div"
    ) & F.coalesce(F.col("up_text").rlike(fixed.URGENCY_COMPONENT_TEXT), F.lit(False))
    return (
        F.when(tag == "input", input_kind)
        .when(tag.isin("textarea", "select"), tag)
        .when(tag == "button", F.when(_attr("type") == "submit", "button_submit").otherwise("button_action"))
        .when(tag == "a", link_kind)
        .when(tag == "img", F.when(~tiny & (F.col("in_carousel") == 0), "image_single"))
        .when(tag == "video", "video")
        .when(cls.rlike(fixed.CAROUSEL_CLASS) & (F.col("in_carousel") == 0), "image_carousel")
        .when(tag == "table", F.when(_attr("role") != "presentation", "table"))
        .when(tag == "details", "accordion")
        .when(cls.rlike(fixed.PROOF_COMPONENT_CLASS) & (text != ""), "social_proof")
        .when(tag.isin(*URGENCY_TAGS) & urgent & ~parent_urgent, "urgency")
        .when(fixed_style & tag.isin("div", "footer", "header"), "sticky_element")
        .when(cls.rlike(fixed.STICKY_COMPONENT_CLASS) & tag.isin("div", "footer", "header", "nav"), "sticky_element")
    )


def _component_attributes() -> Column:
    has = lambda name: F.map_contains_key("attrs", name)
    flag = lambda c: F.when(c, "true").otherwise("false")
    entry = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    kind, text = F.col("component"), F.col("text")
    columns = F.when(inside("th") > 0, inside("th")).otherwise(F.least(inside("td"), F.lit(1)))
    return (
        F.when(
            F.col("tag").isin("input", "textarea", "select"),
            entry(
                ("name", _attr("name")), ("label", component_label()), ("required", flag(has("required"))),
                ("placeholder", _attr("placeholder")),
            ),
        )
        .when(F.col("tag") == "button", entry(("label", text), ("className", F.col("cls"))))
        .when(kind.isin("cta_line", "cta_tel"), entry(("label", text), ("href", _attr("href"))))
        .when(
            kind == "cta_link",
            entry(
                ("label", text), ("className", F.col("cls")),
                ("href", without_query(attribute(F.col("attrs"), "href"))),
            ),
        )
        .when(
            kind == "image_single",
            entry(("alt", _attr("alt")), ("width", _attr("width")), ("height", _attr("height"))),
        )
        .when(kind.isin("image_carousel", "sticky_element"), entry(("className", F.col("cls"))))
        .when(
            kind == "table",
            entry(("rowCount", inside("tr").cast("string")), ("colCount", columns.cast("string"))),
        )
        .when(
            kind == "accordion",
            entry(("summary", F.coalesce("summary_text", F.lit(""))), ("open", flag(has("open")))),
        )
        .when(kind == "social_proof", entry(("text", text), ("className", F.col("cls"))))
        .when(kind == "urgency", entry(("text", text)))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def page_sections(nodes: DataFrame, key: str = "capture_id", attributes: bool = True) -> DataFrame:
    """Sections with their components nested, one row per section.

    Columns: key, section_no, type, tag_name, class_name, is_sticky, components
    (array of position, type, tag_name, child_count, is_sticky, attributes). Every node
    carries the section it lies in, so sections and components come from one grouping.
    """
    rows = with_label_candidates(nodes) if attributes else nodes
    elements = rows.filter(F.col("kind") != "text")
    elements = elements.withColumn("_root", F.col("is_root") == 1)
    elements = elements.withColumn("_sec_idx", F.when(F.col("_root"), F.col("idx")).otherwise(F.col("last_root")))
    elements = elements.filter(F.col("_sec_idx").isNotNull()).withColumn(
        "component", F.when(~F.col("_root"), component_type())
    )
    described = _component_attributes() if attributes else F.lit(None).cast("map<string,string>")
    component = F.struct(
        "idx", F.col("component").alias("type"), F.col("tag").alias("tag_name"),
        F.when(F.col("component") == "image_carousel", inside("img")).cast("int").alias("child_count"),
        (F.col("component") == "sticky_element").alias("is_sticky"), described.alias("attributes"),
    )
    style = _attr("style")
    fixed_style = F.contains(style, F.lit("position: fixed")) | F.contains(style, F.lit("position: sticky"))
    section = F.struct(
        section_type().alias("type"), F.col("tag").alias("tag_name"),
        F.when(F.col("cls") != "", F.col("cls")).alias("class_name"), fixed_style.alias("is_sticky"),
    )
    inner_section = F.col("tag").isin(*fixed.SECTION_TAGS) & (F.col("up_1.idx") == F.col("_sec_idx"))
    elements = elements.filter(F.col("_root") | F.col("component").isNotNull() | F.coalesce(inner_section, F.lit(False)))
    grouped = elements.groupBy(key, "_sec_idx").agg(
        F.first(F.when(F.col("_root"), section), ignorenulls=True).alias("_s"),
        F.coalesce(F.bool_or(inner_section & ~F.col("_root")), F.lit(False)).alias("_holds"),
        F.collect_list(F.when(F.col("component").isNotNull(), component)).alias("_c"),
    )
    kept = grouped.filter((F.size("_c") > 0) | (F.col("_s.type") != "div") | F.col("_holds"))
    in_order = F.array_sort("_c", lambda a, b: a["idx"] - b["idx"])
    if fixed.COMPONENT_LIMIT is not None:
        in_order = F.slice(in_order, 1, fixed.COMPONENT_LIMIT)
    placed = F.transform(
        in_order,
        lambda c, i: F.struct(
            i.alias("position"), c["type"].alias("type"), c["tag_name"].alias("tag_name"),
            c["child_count"].alias("child_count"), c["is_sticky"].alias("is_sticky"), c["attributes"].alias("attributes"),
        ),
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("_sec_idx")) - 1
    return kept.select(key, number.cast("int").alias("section_no"), "_s.*", placed.alias("components"))


def component_table(sections: DataFrame, key: str = "capture_id") -> DataFrame:
    """Components as rows: key, section_no, position, type, tag_name, attributes, child_count, is_sticky."""
    return sections.select(key, "section_no", F.explode("components").alias("_c")).select(key, "section_no", "_c.*")


def structure_summary(sections: DataFrame, key: str = "capture_id") -> DataFrame:
    """Per page: section, component, form-section and CTA counts, any sticky component."""
    cta = F.filter("components", lambda c: c["type"].startswith("cta_") | (c["type"] == "button_submit"))
    return sections.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("section_count"),
        F.sum(F.size("components")).cast("int").alias("component_count"),
        F.count_if(F.col("type") == "form").cast("int").alias("form_section_count"),
        F.sum(F.size(cta)).cast("int").alias("cta_count"),
        F.bool_or(F.exists("components", lambda c: c["is_sticky"])).alias("has_sticky"),
    )


def page_structures(sections: DataFrame, key: str = "capture_id") -> DataFrame:
    """One nested document per page (summary, sections with components) with its hash."""
    cta = F.filter("components", lambda c: c["type"].startswith("cta_") | (c["type"] == "button_submit"))
    one = F.struct(
        F.col("section_no").alias("position"), F.concat(F.lit("section-"), F.col("section_no")).alias("id"), "type",
        "tag_name", "class_name", "is_sticky", "components",
    )
    docs = sections.groupBy(key).agg(
        F.collect_list(one).alias("_s"),
        F.count(F.lit(1)).cast("int").alias("section_count"),
        F.sum(F.size("components")).cast("int").alias("component_count"),
        F.count_if(F.col("type") == "form").cast("int").alias("form_section_count"),
        F.sum(F.size(cta)).cast("int").alias("cta_count"),
        F.bool_or(F.exists("components", lambda c: c["is_sticky"])).alias("has_sticky"),
    )
    summary = F.struct("section_count", "component_count", "form_section_count", "cta_count", "has_sticky")
    docs = docs.select(
        key, summary.alias("summary"), F.array_sort("_s", lambda a, b: a["position"] - b["position"]).alias("sections")
    )
    return docs.withColumn("hash", F.sha2(F.to_json(F.struct("summary", "sections")), 256))
