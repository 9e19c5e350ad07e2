"""Captured markup as a table of tokens and of elements.

Captures are partitioned by their key once, as whole documents: one exchange. Ends, depths,
ancestors and counts are worked out on the arrays of a page (``functions/page_tree.py``), and
its nodes are exploded with all of them. Later windows work inside that partitioning, so the
(far more numerous) token rows are sorted locally and never shuffled.

Elements come from the token order alone. A start tag ends at its own end tag of the
same nesting level; elements with implied ends (paragraphs, list items, table rows
and cells, definition items, options) end at the next token that closes them; an
unclosed inline element ends at the next block boundary and any other unclosed
element at the end of the document. On well-formed input this is the document tree;
on broken input it can differ from what a tree-building parser would repair.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import page_tree

from tidemark.functions.html import (
    attribute,
    attribute_map,
    class_text,
    is_text,
    tag_name,
    token_array,
    token_kind,
)
from tidemark.functions.text import blank, chain, decode_entities, strip

# The module travels with its function, so executors need no copy of the package.
register_pickle_by_value(page_tree)

# Elements left out before analysis, by caller.
NORMALISE_OPAQUE = ("script", "style", "noscript", "iframe")
STRUCTURE_OPAQUE = ("script", "style", "noscript", "iframe", "svg")
FORM_OPAQUE = ("script", "style", "noscript")

# Block elements, whose start or end also ends an open paragraph.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]

# Inline elements.
INLINE_TAGS = [
    "a", "abbr", "b", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "q", "s",
    "small", "span", "strong", "sub", "sup", "u",
]

# Parents whose text no rule looks at.
TEXTLESS_PARENTS = ["body", "html"]

UP_FIELDS = ("idx", "end_idx", "tag", "cls", "style", "role", "texts_before", "texts_end")

# Elements with implied ends: (family, members, containers that open a new level, other closers).
IMPLIED = [
    ("p", ["p"], [], BLOCK_TAGS),
    ("li", ["li"], ["ul", "ol", "menu"], []),
    ("tr", ["tr"], ["table"], ["thead", "tbody", "tfoot"]),
    ("td", ["td", "th"], ["table"], ["tr", "thead", "tbody", "tfoot"]),
    ("dt", ["dt", "dd"], ["dl"], []),
    ("option", ["option"], ["select"], ["optgroup"]),
]


def by_capture(rows: DataFrame, key: str) -> DataFrame:
    """Partition whole documents by key.

    The number is given so that adaptive execution does not merge these partitions by
    their size: their rows grow about tenfold once the tokens are exploded.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def token_table(
    captures: DataFrame,
    key: str = "capture_id",
    html: str = "html",
    opaque: tuple[str, ...] = STRUCTURE_OPAQUE,
    counted: tuple[str, ...] = (),
) -> DataFrame:
    """One row per token: key, idx, token, tag, kind, texts_before, leaf, n_tokens, n_texts.

    ``leaf`` marks the text and the end tag of an element that holds text only. ``seen``
    holds the number of ``counted`` tags before the token.
    """
    base = by_capture(captures.select(key, html), key)
    base = base.select(key, token_array(F.col(html), opaque).alias("_tokens"))
    # Counted before the explode, else the counts would be worked out once per token.
    base = base.select(
        "*", F.size("_tokens").alias("n_tokens"), F.size(F.filter("_tokens", is_text)).alias("n_texts")
    )
    # The outer form keeps the optimiser from testing the array (a second tokenising pass)
    # in a filter of its own; empty documents fall out just after.
    rows = base.select(key, "n_tokens", "n_texts", F.posexplode_outer("_tokens").alias("idx", "token"))
    rows = rows.filter(F.col("token").isNotNull())
    rows = rows.withColumn("tag", tag_name(F.col("token")))
    rows = rows.withColumn("kind", token_kind(F.col("token"), F.col("tag"), opaque))
    in_order = Window.partitionBy(key).orderBy("idx")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    near = {n: F.lag(F.struct("kind", "tag"), n).over(in_order) for n in (1, 2, -1)}
    pair = lambda first, last: (first["kind"] == "open") & (last["kind"] == "close") & (first["tag"] == last["tag"])
    own = F.struct("kind", "tag")
    seen = F.struct(
        *[
            F.coalesce(
                F.sum(F.when((F.col("tag") == t) & F.col("kind").isin("open", "void"), 1).otherwise(0)).over(before),
                F.lit(0),
            ).cast("int").alias(t)
            for t in counted
        ]
    )
    leaf_text = (F.col("kind") == "text") & pair(near[1], near[-1])
    leaf_end = (F.col("kind") == "close") & (near[1]["kind"] == "text") & pair(near[2], own)
    return rows.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("kind") == "text", 1).otherwise(0)).over(before), F.lit(0))
        .cast("int").alias("texts_before"),
        F.coalesce(leaf_text | leaf_end, F.lit(False)).alias("leaf"),
        *([seen.alias("seen")] if counted else []),
    )


def _families_of(tag: str, kind: str) -> list[tuple[str, int, bool, bool]]:
    """Families (name, level change, opens, closes) of a known tag; its own family first."""
    opening = kind == "open"
    own = [name for name, members, _, _ in IMPLIED if tag in members]
    out = [(own[0], 0, opening, True)] if own else [(tag, 1 if opening else -1, opening, not opening)]
    for name, members, containers, closers in IMPLIED:
        if tag in containers:
            out.append((name, 1 if opening else -1, False, not opening))
        elif tag in closers and tag not in members:
            out.append((name, 0, False, True))
    return out


def _families() -> Column:
    """Which families a token takes part in, as constants for the known tags."""
    tag, kind = F.col("tag"), F.col("kind")

    def row(name: Column, delta: int, opens: bool, closes: bool) -> Column:
        return F.struct(
            name.alias("fam"), F.lit(delta).alias("delta"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes")
        )

    known = sorted(
        set(BLOCK_TAGS) | {t for _, members, containers, closers in IMPLIED for t in [*members, *containers, *closers]}
    )

    def of_kind(which: str) -> Column:
        # Tags with the same list share one branch; "" stands for the tag's own name.
        shapes: dict[tuple, list[str]] = {}
        for name in known:
            (own, *step), *others = _families_of(name, which)
            shape = (("" if own == name else own, *step), *others)
            shapes.setdefault(shape, []).append(name)
        plain = row(tag, 1, True, False) if which == "open" else row(tag, -1, False, True)
        branches = [
            (tag.isin(*names), F.array(*[row(tag if fam == "" else F.lit(fam), *step) for fam, *step in shape]))
            for shape, names in shapes.items()
        ]
        return chain(branches, F.array(plain))

    return (
        F.when(kind == "open", of_kind("open"))
        .when(kind == "close", of_kind("close"))
        .otherwise(F.array(row(F.lit("#"), 0, False, False)))
    )


def spanned_tokens(tokens: DataFrame, key: str = "capture_id") -> DataFrame:
    """Tokens with ``end_idx`` and ``texts_end`` filled for element starts.

    An element holds the tokens idx < t < end_idx; a void element has end_idx = idx.
    ``cover_end`` is one more when the element ends at its own end tag.
    """
    boundary = F.col("tag").isin(*BLOCK_TAGS) & F.col("kind").isin("open", "close")
    in_order = Window.partitionBy(key).orderBy("idx")
    closed_tag = F.when(F.col("kind") == "close", F.col("tag"))
    has_counts = "seen" in tokens.columns
    if not has_counts:
        tokens = tokens.withColumn("seen", F.lit(None).cast("int"))
    point = F.struct(
        F.col("idx").alias("idx"), F.col("texts_before").alias("texts"), closed_tag.alias("closed"), F.col("seen")
    )
    rows = (
        tokens.withColumn("_point", point)
        .withColumn("_mark", F.when(boundary, F.col("_point")))
        .withColumn(
            "_block",
            F.expr(f"lead(_mark, 1) IGNORE NULLS OVER (PARTITION BY {key} ORDER BY idx)"),
        )
    )
    # Counts at the end of the document, for elements that are never closed.
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_total", F.last("seen").over(everything))
    rows = rows.select("*", F.posexplode(_families()).alias("_no", "_f")).select("*", "_f.*").drop("_f", "_mark")
    by_family = Window.partitionBy(key, "fam").orderBy("idx")
    rows = rows.withColumn("_sum", F.sum("delta").over(by_family))
    rows = rows.withColumn("_low", F.min("_sum").over(by_family))
    # Balance that never falls below zero, so stray end tags do not shift later levels.
    rows = rows.withColumn("_bal", F.col("_sum") - F.least(F.lit(0), F.col("_low")))
    rows = rows.withColumn("_level", F.when(F.col("delta") == -1, F.col("_bal") + 1).otherwise(F.col("_bal")))
    rows = rows.withColumn("_close", F.when(F.col("closes"), F.col("_point")))
    rows = rows.withColumn(
        "_next",
        F.expr(f"lead(_close, 1) IGNORE NULLS OVER (PARTITION BY {key}, fam, _level ORDER BY idx)"),
    )
    page_end = F.struct(
        F.col("n_tokens").alias("idx"), F.col("n_texts").alias("texts"), F.lit(None).cast("string").alias("closed"),
        F.col("_total").alias("seen"),
    )
    end = F.coalesce(
        F.col("_next"),
        F.when(F.col("tag").isin(*INLINE_TAGS), F.col("_block")),
        page_end,
    )
    is_start = F.col("kind") == "open"
    return (
        rows.filter(F.col("_no") == 0)
        .withColumn("_end", F.when(is_start, end).when(F.col("kind") == "void", F.col("_point")))
        .select(
            key, "idx", "token", "tag", "kind", "texts_before", "leaf",
            F.col("_end.idx").alias("end_idx"), F.col("_end.texts").alias("texts_end"),
            (F.col("_end.idx") + F.when(is_start & (F.col("_end.closed") == F.col("tag")), 1).otherwise(0)).alias(
                "cover_end"
            ),
            *(["seen", F.col("_end.seen").alias("seen_end")] if has_counts else []),
        )
    )


Flag = "str | tuple[str, ...] | Callable[[Column], Column]"


def _families_known() -> dict[tuple[str, str], tuple]:
    """Family steps of the tags that belong to more than their own family, by kind and tag."""
    listed = set(BLOCK_TAGS) | {t for _, members, containers, closers in IMPLIED for t in [*members, *containers, *closers]}
    return {(kind, tag): tuple(_families_of(tag, kind)) for tag in sorted(listed) for kind in ("open", "close")}


def _elements(tokens: Column, opaque: tuple[str, ...]) -> Column:
    """Tokens as structs (token, tag, kind, attrs, cls, elem_id); the last three of elements only."""
    rows = F.transform(tokens, lambda t: F.struct(t.alias("token"), tag_name(t).alias("tag")))
    named = lambda e, *names: [e[n].alias(n) for n in names]
    rows = F.transform(
        rows, lambda e: F.struct(*named(e, "token", "tag"), token_kind(e["token"], e["tag"], opaque).alias("kind"))
    )
    attrs = lambda e: F.when(e["kind"].isin("open", "void"), attribute_map(e["token"]))
    rows = F.transform(rows, lambda e: F.struct(*named(e, "token", "tag", "kind"), attrs(e).alias("attrs")))
    return F.transform(
        rows,
        lambda e: F.struct(
            *named(e, "token", "tag", "kind", "attrs"),
            F.when(e["attrs"].isNotNull(), class_text(e["attrs"])).alias("cls"), attribute(e["attrs"], "id").alias("elem_id"),
        ),
    )


def element_nodes(
    captures: DataFrame,
    key: str = "capture_id",
    html: str = "html",
    opaque: tuple[str, ...] = STRUCTURE_OPAQUE,
    levels: int = 3,
    areas: dict[str, Flag] | None = None,
    counted: tuple[str, ...] = (),
    parent_text_for: Callable[[Column], Column] | None = None,
    texts: tuple[str, ...] = ("text",),
    latest: dict[str, Flag] | None = None,
    following: dict[str, Flag] | None = None,
    refs: Callable[[Column], Column] | None = None,
    said: dict[str, tuple[str, Callable[[Column], Column]]] | None = None,
    family_has: dict[str, tuple] | None = None,
    roots: tuple[str, str, tuple[str, ...]] | None = None,
    up_fields: tuple[str, ...] = UP_FIELDS,
    carry: tuple[str, ...] = (),
    whole: bool = False,
) -> DataFrame:
    """Elements and non-blank text runs (or ``whole``: all tokens) with text, depth and nearest ancestors.

    Adds attrs, cls, elem_id, depth, children (elements right below) and up_1..up_<levels>: struct(idx,
    end_idx, tag, cls, style, role, texts_before, texts_end) of the parent, its parent, and so on (NULL above
    the root), and per area in_<area>, the number of enclosing elements for which it holds; body, form,
    header, footer, nav and label are always counted. A flag is a tag, several, or a test of an element's struct.

    ``texts``: "text" (stripped pieces of the subtree joined without a separator), "raw_text", "spaced_text".
    ``up_text`` is the parent's text of the nodes where ``parent_text_for`` holds. last_<name> is the latest
    element of ``latest`` before a node that is still open, next_<name> the next one of ``following``; with
    ``refs`` ref_before and ref_first are the labels with the same reference (the last before, the first in the
    same form), sib, sib_wide and sib_said what stands beside a field, next_sib the next element beside one. ``said`` adds texts of such places,
    ``family_has`` whether a sibling passes a test (for the nodes of a second one; "before": an earlier sibling), ``carry`` columns of the
    captures. ``roots`` (inside, otherwise, without): is_root marks the elements right below ``inside``, or on
    pages without one below ``otherwise`` or nothing, last_root is the latest of them that is still open.
    ``seen``, ``seen_end`` count the tags of ``counted`` up to a node and to its end.

    A page is taken apart as one row of arrays, which are exploded once all this is known.
    """
    areas = {**{tag: tag for tag in ("body", "form", "header", "footer", "nav", "label")}, **(areas or {})}
    latest, following = latest or {}, following or {}
    specs = {**{f"in {n}": f for n, f in areas.items()}, **{f"last {n}": f for n, f in latest.items()}, **{f"next {n}": f for n, f in following.items()}}
    tests = [name for name, flag in specs.items() if callable(flag)]
    tags = lambda flag: None if callable(flag) else ((flag,) if isinstance(flag, str) else tuple(flag))
    shape = {
        "known": _families_known(), "inline": tuple(INLINE_TAGS), "blocks": tuple(BLOCK_TAGS), "levels": levels, "counted": tuple(counted),
        "flags": {name: (tags(flag), tests.index(name) if callable(flag) else 0) for name, flag in specs.items()},
        "areas": list(areas), "latest": list(latest), "following": list(following), "refs": refs is not None, "roots": roots,
    }
    return _nodes(
        _page_arrays(captures, key, html, opaque, [specs[n] for n in tests], refs, carry, shape),
        key, shape, texts, parent_text_for, said or {}, family_has or {}, up_fields, carry, whole,
    )


def _page_arrays(
    captures: DataFrame, key: str, html: str, opaque: tuple[str, ...], tests: list, refs, carry: tuple[str, ...], shape: dict
) -> DataFrame:
    """One row per capture: key, ``carry``, arrays of elements, tree places, texts and stripped texts."""
    base = by_capture(captures.select(key, *carry, F.coalesce(html, F.lit("")).alias("_html")), key)
    base = base.select(key, *carry, token_array(F.col("_html"), opaque).alias("_tokens"))
    base = base.select(key, *carry, _elements(F.col("_tokens"), opaque).alias("_els"))
    is_element = lambda e: e["kind"].isin("open", "void")
    bit = lambda e, k: F.when(F.coalesce(tests[k](e), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    mask = lambda e: F.when(is_element(e), sum((bit(e, k) for k in range(1, len(tests))), bit(e, 0))).otherwise(F.lit(0).cast("long"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    full = lambda e: F.when(blank(e["token"]), "#blank").when(strip(decode_entities(e["token"])) == "", "#empty").otherwise("#said")
    marks = F.transform("_els", lambda e: F.concat_ws(" ", e["kind"], F.when(e["kind"] == "text", full(e)).otherwise(e["tag"])))
    masks = F.transform("_els", mask) if tests else none("long")
    names = F.transform("_els", refs) if refs else none("string")

    def trees(marks: pa.Array, masks: pa.Array, refs: pa.Array) -> pa.Array:
        return page_tree.page_trees(marks, masks, refs, shape)

    fields = ", ".join(f"{name}: int" for name in page_tree.fields_of(shape))
    base = base.withColumn("_tree", F.arrow_udf(trees, f"array<struct<{fields}>>")(marks, masks, names))
    raw = F.transform(F.filter("_els", lambda e: e["kind"] == "text"), lambda e: decode_entities(e["token"]))
    pages = base.select(key, *carry, "_els", "_tree", raw.alias("_texts"))
    return pages.select("*", F.transform("_texts", strip).alias("_strip"))


def _nodes(
    pages: DataFrame, key: str, shape: dict, texts: tuple[str, ...], parent_text_for, said: dict, family_has: dict,
    up_fields: tuple[str, ...], carry: tuple[str, ...], whole: bool,
) -> DataFrame:
    """The arrays of a page as rows of nodes."""
    element_at = lambda i: F.get("_els", i)
    tree_at = lambda i: F.get("_tree", i)

    def span(array: str, t: Column, joiner: str) -> Column:
        length = F.greatest(F.coalesce(t["te"], t["tb"] + 1) - t["tb"], F.lit(0))
        return F.array_join(F.slice(F.col(array), t["tb"] + 1, length), joiner)

    forms = {"text": ("_strip", ""), "raw_text": ("_texts", ""), "spaced_text": ("_texts", " ")}
    counts = lambda t, side: F.struct(*[t[f"{side}_{name}"].alias(name) for name in shape["counted"]])
    counted = lambda t: [counts(t, "seen").alias("seen"), counts(t, "ended").alias("seen_end")] if shape["counted"] else []

    def offer(at: Column) -> Column:
        e, t = element_at(at), tree_at(at)
        style, role = (F.coalesce(attribute(e["attrs"], name), F.lit("")) for name in ("style", "role"))
        offered = dict(zip(UP_FIELDS, (at, t["end"], e["tag"], e["cls"], style, role, t["tb"], t["te"])))
        if shape["counted"]:
            offered |= {"seen": counts(t, "seen"), "seen_end": counts(t, "ended")}
        return F.when(at.isNotNull(), F.struct(*[offered[name].alias(name) for name in up_fields]))

    plain = ["children", *[f"in_{n}" for n in shape["areas"]], *[f"last_{n}" for n in shape["latest"]], *[f"next_{n}" for n in shape["following"]]]
    plain += ["ref_before", "ref_first", "sib", "sib_wide", "sib_said", "next_sib"] if shape["refs"] else []
    plain += ["is_root", "last_root"] if shape["roots"] else []
    names = ("kind", "tag", "token", "attrs", "cls", "elem_id")

    def node(n: Column) -> Column:
        e, t = n["e"], n["t"]
        return F.struct(
            n["idx"].alias("idx"), t["end"].alias("end_idx"), *[e[name].alias(name) for name in names], t["depth"].alias("depth"),
            t["tb"].alias("texts_before"), t["te"].alias("texts_end"), (t["leaf"] == 1).alias("leaf"),
            *[offer(t[f"up_{k}"]).alias(f"up_{k}") for k in range(1, shape["levels"] + 1)],
            *[t[name].alias(name) for name in plain], *counted(t),
            *[span(forms[name][0], t, forms[name][1]).alias(name) for name in texts],
        )

    rows = F.transform("_tree", lambda t, i: F.struct(i.alias("idx"), t.alias("t"), element_at(i).alias("e")))
    if not whole:
        rows = F.filter(rows, lambda n: n["e"]["kind"].isin("open", "void") | ((n["e"]["kind"] == "text") & ~blank(n["e"]["token"])))
    rows = F.transform(rows, node)
    # What looks at a node's own text or at other places comes after it is a struct.
    places = {name: lambda n, at=at, when=when: F.when(when(n), span("_strip", tree_at(n[at]), "")) for name, (at, when) in said.items()}
    if parent_text_for is not None:
        up = lambda n: tree_at(n["up_1"]["idx"])
        places["up_text"] = lambda n: F.when(
            ~n["up_1"]["tag"].isin(*TEXTLESS_PARENTS) & parent_text_for(n), span("_strip", up(n), "")
        )
    if family_has:
        pages = pages.select("*", rows.alias("_rows"))
        parent = lambda n: F.coalesce(n["up_1"]["idx"], F.lit(-1))
        kin = lambda n: F.struct(parent(n).alias("up"), n["idx"].alias("idx"))
        found = [F.transform(F.filter("_rows", test), kin).alias(f"_of_{name}") for name, (test, *_) in family_has.items()]
        pages, rows = pages.select("*", *found), F.col("_rows")

        def related(name: str, when, *side: str):
            beside = lambda n: F.array_contains(F.col(f"_of_{name}")["up"], parent(n))
            before = lambda n: F.exists(f"_of_{name}", lambda m: (m["up"] == parent(n)) & (m["idx"] < n["idx"]))
            return lambda n: when(n) & (before(n) if side else beside(n))

        places |= {name: related(name, *rest) for name, (_, *rest) in family_has.items()}
    if places:
        rows = F.transform(rows, lambda n: F.struct(n.alias("n"), *[make(n).alias(name) for name, make in places.items()]))
    # The outer form keeps the optimiser from testing the array (a second pass) in a filter of its own.
    out = pages.select(key, *carry, F.explode_outer(rows).alias("_n"))
    if places:
        out = out.select(key, *carry, "_n.n.*", *[f"_n.{name}" for name in places])
    else:
        out = out.select(key, *carry, "_n.*")
    return out.filter(F.col("idx").isNotNull())


def carried(rows: DataFrame, name: str, condition: Column, value: Column, key: str = "capture_id") -> DataFrame:
    """Adds the innermost-latest element with ``condition`` that is still open at each row.

    ``value`` must be a struct holding end_idx; meant for elements that do not nest.
    """
    rows = rows.withColumn("_v", F.when(condition, value)).withColumn(
        "_last",
        F.expr(
            f"last(_v) IGNORE NULLS OVER (PARTITION BY {key} ORDER BY idx "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ),
    )
    return rows.withColumn(name, F.when(F.col("_last.end_idx") > F.col("idx"), F.col("_last"))).drop("_v", "_last")


def inside(tag: str) -> Column:
    """Number of ``tag`` elements below an element, from the running counts."""
    return F.col(f"seen_end.{tag}") - F.col(f"seen.{tag}") - F.when(F.col("tag") == tag, 1).otherwise(0)
