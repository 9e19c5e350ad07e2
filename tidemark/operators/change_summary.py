"""Readable summary of a change from its added and removed lines.

Input rows hold two arrays, ``added`` and ``removed``, of whole lines. All steps are array
expressions on that row, so a summary costs no shuffle. Messages are short; what they leave out
is in the list of items, and their last line counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import strip_tags
from tidemark.functions.text import collapse, lookup, none_if_empty, shorten, strip
from tidemark.rules import summary as fixed

NO_STRINGS = "array<string>"
MESSAGES = "array<struct<short:string,whole:string>>"


def split_signs(diffs: DataFrame, text: str = "diff_text") -> DataFrame:
    """Adds added and removed line arrays of a diff text, signs cut off, file headers left out."""
    lines = F.split(text, r"\r?\n")
    pick = lambda sign: F.transform(
        F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)),
        lambda x: F.substring(x, 2, 2_000_000_000),
    )
    return diffs.withColumn("added", pick("+")).withColumn("removed", pick("-"))


def _tag_texts(text: Column) -> Column:
    """(tag, text) pairs of visible texts in labelled elements."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(fixed.TEXT_IN_TAG), F.lit(1)), F.lower)
    inner = F.transform(
        F.regexp_extract_all(text, F.lit(fixed.TEXT_IN_TAG), F.lit(2)), lambda x: collapse(strip_tags(x))
    )
    pairs = F.zip_with(tags, inner, lambda t, x: F.struct(t.alias("tag"), x.alias("text")))
    return F.filter(pairs, lambda p: ~p["text"].isin(*fixed.MASKS) & (F.length(p["text"]) > 1))


def _quoted(text: Column, length: int) -> Column:
    return F.concat(F.lit("「"), shorten(text, length), F.lit("」"))


def text_changes(added: Column, removed: Column) -> Column:
    """Messages per tag, tags in order of first occurrence. Arguments are (tag, text) arrays."""
    tags = F.array_distinct(F.concat(F.transform(added, lambda p: p["tag"]), F.transform(removed, lambda p: p["tag"])))

    def of_tag(tag: Column) -> Column:
        new = F.transform(F.filter(added, lambda p: p["tag"] == tag), lambda p: p["text"])
        old = F.transform(F.filter(removed, lambda p: p["tag"] == tag), lambda p: p["text"])
        label = lookup(tag, fixed.TEXT_TAG_LABELS, tag)
        first_old = F.get(old, F.lit(0))
        other = F.get(F.filter(F.slice(new, 1, 2), lambda x: x != first_old), F.lit(0))
        swapped = F.concat(label, F.lit("テキスト変更:"), _quoted(first_old, 25), F.lit("→"), _quoted(other, 25))
        listed = lambda xs, word: F.transform(
            F.slice(xs, 1, 3), lambda x: F.concat(label, F.lit(word + ":"), _quoted(x, 30))
        )
        return (
            F.when((F.size(new) > 0) & (F.size(old) > 0), F.array_compact(F.array(swapped)))
            .when(F.size(new) > 0, listed(new, "追加"))
            .otherwise(listed(old, "削除"))
        )

    return F.flatten(F.transform(tags, of_tag))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, inside other array functions as well."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(xs: Column, ys: Column) -> Column:
    """Multiset difference: the copies of each text in ``xs`` beyond those in ``ys``."""
    copies = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.flatten(F.transform(F.array_distinct(xs), lambda x: F.array_repeat(x, F.greatest(copies(xs, x) - copies(ys, x), F.lit(0)))))


def all_text_changes(added: Column, removed: Column) -> Column:
    """Messages of every text a tag gained or lost, whole, one for each copy; the n-th lost and gained ones are a swap."""
    tags = F.array_distinct(F.concat(F.transform(added, lambda p: p["tag"]), F.transform(removed, lambda p: p["tag"])))

    def of_tag(tag: Column) -> Column:
        texts = lambda xs: F.transform(F.filter(xs, lambda p: p["tag"] == tag), lambda p: p["text"])
        new, old = texts(added), texts(removed)
        label = lookup(tag, fixed.TEXT_TAG_LABELS, tag)
        quoted = lambda x: F.concat(F.lit("「"), x, F.lit("」"))
        return F.zip_with(
            _without(old, new), _without(new, old),
            lambda o, n: F.when(o.isNull(), F.concat(label, F.lit("追加:"), quoted(n)))
            .when(n.isNull(), F.concat(label, F.lit("削除:"), quoted(o)))
            .otherwise(F.concat(label, F.lit("テキスト変更:"), quoted(o), F.lit("→"), quoted(n))),
        )

    return F.flatten(F.transform(tags, of_tag))


def snippet_parts(lines: Column, pattern: Column) -> Column:
    """What the first matching block holds: texts, input hints, id, class; all empty if nothing matches."""
    hit = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.concat(F.lit("(?i)"), pattern))), True)
    block = F.when(hit > 0, F.array_join(F.slice(lines, hit.cast("int"), fixed.SNIPPET_LINES), "\n")).otherwise("")

    def parts(block: Column) -> Column:
        texts = F.transform(
            F.regexp_extract_all(block, F.lit(fixed.SNIPPET_IN_TAG), F.lit(2)), lambda x: collapse(strip_tags(x))
        )
        texts = F.filter(texts, lambda x: ~x.isin(*fixed.MASKS) & (F.length(x) > 1))
        hints = F.transform(F.regexp_extract_all(block, F.lit(fixed.INPUT_HINT), F.lit(1)), strip)
        hints = F.filter(hints, lambda x: (x != "") & (x != "[TEXT]"))
        identity = F.regexp_extract(F.regexp_extract(block, r'(?i)\bid="([^"]+)"', 1), r"^\s*(\S+)", 1)
        identity = F.when(~F.lower(identity).isin(*fixed.GENERIC_NAMES), identity)
        classes = F.split(strip(F.regexp_extract(block, r'(?i)\bclass="([^"]+)"', 1)), r"\s+")
        named = F.get(
            F.filter(classes, lambda c: ~F.lower(c).isin(*fixed.GENERIC_NAMES) & (F.length(c) > 3)), F.lit(0)
        )
        return F.struct(texts.alias("texts"), hints.alias("hints"), identity.alias("identity"), named.alias("named"))

    return _once(block, parts)


def said(parts: Column, whole: bool = False) -> Column:
    """Texts, else input hints, else id, else class, in brackets: the first few, shortened, or all."""
    few = lambda xs, count, length: F.transform(F.slice(xs, 1, count), lambda x: shorten(x, length))
    texts = parts["texts"] if whole else few(parts["texts"], 3, 20)
    hints = parts["hints"] if whole else few(parts["hints"], 4, 15)
    words = [none_if_empty(F.array_join(texts, " / ")), none_if_empty(F.array_join(hints, " / ")), none_if_empty(parts["identity"]), parts["named"]]
    return F.coalesce(F.concat(F.lit(" ["), none_if_empty(F.coalesce(*words)), F.lit("]")), F.lit(""))


def structure_changes(added: Column, removed: Column, added_text: Column, removed_text: Column) -> Column:
    """(short, whole) messages on labelled structure patterns: newly there, gone, or grown by n."""
    # A fixed pattern is compiled once, one out of an array for every row: only the rules that match go on.
    hit = lambda p: added_text.rlike("(?i)" + p) | removed_text.rlike("(?i)" + p)
    rules = F.array_compact(F.array(
        *[F.when(hit(p), F.struct(F.lit(p).alias("pattern"), F.lit(name).alias("label"))) for p, name in fixed.STRUCTURE_RULES]
    ))

    def of_rule(rule: Column) -> Column:
        pattern = F.concat(F.lit("(?i)"), rule["pattern"])
        new, old = F.regexp_count(added_text, pattern), F.regexp_count(removed_text, pattern)
        head = lambda *words: F.concat(rule["label"], *words)

        def message(head: Column, lines: Column) -> Column:
            return _once(snippet_parts(lines, rule["pattern"]), lambda parts: F.struct(
                F.concat(head, said(parts)).alias("short"), F.concat(head, said(parts, whole=True)).alias("whole")
            ))

        return (
            F.when((new > 0) & (old == 0), message(head(F.lit("が新規追加")), added))
            .when((old > 0) & (new == 0), message(head(F.lit("が削除")), removed))
            .when(new > old, message(head(F.lit("が追加 (+"), (new - old).cast("string"), F.lit(")")), added))
        )

    return F.array_compact(F.transform(rules, of_rule))


def field_names(lines: Column) -> Column:
    """Per form-field line its first usable name."""
    fields = F.filter(lines, lambda x: x.rlike(fixed.FIELD_TAG))

    def name_of(line: Column) -> Column:
        values = F.transform(F.regexp_extract_all(line, F.lit(fixed.FIELD_NAME), F.lit(1)), strip)
        return F.get(F.filter(values, lambda v: (v != "") & ~v.startswith("[")), F.lit(0))

    return F.array_compact(F.transform(fields, name_of))


def form_changes(added: Column, removed: Column, added_text: Column, removed_text: Column) -> Column:
    """(short, whole) messages of field names gained and lost; none when a form element itself came or went."""
    new, old = field_names(added), field_names(removed)
    minus = lambda xs, ys: F.filter(xs, lambda x: ~F.array_contains(ys, x))

    def message(names: Column, word: str) -> Column:
        said = lambda xs: F.concat(F.lit(f"フォームフィールド{word}: 「"), F.array_join(xs, "」「"), F.lit("」"))
        more = F.when(
            F.size(names) > 5, F.concat(F.lit("など"), F.size(names).cast("string"), F.lit("項目"))
        ).otherwise("")
        first = F.transform(F.slice(names, 1, 5), lambda x: shorten(x, 15))
        return F.when(F.size(names) > 0, F.struct(F.concat(said(first), more).alias("short"), said(names).alias("whole")))

    form = r"(?i)<form\b"
    out = F.array_compact(F.array(
        _once(minus(new, old), lambda names: message(names, "追加")), _once(minus(old, new), lambda names: message(names, "削除"))
    ))
    return F.when(added_text.rlike(form) | removed_text.rlike(form), F.array().cast(MESSAGES)).otherwise(out)


def accessibility_growth(added: Column, removed: Column) -> Column:
    marked = lambda xs: F.size(
        F.filter(xs, lambda x: F.contains(x, F.lit("aria-")) | F.contains(x, F.lit("role=")))
    )
    return F.when(
        marked(added) > marked(removed) + 2, F.array(F.lit("アクセシビリティ属性（aria/role）が追加"))
    ).otherwise(F.array().cast(NO_STRINGS))


def keyword_counts(text: Column, keywords: list[str] | None = None, ascii_borders: bool = False) -> Column:
    """Array of (keyword, n) with n > 0: whole words, else parts of words.

    Letters of any script end no word; with ``ascii_borders`` all but ASCII letters, digits and _ do.
    """
    words = list(fixed.UI_KEYWORDS) if keywords is None else keywords
    lowered = F.lower(text)
    first, last = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])") if ascii_borders else (r"(?U)\b", r"\b")

    def counted(word: Column) -> Column:
        # A pattern made of a column is compiled anew each time, so only for words that are there.
        whole = F.when(F.contains(lowered, word), F.regexp_count(lowered, F.concat(F.lit(first), word, F.lit(last)))).otherwise(0)
        parts = ((F.length(lowered) - F.length(F.replace(lowered, word, F.lit("")))) / F.length(word)).cast("int")
        return F.struct(word.alias("keyword"), F.when(whole > 0, whole).otherwise(parts).alias("n"))

    return F.filter(F.transform(F.array(*[F.lit(w) for w in words]), counted), lambda x: x["n"] > 0)


def summarise_changes(diffs: DataFrame, name: str = "summary") -> DataFrame:
    """Adds the summary text of rows with ``added`` and ``removed`` line arrays.

    ``<name>_items`` holds every change, each copy of a text, all of it whole; the summary shows
    the first few, shortened, and says how many more there are.
    """
    data = diffs.withColumn("_at", F.array_join("added", "\n")).withColumn("_rt", F.array_join("removed", "\n"))
    data = data.withColumn("_ap", _tag_texts(F.col("_at"))).withColumn("_rp", _tag_texts(F.col("_rt")))
    others = F.concat(
        structure_changes(F.col("added"), F.col("removed"), F.col("_at"), F.col("_rt")),
        form_changes(F.col("added"), F.col("removed"), F.col("_at"), F.col("_rt")),
    )
    data = data.withColumn("_others", others).withColumn("_marks", accessibility_growth(F.col("added"), F.col("removed")))
    texts = text_changes(F.col("_ap"), F.col("_rp"))
    data = data.withColumn("_items", F.array_distinct(F.concat(texts, F.col("_others.short"), "_marks")))
    data = data.withColumn(f"{name}_items", F.concat(all_text_changes(F.col("_ap"), F.col("_rp")), F.col("_others.whole"), "_marks"))
    n_items = F.size("_items")
    dotted = F.array_join(F.transform(F.slice("_items", 1, fixed.SHOWN_ITEMS), lambda x: F.concat(F.lit("・"), x)), "\n")
    left = F.greatest(n_items, F.size(f"{name}_items")) - F.least(n_items, F.lit(fixed.SHOWN_ITEMS))
    rest = F.when(left > 0, F.concat(F.lit("\n・他"), left.cast("string"), F.lit("件の変更"))).otherwise("")
    total = F.size("added") + F.size("removed")
    found = keyword_counts(F.concat_ws("\n", F.col("_at"), F.col("_rt")))
    labels = F.transform(F.slice(found, 1, 3), lambda x: lookup(x["keyword"], fixed.UI_KEYWORDS, x["keyword"]))
    tail = F.concat(F.lit("（"), total.cast("string"), F.lit("行）— 詳細はDOM差分を参照"))
    summary = (
        F.when(n_items > 0, F.concat(dotted, rest))
        .when(F.size(found) > 0, F.concat(F.array_join(labels, ", "), F.lit("周辺の構造変更"), tail))
        .when(total > 0, F.concat(F.lit("DOM構造の変更"), tail))
        .otherwise("DOM構造に変更を検知")
    )
    return data.withColumn(name, summary).drop("_at", "_rt", "_ap", "_rp", "_items", "_others", "_marks")
