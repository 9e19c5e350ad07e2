"""Press listings, article bodies and article dates from captured pages.

A listing strategy is a set of candidate rows on the node table; the lowest strategy
number with a row wins on each page. Links, dates and headings inside an item are found
with ordered look-ahead over the nodes of the page, not by pairing nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.dates import date_from_text, date_text
from tidemark.functions.html import attribute, has_class
from tidemark.functions.text import any_of, ascii_digits, chain, collapse, cut, none_if_empty
from tidemark.lineage import cut_lineage
from tidemark.operators.tokens import carried, element_nodes
from tidemark.rules import press as fixed

OPAQUE = ("script", "style", "noscript", "iframe")


def profile_of(source_name: Column) -> Column:
    low = F.lower(source_name)
    return chain([(F.contains(low, F.lit(part)), F.lit(name)) for part, name in fixed.PROFILE_NAMES], F.lit("generic"))


def truncated_title(text: Column) -> Column:
    return cut(text, fixed.TITLE_LIMIT)


def truncated_url(url: Column) -> Column:
    return cut(url, fixed.URL_LIMIT)


def truncated_body(text: Column) -> Column:
    return cut(text, fixed.BODY_LIMIT)


def is_article(title: Column, url: Column, listing_url: Column) -> Column:
    """Not the listing itself, no navigation path or title, title of ten characters or more."""
    bare = lambda u: F.rtrim(u, F.lit("/"))
    itself = (F.coalesce(listing_url, F.lit("")) != "") & (bare(url) == bare(listing_url))
    return F.coalesce(
        (title != "") & (url != "") & ~itself & ~urls.path(url).rlike(fixed.NOT_ARTICLE_PATH)
        & ~collapse(title).rlike(fixed.NOT_ARTICLE_TITLE) & (F.length(collapse(title)) >= 10),
        F.lit(False),
    )


def _attr(name: str) -> Column:
    return F.coalesce(attribute(F.col("attrs"), name), F.lit(""))


def _areas() -> dict[tuple, str]:
    """Enclosing (tag, class) pairs that any selector asks for, with a column name each."""
    wanted = []
    for profile in fixed.LISTING_PROFILES.values():
        for _, selectors in profile["strategies"]:
            wanted += [(tag, cls) for _, _, tag, cls in selectors if tag or cls]
    return {pair: f"sel_{i}" for i, pair in enumerate(dict.fromkeys(wanted))}


def _area_flag(tag: str | None, cls: str | None):
    """Flag of the elements of one (tag, class) pair."""
    if not cls:
        return tag
    classed = lambda e: has_class(F.coalesce(e["cls"], F.lit("")), cls)
    return classed if not tag else lambda e: (e["tag"] == tag) & classed(e)


def _matches(selector: tuple, areas: dict[tuple, str]) -> Column:
    tag, cls, up_tag, up_cls = selector
    test = F.lit(True)
    if tag:
        test = test & (F.col("tag") == tag)
    if cls:
        test = test & has_class(F.col("cls"), cls)
    if up_tag or up_cls:
        test = test & (F.col(f"in_{areas[(up_tag, up_cls)]}") > 0)
    return test


def _ahead(rows: DataFrame, key: str, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds per name the first later node with its condition; it lies inside a row when its idx is below end_idx."""
    marked = rows.select("*", *[F.when(condition, value).alias(f"_m{name}") for name, (condition, value) in found.items()])
    ahead = lambda name: F.expr(f"lead(_m{name}, 1) IGNORE NULLS OVER (PARTITION BY {key} ORDER BY idx)")
    return marked.select(*rows.columns, *[ahead(name).alias(name) for name in found])


def _inside(name: str) -> Column:
    return F.when(F.col(f"{name}.idx") < F.col("end_idx"), F.col(name))


def listing_rows(listings: DataFrame, key: str = "capture_id") -> DataFrame:
    """Articles named on listing pages: key, idx, strategy_no, title, url, published_on.

    ``listings``: key, source_name, base_url, html.
    """
    areas = _areas()
    listings = listings.select(key, "html", profile_of(F.col("source_name")).alias("profile"), "base_url")
    flags = {name: _area_flag(*pair) for pair, name in areas.items()}
    nodes = element_nodes(
        listings, key, "html", OPAQUE, levels=1, areas=flags, texts=("raw_text",), carry=("profile", "base_url")
    )
    nodes = nodes.filter(F.col("kind") != "text")
    said = collapse(F.col("raw_text"))
    link = F.struct("idx", _attr("href").alias("href"), said.alias("title"), F.map_contains_key("attrs", "href").alias("has"))
    is_a = F.col("tag") == "a"
    stamp = F.struct("idx", F.coalesce(none_if_empty(_attr("datetime")), F.col("raw_text")).alias("said"))
    all_classes = list(dict.fromkeys(c for p in fixed.LISTING_PROFILES.values() for c in p["date_classes"]))
    plain = F.struct("idx", F.col("raw_text").alias("said"))
    any_dated = has_class(F.col("cls"), "date") | has_class(F.col("cls"), "time") | F.contains(_attr("class"), F.lit("date"))
    rows = _ahead(nodes, key, {
        "_link": (is_a, link), "_href": (is_a & F.map_contains_key("attrs", "href"), link),
        "_head234": (F.col("tag").isin("h2", "h3", "h4"), F.struct("idx", "end_idx", said.alias("title"))),
        "_time": (F.col("tag") == "time", stamp), "_anydate": (any_dated, plain),
        **{f"_date{i}": (has_class(F.col("cls"), name), plain) for i, name in enumerate(all_classes)},
    })
    head = F.struct("idx", "end_idx", said.alias("title"), _inside("_link").alias("link"))
    rows = _ahead(rows, key, {"_head": (F.col("tag").isin("h1", "h2", "h3", "h4"), head)})
    around = F.struct("idx", "end_idx", _attr("href").alias("href"), said.alias("title"), F.lit(True).alias("has"))
    rows = carried(rows, "_around", is_a, around, key)
    siblings = Window.partitionBy(key, "up_1.idx").orderBy("idx")
    in_dd = F.when(F.col("tag") == "dd", F.struct("idx", _inside("_link").alias("link")))
    rows = rows.withColumn("_dd", in_dd).withColumn("_up", F.col("up_1.idx"))
    rows = rows.withColumn(
        "_dd_next", F.expr(f"lead(_dd, 1) IGNORE NULLS OVER (PARTITION BY {key}, _up ORDER BY idx)")
    ).withColumn("_sib_link", F.lead(F.struct(_inside("_link").alias("link"))).over(siblings))

    by_class = {
        name: F.coalesce(*[_inside(f"_date{all_classes.index(c)}")["said"] for c in p["date_classes"]])
        if p["date_classes"] else F.lit(None).cast("string")
        for name, p in fixed.LISTING_PROFILES.items()
    }
    by_class["generic"] = _inside("_anydate")["said"]
    candidates, numbers = [], {}
    for name, profile in fixed.LISTING_PROFILES.items():
        near = date_from_text(
            F.coalesce(_inside("_time")["said"], by_class[name], date_text(F.col("raw_text")), F.lit(""))
        )
        for number, (kind, selectors) in enumerate(profile["strategies"], 1):
            hit = (F.col("profile") == name) & any_of([_matches(s, areas) for s in selectors])
            title, href, day, ok = _candidate(kind, near)
            good = hit & ok & (F.coalesce(title, F.lit("")) != "") & (F.coalesce(href, F.lit("")) != "")
            candidates.append(F.when(good, _row(number, title, href, day, kind == "dated")))
        numbers[name] = len(profile["strategies"]) + 1
        if profile["fallback"]:
            good = (
                (F.col("profile") == name) & is_a & F.map_contains_key("attrs", "href")
                & _attr("href").rlike(profile["fallback"]) & (F.length(said) >= 5)
            )
            candidates.append(F.when(good, _row(numbers[name], said, _attr("href"), F.lit(None).cast("string"), True)))
    rows = rows.select(key, "idx", "base_url", F.explode(F.array_compact(F.array(*candidates))).alias("_c"))
    rows = rows.select(
        key, "idx", F.col("_c.strategy_no").alias("strategy_no"), truncated_title(F.col("_c.title")).alias("title"),
        truncated_url(urls.resolve(F.col("_c.href"), F.col("base_url"))).alias("url"),
        F.col("_c.published_on").alias("published_on"), F.col("_c.once").alias("once"),
    )
    page = Window.partitionBy(key)
    rows = rows.withColumn("_best", F.min("strategy_no").over(page)).filter("strategy_no = _best")
    rows = rows.filter(~F.col("once") | ~F.col("url").rlike(fixed.DATED_SKIP) | F.col("published_on").isNull())
    same = Window.partitionBy(key, "url").orderBy("idx")
    rows = rows.withColumn("_n", F.row_number().over(same)).filter(~F.col("once") | (F.col("_n") == 1))
    return rows.drop("_best", "_n", "once")


def _row(number: int, title: Column, href: Column, day: Column, once: bool) -> Column:
    return F.struct(
        F.lit(number).alias("strategy_no"), title.alias("title"), href.alias("href"),
        day.cast("string").alias("published_on"), F.lit(once).alias("once"),
    )


def _candidate(kind: str, near: Column) -> tuple[Column, Column, Column, Column]:
    """(title, href, date, extra condition) of a row under one kind of strategy."""
    link = _inside("_link")
    said = collapse(F.col("raw_text"))
    always = F.lit(True)
    if kind == "dt":
        found = F.col("_dd_next.link")
        return found["title"], found["href"], date_from_text(F.col("raw_text")), found["idx"].isNotNull()
    if kind == "item":
        return link["title"], link["href"], near, link["idx"].isNotNull()
    if kind in ("card", "titled"):
        around = F.col("_around")
        title = F.coalesce(link["title"], around["title"]) if kind == "card" else link["title"]
        href = F.coalesce(link["href"], around["href"]) if kind == "card" else link["href"]
        titled = F.when(F.length(title) < 3, F.coalesce(_inside("_head234")["title"], title)).otherwise(title)
        return titled, href, near, always
    if kind == "article":
        head = _inside("_head")
        poor = (F.length(link["title"]) < 3) | (link["href"] == "")
        title = F.when(poor, F.coalesce(head["title"], link["title"])).otherwise(link["title"])
        head_link = F.when(head["link"]["href"] != "", head["link"]["href"])
        href = F.when(poor, F.coalesce(head_link, link["href"])).otherwise(link["href"])
        return title, href, near, link["idx"].isNotNull()
    if kind == "list":
        ok = (F.length(link["title"]) >= 5) & ~link["href"].startswith("#") & (link["href"] != "/")
        return link["title"], link["href"], near, ok
    if kind == "heading":
        found_href = F.coalesce(link["href"], F.col("_sib_link.link.href"))
        return said, found_href, F.lit(None), always
    # dated
    own = F.col("tag") == "a"
    href = F.when(own, _attr("href")).otherwise(_inside("_href")["href"])
    title = F.when(own, said).otherwise(_inside("_href")["title"])
    rest = collapse(F.regexp_replace(said, fixed.DATED_PREFIX, ""))
    title = F.when((F.length(title) < 10) & (F.length(rest) > 10), cut(rest, fixed.TITLE_LIMIT)).otherwise(title)
    stamp, written = r"(\d{4})[./](\d{1,2})[./](\d{1,2})", ascii_digits(F.col("raw_text"))
    pad = lambda i: F.lpad(F.regexp_extract(written, stamp, i), 2, "0")
    day = F.concat_ws("-", F.regexp_extract(written, stamp, 1), pad(2), pad(3))
    ok = written.rlike(stamp) & (F.length(title) >= 10) & ~href.startswith("#") & (href != "/")
    return title, href, day, ok


def article_bodies(pages: DataFrame, key: str = "capture_id") -> DataFrame:
    """Body text per article page: first selector with enough text, else the largest block.

    ``pages``: key, source_name, html.
    """
    named = pages.withColumn("_profile", profile_of(F.col("source_name")))
    out = None
    for removed in dict.fromkeys(tuple(p["removed"]) for p in fixed.BODY_PROFILES.values()):
        names = [n for n, p in fixed.BODY_PROFILES.items() if tuple(p["removed"]) == removed]
        part = _bodies(named.filter(F.col("_profile").isin(*names)), names, removed, key)
        out = part if out is None else out.unionByName(part)
    return out


def _bodies(pages: DataFrame, names: list[str], removed: tuple[str, ...], key: str) -> DataFrame:
    chosen = _ranked_blocks(pages, names, (*OPAQUE, *removed), key, with_selectors=True, with_largest=bool(removed))
    if removed:
        best = chosen
    else:
        # Page furniture is cut out for the largest block only, and only the pages without
        # a selected block (normally few) are taken apart a second time.
        chosen = cut_lineage(chosen)
        rest = pages.join(chosen.select(key).distinct(), key, "left_anti")
        best = chosen.unionByName(_ranked_blocks(rest, names, (*OPAQUE, "nav", "header", "footer"), key, False, True))
    picked = best.groupBy(key).agg(F.min_by("body", "rank").alias("body_text"))
    return pages.select(key).join(picked, key, "left").select(key, F.coalesce("body_text", F.lit("")).alias("body_text"))


def _ranked_blocks(
    pages: DataFrame, names: list[str], opaque: tuple[str, ...], key: str, with_selectors: bool, with_largest: bool
) -> DataFrame:
    flags = {"article": "article", "main": "main"}
    nodes = element_nodes(
        pages, key, "html", opaque, levels=1, areas=flags, texts=("text", "spaced_text"), carry=("_profile",)
    ).filter(F.col("kind") == "open")
    ranks, need = [], []
    for name in names:
        profile = fixed.BODY_PROFILES[name]
        need.append((F.col("_profile") == name, F.lit(profile["least"])))
        for order, (tag, cls, elem_id, area) in enumerate(profile["selectors"]):
            test = F.col("_profile") == name
            if tag:
                test = test & (F.col("tag") == tag)
            if cls:
                test = test & has_class(F.col("cls"), cls)
            if elem_id:
                test = test & F.coalesce(F.col("elem_id") == elem_id, F.lit(False))
            if area:
                test = test & (F.col(f"in_{area}") > 0)
            ranks.append(F.when(test, F.lit(order)))
    parts = []
    if with_selectors:
        hits = nodes.withColumn("_order", F.explode(F.array_compact(F.array(*ranks))))
        first = Window.partitionBy(key, "_order").orderBy("idx")
        hits = hits.withColumn("_n", F.row_number().over(first)).filter(
            (F.col("_n") == 1) & (F.length("text") > chain(need, F.lit(50)))
        )
        parts.append(hits.select(key, F.struct(F.lit(0).alias("turn"), F.col("_order").cast("bigint").alias("order")).alias("rank"), "spaced_text"))
    if with_largest:
        tags = chain(
            [
                (F.col("_profile") == n, F.col("tag").isin(*fixed.LARGEST_TAGS.get(n, fixed.LARGEST_TAGS_DEFAULT)))
                for n in names
            ],
            F.lit(False),
        )
        blocks = nodes.filter(tags).withColumn("_size", F.length(collapse(F.col("spaced_text"))))
        largest = Window.partitionBy(key).orderBy(F.col("_size").desc(), "idx")
        blocks = blocks.withColumn("_n", F.row_number().over(largest)).filter("_n = 1")
        parts.append(blocks.select(key, F.struct(F.lit(1).alias("turn"), F.lit(0).cast("bigint").alias("order")).alias("rank"), "spaced_text"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select(key, "rank", truncated_body(collapse(F.col("spaced_text"))).alias("body"))


LD_JSON = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def structured_date(html: Column) -> Column:
    """Date of the first structured-data block that has one."""
    shape = "array<struct<datePublished:string,dateCreated:string>>"
    blocks = F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, shape), F.array().cast(shape))))
    found = F.transform(
        items, lambda i: date_from_text(F.coalesce(none_if_empty(i["datePublished"]), i["dateCreated"]))
    )
    return F.get(F.array_compact(found), F.lit(0))


def article_dates(pages: DataFrame, key: str = "capture_id", html: str = "html") -> DataFrame:
    """Publication date per article page: structured data, meta, time, date classes, header text."""
    nodes = element_nodes(pages, key, html, OPAQUE, levels=1, texts=("raw_text",)).filter(F.col("kind") != "text")
    first_of = Window.partitionBy(key, "_slot").orderBy("idx")
    metas = []
    for i, name in enumerate(fixed.DATE_META):
        metas.append(F.when(_attr("property") == name, F.lit(100 + 2 * i)))
        metas.append(F.when(_attr("name") == name, F.lit(101 + 2 * i)))
    classes = [F.when(has_class(F.col("cls"), c), F.lit(300 + i)) for i, c in enumerate(fixed.DATE_CLASSES)]
    raw_class = _attr("class")
    classes.append(F.when(F.contains(raw_class, F.lit("date")), F.lit(300 + len(fixed.DATE_CLASSES))))
    classes.append(F.when(F.contains(raw_class, F.lit("Date")), F.lit(301 + len(fixed.DATE_CLASSES))))
    none = F.array().cast("array<int>")
    slots = F.concat(
        F.when(F.col("tag") == "meta", F.array_compact(F.array(*metas))).otherwise(none),
        F.when(F.col("tag") == "time", F.array(F.lit(200))).otherwise(none),
        F.array_compact(F.array(*classes)),
        F.when(F.col("tag") == "header", F.array(F.lit(400))).otherwise(none),
        F.when(F.col("tag") == "article", F.array(F.lit(401))).otherwise(none),
    )
    rows = nodes.withColumn("_slot", F.explode(slots)).withColumn("_n", F.row_number().over(first_of))
    slot = F.col("_slot")
    limit = F.when(slot < 200, 1).when(slot < 300, 2_000_000_000).when(slot < 400, 2_000_000_000).otherwise(1)
    raw = F.col("raw_text")
    day = (
        F.when(slot < 200, date_from_text(_attr("content")))
        .when(slot < 300, F.coalesce(date_from_text(_attr("datetime")), date_from_text(raw)))
        .when(slot < 400, date_from_text(raw))
        .otherwise(date_from_text(date_text(raw)))
    )
    rows = rows.filter(F.col("_n") <= limit).select(key, "_slot", "idx", day.alias("_day"))
    # Property before name of one meta; the header area is the header, else the first article.
    has_header = F.max((F.col("_slot") == 400).cast("int")).over(Window.partitionBy(key)) == 1
    rows = rows.withColumn("_skip", (F.col("_slot") == 401) & has_header).filter(~F.col("_skip") & F.col("_day").isNotNull())
    listed = rows.groupBy(key).agg(F.min_by("_day", F.struct("_slot", "idx")).alias("_listed"))
    base = pages.select(key, structured_date(F.col(html)).alias("_structured"))
    return base.join(listed, key, "left").select(key, F.coalesce("_structured", "_listed").alias("published_on"))


def new_articles(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found articles whose (source_id, article_url) is not stored in any state; first of a listing wins."""
    once = Window.partitionBy("source_id", "article_url").orderBy("found_at", "idx")
    first = found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    known = stored.select("source_id", "article_url").distinct()
    return first.join(known, ["source_id", "article_url"], "left_anti")


def backfill_dates(articles: DataFrame, mode: str = "ordered", head_chars: int | None = None) -> DataFrame:
    """Undated live articles with the date found in their body (its first ``head_chars``, if given); NULL if none."""
    from tidemark.functions.dates import date_from_head

    live = articles.filter(F.col("published_at").isNull() & F.col("deleted_at").isNull())
    return live.select("id", "title", date_from_head(F.col("body_text"), mode, head_chars).alias("found_on"))


def backfill_counts(backfilled: DataFrame) -> DataFrame:
    """Dry-run report: total_without_date, updated, still_no_date."""
    return backfilled.agg(
        F.count(F.lit(1)).alias("total_without_date"), F.count("found_on").alias("updated"),
        F.count_if(F.col("found_on").isNull()).alias("still_no_date"),
    )


def press_digest(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """One message row per article: header, line and quoted summary."""
    rows = articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("不明"))
    line = F.format_string(
        "*<%s|%s>*\nソース: %s | 日付: %s | カテゴリ: %s",
        F.coalesce("article_url", F.lit("")), F.coalesce("title", F.lit("タイトル不明")),
        F.coalesce("source_name", F.lit("不明")), day, F.coalesce("relevance_category", F.lit("other")),
    )
    quoted = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("> "), F.col("summary")))
    return rows.select(
        F.col("id").alias("article_id"), F.lit("📰 競合プレスリリース検知").alias("header"), line.alias("line"),
        quoted.alias("quote"),
    )


def press_statistics(articles: DataFrame) -> DataFrame:
    """Per source: new, classified, summarised, failed."""
    done = F.col("classification").isNotNull() & (F.col("classification") != "pending")
    return articles.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("new_articles"), F.count_if(done).alias("classified"),
        F.count_if(F.coalesce("summary", F.lit("")) != "").alias("summarized"),
        F.count_if(F.col("classification") == "classification_failed").alias("errors"),
    )
