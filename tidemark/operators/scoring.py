"""Rule scoring and classification.

A rule set is small and fixed, the texts are many and long, so each rule becomes an
expression on the text's own row. Scores need no join, no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.html import attribute, has_class
from tidemark.functions.press_text import add_press_summary
from tidemark.functions.text import any_of, chain, first_group, lookup, strip
from tidemark.operators.tokens import STRUCTURE_OPAQUE, element_nodes
from tidemark.rules import press as press_rules
from tidemark.rules import scan as scan_rules

WeightedRules = list[tuple[str, int]]


def weight_sum(text: Column, rules: WeightedRules) -> Column:
    """Sum of the weights of the rules that match."""
    total = F.lit(0)
    for pattern, weight in rules:
        total = total + F.when(text.rlike(pattern), weight).otherwise(0)
    return total


def expired_score(
    text: Column,
    service: Column,
    by_service: dict[str, WeightedRules] | None = None,
    generic: WeightedRules | None = None,
) -> Column:
    """Weight of the notices of the text's service plus the general ones."""
    by_service = scan_rules.EXPIRED if by_service is None else by_service
    generic = scan_rules.EXPIRED_ANY if generic is None else generic
    own = chain(
        [(F.lower(service) == name, weight_sum(text, rules)) for name, rules in by_service.items()], F.lit(0)
    )
    return own + weight_sum(text, generic)


def is_expired(text: Column, service: Column, threshold: int = scan_rules.EXPIRED_THRESHOLD, **rules) -> Column:
    return expired_score(text, service, **rules) >= threshold


def expired_reason(text: Column, patterns: list[str] | None = None) -> Column:
    """First notice found, by pattern order; NULL when none."""
    return F.coalesce(*[strip(first_group(text, p, 1)) for p in patterns or scan_rules.EXPIRED_REASON])


def service_of_url(url: Column, hosts: list[tuple[str, str]] | None = None) -> Column:
    name = urls.host(url)
    return chain([(F.contains(name, F.lit(part)), F.lit(to)) for part, to in hosts or scan_rules.SERVICE_HOSTS])


def is_detail_url(url: Column, service: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    rules = scan_rules.DETAIL_URL if patterns is None else patterns
    return F.coalesce(
        any_of([(service == name) & any_of([url.rlike(p) for p in each]) for name, each in rules.items()]),
        F.lit(False),
    )


def replacement_urls(
    listings: DataFrame,
    links_by_service: dict[str, list[tuple]] | None = None,
    detail_patterns: dict[str, list[str]] | None = None,
    key: str = "capture_id",
) -> DataFrame:
    """First usable detail link per expired page.

    ``listings``: key, service, list_url, old_url, html of the service's list page.
    Links are tried selector by selector, in document order within one selector; the
    link must look like a detail page and lead to another path than the old one.
    """
    selectors = scan_rules.DETAIL_LINKS if links_by_service is None else links_by_service
    areas = sorted({area for rules in selectors.values() for area, *_ in rules if area})
    names = {area: f"area_{i}" for i, area in enumerate(areas)}
    flags = {names[a]: lambda e, a=a: has_class(F.coalesce(e["cls"], F.lit("")), a) for a in areas}
    nodes = element_nodes(listings, key, "html", STRUCTURE_OPAQUE, levels=1, areas=flags, texts=())
    links = nodes.filter((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
    links = links.withColumn("href", attribute(F.col("attrs"), "href")).filter(F.col("href") != "")
    links = links.join(listings.select(key, "service", "list_url", "old_url"), key)
    tests = []
    for service, rules in selectors.items():
        for order, (area, cls, parts, tail) in enumerate(rules, 1):
            test = F.lower("service") == service
            if area:
                test = test & (F.col(f"in_{names[area]}") > 0)
            if cls:
                test = test & has_class(F.col("cls"), cls)
            for part in parts:
                test = test & F.contains("href", F.lit(part))
            if tail:
                test = test & F.col("href").endswith(tail)
            tests.append(F.when(test, F.lit(order)))
    links = links.withColumn("selector_no", F.least(*tests) if len(tests) > 1 else tests[0])
    links = links.filter(F.col("selector_no").isNotNull())
    links = links.withColumn("new_url", urls.resolve(F.col("href"), F.col("list_url")))
    links = links.filter(
        is_detail_url(F.col("new_url"), F.lower("service"), detail_patterns)
        & (urls.path(F.col("new_url")) != urls.path(F.col("old_url")))
    )
    return links.groupBy(key).agg(F.min_by("new_url", F.struct("selector_no", "idx")).alias("new_url"))


def list_page_of_service(pages: DataFrame) -> DataFrame:
    """One list page per service: active, not deleted, pc first, then oldest."""
    device_rank = F.when(F.col("device") == "pc", 0).otherwise(1)
    first = Window.partitionBy("service_id").orderBy(device_rank, F.col("created_at").asc_nulls_last(), "id")
    live = pages.filter(
        F.col("page_type").isin("list", "listing") & F.col("is_active") & F.col("deleted_at").isNull()
    )
    return (
        live.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
        .select("service_id", "id", "url", "device", "page_type")
    )


def classify_changes(
    changes: DataFrame,
    text: str,
    rules: dict[str, WeightedRules] | None = None,
    threshold: int = scan_rules.CATEGORY_THRESHOLD,
    cap: int = scan_rules.REPEAT_CAP,
) -> DataFrame:
    """Adds category, confidence, reason and category_score of a change text."""
    rules = scan_rules.CATEGORY_RULES if rules is None else rules
    lowered = F.lower(text)
    data = changes
    for name, each in rules.items():
        # Splitting into at most cap + 1 parts counts up to cap matches and then stops reading.
        hits = F.array(*[F.size(F.split(lowered, p, cap + 1)) - 1 for p, _ in each])
        data = data.withColumn(f"_hits_{name}", hits)
    scored = []
    for order, (name, each) in enumerate(rules.items()):
        score = F.lit(0)
        for i, (_, weight) in enumerate(each):
            score = score + F.col(f"_hits_{name}")[i] * weight
        named = F.array(*[F.when(F.col(f"_hits_{name}")[i] > 0, F.lit(p)) for i, (p, _) in enumerate(each)])
        found = F.array_join(F.array_compact(named), ", ")
        scored.append(
            F.struct(score.alias("score"), F.lit(-order).alias("rank"), F.lit(name).alias("name"), found.alias("found"))
        )
    data = data.withColumn("_best", F.array_max(F.array(*scored)))
    clear = F.col("_best.score") >= threshold
    data = data.withColumn("category", F.when(clear, F.col("_best.name")).otherwise("OTHER"))
    data = data.withColumn(
        "confidence",
        F.when(clear, F.round(F.least(F.col("_best.score") / F.lit(20.0), F.lit(1.0)), 2)).otherwise(F.lit(0.3)),
    )
    data = data.withColumn(
        "reason",
        F.when(clear, F.concat(F.lit(scan_rules.PATTERN_REASON), F.col("_best.found"))).otherwise(
            scan_rules.NO_PATTERN_REASON
        ),
    )
    data = data.withColumn("category_score", F.col("_best.score"))
    return data.drop("_best", *[f"_hits_{n}" for n in rules])


def priority_of(category: Column) -> Column:
    return lookup(category, scan_rules.PRIORITY_OF_CATEGORY, F.lit("low"))


def advice_stub(changes: DataFrame) -> DataFrame:
    """Placeholder advice per change (change_id, category, summary)."""
    text = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", scan_rules.NO_SUMMARY).otherwise(
        F.col("summary")
    )
    return changes.select(
        "change_id", text.alias("summary"),
        F.lit(scan_rules.ADVICE_PLACEHOLDER).alias("intent"),
        F.lit(scan_rules.ADVICE_PLACEHOLDER).alias("proposal"),
        priority_of(F.col("category")).alias("priority"),
        F.lit(None).cast("string").alias("expected_effect"),
        F.lit(None).cast("string").alias("risks"),
    )


def classify_articles(
    articles: DataFrame,
    title: str = "title",
    body: str = "body_text",
    relevant: dict[str, list[str]] | None = None,
    irrelevant: list[str] | None = None,
    threshold: float = press_rules.CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Adds is_relevant, relevance_category, confidence, needs_manual_review."""
    relevant = press_rules.RELEVANT if relevant is None else relevant
    irrelevant = press_rules.IRRELEVANT if irrelevant is None else irrelevant
    said = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    data = articles.withColumn("_text", strip(F.concat(said(title), F.lit(" "), said(body))))
    scored = []
    for order, (name, words) in enumerate(relevant.items()):
        hits = F.lit(0)
        for word in words:
            hits = hits + F.contains("_text", F.lit(word)).cast("int")
        scored.append(
            F.struct(
                (hits / F.lit(float(len(words)))).alias("score"), F.lit(-order).alias("rank"),
                F.lit(name).alias("name"),
            )
        )
    data = data.withColumn("_best", F.array_max(F.array(*scored)))
    data = data.withColumn("_off", any_of([F.col("_text").rlike(p) for p in irrelevant]))
    empty, score = F.col("_text") == "", F.col("_best.score")
    off_topic = F.col("_off") & (score == 0)
    data = data.withColumn("is_relevant", ~(empty | off_topic))
    data = data.withColumn(
        "relevance_category",
        F.when(empty, "classification_failed")
        .when(off_topic, F.lit(None).cast("string"))
        .when(score >= threshold, F.col("_best.name"))
        .otherwise("other"),
    )
    data = data.withColumn("confidence", F.when(empty | off_topic, F.lit(0.0)).otherwise(score))
    data = data.withColumn("needs_manual_review", ~(empty | off_topic) & (score < threshold))
    return data.drop("_text", "_best", "_off")


def written_back(articles: DataFrame, body: str = "body_text", **summary_options) -> DataFrame:
    """Classified articles with classification, summary and the final review flag."""
    status = (
        F.when(F.col("relevance_category") == "classification_failed", "classification_failed")
        .when(F.col("is_relevant"), "relevant")
        .otherwise("irrelevant")
    )
    data = add_press_summary(
        articles.withColumn("classification", status), body, "relevance_category", "_said", **summary_options
    )
    data = data.withColumn("summary", F.when((F.col("classification") == "relevant") & (F.col("_said") != ""), F.col("_said")))
    unsummarised = (F.col("classification") == "relevant") & F.col("summary").isNull()
    return data.withColumn("needs_manual_review", F.col("needs_manual_review") | unsummarised).drop("_said")
