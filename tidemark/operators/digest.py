"""Run summaries, change digests and dashboard totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import chain, cut, lookup

# Fixed values of the digest.
CATEGORY_LABELS = {"CRO": "CRO", "AD_PRODUCT": "広告商品", "SEO": "SEO", "AI": "AI機能", "OTHER": "その他"}
PAGE_TYPE_LABELS = {"detail": "物件詳細", "list": "一覧", "top": "トップ", "search": "検索結果"}
PRIORITY_RANK = {"high": "3", "medium": "2", "low": "1"}
TIERS = [("high", "*🔴 対応検討推奨*"), ("medium", "*🟡 参考情報*"), ("low", "*⚪ その他の変更*")]


def run_summary(scans: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by status, changes and errors of each run (keys such as run_date)."""
    status = F.col("status")
    of = lambda name: F.count_if(status == name)
    return scans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("change_detected").alias("changes"),
        F.count_if(status.startswith("error")).alias("errors"), of("first_scan").alias("first_scans"),
        of("rendering_failure").alias("rendering_failures"), of("baseline_reset").alias("baseline_resets"),
        F.count_if("url_rotated").alias("rotations"),
        F.count_if(status.endswith("_no_fallback") | (status == "expired_no_valid_fallback")).alias("missing_fallbacks"),
    )


def run_health(summary: DataFrame) -> DataFrame:
    """Adds failed (half the pages in error), many_render_failures (30 %), notify."""
    failed = (F.col("errors") > 0) & (F.col("errors") >= F.col("total") * 0.5)
    many = F.col("rendering_failures") >= F.col("total") * 0.3
    notify = (F.col("changes") > 0) | (F.col("rotations") > 0) | (F.col("missing_fallbacks") > 0) | many
    return summary.withColumn("failed", failed).withColumn("many_render_failures", many).withColumn("notify", failed | notify)


def priority_rank(priority: Column) -> Column:
    return lookup(priority, PRIORITY_RANK, F.lit("0")).cast("int")


def url_digest(changes: DataFrame, keys: tuple[str, ...] = ("url",), order: str = "scan_no") -> DataFrame:
    """One row per URL: devices in first-seen order, highest priority, longest summary, rest from the first.

    Devices are reduced to their first sighting before they are listed, so a URL with very
    many changes still lists a handful of values.
    """
    priority = F.coalesce("priority", F.lit("low"))
    summary = F.coalesce("summary", F.lit(""))
    first = F.struct("service", F.coalesce("category", F.lit("OTHER")).alias("category"), F.coalesce("page_type", F.lit("")).alias("page_type"))
    per_device = changes.groupBy(*keys, "device").agg(
        F.min(order).alias("_first"),
        F.max_by(priority, F.struct(priority_rank(priority), -F.col(order))).alias("priority"),
        F.max(F.struct(priority_rank(priority).alias("r"), (-F.col(order)).alias("o"), priority.alias("p"))).alias("_p"),
        F.max(F.struct(F.length(summary).alias("n"), (-F.col(order)).alias("o"), summary.alias("s"))).alias("_s"),
        F.min_by(first, order).alias("_rest"), F.count(F.lit(1)).alias("_n"),
    )
    merged = per_device.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", "device"))), lambda x: x["device"]).alias("devices"),
        F.max("_p").alias("_p"), F.max("_s").alias("_s"), F.min_by("_rest", "_first").alias("_rest"),
        F.sum("_n").alias("n_changes"), F.min("_first").alias("first_seen"),
    )
    return merged.select(
        *keys, "_rest.*", F.array_join("devices", "/").alias("devices"), F.col("_p.p").alias("priority"),
        F.col("_s.s").alias("summary"), "n_changes", "first_seen",
    )


def page_type_label(page_type: Column) -> Column:
    named = lookup(page_type, PAGE_TYPE_LABELS, page_type)
    return F.when(F.coalesce(page_type, F.lit("")) == "", "不明").otherwise(named)


def digest_rows(digest: DataFrame, scans: DataFrame) -> DataFrame:
    """The digest as ordered rows: (part, item, text). Delivery is not part of it.

    Parts: 0 header, 10/20/30 tiers by priority, 40 rotations, 50 missing fallbacks,
    60 rendering failures (from 30 % of the pages).
    """
    service = F.upper("service")
    label = page_type_label(F.col("page_type"))
    short = F.when(F.length("summary") > 120, F.concat(cut(F.col("summary"), 117), F.lit("..."))).otherwise(F.col("summary"))
    block = F.format_string(
        "*【%s】%s* (%s)\n分類: %s\n%s", service, label, F.col("devices"),
        lookup(F.col("category"), CATEGORY_LABELS, F.lit("その他")), short,
    )
    compact = F.format_string("• %s (%s): %s", service, label, cut(F.col("summary"), 60))
    named = lambda part, item, text: F.struct(
        F.lit(part).alias("part"), item.cast("bigint").alias("item"), text.alias("text")
    )
    none, n = F.lit(0), F.col("n")
    # Changes: one row each, and the headings from the number of URLs per priority.
    tier_no = chain([(F.col("priority") == tier, F.lit(10 * i)) for i, (tier, _) in enumerate(TIERS, 1)])
    blocks = digest.select(
        (tier_no + 1).alias("part"), F.col("first_seen").cast("bigint").alias("item"),
        F.when(F.col("priority") == "low", compact).otherwise(block).alias("text"),
    ).filter(F.col("part").isNotNull())
    counted = digest.rollup("priority").agg(F.count(F.lit(1)).alias("n"), F.grouping("priority").alias("_all"))
    title = F.when((F.col("_all") == 1) & (n > 0), named(0, none, F.format_string("🔍 競合変更レポート (%d箇所)", n)))
    for i, (tier, heading) in enumerate(TIERS, 1):
        title = title.when((F.col("_all") == 0) & (F.col("priority") == tier), named(10 * i, none, F.lit(heading)))
    headings = counted.select(title.alias("_h")).filter(F.col("_h").isNotNull()).select("_h.*")
    # Scans: one pass for the rows, one for the totals.
    rotated = F.coalesce(F.col("url_rotated"), F.lit(False))
    missing = F.col("status").endswith("_no_fallback") | (F.col("status") == "expired_no_valid_fallback")
    told = lambda tail: F.format_string("• %s (%s): %s", F.col("service"), F.col("device"), tail)
    lines = F.array_compact(
        F.array(
            F.when(rotated, named(41, F.col("scan_no"), told(F.coalesce("new_url", F.lit("N/A"))))),
            F.when(missing, named(51, F.col("scan_no"), told(F.col("url")))),
        )
    )
    each = scans.filter(rotated | missing).select(F.explode(lines).alias("_l")).select("_l.*")
    totals = scans.agg(
        F.count_if(rotated).alias("r"), F.count_if(missing).alias("m"), F.count(F.lit(1)).alias("all"),
        F.count_if(F.col("status") == "rendering_failure").alias("f"),
    )
    sums = F.array_compact(
        F.array(
            F.when(F.col("r") > 0, named(40, none, F.format_string("*🔄 物件URL自動切替: %d件*", F.col("r")))),
            F.when(F.col("m") > 0, named(50, none, F.format_string("*⚠️ URL切替失敗（要手動対応）: %d件*", F.col("m")))),
            F.when(
                (F.col("all") > 0) & (F.col("f") >= F.col("all") * 0.3),
                named(60, none, F.format_string("*🔧 レンダリング失敗（誤検知除外）: %d件*", F.col("f"))),
            ),
        )
    )
    summed = totals.select(F.explode(sums).alias("_s")).select("_s.*")
    return headings.unionByName(blocks).unionByName(each).unionByName(summed)


def dashboard(changes: DataFrame, pages: DataFrame, services: DataFrame, main_category: str = "real_estate") -> DataFrame:
    """One row: change, page and service totals, and the last ten changes split by service category."""
    live = lambda t: t.filter(F.col("is_active") & F.col("deleted_at").isNull())
    n = F.count(F.lit(1)).cast("bigint")
    last = changes.select("id", "page_id", "detected_at").orderBy(F.col("detected_at").desc_nulls_first(), "id").limit(10)
    last = last.join(pages.select(F.col("id").alias("page_id"), "service_id"), "page_id").join(
        services.select(F.col("id").alias("service_id"), "category"), "service_id"
    )
    main, other = F.col("category") == main_category, ~F.col("category").eqNullSafe(main_category)
    both = lambda first, second: F.struct(F.count_if(first).alias("a"), F.count_if(second).alias("b")).alias("s")
    of_services = live(services).agg(both(main, F.col("category") == "other")).scalar()
    of_last = last.agg(both(main, other)).scalar()
    totals = changes.agg(n.alias("total_changes")).select(
        "total_changes", live(pages).agg(n).scalar().alias("active_pages"), of_services.alias("_s"), of_last.alias("_l")
    )
    return totals.select(
        "total_changes", "active_pages", F.col("_s.a").alias("main_services"), F.col("_s.b").alias("other_services"),
        F.col("_l.a").alias("recent_main"), F.col("_l.b").alias("recent_other"),
    )


def services_by_category(services: DataFrame) -> DataFrame:
    """Live services per category and in all (category ``all``)."""
    rows = services.filter(F.col("deleted_at").isNull()).rollup("category").agg(
        F.count(F.lit(1)).alias("n_services"), F.grouping("category").alias("_all")
    )
    return rows.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("category")).alias("category"), "n_services")


def device_pairs(pages: DataFrame, order: str = "id") -> DataFrame:
    """One row per (url, page_type) with the last pc, sp and other page id."""
    slot = F.when(F.col("device").isin("pc", "sp"), F.col("device")).otherwise("other")
    last = lambda name: F.max_by(F.when(slot == name, F.col("id")), F.when(slot == name, F.col(order))).alias(f"{name}_id")
    return pages.groupBy("url", "page_type").agg(last("pc"), last("sp"), last("other"))
