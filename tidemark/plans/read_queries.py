"""Reads, comparison, digests and maintenance over the sample tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import compare, digest, maintenance, press_pages, reads, scoring, snapshots
from tidemark.plans import sample
from tidemark.plans.sample import with_roles
from tidemark.sources import tables

QUERIES, ORACLES = {}, {}
STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def stamp(column: str):
    return F.date_format(column, STAMP)


# Scans ------------------------------------------------------------------------------

@query("active_pages", with_roles("services", "pages") + """
SELECT p.id AS page_id, p.url, p.page_type, p.device, s.name AS service_name, s.category FROM mpages p
JOIN services s ON p.service_id = s.id WHERE p.is_active AND NOT p.is_deleted AND s.is_active AND NOT s.is_deleted""")
def active_pages(spark, sf):
    rows = tables.active_pages(sample.pages(spark, sf), sample.services(spark, sf))
    return rows.select("page_id", "url", "page_type", "device", "service_name", "category")


@query("active_own_pages", with_roles("own_pages") + """
SELECT id AS own_page_id, name, page_type, url, device FROM own WHERE is_active""")
def active_own_pages(spark, sf):
    own = sample.own_pages(spark, sf).withColumn("category", F.lit("chintai"))
    return tables.active_own_pages(own).drop("category")


@query("active_press_sources", with_roles("sources") + """
SELECT id, name, url, created_no FROM sources WHERE is_active AND NOT is_deleted""")
def active_press_sources(spark, sf):
    rows = tables.active_press_sources(sample.press_sources(spark, sf))
    return rows.select("id", "name", "url", F.floor(F.unix_timestamp("created_at") / 60).alias("created_no"))


@query("pending_articles", with_roles("articles", "sources") + """
SELECT a.id, a.source_id, s.name AS source_name, a.title, a.article_url FROM articles a JOIN sources s ON a.source_id = s.id
WHERE a.classification = 'pending' AND NOT a.is_deleted""")
def pending_articles(spark, sf):
    rows = tables.pending_articles(sample.articles(spark, sf), sample.press_sources(spark, sf))
    return rows.select("id", "source_id", "source_name", "title", "article_url")


@query("undated_articles", with_roles("articles") + """
SELECT id, source_id, title FROM articles WHERE published_at IS NULL AND NOT is_deleted""")
def undated_articles(spark, sf):
    return tables.undated_articles(sample.articles(spark, sf)).select("id", "source_id", "title")


@query("unseeded_services", """
SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)
UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 11 = 5""")
def unseeded_services(spark, sf):
    stored = sample.services(spark, sf)
    seed = sample.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return tables.unseeded(seed.unionByName(stored.select("name")), stored, ["name"])


@query("page_type_on_load", """
SELECT CASE WHEN t = 'listing' THEN 'list' ELSE t END AS page_type, t = 'listing' AS was_listing, count(*) AS n FROM (
 SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'detail' WHEN 'BUILDING' THEN 'list' WHEN 'AUTOMOBILE' THEN 'form'
 WHEN 'HOUSEHOLD' THEN 'search' WHEN 'FURNITURE' THEN 'listing' END AS t FROM customer) GROUP BY 1, 2""")
def page_type_on_load(spark, sf):
    rows = tables.normalised_page_type(sample.pages(spark, sf))
    return rows.groupBy("page_type", "was_listing").agg(F.count(F.lit(1)).alias("n"))


# Snapshot history -------------------------------------------------------------------

@query("save_on_change", """
WITH h AS (SELECT o_orderkey, o_custkey, sha256(o_orderstatus || '|' || o_orderpriority) AS hash,
  lag(sha256(o_orderstatus || '|' || o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_orderkey AS id, o_custkey AS page_id, hash FROM h WHERE p IS DISTINCT FROM hash""")
def save_on_change(spark, sf):
    o = sample.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page_id"), F.col("o_orderdate").alias("captured_at"),
        F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("hash"),
    )
    kept = snapshots.save_on_change(o, ["page_id"], ["captured_at", "id"], "hash", F.date_trunc("quarter", "captured_at"))
    return kept.select("id", "page_id", "hash")


@query("structure_link_asof", """
WITH s AS (SELECT user_id, event_id, ts, lag(event_id) OVER w AS before, lead(ts) OVER w IS DISTINCT FROM ts AS latest
           FROM events WHERE event_type IN ('purchase', 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('purchase', 'signup'))
SELECT c.event_id AS change_id, c.user_id AS page_id,
  CASE WHEN s.ts >= c.ts - INTERVAL 6 HOURS THEN s.before END AS structure_before_id,
  CASE WHEN s.ts >= c.ts - INTERVAL 6 HOURS THEN s.event_id END AS structure_after_id
FROM c ASOF LEFT JOIN (SELECT * FROM s WHERE latest) s ON c.user_id = s.user_id AND c.ts >= s.ts""")
def structure_link_asof(spark, sf):
    """Purchases and signups stand for saved structures, all other events for changes."""
    e = sample.table(spark, sf, "events")
    structural = F.col("event_type").isin("purchase", "signup")
    saved = e.filter(structural).select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("structure_id"), F.col("ts").alias("captured_at")
    )
    changed = e.filter(~structural).select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("change_id"), F.col("ts").alias("detected_at")
    )
    linked = snapshots.link_structures(changed, saved, within="6 hours")
    return linked.select("change_id", "page_id", "structure_before_id", "structure_after_id")


@query("scan_outcomes", """
WITH e AS (SELECT event_id, user_id, event_type, value, event_id % 3 AS k FROM events),
o AS (SELECT event_id, CASE
  WHEN event_type = 'signup' AND k = 0 THEN 'error: timeout'
  WHEN event_type = 'error' AND k = 0 THEN 'http_404_no_fallback' WHEN event_type = 'error' AND k = 1 THEN 'http_500'
  WHEN event_type = 'error' THEN 'ok' WHEN event_type = 'click' THEN 'http_503'
  WHEN event_type = 'purchase' AND k = 0 THEN 'expired_no_fallback' WHEN event_type = 'purchase' AND k = 1 THEN 'expired_no_valid_fallback'
  ELSE 'ok' END AS status FROM e)
SELECT status, count(*) AS n FROM o GROUP BY status""")
def scan_outcomes(spark, sf):
    e = sample.table(spark, sf, "events").withColumn("k", F.col("event_id") % 3)
    kind, k = F.col("event_type"), F.col("k")
    scans = e.select(
        F.lit("detail").alias("page_type"), F.when((kind == "signup") & (k == 0), "timeout").alias("error"),
        F.when(kind == "error", 404).when(kind == "click", 503).otherwise(200).alias("http_status"),
        (kind == "purchase").alias("expired"),
        F.when(kind.isin("error", "purchase") & (k > 0), F.concat(F.lit("https://x.example.com/"), F.col("event_id"))).alias("fallback_url"),
        F.when((kind == "error") & (k == 1), 500).otherwise(200).alias("fallback_status"),
        ((kind == "purchase") & (k == 1)).alias("fallback_expired"),
    )
    return snapshots.scan_outcome(scans).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Feeds ------------------------------------------------------------------------------

@query("recent_changes", with_roles("changes", "advice") + f"""
SELECT c.id, c.category, strftime(c.detected_at, {SQL_STAMP}) AS detected_at, a.priority AS advice_priority
FROM changes c LEFT JOIN advice a ON a.change_id = c.id WHERE c.detected_at >= TIMESTAMP '2001-07-01' - INTERVAL 30 DAYS""")
def recent_changes(spark, sf):
    rows = reads.recent_changes(
        sample.changes(spark, sf), sample.advice(spark, sf), F.lit("2001-07-01").cast("timestamp"), days=30
    )
    return rows.select("id", "category", stamp("detected_at").alias("detected_at"), "advice_priority")


@query("change_detail", with_roles("changes", "advice", "pages", "services") + """
SELECT c.id, c.summary, a.priority AS advice_priority, p.url, p.device, s.display_name AS service_display_name
FROM changes c LEFT JOIN advice a ON a.change_id = c.id LEFT JOIN mpages p ON c.page_id = p.id
LEFT JOIN services s ON p.service_id = s.id WHERE c.id = 7""")
def change_detail(spark, sf):
    rows = reads.change_detail(
        sample.changes(spark, sf), sample.advice(spark, sf), sample.pages(spark, sf), sample.services(spark, sf), 7
    )
    return rows.select("id", "summary", "advice_priority", "url", "device", "service_display_name")


@query("service_feed", with_roles("changes") + f"""
SELECT service_name, category, strftime(detected_at, {SQL_STAMP}) AS detected_at, summary,
 row_number() OVER (PARTITION BY service_name ORDER BY detected_at DESC, id) AS rank
FROM changes QUALIFY rank <= 20""")
def service_feed(spark, sf):
    rows = reads.service_feed(sample.changes(spark, sf))
    return rows.select("service_name", F.col("rank").cast("bigint"), "category", stamp("detected_at").alias("detected_at"), "summary")


@query("change_search", with_roles("changes") + """
SELECT id, summary FROM changes WHERE category = 'AI' AND contains(lower(summary), 'total 12')
ORDER BY detected_at DESC, id LIMIT 20""")
def change_search(spark, sf):
    return reads.search_changes(sample.changes(spark, sf), "AI", "TOTAL 12").select("id", "summary")


@query("unanalysed_changes", with_roles("changes", "advice") + """
SELECT c.id, a.proposal AS advice_proposal FROM changes c JOIN advice a ON a.change_id = c.id
WHERE contains(a.proposal, 'MCP経由') ORDER BY c.detected_at DESC, c.id LIMIT 10""")
def unanalysed_changes(spark, sf):
    return reads.unanalysed_changes(sample.changes(spark, sf), sample.advice(spark, sf)).select("id", "advice_proposal")


@query("real_advice", with_roles("advice") + """
SELECT change_id, CASE WHEN NOT contains(intent, 'MCP経由') THEN intent END AS intent,
 CASE WHEN NOT contains(proposal, 'MCP経由') THEN proposal END AS proposal,
 NOT contains(intent, 'MCP経由') OR NOT contains(proposal, 'MCP経由') AS has_real FROM advice""")
def real_advice(spark, sf):
    a = sample.advice(spark, sf)
    clean = reads.without_placeholder
    return a.select(
        "change_id", clean(F.col("intent")).alias("intent"), clean(F.col("proposal")).alias("proposal"),
        reads.has_real_advice(F.col("intent"), F.col("proposal")).alias("has_real"),
    )


@query("change_list_page", with_roles("changes", "advice") + """, f AS (
SELECT c.id, c.detected_at, c.category, a.priority AS advice_priority FROM changes c LEFT JOIN advice a ON a.change_id = c.id
WHERE c.category <> 'OTHER' AND (a.priority <> 'low' OR a.id IS NULL) AND NOT c.is_reviewed)
SELECT id, category, advice_priority, (SELECT count(*) FROM f) AS total_count,
 CAST(ceil((SELECT count(*) FROM f) / 20.0) AS BIGINT) AS total_pages FROM f ORDER BY detected_at DESC, id LIMIT 20 OFFSET 40""")
def change_list_page(spark, sf):
    rows = reads.filter_changes(sample.changes(spark, sf), sample.advice(spark, sf), reviewed=False)
    return reads.page_of(rows, "detected_at", page=3).select("id", "category", "advice_priority", "total_count", "total_pages")


@query("press_search", with_roles("articles", "sources") + f"""
SELECT title, article_url, strftime(published_at, {SQL_STAMP}) AS published_at FROM articles
WHERE NOT is_deleted AND published_at >= TIMESTAMP '2020-02-01' AND published_at < TIMESTAMP '2021-06-02'
AND relevance_category = 'market_data' ORDER BY articles.published_at DESC, id LIMIT 50""")
def press_search(spark, sf):
    rows = reads.press_articles_between(
        sample.articles(spark, sf), sample.press_sources(spark, sf), date_from="2020-02-01", date_to="2021-06-01",
        category="market_data", limit=50,
    )
    return rows.select("title", "article_url", stamp("published_at").alias("published_at"))


@query("latest_press_articles", with_roles("articles", "sources") + """
SELECT source_name, title, rank FROM (
 SELECT s.name AS source_name, a.title, row_number() OVER (PARTITION BY a.source_id ORDER BY a.published_at DESC NULLS FIRST, a.id) AS rank
 FROM articles a JOIN sources s ON a.source_id = s.id WHERE NOT a.is_deleted AND NOT s.is_deleted) WHERE rank <= 10""")
def latest_press_articles(spark, sf):
    rows = reads.latest_press_articles(sample.articles(spark, sf), sample.press_sources(spark, sf))
    return rows.select("source_name", "title", F.col("rank").cast("bigint"))


@query("press_list_page", with_roles("articles", "sources") + """, f AS (
SELECT a.id, a.source_id, a.published_at FROM articles a WHERE NOT is_deleted AND classification = 'irrelevant')
SELECT t.id, s.name AS source_name, (SELECT count(*) FROM f) AS total_count FROM
 (SELECT * FROM f ORDER BY published_at DESC NULLS FIRST, id LIMIT 20 OFFSET 20) t LEFT JOIN sources s ON t.source_id = s.id""")
def press_list_page(spark, sf):
    rows = reads.press_list(
        sample.articles(spark, sf), sample.press_sources(spark, sf), classification="irrelevant", page=2
    )
    return rows.select("id", "source_name", "total_count")


@query("source_list", with_roles("sources") + " SELECT id, name, url, is_active FROM sources WHERE NOT is_deleted")
def source_list(spark, sf):
    return reads.source_list(sample.press_sources(spark, sf)).drop("created_at")


@query("insight_search", with_roles("insights", "articles", "sources") + """
SELECT i.id, i.insight_type, a.title AS article_title, s.name AS source_name FROM insights i
JOIN articles a ON i.article_id = a.id JOIN sources s ON a.source_id = s.id
WHERE i.status = 'new' AND i.priority = 'high' AND i.tag = 'k7'""")
def insight_search(spark, sf):
    rows = reads.press_insights(
        sample.insights(spark, sf), sample.articles(spark, sf), sample.press_sources(spark, sf), status="new",
        priority="high", tag="k7", limit=None,
    )
    return rows.select("id", "insight_type", "article_title", "source_name")


@query("advice_feed", with_roles("changes", "advice", "pages", "services") + """
SELECT a.id, c.category, p.url, s.display_name AS service_display_name FROM
 (SELECT * FROM advice ORDER BY created_at DESC, id LIMIT 30) a JOIN changes c ON a.change_id = c.id
 LEFT JOIN mpages p ON c.page_id = p.id LEFT JOIN services s ON p.service_id = s.id""")
def advice_feed(spark, sf):
    rows = reads.advice_feed(
        sample.advice(spark, sf), sample.changes(spark, sf), sample.pages(spark, sf), sample.services(spark, sf)
    )
    return rows.select("id", "category", "url", "service_display_name")


@query("advice_stub", """
SELECT doc_id AS change_id, CASE WHEN coalesce(text, '') = '' OR doc_id % 7 = 0 THEN '変更を検知しました' ELSE text END AS summary,
 'MCP経由でKiroに分析を依頼してください' AS intent, 'MCP経由でKiroに分析を依頼してください' AS proposal,
 CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'high' WHEN 'de' THEN 'medium' ELSE 'low' END AS priority FROM documents""")
def advice_stub(spark, sf):
    """Placeholder advice on whole texts as summaries; every seventh summary is missing or empty."""
    d = sample.table(spark, sf, "documents")
    missing = F.when(F.col("doc_id") % 2 == 0, F.lit(""))
    rows = d.select(
        F.col("doc_id").alias("change_id"), sample.case(F.col("lang"), {"en": "CRO", "fr": "AI", "de": "SEO"}, "OTHER").alias("category"),
        F.when(F.col("doc_id") % 7 == 0, missing).otherwise(F.col("text")).alias("summary"),
    )
    return scoring.advice_stub(rows).select("change_id", "summary", "intent", "proposal", "priority")


@query("service_page_counts", with_roles("services", "pages") + """
SELECT s.id, s.name, (SELECT count(*) FROM mpages p WHERE p.service_id = s.id AND NOT p.is_deleted) AS page_count
FROM services s WHERE NOT s.is_deleted""")
def service_page_counts(spark, sf):
    rows = reads.services_with_page_counts(sample.services(spark, sf), sample.pages(spark, sf))
    return rows.select(F.col("id").cast("bigint"), "name", "page_count")


@query("service_pages", with_roles("pages") + " SELECT id, url, device FROM mpages WHERE service_id = 4 AND NOT is_deleted")
def service_pages(spark, sf):
    return reads.pages_of_service(sample.pages(spark, sf), 4).select("id", "url", "device")


@query("display_short", """
SELECT page_id, h || CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '…' ELSE t END AS short_url,
 CASE WHEN length(b) > 80 THEN substr(b, 1, 80) || '...' ELSE b END AS short_title FROM (
 SELECT page_id, html AS b, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h,
 regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS t FROM pages)""")
def display_short(spark, sf):
    p = sample.table(spark, sf, "pages")
    return p.select("page_id", reads.short_url(F.col("url")).alias("short_url"), reads.short_title(F.col("html")).alias("short_title"))


# Structures: orders stand for structure rows of their customer's page ----------------

def _structures(spark, sf, own=False):
    """Structure rows with conversion kinds taken from the line items of an order."""
    kinds = {"A": "line_cta", "N": "social_proof", "R": "urgency"}
    li = sample.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("flags"), F.min("l_suppkey").alias("supplier"),
        F.max("l_shipdate").alias("shipped"),
    )
    o = sample.table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    points = F.transform("flags", lambda f: F.struct(sample.case(f, kinds).alias("type")))
    component_count = F.floor("o_totalprice").cast("int") % 100
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("supplier") if own else F.col("o_custkey")).alias("page_id"),
        F.col("o_orderdate").alias("captured_at"),
        F.struct(component_count.alias("component_count")).alias("summary"), points.alias("cv_points"),
        F.lit(None).cast("array<int>").alias("sections"),
        F.array(F.struct(F.size("flags").alias("total_fields"))).alias("forms"),
        F.md5(F.col("o_orderkey").cast("string")).alias("hash"),
    )


STRUCTURES_SQL = """li AS (SELECT l_orderkey, min(l_suppkey) AS supplier, count(DISTINCT l_returnflag) AS nf,
  max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1),
st AS (SELECT o_orderkey AS id, o_custkey AS rival_page, supplier AS own_page, o_orderdate AS captured_at,
  CAST(floor(o_totalprice) AS BIGINT) % 100 AS component_count, nf, a, n, r FROM orders JOIN li ON o_orderkey = l_orderkey),
rlast AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY rival_page ORDER BY captured_at DESC, id DESC) = 1),
olast AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY own_page ORDER BY captured_at DESC, id DESC) = 1)"""


@query("latest_structure", with_roles("pages") + ", " + STRUCTURES_SQL + """
, fp AS (SELECT service_id, page_type, device, min(id) AS page_id FROM mpages WHERE is_active AND NOT is_deleted GROUP BY 1, 2, 3)
SELECT fp.service_id, fp.page_type, fp.device, fp.page_id, rlast.component_count FROM fp JOIN rlast ON fp.page_id = rlast.rival_page""")
def latest_structure(spark, sf):
    rows = reads.page_structure(_structures(spark, sf), sample.pages(spark, sf), ["service_id", "page_type", "device"])
    return rows.select(
        "service_id", "page_type", "device", "page_id", F.col("summary.component_count").cast("bigint").alias("component_count")
    )


@query("structure_history", with_roles("pages") + ", " + STRUCTURES_SQL + """
, fp AS (SELECT service_id, page_type, device, min(id) AS page_id FROM mpages WHERE is_active AND NOT is_deleted GROUP BY 1, 2, 3),
h AS (SELECT *, row_number() OVER (PARTITION BY rival_page ORDER BY captured_at DESC, id) AS rank FROM st)
SELECT fp.page_id, h.id, h.rank, h.component_count FROM fp JOIN h ON fp.page_id = h.rival_page WHERE h.rank <= 10""")
def structure_history(spark, sf):
    rows = reads.structure_history(_structures(spark, sf), sample.pages(spark, sf), ["service_id", "page_type", "device"])
    return rows.select("page_id", "id", F.col("rank").cast("bigint"), F.col("summary.component_count").cast("bigint").alias("component_count"))


@query("cv_gaps", with_roles("pages", "own_pages") + ", " + STRUCTURES_SQL + """
, k AS (SELECT 'line_cta' AS kind UNION ALL SELECT 'social_proof' UNION ALL SELECT 'urgency'),
rk AS (SELECT DISTINCT p.page_type, p.device, k.kind FROM mpages p JOIN rlast s ON p.id = s.rival_page, k
  WHERE p.is_active AND NOT p.is_deleted AND p.page_type IN ('detail', 'list', 'form')
  AND ((kind = 'line_cta' AND a = 1) OR (kind = 'social_proof' AND n = 1) OR (kind = 'urgency' AND r = 1))),
fo AS (SELECT page_type, device, min(id) AS page_id FROM own WHERE is_active AND page_type IN ('detail', 'list', 'form') GROUP BY 1, 2),
ok AS (SELECT DISTINCT f.page_type, f.device, k.kind FROM fo f JOIN olast s ON f.page_id = s.own_page, k
  WHERE (kind = 'line_cta' AND a = 1) OR (kind = 'social_proof' AND n = 1) OR (kind = 'urgency' AND r = 1))
SELECT page_type, device, string_agg(kind, ',' ORDER BY kind) AS missing
FROM (SELECT * FROM rk EXCEPT SELECT * FROM ok) GROUP BY 1, 2""")
def cv_gaps(spark, sf):
    rows = compare.cv_gaps(
        _structures(spark, sf), sample.pages(spark, sf), _structures(spark, sf, own=True), sample.own_pages(spark, sf)
    )
    return rows.select("page_type", "device", F.array_join("missing", ",").alias("missing"))


@query("component_kind_gap", with_roles("own_pages") + """
, rival AS (SELECT DISTINCT CASE c_mktsegment WHEN 'MACHINERY' THEN 'detail' WHEN 'BUILDING' THEN 'list' ELSE 'form' END AS page_type,
 'kind' || (c_custkey % 40) AS type FROM customer)
SELECT page_type, type FROM rival EXCEPT SELECT page_type, 'kind' || (id % 25) FROM own""")
def component_kind_gap(spark, sf):
    c = sample.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    rival = c.select(
        F.when(seg == "MACHINERY", "detail").when(seg == "BUILDING", "list").otherwise("form").alias("page_type"),
        F.concat(F.lit("kind"), F.col("c_custkey") % 40).alias("type"),
    )
    own = sample.own_pages(spark, sf).select("page_type", F.concat(F.lit("kind"), F.col("id") % 25).alias("type"))
    return compare.component_gaps(rival, own)


@query("side_by_side", with_roles("pages", "own_pages") + ", " + STRUCTURES_SQL + """
, fr AS (SELECT service_id, page_type, device, min(id) AS page_id FROM mpages WHERE is_active AND NOT is_deleted GROUP BY 1, 2, 3),
fo AS (SELECT page_type, device, min(id) AS page_id FROM own WHERE is_active GROUP BY 1, 2),
r AS (SELECT fr.*, s.id AS sid, s.component_count FROM fr LEFT JOIN rlast s ON fr.page_id = s.rival_page),
o AS (SELECT fo.*, s.id AS sid, s.component_count FROM fo LEFT JOIN olast s ON fo.page_id = s.own_page)
SELECT r.service_id, coalesce(r.page_type, o.page_type) AS page_type, coalesce(r.device, o.device) AS device,
 CASE WHEN r.page_id IS NULL THEN NULL ELSE coalesce(r.component_count, 0) END AS rival_component_count,
 CASE WHEN o.page_id IS NULL THEN NULL ELSE coalesce(o.component_count, 0) END AS own_component_count
FROM r FULL JOIN o ON r.page_type = o.page_type AND r.device = o.device WHERE r.sid IS NOT NULL OR o.sid IS NOT NULL""")
def side_by_side(spark, sf):
    rows = compare.side_by_side(
        _structures(spark, sf), sample.pages(spark, sf), _structures(spark, sf, own=True), sample.own_pages(spark, sf)
    )
    return rows.select(
        "service_id", "page_type", "device", F.col("rival_component_count").cast("bigint"),
        F.col("own_component_count").cast("bigint"),
    )


@query("form_comparison", with_roles("pages", "own_pages") + ", " + STRUCTURES_SQL + """
, fr AS (SELECT service_id, device, min(id) AS page_id FROM mpages WHERE is_active AND NOT is_deleted AND page_type = 'form' GROUP BY 1, 2),
fo AS (SELECT device, min(id) AS page_id FROM own WHERE is_active AND page_type = 'form' GROUP BY 1)
SELECT 'rival' AS site_role, fr.service_id, fr.device, fr.page_id, s.nf AS total_fields FROM fr LEFT JOIN rlast s ON fr.page_id = s.rival_page
UNION ALL SELECT 'own', NULL, fo.device, fo.page_id, s.nf FROM fo LEFT JOIN olast s ON fo.page_id = s.own_page""")
def form_comparison(spark, sf):
    rows = compare.form_comparison(
        _structures(spark, sf), sample.pages(spark, sf), _structures(spark, sf, own=True), sample.own_pages(spark, sf)
    )
    return rows.select(
        "site_role", "service_id", "device", "page_id", F.get("forms", F.lit(0))["total_fields"].cast("bigint").alias("total_fields")
    )


# Digests ----------------------------------------------------------------------------

def _scans(spark, sf):
    e = sample.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("scan_no"), F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com/")).alias("url"),
        F.concat(F.lit("svc"), F.col("user_id") % 7).alias("service"),
        F.when(F.col("event_id") % 2 == 0, "pc").otherwise("sp").alias("device"),
        F.when(F.col("event_type") == "click", "CRO").when(F.col("event_type") == "view", "SEO").otherwise("OTHER").alias("category"),
        F.when(F.col("value") > 30, "high").when(F.col("value") > 15, "medium").otherwise("low").alias("priority"),
        F.lit("detail").alias("page_type"), F.concat(F.lit("value "), F.col("value").cast("string")).alias("summary"),
        F.when(F.col("event_type") == "error", "error: timeout").when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), "first_scan")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "expired_no_fallback").otherwise("ok").alias("status"),
        (F.col("event_type").isin("click", "view")).alias("change_detected"),
        ((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 1)).alias("url_rotated"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("https://new.example.com/"), F.col("event_id"))).alias("new_url"),
    )


SCANS_SQL = """WITH scans AS (SELECT event_id AS scan_no, 'https://u' || user_id || '.example.com/' AS url, 'svc' || (user_id % 7) AS service,
 CASE WHEN event_id % 2 = 0 THEN 'pc' ELSE 'sp' END AS device,
 CASE event_type WHEN 'click' THEN 'CRO' WHEN 'view' THEN 'SEO' ELSE 'OTHER' END AS category,
 CASE WHEN value > 30 THEN 'high' WHEN value > 15 THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN value > 30 THEN 3 WHEN value > 15 THEN 2 ELSE 1 END AS prank, 'value ' || CAST(value AS VARCHAR) AS summary,
 CASE WHEN event_type = 'error' THEN 'error: timeout' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'first_scan'
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'expired_no_fallback' ELSE 'ok' END AS status,
 event_type IN ('click', 'view') AS change_detected, event_type = 'purchase' AND event_id % 4 = 1 AS url_rotated,
 strftime(ts, '%Y-%m-%d') AS run_date, CASE WHEN event_type = 'purchase' THEN 'https://new.example.com/' || event_id END AS new_url FROM events)"""
DIGEST_SQL = SCANS_SQL + """, d AS (SELECT url, arg_min(service, scan_no) AS service, arg_min(category, scan_no) AS category,
 arg_max(priority, prank * 1000000000000 - scan_no) AS priority,
 arg_max(summary, length(summary) * 1000000000000 - scan_no) AS summary, count(*) AS n_changes, min(scan_no) AS first_seen,
 CASE WHEN count(DISTINCT device) = 1 THEN min(device) WHEN min(CASE WHEN device = 'pc' THEN scan_no END) < min(CASE WHEN device = 'sp' THEN scan_no END)
 THEN 'pc/sp' ELSE 'sp/pc' END AS devices FROM scans WHERE change_detected GROUP BY url)"""


@query("scan_run_report", SCANS_SQL + """, s AS (SELECT run_date, count(*) AS total, count_if(change_detected) AS changes,
 count_if(status LIKE 'error%') AS errors, count_if(status = 'first_scan') AS first_scans, count_if(url_rotated) AS rotations,
 count_if(status LIKE '%_no_fallback') AS missing_fallbacks FROM scans GROUP BY 1)
SELECT *, errors > 0 AND errors >= total * 0.5 AS failed, (errors > 0 AND errors >= total * 0.5) OR changes > 0 OR rotations > 0 OR missing_fallbacks > 0 AS notify FROM s""")
def scan_run_report(spark, sf):
    rows = digest.run_health(digest.run_summary(_scans(spark, sf), ["run_date"]))
    return rows.select("run_date", "total", "changes", "errors", "first_scans", "rotations", "missing_fallbacks", "failed", "notify")


@query("url_digest", DIGEST_SQL + " SELECT url, service, category, devices, priority, summary, n_changes, first_seen FROM d")
def url_digest(spark, sf):
    rows = digest.url_digest(_scans(spark, sf).filter("change_detected"))
    return rows.select("url", "service", "category", "devices", "priority", "summary", "n_changes", "first_seen")


@query("digest_rows", DIGEST_SQL + """
SELECT 0 AS part, 0 AS item, '🔍 競合変更レポート (' || count(*) || '箇所)' AS text FROM d
UNION ALL SELECT 10, 0, '*🔴 対応検討推奨*' WHERE EXISTS (SELECT 1 FROM d WHERE priority = 'high')
UNION ALL SELECT 20, 0, '*🟡 参考情報*' WHERE EXISTS (SELECT 1 FROM d WHERE priority = 'medium')
UNION ALL SELECT 30, 0, '*⚪ その他の変更*' WHERE EXISTS (SELECT 1 FROM d WHERE priority = 'low')
UNION ALL SELECT CASE priority WHEN 'high' THEN 11 WHEN 'medium' THEN 21 ELSE 31 END, first_seen,
 CASE WHEN priority = 'low' THEN '• ' || upper(service) || ' (物件詳細): ' || substr(summary, 1, 60)
 ELSE '*【' || upper(service) || '】物件詳細* (' || devices || ')' || chr(10) || '分類: ' || CASE category WHEN 'OTHER' THEN 'その他' ELSE category END || chr(10) || summary END FROM d
UNION ALL SELECT 40, 0, '*🔄 物件URL自動切替: ' || count(*) || '件*' FROM scans WHERE url_rotated HAVING count(*) > 0
UNION ALL SELECT 41, scan_no, '• ' || service || ' (' || device || '): ' || new_url FROM scans WHERE url_rotated
UNION ALL SELECT 50, 0, '*⚠️ URL切替失敗（要手動対応）: ' || count(*) || '件*' FROM scans WHERE status LIKE '%_no_fallback' HAVING count(*) > 0
UNION ALL SELECT 51, scan_no, '• ' || service || ' (' || device || '): ' || url FROM scans WHERE status LIKE '%_no_fallback'""")
def digest_rows(spark, sf):
    scans = _scans(spark, sf)
    rows = digest.digest_rows(digest.url_digest(scans.filter("change_detected")), scans)
    return rows.withColumn("part", F.col("part").cast("bigint"))


@query("dashboard", with_roles("changes", "pages", "services") + """
, last AS (SELECT s.category FROM (SELECT * FROM changes ORDER BY detected_at DESC, id LIMIT 10) c JOIN mpages p ON c.page_id = p.id JOIN services s ON p.service_id = s.id)
SELECT (SELECT count(*) FROM changes) AS total_changes, (SELECT count(*) FROM mpages WHERE is_active AND NOT is_deleted) AS active_pages,
 (SELECT count(*) FROM services WHERE is_active AND NOT is_deleted AND category = 'real_estate') AS main_services,
 (SELECT count(*) FROM services WHERE is_active AND NOT is_deleted AND category = 'other') AS other_services,
 (SELECT count(*) FROM last WHERE category = 'real_estate') AS recent_main, (SELECT count(*) FROM last WHERE category <> 'real_estate') AS recent_other""")
def dashboard(spark, sf):
    return digest.dashboard(sample.changes(spark, sf), sample.pages(spark, sf), sample.services(spark, sf))


@query("services_by_category", with_roles("services") + """
SELECT category, count(*) AS n_services FROM services WHERE NOT is_deleted GROUP BY category
UNION ALL SELECT 'all', count(*) FROM services WHERE NOT is_deleted""")
def services_by_category(spark, sf):
    return digest.services_by_category(sample.services(spark, sf))


@query("device_pivot", with_roles("pages") + """
SELECT url, page_type, max(CASE WHEN device = 'pc' THEN id END) AS pc_id, max(CASE WHEN device = 'sp' THEN id END) AS sp_id,
 max(CASE WHEN device NOT IN ('pc', 'sp') THEN id END) AS other_id FROM mpages GROUP BY 1, 2""")
def device_pivot(spark, sf):
    return digest.device_pairs(sample.pages(spark, sf))


@query("press_digest", with_roles("articles", "sources") + """
SELECT a.id AS article_id, '📰 競合プレスリリース検知' AS header, '*<' || article_url || '|' || title || '>*' || chr(10) || 'ソース: ' || s.name || ' | 日付: ' ||
 coalesce(strftime(published_at, '%Y-%m-%d'), '不明') || ' | カテゴリ: ' || relevance_category AS line, '> ' || summary AS quote
FROM articles a LEFT JOIN sources s ON a.source_id = s.id""")
def press_digest(spark, sf):
    return press_pages.press_digest(sample.articles(spark, sf), sample.press_sources(spark, sf))


@query("press_statistics", with_roles("articles") + """
SELECT source_id, count(*) AS new_articles, count_if(classification <> 'pending') AS classified,
 count_if(coalesce(summary, '') <> '') AS summarized, 0::BIGINT AS errors FROM articles GROUP BY 1""")
def press_statistics(spark, sf):
    return press_pages.press_statistics(sample.articles(spark, sf))


# Maintenance ------------------------------------------------------------------------

def _advice_edits(spark, sf):
    li = sample.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("change_id"), F.col("l_shipdate").alias("edited_at"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("edit_no"),
        F.concat(F.lit("note "), F.col("l_partkey")).alias("summary"),
        F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("priority"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("risk "), F.col("l_suppkey"))).alias("risks"),
    )


@query("upsert_latest", """
WITH e AS (SELECT l_orderkey AS change_id, 'note ' || l_partkey AS summary,
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN l_linestatus = 'O' THEN 'risk ' || l_suppkey END AS risks, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey * 100000 + l_suppkey * 10 + l_linenumber DESC) AS r,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_shipdate DESC, l_partkey * 100000 + l_suppkey * 10 + l_linenumber DESC) AS ro FROM lineitem),
b AS (SELECT c_custkey AS change_id, 'stored ' || c_nationkey AS summary, 'low' AS priority, 'stored risk' AS risks FROM customer),
n AS (SELECT * FROM e WHERE r = 1), x AS (SELECT change_id, risks FROM e WHERE ro = 1 AND l_linestatus = 'O')
SELECT coalesce(b.change_id, n.change_id) AS change_id, coalesce(n.summary, b.summary) AS summary,
 coalesce(n.priority, b.priority) AS priority, coalesce(x.risks, b.risks) AS risks
FROM b FULL JOIN n ON b.change_id = n.change_id LEFT JOIN x ON x.change_id = n.change_id""")
def upsert_latest(spark, sf):
    base = sample.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("change_id"), F.concat(F.lit("stored "), F.col("c_nationkey")).alias("summary"),
        F.lit("low").alias("priority"), F.lit("stored risk").alias("risks"),
    )
    return maintenance.upsert(base, _advice_edits(spark, sf), ["change_id"], ["summary", "priority", "risks"])


def _page_edits(spark, sf):
    e = sample.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") * 20).alias("id"), F.col("ts").alias("edited_at"), F.col("event_id").alias("edit_no"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("https://e.example.com/"), F.col("event_id"))).alias("url"),
        F.when(F.col("event_type") == "view", F.lit("sp")).alias("device"),
    )


@query("partial_update", with_roles("pages") + """
, k AS (SELECT user_id * 20 AS id, 'https://e.example.com/' || event_id AS url FROM events WHERE event_type = 'click'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
v AS (SELECT DISTINCT user_id * 20 AS id FROM events WHERE event_type = 'view')
SELECT p.id, coalesce(k.url, p.url) AS url, CASE WHEN v.id IS NOT NULL THEN 'sp' ELSE p.device END AS device
FROM mpages p LEFT JOIN k ON p.id = k.id LEFT JOIN v ON p.id = v.id""")
def partial_update(spark, sf):
    rows, _ = maintenance.partial_update(sample.pages(spark, sf), _page_edits(spark, sf), ["url", "device"])
    return rows.select("id", "url", "device")


@query("unknown_edits", """
SELECT user_id * 20 AS id, count(*) AS n_edits FROM events WHERE user_id * 20 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def unknown_edits(spark, sf):
    _, unknown = maintenance.partial_update(sample.pages(spark, sf), _page_edits(spark, sf), ["url", "device"])
    return unknown.groupBy("id").agg(F.count(F.lit(1)).alias("n_edits"))


@query("toggle_parity", with_roles("changes") + """
, t AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1)
SELECT c.id, (coalesce(t.n, 0) % 2 = 1) <> c.is_reviewed AS is_reviewed FROM changes c LEFT JOIN t ON c.id = t.id""")
def toggle_parity(spark, sf):
    toggles = sample.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return maintenance.toggle_reviewed(sample.changes(spark, sf), toggles).select("id", "is_reviewed")


@query("insight_parent_check", """
SELECT event_type AS insight_type, count(*) AS n, count_if(user_id * 40 IN (SELECT doc_id FROM documents)) AS accepted FROM events GROUP BY 1""")
def insight_parent_check(spark, sf):
    rows = sample.insights(spark, sf).withColumn("article_id", F.col("article_id") * 40)
    kept, rejected = maintenance.append_with_parent(rows, sample.articles(spark, sf), "article_id")
    both = kept.withColumn("ok", F.lit(1)).unionByName(rejected.withColumn("ok", F.lit(0)))
    return both.groupBy("insight_type").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("accepted"))


@query("soft_delete_cascade", with_roles("services", "pages") + """
, gone AS (SELECT id FROM services WHERE NOT is_deleted AND category = 'other')
SELECT 'service' AS kind, id, is_deleted OR id IN (SELECT id FROM gone) AS is_deleted FROM services
UNION ALL SELECT 'page', id, is_deleted OR service_id IN (SELECT id FROM gone) FROM mpages""")
def soft_delete_cascade(spark, sf):
    s, p = sample.services(spark, sf).withColumn("id", F.col("id").cast("bigint")), sample.pages(spark, sf)
    gone = s.filter("category = 'other'").select("id", F.lit("2024-01-01").cast("timestamp").alias("deleted_at"))
    s2, p2 = maintenance.soft_delete_services(s, p, gone)
    flag = F.col("deleted_at").isNotNull().alias("is_deleted")
    return s2.select(F.lit("service").alias("kind"), "id", flag).unionByName(p2.select(F.lit("page").alias("kind"), "id", flag))


NOISE_SQL = with_roles("changes", "advice") + """, noise AS (SELECT c.id FROM changes c JOIN advice a ON a.change_id = c.id
 WHERE c.detected_at < TIMESTAMP '1999-01-01' AND a.priority = 'low' AND contains(a.summary, 'noted'))"""


@query("noise_purge", NOISE_SQL + """
SELECT category, count(*) AS n_left FROM changes WHERE id NOT IN (SELECT id FROM noise) GROUP BY 1
UNION ALL SELECT 'advice', count(*) FROM advice WHERE change_id NOT IN (SELECT id FROM noise)""")
def noise_purge(spark, sf):
    kept, advice = maintenance.purge_noise(
        sample.changes(spark, sf), sample.advice(spark, sf), priority="low", summary_contains="noted", before="1999-01-01"
    )
    n = F.count(F.lit(1)).alias("n_left")
    return kept.groupBy("category").agg(n).unionByName(advice.groupBy(F.lit("advice").alias("category")).agg(n))


@query("noise_dry_run", NOISE_SQL + """
SELECT (SELECT count(*) FROM noise) AS matching_changes, (SELECT count(*) FROM advice WHERE change_id IN (SELECT id FROM noise)) AS matching_advice""")
def noise_dry_run(spark, sf):
    return maintenance.purge_counts(
        sample.changes(spark, sf), sample.advice(spark, sf), priority="low", summary_contains="noted", before="1999-01-01"
    )


@query("validation_report", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'name:サービス名を入力してください;' WHEN c_custkey % 7 = 1 THEN 'name:サービス名は英数字とハイフンのみ使用できます;'
  WHEN c_custkey % 7 = 2 THEN 'name:サービス名は50文字以内で入力してください;' ELSE '' END ||
 CASE WHEN c_custkey % 5 = 0 THEN 'base_url:有効なURL形式で入力してください;' ELSE '' END ||
 CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'category:カテゴリを選択してください;' END AS errors FROM customer""")
def validation_report(spark, sf):
    c = sample.table(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        k.alias("id"),
        F.when(k % 7 == 0, " ").when(k % 7 == 1, F.col("c_name")).when(k % 7 == 2, F.repeat(F.lit("abc-"), 20))
        .otherwise(F.regexp_replace("c_name", "#", "-")).alias("name"),
        F.col("c_name").alias("display_name"),
        F.when(k % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("https://c"), k, F.lit(".example.com"))).alias("base_url"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise(F.lower("c_mktsegment")).alias("category"),
    )
    report = maintenance.validate_services(rows)
    text = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["message"], F.lit(";"))), "")
    return report.select("id", text.alias("errors"))


@query("page_validation", with_roles("pages") + """
SELECT page_type, device, 0::BIGINT AS n_invalid, count(*) AS n FROM mpages WHERE page_type <> 'list' GROUP BY 1, 2
UNION ALL SELECT page_type, device, count(*), count(*) FROM mpages WHERE page_type = 'list' GROUP BY 1, 2""")
def page_validation(spark, sf):
    rows = maintenance.validate_pages(sample.pages(spark, sf))
    return rows.groupBy("page_type", "device").agg(F.count_if(~F.col("valid")).alias("n_invalid"), F.count(F.lit(1)).alias("n"))


@query("source_validation", with_roles("sources") + " SELECT id, TRUE AS valid FROM sources")
def source_validation(spark, sf):
    return maintenance.validate_press_sources(sample.press_sources(spark, sf)).select("id", "valid")


@query("uniqueness_conflicts", with_roles("pages") + """
SELECT e.id, e.url FROM mpages e WHERE EXISTS (SELECT 1 FROM mpages s WHERE s.url = e.url AND s.id <> e.id AND NOT s.is_deleted)""")
def uniqueness_conflicts(spark, sf):
    p = sample.pages(spark, sf)
    return maintenance.conflicts(p.select("id", "url"), p, "url").select("id", "url")


@query("duplicated_articles", with_roles("articles") + """
SELECT source_id, article_url, count(*) AS n_rows FROM articles GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicated_articles(spark, sf):
    return maintenance.duplicated_keys(sample.articles(spark, sf), ["source_id", "article_url"])


@query("device_expansion", with_roles("pages") + """
SELECT device, count(*) AS n FROM (SELECT CASE WHEN device = 'both' THEN 'pc' ELSE device END AS device FROM mpages
 UNION ALL SELECT 'sp' FROM mpages WHERE device = 'both') GROUP BY 1""")
def device_expansion(spark, sf):
    return maintenance.expand_devices(sample.pages(spark, sf)).groupBy("device").agg(F.count(F.lit(1)).alias("n"))


@query("new_articles", """
WITH a AS (SELECT doc_id, source, 'https://' || source || '.example.com/a/' || n_chars || '-' || md5(text) AS url FROM documents),
s AS (SELECT DISTINCT source, url FROM a WHERE doc_id % 4 = 0),
f AS (SELECT source, url, min(doc_id) AS id FROM a WHERE doc_id % 4 <> 0 GROUP BY 1, 2)
SELECT f.id, f.source AS source_id FROM f LEFT JOIN s ON f.source = s.source AND f.url = s.url WHERE s.url IS NULL""")
def new_articles(spark, sf):
    a = sample.articles(spark, sf)
    found = a.filter("id % 4 <> 0").withColumn("found_at", F.col("created_at")).withColumn("idx", F.col("id"))
    return press_pages.new_articles(found, a.filter("id % 4 = 0")).select("id", "source_id")


@query("date_backfill", """
SELECT doc_id AS id, CASE WHEN doc_id % 5 < 4 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') END AS found_on
FROM documents WHERE doc_id % 3 = 0 AND n_chars % 13 <> 0""")
def date_backfill(spark, sf):
    return press_pages.backfill_dates(sample.articles(spark, sf)).select("id", "found_on")


@query("date_backfill_counts", """
SELECT count(*) AS total_without_date, count_if(doc_id % 5 < 4) AS updated, count_if(doc_id % 5 = 4) AS still_no_date
FROM documents WHERE doc_id % 3 = 0 AND n_chars % 13 <> 0""")
def date_backfill_counts(spark, sf):
    rows = press_pages.backfill_dates(sample.articles(spark, sf), mode="mixed")
    return press_pages.backfill_counts(rows)


@query("list_page_pick", with_roles("pages") + """
SELECT service_id, id FROM mpages WHERE page_type IN ('list', 'listing') AND is_active AND NOT is_deleted
QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY CASE WHEN device = 'pc' THEN 0 ELSE 1 END, id) = 1""")
def list_page_pick(spark, sf):
    from tidemark.operators.scoring import list_page_of_service

    return list_page_of_service(sample.pages(spark, sf)).select("service_id", "id")


@query("stored_changes", with_roles("changes") + """
, t AS (SELECT id, repeat(summary || chr(10), CAST(200 + id % 300 AS INTEGER)) AS d FROM changes)
SELECT id, length(d) AS stored_length, md5(d) AS digest FROM t""")
def stored_changes(spark, sf):
    c = sample.changes(spark, sf).withColumn(
        "diff_text", F.expr("repeat(concat(summary, '\n'), cast(200 + id % 300 as int))")
    )
    rows = tables.change_rows(c)
    return rows.select("id", F.length("diff_text").cast("bigint").alias("stored_length"), F.md5("diff_text").alias("digest"))
