"""The given sample tables in the roles of the stored tables.

Every role is derived from whole tables with column expressions; nothing is cut down.
``ROLE_SQL`` states the same derivations in ANSI SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as captures: the page is the URL host, the capture order the page id."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("capture_id"), urls.host(F.col("url")).alias("page_id"), "url", "html")


def case(value: Column, pairs: dict, default=None) -> Column:
    out = F
    for k, v in pairs.items():
        out = out.when(value == k, v)
    return out.otherwise(default)


CATEGORY_OF = {"1-URGENT": "CRO", "2-HIGH": "AD_PRODUCT", "3-MEDIUM": "SEO", "4-NOT SPECIFIED": "AI", "5-LOW": "OTHER"}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page_id"), F.col("o_orderstatus").alias("service_name"),
        case(F.col("o_orderpriority"), CATEGORY_OF).alias("category"),
        F.concat(F.lit("Order "), F.lower("o_orderpriority"), F.lit(" total "), F.floor("o_totalprice").cast("string")).alias("summary"),
        F.col("o_orderdate").alias("detected_at"), (F.floor("o_totalprice") % 2 == 0).alias("is_reviewed"),
    )


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_linestatus").alias("s"), F.max("l_shipdate").alias("d")
    )
    return per_order.select(
        F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("change_id"),
        F.concat(F.lit("noted "), F.col("n").cast("string"), F.lit(" lines")).alias("summary"),
        F.when(F.col("n") % 2 == 0, F.lit("MCP経由 later")).otherwise("they sell more").alias("intent"),
        F.when(F.col("s") == "F", F.lit("MCP経由 later")).otherwise("follow them").alias("proposal"),
        F.when(F.col("n") % 3 == 0, "low").when(F.col("n") % 3 == 1, "medium").otherwise("high").alias("priority"),
        F.col("d").alias("created_at"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("display_name"),
        F.when(F.col("n_regionkey") < 2, "real_estate").otherwise("other").alias("category"),
        (F.col("n_nationkey") % 7 != 3).alias("is_active"),
        F.when(F.col("n_nationkey") % 11 == 5, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
        F.timestamp_seconds(F.col("n_nationkey") * 86400).alias("created_at"),
    )


PAGE_TYPE_OF = {"MACHINERY": "detail", "BUILDING": "list", "AUTOMOBILE": "form", "HOUSEHOLD": "search", "FURNITURE": "listing"}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("service_id"),
        F.concat(F.lit("https://n"), F.col("c_nationkey"), F.lit(".example.com/p/"), F.floor(F.col("c_custkey") / 2)).alias("url"),
        case(F.col("c_mktsegment"), PAGE_TYPE_OF).alias("page_type"),
        F.when(F.col("c_custkey") % 2 == 0, "pc").when(F.col("c_custkey") % 3 == 0, "both").otherwise("sp").alias("device"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(F.col("c_acctbal") > 9000, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
        F.timestamp_seconds(F.col("c_custkey") * 3600).alias("created_at"),
    )


def own_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 4 == 0, "detail").when(F.col("s_suppkey") % 4 == 1, "list")
        .when(F.col("s_suppkey") % 4 == 2, "form").otherwise("top").alias("page_type"),
        F.concat(F.lit("https://own.example.com/"), F.col("s_suppkey")).alias("url"),
        F.when(F.col("s_nationkey") % 2 == 0, "pc").otherwise("sp").alias("device"),
        (F.col("s_acctbal") > 0).alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def press_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("m"))
    return d.select(
        F.col("source").alias("id"), F.concat(F.col("source"), F.lit("-press")).alias("name"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/news/")).alias("url"),
        (F.col("m") % 5 != 0).alias("is_active"), F.when(F.col("m") % 7 == 3, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
        F.timestamp_seconds(F.col("m") * 60).alias("created_at"),
    )


DAY0 = "2020-01-01"


def article_day() -> Column:
    """Day written into the body of document doc_id."""
    return F.date_add(F.lit(DAY0).cast("date"), (F.col("doc_id") % 1500).cast("int"))


def dated_body() -> Column:
    """Document text after a date in one of four notations; every fifth text has none."""
    day, k = article_day(), F.col("doc_id") % 5
    stamp = (
        F.when(k == 0, F.date_format(day, "yyyy'年'M'月'd'日'")).when(k == 1, F.date_format(day, "yyyy.MM.dd"))
        .when(k == 2, F.date_format(day, "yyyy/M/d")).when(k == 3, F.date_format(day, "yyyy-MM-dd"))
    )
    return F.when(stamp.isNotNull(), F.concat(stamp, F.lit(" "), F.col("text"))).otherwise(F.col("text"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("n_chars"), F.lit("-"), F.md5("text")).alias("article_url"),
        F.when(F.col("doc_id") % 3 > 0, article_day().cast("timestamp")).alias("published_at"),
        dated_body().alias("body_text"),
        F.when(F.col("doc_id") % 4 == 0, "pending").when(F.col("doc_id") % 4 == 1, "relevant").otherwise("irrelevant").alias("classification"),
        F.when(F.col("lang") == "en", "market_data").when(F.col("lang") == "fr", "pricing").otherwise("other").alias("relevance_category"),
        F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("summary"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"),
        F.when(F.col("n_chars") % 13 == 0, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("article_id"), F.col("event_type").alias("insight_type"),
        F.when(F.col("value") < 5, "low").when(F.col("value") < 15, "medium").otherwise("high").alias("priority"),
        F.when(F.col("event_id") % 2 == 0, "new").otherwise("reviewed").alias("status"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("tags"),
        F.col("ts").alias("created_at"),
    )


# The same roles in SQL.
ROLE_SQL = {
    "changes": """changes AS (SELECT o_orderkey AS id, o_custkey AS page_id, o_orderstatus AS service_name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'CRO' WHEN '2-HIGH' THEN 'AD_PRODUCT' WHEN '3-MEDIUM' THEN 'SEO'
        WHEN '4-NOT SPECIFIED' THEN 'AI' WHEN '5-LOW' THEN 'OTHER' END AS category,
      'Order ' || lower(o_orderpriority) || ' total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS summary,
      o_orderdate AS detected_at, CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 AS is_reviewed FROM orders)""",
    "advice": """advice AS (SELECT l_orderkey AS id, l_orderkey AS change_id, 'noted ' || n || ' lines' AS summary,
      CASE WHEN n % 2 = 0 THEN 'MCP経由 later' ELSE 'they sell more' END AS intent,
      CASE WHEN s = 'F' THEN 'MCP経由 later' ELSE 'follow them' END AS proposal,
      CASE n % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority, d AS created_at
      FROM (SELECT l_orderkey, count(*) AS n, min(l_linestatus) AS s, max(l_shipdate) AS d FROM lineitem GROUP BY 1))""",
    "services": """services AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS display_name,
      CASE WHEN n_regionkey < 2 THEN 'real_estate' ELSE 'other' END AS category, n_nationkey % 7 <> 3 AS is_active,
      n_nationkey % 11 = 5 AS is_deleted, n_nationkey AS created_no FROM nation)""",
    "pages": """mpages AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS service_id,
      'https://n' || c_nationkey || '.example.com/p/' || (c_custkey // 2) AS url,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'detail' WHEN 'BUILDING' THEN 'list' WHEN 'AUTOMOBILE' THEN 'form'
        WHEN 'HOUSEHOLD' THEN 'search' WHEN 'FURNITURE' THEN 'listing' END AS page_type,
      CASE WHEN c_custkey % 2 = 0 THEN 'pc' WHEN c_custkey % 3 = 0 THEN 'both' ELSE 'sp' END AS device,
      c_acctbal > 0 AS is_active, c_acctbal > 9000 AS is_deleted FROM customer)""",
    "own_pages": """own AS (SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'detail' WHEN 1 THEN 'list'
      WHEN 2 THEN 'form' ELSE 'top' END AS page_type, 'https://own.example.com/' || s_suppkey AS url,
      CASE WHEN s_nationkey % 2 = 0 THEN 'pc' ELSE 'sp' END AS device, s_acctbal > 0 AS is_active FROM supplier)""",
    "sources": """sources AS (SELECT source AS id, source || '-press' AS name, 'https://' || source || '.example.com/news/' AS url,
      min(doc_id) % 5 <> 0 AS is_active, min(doc_id) % 7 = 3 AS is_deleted, min(doc_id) AS created_no FROM documents GROUP BY source)""",
    "articles": """articles AS (SELECT doc_id AS id, source AS source_id, text AS title,
      'https://' || source || '.example.com/a/' || n_chars || '-' || md5(text) AS article_url,
      CASE WHEN doc_id % 3 > 0 THEN CAST(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS TIMESTAMP) END AS published_at,
      CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'relevant' ELSE 'irrelevant' END AS classification,
      CASE lang WHEN 'en' THEN 'market_data' WHEN 'fr' THEN 'pricing' ELSE 'other' END AS relevance_category,
      CASE WHEN doc_id % 6 <> 0 THEN text END AS summary, doc_id AS created_no, text,
      n_chars % 13 = 0 AS is_deleted FROM documents)""",
    "insights": """insights AS (SELECT event_id AS id, user_id AS article_id, event_type AS insight_type,
      CASE WHEN value < 5 THEN 'low' WHEN value < 15 THEN 'medium' ELSE 'high' END AS priority,
      CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'reviewed' END AS status,
      'k' || json_extract_string(props, '$.k') AS tag, ts AS created_at FROM events)""",
}


def with_roles(*names: str) -> str:
    return "WITH " + ",\n".join(ROLE_SQL[n] for n in names)
