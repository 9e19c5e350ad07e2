"""The press run as one plan: listings and article pages to classified, summarised articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import press_pages, scoring


def published_day(listing_day: Column, page_day: Column) -> Column:
    """Date of the listing, else the date of the article page."""
    return F.coalesce(listing_day, page_day)


def found_articles(listings: DataFrame, stored: DataFrame) -> DataFrame:
    """New articles named on listing pages.

    ``listings``: capture_id, source_id, source_name, base_url, html. Navigation rows and
    articles already stored in any state are left out.
    """
    rows = press_pages.listing_rows(listings).join(listings.select("capture_id", "source_id", "base_url"), "capture_id")
    rows = rows.filter(press_pages.is_article(F.col("title"), F.col("url"), F.col("base_url")))
    rows = rows.withColumnRenamed("url", "article_url").withColumn("found_at", F.col("capture_id"))
    return press_pages.new_articles(rows, stored).select("source_id", "article_url", "title", "published_on")


def press_articles(
    listings: DataFrame, article_pages: DataFrame, stored: DataFrame, classify: dict | None = None, summarise: dict | None = None
) -> DataFrame:
    """New articles with body, date, classification and summary.

    ``article_pages``: capture_id, url, source_name, html. An article without a captured
    page keeps an empty body and is judged by its title.
    """
    found = found_articles(listings, stored)
    texts = press_pages.article_bodies(article_pages).join(
        press_pages.article_dates(article_pages).withColumnRenamed("published_on", "page_day"), "capture_id"
    )
    texts = article_pages.select("capture_id", F.col("url").alias("article_url")).join(texts, "capture_id").drop("capture_id")
    rows = found.join(texts, "article_url", "left").withColumn("body_text", F.coalesce("body_text", F.lit("")))
    rows = rows.withColumn("published_on", published_day(F.col("published_on"), F.col("page_day"))).drop("page_day")
    return scoring.written_back(scoring.classify_articles(rows, **(classify or {})), **(summarise or {}))
