"""Listings, bodies and dates of press pages."""

from pyspark.sql import functions as F

from tidemark.functions.dates import calendar_date, date_from_head, date_from_text
from tidemark.operators import press_pages

LISTINGS = [
    ("suumo-press", '<dl class="news-list"><dt>2025年1月5日</dt><dd><a href="/n/1">First title</a></dd><dt>2025.2.6<dd><a href="n2">Second</a></dl><ul class="list"><li><a href="/x">X</a></ul>',
     [("https://p.example.com/n/1", "First title", "2025-01-05"), ("https://p.example.com/news/n2", "Second", "2025-02-06")]),
    ("athome", '<ul class="news"><li><time datetime="2025-03-04T00:00">x</time><a href="a/b.html">One</a><li><span class="date">2025/1/2</span><a href="../c">Two</a></ul>',
     [("https://p.example.com/news/a/b.html", "One", "2025-03-04"), ("https://p.example.com/c", "Two", "2025-01-02")]),
    ("BluAge", '<a href="/card"><div class="news-card"><h3>Card heading</h3><p>2024-1-9</p></div></a>',
     [("https://p.example.com/card", "Card heading2024-1-9", "2024-01-09")]),
    ("itandi", '<ul><li>2026.06.18 お知らせ <a href="/p/1">A sufficiently long title</a></li></ul><div><a href="/about/">2026.06.18 about page long</a></div>',
     [("https://p.example.com/p/1", "A sufficiently long title", "2026-06-18")]),
    ("other", '<ul><li><a href="/">Home page</a><li><a href="/q">Question</a></ul>', [("https://p.example.com/q", "Question", None)]),
    ("suumo", '<p><a href="/news/5">Fallback title</a><a href="/news/5">again the same</a></p>', [("https://p.example.com/news/5", "Fallback title", None)]),
    ("zzz", '<h2>Head</h2><p><a href="/t">t</a></p><h3><a href="/u">U</a></h3>', [("https://p.example.com/t", "Head", None), ("https://p.example.com/u", "U", None)]),
]


def test_listing_strategies(spark):
    rows = spark.createDataFrame(
        [(i, s, "https://p.example.com/news/", h) for i, (s, h, _) in enumerate(LISTINGS)],
        "capture_id int, source_name string, base_url string, html string",
    )
    got = {}
    for r in press_pages.listing_rows(rows).orderBy("capture_id", "idx").collect():
        got.setdefault(r.capture_id, []).append((r.url, r.title, r.published_on))
    assert got == {i: want for i, (_, _, want) in enumerate(LISTINGS)}


def test_article_filter(spark):
    cases = [
        ("A long enough title", "https://p.example.com/news/1", True), ("A long enough title", "https://p.example.com/news", False),
        ("Contact information", "https://p.example.com/x/contact/", False), ("会社概要 について詳しく", "https://p.example.com/y", False),
        ("short", "https://p.example.com/z", False), ("", "https://p.example.com/z", False), ("Services offered today", "https://p.example.com/z2", False), ("Servicesoffered today", "https://p.example.com/z3", True),
    ]
    rows = spark.createDataFrame(cases, "t string, u string, want boolean")
    bad = rows.filter(press_pages.is_article(F.col("t"), F.col("u"), F.lit("https://p.example.com/news/")) != F.col("want"))
    assert bad.collect() == []


def test_bodies(spark):
    pages = [
        (1, "suumo", "<nav>n</nav><article>" + "x " * 60 + "</article>"), (2, "zzz", "<header>h</header><div>a<div>b b</div></div><section>ccccc ddd</section>"),
        (3, "canary", "<nav>" + "n" * 90 + "</nav><div>short</div>"), (4, "suumo", "<p></p>"), (5, "zzz", "<main>" + "m" * 60 + "<aside>no</aside></main>"),
    ]
    rows = spark.createDataFrame(pages, "capture_id int, source_name string, html string")
    got = {r.capture_id: r.body_text for r in press_pages.article_bodies(rows).collect()}
    assert got == {1: ("x " * 60).strip(), 2: "ccccc ddd", 3: "short", 4: "", 5: "m" * 60}


def test_page_dates(spark):
    pages = [
        (1, '<script type="application/ld+json">[{"x":1},{"datePublished":"2025-04-05T00:00"}]</script><meta name=date content="2024-1-1">', "2025-04-05"),
        (2, '<meta name="pubdate" content="2024/2/3"><time>2020-1-1</time>', "2024-02-03"), (3, '<time>soon</time><time datetime="2023-5-6">x</time>', "2023-05-06"),
        (4, '<div class="postDate">2022.1.2</div>', "2022-01-02"), (5, "<header>on 2021年3月4日 x</header><article>2020-1-1</article>", "2021-03-04"), (6, "none", None),
        (7, '<script type="application/ld+json">{bad</script><p class=date>2019-9-9</p>', "2019-09-09"), (8, "<header>h</header><article>2018-1-1</article>", None),
    ]
    rows = spark.createDataFrame([p[:2] for p in pages], "capture_id int, html string")
    got = {r.capture_id: r.published_on for r in press_pages.article_dates(rows).collect()}
    assert got == {i: d for i, _, d in pages}


def test_dates_in_text(spark):
    cases = [("2025年1月5日", "2025-01-05"), ("2025.1.5 x", "2025-01-05"), ("on 2025/01/15", "2025-01-15"), ("2025-1-15T00", "2025-01-15"), ("none", None), ("2024.1.1 2025年2月3日", "2025-02-03")]
    rows = spark.createDataFrame(cases, "t string, w string").select("*", date_from_text(F.col("t")).alias("d"))
    assert [r.d for r in rows.collect()] == [w for _, w in cases]
    row = spark.range(1).select(
        calendar_date(F.lit("2025-02-30")).alias("none"), date_from_head(F.lit("2024.1.1 2025年2月3日"), "mixed", 500).alias("mixed"),
        date_from_head(F.lit("x" * 600 + "2025-1-1"), "mixed", 500).alias("late"),
    ).first()
    assert row.none is None and row.mixed == "2024-01-01" and row.late is None
