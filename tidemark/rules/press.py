"""Fixed values of the press pipeline."""

from tidemark.functions.text import wide

IRRELEVANT = [
    "人事|取締役|執行役|役員|代表|社長就任",
    "決算|IR|投資家|株主|配当|有価証券",
    "イベント|セミナー|展示会|協賛|スポンサー",
    "CSR|SDGs|社会貢献|ボランティア",
    "オフィス移転|組織変更|グループ会社",
]
RELEVANT = {
    "service_feature": ["新機能", "リリース", "サービス開始", "提供開始", "機能追加", "アップデート", "新サービス", "β版", "正式版"],
    "market_data": ["調査", "レポート", "統計", "データ", "白書", "トレンド", "動向", "市場", "実態"],
    "ux_improvement": ["UI", "UX", "デザイン", "ユーザビリティ", "使いやすさ", "リニューアル", "改善", "刷新"],
    "pricing": ["料金", "価格", "プラン", "値下げ", "無料", "有料", "課金", "手数料"],
}
CONFIDENCE_THRESHOLD = 0.3

SUMMARY_KEYWORDS = {
    "service_feature": ["新機能", "リリース", "サービス", "提供開始", "機能", "アップデート", "対応"],
    "market_data": ["調査", "結果", "データ", "割合", "%", "件数", "増加", "減少", "前年比"],
    "ux_improvement": ["UI", "UX", "デザイン", "改善", "リニューアル", "使いやすさ"],
    "pricing": ["料金", "価格", "プラン", "無料", "月額", "円"],
    "other": [],
}
SENTENCE_ENDS = "。！？"
SUMMARY_MIN, SUMMARY_MAX = 50, 200

TITLE_LIMIT = URL_LIMIT = BODY_LIMIT = None  # no limit

# Paths and titles that are not articles.
NOT_ARTICLE_PATH = (
    r"(?i)(^/$|^#|/contact/?$|/career/?$|/recruit/?$|/about/?$|/company/?$|/mission/?$|/member/?$|/service/?$"
    r"|/services/?$|/privacy/?$|/terms/?$|/sitemap/?$|/faq/?$|/login/?$|/signup/?$|/download/?$|/seminar/?$"
    r"|/whitepaper/?$|/cookie/?$|javascript:|mailto:)"
)
NOT_ARTICLE_TITLE = (
    r"(?i)^(Mission|Member|Services|Contact|Career|About|会社概要|お問い合わせ|採用情報|事業内容|ミッション|メンバー"
    r"|プライバシー|利用規約|サイトマップ|お役立ち資料|セミナー|資料ダウンロード)(\s|$)"
)

DATE_META = [
    "article:published_time", "og:article:published_time", "article:modified_time", "pubdate", "date",
    "DC.date.issued",
]
DATE_CLASSES = [
    "date", "post-date", "entry-date", "article-date", "news-date", "newsDate", "publish-date", "published",
]

# Listing profiles. An item selector is (tag, class, enclosing tag, enclosing class), None = any.
# A strategy is (kind, selectors): "dt" pairs a term with the next definition, "item" takes
# the first link inside, "card" also a link around or a heading, "dated" needs a date in the
# text, "list" and "heading" are the generic forms. The first strategy with a row wins.
_DT = [("dt", None, "dl", "news-list"), ("dt", None, "dl", "newsList")]
_NEWS_LI = [("li", None, None, "news-list"), ("li", None, None, "newsList")]
LISTING_PROFILES = {
    "suumo": {
        "strategies": [
            ("dt", _DT),
            ("item", [("li", "news-item", None, None), ("li", "newsItem", None, None), *_NEWS_LI,
                      ("li", None, None, "newsroom-list"), ("li", None, "ul", "list")]),
            ("item", [("article", None, None, None), (None, "article-item", None, None),
                      (None, "press-item", None, None), (None, "news-entry", None, None)]),
        ],
        "fallback": r"(?i)(news|press|release|newsroom|recruit\.co\.jp/newsroom)",
        "date_classes": ["date", "time", "news-date", "newsDate"],
    },
    "athome": {
        "strategies": [
            ("dt", [*_DT, ("dt", None, None, "news-list")]),
            ("item", [(None, "news-item", None, None), (None, "newsItem", None, None), *_NEWS_LI,
                      ("li", None, None, "press-list"), ("li", None, None, "topics-list"), ("li", None, "ul", "news")]),
            ("item", [(None, "news-block", None, None), (None, "newsBlock", None, None),
                      (None, "press-release-item", None, None), ("article", "news", None, None),
                      (None, "entry", None, None), (None, "post-item", None, None)]),
        ],
        "fallback": r"(?i)(news|press|release|topics|info)",
        "date_classes": ["date", "time", "news-date", "newsDate", "post-date"],
    },
    "canary": {
        "strategies": [
            ("card", [(None, c, None, None) for c in (
                "news-item", "newsItem", "news-card", "newsCard", "press-item", "pressItem", "post-item", "postItem")]),
            ("titled", [*_NEWS_LI, ("li", None, None, "press-list"), ("li", None, None, "topics"),
                        ("li", None, None, "information"), ("li", None, "ul", "news")]),
            ("titled", [("article", None, None, None), (None, "article", None, None), (None, "entry", None, None),
                        (None, "post", None, None), ("section", "news-item", None, None)]),
        ],
        "fallback": r"(?i)(news|press|release|topics|info|blog)",
        "date_classes": ["date", "time", "news-date", "newsDate", "post-date", "entry-date"],
    },
    "itandi": {
        "strategies": [("dated", [(t, None, None, None) for t in ("article", "li", "div", "a")])],
        "fallback": None,
        "date_classes": [],
    },
    "generic": {
        "strategies": [
            ("article", [("article", None, None, None)]),
            ("list", [("li", None, "ul", None), ("li", None, "ol", None)]),
            ("heading", [("h2", None, None, None), ("h3", None, None, None)]),
        ],
        "fallback": None,
        "date_classes": ["date", "time"],
    },
}
PROFILE_NAMES = [("suumo", "suumo"), ("athome", "athome"), ("canary", "canary"), ("bluage", "canary"), ("itandi", "itandi")]
DATED_PREFIX = wide(r"^\d{4}[./]\d{1,2}[./]\d{1,2}\s*(プレスリリース|お知らせ|PRESS RELEASE|NEWS)?\s*")
DATED_SKIP = r"(?i)/(download|seminar|whitepaper|contact|about)/?$"

# Body selectors (tag, class, id, enclosing tag) in order, characters needed, tags removed first.
BODY_PROFILES = {
    "suumo": {
        "selectors": [(None, c, None, None) for c in (
            "news-detail__body", "newsDetail__body", "article-body", "articleBody", "press-body", "entry-content")]
        + [(None, "content", None, "article"), ("article", None, None, None), (None, "main-content", None, None),
           ("main", None, None, None)],
        "least": 50, "removed": [],
    },
    "athome": {
        "selectors": [(None, c, None, None) for c in (
            "news-detail", "newsDetail", "article-content", "articleContent", "entry-content", "entryContent",
            "press-content", "news-body")]
        + [(None, "body", None, "article"), ("article", None, None, None), (None, "main-content", None, None),
           ("main", None, None, None)],
        "least": 50, "removed": [],
    },
    "canary": {
        "selectors": [(None, c, None, None) for c in (
            "news-content", "newsContent", "article-body", "articleBody", "entry-content", "entryContent",
            "post-content", "postContent", "press-body", "content-area")]
        + [(None, "content", None, "article"), ("article", None, None, None), (None, "content", None, "main"),
           ("main", None, None, None)],
        "least": 50, "removed": [],
    },
    "itandi": {
        "selectors": [(None, "news-content", None, None), (None, "article-content", None, None),
                      (None, "entry-content", None, None), ("article", None, None, None),
                      (None, "content", None, "main"), ("main", None, None, None)],
        "least": 100, "removed": ["nav", "header", "footer"],
    },
    "generic": {
        "selectors": [("main", None, None, None), ("article", None, None, None)]
        + [(None, c, None, None) for c in ("content", "entry-content", "article-content", "post-content", "main-content")]
        + [(None, None, "content", None), (None, None, "main", None)],
        "least": 50, "removed": ["nav", "header", "footer", "aside"],
    },
}
LARGEST_TAGS = {"generic": ["div", "section"]}
LARGEST_TAGS_DEFAULT = ["div", "article", "section", "main"]
