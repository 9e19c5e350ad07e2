"""Fixed values of the page scan: expired notices, services, change categories."""

# Notices that a listing has ended, per service: (pattern, weight).
EXPIRED = {
    "suumo": [
        ("掲載期間が終了", 10), ("この物件の掲載は終了しました", 10), ("この物件の掲載期間は終了", 10),
        ("掲載が終了した物件", 8), ("現在公開されていません", 8), ("公開が終了しています", 8),
        ("類似物件を探す", 3), ("お探しの物件は見つかりませんでした", 8), ("こちらの物件情報は掲載を終了", 10),
    ],
    "athome": [
        ("掲載期間が終了", 10), ("この物件の掲載は終了", 10), ("掲載終了", 6), ("この物件情報は掲載が終了", 10),
        ("掲載が終了しています", 10), ("物件の掲載期間が終了", 10), ("現在この物件は公開されて", 8),
        ("類似のおすすめ物件", 3), ("この物件は現在掲載されて", 8), ("お探しの物件情報の掲載は終了", 10),
    ],
    "canary": [
        ("掲載終了", 6), ("この物件は掲載が終了", 10), ("掲載期間が終了", 10), ("募集が終了", 8),
        ("現在募集していません", 8), ("この部屋の募集は終了", 10),
    ],
    "carsensor": [
        ("この車両の掲載は終了", 10), ("掲載期間が終了", 10), ("この車両は販売済み", 10), ("販売終了", 8),
        ("SOLD OUT", 8), ("売約済み", 8), ("この中古車は掲載が終了", 10), ("掲載終了", 6),
        ("在庫確認ができません", 8), ("類似の中古車を探す", 3),
    ],
    "goo-net": [
        ("この車両の掲載は終了", 10), ("掲載期間が終了", 10), ("この車両は売約済み", 10), ("売約済み", 8),
        ("SOLD", 8), ("販売終了", 8), ("在庫なし", 8), ("掲載終了", 6), ("この中古車情報は掲載が終了", 10),
        ("似た条件の中古車", 3),
    ],
    "eheya": [
        ("この物件の掲載は終了", 10), ("掲載期間が終了", 10), ("掲載終了", 6), ("この物件は掲載が終了", 10),
        ("現在募集していません", 8), ("募集が終了", 8), ("お探しの物件は見つかりません", 8),
    ],
    "sumaity": [
        ("この物件の掲載は終了", 10), ("掲載期間が終了", 10), ("掲載終了", 6), ("現在募集中の部屋はありません", 10),
        ("募集が終了", 8), ("この物件情報は掲載が終了", 10),
    ],
    "smocca": [
        ("この物件の掲載は終了", 10), ("掲載期間が終了", 10), ("掲載終了", 6), ("この物件は現在掲載されて", 8),
        ("募集が終了", 8), ("お探しの物件は見つかりません", 8),
    ],
    "door": [
        ("この物件の掲載は終了", 10), ("掲載期間が終了", 10), ("掲載終了", 6), ("この物件は現在掲載されて", 8),
        ("募集が終了", 8), ("現在募集していません", 8),
    ],
    "ietty": [("この物件の掲載は終了", 10), ("掲載終了", 6), ("募集が終了", 8)],
    "airdoor": [
        ("この物件の掲載は終了", 10), ("掲載終了", 6), ("募集が終了", 8), ("現在募集していません", 8),
        ("この物件は現在掲載されて", 8),
    ],
}
EXPIRED_ANY = [
    ("掲載期間.*?終了", 8), ("掲載.*?終了.*?物件", 6), ("この物件.*?終了", 8),
    ("物件情報.*?掲載.*?終了", 8), ("募集.*?終了", 5), ("公開.*?終了", 5),
]
EXPIRED_THRESHOLD = 8
EXPIRED_REASON = [
    r"(この物件[^。「」\n]{0,30}(?:終了|ません))",
    r"(掲載期間[^。「」\n]{0,30}終了)",
    r"(掲載が終了[^。「」\n]{0,20})",
    r"(物件情報[^。「」\n]{0,30}終了)",
]

# Host part -> service, first match counts.
SERVICE_HOSTS = [
    ("suumo", "suumo"), ("athome", "athome"), ("canary", "canary"), ("カナリー", "canary"),
    ("carsensor", "carsensor"), ("goo-net", "goo-net"), ("eheya", "eheya"), ("sumaity", "sumaity"),
    ("smocca", "smocca"), ("door.ac", "door"), ("ietty", "ietty"), ("airdoor", "airdoor"),
]

# Patterns of a detail-page URL.
DETAIL_URL = {
    "suumo": [r"/chintai/jnc_\d+", r"/ms/jnc_\d+", r"/chukoikkodate/.+/nc_", r"/library/.+/sc_"],
    "athome": [r"/chintai/\d+", r"/mansion/\d+", r"/detail/\d+"],
    "canary": [r"/rooms/[a-zA-Z0-9\-]+", r"/room/[a-zA-Z0-9\-]+", r"/property/[a-zA-Z0-9\-]+"],
    "carsensor": [
        r"/usedcar/detail/[A-Z0-9]+/", r"/usedcar/detail/VU\d+", r"/usedcar/detail/[A-Z]{2}\d+/index\.html",
    ],
    "goo-net": [r"/usedcar/detail/\d+/", r"/usedcar/detail/7\d+", r"/usedcar/spread/goo/\d+/\d+\.html"],
    "eheya": [r"/line/detail/\d+", r"/detail/\d+"],
    "sumaity": [r"_bldg/bldg_\d+", r"/chintai/[a-z]+_bldg/bldg_\d+"],
    "smocca": [r"/bukken/detail/[a-z0-9_]+"],
    "door": [r"/[a-z]+/city-\d+/detail/\d+", r"/detail/\d+"],
    "airdoor": [r"/detail/\d+/\d+"],
}

# Link selectors of a listing page in order: (class of an enclosing element or None,
# class of the link or None, parts the href contains, end of the href or None).
DETAIL_LINKS = {
    "suumo": [
        (None, "cassetteitem_other-linktext", [], None), (None, None, ["/chintai/jnc_"], None),
        (None, None, ["/ms/jnc_"], None), (None, None, ["/chukoikkodate/"], None),
        ("cassetteitem", None, ["/jnc_"], None), ("property_unit", None, ["nc_"], None),
    ],
    "athome": [
        (None, None, ["/chintai/"], None), (None, None, ["/mansion/"], None),
        ("property-list", None, ["/detail/"], None), ("item", None, ["/detail/"], None),
        ("p-property", None, [], None),
    ],
    "canary": [
        (None, None, ["/rooms/"], None), (None, None, ["/room/"], None), (None, None, ["/property/"], None),
        ("room-card", None, [], None), ("property-card", None, [], None),
    ],
    "carsensor": [
        (None, None, ["/usedcar/detail/"], None), ("cassetteitem", None, ["/usedcar/detail/"], None),
        ("car-card", None, ["/detail/"], None), (None, None, ["/usedcar/detail/VU"], None),
        ("list_item", None, ["/detail/"], None), (None, None, ["/usedcar/detail/"], "/index.html"),
        ("mod-cassette", None, ["/usedcar/detail/"], None), ("cassette_list", None, ["/usedcar/detail/"], None),
    ],
    "goo-net": [
        (None, None, ["/usedcar/detail/"], None), (None, None, ["/usedcar/spread/"], None),
        ("car-card", None, ["/detail/"], None), ("list-item", None, ["/detail/"], None),
        (None, None, ["/usedcar/detail/7"], None), ("car_list", None, ["/usedcar/detail/"], None),
        ("search_list", None, ["/usedcar/detail/"], None), (None, None, ["/usedcar/detail/"], "/"),
    ],
    "eheya": [
        (None, None, ["/detail/"], None), (None, None, ["/line/detail/"], None),
        ("property-item", None, [], None), ("room-item", None, ["/detail/"], None),
    ],
    "sumaity": [
        (None, None, ["_bldg/bldg_"], None), (None, None, ["/chintai/", "_bldg/"], None),
        ("property-item", None, [], None),
    ],
    "smocca": [
        (None, None, ["/bukken/detail/"], None), ("property-item", None, ["/bukken/detail/"], None),
        ("room-card", None, ["/bukken/"], None),
    ],
    "door": [
        (None, None, ["/detail/"], None), ("property-list", None, ["/detail/"], None), ("room-card", None, [], None),
    ],
    "airdoor": [
        (None, None, ["/detail/"], None), ("property-card", None, ["/detail/"], None),
        (None, None, ["/detail/", "/"], None),
    ],
}

# Change categories in order of preference: (pattern, weight).
CATEGORY_RULES = {
    "CRO": [
        (r"button|btn|cta", 3), (r"form|input|submit|textarea|select", 4), (r"modal|dialog|popup|overlay", 3),
        (r"conversion|cv|contact|inquiry", 4), (r"step|wizard|progress", 3), (r"tab|accordion|toggle", 2),
        (r"carousel|slider|swiper", 2), (r"favorite|bookmark|save|clip", 3), (r"compare|hikaku", 3),
        (r"review|rating|star", 2), (r"breadcrumb|pagination", 1), (r"filter|sort|search-result", 2),
    ],
    "AD_PRODUCT": [
        (r"ad[-_]|ads[-_]|advert|sponsor", 5), (r"banner|promotion|promo", 4), (r"recommend|pickup|featured", 3),
        (r"campaign|sale|discount", 3), (r"partner|affiliate", 4), (r"premium|highlight|boost", 3),
        (r"slot|placement|inventory", 3),
    ],
    "SEO": [
        (r"schema|structured[-_]?data|json[-_]?ld", 5), (r"meta|og:|twitter:", 4),
        (r"canonical|alternate|hreflang", 5), (r"heading|<h[1-6]", 3), (r"internal[-_]?link|breadcrumb", 3),
        (r"sitemap|robots", 4), (r"aria[-_]|role=|alt=", 2), (r"nav|navigation|menu", 2),
    ],
    "AI": [
        (r"ai[-_]|chatbot|chat[-_]?bot", 5), (r"recommend|suggestion|similar", 3),
        (r"personali[sz]|machine[-_]?learn", 4), (r"auto[-_]?complete|predict", 3), (r"smart|intelligent", 2),
        (r"gpt|llm|generative", 5),
    ],
}
CATEGORY_THRESHOLD = 5
REPEAT_CAP = 3
NO_PATTERN_REASON = "明確なパターンが検出されませんでした"
PATTERN_REASON = "検出パターン: "

PRIORITY_OF_CATEGORY = {"CRO": "high", "AD_PRODUCT": "medium", "SEO": "medium", "AI": "high", "OTHER": "low"}
ADVICE_PLACEHOLDER = "MCP経由でKiroに分析を依頼してください"
PLACEHOLDER_MARK = "MCP経由"
NO_SUMMARY = "変更を検知しました"
