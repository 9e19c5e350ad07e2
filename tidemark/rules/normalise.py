"""Fixed values of the page normaliser."""

from tidemark.functions.text import wide

# Elements removed before comparison, as (tag, class, id, attribute); None = any.
EXCLUDED = [
    (None, None, None, "data-property-price"),
    (None, None, None, "data-property-address"),
    (None, "property-price", None, None),
    (None, "property-name", None, None),
    (None, "property-address", None, None),
    (None, "bukken-price", None, None),
    (None, "bukken-name", None, None),
    (None, "cassetteitem_price", None, None),
    (None, "cassetteitem_detail-col3", None, None),
    (None, "price", None, None),
    (None, "detail-price", None, None),
    (None, "ad-banner", None, None),
    (None, "ranking-position", None, None),
    ("time", None, None, None),
    (None, None, None, "datetime"),
    (None, "cookie-consent", None, None),
    (None, "modal-overlay", None, None),
    (None, None, "cookie-banner", None),
]

ASSET_HASH = r"""(?i)(/(?:_next|static|assets|webpack|chunks)/[^"']*?)[a-f0-9]{8,}([^"']*)"""
BUILD_ID = r"/_next/data/[a-zA-Z0-9_-]+/"
CACHE_BUSTER = r"""[?&](?:v|ver|version|hash|t|ts|cb|_)=[^&"']+"""

# Numbers with a counter in meta contents.
COUNTED_NUMBER = wide(r"[\d,]+(?:\.\d+)?\s*(?:件|棟|戸|台|室|区画|物件|軒|人|万|円|m²|㎡)")

RECOMMEND_SECTION = r"(?i)recommend|おすすめ|関連|人気|ランキング|新着|pickup|similar|related|suggest"

# Elements whose text is kept, with everything inside them.
KEPT_TEXT_TAGS = [
    "button", "a", "h1", "h2", "h3", "h4", "h5", "h6",
    "label", "legend", "th", "caption", "summary", "nav",
]
KEPT_TEXT_ROLES = ["button", "tab", "menuitem", "link", "heading", "navigation"]
KEPT_TEXT_CLASS = [
    "btn", "button", "cta", "submit", "action",
    "tab", "nav", "menu", "breadcrumb",
    "badge", "tag", "chip", "alert", "toast",
]

# Kept text that names one listing is masked all the same.
LISTING_NOISE = [wide(p) for p in (
    r"\d{1,4}万円",
    r"\d+\.\d+万円",
    r"\d+円",
    r"築\d+年",
    r"\d+階建",
    r"\d+[LDK]+",
    r"\d+\.\d+m²",
    r"\d+㎡",
    r"20\d{2}/\d{1,2}/\d{1,2}",
    r"20\d{2}年\d{1,2}月",
)]

# Attributes dropped by prefix; inline handlers (on...) are dropped too.
DYNAMIC_ATTRIBUTES = [
    "data-tracking-id", "data-session", "data-csrf", "data-nonce",
    "data-request-id", "data-impression-id", "data-ab-test", "data-gtm-vis-",
]
TRACKING_SOURCE = ["pixel", "beacon", "1x1", "tracking", "impression"]
PRELOAD_RELATION = ["preconnect", "prefetch", "preload", "dns-prefetch"]

NORM_VERSION = "v2"
