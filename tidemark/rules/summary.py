"""Fixed values of the change summary."""

# UI keyword -> label, in order of preference.
UI_KEYWORDS = {
    "button": "ボタン", "btn": "ボタン", "form": "フォーム", "input": "入力欄", "nav": "ナビゲーション",
    "header": "ヘッダー", "footer": "フッター", "modal": "モーダル", "dialog": "ダイアログ", "card": "カード",
    "tab": "タブ", "carousel": "カルーセル", "slider": "スライダー", "banner": "バナー", "sidebar": "サイドバー",
    "menu": "メニュー", "search": "検索", "filter": "フィルター", "sort": "ソート", "pagination": "ページネーション",
    "breadcrumb": "パンくずリスト", "accordion": "アコーディオン", "tooltip": "ツールチップ",
    "dropdown": "ドロップダウン", "table": "テーブル", "list": "リスト", "image": "画像", "img": "画像",
    "video": "動画", "icon": "アイコン", "badge": "バッジ", "tag": "タグ", "label": "ラベル", "link": "リンク",
    "section": "セクション", "article": "記事", "aside": "サイドコンテンツ", "ad": "広告", "ads": "広告",
    "sponsor": "スポンサー", "recommend": "おすすめ", "favorite": "お気に入り", "review": "レビュー",
    "rating": "評価", "map": "地図", "photo": "写真", "gallery": "ギャラリー",
}

GENERIC_NAMES = [
    "hidden", "block", "flex", "grid", "w-full", "container", "wrapper", "inner", "outer", "content", "main",
    "body", "row", "col", "item", "list", "top", "bottom", "left", "right", "center", "active", "disabled",
    "true", "false", "on", "off", "open", "close", "show", "hide",
]

TEXT_TAG_LABELS = {
    "button": "ボタン", "a": "リンク", "h1": "大見出し(H1)", "h2": "見出し(H2)", "h3": "見出し(H3)",
    "h4": "見出し(H4)", "h5": "見出し(H5)", "h6": "見出し(H6)", "label": "ラベル", "th": "テーブルヘッダー",
    "summary": "サマリー", "legend": "フォーム凡例",
}
TEXT_IN_TAG = r"(?is)<(button|a|h[1-6]|label|th|summary|legend)[^>]*>(.*?)</\1>"
SNIPPET_IN_TAG = r"(?is)<(button|a|h[1-6]|legend)[^>]*>(.*?)</\1>"
MASKS = ["[TEXT]", "[PROPERTY_TEXT]"]

STRUCTURE_RULES = [
    (r"<form\b", "フォーム"),
    (r"<nav\b", "ナビゲーション"),
    (r"<section\b", "セクション"),
    (r"<aside\b", "サイドバー"),
    (r"<dialog\b|<div[^>]*modal", "モーダル/ダイアログ"),
    (r"<details\b", "アコーディオン"),
    (r'class="[^"]*carousel|class="[^"]*slider|class="[^"]*swiper', "カルーセル/スライダー"),
    (r'class="[^"]*\btab\b', "タブ"),
    (r'class="[^"]*search', "検索UI"),
    (r'class="[^"]*filter', "フィルターUI"),
    (r'class="[^"]*banner', "バナー"),
    (r'class="[^"]*cta|class="[^"]*cv[-_]', "CVエリア"),
    (r'class="[^"]*recommend|class="[^"]*pickup', "おすすめ/ピックアップ"),
    (r'class="[^"]*review|class="[^"]*rating', "レビュー/評価"),
]
SNIPPET_LINES = 20
INPUT_HINT = r'(?i)<input[^>]*(?:placeholder|aria-label)="([^"]+)"'
FIELD_TAG = r"(?i)<(?:input|select|textarea)\b[^>]*>"
FIELD_NAME = r'(?i)(?:placeholder|aria-label|name|id)="([^"]+)"'
SHOWN_ITEMS = 8
