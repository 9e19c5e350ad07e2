"""Fixed values of section, component, form and conversion extraction."""

from tidemark.functions.text import wide

SECTION_TAGS = ["header", "footer", "nav", "main", "aside", "section", "article", "form"]
SECTION_CLASS = (
    r"(?i)hero|banner|sidebar|content|wrapper|container|panel|block|module|widget|modal|drawer|overlay"
    r"|toolbar|bottom-bar|fixed-(?:top|bottom)|sticky"
)
SECTION_ROLES = {
    "banner": "header", "navigation": "nav", "main": "main", "contentinfo": "footer", "complementary": "aside",
}
CAROUSEL_CLASS = r"(?i)carousel|slider|swiper|gallery|lightbox|slide-show"
LINK_CLASS = r"(?i)btn|button|cta|action|submit|inquiry|contact|apply|register|signup"
LINK_TEXT = r"問い合わせ|お問合せ|資料請求|見学|内見|申し込|申込|予約|相談"
STICKY_COMPONENT_CLASS = r"(?i)sticky|fixed|float|pin"
PROOF_COMPONENT_CLASS = r"(?i)review.count|view.count|favorite.count|popular|rating|star|score"
URGENCY_COMPONENT_TEXT = wide(r"残り\d|あと\d|期間限定|本日限り|急いで|お早めに|人気|即入居|すぐ")
COMPONENT_LIMIT = None  # no limit

INPUT_TYPES = {
    "text": "input_text", "email": "input_text", "tel": "input_tel", "number": "input_number",
    "password": "input_password", "date": "input_date", "datetime-local": "input_date",
    "checkbox": "checkbox", "radio": "radio",
}

# Forms.
SKIPPED_INPUTS = ["hidden", "submit", "button", "reset", "image"]
LOOSE_SKIPPED_INPUTS = ["hidden", "submit", "button", "reset"]
REALTIME_VALIDATION = r"(?i)validate|error.*message|invalid|has-error|is-invalid|field-error|validation"
VALIDATION_ATTRIBUTES = ["pattern", "minlength", "maxlength", "min", "max", "required"]
STEP_CLASS = r"(?i)step|progress|wizard|phase|stage|ステップ|STEP"
PROGRESS_CLASS = r"(?i)progress|stepper|wizard-bar|indicator"
PROGRESS_BEFORE_CLASS = r"(?i)progress|stepper|step-indicator"
REQUIRED_WORDS = ["必須", "※"]
REQUIRED_MARKS = ["*", "※", "必須"]
SUBMIT_LABEL = "送信"
SUBMIT_LINK_CLASS = r"(?i)btn|button|cta|submit"
FORM_MICRO_COPY = wide(
    r"無料|しつこい.*ません|営業.*ません|安心|簡単|かんたん|\d+分で完了|\d+秒で|すぐに届|今すぐ|無理な勧誘"
    r"|個人情報.*保護|SSL|暗号化|セキュア"
)
FORM_PROOF = wide(r"本日\d+人|今日\d+人|\d+人が(問い合わせ|申し込|利用|閲覧)|満足度\d+|★\d|評価\d|\d+件のレビュー")
FIELD_SECONDS = {
    "input_text": 8, "input_tel": 6, "input_number": 5, "input_password": 6, "input_date": 5, "textarea": 20,
    "select": 4, "checkbox": 2, "radio": 3,
}
OTHER_FIELD_SECONDS = 5

# Conversion elements.
CTA_CLASS = (
    r"(?i)btn-primary|btn-main|cta-primary|cta-main|button-primary|btn-secondary|btn-sub|cta-secondary"
    r"|btn-line|line-btn|line-button|btn-tel|tel-btn|phone-btn"
)
CTA_TEXT = (
    r"問い合わせ|お問合せ|資料請求|見学予約|内見予約|内覧予約|申し込[みむ]|申込|予約する|相談する|無料相談"
    r"|今すぐ|LINEで|電話で|メールで|お気に入り|保存する|比較する"
)
PROOF_CLASS = r"(?i)review|rating|star|score|count|popular|favorite|bookmark"
PROOF_TEXT = wide(
    r"(\d+)人が(閲覧|問い合わせ|お気に入り|検討|保存)|閲覧数\s*(\d+)|お気に入り\s*(\d+)|レビュー\s*(\d+)|★\s*[\d.]+"
    r"|満足度\s*[\d.]+|評価\s*[\d.]+|本日(\d+)人|今日(\d+)人"
)
URGENCY_TEXT = wide(
    r"残り\s*(\d+)|あと\s*(\d+)|期間限定|本日限り|今だけ|お早めに|急募|即入居|すぐ入居|即日|人気物件|注目|おすすめ"
    r"|(\d+)日以内|本日中"
)
MICRO_COPY_TEXT = wide(
    r"無料で|しつこい.*ません|営業.*ません|安心.*ください|ご安心|簡単|かんたん|\d+分で完了|\d+秒で完了|すぐ終わ"
    r"|個人情報.*保護|プライバシー|SSL|無理な勧誘.*ません|迷惑.*ません|いつでもキャンセル|気軽に"
)
STICKY_STYLE = r"(?i)position\s*:\s*(fixed|sticky)"
STICKY_CLASS = r"(?i)fixed|sticky|float|pin|dock"
CV_LIMIT = None  # no limit
