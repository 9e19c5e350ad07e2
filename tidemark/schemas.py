"""Explicit schemas of the stored tables; nothing is inferred when reading."""

SERVICE = (
    "id string, name string, display_name string, base_url string, category string, is_active boolean, "
    "created_at timestamp, deleted_at timestamp"
)
MONITORED_PAGE = (
    "id string, service_id string, url string, page_type string, device string, is_active boolean, "
    "last_scanned_at timestamp, last_status int, created_at timestamp, deleted_at timestamp"
)
CAPTURE = "capture_id string, page_id string, url string, device string, http_status int, captured_at timestamp, html string"
SNAPSHOT = (
    "capture_id string, page_id string, dom_hash string, norm_text string, norm_length int, norm_version string, "
    "captured_at timestamp"
)
CHANGE = (
    "id string, page_id string, service_name string, page_type string, category string, summary string, "
    "diff_text string, structure_before_id string, structure_after_id string, detected_at timestamp, is_reviewed boolean"
)
ADVICE = (
    "id string, change_id string, summary string, intent string, proposal string, priority string, "
    "expected_effect string, risks string, created_at timestamp"
)
SETTING = "key string, value string"
PRESS_SOURCE = "id string, name string, url string, is_active boolean, created_at timestamp, deleted_at timestamp"
PRESS_ARTICLE = (
    "id string, source_id string, title string, article_url string, published_at timestamp, body_text string, "
    "classification string, relevance_category string, summary string, needs_manual_review boolean, "
    "scraped_at timestamp, created_at timestamp, deleted_at timestamp"
)
PRESS_INSIGHT = (
    "id string, article_id string, insight_type string, title string, description string, applicability string, "
    "priority string, status string, tags array<string>, source_competitor string, created_at timestamp"
)
COMPONENT = (
    "struct<position:int,type:string,tag_name:string,child_count:int,is_sticky:boolean,attributes:map<string,string>>"
)
SECTION = (
    "struct<position:int,id:string,type:string,tag_name:string,class_name:string,is_sticky:boolean,"
    f"components:array<{COMPONENT}>>"
)
CV_POINT = (
    "struct<type:string,element:string,label:string,text:string,position:string,is_sticky:boolean,"
    "class_name:string,micro_copy:string,social_proof:string>"
)
FORM = (
    "struct<id:string,action:string,method:string,total_fields:int,required_fields:int,field_types:map<string,int>,"
    "steps:int,has_progress_bar:boolean,validation_type:string,estimated_minutes:int>"
)
PAGE_STRUCTURE = (
    "id string, site_role string, page_id string, captured_at timestamp, "
    "summary struct<section_count:int,component_count:int,form_section_count:int,cta_count:int,has_sticky:boolean>, "
    f"sections array<{SECTION}>, cv_points array<{CV_POINT}>, forms array<{FORM}>, hash string"
)
OWN_PAGE = (
    "id string, name string, page_type string, url string, device string, category string, is_active boolean, "
    "created_at timestamp, deleted_at timestamp"
)
TABLES = {
    "service": SERVICE, "monitored_page": MONITORED_PAGE, "capture": CAPTURE, "snapshot": SNAPSHOT, "change": CHANGE,
    "advice": ADVICE, "setting": SETTING, "press_source": PRESS_SOURCE, "press_article": PRESS_ARTICLE,
    "press_insight": PRESS_INSIGHT, "page_structure": PAGE_STRUCTURE, "own_page": OWN_PAGE,
}
