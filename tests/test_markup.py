"""Tokens, elements, normaliser, structure, forms and conversion elements."""

import html
import random

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.html import token_array
from tidemark.functions.text import decode_entities
from tidemark.operators import conversion, forms, structure
from tidemark.operators.normalise import normalise
from tidemark.operators.tokens import element_nodes, inside, spanned_tokens, token_table


def pages(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "capture_id long, html string")


def test_tokens_are_lossless(spark):
    random.seed(3)
    bits = ["<p>", "</p>", "<a href='x>y'>", "text ", "<", ">", "<!-- c -->", "<!DOCTYPE html>", "<script>a<b</script>", '"', "'", "<br/>", "é"]
    texts = ["".join(random.choice(bits) for _ in range(40)) for _ in range(200)]
    rows = pages(spark, *texts).select("html", F.array_join(token_array(F.col("html")), "").alias("joined"))
    assert rows.filter("html <> joined").count() == 0


def test_tree_of_well_formed_markup(spark):
    """Depth, parent and text equal those of a stack machine on random nested markup."""
    random.seed(11)

    def tree(depth):
        if depth == 0 or random.random() < 0.2:
            return random.choice(["x ", " y", "z", "<br>"])
        tag = random.choice(["div", "span", "section", "ul", "b"])
        inner = "".join(tree(depth - 1) for _ in range(random.randint(1, 3)))
        return f"<ul><li>{inner}</li></ul>" if tag == "ul" else f"<{tag}>{inner}</{tag}>"

    texts = ["<div>" + "".join(tree(5) for _ in range(3)) + "</div>" for _ in range(30)]
    want = set()
    for page, text in enumerate(texts):
        import re

        stack, seen = [], {}
        for i, token in enumerate(re.findall(r"<[^>]*>|[^<]+", text)):
            if token.startswith("</"):
                stack.pop()
            elif token == "<br>":
                want.add((page, i, len(stack) + 1, stack[-1] if stack else None))
            elif token.startswith("<"):
                want.add((page, i, len(stack) + 1, stack[-1] if stack else None))
                stack.append(i)
                seen[i] = ""
            else:
                for s in stack:
                    seen[s] += token.strip()
        want |= {("text", page, i, t) for i, t in seen.items()}
    nodes = element_nodes(pages(spark, *texts), levels=1).filter("kind <> 'text'")
    got = set()
    for r in nodes.select("capture_id", "idx", "depth", F.col("up_1.idx").alias("p"), "kind", "text").collect():
        got.add((r.capture_id, r.idx, r.depth, r.p))
        if r.kind == "open":
            got.add(("text", r.capture_id, r.idx, r.text))
    assert got == want


def test_unclosed_elements(spark):
    html = "<div><p>one <b>two<p>three<ul><li>a<ul><li>n</ul><li>b</ul></div></p><i>last"
    rows = spanned_tokens(token_table(pages(spark, html))).filter("kind = 'open'").collect()
    ends = {(r.idx, r.tag): r.end_idx for r in rows}
    assert ends[(1, "p")] == 5 and ends[(3, "b")] == 5 and ends[(5, "p")] == 7
    assert ends[(8, "li")] == 14 and ends[(11, "li")] == 13 and ends[(14, "li")] == 16
    assert ends[(19, "i")] == 21


def test_counts_inside(spark):
    html = "<table><tr><th>a<td>b<tr><td>c</table><table><tr><td>d"
    nodes = element_nodes(pages(spark, html), levels=1, counted=("tr", "td", "th"))
    rows = nodes.filter("tag = 'table'").select("idx", inside("tr").alias("tr"), inside("td").alias("td")).orderBy("idx").collect()
    assert [(r.tr, r.td) for r in rows] == [(2, 2), (1, 1)]


def test_normaliser_masks_and_is_stable(spark):
    html = (
        '<nav><a href="/p?v=12">Menu</a></nav><a href="/x">3LDK</a><p>free</p><div class="price"><b>1</b></div>'
        '<div class="tag-x">kept</div><span role="tab">kept too</span><input type="hidden" value="s"><img src="data:xx">'
        '<p onclick="a()" data-csrf="t" id="i">z</p><script>var a="<p>"</script><!-- note --><time>now</time>'
    )
    row = normalise(pages(spark, html)).first()
    assert row.norm_lines == [
        "<nav>", '<a href="/p">Menu</a>', "</nav>", '<a href="/x">[PROPERTY_TEXT]</a>', "<p>[TEXT]</p>",
        '<div class="tag-x">kept</div>', '<span role="tab">kept too</span>', '<input type="hidden" value="[HIDDEN_VALUE]">',
        '<img src="[DATA_URI]">', '<p id="i">[TEXT]</p>', "[TEXT]",
    ]
    again = normalise(pages(spark, row.norm_text.replace("\n", ""))).first()
    assert again.dom_hash == row.dom_hash


def test_resolve_urls(spark):
    from urllib.parse import urljoin

    base = "https://a.example.com/x/y/z.html?q=1#f"
    hrefs = ["b", "/b", "../b", "./b?x=1", "../../../b", "//h.example.com/p", "?k=2", "#top", "", "https://o.example.com/", "mailto:a@b", "a/../b", ".."]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", urls.resolve(F.col("h"), F.lit(base)).alias("u"))
    for r in rows.collect():
        assert r.u == urljoin(base, r.h) or (r.h == "" and r.u == base), r.h


def test_sections_and_components(spark):
    html = (
        '<body><header class="x"><a class="btn" href="/go?x=1">Go</a><a href="tel:1">Call</a></header><div></div>'
        '<div class="hero"><img src=a><span>残り3室</span></div><div><section>s</section></div><details open><summary>S</summary></details>'
        '<section><div class="swiper"><img><img><div class="swiper-slide"></div></div><table><tr><th>a<th>b<tr><td>1</table>'
        '<table role="presentation"></table><details><summary>More</summary></details><video></video><img width=1 height=1>'
        '<button>Go</button><a href="/q">見学予約</a><div class="float-bar">f</div><b class="star">5</b></section></body>'
    )
    sections = structure.page_sections(structure.structure_nodes(pages(spark, html)))
    rows = sections.orderBy("section_no").collect()
    assert [(r.type, [c.type for c in r.components]) for r in rows] == [
        ("header", ["cta_link", "cta_tel"]), ("hero", ["image_single", "urgency"]), ("div", []),
        ("section", ["image_carousel", "table", "accordion", "video", "button_action", "cta_link", "sticky_element", "social_proof"]),
    ]
    parts = {c.type: c for c in rows[3].components}
    assert parts["image_carousel"].child_count == 2
    assert parts["table"].attributes == {"rowCount": "2", "colCount": "2"}
    assert parts["accordion"].attributes == {"summary": "More", "open": "false"}
    assert rows[0].components[0].attributes["href"] == "/go"
    total = structure.structure_summary(sections).first()
    assert (total.section_count, total.component_count, total.cta_count, total.has_sticky) == (4, 12, 3, True)


FORM = (
    '<body><div class="step-area"><div class="stepper">x</div><form action="/a" method=post><ul class="step-list"><li>1<li>2<li>3</ul>'
    '<label for=q>Name</label><input id=q name=nm required placeholder=pp><label>Tel <input type=tel></label>'
    '<p>住所<span>必須</span><input type=number></p><select name=s><option>1<option selected>2</select><textarea name=t pattern=x></textarea>'
    '<button type=submit class="btn-lg" style="background: red; x">OK</button><input type=hidden><p>無料で簡単</p></form><p>安心です</p>'
    "<span>5人が閲覧</span></div></body>"
)


def test_form_facts(spark):
    nodes = forms.form_nodes(pages(spark, FORM, "<p>no form</p>"))
    row = forms.form_table(nodes).first()
    assert (row.action, row.method, row.total_fields, row.required_fields, row.steps) == ("/a", "POST", 5, 4, 3)
    assert row.has_progress_bar and row.validation_type == "onsubmit"
    assert tuple(row.submit) == ("OK", "btn-lg", "large", "red", "form_bottom")
    assert row.micro_copy == ["無料で簡単", "安心です"] and row.social_proof == ["5人が閲覧"]
    fields = forms.field_table(nodes).orderBy("position").collect()
    assert [(f.type, f.label) for f in fields] == [
        ("input_text", "Name"), ("input_tel", "Tel"), ("input_number", "必須"), ("textarea", "住所必須"), ("select", "住所必須"),
    ]
    assert fields[4].option_count == 1 and fields[4].default_option == "2" and fields[4].has_validation is False


def test_conversion_elements(spark):
    html = (
        '<body><div class="fixed-bottom"><a href="https://line.me/x">LINE</a><small>ご安心ください</small></div><footer><a href="tel:1">電話</a></footer>'
        '<a class="btn-primary">今すぐ</a><a class="btn-sub">今すぐ</a><button>予約する</button><button>plain</button>'
        "<p>残り3<span>残り3</span></p><p>あと5日</p><p>残り3<span>残り3</span></p>"
        '<form><input type=submit></form><div class="rating">4.5</div><span>3人が検討</span></body>'
    )
    points = conversion.cv_points(conversion.conversion_nodes(pages(spark, html)))
    rows = points.collect()
    ctas = {r.label: (r.type, r.position, r.is_sticky) for r in rows if r.label}
    assert ctas == {
        "送信": ("primary_cta", "in_form", False), "予約する": ("secondary_cta", "body", False), "LINE": ("line_cta", "fixed_bottom", True),
        "電話": ("tel_cta", "footer", False), "今すぐ": ("primary_cta", "body", False),
    }
    assert next(r.micro_copy for r in rows if r.label == "LINE") == "ご安心ください"
    assert [r.text for r in sorted(rows, key=lambda r: r.idx) if r.type == "urgency"] == ["残り3残り3", "あと5日"]
    assert {r.text for r in rows if r.type == "social_proof"} == {"4.5", "3人が検討"}


def test_texts_behind_display_lengths(spark):
    long = "x" * 60
    html = (
        f'<body><main><a class="btn-sub" href="/a">{long}1</a><a class="btn-sub" href="/b">{long}2</a><a href="/c">{long}見学予約</a>'
        f'<a class="btn-sub" href="/{"p" * 250}">Far</a><p class="star">{long}{long}1</p><details open><summary>{long}1</summary></details></main></body>'
    )
    other = [html.replace(f"{long}1</{tag}", f"{long}9</{tag}") for tag in ("a", "p", "summary")] + [html.replace("p" * 250, "p" * 249 + "q")]
    source = pages(spark, html, *other)
    docs = structure.page_structures(structure.page_sections(structure.structure_nodes(source))).collect()
    assert len({d.hash for d in docs}) == len(docs) == 5
    points = conversion.cv_points(conversion.conversion_nodes(pages(spark, html.replace("見学予約", "今すぐ予約"))))
    ctas = {r.label: r.display_label for r in points.collect() if r.label}
    assert ctas == {f"{long}1": "x" * 50, f"{long}2": "x" * 50, f"{long}今すぐ予約": "x" * 50, "Far": "Far"}
    assert conversion.cv_summary(points).first().total_cta_count == 4
    components = docs[0].sections[0].components
    assert [c.attributes["href"] for c in components if c.type == "cta_link"] == ["/a", "/b", "/c", "/" + "p" * 250]


def test_form_texts_without_limits(spark):
    said = [f"無料で簡単 {i} " + "x" * 30 * i for i in range(8)]
    proofs = [f"{i}人が閲覧 " + "y" * 30 * i for i in range(1, 7)]
    html = (
        "<body><section><form><input name=a>" + "".join(f"<p>{t.strip()}</p>" for t in said) + "</form><p>安心です " + "z" * 150 + "</p>"
        + "".join(f"<span>{t}</span>" for t in proofs) + "</section></body>"
    )
    nodes = forms.form_nodes(pages(spark, html))
    row = forms.form_table(nodes).first()
    assert row.micro_copy == [*[t.strip() for t in said], "安心です " + "z" * 150] and row.social_proof == proofs
    row = forms.form_table(nodes, max_copies=2, max_proofs=1, max_length=100).first()
    assert row.micro_copy == [t.strip() for t in said[:2]] and row.social_proof == proofs[:1]


def test_character_references(spark):
    texts = [
        "a&#12354;b&#x1F600; &amp;#65; &#38;lt; &lt;x&gt; &unknown; & &#; &#xZZ; &#0; &#xD800; &#1114112; &#99999999999;",
        "&#39;&quot;&nbsp;|", "plain", "&amp;lt;", "&#x000041;", "", "&#x000000000041;",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.d for r in frame.select("t", decode_entities(F.col("t")).alias("d")).collect()}
    assert got[texts[-1]] == "\ufffd" and all(got[t] == html.unescape(t) for t in texts[:-1])


def test_long_labels_stay_whole(spark):
    label, press = "Your name " * 30, "Send this now " * 20
    page = f'<body><form><label for="n">{label}</label><input id="n" name="n"><button type="submit">{press}</button></form></body>'
    frame = spark.createDataFrame([(1, page)], "capture_id long, html string")
    nodes = forms.form_nodes(frame)
    assert [r.label for r in forms.field_table(nodes).collect()] == [label.strip()]
    assert [r.submit.label for r in forms.form_table(nodes).collect()] == [press.strip()]
