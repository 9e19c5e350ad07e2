"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read as a sequence of leaf blocks, each with the open tags above it. Features are
ancestor tags, words of their class and id, and plain facts about the text. The field has two
labels, article and rest; it is trained in numpy on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_batches, text_steps

# Fixed values of HTML: elements without content, without visible text, and within a line;
# and those that a start tag of a block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript iframe object svg canvas select textarea button datalist audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"},
    **dict.fromkeys(("thead", "tbody", "tfoot"), {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}),
    **dict.fromkeys(("col", "colgroup"), {"caption"}),
}
# What a start tag ends wherever it is open; what may stand in a head; elements whose content
# is text up to their end tag; hidden ones out of which a start tag closes nothing.
ENDS = {"button": "button", "select": "select", "input": "select", "textarea": "select", "body": "head"}
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BARRIERS = HIDDEN - {"head"}
SCOPES = frozenset("ul ol dl table tr body html article section div main aside nav header footer form blockquote figure details".split())
NOT_IN_P = frozenset(
    "p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption "
    "address details fieldset hr".split()
)

# Elements that say nothing about their content, and those that name an area of the page.
PLAIN = frozenset("html body div section".split())
AREAS = frozenset("article main nav header footer aside form".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Characters of scripts that set no space between words, about two to a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text of a leaf block and its ancestors from the outside in, with words of their names."""

    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: float


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; blocks without text are left out."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    links = linked = 0
    at = 0
    dark: int | None = None  # place of the outermost hidden element in the stack
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            outer = [s for s in stack[:dark] if s[0] not in INLINE]
            blocks.append(Block(text, tuple(t for t, _ in outer), tuple(n for _, ns in outer for n in ns), linked / len(text)))
        linked = 0

    def close(index: int) -> None:
        nonlocal links, dark
        seen = stack[index:dark]
        if any(t not in INLINE for t, _ in seen):
            flush()
        links -= sum(t == "a" for t, _ in seen)
        del stack[index:]
        if dark is not None and index <= dark:
            dark = None

    def innermost(tag: str, floor: int = 0) -> int | None:
        return next((i for i in range(len(stack) - 1, floor - 1, -1) if stack[i][0] == tag), None)

    def say(raw: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and raw.strip(" \t\n\f\r"):
            close(len(stack) - 1)
        if raw and dark is None:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    while at < len(page):
        found = _MARKUP.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            index = innermost(tag)
            if index is not None:
                close(index)
            elif tag not in INLINE and dark is None:
                flush()
            continue
        floor = 0
        if dark is not None:
            floor = next((i + 1 for i in range(len(stack) - 1, dark - 1, -1) if stack[i][0] in BARRIERS), 0)
            if found[3].endswith("/") and any(t == "svg" for t, _ in stack[dark:]):
                continue
        ended = "head" if tag not in IN_HEAD and stack and stack[-1][0] in ("head", "noscript") else ENDS.get(tag)
        index = innermost(ended) if ended else None
        if index is not None:
            close(index)
        if tag in NOT_IN_P:
            index = innermost("p", floor)
            if index is not None:
                close(index)
        closes = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, floor - 1, -1) if closes else ():
            if stack[i][0] in closes:
                close(i)
            elif stack[i][0] in SCOPES:
                break
        names: tuple[str, ...] = ()
        hidden = tag in HIDDEN
        if found[3]:
            words = []
            for name, value in _ATTRIBUTE.findall(found[3]):
                name = name.lower()
                if name == "hidden":
                    hidden = True
                elif name in ("class", "id", "role", "itemprop"):
                    words += [w.lower() for w in _NAME_PARTS.findall(value)]
            names = tuple(words)
        if tag in VOID:
            if dark is None and not hidden:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
            continue
        if hidden and found[3].endswith("/") and tag in ("svg", "canvas"):
            continue
        if dark is None and tag not in INLINE and not (hidden and tag == "button"):
            flush()
        if tag in RAW and tag not in unended:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end or tag not in ("noscript", "iframe"):
                at = end.end() if end else len(page)
                continue
            unended.add(tag)
        if hidden and dark is None:
            dark = len(stack)
        if tag == "a" and dark is None:
            links += 1
        stack.append((tag, names))
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        if not b.text.isascii():
            words += len(_UNSPACED.findall(b.text)) // 2
        stop = b.text[-1] in ".!?:;”\"。…！？」"
        prose = stop and b.linked < 0.5
        area = next((t for t in reversed(b.tags) if t in AREAS), "")
        own = {f"tag={b.tags[-1]}" if b.tags else "tag="}
        own.update(f"in={t}" for t in b.tags if t not in PLAIN)
        own.update(f"name={n}" for n in b.names)
        own.add("words=" + ("1" if words < 2 else "2-4" if words < 5 else "5-9" if words < 10 else "10-24" if words < 25 else "25"))
        own.add("linked=" + ("no" if b.linked < 0.05 else "some" if b.linked < 0.5 else "most"))
        own.add(f"stop={stop}")
        own.add(f"area={area}")
        own.add(f"area={area} prose={prose}")
        own.add(f"mark={b.text[0] in '©®'}")
        own.add(f"main={any(t in ('article', 'main') for t in b.tags)}")
        own.add(f"list={b.tags[-1] if b.tags else ''} linked={b.linked > 0.5}")
        out.append(sorted(own))
    return out


class ChainField:
    """Weights of a two-label chain: by feature and label, by label pair, and for the start."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names), 2))
        self.pairs = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """Label scores of each block; unknown features count nothing."""
        known = [[self.names[f] for f in row if f in self.names] for row in rows]
        return np.array([self.weights[k].sum(axis=0) for k in known]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the most likely labels."""
        if not rows:
            return []
        scores = self.scores(rows).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = int(b + p10 > a + p00), int(b + p11 > a + p01)
            a, b = (b + p10 if from0 else a + p00) + s0, (b + p11 if from1 else a + p01) + s1
            back.append((from0, from1))
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def gradient(self, known: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed: by block and label, and by label pair (forward-backward)."""
        n = len(known)
        scores = np.array([self.weights[k].sum(axis=0) for k in known])
        scores[0] += self.start
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for t in range(1, n):
            forward[t] = scores[t] + np.logaddexp(forward[t - 1, 0] + self.pairs[0], forward[t - 1, 1] + self.pairs[1])
        for t in range(n - 2, -1, -1):
            ahead = scores[t + 1] + backward[t + 1]
            backward[t] = np.logaddexp(self.pairs[:, 0] + ahead[0], self.pairs[:, 1] + ahead[1])
        total = np.logaddexp(*forward[-1])
        single = np.exp(forward + backward - total)
        double = np.zeros((2, 2))
        for t in range(1, n):
            double += np.exp(forward[t - 1][:, None] + self.pairs + (scores[t] + backward[t])[None, :] - total)
            double[labels[t - 1], labels[t]] -= 1
        single[np.arange(n), labels] -= 1
        return single, double


def train(pages: list[tuple[str, list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4) -> ChainField:
    """A field from pages and the labels of their leaf blocks, by stochastic gradient ascent."""
    rows = [(features(leaf_blocks(page)), labels) for page, labels in pages]
    names = {f: i for i, f in enumerate(sorted({f for r, _ in rows for block in r for f in block}))}
    field = ChainField(names)
    data = [([np.array([names[f] for f in block]) for block in r], labels) for r, labels in rows if labels]
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(data)):
            known, labels = data[i]
            single, double = field.gradient(known, labels)
            for k, g in zip(known, single):
                field.weights[k] -= step * g
            field.start -= step * single[0]
            field.pairs -= step * (double + decay * field.pairs)
            field.weights *= 1 - step * decay
    return field


# ---- Labelled pages -------------------------------------------------------------------


#: Names that made-up pages give to the element of their article; others there are made of syllables.
ARTICLE_NAMES = ["content", "entry", "post", "story", "article-body", "main-content", "post entry", "text"]


def labelled_pages(count: int = 300, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with a label for each leaf block: 1 article, 0 the rest.

    Words are made of syllables, so that nothing but structure and form can be learnt. The
    layouts vary which elements, classes and orders mark the article and everything around it.
    """
    rng = random.Random(seed)
    return [_page(rng) for _ in range(count)]


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = ["ka", "lo", "ren", "ti", "su", "mi", "ver", "dan", "o", "pel", "qui", "as", "no", "fe"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize()


def _prose(rng: random.Random) -> str:
    text = ". ".join(_words(rng, rng.choice([1, 3, 3]), 18) for _ in range(rng.choice([1, 1, 2, 3, 5]))) + "."
    return text if rng.random() < 0.8 else text.replace(" ", f' <a href="/x">{_words(rng, 1, 2)}</a> ', 1)


def _wrappers(rng: random.Random, most: int = 2) -> tuple[str, str]:
    """Start and end tags of up to ``most`` elements that say nothing about their content."""
    tags = [rng.choice(["div", "div", "section"]) for _ in range(rng.randint(0, most))]
    said = [rng.choice(["", f' class="{rng.choice(["wrapper", "container", "inner", "row", "col", "page", _words(rng, 1, 1)])}"']) for _ in tags]
    return "".join(f"<{t}{n}>" for t, n in zip(tags, said)), "".join(f"</{t}>" for t in reversed(tags))


def _unspaced(page: str) -> str:
    """The page with its visible words in a script without spaces."""

    def write(text: re.Match) -> str:
        words = re.sub(r"(?<![&A-Za-z])[A-Za-z]+", lambda w: "".join(chr(0x3042 + sum(map(ord, w[0][i : i + 2])) % 78) for i in range(0, len(w[0]), 2)), text[0])
        return words.replace(". ", "。").replace(".", "。").replace(" ", "")

    return re.sub(r"(?<=>)[^<]+(?=<)", write, page)


def _page(rng: random.Random) -> tuple[str, list[int]]:
    out: list[str] = []
    labels: list[int] = []

    def put(markup: str, label: int) -> None:
        out.append(markup)
        labels.append(label)

    def links(tag: str, label: int = 0) -> None:
        for _ in range(rng.randint(2, 7)):
            put(f'<{tag}><a href="/a">{_words(rng, 1, 4)}</a></{tag}>', label)

    def menu() -> None:
        how = rng.randrange(4)
        opening = ["<nav>", '<div class="menu nav">', '<div id="navigation">', '<ul class="site-menu">'][how]
        out.append(opening + ("" if how == 3 else "<ul>"))
        links("li")
        out.append(("" if how == 3 else "</ul>") + ["</nav>", "</div>", "</div>", "</ul>"][how])

    def header() -> None:
        how = rng.randrange(3)
        out.append(["<header>", '<div class="site-header">', '<header class="masthead" role="banner">'][how])
        put(f"<{'div' if how else 'p'}>{_words(rng, 1, 5)}</{'div' if how else 'p'}>", 0)
        if rng.random() < 0.4:
            menu()
        out.append(["</header>", "</div>", "</header>"][how])

    def advert() -> None:
        name = rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo box", "advertisement"])
        tag = rng.choice(["div", "aside", "section"])
        text = _prose(rng) if rng.random() < 0.6 else f"<p>{_prose(rng)}</p>"
        put(f'<{tag} class="{name}">{text}</{tag}>', 0)

    def notice() -> None:
        name = rng.choice(["cookie-notice", "notice", "cookie consent", "alert banner", "gdpr", "newsletter signup", "paywall", "popup modal"])
        put(f'<div class="{name}"><p>{_prose(rng)}</p></div>', 0)

    def sidebar() -> None:
        how = rng.randrange(3)
        out.append(["<aside>", '<div class="sidebar">', '<div id="side-bar" class="widget related">'][how])
        put(f"<h3>{_words(rng, 1, 4)}</h3>", 0)
        out.append("<ul>")
        links("li")
        out.append("</ul>")
        if rng.random() < 0.6:
            put(f"<p>{_prose(rng)}</p>", 0)
        out.append(["</aside>", "</div>", "</div>"][how])

    def form() -> None:
        out.append('<form action="/s">')
        put(f'<p>{_prose(rng) if rng.random() < 0.5 else _words(rng, 1, 4)}</p><input name="q">', 0)
        put(f"<label>{_words(rng, 1, 3)}</label><input><button>{_words(rng, 1, 2)}</button>", 0)
        out.append("</form>")

    def comments() -> None:
        how = rng.randrange(4)
        opening = ['<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="discussion replies">'][how]
        out.append(opening)
        if how != 3:
            put(f"<{'h2' if how else 'h3'}>{_words(rng, 1, 3)}</{'h2' if how else 'h3'}>", 0)
        for _ in range(rng.randint(1, 4)):
            tag = "li" if how == 3 else rng.choice(["div", "article"])
            put(f'<{tag} class="comment"><p>{_prose(rng)}</p></{tag}>', 0)
        out.append(["</section>", "</div>", "</div>", "</ol>"][how])

    def footer() -> None:
        how = rng.randrange(3)
        out.append(["<footer>", '<div class="footer">', '<footer id="site-footer">'][how])
        put(f"{'&copy; ' if rng.random() < 0.6 else ''}{_words(rng, 1, 6)}{rng.choice(['', '. ' + _prose(rng)])}", 0)
        out.append(["</footer>", "</div>", "</footer>"][how])

    def article() -> None:
        tag = rng.choice(["article", "article", "article", "main", "main article", "div", "div", "div", "section", ""]).split()
        name = rng.choice(ARTICLE_NAMES) if rng.random() < 0.7 else _words(rng, 1, 1)
        said = rng.choice(["", f' class="{name}"', f' id="{name}"', ' role="main"' if tag == ["div"] else ""])
        before, after = _wrappers(rng) if tag else ("", "")
        opening = "".join(f"<{t}>" for t in tag[:-1]) + "".join(f"<{t}{said}>" for t in tag[-1:]) + before
        closing = after + "".join(f"</{t}>" for t in reversed(tag))
        out.append(opening)
        if rng.random() < 0.75:
            put(f"<h1>{_words(rng, 2, 12)}</h1>", 1)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])):
            kind = rng.random()
            if kind < 0.62:
                put(f"<p>{_prose(rng)}</p>", 1)
            elif kind < 0.68:
                put(f"<p><b>{_words(rng, 2, 12)}.<br>", 1)
                put(f"<p>{_prose(rng)}</p>", 1)
            elif kind < 0.76:
                put(f"<h{rng.choice('23')}>{_words(rng, 1, 6)}</h2>", 1)
            elif kind < 0.84:
                which = rng.choice(["ul", "ol"])
                out.append(f"<{which}>")
                for _ in range(rng.randint(2, 4)):
                    put(f"<li>{_words(rng, 1, 9)}</li>", 1)
                out.append(f"</{which}>")
            elif kind < 0.87:
                put(f"<blockquote><p>{_prose(rng)}</p></blockquote>", 1)
            elif kind < 0.89:
                out.append("<table>")
                put(f"<tr><td>{_words(rng, 1, 3)}</td>", 1)
                put(f"<td>{_words(rng, 1, 3)}</td></tr>", 1)
                out.append("</table>")
            elif kind < 0.91:
                put(f"<pre>{_words(rng, 2, 9)}</pre>", 1)
            else:
                rng.choice([advert, notice])()
        if rng.random() < 0.15:
            rng.choice([comments, form, sidebar])()
        if tag and tag[-1] == "article" and rng.random() < 0.15:
            put(f"<footer>{rng.choice(['', '<p>'])}{_words(rng, 1, 8)}</footer>", 0)
        out.append(closing)

    around = [header, menu, advert, notice, sidebar, form]
    page = _wrappers(rng) if rng.random() < 0.5 else ("", "")
    out.append(page[0])

    def wrapped(part: Callable[[], None]) -> None:
        before, after = _wrappers(rng, 1)
        out.append(before)
        part()
        out.append(after)

    for part in rng.sample(around, rng.randint(0, 4)):
        wrapped(part)
    wrapped(article)
    for part in rng.sample([comments, sidebar, advert, form, notice], rng.randint(0, 3)):
        wrapped(part)
    if rng.random() < 0.9:
        wrapped(footer)
    out.append(page[1])
    head = f"<head><title>{_words(rng, 2, 6)}</title><style>p{{margin:0}}</style></head>"
    text = f"<!DOCTYPE html><html>{head}<body>{''.join(out)}</body></html>"
    return _unspaced(text) if rng.random() < 0.15 else text, labels


def main_text(page: str | None, field: ChainField) -> str:
    """Texts of the blocks that the field labels as article, joined by one space."""
    blocks = leaf_blocks(page)
    labels = field.decode(features(blocks))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


def extract_pages(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null and empty pages, and pages without an article, have an empty text. Repeated rows and
    repeated or null ids each get their own row. Other columns are not read. An empty table
    gives an empty result.
    """
    model = pages.sparkSession.sparkContext.broadcast(field or train(labelled_pages()))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "html"):
            texts = [main_text(h, model.value) for h in step.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [step.column("page_id"), step.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
