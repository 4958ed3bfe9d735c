"""Main text of web pages: the best-scoring run of words and tags, with learned weights."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# Fixed values of HTML.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre"
    " section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Never part of an article if they are closed; forms may also be around a whole page.
APART = set("aside button datalist dialog footer iframe menu nav object select".split())
FORMS = {"form", "fieldset"}
# Words of a class, id or role that say the same of any other element.
APART_NAMES = set(
    "ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments"
    " complementary consent contentinfo cookie cookies disqus footer gdpr menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promoted promotion recommended related respond"
    " search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADERS = {"header", "masthead"}
# Words that may stand beside those in one name without a meaning of their own.
BESIDE = set(
    "area article articles bar block body bottom box buttons center container content div entry form"
    " global group inner item items left links list main middle outer page panel post posts primary right"
    " row secondary section site slot story thread top unit user wrap wrapper zone".split()
)
# Names of an article, and words that turn one of the above into a remark on the layout.
CONTENT = set("article content entry post story".split())
LAYOUT = set("has have no non not with without".split())
# What can hold a whole article.
CONTAINERS = set("article center div main section td".split())
ARTICLES = {"article", "main"}
# A new one of these ends an open one.
SIBLINGS = {name: {name} for name in ("li", "option")} | {
    name: group for group in ({"dt", "dd"}, {"td", "th"}) for name in group
}
# Elements whose end may be left out, and how far back an implied end is looked for.
ENDLESS = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
INLINE_DEPTH = 32

# Elements whose content is no markup.
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "canvas", "math")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_QUOTED = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_PLAIN = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>", re.I)
_OPENING = re.compile(r"</?[a-z]|<[!?/]", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
_HEADING = re.compile("h[1-6]$")


@dataclass(frozen=True)
class HtmlParams:
    """Labelled pages that weights are learned from at most, and the weights if there are none.

    `prior` tags a word are added on both sides of a comparison, whatever the sample's size.
    """

    labelled_pages: int = 4000
    prior: float = 0.02
    word: float = 1.0
    link_word: float = 0.1
    tag: float = -1.0


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts, and opening and closing tags with what is in them; in time linear in the page.

    A tag ends at the first `>` outside of quotes. Once the quotes of a tag do not end, they count no
    more in the rest of the page; what follows the last `>` is text.
    """
    last = page.rfind(">")
    quotes = True
    endless: set[str] = set()
    at = look = 0
    while (m := _OPENING.search(page, look)) and m.start() <= last:
        start = m.start()
        if start > at:
            yield "", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = look = len(page) if end < 0 else end + 3
            continue
        tag = None
        if page[start + 1] not in "!?":
            tag = _QUOTED.match(page, start) if quotes else None
            if tag is None:
                tag = _PLAIN.match(page, start)
                quotes = quotes and tag is None
        if tag is None:
            at = look = page.find(">", start) + 1
            continue
        at = look = tag.end()
        name = tag[2].lower()
        if name in _RAW_END and not tag[1]:
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end:
                at = look = end.end()
                continue
            endless.add(name)
            if name in ("script", "style"):
                at = look = len(page)
            continue
        yield tag[1] or "<", name, tag[3]
    comment = page.find("<!--", at)
    rest = page[at:] if comment < 0 else page[at:comment]
    if rest:
        yield "", rest, ""


def _mark(name: str, inside: str, in_article: bool) -> str:
    """`strong` if the element's name or all of a class word says that it is no part of an article,
    `weak` if a class word says so beside others, or if it is a form; else nothing.
    """
    if name in ("html", "body", *ARTICLES):
        return ""
    if name in APART or (name in HEADERS and not in_article):
        return "strong"
    weak = content = False
    for found in _NAMES.findall(inside) if "=" in inside else ():
        for word in "".join(found).split():
            parts = {x.lower() for x in _PARTS.findall(word)}
            if parts & LAYOUT:
                continue
            if parts & APART_NAMES or (parts & HEADERS and not in_article and not parts & CONTENT):
                if not parts - APART_NAMES - HEADERS - BESIDE:
                    return "strong"
                weak = True
            elif parts & CONTENT:
                content = True
    return "weak" if name in FORMS or (weak and not content) else ""


@dataclass
class Element:
    """An element with its range of events; `apart` tells that it is no part of an article."""

    name: str
    mark: str
    first: int
    end: int = -1
    closed: bool = False
    apart: bool = False


@dataclass
class Page:
    """Events of a page in order: (kind, text or tag name, whether in an article), and its elements.

    Kind is `word`, `link word`, `tag` or `break`. Elements are in the order of their start and have
    their range of events.
    """

    events: list[tuple[str, str, bool]]
    elements: list[Element]


def parse(page: str) -> Page:
    """The events and elements of a page. Ends that are left out are implied as browsers do."""
    events: list[tuple[str, str, bool]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    open_ = Counter()
    articles = 0

    def end(closed: bool) -> str:
        nonlocal articles
        element = stack.pop()
        element.end, element.closed = len(events), closed
        open_[element.name] -= 1
        articles -= element.name in ARTICLES
        return element.name

    def imply(names: set[str]) -> None:
        """End an element of these names if only inline ones are open in it."""
        for depth in range(1, min(len(stack), INLINE_DEPTH) + 1):
            name = stack[-depth].name
            if name in names:
                for _ in range(depth):
                    end(True)
                return
            if name in BLOCKS and name != "p":
                return

    for kind, what, inside in _tokens(page):
        if not kind:
            events.append(("link word" if open_["a"] else "word", what, articles > 0))
        elif what in VOID and what in BLOCKS:
            events.append(("break", what, articles > 0))
        elif what in VOID:
            events.append(("word", "" if what == "wbr" else " ", articles > 0))
        elif kind == "<":
            if what in BLOCKS and open_["p"]:
                imply({"p"})
            if what in SIBLINGS:
                imply(SIBLINGS[what])
            element = Element(what, _mark(what, inside, articles > 0), len(events))
            events.append(("tag", what, articles > 0 or what in ARTICLES))
            elements.append(element)
            if inside.endswith("/") and what not in BLOCKS:
                element.end, element.closed = len(events), True
            else:
                stack.append(element)
                open_[what] += 1
                articles += what in ARTICLES
            if what in BLOCKS:
                events.append(("break", what, articles > 0))
        else:
            if open_[what]:
                while stack[-1].name != what:
                    end(stack[-1].name in ENDLESS)
                events.append(("tag", what, articles > 0))
                end(True)
            if what in BLOCKS:
                events.append(("break", what, articles > 0))
    while stack:
        end(stack[-1].name in ENDLESS)
    tree = Page(events, elements)
    _set_apart(tree)
    return tree


def _set_apart(page: Page) -> None:
    """Tell which elements are no part of an article.

    Those marked so are, but for one that holds at least half of the page's words while next to no
    prose stands outside of all of them: then the mark speaks of the layout, or its end was left out,
    and what is within is judged by itself.
    """
    words = [0]
    skip = heading_end = outside = 0
    starts: dict[int, list[Element]] = {}
    for element in page.elements:
        starts.setdefault(element.first, []).append(element)
    for i, (kind, what, _) in enumerate(page.events):
        for element in starts.get(i, ()):
            if element.mark:
                skip = max(skip, element.end)
            if _HEADING.match(element.name):
                heading_end = max(heading_end, element.end)
        n = len(what.split()) if kind == "word" else 0
        words.append(words[-1] + n)
        if i >= skip and i >= heading_end:
            outside += n
    total = words[-1]
    skip = 0
    for element in page.elements:
        if element.mark and element.first >= skip:
            size = words[element.end] - words[element.first]
            strong = element.mark == "strong" and element.closed
            if 2 * size >= total and size and outside < (10 if strong else max(10, size // 10)):
                # Something short that a name speaks against stays out.
                if size >= 60 or not strong:
                    continue
            element.apart = True
            skip = element.end


def _shown(page: Page) -> list[int]:
    """The numbers of the events that stand in no element that is apart."""
    skips = [e for e in page.elements if e.apart]
    shown, at, skip = [], 0, 0
    for i in range(len(page.events)):
        while at < len(skips) and skips[at].first <= i:
            skip = max(skip, skips[at].end)
            at += 1
        if i >= skip:
            shown.append(i)
    return shown


def _gram(kind: str, what: str) -> str:
    if kind != "tag":
        return kind
    return what if what in BLOCKS or what == "a" else "inline"


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often words and tags stand within and outside the articles of pages that mark one."""
    counts: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            page = value.as_py() or ""
            if "<article" not in page and "<main" not in page:
                continue
            tree = parse(page)
            shown = set(_shown(tree))
            for i, (kind, what, content) in enumerate(tree.events):
                if kind != "break":
                    n = len(what.split()) if kind != "tag" else 1
                    counts[_gram(kind, what), content and i in shown] += n
    keys = [k for k in counts if counts[k]]
    yield pa.record_batch(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        ["what", "content", "n"],
    )


def learn(pages: DataFrame, params: HtmlParams = HtmlParams(), id_col: str = "page_id") -> dict:
    """Weights from pages that mark their article, on a sample by id of bounded expected size.

    A weight is the log of how many tags (or link words) a word there are in articles, by that
    elsewhere. Words count for and tags against, so the sign is kept even where the sample has it
    otherwise. A tag that no article of the sample has may be in the next, so none counts more than a
    word. Without labelled pages there are defaults.
    """
    total = pages.count()
    every = max(1, -(-total // params.labelled_pages))
    sample = pages.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select("html")
    rows = (
        sample.mapInArrow(_label_counts, "what string, content boolean, n long")
        .groupBy("what", "content")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    default = {"word": params.word, "link word": params.link_word, "inline": params.tag}
    weights = default | {name: params.tag for name in (*BLOCKS, "a")}
    n = {(r["what"], r["content"]): r["n"] for r in rows}
    within, outside = (
        sum(v for (w, c), v in n.items() if c == side and w.endswith("word")) for side in (True, False)
    )
    if within and outside:
        for what in weights:
            a, b = n.get((what, True), 0), n.get((what, False), 0)
            if a + b:
                odds = np.log(a / within + params.prior) - np.log(b / outside + params.prior)
                sign = 1 if what.endswith("word") else -1
                weights[what] = float(sign * max(0.05, sign * odds))
        most = weights["word"]
        for what in weights:
            weights[what] = min(max(weights[what], -most), most)
    return weights


def best_run(values: list[float]) -> tuple[int, int]:
    """The first run of numbers with the largest sum, as a range; an empty one if none is above 0."""
    best, total, begin = (0.0, 0, 0), 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += value
        if total > best[0]:
            best = (total, begin, i + 1)
    return best[1:]


def _container(tree: Page, counts: list[int], first: int, end: int) -> Element | None:
    """The innermost article with half of the words, else the innermost container that holds all of them.

    `counts` has the words before each event.
    """
    total = counts[end] - counts[first]
    article = around = None
    for e in tree.elements:
        if e.apart or e.name not in CONTAINERS:
            continue
        if e.name in ARTICLES:
            n = counts[min(end, e.end)] - counts[max(first, e.first)] if e.first < end and e.end > first else 0
            better = article is None or e.name == "article" or article.name == "main"
            if 2 * n >= total and better:
                article = e
        if e.first <= first and e.end >= end:
            around = e
    return article or around


def main_text(page: str | None, weights: dict) -> str:
    """The blocks of the run of words and tags with the largest sum of weights, and of its container.

    Of equal runs the first. A block is kept whole if any of its words is in the run.
    If half of the run's words are in one article, that whole article is the text; else the rest of
    the container that holds the whole run comes with it.
    """
    tree = parse(page or "")
    shown = _shown(tree)
    seen = set(shown)
    values, counts, blocks, block = [], [0], {}, 0
    for i, (kind, what, _) in enumerate(tree.events):
        n = len(what.split()) if "word" in kind and i in seen else 0
        counts.append(counts[-1] + n)
        block += kind == "break" or (i not in seen and i - 1 in seen)
        blocks[i] = block
    for i in shown:
        kind, what, _ = tree.events[i]
        if kind == "break":
            values.append(0.0)
        elif kind == "tag":
            values.append(weights[_gram(kind, what)])
        else:
            values.append((counts[i + 1] - counts[i]) * weights[kind])
    begin, stop = best_run(values)
    # The run from its first to its last word.
    run = [i for i in shown[begin:stop] if counts[i + 1] > counts[i]]
    if not run:
        return ""
    first, last = run[0], run[-1]
    box = _container(tree, counts, first, last + 1)
    alone = box is not None and box.name in ARTICLES
    out: list[list[str]] = []
    before = None
    for i in shown:
        kind, what, _ = tree.events[i]
        if "word" not in kind:
            continue
        inside = box is not None and box.first <= i < box.end
        if inside or (not alone and blocks[first] <= blocks[i] <= blocks[last]):
            if blocks[i] != before:
                out.append([])
                before = blocks[i]
            out[-1].append(html.unescape(what))
    joined = (" ".join("".join(parts).split()) for parts in out)
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame, weights: dict) -> DataFrame:
    """One row per page: `page_id`, `url`, `text` (its main text) and `n_chars`.

    Blocks are joined by an empty line, white space within them is one space, and character
    references are decoded. Null and empty pages, and pages without words outside of menus and the
    like, have an empty text. Pages may repeat and ids and urls be null; other columns are not read;
    no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.record_batch([*columns, sizes], ["page_id", "url", "text", "n_chars"])

    frame = pages.select("page_id", "url", "html")
    return frame.mapInArrow(run, "page_id long, url string, text string, n_chars long")
