"""Main-text extraction by line-block distribution.

Markup is stripped by one pass of a tolerant tokeniser: block tags end a line,
text of elements that are never content (scripts, menus, forms, and elements
whose class, id or role names boilerplate) is left out, and lines keep how much
of them is link text and which article elements hold them.  Over the lines,
text lengths are summed in windows of ``WINDOW`` lines; a window sum that rises
above the page's threshold is a surge, one that falls to nothing a dive, and every
line of each stretch between is kept, as are the lines between two stretches that
share a container (a link list within a text) and those from the first to the last line
of text of a container that holds lines of the stretch (a short heading or close).  Stretches end where an outermost
article element does, and one that meets an article element grows to that
element's ends, but not into articles inside it that it does not meet.  Without
any surge the articles as they stand, or all lines but link lists, are kept, so
short pages are not lost.

Inside an article a name is only a doubt: it must be a whole class word (or the id
of no heading or section), and an element with a long line of text is kept all the
same.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm._common import extend, portions

WINDOW = 3
#: Tag names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "xmp", "noembed", "noframes"}
SKIP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "figcaption", "object", "audio", "video", "canvas", "head"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
#: Words of class, id and role that name boilerplate.
BOILER = set(
    "ad ads advert advertisement adverts advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist disqus respond cookie cookies consent gdpr notice "
    "notices alert alerts footer footnotes header masthead menu menubar nav navbar navigation newsletter pager pagination popup modal overlay promo promoted promotion related recommended "
    "share sharing shares social sidebar sidenav sponsor sponsored subscribe subscription tags tagcloud toolbar topbar widget widgets contentinfo complementary search login signup "
    "replies reply discussion disclaimer copyright colophon skip".split()
)
#: Those that an article uses for its own parts.
ARTICLE_PARTS = {"header", "masthead", "banner", "search", "copyright", "widget", "tags", "discussion", "notice", "notices", "alert", "alerts", "footnotes", "disclaimer", "skip"}
#: Elements of an article whose id names their subject.
TITLED = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
#: Letters of a line in an article that no box beside the text reaches.
LONG = 120
#: Prefixes of class words that say how a page is laid out.
LAYOUT = ("no-", "has-", "with-", "without-", "is-")
ARTICLE = {"article", "main"}
#: Block tags that hold paragraphs, headings and lists.
CONTAINER = {"article", "blockquote", "body", "center", "dd", "div", "main", "section", "td"}
#: Container of what lies in no other than the page.
PAGE = -1
ARTICLE_WORDS = {"articlebody", "article-body", "post-content", "entry-content", "article-content", "story-body"}
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?])")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACES = re.compile(r"\s+")


def _kind(tag: str, attrs: str, in_article: bool) -> str:
    """'skip', 'article', 'doubt' or '' for an opening tag."""
    if tag in SKIP and not (in_article and tag == "figcaption"):
        return "skip"
    kind = "article" if tag in ARTICLE else ""
    if attrs:
        for name, a, b, c in _NAMED.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return "skip"
            if name in ("class", "id", "role", "itemprop"):
                words = value.split()
                if any(w in ARTICLE_WORDS for w in words):
                    kind = "article"
                elif in_article and tag not in ARTICLE:
                    if not (name == "id" and tag in TITLED) and (BOILER - ARTICLE_PARTS).intersection(words):
                        kind = kind or "doubt"
                elif tag not in ("html", "body", *ARTICLE):
                    named = {x for w in words if not w.startswith(LAYOUT) for x in (w, *re.split(r"[-_:]+", w))}
                    if BOILER.intersection(named):
                        return "skip"
    return kind


class Marks:
    """Walks the markup of a page; no part is searched twice, however broken."""

    def __init__(self, page: str):
        self.page, self.end, self.gone = page, len(page), set()

    def find(self, what: str, at: int) -> int:
        """Place of a string, or -1; a string not found once is not looked for again."""
        if what in self.gone:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def past(self, what: str, at: int) -> int:
        i = self.find(what, at)
        return self.end if i < 0 else i + len(what)

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag; quotes hide it, unless never closed."""
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return at
            close = self.find(m[0], at)
            at = at if close < 0 else close + 1
        return self.end

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no markup."""
        if tag in self.gone:
            return self.end
        m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.page, at)
        if not m:
            self.gone.add(tag)
        return self.past(">", m.end()) if m else self.end


def page_lines(page: str) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """Lines, (text, letters inside links, number of the container, number of the
    innermost article element, or 0) of each non-empty one but those of doubted
    elements that hold no long line; and of each element number the article
    element around it, where it is an article."""
    lines: list[tuple[str, int, int, int]] = []
    doubts: list[int] = []  # of each line, the outermost doubted element around it, or 0
    around: dict[int, int] = {}
    doubted: list[int] = []
    buffer: list[str] = []
    stack: list[tuple[str, str]] = []
    held: dict[str, int] = {}  # open elements by tag
    blocks: list[int] = []  # places in the stack of block elements and paragraphs
    articles, containers = [0], [PAGE]
    skips = linked = numbered = 0
    at, marks = 0, Marks(page)

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACES.sub(" ", "".join(buffer)).strip()
            if text:
                lines.append((text, linked, containers[-1], articles[-1]))
                doubts.append(doubted[0] if doubted else 0)
            buffer.clear()
        linked = 0

    def pop(n):
        nonlocal skips
        while len(stack) > n:
            tag, kind = stack.pop()
            held[tag] -= 1
            skips -= kind == "skip"
            if kind == "article":
                articles.pop()
            if kind == "doubt":
                doubted.pop()
            if tag in CONTAINER:
                containers.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not skips:
            text = _html.unescape(page[at:stop])
            buffer.append(text)
            if held.get("a"):
                linked += len(text.strip())
        if not m:
            break
        tag = (m[2] or "").lower()
        if not tag:
            at = marks.past("-->", m.end()) if m[3] else marks.past("]]>", m.end()) if m[4] else marks.past(">", m.end())
            continue
        at = marks.tag_end(m.end())
        if m[1]:
            if tag in BLOCK:
                flush()
            if held.get(tag):
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                pop(n)
            continue
        attrs = page[m.end() : at].rstrip(">")
        closed = attrs.endswith("/")
        if tag in RAW:
            at = at if closed else marks.raw_end(tag, at)
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            pop(blocks[-1])  # an open paragraph ends where a block begins
        if tag in VOID or closed:
            continue
        if tag == "header":
            kind = "skip" if len(articles) == 1 else ""
        else:
            kind = _kind(tag, attrs, len(articles) > 1)
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, kind))
        held[tag] = held.get(tag, 0) + 1
        skips += kind == "skip"
        numbered += 1
        if kind == "article":
            around[numbered] = articles[-1]
            articles.append(numbered)
        if kind == "doubt":
            doubted.append(numbered)
        if tag in CONTAINER:
            containers.append(numbered if tag != "body" else PAGE)
    flush()
    sure = {0} | {d for (text, k, *_), d in zip(lines, doubts) if len(text) >= LONG and k * 2 <= len(text)}
    return [x for x, d in zip(lines, doubts) if d in sure], around


def outermost(lines: list, around: dict[int, int]) -> list[int]:
    """Of each line, the outermost article element around it, or 0."""
    top: dict[int, int] = {0: 0}
    for a in sorted(around):  # an element is numbered after those around it
        top[a] = top[around[a]] or a
    return [top[a] for *_, a in lines]


def stretches(lines: list, outer: list[int], weight: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each stretch between a surge and a dive, those that share a
    container made one."""
    threshold = max(40.0, 0.5 * weight.sum() / len(lines) * WINDOW / 2)
    edges = [0, *(i for i in range(1, len(lines)) if outer[i] != outer[i - 1]), len(lines)]
    found: list[tuple[int, int]] = []
    for low, high in zip(edges, edges[1:]):
        sums = np.convolve(weight[low:high], np.ones(WINDOW, int))[WINDOW - 1 :]  # each window from its first line
        start, own = None, []
        for i in range(low, high + 1):
            if start is None and i < high and sums[i - low] > threshold and weight[i]:
                start = i
            elif start is not None and (i == high or (weight[i] == 0 and sums[i - low] < threshold)):
                own.append((start, i))
                start = None
        ends: dict[int, tuple[int, int]] = {}  # first and last line of text of each container
        for i in range(low, high):
            if weight[i]:
                ends[lines[i][2]] = (ends.get(lines[i][2], (i, i))[0], i)

        def grown(a, b):
            homes = {c for _, _, c, _ in lines[a:b]} - {PAGE}
            return min([a, *(ends[c][0] for c in homes if c in ends)]), max([b, *(ends[c][1] + 1 for c in homes if c in ends)])

        last = {c: n for n, (a, b) in enumerate(own) for _, _, c, _ in lines[a:b]}  # the last stretch of each container
        n = 0
        while n < len(own):
            first, reach = n, n
            while n <= reach:
                reach = max(reach, *(last[c] for _, _, c, _ in lines[own[n][0] : own[n][1]]))
                n += 1
            found.append(grown(own[first][0], own[reach][1]))
    return found


def main_text(page: str | None) -> str:
    lines, around = page_lines(page or "")
    if not lines:
        return ""
    # link lists carry no weight in the distribution
    weight = np.array([0 if k * 2 > len(t) else len(t) for t, k, *_ in lines])
    found = stretches(lines, outermost(lines, around), weight)
    if found:
        kept = np.zeros(len(lines), bool)
        for start, end in found:
            kept[start:end] = True
        met = {0}
        for i in np.flatnonzero(kept).tolist():
            a = lines[i][-1]
            while a not in met:
                met.add(a)
                a = around[a]
        keep = [i for i, (*_, a) in enumerate(lines) if kept[i] or (a and a in met)]
    else:
        keep = [i for i, (*_, a) in enumerate(lines) if a] or [i for i, w in enumerate(weight) if w]
    return "\n".join(lines[i][0] for i in keep)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (page_id and url by default) with ``text`` and
    ``n_chars``.  Null and empty pages, and pages without content, give an empty
    text; cut-off markup ends the open element; repeated rows are kept; other
    columns are ignored."""
    carry = carry or ["page_id", "url"]
    schema = pages.select(*carry).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches, "__html"):
            texts = [main_text(t) for t in batch.column("__html").to_pylist()]
            yield extend(batch, "__html", {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(*carry, F.col(html).alias("__html")).mapInArrow(run, schema)
