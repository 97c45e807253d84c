"""Main text of web pages by composite text density.

Every DOM node has a density: characters per tag, adjusted by how much of it
is links. The node whose children's densities sum highest is the centre of the
content, and the least density on its path to the body is the threshold. What
is beside that path belongs to the text only with the threshold and a share of
the highest sum; what is within the centre leaves it where links make most of
it, or where it is a container below the threshold.

Tags, roles and class names are a prior only: text below an element that they
call boilerplate counts as link text, unless the element has most of the
page's text. Scripts, styles, form controls and hidden
elements hold no text at all.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
#: Never text.
_DROPPED = _RAW | {"head", "button", "select", "option", "canvas", "object", "embed", "audio", "video", "map", "datalist", "math", "input"}
#: Boilerplate by tag.
_BAD_TAG = {"nav", "footer", "aside", "menu", "dialog", "fieldset", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"tr"}, "body": {"head"},
}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "main", "body", "div", "html", "td", "th", "blockquote", "aside", "nav", "form"}
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_BAD_NAME = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidebars sidenav widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs "
    "masthead footer comment comments commentlist disqus pagination pager copyright searchbox hidden paywall".split()
)
#: Names that content may have too; they do not count on an element with most of the page's text.
_WEAK_NAME = set("notice notices reply replies register foot discussion responses respond related recommended recommendations share sharing social toolbar legal disclaimer search topbar skip alert tracking rail".split())
_SITE_HEAD = {"header", "head", "top", "hdr"}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CONTENT = {"article", "main"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks of running text: within the content they stay however short they are, unless they are lists of links.
_TEXT_BLOCK = _HEADING | set("p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address section article main details summary hgroup header".split())
#: Share of the highest sum that a neighbour of the content needs.
NEIGHBOUR_SHARE = 0.3
#: Share of the page's own text from which on article and main elements are believed.
MARKED_SHARE = 0.1
#: Share of the page's text from which on an element's names do not count against it.
MOST_OF_PAGE = 0.8
_PLAIN, _GONE, _BAD, _WEAK, _NAMED = range(5)


def _prior(tag: str, attrs: str, inside: bool) -> int:
    """What tag, role and names say of an element; ``inside``: an article or main element is open, its own header is content."""
    if tag in _DROPPED:
        return _GONE
    found = _BAD if tag in _BAD_TAG or tag == "header" and not inside else _WEAK if tag == "form" else _PLAIN
    if not attrs.strip():
        return found
    a = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return _GONE
    if found == _BAD or a.get("role", "").lower() in _BAD_ROLE:
        return _BAD
    if tag in ("html", "body", *_CONTENT):
        return _PLAIN
    names = {x.lower() for k in ("class", "id") for x in _NAME.findall(a.get(k, ""))}
    if names & _BAD_NAME:
        return _NAMED
    return _WEAK if found == _WEAK or names & _WEAK_NAME or not inside and names & _SITE_HEAD else _PLAIN


class _Page:
    """Nodes in page order, as parallel lists; texts belong to the innermost open node."""

    def __init__(self, source: str):
        self.tag, self.parent, self.prior, self.end = ["#root"], [-1], [_PLAIN], [0]
        self.texts: list[tuple[int, str]] = []  # (node, text); (node, "\n") where a block begins or ends
        stack, at, blocks, inside, pos = [0], {}, [0], 0, 0  # at: places in the stack by tag; blocks: block elements up to a place

        def shut(place: int) -> None:
            nonlocal inside
            for x in stack[place:]:
                inside -= self.tag[x] in _CONTENT
                self.end[x] = len(self.tag)
                at[self.tag[x]].pop()
            del stack[place:], blocks[place:]

        last = source.rfind(">")
        for m in iter(lambda: _TAG.search(source, pos) if pos <= last or source.find("<!", pos) >= 0 else None, None):
            if m.start() > pos:
                self.texts.append((stack[-1], source[pos : m.start()]))
            pos = m.end()
            close, tag, attrs = m[1], m[2], m[3]
            if tag is None:
                if m[4]:
                    self.texts.append((stack[-1], m[4].replace("&", "&amp;")))
                continue
            tag = tag.lower()
            if tag not in _INLINE:
                self.texts.append((stack[-1], "\n"))
            if close:
                place = at[tag][-1] if at.get(tag) else 0
                # An inline end tag does not close blocks that were opened since.
                if place and not (tag in _INLINE and blocks[-1] > blocks[place]):
                    shut(place)
                continue
            if tag not in _INLINE and tag not in _VOID:
                closes = _CLOSED_BY.get(tag, set()) | {"p"}
                scope = max((at[t][-1] for t in _SCOPE - closes if at.get(t)), default=0)
                first = min((at[t][k] for t in closes if at.get(t) and (k := bisect_right(at[t], scope)) < len(at[t])), default=0)
                if first:
                    shut(first)
            if tag == "br" or tag in _VOID and tag not in _INLINE:
                continue
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.prior.append(_prior(tag, attrs, inside > 0))
            self.end.append(0)
            if tag in _VOID or attrs.endswith("/") and tag in ("svg", "path"):
                self.end[node] = node + 1
            elif tag in _RAW:
                stop = _raw_end(tag).search(source, pos)
                pos = (source.find(">", stop.start()) + 1 if stop else 0) or len(source)
                self.end[node] = node + 1
            else:
                at.setdefault(tag, []).append(len(stack))
                stack.append(node)
                blocks.append(blocks[-1] + (tag not in _INLINE and tag != "p"))
                inside += tag in _CONTENT
        if pos < len(source):
            self.texts.append((stack[-1], source[pos:]))
        for x in stack:
            self.end[x] = len(self.tag)

    def text(self, keep: list[bool]) -> str:
        """Texts of the nodes in ``keep``: white space collapsed in each block, blocks joined by a space."""
        blocks, now = [], []
        for node, t in self.texts:
            if t == "\n":
                blocks.append("".join(now))
                now = []
            elif keep[node]:
                now.append(t)
        blocks.append("".join(now))
        return " ".join(y for x in blocks if x and (y := " ".join(html.unescape(x).split())))


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


def composite_density(chars: int, link_chars: int, tags: int, link_tags: int, page_share: float) -> float:
    """Characters per tag times the logarithm of (characters per link character times tags per link tag).

    The logarithm's base grows with the link text of the node and with
    ``page_share``, the page's part of link text, so a long text with few links
    stays high and a list of links falls to nothing. It is at least 2, else
    logarithms of short texts would have no bound.
    """
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_share * chars + math.e)
    adjusted = math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1.0001))
    return max(chars / tags * adjusted / max(math.log(base), math.log(2)), 1e-9)


class _Densities:
    """Characters, link characters, density and sum of the children's densities of every node."""

    def __init__(self, page: _Page):
        n = len(page.tag)
        gone = [p == _GONE for p in page.prior]
        own = [0] * n
        for i in range(1, n):
            gone[i] |= gone[page.parent[i]]
        for node, t in page.texts:
            if t != "\n" and not gone[node]:
                own[node] += len(t.strip())
        plain = own[:]
        for i in range(n - 1, 0, -1):
            plain[page.parent[i]] += plain[i]
        # Text counts as link text below a link and below what the prior calls boilerplate.
        linked = [False] * n
        for i in range(1, n):
            # no name takes most of a page away
            bad = page.prior[i] == _BAD or page.prior[i] == _NAMED and plain[i] < MOST_OF_PAGE * plain[0] or page.prior[i] == _WEAK and 2 * plain[i] < plain[0]
            linked[i] = page.tag[i] == "a" or bad or linked[page.parent[i]]
        chars, links = own, [c if k else 0 for c, k in zip(own, linked)]
        tags, link_tags = [1] * n, [int(t == "a" or k and not linked[max(p, 0)]) for t, k, p in zip(page.tag, linked, page.parent)]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = page.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i]
                link_tags[p] += link_tags[i]
        share = links[0] / max(chars[0], 1)
        self.gone, self.chars, self.links, self.link_tags = gone, chars, links, link_tags
        self.density = [0.0 if gone[i] else composite_density(chars[i], links[i], tags[i], link_tags[i], share) for i in range(n)]
        self.sums = [0.0] * n
        for i in range(1, n):
            self.sums[page.parent[i]] += self.density[i]
        self.sums = [s or d for s, d in zip(self.sums, self.density)]

    def is_links(self, i: int) -> bool:
        """Most of the node's text is link text."""
        return 2 * self.links[i] > self.chars[i]


def content_nodes(page: _Page) -> list[bool]:
    """Which nodes' texts are the main text."""
    d, n = _Densities(page), len(page.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parent[i]].append(i)
    usable = [i for i in range(n) if d.chars[i] > d.links[i] and not d.gone[i]]
    if not usable:
        return [False] * n
    # Where article or main elements hold a fair share of the page's own text, the centre is looked for in them.
    marked = [False] * n
    for i in range(1, n):
        marked[i] = page.tag[i] in _CONTENT or marked[page.parent[i]]
    said = [i for i in usable if marked[i]]
    own_text = sum(d.chars[i] - d.links[i] for i in said if not marked[page.parent[i]])
    best = max(said if own_text >= MARKED_SHARE * (d.chars[0] - d.links[0]) and said else usable, key=lambda i: (d.sums[i], -i))
    while page.parent[best] > 0 and (page.tag[best] in _INLINE or page.tag[best] in _TEXT_BLOCK - {"section", "article", "main"}):
        best = page.parent[best]
    path = [best]
    while page.parent[path[-1]] >= 0 and page.tag[path[-1]] != "body":
        path.append(page.parent[path[-1]])
    threshold = min(d.density[i] for i in path)
    least = NEIGHBOUR_SHARE * d.sums[best]
    # An article or main element around the centre is one text with it.
    whole = next((i for i in reversed(path) if page.tag[i] == "article"), None) or next((i for i in reversed(path) if page.tag[i] == "main"), best)
    keep, within = [False] * n, [False] * n
    for top, below in zip(path, [None, *path]):
        if top == whole:
            keep[top] = within[top] = True
        elif not keep[below or top]:
            continue
        else:
            place = children[top].index(below)
            for k, x in enumerate(children[top]):
                if x == below or d.gone[x] or d.is_links(x) or marked[best] and not marked[x]:
                    continue
                heading = k < place and page.tag[x] in _HEADING
                keep[x] = within[x] = heading or d.density[x] >= threshold and d.sums[x] >= least
            keep[top] = any(keep[x] for x in children[top])
    on_path = set(path[path.index(whole) + 1 :])
    for x in on_path:
        keep[x] = False
    for i in range(n):
        if not within[i]:
            continue
        some = [x for x in children[i] if not d.gone[x]]
        own = [page.tag[x] in _INLINE or d.density[x] >= threshold and not d.is_links(x) for x in some]
        stays = [k for k, ok in enumerate(own) if ok and page.tag[some[k]] not in _INLINE]
        for k, x in enumerate(some):
            tag = page.tag[x]
            if own[k]:
                ok = True
            elif d.is_links(x):
                ok = tag in _HEADING or tag in ("p", "li", "td", "th", "dd", "dt") and d.link_tags[x] < 2 and page.prior[x] == _PLAIN
            else:
                between = stays and stays[0] < k < stays[-1] and tag == page.tag[some[stays[bisect_right(stays, k)]]]
                ok = tag in _TEXT_BLOCK or between or not d.chars[x]
            keep[x] = within[x] = ok
    return keep


def main_text(source: str | None) -> str:
    """The main text of a page. Null, empty and textless pages, and those of links alone, give ''."""
    if not source:
        return ""
    page = _Page(source)
    return page.text(content_nodes(page))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages`` (``page_id, url, html``; other columns are not read).

    Null html counts as empty; a null id or url stays null; repeated rows give repeated results.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    kept = [F.col(c).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    return pages.select(*kept).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
