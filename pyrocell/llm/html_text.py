"""Main text of web pages by composite text density.

A forgiving pass over the markup builds a tree. Each node counts the characters C and tags T below it, and the
characters LC and tags LT inside links. Its link-adjusted density is
    C / T * log(C * T / (LC' * LT')) / log(log(C * LC / (C - LC)' + share of the body's link characters * C + e))
with primes for "at least 1". A node's density sum adds its children's densities. Elements that are no content
(below) count nowhere. The node of the largest density sum is found; on the path from it to the body the least
density is the threshold. Every node at or above the threshold gives the node of the largest density sum of its
subtree to the content: the largest sum of the page itself, and, if an article is cut into several containers, the
others that are as dense. A page's h1 is added if none is among them.

No content. By tag: scripts, menus, footers, sidebars, controls. By name, a class or id: its words are what - and _ part, and
the last one that says more than "list" or "box" says what the element is, so banner-ad is an advert, related-posts are
related and share-price is a price. Adverts, comments, notices and the like go, forms, and headers outside an article
or main element; what is named as a discussion, a widget or an author's note goes where it is outside the article, as
inside one it is a section. A named wrapper stays if it holds the article (a main or h1; an article element, but for
comments) or all of the page's text. Further article elements whose heading isn't a link belong to the content with the
first. Where no article or main element says what belongs, lists of links before and after the prose go, but for those
under a heading of their own.

Output: blocks in page order joined by two newlines, white space inside a block one space, trimmed. Null or
empty html: empty text; an empty table gives no rows. Ties in the density sum: the first node in page order. Very long
and very deep pages are read whole, without recursion. Repeated pages are handled row by row; extra columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style noscript template head title iframe object svg canvas select textarea button nav footer aside menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = frozenset("li p dt dd option tr td th".split())
# Words for what is no content, for comments, for headers, for what is content inside an article alone.
AWAY = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertising alert alerts breadcrumb breadcrumbs consent cookie cookies footer gdpr menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promos promoted recirc related share sharing sidebar sidebars skyscraper social sponsor sponsored sponsors subscribe toolbar".split())
COMMENTS = frozenset("comment commentlist comments disqus respond".split())
HEADER = frozenset("banner header masthead topbar".split())
BESIDE = frozenset("author bio discussion popular recommendations recommended replies reply responses trending widget widgets".split())
#: Words that say where or how, not what; and first words that tell a state of what they are set on.
VAGUE = frozenset("area article articles bar block body box button buttons card cards col column container content feed form group holder icons inline inner item items left link links list main mobile module panel placement posts right row section signup slot small sticky stories text this top bottom unit view wrap wrapper zone".split())
STATE = frozenset("has hide is no not on show with without".split())
WORDS = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])|(?<=[a-zA-Z])(?=\d)")
AWAY_ROLE = frozenset("navigation complementary contentinfo search dialog alert form menu".split())
#: Why an element may be no content.
PLAIN, NEVER, HEAD, REPLIES, NAMED, OUTSIDE = range(6)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
SPACE = re.compile(r"\s+")


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("chars", "density", "holds", "in_article", "inside", "items", "kind", "links", "link_tags", "parent", "sums", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, kind: int = PLAIN):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.items: list[Node | str] = []
        self.holds: set[str] = set()
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.sums = 0.0

    def nodes(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def parse(page: str) -> Node:
    """A tree of any markup; unclosed elements end with their parent, stray end tags are skipped."""
    root = node = Node("body", None)
    at, end = 0, len(page)
    open_: dict[str, int] = {}
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            node.items.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if open_.get(tag):
                while True:
                    gone, node = node, node.parent
                    open_[gone.tag] -= 1
                    if gone.tag == tag:
                        break
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            node.items.append(Node(tag, node))
            continue
        shut = "p" if tag in CLOSES_P else tag
        if (tag in CLOSES_P or tag in CLOSES_SAME) and open_.get(shut):
            n = node
            while n.tag in INLINE and n.parent:
                n = n.parent
            if n.tag == shut:
                while True:
                    gone, node = node, node.parent
                    open_[gone.tag] -= 1
                    if gone is n:
                        break
        child = Node(tag, node, _kind(tag, m[3]))
        node.items.append(child)
        if m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        open_[tag] = open_.get(tag, 0) + 1
        node = child
    return root


def _kind(tag: str, attributes: str) -> int:
    if tag in DROP:
        return NEVER
    kind = HEAD if tag == "header" else NAMED if tag == "form" else PLAIN
    for k, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        k, v = k.lower(), "".join(values)
        if k == "hidden" or k == "aria-hidden" and v == "true":
            return NEVER
        if k == "role":
            kind = NAMED if v in AWAY_ROLE else HEAD if v == "banner" else kind
        elif k in ("class", "id"):
            for name in v.split():
                kind = _named(name) or kind
    return kind


def _named(name: str) -> int:
    """What a class or id says an element is."""
    words = [w.lower() for w in WORDS.split(name) if w]
    if not words or words[0] in STATE:
        return PLAIN
    while len(words) > 1 and (words[-1] in VAGUE or words[-1].isdigit() or len(words[-1]) == 1):
        words.pop()
    word = words[-1]
    return REPLIES if word in COMMENTS else HEAD if word in HEADER else NAMED if word in AWAY else OUTSIDE if word in BESIDE else PLAIN


def _order(root: Node) -> list[Node]:
    """The content's nodes, parents before children; no recursion, so depth is no limit."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.kind == PLAIN:
            out.append(n)
            todo += reversed(n.nodes())
    return out


def _settle(root: Node) -> None:
    """Makes wrappers of the article plain again."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.kind != NEVER:
            nodes.append(n)
            todo += reversed(n.nodes())
    for n in reversed(nodes):
        n.chars = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        for x in n.nodes():
            if x.kind != NEVER:
                n.chars += x.chars
                n.holds |= x.holds | ({x.tag} & {"main", "h1", "article"})
    for n in nodes:
        wanted = {"main", "article"} if n.kind == HEAD else {"main", "h1"} if n.kind == REPLIES else {"main", "h1", "article"}
        within = n.in_article if "article" in root.holds else n.inside
        if n.kind != PLAIN and (n.chars == root.chars or n.holds & wanted or n.kind == HEAD and n.inside or n.kind == OUTSIDE and within):
            n.kind = PLAIN


def measure(root: Node) -> list[Node]:
    _settle(root)
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = 0
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(SPACE.sub(" ", x).strip())
            elif x.kind == PLAIN:
                n.chars, n.tags, n.links, n.link_tags = n.chars + x.chars, n.tags + x.tags + 1, n.links + x.links, n.link_tags + x.link_tags
        if n.tag == "a":
            n.links, n.link_tags = n.chars, n.tags + 1
    share = root.links / root.chars if root.chars else 0.0
    for n in reversed(nodes):
        if n.chars:
            t, plain = max(1, n.tags), max(1, n.chars - n.links)
            base = math.log(n.chars * n.links / plain + share * n.chars + math.e)
            ratio = n.chars * t / (max(1, n.links) * max(1, n.link_tags))
            n.density = n.chars / t * math.log(max(ratio, 1.0 + 1e-9)) / math.log(base + math.e - 1)
        n.sums = sum(x.density for x in n.nodes() if x.kind == PLAIN)
    return nodes


def _whole(n: Node) -> Node:
    """A paragraph or an inline piece is part of a block of text: the content is what holds its neighbours."""
    while n.parent is not None and (n.tag in INLINE or n.tag in ("p", "ul", "ol", "li", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")):
        n = n.parent
    return n


def content(root: Node) -> list[Node]:
    """The chosen subtrees, none inside another, in page order."""
    nodes = [n for n in measure(root) if n.chars]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: n.sums)
    threshold, n = best.density, best
    while n is not None:
        threshold = min(threshold, n.density)
        n = n.parent
    # of each subtree the node of the largest density sum; children come after their parents
    top: dict[Node, Node] = {}
    for n in reversed(nodes):
        top[n] = max([n, *(top[x] for x in n.nodes() if x in top)], key=lambda x: x.sums)
    chosen = {_whole(best)} | {top[n] for n in nodes if n.density >= threshold}
    found, inside = [], set()
    for n in nodes:
        if n.parent in inside or n in chosen:
            inside.add(n)
            if n.parent not in inside:
                found.append(n)
    more = set()
    if not any(n.tag == "h1" for n in inside):
        more = {n for n in nodes if n.tag == "h1" and n not in inside}
    if any(n.tag == "article" or n.in_article for n in found):
        holders = {n for f in found for n in _above(f)}
        more |= {n for n in nodes if n.tag == "article" and not n.in_article and n not in inside and n not in holders and 2 * n.links <= n.chars and not _teaser(n)}
    if more:
        wanted, found, inside = more | set(found), [], set()
        for n in nodes:
            if n.parent in inside or n in wanted:
                inside.add(n)
                if n.parent not in inside:
                    found.append(n)
    return found


def _above(n: Node) -> list[Node]:
    out = []
    while n.parent is not None:
        n = n.parent
        out.append(n)
    return out


def _teaser(article: Node) -> bool:
    """Whether the article's first heading is all link: it stands for a page of its own."""
    todo = [article]
    while todo:
        n = todo.pop()
        if n.tag in HEADINGS and n.chars:
            return n.links == n.chars or n.parent is not None and n.parent.tag == "a"
        todo += reversed([x for x in n.nodes() if x.kind == PLAIN])
    return False


def blocks(node: Node) -> list[str]:
    out: list[tuple[str, bool, bool]] = []  # text, mostly links, heading
    line: list[str] = []

    def flush(links: bool, heading: bool) -> None:
        if text := SPACE.sub(" ", "".join(line)).strip():
            out.append((text, links, heading))
        line.clear()

    todo: list = [(node, False, node.tag in HEADINGS)]
    while todo:
        x, links, heading = todo.pop()
        if x is None:
            flush(links, heading)
        elif isinstance(x, str):
            line.append(x)
        elif x.kind != PLAIN:
            flush(links, heading)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            todo += [(y, links, heading) for y in reversed(x.items)]
        else:
            flush(links, heading)
            within = links or x is not node and 2 * x.links > x.chars and x.tag in ("div", "ul", "ol", "section", "table", "dl")
            todo.append((None, within, x.tag in HEADINGS))
            todo += [(y, within, x.tag in HEADINGS) for y in reversed(x.items)]
    flush(False, False)
    if not node.inside and node.tag not in ("article", "main") and not node.holds & {"article", "main"}:
        prose = [i for i, (_, links, _) in enumerate(out) if not links]
        last = prose[-1] + 1 if prose else 0
        if prose and out[last - 1][2]:  # a heading at the end: what it stands over is listed under it
            last = next((i for i in range(last, len(out)) if not out[i][1]), len(out))
        out = out[prose[0] : last] if prose else []
    return [text for text, _, _ in out]


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(text for n in content(parse(page)) for text in blocks(n))


def text_column(page: Column) -> Column:
    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in pages], pa.string())

    return of(page)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_column(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
