"""Main text of HTML pages by composite text density.

Every element gets a density: its characters per tag, lowered where its characters lie in links.
The element whose children's densities add up to most holds the article. The least density on the
way from it up to the body is the threshold by which further elements count as content, within article
and main as elsewhere; ``choose`` says what these tags decide beside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanscope.session import share_code

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open element of the key is ended by the start of one of these, up to the nearest container.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
            "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
            "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
CONTAINERS = frozenset("ul ol dl table select body html div section article".split())
#: Elements that never hold article text.
NO_TEXT = frozenset("head script style noscript template nav footer aside iframe svg canvas button select "
                    "textarea audio video input datalist math map".split())
#: Elements that seldom hold article text: judged like hints.
SELDOM = frozenset("form dialog object menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id names that mark what surrounds an article.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar "
                  "navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar aside cookie cookies consent gdpr "
                  "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
                  "share sharing social related recommended recommendations comment comments commentlist respond replies reply "
                  "discussion disqus pagination pager toolbar copyright disclaimer skip hidden".split())
#: Hints that also name parts or wrappers of articles: such elements go only with a low density.
VAGUE = frozenset("alert banner copyright disclaimer discussion hidden menu modal notice notices notification overlay promotion "
                  "related recommended recommendations reply search share sharing skip social sponsor sponsored subscription".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
PAGE_HEADERS = frozenset("header site-header page-header top-header main-header global-header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
                    r"(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?)*+)(?:>|\Z)", re.S)
# a quote opens a value after "=" only; elsewhere it is a letter like any other, as browsers read it
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def path(self) -> Iterator["Node"]:
        node = self
        while node is not None:
            yield node
            node = node.parent


def parse(html: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are mended as browsers do."""
    root = Node("#root", {}, None)
    open_: list[Node] = [root]
    at, n = 0, len(html)

    def close_to(k: int) -> None:
        del open_[k:]

    while at < n:
        lt = html.find("<", at)
        m = _TOKEN.match(html, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a bare "<" is text
            lt = html.find("<", lt + 1)
            m = _TOKEN.match(html, lt) if lt >= 0 else None
        stop = n if lt < 0 else lt
        if stop > at:
            open_[-1].children.append(unescape(html[at:stop]))
        if m is None:
            break
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["close"]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close_to(k)
                    break
                if tag in INLINE and open_[k].tag not in INLINE:
                    break  # a stray end of an inline element ends no block
            continue
        if tag in CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    close_to(k)
                    break
                if open_[k].tag not in INLINE:
                    break
        for k in range(len(open_) - 1, 0, -1):
            if tag in ENDED_BY.get(open_[k].tag, ()):
                close_to(k)
                break
            if open_[k].tag in CONTAINERS:
                break
        found = list(_ATTR.finditer(m["attrs"]))
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in reversed(found)}  # the first of a name counts
        closed = m["attrs"].endswith("/") and (not found or found[-1].end() < len(m["attrs"]))  # a value may end in a slash
        node = Node(tag, attrs, open_[-1])
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not closed:
            open_.append(node)
    return root


def _elements(node: Node) -> list[Node]:
    """All elements in page order, without recursion (pages may nest deeply)."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def _hint(node: Node) -> int:
    """0 without a hint, 1 for a vague one or an element that seldom holds text, 2 for a plain one, 3 for comments."""
    if node.tag in ("html", "body", "main", "#root"):
        return 0
    a = node.attrs
    words = {w.lower() for w in _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")} & HINTS if a else ()
    if words and not COMMENTS.isdisjoint(words):
        return 3
    if a and (a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
              or re.search(r"display\s*:\s*none", a.get("style", ""))
              or any(x.lower() in PAGE_HEADERS for x in f"{a.get('class', '')} {a.get('id', '')}".split())):
        return 2
    return 2 if any(w not in VAGUE for w in words) else 1 if words or node.tag in SELDOM else 0


def _larger_part(body: Node, hints: dict[int, int]) -> set[int]:
    """Hinted elements with most of the page's text outside links that have no rival.

    A rival of a vaguely hinted element is an article or main with text elsewhere, that of another hint
    also any element elsewhere whose density sum reaches the densest child of the hinted one, or inside an article
    its whole density sum. Comments have no such right.
    """
    most: dict[int, float] = {}  # the greatest density sum outside hinted elements
    marked: dict[int, bool] = {}
    for e in reversed(_elements(body)):
        below = [c for c in e.children if isinstance(c, Node)]
        free = not hints.get(id(e))
        own = e.sum - sum(c.density for c in below if hints.get(id(c)))
        most[id(e)] = max([own, *(most[id(c)] for c in below)]) if free else 0.0
        marked[id(e)] = free and (e.tag in ("article", "main") and e.chars > 0 or any(marked[id(c)] for c in below))
    kept, at, rival, article, inside = set(), body, 0.0, False, False
    half = (body.chars - body.link_chars) / 2
    while at is not None:
        below = [c for c in at.children if isinstance(c, Node)]
        large = next((c for c in below if c.chars - c.link_chars > half), None)
        inside = inside or at.tag == "article"
        if large is not None:
            rival = max([rival, at.sum - sum(c.density for c in below if c is large or hints.get(id(c))),
                         *(most[id(c)] for c in below if c is not large)])
            article = article or any(marked[id(c)] for c in below if c is not large)
            reach = max((c.density for c in large.children if isinstance(c, Node)), default=large.density)
            reach = max(reach, large.sum) if inside and hints.get(id(large)) != 3 else reach
            if hints.get(id(large)) and not article and (hints[id(large)] == 1 or rival < reach):
                kept.add(id(large))
        at = large
    return kept


def prune(root: Node, link_share: float) -> list[tuple[Node, Node, list]]:
    """Takes out what surrounds the article, by names and measured densities together.

    A hinted element stays if it holds main, the page's articles (comments hold none of them) or the larger
    part of the text. Returns (parent, element, the parent's former children) of vaguely hinted ones taken out.
    """
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if not isinstance(c, Node)
                         or not (c.tag in NO_TEXT or c.tag in RAW or (c.tag == "header" and not inside))]
        stack.extend((c, inside) for c in node.children if isinstance(c, Node))
    body = next((e for e in _elements(root) if e.tag == "body"), root)
    hints = {id(e): h for e in _elements(root) if (h := _hint(e))}
    if not hints:
        return []
    measure(body, link_share)
    kept = _larger_part(body, hints)
    holds: dict[int, tuple[bool, bool]] = {}  # an article, main: in or below the element
    for e in reversed(_elements(root)):
        below = [holds[id(c)] for c in e.children if isinstance(c, Node)]
        holds[id(e)] = (e.tag == "article" or any(b[0] for b in below), e.tag == "main" or any(b[1] for b in below))
    least = 4  # the weakest hint at or above any article
    stack = [(root, 0)]
    while stack:
        node, hint = stack.pop()
        hint = max(hint, hints.get(id(node), 0))
        if node.tag == "article":
            least = min(least, hint)
        stack.extend((c, hint) for c in node.children if isinstance(c, Node) and holds[id(c)][0])
    withheld = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag == "article"
        former, node.children = node.children, []
        for c in former:
            if isinstance(c, Node):
                hint = hints.get(id(c), 0)
                article = holds[id(c)][0] and not inside and (hint == 1 or least >= hint)
                replies = hint == 3 and inside and holds[id(c)][0]  # articles nested in an article's comments
                if not hint or article or holds[id(c)][1] or id(c) in kept and not replies:
                    node.children.append(c)
                elif hint == 1:
                    withheld.append((node, c, former))
                else:
                    continue
                stack.append((c, inside))
            else:
                node.children.append(c)
    return withheld


def put_back(withheld: list[tuple[Node, Node, list]], content: Node, threshold: float, link_share: float) -> None:
    """Returns vaguely hinted elements inside ``content`` whose density sum, a paragraph's density, reaches the threshold."""
    below = set(map(id, _elements(content))) if withheld else ()
    for parent, c, former in withheld:
        if id(parent) in below:
            measure(c, link_share)
            if (c.density if c.tag == "p" else c.sum) >= threshold and c.link_chars * 2 <= c.chars:
                now = {id(x) for x in parent.children if isinstance(x, Node)} | {id(c)}
                gone = {id(x) for x in former if isinstance(x, Node)} - now
                parent.children = [x for x in former if id(x) not in gone]
                below.update(map(id, _elements(c)))


def measure(body: Node, link_share: float) -> None:
    """Densities and density sums of all elements below ``body``, innermost first."""
    for node in reversed(_elements(body)):
        node.chars = node.link_chars = node.link_tags = 0
        node.tags = 1
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
            else:
                node.chars += len("".join(c.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, link_share)
        node.sum = sum(c.density if isinstance(c, Node) else _density(len("".join(c.split())), 1, 0, 0, link_share)
                       for c in node.children)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + link_share * chars + math.e)
    ratio = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(ratio, 1.0) + 1.0) / math.log(max(base, 2.0))


def _share_of_links(body: Node) -> float:
    chars = links = 0
    stack = [(body, False)]
    while stack:
        node, in_link = stack.pop()
        if node.tag in RAW or node.tag == "head":
            continue
        for c in node.children:
            if isinstance(c, Node):
                stack.append((c, in_link or c.tag == "a"))
            else:
                n = len("".join(c.split()))
                chars += n
                links += n * in_link
    return links / max(chars, 1)


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order; inline elements, breaks and cells make no block."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x.tag in ("br", "td", "th", "img", "wbr"):
            if x.tag != "wbr":
                part.append(" ")
            stack.extend(reversed(x.children))
        elif x.tag in INLINE:
            stack.extend(reversed(x.children))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def _linked(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def _teaser(node: Node, threshold: float) -> bool:
    """Less dense than content, and mostly links or under a heading that is one link."""
    return max(node.density, node.sum) < threshold and node.chars > 0 and (_linked(node) or any(
        e.tag in HEADINGS and e.chars and e.link_chars == e.chars for e in _elements(node)))


def choose(body: Node, best: Node, threshold: float, link_share: float) -> None:
    """Leaves below ``body`` the best element and what is as dense as the threshold.

    Less dense blocks stay in two cases, unless more than half of them is links: in the article element
    around the best one (not in articles nested there), and as headings or paragraphs beside the way to
    the best one below main. An article beside that of the best one needs the density sum only. In the best
    element, teasers go: anywhere if it lies in no article, else where an article is nested.
    """
    path = set(map(id, best.path()))
    article = next((e for e in reversed(list(best.path())) if e.tag == "article"), None)
    holds: set[int] = set()  # elements in which an article lies
    for e in _elements(body):
        if e.tag == "article" and e is not article:
            for up in e.path():
                if id(up) in holds:
                    break
                holds.add(id(up))

    def run_stays(run: list, lenient: bool) -> bool:
        parts = [c for c in run if isinstance(c, Node)]
        chars = sum(c.chars if isinstance(c, Node) else len("".join(c.split())) for c in run)
        links = sum(c.link_chars for c in parts)
        if lenient:
            return links * 2 <= chars
        return chars > 0 and _density(chars, 1 + sum(c.tags for c in parts), links, sum(c.link_tags for c in parts),
                                      link_share) >= threshold

    stack = [] if body is best else [(body, body is article, body.tag == "main")]
    while stack:
        node, lenient, main = stack.pop()
        keep, run = [], []
        for c in [*node.children, None]:
            if c is not None and (not isinstance(c, Node) or (c.tag in INLINE or c.tag in VOID) and id(c) not in path):
                run.append(c)
                continue
            keep += run if run_stays(run, lenient) else ()
            run = []
            if c is None:
                break
            beside = id(node) in path
            if id(c) in path:
                if c is not best:
                    stack.append((c, lenient or c is article, main or c.tag == "main"))
            elif not (c.density >= threshold and (c.tag in HEADINGS or c.tag == "p" or c.sum >= threshold)
                      or not _linked(c) and (
                          lenient and id(c) not in holds
                          or main and beside and (c.tag in HEADINGS or c.tag in ("p", "header", "hgroup", "blockquote", "pre"))
                          or c.tag == "article" and article is not None and article.parent is node and c.sum >= threshold)):
                stack.append((c, lenient and c.tag != "article" and not _linked(c), main))
            keep.append(c)
        node.children = keep
    if article is None and not any(e.tag == "main" for e in best.path()):
        return
    stack = [best]
    while stack:
        node = stack.pop()
        drop = {id(c) for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in HEADINGS
                and c.tag != "p" and (article is None or id(c) in holds) and _teaser(c, threshold)}
        node.children = [c for c in node.children if id(c) not in drop]
        stack.extend(c for c in node.children if isinstance(c, Node) and max(c.density, c.sum) >= threshold
                     and c.density < threshold and (article is None or id(c) in holds))


def main_text(html: str) -> str:
    """The article's blocks joined by line feeds; empty if the page has no text."""
    root = parse(html)
    body = next((e for e in _elements(root) if e.tag == "body"), root)
    share = _share_of_links(body)
    withheld = prune(root, share)
    body = next((e for e in _elements(root) if e.tag == "body"), root)
    measure(body, share)
    best = max(_elements(body), key=lambda e: e.sum)
    if not best.chars:
        return ""
    threshold = min(e.density for e in best.path() if hasattr(e, "density"))
    put_back(withheld, next((e for e in best.path() if e.tag == "article"), best), threshold, share)
    measure(body, share)
    choose(body, best, threshold, share)
    return "\n".join(blocks_of(body))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    A null or empty page, or one without text, gives an empty text. Nothing is cut from long pages;
    repeated rows are read like any others; other columns are ignored; an empty table gives no rows.
    """
    share_code(pages.sparkSession)
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint")
