"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, small_batches, table, text_slices

#: A tag, a comment or a declaration. Quoted attribute values may hold ">".
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the value is ended by a start tag of the key.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements beyond which neither an end tag nor an implied end reaches.
_WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map form button select option textarea input nav menu aside footer dialog datalist title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Class names, each a whole token, that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget notice notices notification alert toolbar pagination pager search copyright skip outbrain taboola".split()
)
#: Whole ids that do; words that may well name a section of an article are not among them.
_IDS = frozenset("ad ads adsense sidebar sidenav nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comments commentlist disqus newsletter pagination outbrain taboola".split())
#: Class names and ids that count within an article too: adverts, reader comments, sidebars.
_INSIDE = frozenset("ad ads adsense adslot advert advertisement advertising adverts commentlist comments disqus newsletter outbrain sidebar sponsored taboola".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "marked", "host", "chars", "articles", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.marked, self.host = tag, parent, [], False, None


def _attributes(raw: str) -> dict[str, str]:
    return {} if not raw or raw.isspace() else {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _hidden(tag: str, values: dict[str, str], inside: bool) -> bool:
    """True for an element that its tag, role or style tells apart from the article."""
    if tag in _DROPPED:
        return True
    if tag == "header":
        return not inside
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        return True
    return values.get("role", "").lower() in _ROLES


def _marked(tag: str, values: dict[str, str], inside: bool) -> bool:
    """True for an element that a class or its id names as not the article; never a heading, and few names count inside article or main."""
    if tag in _HEADINGS or tag in ("html", "body", "main"):
        return False
    names, own = set(values.get("class", "").lower().split()), values.get("id", "").strip().lower()
    if inside:
        return tag != "article" and bool((names | {own}) & _INSIDE)
    return bool(names & _MARKS) or own in _IDS or "header" in names or own == "header"


def prune(root: Node) -> None:
    """Take marked subtrees out of the tree, but none that holds most of the page's text.

    Such a one goes only where an article or main element with text stands outside it. One within
    an article or main element goes where that has other text. Where nothing would be left, all stay.
    """
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    if not any(n.marked for n in nodes):
        return
    for n in reversed(nodes):
        n.chars = sum(c.chars if isinstance(c, Node) else len(c.strip()) for c in n.children)
        n.articles = sum(c.articles for c in n.children if isinstance(c, Node)) + (n.tag in ("article", "main") and n.chars > 0)
    for n in nodes:
        for c in n.children:
            if isinstance(c, Node):
                c.host = n if n.tag in ("article", "main") else n.host
    goes = {id(n) for n in nodes if n.marked and (n.host.chars > n.chars if n.host else 2 * n.chars <= root.chars or root.articles > n.articles)}
    left, todo = 0, [root]
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, Node):
                left += len(c.strip())
            elif id(c) not in goes:
                todo.append(c)
    if left:
        for n in nodes:
            n.children = [c for c in n.children if id(c) not in goes]


def parse(html: str) -> Node:
    """The page's tree without what is told apart from the article; unclosed and stray tags are put up with."""
    root = Node("#root", None)
    at, pos, dropped, inside = root, 0, None, 0

    def text(s: str) -> None:
        if dropped is None and s:
            at.children.append(unescape(s) if "&" in s else s)

    counts: dict[str, int] = {}  # open elements by tag: no walk up for one that is not open
    while m := _TAG.search(html, pos):
        text(html[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node, wall = at if counts.get(tag) else root, _WALLS.get(tag, ())
            while node is not root and node.tag != tag:
                if node.tag in wall or (tag not in _BLOCK and node.tag in _BLOCK and node.tag != "p"):
                    node = root
                    break
                node = node.parent
            if node is not root:
                while at is not node.parent:
                    inside -= at.tag in ("article", "main")
                    dropped = None if at is dropped else dropped
                    counts[at.tag] -= 1
                    at = at.parent
            elif tag == "p":
                at.children.append(Node("p", at))
            continue
        ends = _ENDS.get(tag, ())
        if tag in _BLOCK:
            ends = {*ends, "p"}
        if any(map(counts.get, ends)):
            node, stop = at, None
            while node is not root:
                if node.tag in ends:
                    stop = node
                    if node.tag == "p" or tag not in _WALLS:
                        break
                if node.tag in _WALLS.get(tag, ()) or (tag not in _WALLS and node.tag in _BLOCK):
                    break
                node = node.parent
            if stop is not None:
                while at is not stop.parent:
                    inside -= at.tag in ("article", "main")
                    dropped = None if at is dropped else dropped
                    counts[at.tag] -= 1
                    at = at.parent
        node = Node(tag, at)
        values = _attributes(m[3]) if dropped is None else {}
        hide = dropped is None and _hidden(tag, values, inside > 0)
        node.marked = dropped is None and not hide and _marked(tag, values, inside > 0)
        if dropped is None and not hide:
            at.children.append(node)
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        at = node
        counts[tag] = counts.get(tag, 0) + 1
        inside += tag in ("article", "main")
        dropped = node if hide else dropped
    text(html[pos:])
    prune(root)
    return root


def measure(root: Node) -> list[Node]:
    """Densities of each node, parents first: link-adjusted characters a tag, and the children's sum.

    The parts of an article or main element belong together: its sum also counts the best one within.
    """
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, Node):
                n.chars, n.tags = n.chars + c.chars, n.tags + c.tags + 1
                n.link_chars, n.link_tags = n.link_chars + c.link_chars, n.link_tags + c.link_tags + (c.tag == "a")
            else:
                n.chars += len(c) if not c.isspace() else 0
        if n.tag == "a":
            n.link_chars = n.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        if not c:
            n.density = 0.0
            continue
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
        n.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1) / math.log(base + 1e-9) if base > 1 + 1e-6 else c / t * math.log(max(1.0, c / lc * t / lt) + 1)
    for n in reversed(nodes):
        n.total = sum(c.density for c in n.children if isinstance(c, Node))
        n.best = n
        for c in n.children:
            if isinstance(c, Node) and c.best.total > n.best.total:
                n.best = c.best
        if n.tag in ("article", "main") and n.best is not n:
            n.total, n.best = n.total + n.best.total, n
    return nodes


def article(root: Node) -> set[int]:
    """Identities of the subtrees that make up the article.

    The node of the largest sum of child densities is taken. If that is an article or main element,
    it is the whole extent. If not, the least density on the path from it up to the body is the
    threshold: below the body, each node that reaches it gives its own best subtree.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    within = [n for n in nodes if n.tag in ("article", "main") and n.chars > 0.5 * root.chars]
    top = max(within, key=lambda n: n.total).best if within else body.best if body.chars else root.best
    if top.tag in ("article", "main"):
        return {id(top)}
    threshold, up = top.density, top
    while up is not None and up is not body:
        threshold = min(threshold, up.density)
        up = up.parent
    threshold = min(threshold, body.density)
    chosen, todo = {id(top)}, [body]
    while todo:
        n = todo.pop()
        if id(n) in chosen and n is not body or n is top:
            continue
        if n.density >= threshold and n.chars:
            chosen.add(id(n.best))
            if n.best is not n:
                todo += [c for c in n.children if isinstance(c, Node)]
    return chosen


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by two line feeds; white space in a block is one space."""
    if not html or html.isspace():
        return ""
    root = parse(html)
    chosen = article(root)
    blocks, run = [], []

    def end() -> None:
        if run:
            if block := _SPACE.sub(" ", "".join(run)).strip():
                blocks.append(block)
            run.clear()

    todo: list = [(root, False)]
    while todo:
        item, on = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if on:
                run.append(item)
        elif item.tag == "br":
            run.append(" ")
        else:
            on = on or id(item) in chosen
            block = item.tag in _BLOCK or item.tag == "#root"
            if block:
                end()
                todo.append((None, on))
            todo += [(c, on) for c in reversed(item.children)]
    end()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns but `html`, and text string, n_chars long: each page's main text.

    Null, empty and blank pages, and pages without text, have the empty text. Pages of any length
    are read whole, nested however deep. Repeated rows each have a row.
    Elements of a page's frame are left out by tag and role, and by whole class names and ids: outside
    article and main unless most of the page's text is in them, inside only adverts, comments and sidebars.
    Columns of the result's own names are replaced.
    """
    checked(pages, html)
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, text, "n_chars")]
    source = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{html}`").cast("binary").alias("html"))

    def run(batches):
        for batch in batches:
            for start, values in text_slices(batch, "html"):
                out = [main_text(x.decode("utf-8", "replace")) for x in values]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(out)).columns[: len(keep)], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*[f"c{i}" for i in range(len(keep))], "text", "n_chars"])

    fields = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    out = source.mapInArrow(run, f"{fields}text string, n_chars long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(text), "n_chars")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
