"""Main-text extraction from raw HTML by tree scoring.

A tolerant tokeniser builds a tree (void elements, implied end tags, raw-text elements, unclosed markup). Subtrees that are
page furniture by their tag, role, being hidden, or a class or id that names nothing else, are pruned. Each remaining block gives
points for its length and commas to its ancestors, less the farther they are, and in full to the article (or main part) it
stands in; a container's points are discounted by its link density. The best container is kept with those siblings that
score alike, and with other articles beside it or of like score. Nothing inside what is kept is left out, but for lists of
short links that stand outside articles.

Defined cases: null or empty html, pages with no text and pages of furniture alone give an empty text; repeated rows are
extracted each; unclosed and nested markup of any depth is read without recursion, in time linear in the page; other columns
are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_batches

# The element sets of the HTML standard that matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr html body".split())
FURNITURE = frozenset("nav footer aside form menu dialog search head button object canvas audio video label fieldset legend datalist output progress meter map".split()) | RAW
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
# Parts of class names and ids by which page furniture is known, and parts that say nothing of their own beside them.
FURNITURE_NAMES = frozenset(
    "ad ads adv alert alerts advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus disclaimer footer gdpr masthead menu menus modal nav navbar navigation navigational newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted recommendations recommended related reply replies respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar trending widget widgets".split()
)
NEUTRAL_NAMES = frozenset("a area bar block bottom box btn button buttons center col column container content entry first footer form global group header holder inner item items js last left link links list main mobile module outer page panel post posts primary reader readers right row secondary section side site slot sticky the thread title top unit user wrap wrapper".split())
HEADER_NAMES = frozenset(["header", "head", "topbar"])
READER_NAMES = frozenset("comment comments commentlist disqus respond reply replies".split())
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
KEPT = frozenset("html body main b i em strong h1".split())
CLOSES_CELLS = frozenset("table tr td th tbody thead tfoot article main div section".split())
P_SCOPE = frozenset("article aside body button caption div footer header html li main nav object section table td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("chars", "children", "drop", "links", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.drop, self.score, self.chars, self.links = 0, 0.0, 0, 0


HARD, SOFT = 2, 1
UNITS = ("article", "main")


def _names(marked: dict[str, str], in_article: bool) -> set[str]:
    """The furniture words among class names and the id; a name counts only if its other parts say nothing, so "related-work" does not."""
    found: set[str] = set()
    words = FURNITURE_NAMES if in_article else FURNITURE_NAMES | HEADER_NAMES
    for name in f"{marked.get('class', '')} {marked.get('id', '')}".split():
        parts = {x.lower() for x in _PARTS.split(name) if x and not x.isdigit()}
        if parts & words and parts <= words | NEUTRAL_NAMES:
            found |= parts & words
    return found


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    """HARD for page furniture by tag, role, being hidden or being readers' words; SOFT by another name, which may mislead."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return HARD
    if len(attrs) < 3:
        return 0
    marked = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in marked or marked.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", marked.get("style", "").lower()):
        return HARD
    if tag in KEPT:
        return 0
    if marked.get("role", "").lower() in FURNITURE_ROLES:
        return HARD
    names = _names(marked, in_article)
    if names & READER_NAMES:
        return HARD
    return SOFT if names and tag != "article" else 0


def _reconsider(root: Node) -> None:
    """Softly pruned parts that hold the article, or a main heading and paragraphs, come back: their name was not what they are."""
    order = [root]
    for node in order:
        order.extend(x for x in node.children if not isinstance(x, str) and x.drop != HARD)
    paragraphs: dict[int, int] = {}
    article: dict[int, bool] = {}
    heading: dict[int, bool] = {}
    for node in reversed(order):
        below = [x for x in node.children if not isinstance(x, str) and x.drop != HARD]
        paragraphs[id(node)] = (node.tag == "p") + sum(paragraphs[id(x)] for x in below)
        article[id(node)] = node.tag in ("article", "main") or any(article[id(x)] for x in below)
        heading[id(node)] = node.tag == "h1" or any(heading[id(x)] for x in below)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.drop == SOFT and (article[id(node)] or heading[id(node)] and paragraphs[id(node)] > 1):
            node.drop = 0
        if not node.drop:
            stack.extend(x for x in node.children if not isinstance(x, str) and x.drop != HARD)


def _kept_tags(root: Node) -> set[str]:
    found, stack = set(), [root]
    while stack:
        for x in stack.pop().children:
            if not isinstance(x, str) and not x.drop:
                found.add(x.tag)
                stack.append(x)
    return found


class _Open:
    """The open elements, with the places of each tag among them, so that no search walks up the tree."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        if node.tag in P_SCOPE:
            self.scopes.append(len(self.nodes))
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of the tags; 0 (the root) if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, place: int, *tags: str) -> int:
        """The place of the outermost open element of the tags below a place; 0 if there is none."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, place)) < len(p)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        """Closes the element at a place, and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()
        while self.scopes and self.scopes[-1] >= place:
            self.scopes.pop()


def parse(html: str) -> Node:
    root = Node("html", None)
    now, pos = _Open(root), 0
    soft = False
    for m in iter(lambda: _TOKEN.search(html, pos), None):
        if m.start() > pos:
            now.nodes[-1].children.append(unescape(html[pos : m.start()]))
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                now.nodes[-1].children.append(m["cdata"])
            continue
        tag = tag.lower()
        if m["end"]:
            place = now.last(tag)
            if place and (place >= now.last("td", "th") or tag in CLOSES_CELLS):
                now.close(place)
            elif tag in ("p", "br"):
                now.nodes[-1].children.append(Node(tag, now.nodes[-1]))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and (place := now.last("p")) > (now.scopes[-1] if now.scopes else 0):
            now.close(place)
        if tag in CLOSED_BY:
            ends, bounds = CLOSED_BY[tag]
            bound = now.last(*bounds)
            place = now.first_after(bound, *ends) if tag == "tr" else now.last(*ends)
            if place > bound:
                now.close(place)
        node = Node(tag, now.nodes[-1])
        node.drop = _furniture(tag, m["attrs"], now.last("article", "main") > 0)
        soft |= node.drop == SOFT
        now.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        elif tag not in VOID and not m["attrs"].endswith("/>"):
            now.push(node)
    if pos < len(html):
        now.nodes[-1].children.append(unescape(html[pos:]))
    if soft and not _kept_tags(root) & {"article", "main"}:
        _reconsider(root)
    return root


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(container, text, characters in links) of each run of inline content, in page order, without pruned subtrees."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    links = 0

    def flush(node: Node) -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append((node, text, min(links, len(text))))
        parts.clear()
        links = 0

    stack: list[tuple[Node, Node, int, bool]] = [(root, root, 0, False)]  # node, its nearest block, next child, in a link
    while stack:
        node, block, i, linked = stack.pop()
        if i == len(node.children):
            if node is block:
                flush(block)
            continue
        child = node.children[i]
        stack.append((node, block, i + 1, linked))
        if isinstance(child, str):
            parts.append(child)
            links += len(child) * linked
        elif child.drop:
            parts.append(" ")
        elif child.tag in BLOCK:
            flush(block)
            stack.append((child, child, 0, linked))
        elif child.tag in VOID:
            parts.append(" ")
        else:
            stack.append((child, block, 0, linked or child.tag == "a"))
    flush(root)
    return out


def _is_menu(node: Node, anchors: int) -> bool:
    """A list or table of little but links with short names."""
    return node.tag in ("ul", "ol", "dl", "table") and anchors > 0 and node.links > 0.75 * node.chars and node.links < 30 * anchors


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    blocks = _blocks(root)
    if not blocks:
        return ""
    order, unit = [root], {id(root): root if root.tag in UNITS else None}
    for node in order:
        for x in node.children:
            if not isinstance(x, str) and not x.drop:
                order.append(x)
                own = unit[id(node)]
                unit[id(x)] = x if x.tag == "article" or x.tag == "main" and own is None else own
    for node, text, links in blocks:
        node.chars += len(text)
        node.links += links
    anchors = {id(node): int(node.tag == "a") for node in order}
    for node in reversed(order[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links
        anchors[id(node.parent)] += anchors[id(node)]
    scored: dict[int, Node] = {}
    for node, text, _ in blocks:
        if len(text) < 25 or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        a = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") and node.parent is not None else node
        shares = {}
        for share in (1, 2, 6, 9, 12, 15):
            shares[id(a)] = (a, points / share)
            a = a.parent
            if a is None:
                break
        if (own := unit[id(node)]) is not None:
            shares[id(own)] = (own, points)  # an article gets the points of all that it holds in full
        for a, more in shares.values():
            if id(a) not in scored:
                scored[id(a)] = a
            a.score += more
    worth = lambda a: a.score * (1 - a.links / max(1, a.chars))
    if scored:
        best = max(scored.values(), key=lambda a: worth(a) + (25 if a.tag in UNITS else 5 if a.tag in ("div", "section") else 0))
    else:  # no block that scores: the article if there is one, else the whole page
        best = max((a for a in order if a.chars), key=lambda a: (a.tag in UNITS, a.tag == "html", a.chars))
    kept, least = {id(best)}, 0.2 * worth(best)
    for x in best.parent.children if best.parent is not None else []:
        if isinstance(x, str) or x.drop or not x.chars:
            continue
        density = x.links / x.chars
        if x.score and worth(x) >= least or x.tag in ("article", "h1") and density < 0.5 or x.tag == "p" and density < 0.25:
            kept.add(id(x))
    if best.tag == "article":
        kept.update(id(x) for x in scored.values() if x.tag == "article" and worth(x) >= least)
    inside: set[int] = set()
    for node in order:
        if id(node) in kept or node.parent is not None and id(node.parent) in inside and (unit[id(node)] is not None or not _is_menu(node, anchors[id(node)])):
            inside.add(id(node))
    return "\n".join(text for node, text, _ in blocks if id(node) in inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), compute, "page_id long, url string, text string, n_chars long")


def oracle_sql() -> str:
    """The same texts in DuckDB for tables whose pages keep their text in one plain article element, as ``pages`` does."""
    return r"""
with cut as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer|$)', 1), '\s+', ' ', 'g') as body from pages),
lines as (select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h1|article|li|ul|div)\b[^>]*>', chr(10), 'g'), '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(10)) as l from cut),
plain as (select page_id, url, list_transform(l, lambda x: replace(replace(replace(replace(replace(replace(x, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as l from lines),
joined as (select page_id, url, array_to_string(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from plain)
select page_id, url, text, length(text)::bigint as n_chars from joined"""
