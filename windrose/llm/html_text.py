"""Main text of web pages by tree scoring.

A page becomes a tree of blocks. Every paragraph gives points for its length and its commas to its parent and, halved
again and again, to the ancestors above; a container's points are discounted by the share of its text that lies in
links. The best container is kept, whole with the article that it lies in; where what surrounds it is a main element or
poor in links, so are all its siblings but lists of links, else those that score well enough or hold plain prose. Menus,
footers, forms, scripts, styles, what is hidden, and headers but those of an article are never part of the tree. What only
a class or id names as such, or as sidebar, notice, advert or comments of readers, is left out unless it holds most of the
page's text and either an article or main element or a name of which that word is just a part; or unless nothing else is
left. Inside an article or main element a name counts only if all its words are of that kind, so a section on side effects
or related work stays.

A page with null or empty html, or without any text, has an empty text and 0 characters. Rows are independent: repeated
pages repeat their result. Unclosed and stray tags are repaired as browsers do for paragraphs, list items and cells. Pages
of any length and depth are taken whole, in time that grows with their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import map_arrow

#: Characters that give a paragraph one more point, and the most such points.
POINT_CHARS, MOST_POINTS = 100, 3
#: Of the best score: what a sibling needs; of a link-free sibling paragraph: the length that is prose.
SIBLING_SHARE, PROSE_CHARS = 0.2, 80
#: The share of text in links below which a container is poor in links, and from which one is a list of links.
LINK_POOR, LINK_LIST = 0.25, 0.5

# Fixed values of the HTML standard: elements by how they are laid out and closed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
LEFT_OUT = frozenset("nav header footer aside form button select option input textarea dialog menu script style noscript template iframe object embed svg canvas audio video head title map fieldset".split())
SECTIONING = frozenset("article main body html section div".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|related|recommend\w*|share|sharing|social|comments?|commentlist|respond|disqus|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|paywall|pagination|pager|toolbar|skip|hidden)(?:$|[\s_-])", re.I)
#: What stands beside such a word in the name of a container of that kind.
COMPANIONS = frozenset("area bar block body bottom box btn button buttons cell col column container content country count entry feed first footer form global group header heading holder icon icons inline inner item items label last layer left link links list main mobile desktop more ns outer page panel pane post posts articles stories primary region right row secondary section site slot strip tab tabs text thread title tools top tray unit user reader view wrap wrapper zone google dfp and the for of s".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "chars", "link_chars", "named", "whole")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        #: Nodes and (text, whether in a link).
        self.children: list = []
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        #: Whether a class or id names it as boilerplate, and whether that is a whole name.
        self.named = self.whole = False


def _attributes(attributes: str) -> Iterator[tuple[str, str]]:
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def _is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _attributes(attributes):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _all_boilerplate(name: str) -> bool:
    """Whether a name has words of boilerplate and, beside them, only their companions."""
    words = [w for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)", name) if w]
    kinds = [bool(BOILERPLATE.fullmatch(w)) for w in words]
    return any(kinds) and all(k or w.lower() in COMPANIONS or w.isdigit() for k, w in zip(kinds, words, strict=True))


def _named(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether a class or id has a word of boilerplate (in an article: no others), and whether one is such a word and no more."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    values = [x for name, v in _attributes(attributes) if name in ("class", "id") and BOILERPLATE.search(v) for x in v.split()]
    named = any(map(_all_boilerplate, values)) if in_article else bool(values)
    return named, any(BOILERPLATE.fullmatch(x) for x in values)


def parse(page: str) -> Node:
    """The tree of a page's blocks; inline elements leave only their text."""
    root = node = Node("html", None, False)
    links, at = 0, 0
    #: Open elements by tag, so that no search for one that is not there climbs the tree.
    open_: Counter[str] = Counter(html=1)

    def add(text: str) -> None:
        if text and not node.dropped:
            node.children.append((html.unescape(text), links > 0))

    def close(up: Node) -> Node:
        """The parent of ``up``, after all that is open below it."""
        here = node
        while here is not up:
            open_[here.tag] -= 1
            here = here.parent
        open_[up.tag] -= 1
        return up.parent

    while True:
        m = TAG.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            return root
        at = m.end()
        if not m[1]:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:-3], quote=False))
            continue
        tag, closing = m[1].lower(), m[0][1] == "/"
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                add(" ")
            continue
        links = 0
        if closing:
            up = node if open_[tag] else None
            while up is not None and up.tag != tag:
                up = None if up.tag in ("td", "th", "article", "main") and tag in ("p", "li") else up.parent
            if up is not None and up.parent is not None:
                node = close(up)
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = CLOSED_BY.get(tag, set()) | {"p"}
            up = node if any(open_[x] for x in ends) else root
            while up.parent is not None and up.tag not in SCOPE and up.tag not in ends:
                up = up.parent
            if up.tag in ends and up.parent is not None:
                node = close(up)
        if tag in RAW:
            if not m[2].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            add(" ")
            continue
        in_article = open_["article"] + open_["main"] > 0
        child = Node(tag, node, node.dropped or not (tag == "header" and open_["article"]) and _is_boilerplate(tag, m[2]))
        if m[2].endswith("/"):
            continue
        child.named, child.whole = _named(tag, m[2], in_article)
        if not child.dropped:
            node.children.append(child)
        node = child
        open_[tag] += 1


def _blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(node, text, characters in links) of the runs of text below, in page order, without recursion."""
    stack: list = [(top, iter(top.children), [], [])]
    while stack:
        node, rest, texts, linked = stack[-1]
        for x in rest:
            if isinstance(x, Node):
                break
            texts.append(x[0])
            linked.append(len(x[0].strip()) if x[1] else 0)
        else:
            x = None
        if texts:
            if text := SPACE.sub(" ", "".join(texts)).strip():
                yield node, text, sum(linked)
            texts.clear()
            linked.clear()
        if x is None:
            stack.pop()
        else:
            stack.append((x, iter(x.children), [], []))


def _left_out(root: Node) -> list[tuple[Node, Node]]:
    """(parent, child) of the containers that are boilerplate by their names, the outermost ones."""
    inside: list[Node] = [root]
    for node in inside:
        inside.extend(x for x in node.children if isinstance(x, Node))
    if not any(x.named for x in inside):
        return []
    size, articles = {}, {}
    for node in reversed(inside):
        size[id(node)] = sum(size[id(x)] if isinstance(x, Node) else len(x[0].strip()) for x in node.children)
        articles[id(node)] = node.tag in ("article", "main") or any(articles[id(x)] for x in node.children if isinstance(x, Node))
    out, rest = [], [root]
    for node in rest:
        for x in node.children:
            if isinstance(x, Node):
                if x.named and not (2 * size[id(x)] > size[id(root)] and (articles[id(x)] or not x.whole)):
                    out.append((node, x))
                else:
                    rest.append(x)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    blocks = list(_blocks(root))
    if named := _left_out(root):
        before = {id(parent): list(parent.children) for parent, _ in named}
        gone = {id(x) for _, x in named}
        for parent, _ in named:
            parent.children = [x for x in parent.children if id(x) not in gone]
        #: A page of nothing else stays as it is.
        if rest := list(_blocks(root)):
            blocks = rest
        else:
            for parent, _ in named:
                parent.children = before[id(parent)]
    own: dict[int, float] = {}
    for node, text, linked in blocks:
        node.chars, node.link_chars = node.chars + len(text), node.link_chars + linked
        to = node if node.tag in SECTIONING else node.parent
        own[id(to)] = own.get(id(to), 0.0) + (1 + text.count(",") + min(MOST_POINTS, len(text) // POINT_CHARS)) * (1 - min(1.0, linked / len(text)))
    tree = [root]
    for node in tree:
        tree.extend(x for x in node.children if isinstance(x, Node))
    #: Children come after their parents, so sums and halved points go up in one pass.
    for node in reversed(tree):
        node.points += own.get(id(node), 0.0)
        if node.parent is not None:
            up = node.parent
            up.chars, up.link_chars, up.points = up.chars + node.chars, up.link_chars + node.link_chars, up.points + node.points / 2
    touched = {id(x): x for x in tree if x.points > 0}
    if not touched:
        return "\n\n".join(text for _, text, _ in blocks)
    score = lambda n: n.points * (1 - n.link_chars / max(1, n.chars))
    best = max(touched.values(), key=score)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    #: The outermost article or, without one, the best container; then up to the outermost main element.
    best = next((x for x in reversed(above) if x.tag == "article"), best)
    above = above[above.index(best) :]
    last = max((k for k, x in enumerate(above) if x.tag == "main"), default=0)
    poor = len(above) > 1 and above[1].link_chars < LINK_POOR * above[1].chars
    top = above[last] if last else above[1] if poor and best.tag != "main" else best
    kept, lists = {id(top)}, set()
    for inner, outer in zip(above, above[1 : above.index(top) + 1], strict=False):
        lists.update(id(x) for x in outer.children if isinstance(x, Node) and x is not inner and x.link_chars >= LINK_LIST * max(1, x.chars))
    if top is best and best.parent is not None:
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling is not best and sibling.chars:
                links = sibling.link_chars / sibling.chars
                if score(sibling) >= SIBLING_SHARE * score(best) or sibling.tag in ("p", "h1", "h2", "blockquote", "pre") and links < LINK_POOR and (sibling.chars >= PROSE_CHARS or sibling.tag in ("h1", "h2")):
                    kept.add(id(sibling))
    #: Of the marks above a block the nearest one decides.
    inside = {id(root): id(root) in kept}
    for node in tree[1:]:
        inside[id(node)] = id(node) not in lists and (id(node) in kept or inside[id(node.parent)]) or id(node) in kept
    return "\n\n".join(text for node, text, _ in blocks if inside[id(node)])


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", F.col(html_column).cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
