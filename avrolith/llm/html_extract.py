"""Main text of web pages by tree scoring.

A page becomes a tree of elements (tags that browsers close are closed). Parts that
never belong to an article by their tag, or that are hidden, are cut. A part
whose name says that it is a menu, an advert or the like is cut as well, unless most of
the page's text is in it (see _cut_named): then it is a wrapper.
Every paragraph passes points for its own length and commas to its container, half of them to
the container's container, and so on; a container's points are discounted by its
link density. The best container is kept, with those of its siblings that score
near it or read like text, without link lists inside.

Text rules: character references are decoded, white space within a block
becomes one space, blocks are joined in page order by one space.

Every step is linear in the page, however deep it nests: open elements are found by tag in
stacks, and points are summed up from the leaves. Each page is worked off by itself in one
pass, so rows need no shuffle and skew does not matter. Defined results: null and
empty pages, and pages without any text, give the empty string; broken markup is read as far
as it goes (a comment, script or style that never ends hides the rest, as in browsers; after
UNBALANCED tags without an end outside quotes, quotes hide no '>' in this page any more); repeated rows
each get a row; an empty table gives an empty result; only the id, url and html
columns are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from avrolith.llm.common import texts

#: Tags without an end outside quotes after which quotes are taken for plain characters.
UNBALANCED = 64

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>`]++)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_SURROGATE = re.compile("[\ud800-\udfff]")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|[0-9]+|[^\x00-\x7f]+")

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_P_FENCE = ("td", "th", "button", "table", "caption", "object")
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "button": ("button",)}
_FENCE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "button": ()}
_FORMATTING = frozenset("b big code em font i s small span strike strong tt u".split())
_IN_HEAD = frozenset("base bgsound link meta noframes noscript script style template title".split())

_CUT_TAGS = frozenset("nav footer aside dialog menu head svg math select button template object canvas audio video".split())
_BOXES = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar side aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login search searchbox share sharing social sharebar widget widgets pagination pager toolbar copyright skip taglist contentinfo complementary".split())
_COMMENTS = frozenset("comment comments commentlist commentary respond replies disqus".split())
_RELATED = frozenset("related recommended recommendation recommendations".split())
_AFTER_RELATED = frozenset("articles box content items links list news pages posts products reading stories topics videos".split())
_STATES = frozenset("has with without no not is show hide enable disable hidden".split())
_ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog menu menubar toolbar".split())
_GOOD = frozenset("article body content entry main page post text story blog hentry".split())
_NAMED_BY_PARTS = frozenset("div section ul ol table center details fieldset dl figure header".split())
_NEVER_NAMED = _HEADINGS | {"html", "body", "main", "blockquote", "pre"}
_PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
_START = {"article": 40.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}
#: What a name says of an element.
_PLAIN, _BOX, _REMARKS = 0, 1, 2


class _Node:
    __slots__ = ("tag", "parent", "items", "cut", "good", "named", "titles", "block", "length", "linked", "commas", "own", "own_linked", "own_commas", "inbox", "score", "passed", "gain", "solid", "core")

    def __init__(self, tag, parent, cut=False, good=False, named=_PLAIN, titles=False):
        self.tag, self.parent, self.items = tag, parent, []
        self.cut, self.good, self.named, self.titles = cut, good, named, titles
        self.block = tag in _BLOCK


def _kind(tokens: list[str], by_parts: bool) -> int:
    """What class tokens or an id say. by_parts: a token's first or last part is enough."""
    for token in tokens:
        parts = [x.lower() for x in _PARTS.findall(token)]
        if not parts or ":" in token or not _STATES.isdisjoint(parts):
            continue
        ends = {"".join(parts)} | ({parts[0], parts[-1]} if by_parts or len(parts) == 1 else set())
        if ends & _COMMENTS:
            return _REMARKS
        if ends & _BOXES or (parts[0] in _RELATED and (len(parts) == 1 or parts[1] in _AFTER_RELATED)):
            return _BOX
    return _PLAIN


def _traits(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, int, int]:
    """Of an element: whether it is hidden, has a good name, as what box it is named, and whether it
    is named as a header (1) or as an article's header (2)."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    style = found.get("style")
    unseen = tag not in ("html", "body") and ("hidden" in found or (style is not None and _UNSEEN.search(style) is not None) or found.get("aria-hidden", "").strip().lower() == "true")
    classes, name = found.get("class", "").split(), found.get("id", "").split()
    parts = {x.lower() for token in [*classes, *name] for x in _PARTS.findall(token)}
    good = not parts.isdisjoint(_GOOD)
    named, head = _PLAIN, 0
    if tag not in _NEVER_NAMED:
        by_parts = tag in _NAMED_BY_PARTS
        named = max(_kind(classes, by_parts), _kind(name, by_parts and not in_article) if by_parts or tag in ("td", "li") else _PLAIN)
        if not named and found.get("role", "").strip().lower() in _ROLES:
            named = _BOX
        for token in [*classes, *name] if by_parts and not named else ():
            ends = [x.lower() for x in _PARTS.findall(token)]
            if ends and "header" in (ends[0], ends[-1]) and _STATES.isdisjoint(ends):
                head = max(head, 1 if _GOOD.isdisjoint(ends) else 2)
    return unseen, good, named, head


_known_traits = functools.lru_cache(maxsize=1 << 14)(_traits)


def _piece(text: str) -> str:
    return _html.unescape(text) if "&" in text else text


def parse(page: str) -> _Node:
    root = node = _Node("html", None)
    open_: list[_Node] = [root]
    where: dict[str, list[int]] = {"html": [0]}  # places in open_ by tag
    blocks = [0]
    missing: set[str] = set()  # raw tags that don't end any more
    unbalanced = at = 0
    size, last = len(page), page.rfind(">")

    def close(place: int) -> _Node:
        """Closes the elements from a place on."""
        while len(open_) > place:
            gone = open_.pop()
            where[gone.tag].pop()
            if gone.block:
                blocks.pop()
        return open_[-1]

    def latest(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            lt = size
        if lt > at:
            text = page[at:lt]
            if node.tag == "head" and not text.isspace():
                node = close(len(open_) - 1)
            if not node.titles:
                node.items.append(_piece(text))
            at = lt
            if lt == size:
                break
        next_ = page[lt + 1 : lt + 2]
        if next_ in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = size if end < 0 else max(end + 3, lt + 4)
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                node.items.append(page[lt + 9 : size if end < 0 else end])
                at = size if end < 0 else end + 3
            else:
                at = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt) if unbalanced < UNBALANCED else None
        if m is None:
            m = _PLAIN_TAG.match(page, lt)
            if m is None:  # no tag
                node.items.append("<")
                at = lt + 1
                continue
            unbalanced += 1
        at = m.end()
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                node.items.append(" ")
                continue
            places = where.get(tag)
            if not places or places[-1] == 0 or (tag in _FORMATTING and places[-1] < blocks[-1]) or (tag == "body"):
                continue
            node = close(places[-1])
            continue
        if tag in _RAW:
            if tag not in missing:
                end = _raw_end(tag).search(page, at)
                if end is None:
                    missing.add(tag)
                else:
                    at = end.end()
            if tag in missing and tag in ("script", "style"):
                break
            if tag != "title":
                node.items.append(" ")
            continue
        if tag == "html" or (tag in ("body", "head") and where.get("body")):
            continue
        if where.get("head") and tag not in _IN_HEAD and tag != "head":
            node = close(where["head"][-1])
        if tag in _VOID:
            if tag == "br":
                node.items.append(" ")
            elif tag == "hr":
                node.items.append("\n")
            continue
        if tag in _CLOSES_P and where.get("p") and where["p"][-1] > latest(_P_FENCE):
            node = close(where["p"][-1])
        if tag in _HEADINGS and node.tag in _HEADINGS:
            node = close(len(open_) - 1)
        if tag in _CLOSED_BY:
            while (place := latest(_CLOSED_BY[tag])) > latest(_FENCE[tag]):
                node = close(place)
        elif tag == "a" and where.get("a") and where["a"][-1] > blocks[-1]:
            node = close(where["a"][-1])
        in_article = bool(where.get("article") or where.get("main"))
        unseen = good = False
        named, head = _PLAIN, 0
        if len(attrs) > 3 and _TELLING.search(attrs):
            unseen, good, named, head = (_known_traits if len(attrs) < 200 else _traits)(tag, attrs, in_article)
        titles = node.titles and tag not in _HEADINGS
        if tag == "header" or head:
            if in_article or head == 2:
                titles = True  # of an article's own header the headings are kept
            elif tag == "header":
                unseen = True
            else:
                named = _BOX
        if tag == "form" and not named:
            named = _BOX
        child = _Node(tag, node, unseen or tag in _CUT_TAGS, good, named, titles)
        node.items.append(child)
        if attrs.endswith("/") and (tag in ("svg", "math") or where.get("svg") or where.get("math")):
            continue
        where.setdefault(tag, []).append(len(open_))
        if child.block:
            blocks.append(len(open_))
        open_.append(child)
        node = child
    return root


@functools.lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


def _order(root: _Node) -> list[_Node]:
    """Nodes that aren't cut, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.items) if x.__class__ is _Node and not x.cut)
    return out


def _density(node: _Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _points(node: _Node) -> float:
    """What a paragraph gives by its own text, without that of blocks within."""
    if not node.own or not node.block:
        return 0.0
    if node.tag not in _PARAGRAPHS and node.own <= 20:
        return 0.0
    return (1.0 + node.own_commas + min(node.own / 100, 3.0)) * (1 - node.own_linked / node.own)


def measure(nodes: list[_Node]) -> None:
    """Sizes, points and scores, from the leaves up. A paragraph's points go to its container
    whole (other text of a block is its own), and on to each further container by half."""
    for node in reversed(nodes):
        length = linked = commas = own = own_linked = own_commas = solid = 0
        inbox = gain = 0.0
        core = node.tag in ("main", "article")
        for x in node.items:
            if x.__class__ is str:
                x = x.strip()
                if x:
                    n, c = len(x), x.count(",") + x.count("、") + x.count("，")
                    length += n
                    commas += c
                    own += n
                    own_commas += c
            elif not x.cut:
                length += x.length
                linked += x.linked
                commas += x.commas
                gain += x.gain
                solid += x.solid
                core = core or x.core
                if x.block:
                    inbox += x.passed
                else:
                    own += x.own
                    own_linked += x.own_linked
                    own_commas += x.own_commas
                    inbox += x.inbox
        if node.tag == "a":
            linked, own_linked = length, own
        node.length, node.linked, node.commas = length, linked, commas
        node.own, node.own_linked, node.own_commas = own, own_linked, own_commas
        points = _points(node)
        node.inbox = inbox
        start = (_START.get(node.tag, 0.0) + (15.0 if node.good and node.block else 0.0)) if length else 0.0
        direct = node.tag not in _PARAGRAPHS
        node.score = inbox + start + (points if direct else 0.0)
        node.passed = (inbox + points) / 2 if direct else inbox / 2 + points
        node.gain = gain + points
        node.solid = solid + (points > 0 and own >= 80 and own_linked < 0.3 * own)
        node.core = core


def _cut_named(nodes: list[_Node]) -> bool:
    """Cuts what is named as a box or as readers' remarks. A box with over half of the page's
    points is a wrapper, if it holds the article's element, if no long paragraph stands outside it,
    or if next to nothing does; remarks stay only where there is no long paragraph besides."""
    total, solid, some = nodes[0].gain, nodes[0].solid, False
    for node in nodes:
        up = node.parent
        if up is not None and up.cut:
            node.cut = True  # so that nothing below is looked at
            continue
        if node.named and not node.cut:
            most = node.gain > total / 2
            if node.named == _REMARKS:
                keep = most and solid == node.solid
            else:
                keep = most and (node.core or solid == node.solid > 0 or node.gain >= 0.8 * total)
            if not keep:
                node.cut = some = True
    return some


def _text(node: _Node, out: list[str]) -> None:
    # explicit stack: broken pages nest deeply
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            out.append(x)
        elif x.__class__ is _Node and not x.cut:
            if x.block:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.items))


def best_container(nodes: list[_Node]) -> _Node | None:
    """The block with the most points by its share of text outside links; of equals the first."""
    best, most = None, 0.0
    for node in nodes:
        if node.block and node.score > 0:
            value = node.score * (1 - _density(node))
            if value > most:
                best, most = node, value
    return best


def extract_text(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    nodes = _order(root)
    measure(nodes)
    if _cut_named(nodes):
        nodes = _order(root)
        measure(nodes)
    if not root.length:
        return ""
    best = best_container(nodes)
    if best is None:
        best = next((n for n in nodes if n.tag == "body"), root)
    kept = [best]
    if best.parent is not None:
        most = best.score * (1 - _density(best))
        kept = []
        for x in best.parent.items:
            if x is best:
                kept.append(x)
            elif x.__class__ is _Node and not x.cut and x.length and x.block:
                density = _density(x)
                like = x.tag == best.tag and x.tag == "article"
                near = x.score * (1 - density) >= max(10.0, most * (0.2 if like or x.good == best.good else 0.5))
                reads = x.tag == "p" and ((x.length > 80 and density < 0.25) or (x.commas and density == 0))
                if near or reads or (x.tag == "h1" and density < 0.5):
                    kept.append(x)
    for node in kept:
        for inner in _order(node)[1:]:
            if inner.tag in ("ul", "ol", "div", "table", "section") and inner.length and _density(inner) > 0.5:
                inner.cut = True
    out: list[str] = []
    for node in kept:
        _text(node, out)
        out.append("\n")
    text = " ".join("".join(out).split())
    return _SURROGATE.sub("�", text) if not text.isascii() else text


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract_text(page) for page in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
