"""HTML extraction by wrapper induction over the pages of a host.

A page's tree has a node for each block element, named by tag, class and id; inline elements belong to the text around them.
Trees of a host's pages are folded into a template by simple tree matching: of all order-keeping mappings of two trees the
one with most matched nodes, a node with the same text counting twice, aligns them, repeated siblings one by one. The
template counts the pages, letters and link letters of each node. A node is constant, so template, if its text was the same
on all pages that have it, on at least SHARE of those that have its parent, and if these differ: one of their three longest
texts takes CONSTANT values at least. All other nodes with text are slots. A page is aligned with its host's template and
each of its nodes takes the verdict of its partner there.

Slots are content if they lie in the page's main region: its article or main element, or, where it has none, what is left
after going down from the root for as long as one child has REGION of the slots' letters on that host (and, below SURE, half of them
on the page), stopping at a heading.
Slots that are links for the most part are no content outside an article. Zones of other use go whole: elements and roles
for it (nav, footer, aside, form ..), and names of it (ads, menus, comments ..). Names that articles use too (related,
discussion, form ..) count only where the template finds the zone's text constant or linked for the most part; so do, inside an
article of a host with a template, plain names of what an article may be about (search, login, menu ..: TOPICS).
Headings in an article may be the same everywhere ("Introduction"): such a one stays if content follows it. An article that
is constant for the most part is a copied article and no template.

Folding happens in each task first, then among partial templates FAN_IN at a time, so no task reads a host whole. A template
keeps its NODES most frequent nodes. Templates of BROADCAST bytes in all travel with the tasks; more meet the pages by host
in groups of about GROUP bytes of pages, one template for each group, so a host of any size is spread over many groups.

Defined cases. Null or empty html, and pages without content, give an empty text. A null or odd url has the empty host. A
host's only page has no constants. Repeated rows are extracted one by one and count as one page. Broken markup never fails:
unclosed elements end with their parents. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, of, stored, text_slices, texts

CONSTANT = 3
SHARE = 0.5
REGION, SURE = 0.7, 0.9
LINKS = 0.6
FAN_IN = 64
HELD = 2000
NODES = 400
DEPTH = 150
CELLS = 250_000
BROADCAST = 32 << 20
GROUP = 32 << 20

# Elements of HTML by their use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body button caption div footer form header html main nav object section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = frozenset("script style head meta link".split())
OTHER_USE = frozenset("nav header footer aside form script style noscript template head title button select option input textarea iframe object svg canvas audio video dialog menu noembed noframes".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of classes and ids. Of a name's words the last one that isn't about layout says what it is.
LAYOUT = frozenset("area section block box container wrapper wrap list item items slot unit bar inner outer panel group holder region zone left right top bottom links link buttons button body content".split())
STATES = frozenset("with has no is without js".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo nav navbar navigation menu menubar sidebar breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr "
    "notice notification alert popup modal overlay toast comment comments commentlist replies respond disqus share sharing social subscribe newsletter signup login search pager pagination toolbar".split()
)
TOPICS = frozenset("search pagination navigation login sharing menu social modal overlay".split())  # of OTHER_NAMES, what a technical article may have a section on
SHARED_NAMES = frozenset("header banner aside reply discussion related recommended subscription promotion sponsor form widget skip".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"display\s*:\s*none")
PARTIAL = pa.schema([("host", pa.string()), ("template", pa.string())])
DONE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
DONE_DDL = "page_id long, url string, text string, n_chars long"

# a template node is a list: its name, pages, text (a hash; "" for none, None where it varies), marks, letters, letters in links, children
K, N, T, S, A, L, C = range(7)


class Node:
    """An element. kids: the block elements next below it, those inside of its inline elements included."""

    __slots__ = ("tag", "name", "zone", "article", "depth", "parent", "children", "kids", "constant", "links", "like")

    def __init__(self, tag: str, name: str, zone: int, parent: Node | None):
        self.tag, self.name, self.zone, self.parent = tag, name, zone, parent
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.depth = parent.depth + 1 if parent is not None else 0
        self.children: list[Node | str] = []
        self.kids: list[Node] = []
        self.constant = self.links = False
        self.like: dict | None = None


def zone_of(names: str) -> int:
    """Of classes and ids: 2 if they name another use, 3 if that is what an article may have a section on, 1 if the name is one that articles use too, 0 else."""
    most = 0
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if not words or words[0] in STATES:
            continue
        while len(words) > 1 and words[-1] in LAYOUT:
            words.pop()
        if len(words) == 1 and words[0] in TOPICS:
            most = 3
        elif words[-1] in OTHER_NAMES or words[-1] in SHARED_NAMES and not OTHER_NAMES.isdisjoint(words):
            return 2
        elif not most and words[-1] in SHARED_NAMES or not most and words[0] in ("related", "recommended") and len(words) > 1:
            most = 1
    return most


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    name, zone = tag, 2 if tag in OTHER_USE else 0
    if tag == "header" and parent.article:
        zone = 0  # an article's own heading
    if attributes and not attributes.isspace() and attributes != "/":
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        named = " ".join(filter(None, (found.get("class"), found.get("id"))))
        if named.strip():
            name = f"{tag}.{re.sub(r'[0-9]+', '#', named).strip()}"
            if tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
                said = zone_of(named)
                zone = max(zone, said if said < 3 else 2) if said < 3 or zone or not parent.article else 3
        if found.get("role", "").lower() in OTHER_ROLES or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")) or "hidden" in found or "hidden" in ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split():
            zone = 2
    return Node(tag, f"{name}!{zone}" if zone else name, zone, parent)


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def parse(page: str) -> Node:
    """The page's tree. Text nodes are strings with character references decoded."""
    root = at = Node("#page", "#page", 0, None)
    here, n, flat = 0, len(page), 0
    while here < n:
        found = TOKEN.search(page, here)
        text = page[here : found.start()] if found else page[here:]
        if text:
            at.children.append(html.unescape(text))
        if not found:
            break
        here = found.end()
        close, tag, attributes = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if flat:
                flat -= tag not in INLINE
                continue
            for node in _up(at):
                if node.tag == tag:
                    at = node.parent
                    break
                if node.tag in SCOPES and tag in ("p", "li", "b", "i", "a", "span", "em", "strong", "td", "tr"):
                    break
            continue
        if tag in ENDS_P:
            for node in _up(at):
                if node.tag == "p":
                    at = node.parent
                    break
                if node.tag in SCOPES:
                    break
        elif tag in ("li", "td", "th", "tr", "option", "dt", "dd"):
            for node in _up(at):
                if node.tag == tag or (tag in ("dt", "dd") and node.tag in ("dt", "dd")):
                    at = node.parent
                    break
                if node.tag in ("ul", "ol", "table", "select", "dl") or node.tag in SCOPES and node.tag not in ("td", "th"):
                    break
        node = _opened(tag, attributes or "", at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, here)
            node.children.append(page[here : end.start() if end else n])
            here = end.end() if end else n
        elif tag not in VOID and not (attributes or "").endswith("/") or tag in ("div", "p", "span", "a"):
            if flat or at.depth >= DEPTH:  # what is nested deeper stays beside its parent, and its text is kept
                flat += tag not in INLINE
            else:
                at = node
    if not _articles(root, True):  # names don't hide a page's only article
        for node in _articles(root, False):
            if all(p.tag not in OTHER_USE for p in _up(node)):
                for p in _up(node):
                    p.zone = 0
    return root


def _articles(root: Node, clear: bool) -> list[Node]:
    """Outermost article and main elements; clear: those in no zone of other use."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if clear and node.zone == 2:
            continue
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            stack += [c for c in node.children if not isinstance(c, str)]
    return found


def squeezed(text: str) -> str:
    return " ".join(text.split())


def shape(root: Node) -> list:
    """A template made of one page. Its marks are hashes of the page's three longest texts."""
    longest: list[tuple[int, int]] = []

    def block(node: Node, linked: bool) -> list:
        own, letters, links, kids = [], 0, 0, []
        stack = [(node, linked or node.tag == "a")]
        while stack:
            one, inside = stack.pop()
            if isinstance(one, str):
                text = squeezed(one)
                if text:
                    own.append(text)
                    letters += len(text)
                    links += len(text) * inside
            elif one is node or one.tag in INLINE:
                inside = inside or one.tag == "a"
                stack += [(c, inside) for c in reversed(one.children)]
            elif one.tag not in NO_TEXT and one.tag != "br":
                node.kids.append(one)
                kids.append((one, inside))
        value = xxhash.xxh32_intdigest(" ".join(own).encode("utf-8", "surrogatepass")) if own else ""
        if own and node.tag not in RAW:
            longest.append((letters, value))
        return [node.name, 1, value, marks, letters, links, [block(c, w) for c, w in kids]]

    marks: list[list[int]] = []  # one list for all nodes; filled when all are known, and never changed by fold()
    tree = block(root, False)
    marks += [[value] for _, value in sorted(set(longest), reverse=True)[:3]]
    return tree


def alike(x: list, y: list) -> int:
    """What the pair of roots counts: 0 for different names, 2 if their texts are equal."""
    return 0 if x[K] != y[K] else 1 + (x[T] not in ("", None) and x[T] == y[T])


def matching(x: list, y: list, known: dict | None = None) -> int:
    """The greatest count of an order-keeping mapping of two trees."""
    known = {} if known is None else known
    weight = alike(x, y)
    if not weight or not x[C] or not y[C]:
        return weight
    key = id(x), id(y)
    if key not in known:
        pairs = align(x[C], y[C], known)
        known[key] = weight + sum(matching(x[C][i], y[C][j], known) for i, j in pairs)
    return known[key]


def _runs(nodes: list[list]) -> list[tuple[str, int, int]] | None:
    """(name, first, end) of stretches of one name; None if a name has several."""
    out, at = [], 0
    while at < len(nodes):
        end = at + 1
        while end < len(nodes) and nodes[end][K] == nodes[at][K]:
            end += 1
        out.append((nodes[at][K], at, end))
        at = end
    return out if len({r[0] for r in out}) == len(out) else None


def align(a: list[list], b: list[list], known: dict | None = None) -> list[tuple[int, int]]:
    """Pairs of matched children, in order, of the mapping with the greatest count."""
    if not a or not b:
        return []
    known = {} if known is None else known
    first, second = _runs(a), _runs(b)
    if first and second:
        texts_of = {x[T] for x in b if x[T]}
        single = all(e - s == 1 for runs in (first, second) for _, s, e in runs)
        if single or not any(x[T] in texts_of for x in a if x[T]) and not any(x[C] for x in a if x[C]):
            order = {k: i for i, (k, _, _) in enumerate(second)}
            common = [order[k] for k, _, _ in first if k in order]
            if common == sorted(common):  # no name's partners cross another's, so each takes as many as there are
                where = {k: (s, e) for k, s, e in second}
                return [(s + i, where[k][0] + i) for k, s, e in first if k in where for i in range(min(e - s, where[k][1] - where[k][0]))]
    if len(a) * len(b) > CELLS:
        return _long(a, b)
    gain = np.array([[matching(x, y, known) if x[K] == y[K] else 0 for y in b] for x in a], np.int32)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + gain[i]))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _long(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """For lists too long for a table of CELLS: nodes of equal text in rising order, and between them those of equal names in turn."""
    once = lambda nodes: {key: i for i, key in enumerate((x[K], x[T]) for x in nodes) if key[1]}
    left, right = once(a), once(b)
    shared = sorted((i, right[key]) for key, i in left.items() if key in right)
    tails, ends, back = [], [], [-1] * len(shared)
    for n, (_, j) in enumerate(shared):
        at = bisect.bisect_left(tails, j)
        back[n] = ends[at - 1] if at else -1
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
    anchors, n = [], ends[-1] if ends else -1
    while n >= 0:
        anchors.append(shared[n])
        n = back[n]
    pairs, p, q = [], 0, 0
    for i, j in [*anchors[::-1], (len(a), len(b))]:
        later: dict[str, list[int]] = {}
        for y in range(j - 1, q - 1, -1):
            later.setdefault(b[y][K], []).append(y)
        at = q
        for x in range(p, i):
            own = later.get(a[x][K], [])
            while own and own[-1] < at:
                own.pop()
            if own:
                at = own.pop() + 1
                pairs.append((x, at - 1))
        if i < len(a):
            pairs.append((i, j))
        p, q = i + 1, j + 1
    return pairs


def fold(x: list, y: list) -> list:
    """Both templates of one host in one. A text that differs anywhere is None, and has no marks."""
    return _folded(x, y, {})


def _folded(x: list, y: list, known: dict) -> list:
    same = x[T] is not None and x[T] == y[T]
    marks = None
    if same and x[T] != "":
        ranks = max(len(x[S]), len(y[S]))
        marks = [sorted({*(x[S][r] if r < len(x[S]) else ()), *(y[S][r] if r < len(y[S]) else ())})[:CONSTANT] for r in range(ranks)]
    children, i, j = [], 0, 0
    for p, q in [*align(x[C], y[C], known), (len(x[C]), len(y[C]))]:
        children += x[C][i:p]
        children += y[C][j:q]
        if p < len(x[C]):
            children.append(_folded(x[C][p], y[C][q], known))
        i, j = p + 1, q + 1
    return [x[K], x[N] + y[N], x[T] if same else None, marks, x[A] + y[A], x[L] + y[L], children]


def pruned(template: list, most: int = NODES) -> list:
    """The template with so many nodes at most: those on the fewest pages go first, leaves before their parents; among equals a hash of the node decides."""
    while True:
        size, leaves, stack = 0, [], [template]
        while stack:
            node = stack.pop()
            size += 1
            for i, child in enumerate(node[C]):
                if not child[C]:
                    leaves.append((child[N], xxhash.xxh32_intdigest(f"{child[K]} {child[T]}".encode("utf-8", "surrogatepass")), id(node), i))
            stack += node[C]
        if size <= most or not leaves:
            return template
        gone = {x[2:] for x in sorted(leaves)[: size - most]}

        def without(node: list) -> list:
            return [*node[:C], [without(c) for i, c in enumerate(node[C]) if (id(node), i) not in gone]]  # noqa: B023

        template = without(template)


def verdicts(template: list) -> dict:
    """The template's judgement of each node: constant, links, zone, letters (of the slots at and below it), and the same of its children (c)."""

    def judge(node: list, parent: list | None, copied: bool) -> dict:
        enough = parent is None or node[N] >= SHARE * parent[N]
        constant = not copied and enough and node[T] not in ("", None) and any(len(r) >= CONSTANT for r in node[S] or ())
        out = {"constant": constant, "links": node[A] > 0 and node[L] > LINKS * node[A], "n": node[N]}
        out["c"] = [judge(c, node, copied) for c in node[C]]
        out["all"] = node[A] + sum(c["all"] for c in out["c"])
        out["linked"] = node[L] + sum(c["linked"] for c in out["c"])
        out["fixed"] = node[A] * constant + sum(c["fixed"] for c in out["c"])
        zone = int(node[K][-1]) if node[K][-2:] in ("!1", "!2", "!3") else 0
        out["zone"] = zone == 2 or zone == 3 and template[N] < CONSTANT or zone in (1, 3) and (out["linked"] > LINKS * out["all"] or 2 * out["fixed"] > out["all"])
        own = 0 if constant or out["links"] else node[A] - node[L]
        out["letters"] = 0 if out["zone"] else own + sum(c["letters"] for c in out["c"])
        if not copied and node[K].split(".")[0] in ("article", "main") and 2 * out["fixed"] > out["all"]:
            return judge(node, parent, True)
        return out

    return judge(template, None, False)


def _judged(root: Node, page: list, template: list, judgement: dict) -> None:
    """Give the page's nodes the verdicts of their partners in the template."""
    known: dict = {}
    stack = [(root, page, template, judgement)]
    while stack:
        node, own, other, said = stack.pop()
        node.like = said
        node.constant = said["constant"] and own[T] == other[T]
        node.links = said["links"]
        if node.zone in (1, 3):
            node.zone = 2 if said["zone"] else 0
        stack += [(node.kids[i], own[C][i], other[C][j], said["c"][j]) for i, j in align(own[C], other[C], known)]


def _alone(root: Node, page: list) -> None:
    """Shared names, and topics' names, of nodes that the template lacks: links alone decide; where there is no template, topics go."""
    stack, none = [(root, page)], root.like is None or root.like["n"] < CONSTANT
    while stack:
        node, own = stack.pop()
        if node.like is None and node.zone in (1, 3):
            node.zone = 2 if node.zone == 3 and none or verdicts(own)["linked"] > LINKS * sum(_letters(own)) else 0
        stack += zip(node.kids, own[C], strict=True)


def _letters(page: list):
    stack = [page]
    while stack:
        node = stack.pop()
        yield node[A]
        stack += node[C]


def _heads(node: Node) -> bool:
    """Whether a heading with a text of its own is in a subtree."""
    stack = [node]
    while stack:
        one = stack.pop()
        if one.zone == 2:
            continue
        if one.tag in HEADINGS and not one.constant:
            return True
        stack += one.kids
    return False


def _region(root: Node, page: list) -> Node:
    """Where the slots' text is: down from the root while one child has REGION of it on the host, and no heading stays behind."""
    node, own = root, page
    while node.like is not None and node.like["n"] >= CONSTANT:
        open_ = [(k, s) for k, s in zip(node.kids, own[C], strict=True) if k.like is not None and k.zone != 2]
        best = max(open_, key=lambda x: x[0].like["letters"], default=None)
        if best is None or best[0].like["letters"] < REGION * node.like["letters"]:
            break
        here = {id(k): sum(_letters(s)) for k, s in zip(node.kids, own[C], strict=True) if k.zone != 2 and not k.constant and not k.links}
        few = 2 * here.get(id(best[0]), 0) < sum(here.values()) + (0 if node.constant else own[A])
        if few and best[0].like["letters"] < SURE * node.like["letters"] or any(_heads(k) for k in node.kids if k is not best[0]):
            break
        node, own = best
    return node


def extract(page: str, template: list | None, judgement: dict | None = None) -> str:
    """The page's main text by its host's template; a page without one is its own."""
    root = parse(page)
    own = shape(root)
    template = own if template is None else template
    _judged(root, own, template, judgement or verdicts(template))
    _alone(root, own)
    regions = _articles(root, True)
    blocks: list[str] = []
    held: list[str] = []  # a heading that is the same on all pages, until content follows
    text: list[str] = []
    inside = bool(regions)
    wanted = {id(x) for x in regions} if inside else {id(_region(root, own))}

    def flush() -> None:
        block = squeezed("".join(text))
        text.clear()
        if block:
            blocks.extend(held)
            held.clear()
            blocks.append(block)

    def collect(node: Node, here: bool, skip: bool) -> None:
        here, skip = here or id(node) in wanted, skip or node.zone == 2
        heading = node.tag in HEADINGS
        if heading or skip:
            held.clear()
        if here and not skip and inside and heading and node.constant:
            held[:] = [squeezed("".join(_all_text(node)))]
            return
        stack = [iter(node.children)]
        while stack:
            child = next(stack[-1], stack)
            if child is stack:
                stack.pop()
            elif isinstance(child, str):
                if here and not skip and not node.constant and (inside or not node.links):
                    text.append(child)
            elif child.tag in INLINE:
                if child.zone != 2:
                    stack.append(iter(child.children))
            elif child.tag in ("br", "wbr"):
                text.append(" ")
            elif child.tag not in NO_TEXT:
                flush()
                collect(child, here, skip)
                flush()

    collect(root, False, False)
    flush()
    return " ".join(blocks)


def _all_text(node: Node):
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag not in NO_TEXT:
            yield from _all_text(c)


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """host, template (JSON) of every host."""

    def packed(held: dict[str, list]) -> pa.RecordBatch:
        return of(PARTIAL, host=list(held), template=[json.dumps(t, separators=(",", ":")) for t in held.values()])

    def learn(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for piece in text_slices(batch, "html"):
                for host, page in zip(piece.column("host").to_pylist(), texts(piece, "html"), strict=True):
                    one = shape(parse(page))
                    held[host] = pruned(fold(held[host], one) if host in held else one)
                if len(held) > HELD:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def merge(key, group):
        out = None
        for t in group.column("template").to_pylist():
            out = json.loads(t) if out is None else pruned(fold(out, json.loads(t)))
        return pa.Table.from_batches([packed({key[0].as_py(): out})])

    now = stored(_hosts(pages).select("host", "html").mapInArrow(learn, "host string, template string"), "wrappers")
    while True:
        most = now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).collect()[0]["n"] or 0
        if most <= 1:
            return now
        turn = F.pmod(F.xxhash64("template"), F.lit(-(-most // FAN_IN))) if most > FAN_IN else F.lit(0)
        merged = stored(now.withColumn("turn", turn).groupBy("host", "turn").applyInArrow(merge, "host string, template string"), "wrappers")
        discard(now)
        now = merged


def _done(rows: pa.RecordBatch, template_of) -> pa.RecordBatch:
    out = [extract(page, *template_of(host)) for host, page in zip(rows.column("host").to_pylist(), texts(rows, "html"), strict=True)]
    return of(DONE, page_id=rows.column("page_id"), url=rows.column("url"), text=out, n_chars=[len(t) for t in out])


def _opened_template(text: str) -> tuple[list, dict]:
    template = json.loads(text)
    return template, verdicts(template)


def main_text(pages: DataFrame, most: int = BROADCAST, group: int = GROUP) -> DataFrame:
    """The contract's rows: page_id, url, text, n_chars."""
    rows, found = _hosts(pages), templates(pages)
    size = found.agg(F.sum(F.octet_length("template") + F.octet_length("host")).alias("n")).collect()[0]["n"] or 0
    if size <= most:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})

        def apply(batches):
            opened: dict[str, tuple] = {}

            def template_of(host: str) -> tuple:
                if host not in opened:
                    if len(opened) > HELD:
                        opened.clear()
                    opened[host] = _opened_template(sent.value[host])
                return opened[host]

            for batch in batches:
                for piece in text_slices(batch, "html"):
                    yield _done(piece, template_of)

        return rows.mapInArrow(apply, DONE_DDL)

    # a host has as many groups as its pages need; its template goes to each of them once
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("n")).select("host", F.floor(F.col("n") / group + 1).cast("long").alias("groups"))
    dealt = rows.join(sizes, "host").withColumn("turn", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("groups"))).drop("groups")
    copies = found.join(sizes, "host").select("host", "template", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("turn"))

    def together(own, other):
        opened = _opened_template(other.column("template")[0].as_py()) if other.num_rows else (None, None)
        return pa.Table.from_batches([_done(piece, lambda host: opened) for batch in own.combine_chunks().to_batches() for piece in text_slices(batch, "html")], DONE)

    return dealt.groupBy("host", "turn").cogroup(copies.groupBy("host", "turn")).applyInArrow(together, DONE_DDL)
