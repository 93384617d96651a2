"""Main text of HTML pages by composite text density.

The page is read into a tree. Each node has its text characters C, tags T, link characters LC and link
tags LT, and with the body's CB and LCB the density

    C / T * log[ln(C * LC / (C - LC) + LCB * C / CB + e)] (C * T / (LC * LT))

(counts of links at least 1). A node's density sum is that of its children; the node of largest sum
holds the text. The least density on its way up to the body is the threshold: on each step of that way,
further children of the node reached are taken whose density passes the threshold and whose sum is
at least ``SHARE`` of the largest, so that an article in several sections comes whole. The body's own sum counts
what it holds outside of containers; if that is the largest, its containers must pass the same two tests.

What the HTML standard gives another purpose (navigation, asides, footers, scripts, controls, and such
roles) is never text. Forms, page heads and class names that speak of adverts, comments and the like are only
evidence: densities inside them count ``DOUBT`` times, and inside a taken node they are left out unless they
hold half of its text. A class name speaks only if all its words do ("related-work" does not). Lists of
links (density zero) are left out as menus.

Blocks of the taken nodes are given in page order: references decoded, white space inside a block
one space, blocks joined by an empty line.

Cases: a null or empty page, or one without text, gives the empty text; text outside any element
counts to the body; unclosed and crossed elements are closed as their parents end; an unclosed comment or an
unclosed element of raw text other than scripts and styles is passed over and the rest read on; repeated rows
each get a row; an empty table gives no rows. Pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of densities inside what looks like boilerplate.
DOUBT = 0.2
#: Least part of the largest sum that a further subtree must have.
SHARE = 0.1

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CUT = frozenset("nav aside footer button dialog menu head template noscript select datalist svg audio video canvas".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CELLS = frozenset(("td", "th", "br"))
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Elements that are parts of a text rather than hold one.
PARTS = HEADINGS | frozenset("p b i em strong span a li ul ol dl dt dd tr td th tbody thead tfoot table blockquote pre figure figcaption details center".split())
#: A new element of the key's kind ends the open element of these in the same scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements inside which those of the value are a new scope.
SCOPES = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("p", "tr", "td", "th"), "tr": ("td", "th"), "td": ("p",), "th": ("p",), "button": ("p",), "select": ("option",), "svg": ("p",)}
TRACKED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "svg"))

#: Words of class names and ids that speak of what isn't the article,
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus reply replies respond cookie cookies consent notice notices popup modal newsletter subscribe signup login "
    "share sharing social related recommended pagination pager toolbar skip masthead topbar header".split()
)
#: and words that may stand beside them.
FILLERS = frozenset(
    "a and area author bar block body bottom box button buttons center column col container content first footer form global group header icons inline inner "
    "item items last left link links list main message module my news next of on page panel post posts prev primary reader right row secondary section site "
    "slot small sticky text the this thread to top unit user view widget widgets wrap wrapper".split()
)

#: Marks of what readers write; such elements are never text, even where class names tell nothing else.
READERS = frozenset("comment comments disqus reply replies respond".split())

#: Whole class names and ids of heads; inside an article they may hold its title.
HEADS = frozenset("header site-header page-header site_header page_header masthead topbar".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
MARKED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=$|[\s"'/])""", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    __slots__ = ("name", "parent", "children", "cut", "doubt", "open", "chars", "tags", "link_chars", "link_tags", "heads", "density", "total", "best")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, doubt: bool = False):
        self.name, self.parent, self.cut, self.doubt = name, parent, cut, doubt
        self.children: list = []
        self.open: dict[str, Node | None] = parent.open if parent else {}
        self.chars = self.tags = self.link_chars = self.link_tags = self.heads = 0
        self.density = self.total = 0.0
        self.best = self


def speaks(token: str) -> bool:
    """Whether each word of a class name is a mark or may stand beside one, and one is a mark."""
    words = [w.lower() for w in PART.findall(token)]
    return any(w in MARKS for w in words) and all(w in MARKS or w in FILLERS for w in words)


def of_readers(token: str) -> bool:
    """Whether a class name speaks of readers' comments."""
    return speaks(token) and any(w.lower() in READERS for w in PART.findall(token))


def unwanted(name: str, attributes: str, inside: bool = False, by_name: bool = True) -> tuple[bool, bool]:
    """Whether an element is never text by its kind, role or state (or as readers' comments), and whether it is doubtful by its kind, class or id.

    Names of heads aren't doubtful ``inside`` an article or main element.
    """
    cut, doubt = name in CUT, name == "form"
    if not attributes or name in ("html", "body", "article", "main"):
        return cut, doubt
    for key, a, b, c in MARKED.findall(attributes):
        key, value = key.lower(), a or b or c
        low = value.lower()
        if key == "role":
            cut, doubt = cut or low in ROLES - {"form", "banner"}, doubt or low in ("form", "banner")
        elif key == "hidden" or (key == "style" and "display:none" in low.replace(" ", "")):
            cut = True
        elif key in ("class", "id"):
            cut = cut or (name not in HEADINGS and any(map(of_readers, value.split())))
            doubt = doubt or by_name and any(speaks(x) and not (inside and x.lower() in HEADS) for x in value.split())
    return cut, doubt


class Scanner:
    """Markup of a page from left to right; what fails to end once isn't sought again, so time stays linear."""

    def __init__(self, page: str):
        self.page, self.comments, self.quotes = page, True, True

    def tag_end(self, pos: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``pos``, or -1."""
        at = pos
        while self.quotes:
            m = STOP.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            if self.page[pos : m.start()][-64:].rstrip().endswith("="):
                at = self.page.find(m[0], m.end())
                if at < 0:
                    break
                at += 1
            else:
                at = m.end()
        self.quotes = False
        return self.page.find(">", pos)

    def next(self, pos: int) -> tuple[int, int, str, str, bool] | None:
        """Start, end, name (empty: no element), attributes and whether it is an end tag, of the next markup from ``pos``."""
        page = self.page
        while (start := page.find("<", pos)) >= 0:
            lead = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2) if self.comments else -1
                if end >= 0:
                    return start, end + 3, "", "", False
                self.comments = False
                return start, start + 4, "", "", False
            closing = lead == "/"
            m = NAME.match(page, start + 1 + closing)
            if m:
                end = self.tag_end(m.end())
                if end >= 0:
                    return start, end + 1, m[0].lower(), page[m.end() : end], closing
                return None
            if lead in ("!", "?") or closing:
                end = page.find(">", start)
                if end >= 0:
                    return start, end + 1, "", "", False
                return None
            pos = start + 1
        return None


def parse(page: str, by_name: bool = True) -> Node:
    """The page's body as a tree of nodes and strings."""
    body = at = Node("body", None)
    count, scanner, pos, n, raw_ends = {"body": 1}, Scanner(page), 0, len(page), {}

    def leave(node: Node) -> Node:
        """Closes what is open up to and with ``node``."""
        x = at
        while x is not node:
            count[x.name] -= 1
            x = x.parent
        count[node.name] -= 1
        return node.parent

    def add(text: str) -> None:
        if text and not at.cut:
            at.children.append(html.unescape(text))

    while pos < n:
        found = scanner.next(pos)
        if found is None:
            add(page[pos:])
            break
        start, end, name, attributes, closing = found
        add(page[pos:start])
        pos = end
        if not name or (name in ("html", "body") and not closing):
            continue
        if closing:
            if name == "br" or (name == "p" and not count.get("p")):
                add(" ")
            elif name not in ("body", "html") and count.get(name):
                x = at
                while x.name != name:
                    x = x.parent
                at = leave(x)
            continue
        if name in BLOCK:
            for kind in ("svg", "p"):  # a block ends an open paragraph, and can't stand in a drawing
                if (shut := at.open.get(kind)) is not None:
                    at = leave(shut)
        for kind in ENDS.get(name, ()):
            if (shut := at.open.get(kind)) is not None:
                at = leave(shut)
        cut, doubt = unwanted(name, attributes, bool(count.get("article") or count.get("main")), by_name)
        node = Node(name, at, at.cut or cut, doubt)
        if not at.cut:
            at.children.append(node)
        if name in VOID or (attributes.endswith("/") and name not in BLOCK and name not in RAW):
            continue
        if name in RAW:
            if raw_ends.get(name, 0) >= 0:
                m = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, pos)
                raw_ends[name] = m.end() if m else -1
            if raw_ends[name] >= 0:
                pos = raw_ends[name]
            elif name in ("script", "style"):
                break
            continue
        changed = dict.fromkeys(SCOPES.get(name, ()))
        if name in TRACKED:
            changed[name] = node
        if changed:
            node.open = {**node.open, **changed}
        count[name] = count.get(name, 0) + 1
        at = node
    return body


def in_order(root: Node) -> list[Node]:
    """Wanted nodes, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [c for c in reversed(node.children) if type(c) is Node and not c.cut]
    return found


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all wanted nodes; they are returned parents first."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if type(c) is str:
                node.chars += len("".join(c.split()))
            elif not c.cut:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
                node.heads += c.heads + (c.name in HEADINGS)
        if node.name == "a":
            node.link_chars = node.chars
    links = root.link_chars / root.chars if root.chars else 0.0
    doubted: dict[int, bool] = {}
    for node in nodes:
        doubted[id(node)] = inside = node.doubt or (node.parent is not None and doubted.get(id(node.parent), False))
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            bottom = math.log(math.log(c * lc / max(c - node.link_chars, 1) + links * c + math.e))
            node.density = c / t * max(math.log(max(c * t / (lc * lt), 1.0)), 0.0) / bottom * (DOUBT if inside else 1.0)
    for node in nodes[1:]:
        node.parent.total += node.density
    for node in reversed(nodes[1:]):  # the node of largest sum in each subtree, the outermost of equals
        if node.best.total > node.parent.best.total or (node.best.total == node.parent.best.total and node.parent.best is not node.parent):
            node.parent.best = node.best
    return nodes


def leads(node: Node) -> bool:
    """Whether a header is a text's own: it has a heading and is not mostly links."""
    return node.heads > 0 and 2 * node.link_chars <= node.chars


def at_edge(node: Node, over: Node) -> bool:
    """Whether a list of links stands before all text of ``over``, or behind all of it without a heading of its own."""
    ahead = behind = False
    last: Node | str | None = None  # what stands right before
    while node is not over:
        before = True
        nearest: Node | str | None = None
        for c in node.parent.children:
            if c is node:
                before = False
            elif (c.strip() if type(c) is str else not c.cut and c.chars):
                if before:
                    ahead, nearest = True, c
                else:
                    behind = True
        last = last or nearest
        node = node.parent
    return not ahead or (not behind and not (type(last) is Node and last.name in HEADINGS))


def holder(node: Node, root: Node) -> Node:
    """From a part of a text to what holds it."""
    while node.name in PARTS and node is not root:
        node = node.parent
    return node


def chosen(root: Node) -> tuple[set[int], set[int]]:
    """Identities of the nodes to give whole, and of those below them to leave out."""
    nodes = measure(root)
    containers = [c for c in root.children if type(c) is Node and not c.cut and c.name not in PARTS]
    inner = max((c.best for c in containers), key=lambda x: x.total, default=root)
    kept = {id(c) for c in containers}
    # the body itself only for the text that it holds outside containers
    own = sum(len("".join(c.split())) if type(c) is str else 0.0 if c.cut or id(c) in kept else c.density for c in root.children)
    top = holder(root if own >= inner.total else inner, root)
    threshold, way, step = top.density, [], top
    while step is not root:
        step = step.parent
        way.append(step)
        threshold = min(threshold, step.density)
    taken, dropped = {id(top)}, set()
    holds = {id(x) for x in (top, *way)}

    def passes(node: Node) -> bool:
        return node.density >= threshold and 0 < SHARE * top.best.total <= node.best.total

    for above in way:  # further parts of the same text beside what is taken
        before, within = True, above.name in ("article", "main")
        for c in above.children:
            if type(c) is str:
                continue
            if id(c) in holds:
                before = False
            elif not c.cut and c.chars:
                title = before and 2 * c.link_chars <= c.chars and (c.name == "h1" or (c.name in HEADINGS and above is not root))
                head = before and c.name == "header" and above is not root and leads(c)
                if title or head or (within and not c.doubt and c.density > 0) or (c.name != "header" and not c.doubt and passes(c)):
                    taken.add(id(c))
    if top is root:
        dropped |= {id(c) for c in containers if c.name == "header" or (c.name in BLOCK and own and not passes(c))}
    under: dict[int, Node] = {}  # the taken node over each node
    nested: set[int] = set()  # what stands inside an article
    for node in nodes:
        if node.parent is not None and (node.parent.name == "article" or id(node.parent) in nested):
            nested.add(id(node))
        over = node if id(node) in taken else under.get(id(node.parent)) if node.parent else None
        if over is None or id(node) in dropped:
            continue
        if node is not over and 2 * node.chars < over.chars:
            menu = node.name in BLOCK and node.link_tags >= 3 and 5 * node.link_chars >= 4 * node.chars and at_edge(node, over)
            reader = node.name == "article" and id(node) in nested  # an article inside an article is a comment on it
            if menu or reader or (node.name == "header" and not leads(node)) or (node.doubt and node.name not in HEADINGS and not (node.name == "header" and leads(node))):
                dropped.add(id(node))
                continue
        under[id(node)] = over
    return taken, dropped


def blocks(root: Node, taken: set[int], dropped: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks of taken nodes without dropped ones, in page order."""
    found, line = [], []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            found.append(text)

    todo: list = [(root, id(root) in taken, False)]
    while todo:
        item, on, leaving = todo.pop()
        if type(item) is str:
            if on:
                line.append(item)
            continue
        if item.cut or id(item) in dropped:
            if on and item.name in BLOCK:
                end()
            continue
        on = on or id(item) in taken
        if item.name in BLOCK:
            end()
        elif item.name in CELLS:
            line.append(" ")
        if not leaving:
            todo.append((item, on, True))
            todo += [(c, on, False) for c in reversed(item.children)]
    end()
    return found


def main_text(page: str | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    for by_name in (True, False):  # class names may be given to everything: then they tell nothing
        root = parse(page, by_name)
        found = blocks(root, *chosen(root))
        if found:
            return "\n\n".join(found)
    return ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every page."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    plain = pages.select(F.col(html_col).alias("_page"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column("_page").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_{k}") for k in range(len(keep))], texts], names=[*keep, "text"])

    return plain.mapInArrow(run, f"{kinds}, text string")
