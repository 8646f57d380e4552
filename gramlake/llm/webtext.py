"""Main text of web pages by composite text density over the page's tree."""

from __future__ import annotations

import html
import itertools
import math
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gramlake.llm.common import map_texts, read

# Element names of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags that mark words inside a text, or items of a list, which is one text; they are not counted.
FORMAT = set("b big br cite code dd dt em font i li mark q s small span strike strong sub sup tt u wbr".split())
#: What a reader doesn't see as text: neither densities nor texts know of it.
UNSEEN = set("head script style textarea title noscript iframe xmp noembed noframes template button select option input label svg canvas audio video object embed map".split())
#: Elements and roles whose text is not the article's.
ASIDE = set("nav header footer aside form menu dialog".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: What a form is made of, and the characters for each of these that only a wrapper around a whole page has.
CONTROLS, CONTROL_CHARS = set("input select textarea button label option".split()), 250
MAIN, MAIN_ROLES = {"article", "main"}, {"article", "main"}
#: Elements that a start tag closes when one of them is open, up to the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words that begin or end the class and id names of blocks that are no part of an article; and those of names that only state something.
HINTS = set("ad ads advert adverts advertisement comment comments cookie cookies disqus newsletter notice promo sidebar sponsored subscribe".split())
STATES = set("close closed disabled enabled has hide is no off on open show with without".split())
#: Factor of the sums of densities inside the page's one article or main element.
NAMED = 4.0
#: Share of the article's sum of densities that a part beside it has at least; what has less is a minor part.
BESIDE = 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+(?:[A-Z](?![a-z]))*|[A-Z][a-z0-9]*")


class Node:
    __slots__ = ("tag", "parent", "children", "unseen", "aside", "main", "hinted", "apart", "named", "chars", "link_chars", "tags", "link_tags", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.children: list = []  # nodes and strings in page order
        self.unseen = tag in UNSEEN or (parent is not None and parent.unseen)
        self.aside, self.main, self.hinted = tag in ASIDE, tag in MAIN, False
        self.apart = self.named = False
        self.chars = self.link_chars = self.tags = self.link_tags = self.links = 0
        self.density = self.total = 0.0
        for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                self.unseen = True
            elif name == "role":
                self.aside |= value.lower().strip() in ASIDE_ROLES
                self.main |= value.lower().strip() in MAIN_ROLES
            elif name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _WORDS.findall(token)]
                    self.hinted |= bool(words) and (words[0] in HINTS or words[-1] in HINTS) and STATES.isdisjoint(words)
        self.main &= not self.hinted

    def seen(self) -> list[Node]:
        return [x for x in self.children if type(x) is Node and not x.unseen]


class _Open:
    """The open elements, and where those of each tag are among them: nothing looks through the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def end(self, tag: str) -> None:
        if self.places[tag]:
            self.cut(self.places[tag][-1])

    def close(self, tags: set[str], bounds: set[str]) -> None:
        """Close the outermost open element of ``tags`` above the last of ``bounds``."""
        last = max((self.places[b][-1] for b in bounds if self.places[b]), default=0)
        found = [self.places[t][i] for t in tags if (i := bisect_right(self.places[t], last)) < len(self.places[t])]
        if found:
            self.cut(min(found))


def parse(page: str) -> Node:
    """The page's tree, with the end tags that HTML implies; what nobody sees is marked, and so is all below it. Time grows with the page."""
    root = top = Node("html", None)
    opened = _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue  # comment or declaration
        tag = tag.lower()
        if closing:
            opened.end(tag)
            top = opened.stack[-1]
            continue
        if tag == "html" or (tag == "body" and opened.places["body"]):
            continue
        if tag in BLOCK and tag not in ("body", "li", "option"):
            opened.close({"p"}, {"button", "table", "td", "th", "caption"})
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
        elif tag == "body":
            opened.close({"head"}, set())
        top = opened.stack[-1]
        node = Node(tag, top, attributes)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            node.unseen = True
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCK - VOID:
            opened.push(node)
            top = node
    return root


def label(order: list[Node], hints: bool = True) -> None:
    """What lies apart from the article by its names, and what lies in the one article or main element; ``order`` has parents first.

    A block that is hinted lies apart, unless it is the body or holds the page's first heading or main element: then it's a wrapper. So
    is a form that holds one of these, or more than CONTROL_CHARS characters for each of its controls. Without ``hints`` only ASIDE elements lie apart.
    """
    head, controls, chars = {}, {}, {}
    for node in reversed(order):
        head[node] = node.tag == "h1" or node.main
        controls[node] = int(node.tag in CONTROLS)
        chars[node] = 0
        for x in node.children:
            if type(x) is str:
                chars[node] += len(x.strip())
            else:
                head[node] |= head.get(x, False) and not x.hinted
                controls[node] += controls.get(x, int(x.tag in CONTROLS))  # controls themselves aren't seen
                chars[node] += chars.get(x, 0)
    for node in order:
        inner = any(head.get(x, False) for x in node.children if type(x) is Node)
        if node.tag in ("form", "dialog") and (inner or chars[node] > CONTROL_CHARS * max(1, controls[node])):
            node.aside = False
        hinted = hints and node.hinted and node.tag not in ("html", "body") and not inner
        node.hinted = hinted
        node.apart = node.aside or hinted or (node.parent is not None and node.parent.apart)
    inside: dict[Node, Node | None] = {}
    for node in order:
        outer = inside.get(node.parent) if node.parent is not None else None
        inside[node] = outer or (node if node.main and not node.apart and chars[node] else None)
    named = {id(x) for x in inside.values() if x is not None}
    for node in order:
        node.named = len(named) == 1 and inside[node] is not None


def weigh(root: Node, hints: bool = True) -> list[Node]:
    """Counts, densities and sums of densities of every node that is seen, children before parents.

    A node's density is its characters per tag, itself included and FORMAT left out, times the logarithm of its characters per linked
    character and tags per link, to a base that grows with the page's share of linked text. Text that lies apart counts as linked.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.seen()
    label(order, hints)
    order.reverse()
    for node in order:
        for x in node.children:
            if type(x) is str:
                node.chars += len(x.strip())
            elif not x.unseen:
                node.chars += x.chars
                node.tags += x.tags + (x.tag not in FORMAT)
                node.links += x.links + (x.tag == "a")
    whole = order[-1].chars
    linked = {root: False}
    for node in reversed(order):  # parents before children
        own = linked[node] = node.aside or node.hinted or node.tag == "a" or (node.parent is not None and linked[node.parent])
        node.link_chars, node.link_tags = (node.chars, node.links) if own else (0, 0)
    for node in order:
        if not linked[node]:
            for x in node.seen():
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    share = order[-1].link_chars / whole if whole else 0.0
    for node in order:
        c, lc, t = node.chars, node.link_chars, node.tags + 1
        if c:
            base = 1 + math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, node.link_tags))) / math.log(base)
    for node in order:
        inner = node.seen()
        node.total = sum(x.density for x in inner) if any(x.tag in BLOCK for x in inner) else node.density / 2
    return order


def is_box(node: Node, threshold: float, minor: float) -> bool:
    """A block of links that is less dense than the threshold, one that is hinted, or a minor one of an ASIDE element."""
    if node.hinted:
        return True
    if node.aside:
        return node.total < minor
    return node.links > 2 and 2 * node.link_chars > node.chars and node.density < threshold


def main_nodes(root: Node) -> tuple[list[Node], float, float]:
    """The subtree with the largest sum of child densities and what lies beside its path as densely, in page order; the threshold; and a minor sum.

    Subtrees that lie apart don't compete; where nothing else has text, hints are left aside. Sums inside the page's one article or main
    element count NAMED times. The threshold is the least density on the way from that subtree to the body. A part beside the way belongs to the
    article if it holds blocks, reaches the threshold, and has BESIDE of the article's sum; none outside that one element does.
    """
    for hints in (True, False):
        nodes = weigh(root, hints)
        free = [x for x in reversed(nodes) if not x.apart and x.total > 0]
        if free and any(type(y) is str and y.strip() for x in free for y in x.children):
            break
    if not free:
        return [], 0.0, 0.0
    best = max(free, key=lambda x: x.total * (NAMED if x.named else 1.0))
    path = [*_ways_up(best)]
    threshold = min(x.density for x in path if x.chars)
    found = [best]
    for node, parent in itertools.pairwise(path):
        if best.named and not parent.named:
            break
        others = [x for x in parent.seen() if x is not node and x.density >= threshold and x.total >= BESIDE * best.total and not x.apart and any(y.tag in BLOCK for y in x.seen())]
        if others:
            kept = {id(x) for x in others}
            before = [x for x in itertools.takewhile(lambda x: x is not node, parent.children) if id(x) in kept]
            found = [*before, *found, *others[len(before) :]]
    return found, threshold, BESIDE * best.total


def _ways_up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def blocks(node: Node, threshold: float = 0.0, minor: float = 0.0) -> list[str]:
    """Text of the blocks in page order but for boxes, character references decoded and white space turned into single spaces."""
    out: list[str] = []
    line: list[str] = []

    def close():
        if line:
            text = "".join(line)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif type(x) is str:
            line.append(x)
        elif not x.unseen and (x is node or not is_box(x, threshold, minor)):
            if x.tag in BLOCK:
                close()
                todo.append(None)
            elif x.tag == "br":
                line.append(" ")
            todo += reversed(x.children)
    close()
    return out


def extract_text(page: str) -> str:
    found, threshold, minor = main_nodes(parse(page))
    return "\n".join(b for node in found for b in blocks(node, threshold, minor))


def extract_main_text(pages: DataFrame, html_column: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry``, text and n_chars (code points) of every page.

    The text is that of the subtree with the largest sum of text densities, without boxes of links or of other marked
    parts that are less dense than the way to it, and of parts beside it that are like it. Names of elements, roles and
    classes settle only what densities leave open. One pass, no shuffle; one page at a time. Null, empty and text-less pages give an empty text;
    unclosed and stray tags are read as HTML reads them; repeated rows are read each; other columns,
    whatever their names, are not read; an empty table gives no rows.
    """

    def work():
        def run(data, offsets):
            raw = data.tobytes()
            texts = [extract_text(raw[a:b].decode("utf-8")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

        return run

    return map_texts(pages, work, "text string, n_chars long", html_column, carry)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


QUERIES = {"op2_main_text": op2_main_text}
