"""Main-text extraction with a tree-structured graphical model over the DOM.

Each block element of a page is a node with a hidden label: content or not. A
node's potential comes from its tag, class and id words, text length and share
of link text; a parent-child potential joins the labels along every edge of the
tree. Sum-product messages, once upward and once downward, give each node's
exact content marginal; text stays where it is one half or more. Weights are
trained by gradient ascent of the conditional likelihood on labelled pages,
which `labelled_pages` makes from layouts (menus, headers, sidebars, notices,
adverts, forms, comments and articles), or on pages handed in by the caller.

A page takes time in proportion to its length, whatever its markup: tags are
closed by the places of the open ones, and wrappers around a single element are
contracted before the tree is judged.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, values

#: Comments and the like; else a tag with its attributes. As in browsers a quote opens a value only after `=`, and one
#: that is never closed is an ordinary character. Possessive, so that no text makes it try twice.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+|[^>=]++)*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")
#: Text in these is no markup, up to the closing tag or the end of the page.
_RAW = frozenset(("script", "style", "iframe", "noembed", "noframes", "textarea", "title"))
#: These are not shown; without a closing tag only the opening one is left out.
_HIDDEN = frozenset(("noscript", "template", "svg"))
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW | _HIDDEN}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msqrt msub msubsup msup mtext object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
#: An opening tag ends an open element of these, up to the nearest of the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements that a closing tag doesn't reach through.
_WALLS = frozenset("table td th article section aside nav header footer main form div body html".split())


#: Elements that say nothing by themselves, and how many of their names pass to a single element inside.
_PLAIN = frozenset("div section center".split())
_MOST_WORDS = 40
#: Names of layout, which are no feature.
_NEUTRAL = frozenset("wrap wrapper row col column columns container grid inner outer layout box block section left center right site app root hold area item list".split())


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    texts: list[tuple[int, str]] = field(default_factory=list)  # (number of the block, text)
    chars: int = 0
    link_chars: int = 0


def parse(source: str) -> list[Node]:
    """Block elements in page order; parents come first. Inline elements belong to their block."""
    nodes = [Node("#root", -1)]
    open_, piece = [0], []  # numbers of open blocks; text of the block so far
    places: dict[str, list[int]] = {"#root": [0]}  # of each tag in open_, so that no tag is looked for one by one
    unclosed: set[str] = set()  # hidden or raw elements that no closing tag follows any more
    n_blocks, links = 0, 0

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(k: int) -> None:
        while len(open_) > k:
            places[nodes[open_.pop()].tag].pop()

    def flush() -> None:
        nonlocal n_blocks
        if piece:
            text = "".join(piece)
            piece.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                node = nodes[open_[-1]]
                node.texts.append((n_blocks, text))
                node.chars += len(text)
                n_blocks += 1

    def put(text: str) -> None:
        if text:
            piece.append(text)
            if links:
                nodes[open_[-1]].link_chars += len(text)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _CLOSE:
            if m[1] or m[0].endswith("/>"):
                continue
            close = None if tag in unclosed else _CLOSE[tag].search(source, at)
            if close:
                at = source.find(">", close.end()) + 1 or end
            elif tag in _RAW:
                at = end
            else:
                unclosed.add(tag)
        elif tag in _INLINE:
            if tag == "br":
                piece.append(" ")
            elif tag == "a":
                links = 0 if m[1] else 1
        elif m[1]:
            if places.get(tag):
                k = places[tag][-1]
                if tag in _WALLS or last(_WALLS) < k:
                    flush()
                    cut(k)
                    links = 0
            else:
                flush()
        else:
            flush()
            links = 0
            if tag == "html" and len(open_) > 1:
                continue
            if nodes[open_[-1]].tag == "p":  # any block ends a paragraph
                cut(len(open_) - 1)
            if tag in _CLOSES:
                ends, walls = _CLOSES[tag]
                wall = last(walls)
                above = [x for t in ends if places.get(t) for x in places[t][bisect_right(places[t], wall) :][:: 1 if tag in ("tr", "tbody") else -1][:1]]
                if above:
                    cut(min(above) if tag in ("tr", "tbody") else max(above))
            words = tuple(w for x in _NAMED.findall(m[3]) for w in _LETTERS.findall("".join(x).lower())) if m[3] else ()
            nodes.append(Node(tag, open_[-1], words))
            if tag not in _VOID and not m[0].endswith("/>"):
                places.setdefault(tag, []).append(len(open_))
                open_.append(len(nodes) - 1)
    flush()
    return nodes


def contract(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """Without plain elements around a single element and no text, and the numbers of those that stay.

    Such an element says nothing but by its names, which pass to the one inside:
    so however deep the wrappers, the tree of a page is the same.
    """
    children = [0] * len(nodes)
    for x in nodes[1:]:
        children[x.parent] += 1
    to, stay = [0] * len(nodes), []  # the number, among those that stay, of the element that stands for each
    out: list[Node] = []
    names: dict[int, tuple[str, ...]] = {}
    for i, x in enumerate(nodes):
        own = names.get(x.parent, ()) + x.words
        if i and x.tag in _PLAIN and children[i] == 1 and not x.texts:
            to[i] = to[x.parent]
            names[i] = own[-_MOST_WORDS:]
        else:
            to[i] = len(out)
            out.append(Node(x.tag, to[x.parent] if i else -1, own, x.texts, x.chars, x.link_chars))
            stay.append(i)
    return out, stay


def features(node: Node) -> tuple[str, ...]:
    size = 0 if not node.chars else 1 + min(6, node.chars.bit_length() // 2)
    share = 0 if not node.link_chars else 1 + min(2, 3 * node.link_chars // max(1, node.chars))
    return ("1", f"t={node.tag}", f"n={size}", f"l={share}", *sorted({f"w={w}" for w in node.words if w not in _NEUTRAL}))


def _logsum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


@dataclass
class Model:
    """weight: of features for content; edge[parent][child]: log potentials."""

    weight: dict[str, float] = field(default_factory=dict)
    edge: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def marginals(self, nodes: list[Node], feats: list[tuple[str, ...]] | None = None, pairs: bool = True) -> tuple[list[float], list[list[list[float]]]]:
        """P(content) of each node, and, with `pairs`, P(parent's label, own label) of each node."""
        w, e = self.weight, self.edge
        n = len(nodes)
        own = [sum(w.get(f, 0.0) for f in (feats[i] if feats else features(nodes[i]))) for i in range(n)]
        up0, up1 = [0.0] * n, list(own)  # the node's potential times the messages from below
        to0, to1 = [0.0] * n, [0.0] * n  # its message to the parent
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            to0[i] = _logsum(e[0][0] + up0[i], e[0][1] + up1[i])
            to1[i] = _logsum(e[1][0] + up0[i], e[1][1] + up1[i])
            up0[p] += to0[i]
            up1[p] += to1[i]
        down0, down1 = [0.0] * n, [0.0] * n
        prob, pair = [0.0] * n, [[[0.0, 0.0], [0.0, 0.0]]] if pairs else []
        for i in range(n):
            if i:
                p = nodes[i].parent
                a, b = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]  # the parent without this child
                down0[i] = _logsum(a + e[0][0], b + e[1][0])
                down1[i] = _logsum(a + e[0][1], b + e[1][1])
                if pairs:
                    z = _logsum(up0[i] + down0[i], up1[i] + down1[i])
                    pair.append([[exp(a + e[0][0] + up0[i] - z), exp(a + e[0][1] + up1[i] - z)], [exp(b + e[1][0] + up0[i] - z), exp(b + e[1][1] + up1[i] - z)]])
            d = up1[i] + down1[i] - up0[i] - down0[i]
            prob[i] = 1 / (1 + exp(-d)) if d > -700 else 0.0
        return prob, pair


def train(pages: Iterable[tuple[str, dict[int, int]]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """pages: (html, label of each node of parse(html) by number). Exact gradients from marginals, with AdaGrad."""
    data = []
    for source, labels in pages:
        nodes, stay = contract(parse(source))
        data.append((nodes, [features(x) for x in nodes], [labels[i] for i in stay]))
    model, grown, grown_e = Model(), {}, [[1e-3, 1e-3], [1e-3, 1e-3]]
    for _ in range(rounds):
        for nodes, feats, y in data:
            prob, pair = model.marginals(nodes, feats)
            slope: dict[str, float] = {}
            for i, fs in enumerate(feats):
                d = y[i] - prob[i]
                for f in fs:
                    slope[f] = slope.get(f, 0.0) + d
            for f, g in slope.items():
                g -= decay * model.weight.get(f, 0.0)
                grown[f] = grown.get(f, 1e-3) + g * g
                model.weight[f] = model.weight.get(f, 0.0) + rate * g / grown[f] ** 0.5
            for a in (0, 1):
                for b in (0, 1):
                    g = sum((y[nodes[i].parent] == a and y[i] == b) - pair[i][a][b] for i in range(1, len(nodes))) - decay * model.edge[a][b]
                    grown_e[a][b] += g * g
                    model.edge[a][b] += rate * g / grown_e[a][b] ** 0.5
    return model


#: Layout words of labelled pages: class or id words of parts that are no content, and of those that are.
_PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc pager pagination links",
    "header": "header masthead topbar branding logo hero banner",
    "footer": "footer bottom copyright legal colophon sitemap",
    "aside": "sidebar side aside widget related recommended trending popular more rail",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion teaser outbrain",
    "notice": "notice cookie cookies consent gdpr alert warning message banner popup modal overlay disclaimer paywall",
    "form": "form search login signup subscribe newsletter contact signin",
    "comments": "comments comment reply replies discussion responses disqus thread",
    "share": "share social sharing follow buttons tags meta byline",
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section"], "notice": ["div", "section", "p", "aside"], "form": ["form", "div"], "comments": ["div", "section", "ol"], "share": ["div", "ul"]}
_CONTENT = "article content post entry story main body text page"
_FILLER = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state people those too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part school thought went say general once upon every left war don does got united number hand course water until always away public something fact less though far put head think called set almost enough end took government night yet system better four nothing told eyes city going president why days present point didn look find asked second group later next room social business knew program give half side face toward white five let young form given per order large several second".split()


def labelled_pages(n: int = 400, seed: int = 1) -> list[tuple[str, dict[int, int]]]:
    """Pages in many layouts, each element labelled while it is written."""
    rng = random.Random(seed)
    out = []

    def sentence(a: int, b: int) -> str:
        return " ".join(rng.choice(_FILLER) for _ in range(rng.randint(a, b))).capitalize() + rng.choice(".  ?")

    def named(words: str) -> str:
        w = rng.choice(words.split())
        return rng.choice([f' class="{w}"', f' class="{w}"', f' id="{w}"', f' class="{rng.choice("box wrap block inner row col".split())} {w}"', f' class="{w}-{rng.choice("box wrap area list item block".split())}"'])

    def element(tag: str, label: int, inner: str, attrs: str = "") -> str:
        return f"<{tag}{attrs} data-y={label}>{inner}</{tag}>"

    def wrapped(inner: str, label: int, most: int) -> str:
        """Inside of 0 to `most` elements whose names say nothing."""
        for _ in range(rng.randint(0, most)):
            name = rng.choice([rng.choice(sorted(_NEUTRAL)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 5)))])
            attrs = rng.choice(["", f' class="{name}"', f' class="{name}-{rng.randint(1, 12)}"', f' id="{name}{rng.randint(1, 99)}"'])
            inner = element(rng.choice(["div", "div", "div", "section", "center"]), label, inner, attrs)
        return inner

    def part(kind: str) -> str:
        tag = rng.choice(_TAGS[kind])
        attrs = "" if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5 else named(_PARTS[kind])
        links = lambda k: element("ul", 0, "".join(element("li", 0, f'<a href="/{rng.choice(_FILLER)}">{sentence(1, 3)}</a>') for _ in range(k)))
        paras = lambda k, a, b: "".join(element(rng.choice(["p", "p", "div"]), 0, sentence(a, b)) for _ in range(k))
        if kind == "nav":
            body = "".join(element("li", 0, f'<a href="/">{sentence(1, 3)}</a>') for _ in range(4)) if tag == "ul" else links(rng.randint(3, 8))
        elif kind == "comments":
            body = (element("h3", 0, "Comments") if rng.random() < 0.6 else "") + "".join(element(rng.choice(["div", "li", "article"]), 0, paras(rng.randint(1, 2), 4, 60), named("comment reply")) for _ in range(rng.randint(1, 4)))
        elif kind in ("ad", "notice"):
            body = sentence(3, 40) if tag == "p" or rng.random() < 0.5 else paras(rng.randint(1, 2), 3, 40)
        elif kind == "form":
            body = element("p", 0, sentence(2, 12)) + "<label>E-mail</label><input type=text>" + element("button", 0, sentence(1, 2)) + element("select", 0, element("option", 0, sentence(1, 2)))
        elif kind == "aside":
            body = element("h3", 0, sentence(1, 3)) + (links(4) if rng.random() < 0.5 else paras(2, 4, 40))
        elif kind == "header":
            body = element("h1", 0, sentence(1, 4)) if rng.random() < 0.4 else sentence(1, 6)
            body += links(3) if rng.random() < 0.4 else ""
        elif kind == "footer":
            body = sentence(3, 20) if rng.random() < 0.6 else paras(2, 3, 30) + links(3)
        else:
            body = sentence(1, 6) if rng.random() < 0.5 else links(3)
        return element(tag, 0, body, attrs)

    def article() -> str:
        body = element(rng.choice(["h1", "h1", "h2"]), 1, sentence(1, 14)) if rng.random() < 0.8 else ""
        for _ in range(rng.choice([1, 1, rng.randint(1, 8), rng.randint(1, 8), rng.randint(3, 20)])):
            k = rng.random()
            if k < 0.75:
                text = sentence(1, 120)
                body += element("p", 1, f"<b>{text}</b>" if rng.random() < 0.1 else text + f' <a href="#">{sentence(1, 3)}</a> ' * (rng.random() < 0.2))
            elif k < 0.82:
                body += element(rng.choice(["h2", "h3", "h4"]), 1, sentence(1, 8))
            elif k < 0.88:
                body += element("ul", 1, "".join(element("li", 1, sentence(2, 25)) for _ in range(3)))
            elif k < 0.92:
                body += element("blockquote", 1, element("p", 1, sentence(4, 40)))
            elif k < 0.95:
                body += element("table", 1, element("tr", 1, element("td", 1, sentence(1, 5)) + element("td", 1, sentence(1, 5))))
            else:
                body += element("pre", 1, sentence(3, 20))
        inside = ["ad", "share", "form", "aside", "notice"]
        if rng.random() < 0.35:
            body += part(rng.choice(inside))
        if rng.random() < 0.3:
            body += part("comments")
        k = rng.random()
        if k < 0.5:
            return element("article", 1, body, "" if rng.random() < 0.6 else named(_CONTENT))
        if k < 0.65:
            return element("main", 1, body)
        if k < 0.9:
            return element(rng.choice(["div", "section"]), 1, body, named(_CONTENT))
        return body

    for _ in range(n):
        often = rng.choice([0.0, 0.4, 0.4, 0.4])
        deep = rng.choice([0, 0, 1, 3])
        before = [wrapped(part(k), 0, deep) for k in ("notice", "header", "nav", "ad", "aside", "form") if rng.random() < often]
        after = [wrapped(part(k), 0, deep) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer") if rng.random() < often]
        body = "".join([*before, wrapped(article(), 1, rng.choice([0, 0, 2, 6])), *after])
        body = wrapped(body, 1, rng.choice([0, 0, 1, 4]))
        source = element("html", 1, element("head", 0, "<title>T</title>") + element("body", 1, body))
        labels = {0: 1}
        for m in re.finditer(r" data-y=(\d)", source):
            labels[len(labels)] = int(m[1])
        clean = re.sub(r" data-y=\d", "", source)
        assert len(parse(clean)) == len(labels)
        out.append((clean, labels))
    return out


@lru_cache(maxsize=4)
def trained(n: int = 400, seed: int = 1) -> Model:
    return train(labelled_pages(n, seed))


def main_text(source: str | None, model: Model) -> str:
    """Blocks whose node is content with a probability of one half or more."""
    if not source:
        return ""
    nodes, _ = contract(parse(source))
    prob, _ = model.marginals(nodes, pairs=False)
    return "\n\n".join(t for _, t in sorted(x for i, node in enumerate(nodes) if prob[i] >= 0.5 for x in node.texts))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", model: Model | None = None, keep_html: bool = False) -> DataFrame:
    """Adds the main text of every page; no shuffle, the model travels with the tasks.

    White space inside a block (references decoded) becomes one space; <br> is
    white space; blocks are joined in page order by two line breaks. Defined
    cases: null, empty and textless html give the empty text; unclosed or
    misnested elements are closed as browsers do for common cases; repeated rows
    are read each, an empty table gives no rows; all other columns but `html_col`
    pass, and a column named like `out` is replaced.
    """
    model = model or trained()

    def make():
        return lambda b: [pa.array([main_text(x, model) for x in values(b.column(html_col))], pa.string())]

    return add_columns(pages, [T.StructField(out, T.StringType())], make, () if keep_html else (html_col,))
