"""Main text of web pages: a tree-structured graphical model over DOM nodes, with sum-product message passing."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

BOILERPLATE, CONTENT, MIXED = 0, 1, 2  # labels of a node; MIXED holds nodes of both kinds and has no text of its own to keep

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup label legend li main menu nav noscript ol optgroup option p pre search section select summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
LANDMARKS = frozenset("article aside dialog fieldset footer form header main menu nav noscript search".split())
#: An element that starts closes the open element of the same group, unless a holder lies between.
GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table select html body".split())

#: Exponents of the emission potentials: runs of text below one element resemble each other, so each weighs less than if it stood alone.
WEIGHT = {"words": 0.7, "links": 0.7, "stop": 0.7, "in": 0.7, "tag": 0.3, "landmark": 2.0, "part": 1.5}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    parent: int
    tag: str
    parts: tuple[str, ...] = ()
    given: str = ""
    text: str = ""
    linked: int = 0


@dataclass
class _Run:
    """Text since the last block boundary."""

    texts: list[str] = field(default_factory=list)
    linked: int = 0


def _attributes(raw: str) -> tuple[tuple[str, ...], str]:
    parts, given = [], ""
    for name, *values in _ATTRIBUTE.findall(raw):
        value = "".join(values)
        if name.lower() == "data-y":
            given = value
        else:
            parts += [x.lower() for x in _PART.findall(value)]
    return tuple(dict.fromkeys(parts)), given


def parse(html: str) -> list[Node]:
    """Block elements and runs of text in page order; a node's parent comes before it, node 0 is the page. Unclosed and stray tags,
    comments and tags that are cut off are tolerated. A line break counts as white space."""
    nodes, open_at = [Node(0, "#page")], [0]
    run, link, at = _Run(), 0, 0
    raw_end: dict[str, re.Pattern] = {}
    where: dict[str, list[int]] = {}  # the depths at which elements of a name are open

    def flush() -> None:
        nonlocal run, link
        if run.texts:
            text = " ".join(unescape("".join(run.texts)).split())
            if text:
                nodes.append(Node(open_at[-1], "#text", text=text, linked=min(run.linked, len(text))))
        run, link = _Run(), 0

    def close(names: tuple[str, ...], holders: frozenset) -> None:
        """Closes the innermost open element of names, unless one of holders is open inside it."""
        depth = max((where[n][-1] for n in names if where.get(n)), default=0)
        if depth and depth > max((where[n][-1] for n in holders if where.get(n)), default=0):
            for i in range(len(open_at) - 1, depth - 1, -1):
                where[nodes[open_at[i]].tag].pop()
            del open_at[depth:]

    while True:
        m = _MARKUP.search(html, at)
        chunk = html[at : m.start()] if m else html[at:]
        if chunk:
            run.texts.append(chunk)
            run.linked += len(chunk) if link else 0
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                link = 0
            elif name in BLOCK:
                flush()
                close((name,), frozenset())
        elif name in RAW:
            if not m["attrs"].endswith("/") or name in ("script", "style", "title", "textarea"):
                pattern = raw_end.setdefault(name, re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I))
                end = pattern.search(html, at)
                at = end.end() if end else len(html)
        elif name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                run.texts.append(" ")
        elif name in BLOCK:
            flush()
            close(("p",), frozenset(("button", "td", "th", "caption")))
            if name in GROUPS:
                close(GROUPS[name], HOLDERS)
            parts, given = _attributes(m["attrs"]) if m["attrs"] else ((), "")
            nodes.append(Node(open_at[-1], name, parts, given))
            where.setdefault(name, []).append(len(open_at))
            open_at.append(len(nodes) - 1)
        elif name == "a":
            link = 1
    flush()
    return nodes


def _bin(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n > b for b in bounds)


def features(node: Node, parent: Node) -> list[tuple]:
    """What a node shows of itself; a run of text also shows the element that it stands in, and whether it is a link there."""
    if node.tag == "#text":
        words = node.text.count(" ") + 1
        return [("words", _bin(words, (2, 5, 10, 20, 40))), ("links", _bin(100 * node.linked // max(1, len(node.text)), (0, 30, 70))), ("stop", node.text[-1] in ".!?:;\"'"), ("in", (parent.tag, 2 * node.linked > len(node.text)))]
    return [("landmark" if node.tag in LANDMARKS else "tag", node.tag), *(("part", x) for x in node.parts)]


class PageModel:
    """Emissions P(feature | label) and parent-child potentials P(label | parent's label), by kind of child, counted on labelled pages."""

    def __init__(self, pages: list[tuple[str, str]]):
        """pages: the label of the page itself, and its html."""
        labels = {"b": BOILERPLATE, "c": CONTENT, "m": MIXED}
        shown: dict = defaultdict(lambda: [0.05, 0.05, 0.05])
        kinds: dict = defaultdict(lambda: [2.0, 2.0, 2.0])
        moves = {k: [[0.2] * 3 for _ in range(3)] for k in (True, False)}
        start = [1.0, 1.0, 1.0]
        for of_page, page in pages:
            nodes, label = parse(page), []
            start[labels[of_page]] += 1
            for i, node in enumerate(nodes):
                above = label[node.parent] if i else labels[of_page]
                own = labels[node.given] if node.given else BOILERPLATE if node.tag == "#text" and above == MIXED else above
                label.append(own)
                if i:
                    moves[node.tag == "#text"][above][own] += 1
                for f in features(node, nodes[node.parent]):
                    shown[f][own] += 1
                    kinds[f[0]][own] += 1
        self.moves = {k: [tuple(x / sum(row) for x in row) for row in m] for k, m in moves.items()}
        self.emit = {f: tuple((c[y] / kinds[f[0]][y]) ** WEIGHT[f[0]] for y in range(3)) for f, c in shown.items()}
        self.start = tuple(x / sum(start) for x in start)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, exact: one pass of messages upward, one downward."""
        emit, belief, sent = self.emit, [], [(1.0, 1.0, 1.0)] * len(nodes)
        for node in nodes:
            a = b = c = 1.0
            for f in features(node, nodes[node.parent]):
                e = emit.get(f)
                if e:
                    a, b, c = a * e[0], b * e[1], c * e[2]
            if node.tag == "#text":
                c = 0.0  # text is of one kind
            total = a + b + c
            belief.append([a / total, b / total, c / total])
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = belief[i]
            m = [t[0] * a + t[1] * b + t[2] * c for t in self.moves[nodes[i].tag == "#text"]]
            total = m[0] + m[1] + m[2]
            m = (m[0] / total, m[1] / total, m[2] / total)
            sent[i] = m
            up = belief[nodes[i].parent]
            a, b, c = up[0] * m[0], up[1] * m[1], up[2] * m[2]
            total = a + b + c
            up[0], up[1], up[2] = max(a / total, 1e-150), max(b / total, 1e-150), max(c / total, 1e-150)
        for y in range(3):
            belief[0][y] *= self.start[y]
        for i, node in enumerate(nodes):
            own = belief[i]
            if i:
                up, m = belief[node.parent], sent[i]
                a, b, c = up[0] / m[0], up[1] / m[1], up[2] / m[2]
                t = self.moves[node.tag == "#text"]
                for y in range(3):
                    own[y] *= a * t[0][y] + b * t[1][y] + c * t[2][y]
            total = own[0] + own[1] + own[2]
            for y in range(3):
                own[y] = max(own[y] / total, 1e-150)
        return [x[CONTENT] for x in belief]

    def main_text(self, html: str) -> str:
        """The runs of text that are likelier content than not, one to a line."""
        nodes = parse(html)
        return "\n".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text and p >= 0.5)


# Class and id names that page templates commonly give to their parts, chosen by hand.
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav".split(),
    "header": "header masthead banner branding site-header topbar logo".split(),
    "footer": "footer site-footer copyright legal bottom colophon".split(),
    "side": "sidebar aside side widget widgets rail related recommended trending popular tags toc".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted adbox".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay disclaimer warning message privacy".split(),
    "form": "newsletter subscribe signup login search form contact register".split(),
    "share": "share social sharing follow pagination pager meta byline author-box tools print".split(),
    "comments": "comments comment-list commentlist discussion responses respond disqus replies reader-comments".split(),
    "comment": "comment reply response".split(),
    "content": "content article post entry story main-content article-body post-content entry-content text body prose".split(),
    "wrap": "page wrapper container layout site wrap row col columns outer inner root app grid main".split(),
}


class _Template:
    """Labelled pages, drawn by rule from a seed. data-y gives the label of an element and of what it holds."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, least: int, most: int, stop: bool = True) -> str:
        n = self.rng.randint(least, most)
        return " ".join(self.rng.choice(("lorem", "ipsum", "dolor", "amet", "elit", "nunc")) for _ in range(n)) + ("." if stop else "")

    def named(self, kind: str) -> str:
        return f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(NAMES[kind])}"' if self.rng.random() < 0.85 else ""

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=x>{self.words(1, 4, False)}</a></li>" for _ in range(n)) + "</ul>"

    def prose(self) -> str:
        """A heading and paragraphs as an article has them."""
        return f"<h{(n := self.rng.choice('234'))}>{self.words(1, 6, False)}</h{n}>" * (self.rng.random() < 0.6) + "".join(f"<p>{self.words(2, 60)}</p>" for _ in range(self.rng.randint(1, 3)))

    def boiler(self, kind: str) -> str:
        r = self.rng
        plain = r.random() < 0.4
        if kind == "noscript":
            return f'<noscript data-y="b">{self.words(2, 15)}</noscript>'
        if kind == "nav":
            return f'<nav data-y="b"{"" if plain else self.named("nav")}>{self.links(r.randint(2, 9))}</nav>' if r.random() < 0.7 else f'<div data-y="b" class="{r.choice(NAMES["nav"])}">{self.links(r.randint(2, 9))}</div>'
        if kind == "header":
            inside = r.choice((f"<h1>{self.words(1, 4, False)}</h1>", f"<h1>{self.words(1, 6, False)}</h1><p>{self.words(2, 20)}</p>", self.prose(), f"<p>{self.words(2, 12)}</p>", self.words(1, 8, False), self.links(3)))
            return f'<header data-y="b"{"" if plain else self.named("header")}>{inside}</header>' if r.random() < 0.7 else f'<div data-y="b" class="{r.choice(NAMES["header"])}">{inside}</div>'
        if kind == "footer":
            inside = r.choice((self.words(2, 25), f"<p>{self.words(2, 30)}</p>", self.prose(), self.links(4) + self.words(3, 12)))
            return f'<footer data-y="b"{"" if plain else self.named("footer")}>{inside}</footer>' if r.random() < 0.7 else f'<div data-y="b" class="{r.choice(NAMES["footer"])}">{inside}</div>'
        if kind == "side":
            inside = r.choice((f"<h3>{self.words(1, 4, False)}</h3>{self.links(4)}", self.prose(), self.prose(), self.words(3, 30)))
            return f'<aside data-y="b"{"" if plain else self.named("side")}>{inside}</aside>' if r.random() < 0.6 else f'<{(t := r.choice(("div", "section")))} data-y="b" class="{r.choice(NAMES["side"])}">{inside}</{t}>'
        if kind == "form":
            inside = r.choice((f"<label>{self.words(1, 5, False)}</label><input><button>{self.words(1, 2, False)}</button>", f"<p>{self.words(3, 20)}</p><input><button>{self.words(1, 2, False)}</button>", f"{self.words(2, 12)}<select><option>{self.words(1, 2, False)}<option>{self.words(1, 2, False)}</select>"))
            return f'<form data-y="b"{"" if plain else self.named("form")}>{inside}</form>'
        if kind == "comments":
            name, tag = r.choice(NAMES["comments"]), r.choice(("div", "section", "ol", "aside"))
            each = lambda: (t := "li" if tag == "ol" else r.choice(("div", "article", "p", "blockquote")), f'<{t} class="{r.choice(NAMES["comment"])}">' + (self.words(2, 60) if t == "p" or r.random() < 0.4 else f"<p>{self.words(2, 60)}</p>") + f"</{t}>")[1]
            return f'<{tag} data-y="b" {r.choice(("class", "id"))}="{name}">' + f"<h3>{self.words(1, 3, False)}</h3>" * (r.random() < 0.5) + "".join(each() for _ in range(r.randint(1, 5))) + f"</{tag}>"
        inside = r.choice((self.words(2, 30), f"<p>{self.words(2, 30)}</p>", self.prose(), f"<a href=x>{self.words(2, 8, False)}</a>", f"{self.words(3, 15)} <button>{self.words(1, 2, False)}</button>"))
        tag = r.choice(("div", "div", "section", "p", "dialog" if kind == "notice" else "div"))
        return f'<{tag} data-y="b" {r.choice(("class", "class", "id"))}="{r.choice(NAMES[kind])}">{inside}</{tag}>'

    def block(self) -> str:
        r = self.rng
        x = r.random()
        if x < 0.04:
            return f"<p><a href=x>{self.words(1, 10, False)}</a></p>"
        if x < 0.66:
            return f"<p>{self.words(1, 6) if r.random() < 0.3 else self.words(6, 120)}" + "</p>" * (r.random() < 0.85)
        if x < 0.76:
            return f"<h{(n := r.choice('23'))}>{self.words(1, 8, False)}</h{n}>"
        if x < 0.84:
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.words(1, 25) if r.random() < 0.6 else self.words(1, 4, False)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if x < 0.88:
            return f"<blockquote><p>{self.words(3, 50)}</p></blockquote>"
        if x < 0.92:
            return f"<pre>{self.words(3, 40, False)}</pre>"
        if x < 0.96:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<figure><figcaption>{self.words(2, 15)}</figcaption></figure>" if x < 0.98 else f"<div>{self.words(5, 60)}</div>"

    def article(self) -> str:
        r = self.rng
        blocks = [self.block() for _ in range(r.randint(1, 14))]
        title = f"<h1>{self.words(1, 14, False)}</h1>"
        blocks.insert(0, title if r.random() < 0.9 else "")
        for kind in ("ad", "share", "form", "side", "notice", "nav", "header", "noscript"):
            if r.random() < (0.06 if kind in ("header", "noscript") else 0.3):
                blocks.insert(r.randint(1, len(blocks)), self.boiler(kind))
        if r.random() < 0.3:
            blocks.append(self.boiler("comments"))
        if r.random() < 0.08:
            blocks.append(self.boiler("footer"))
        inside = "".join(blocks)
        x = r.random()
        if x < 0.1:
            inside = f'<div class="{r.choice(NAMES["content"])}">{inside}</div>'
        tag = "article" if x < 0.55 else "main" if x < 0.7 else "section" if x < 0.75 else "div"
        return f'<{tag} data-y="c"' + (self.named("content") if tag in ("div", "section") or r.random() < 0.3 else "") + f">{inside}</{tag}>"

    def page(self) -> tuple[str, str]:
        r = self.rng
        x = r.random()
        if x < 0.14:
            inside = self.words(1, 60) * (r.random() < 0.7) + "".join(self.block() for _ in range(r.randint(0, 6)))
            return ("c", inside or self.words(1, 60)) if x < 0.08 else ("m", f'<html data-y="m"><body data-y="c">{inside}</body></html>')
        middle = [self.article()]
        for kind in ("side", "ad", "share", "form", "notice"):
            if r.random() < 0.25:
                middle.insert(r.randint(0, len(middle)), self.boiler(kind))
        if r.random() < 0.35:
            middle.append(self.boiler("comments"))
        inside = "".join(middle)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            inside = f'<{(t := r.choice(("div", "div", "main", "section")))} data-y="m"{self.named("wrap")}>{inside}</{t}>'
        before = "".join(self.boiler(k) for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.15), ("noscript", 0.1)) if r.random() < p)
        after = "".join(self.boiler(k) for k, p in (("side", 0.25), ("ad", 0.2), ("nav", 0.15), ("footer", 0.8), ("notice", 0.15)) if r.random() < p)
        return "m", f'<html data-y="m"><body data-y="m">{before}{inside}{after}</body></html>'


@cache
def default_model(pages: int = 600, seed: int = 3) -> PageModel:
    """A model of labelled pages that are drawn from templates; there is no other table of labelled pages."""
    template = _Template(seed)
    return PageModel([template.page() for _ in range(pages)])


def main_texts(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages.

    The page is parsed to a tree of block elements and runs of text. Each node is boilerplate, content or mixed; potentials between
    parent and child and what a node shows of itself (element, class and id names, length, links) give each run's marginal
    probability of being content. Runs of at least a half are kept, whole, in page order, one to a line, with white space turned into single
    spaces and character references decoded. The address and the id play no part. Null html counts as empty and gives an empty text; a page
    without markup is judged like any other run. Very long and deep pages are parsed whole. Repeated rows give the same text. An empty table gives
    no rows. Other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select("page_id", "url", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return batched(rows).mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
