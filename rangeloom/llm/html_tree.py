"""Main-text extraction with a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not. Its look (tag, class words, text and link
amounts) gives a node potential, each parent-child pair an edge potential; sum-product messages, upward then downward,
give the exact marginals. Potentials are smoothed counts over labelled pages. As pages of known labels this module makes
its own from layouts, with every node's label; more can be given to ``fit``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Tags, unescape

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title textarea select option button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav".split())
KINDS = {
    **dict.fromkeys("article main".split(), "article"), **dict.fromkeys("nav menu".split(), "nav"), "header": "header", "footer": "footer", "aside": "aside",
    **dict.fromkeys("form fieldset".split(), "form"), "p": "p", **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"), **dict.fromkeys("ul ol dl".split(), "list"),
    **dict.fromkeys("li dt dd".split(), "item"), **dict.fromkeys("table tbody thead tfoot tr".split(), "table"), **dict.fromkeys("td th".split(), "cell"),
    **dict.fromkeys("pre blockquote figure figcaption".split(), "quote"), **dict.fromkeys("html body".split(), "root"),
}
AWAY_WORDS = "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail widget footer foot bottom copyright header masthead topbar top cookie cookies consent gdpr notice alert popup modal overlay share sharing social follow subscribe newsletter signup login comment comments reply replies discussion respondents disqus related recommended more pager pagination tags toc skip search form hidden print legal".split()
MAIN_WORDS = "article content post entry story main body text prose page paragraph blog".split()

_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LABEL = re.compile(r'data-label="(content|away)"')
_WORD = re.compile(r"[a-z]+")
_AWAY, _MAIN = frozenset(AWAY_WORDS), frozenset(MAIN_WORDS)


class Node:
    __slots__ = ("tag", "names", "parent", "parts", "length", "linked", "sign", "given", "dropped")

    def __init__(self, tag: str, names: str, parent: int, dropped: bool):
        self.tag, self.names, self.parent, self.dropped = tag, names, parent, dropped
        self.parts: list[tuple[int, str]] = []  # (run number, text): runs are cut where a block begins or ends
        self.length = self.linked = 0
        self.sign = False
        self.given: str | None = None


def parse(source: str, labelled: bool = False) -> list[Node]:
    """The block elements of a page in order of their start, each with its own text; parents come before children.

    ``labelled`` pages say in data-label="content" or "away" what an element is.
    """
    nodes = [Node("html", "", -1, False)]
    stack: list[tuple[str, int]] = [("html", 0)]
    where: dict[str, list[int]] = {}  # the places of open elements in the stack, by tag
    run = links = at = 0
    tags = Tags(source)

    def add(text: str) -> None:
        node = nodes[stack[-1][1]]
        if text and not node.dropped:
            text = unescape(text)
            node.parts.append((run, text))
            size = len(text.strip())
            node.length += size
            if links:
                node.linked += size
            if "©" in text:
                node.sign = True

    def close(place: int) -> None:
        while len(stack) > place:
            where[stack.pop()[0]].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    while found := tags.next():
        start, ends, tag, attributes = found
        if start > at:
            add(source[at:start])
        at = tags.at
        if tag is None:
            continue
        if tag == "br":
            add("\n")
            continue
        if ends:
            if tag in INLINE:
                if tag == "a" and links:
                    links -= 1
            elif where.get(tag):
                close(where[tag][-1])
                run += 1
                links = 0
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        run += 1
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in SAME:
            place = innermost(SAME[tag])
            if place > innermost(SCOPE):
                close(place)
        links = 0
        parent = stack[-1][1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
        if tag in RAW:
            if not attributes.endswith("/"):
                tags.skip(tag)
                at = tags.at
            continue
        node = Node(tag, names, parent, nodes[parent].dropped or tag in DROPPED)
        if labelled and (given := _LABEL.search(attributes)):
            node.given = given[1]
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(nodes)))
        nodes.append(node)
    add(source[at:])
    return nodes


def look(node: Node) -> tuple:
    """What the node potential sees: kind and class words together, class words alone, kind and size together, links, a copyright sign."""
    words = set(_WORD.findall(node.names)) if node.names else ()
    names = "away" if words and not _AWAY.isdisjoint(words) else "main" if words and not _MAIN.isdisjoint(words) else "none"
    size = 0 if not node.length else 1 if node.length < 25 else 2 if node.length < 80 else 3
    kind = KINDS.get(node.tag, "other")
    return (kind, names), names, (kind, size), bool(node.length) and 2 * node.linked >= node.length, node.sign


def holder(node: Node) -> int:
    """1 for roots and plain containers, in which content may start; 0 for elements that say what they are."""
    kind = KINDS.get(node.tag, "other")
    return int(kind == "root" or (kind == "other" and look(node)[1] == "none"))


class Model:
    """Log potentials of each value of each feature by label; ``edge[holder][parent label][child label]``."""

    def __init__(self, feature: list[dict], edge: list[list[list[float]]]):
        self.feature, self.edge = feature, edge
        self.known: dict[tuple, tuple[float, float]] = {}

    @classmethod
    def fit(cls, pages: Iterable[str], smoothing: float = 0.1) -> Model:
        """Smoothed maximum likelihood from pages whose elements carry data-label="content" or "away" (inherited downward)."""
        seen = [[Counter(), Counter()] for _ in range(5)]
        edge = [[[smoothing, smoothing], [smoothing, smoothing]] for _ in range(2)]
        for page in pages:
            nodes = parse(page, labelled=True)
            label: list[int] = []
            for node in nodes:
                y = int(node.given == "content") if node.given else label[node.parent] if node.parent >= 0 else 0
                label.append(y)
                if node.parent >= 0:
                    edge[holder(nodes[node.parent])][label[node.parent]][y] += 1
                for table, value in zip(seen, look(node), strict=True):
                    table[y][value] += 1
        feature = []
        for table in seen:
            values = set(table[0]) | set(table[1])
            totals = [sum(t.values()) + smoothing * (len(values) + 1) for t in table]
            known = {v: tuple(math.log((t[v] + smoothing) / n) for t, n in zip(table, totals, strict=True)) for v in values}
            known[None] = tuple(math.log(smoothing / n) for n in totals)
            feature.append(known)
        return cls(feature, [[[x / sum(row) for x in row] for row in table] for table in edge])

    def potential(self, node: Node) -> tuple[float, float]:
        key = look(node)
        found = self.known.get(key)
        if found is None:
            parts = [t.get(v, t[None]) for t, v in zip(self.feature, key, strict=True)]
            a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
            top = max(a, b)
            found = self.known[key] = (math.exp(a - top), math.exp(b - top))
        return found

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages from the leaves up, then from the root down."""
        tables = [(*t[0], *t[1]) for t in self.edge]
        n = len(nodes)
        above = [tables[0], *(tables[holder(nodes[node.parent])] for node in nodes[1:])]
        up0, up1 = [0.0] * n, [0.0] * n
        for i, node in enumerate(nodes):
            up0[i], up1[i] = self.potential(node)
        to0, to1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            e00, e01, e10, e11 = above[i]
            m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
            scale = m0 + m1
            to0[i], to1[i] = m0, m1 = m0 / scale, m1 / scale
            p = nodes[i].parent
            a, b = up0[p] * m0, up1[p] * m1
            scale = a + b
            up0[p], up1[p] = a / scale, b / scale
        belief = [0.0] * n
        down0, down1 = [1.0] * n, [1.0] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                a = down0[p] * up0[p] / max(to0[i], 1e-300)
                b = down1[p] * up1[p] / max(to1[i], 1e-300)
                scale = a + b
                a, b = a / scale, b / scale
                e00, e01, e10, e11 = above[i]
                down0[i], down1[i] = a * e00 + b * e10, a * e01 + b * e11
            a, b = down0[i] * up0[i], down1[i] * up1[i]
            belief[i] = b / (a + b)
        return belief


def main_text(source: str | None, model: Model, least: float = 0.5) -> str:
    """The text blocks of content nodes, white space collapsed, in page order, joined by an empty line."""
    if not source:
        return ""
    nodes = parse(source)
    belief = model.marginals(nodes)
    blocks: dict[int, list[str]] = {}
    for node, p in zip(nodes, belief, strict=True):
        if p > least:
            for run, text in node.parts:
                blocks.setdefault(run, []).append(text)
    found = (" ".join("".join(blocks[run]).split()) for run in sorted(blocks))
    return "\n\n".join(x for x in found if x)


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages of many layouts whose elements carry their label: semantic and plain markup, menus, adverts, comments, forms, lists and tables in and out of the text."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(("ka", "lo", "mi", "ter", "sun", "ve", "rad", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def tag(name: str, names: str, inner: str, label: str | None = None) -> str:
        attributes = (f' class="{names}"' if names else "") + (f' data-label="{label}"' if label else "")
        return f"<{name}{attributes}>{inner}</{name}>"

    def body() -> str:
        out = [tag(rng.choice(("h1", "h1", "h2")), rng.choice(("", "", "title")), words(3, 10))] if rng.random() < 0.9 else []
        brief = rng.random() < 0.25
        for _ in range(rng.randint(1, 2 if brief else 9)):
            r = rng.random()
            text = words(1, 7) if brief else words(4, 9) if rng.random() < 0.15 else words(12, 90)
            if r < 0.72:
                out.append(f"<p>{text}" + ("</p>" if rng.random() < 0.9 else ""))
            elif r < 0.78:
                out.append(tag(rng.choice(("h2", "h3")), "", words(2, 8)))
            elif r < 0.85:
                out.append(tag(rng.choice(("ul", "ol")), "", "".join(f"<li>{words(4, 25)}</li>" for _ in range(rng.randint(2, 5)))))
            elif r < 0.9:
                out.append(tag("blockquote", "", rng.choice((text, f"<p>{text}</p>"))))
            elif r < 0.94:
                out.append(tag("table", "", "".join(f"<tr><td>{words(1, 6)}</td><td>{words(1, 12)}</td></tr>" for _ in range(rng.randint(2, 4)))))
            elif r < 0.97:
                out.append(tag("div", "", text))
            else:
                out.append(tag("div", rng.choice(("ad", "promo", "share", "related")), words(2, 25), "away"))
        return "".join(out)

    def away() -> list[str]:
        pieces = [
            tag("nav", rng.choice(("", "menu")), f"<ul>{links(rng.randint(3, 8))}</ul>", "away"),
            tag("div", rng.choice(("ad", "ads banner", "sponsored", "promo")), rng.choice((words(4, 40), f"<p>{words(4, 40)}</p>")), "away"),
            tag("header", rng.choice(("", "site-header")), tag("h1", "", words(1, 4)) + f"<p>{words(2, 9)}</p>", "away"),
            tag("aside", rng.choice(("", "sidebar")), tag("h3", "", words(1, 4)) + f"<ul>{links(4)}</ul><p>{words(5, 50)}</p>", "away"),
            tag("div", rng.choice(("cookie-notice", "notice", "alert")), f"<p>{words(8, 40)}</p>", "away"),
            tag("form", "", f"<p>{words(2, 12)}</p><label>{words(1, 4)}</label>", "away"),
            tag("div", rng.choice(("menu", "breadcrumb", "topbar nav")), f"<ul>{links(4)}</ul>", "away"),
            tag("div", rng.choice(("sidebar", "widget")), tag("h3", "", words(1, 4)) + f"<p>{words(6, 50)}</p>", "away"),
        ]
        rng.shuffle(pieces)
        return pieces[: rng.randint(1, 5)]

    def after() -> list[str]:
        note = f"&copy; {words(2, 8)}"
        pieces = [
            tag("footer", rng.choice(("", "site-footer")), rng.choice((f"{note} {words(0, 25)}", f"<p>{note}</p><ul>{links(3)}</ul>")), "away"),
            tag(rng.choice(("section", "div")), rng.choice(("comments", "reader-comments")), "".join(tag(rng.choice(("div", "article", "li")), "comment", f"<p>{words(5, 60)}</p>") for _ in range(rng.randint(1, 4))), "away"),
            tag("div", rng.choice(("related", "more recommended")), f"<ul>{links(4)}</ul>", "away"),
            tag("div", "newsletter", f"<p>{words(5, 20)}</p>", "away"),
        ]
        keep = [p for p in pieces if rng.random() < 0.6]
        rng.shuffle(keep)
        return keep

    pages = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55:
            text = tag("article", rng.choice(("", "", "post")), body(), "content")
        elif kind < 0.7:
            text = tag("main", "", body(), "content")
        elif kind < 0.9:
            text = tag("div", rng.choice(("content", "post-body", "entry", "article-text", "story")), body(), "content")
        else:
            text = tag("section", rng.choice(("", "content")), body(), "content")
        if rng.random() < 0.3:
            text = tag("div", rng.choice(("", "wrapper", "container")), text + "".join(away()[:1]))
        pages.append(f"<html><body>{''.join(away())}{text}{''.join(after())}</body></html>")
    return pages


def _extract(model: Model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(x, model) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(id, url, text, n_chars) per page: the main text of its whole HTML.

    Content is what the model gives a marginal above one half. Character references are decoded, white space in a block
    (line breaks too) becomes one space, blocks keep their order and are joined by an empty line. Scripts, styles,
    templates and form controls never count. Null or empty HTML, or none of it content, gives an empty text. Broken
    markup is read as far as it goes (open paragraphs, items and cells end where HTML lets them end). Repeated rows are
    all returned, ids and urls may be null, an empty table gives no rows, other columns are ignored.
    """
    model = model or Model.fit(labelled_pages())
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract(model), "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
