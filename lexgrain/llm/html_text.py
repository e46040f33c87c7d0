"""Main text of web pages by a hidden Markov tree over the DOM's blocks.

Each block is a node in one of three states: content, surroundings, or a neutral frame of both. A
parent-child potential says how often a child of that tag takes a state under a parent in one; below a
neutral parent, potentials of the child's whole stretch of text (its length, links and sentences), of its
place on the page and of text of its own come in. Messages pass upward and then downward (sum-product),
which gives each block its marginal. Potentials are counts over labelled pages: those of the table that
mark their article, each a second time with that mark hidden, and a few fixed ones labelled by hand.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch, full, replaced

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"[^>\"']*+>")
QUOTED_REST = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
GIVEN = re.compile(r"\by=([cbn])\b")
WORDS_OF_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# HTML's tags by role.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
ENDS_P = frozenset(BLOCKS) - {"body", "html", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "canvas"}
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FENCE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
NOT_MAIN = frozenset(("nav", "footer", "aside", "header", "form", "button", "menu", "dialog", "fieldset"))
# What class names and ids call surroundings and content; and words that only say which part of it.
SURROUNDING = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead comment comments "
    "disqus respond response responses reply replies discussion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search form share sharing social related "
    "recommended recommendations toolbar pagination pager tags copyright legal disclaimer hidden skip".split()
)
MAIN_NAMES = frozenset("article content main post entry story body text prose".split())
PART_WORDS = frozenset("list item items wrapper wrap container box block area section left right top bottom inner outer bar link links slot unit row col column group holder panel only site page global primary secondary".split())
BOILER, CONTENT, NEUTRAL = 0, 1, 2
FIXED_WEIGHT, TABLE_WEIGHT = 50.0, 500.0
BLOCK_SET, RAW_SET, VOID_SET = frozenset(BLOCKS), frozenset(RAW), frozenset(VOID)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}


class Node:
    __slots__ = ("parent", "tag", "mark", "chars", "linked", "stops", "at", "given", "whole", "place")

    def __init__(self, parent: int, tag: str, mark: str):
        self.parent, self.tag, self.mark, self.chars, self.linked, self.stops, self.at, self.given, self.whole, self.place = parent, tag, mark, 0, 0, 0, None, None, "", ""


def _named(value: str) -> str:
    """What a class name or id says: by its last word that is no mere part of something."""
    said = ""
    for name in value.split():
        words = [w.lower() for w in WORDS_OF_NAME.findall(name)]
        heads = [w for w in words if w not in PART_WORDS]
        if heads and heads[-1] in SURROUNDING:
            return "boiler"
        if heads and heads[-1] in MAIN_NAMES and SURROUNDING.isdisjoint(words):
            said = "content"
    return said


def _mark(attributes: str) -> str:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    names = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "boiler"
        if key in ("class", "id", "role", "itemprop"):
            names.append(value)
    return _named(" ".join(names)) if names else ""


def parse(page: str, teach: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block tree, and (node, text) of the stretches of text between block boundaries in page order; in time linear in the page.

    A tag whose quotes do not close ends at its first '>', and from there on quotes are not read; one
    without any '>' is the last of the page. teach: read the hand-written labels of the fixed pages.
    """
    nodes, texts = [Node(-1, "root", "")], []
    stack: list[tuple[str, int]] = [("root", 0)]  # open blocks
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is in the stack
    links, pos, pending, written = 0, 0, [], 0
    last, quotes, unclosed = page.rfind(">"), True, set()

    def flush():
        nonlocal written
        if pending:
            text = " ".join("".join(t for t, _ in pending).split())
            if text:
                node = nodes[stack[-1][1]]
                node.chars += len(text)
                node.linked += sum(len(t) for t, a in pending if a)
                node.stops += text.count(".") + text.count("!") + text.count("?")
                texts.append((stack[-1][1], text))
                if node.at is None:
                    node.at = written
                written += len(text)
            pending.clear()

    def close(upto: int):
        flush()
        for tag, _ in stack[upto:]:
            places[tag].pop()
        del stack[upto:]

    latest = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
    while True:
        at = page.find("<", pos)
        if at < 0:
            pending.append((entities.unescape(page[pos:]), links > 0))
            break
        if at > pos:
            pending.append((entities.unescape(page[pos:at]), links > 0))
        m = NAME.match(page, at + 1)
        if m is None:
            if page.startswith("<!--", at):
                pos = page.find("-->", at + 2) + 3
                if pos < 3:
                    break
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(page):
                pos = page.find(">", at) + 1
                if not pos:
                    break
            else:
                pending.append(("<", links > 0))
                pos = at + 1
            continue
        if at > last:  # a tag that the page breaks off
            break
        end = REST.match(page, m.end())
        if end is None and quotes:
            end = QUOTED_REST.match(page, m.end())
            quotes = end is not None
        pos = end.end() if end else page.find(">", m.end()) + 1
        if not pos:
            break
        tag, attributes = m[2].lower(), page[m.end() : pos - 1]
        if m[1]:
            if tag == "a":
                links = max(links - 1, 0)
            elif tag in BLOCK_SET:
                if places[tag]:
                    close(places[tag][-1])
                else:
                    flush()
            continue
        if tag in RAW_SET:
            pending.append((" ", False))
            if tag not in unclosed and not (tag == "svg" and attributes.endswith("/")):
                end = RAW_END[tag].search(page, pos)
                if end:
                    pos = end.end()
                elif tag in ("script", "style"):
                    break
                else:
                    unclosed.add(tag)
        elif tag in VOID_SET:
            if tag in ("br", "hr"):
                pending.append((" ", False))
                if tag == "hr":
                    flush()
        elif tag == "a":
            links += 1
        elif tag in BLOCK_SET:
            flush()
            if tag in ENDS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in SAME:
                same = latest(SAME[tag])
                if same > latest(FENCE[tag]):
                    close(next(k for k in sorted(places[t][-1] for t in SAME[tag] if places[t]) if k > latest(FENCE[tag])))
            links = 0
            up = stack[-1][1]
            nodes.append(Node(up, tag, _mark(attributes)))
            if teach and (given := GIVEN.search(attributes)):
                nodes[-1].given = "bcn".index(given[1])
            places[tag].append(len(stack))
            stack.append((tag, len(nodes) - 1))
    flush()
    _stretches(nodes, written)
    return nodes, texts


def _stretches(nodes: list[Node], written: int) -> None:
    """What each block holds with all inside it, and where on the page that lies."""
    n = len(nodes)
    chars, linked, stops, begin = [x.chars for x in nodes], [x.linked for x in nodes], [x.stops for x in nodes], [x.at for x in nodes]
    for k in range(n - 1, -1, -1):
        x, c = nodes[k], chars[k]
        size = "none" if not c else "short" if c < 25 else "middle" if c < 120 else "long" if c < 400 else "vast"
        x.whole = size if not c else f"{size} {'most' if 2 * linked[k] > c else 'some' if linked[k] else 'no'} {'stop' if stops[k] else 'open'}"
        middle = ((begin[k] or 0) + c / 2) / written if written else 0.5
        x.place = "first" if middle < 0.1 else "last" if middle > 0.9 else "middle"
        p = x.parent
        if p >= 0:
            chars[p] += c
            linked[p] += linked[k]
            stops[p] += stops[k]
            if begin[k] is not None and (begin[p] is None or begin[k] < begin[p]):
                begin[p] = begin[k]


def own(node: Node) -> str:
    return "none" if not node.chars else "short" if node.chars < 120 else "long"


def kind(node: Node, hide: bool = False) -> str:
    """What the parent-child potential goes by: a telling class or id, else the tag; hide: as if the article were not marked."""
    return node.mark or ("div" if hide and node.tag in ("article", "main") else node.tag)


def marks_article(nodes: list[Node]) -> bool:
    return any(n.tag in ("article", "main") for n in nodes)


def labels(nodes: list[Node]) -> list[int | None] | None:
    """States of a page that marks its article; None for a page that does not.

    Content is what stands in the article, surroundings what stands outside it or in a menu, header,
    footer, aside or form of it; frames are the blocks around it. Nothing is told from class names: a
    block inside that bears the name of surroundings has no label.
    """
    tag = "article" if any(n.tag == "article" for n in nodes) else "main"
    if not any(n.tag == tag for n in nodes):
        return None
    out: list[int | None] = [BOILER] * len(nodes)
    out[0] = NEUTRAL
    for k, n in enumerate(nodes[1:], 1):
        up = out[n.parent]
        if n.tag == tag and up in (BOILER, NEUTRAL) and n.mark != "boiler":
            out[k], p = CONTENT, n.parent
            while p > 0 and out[p] == BOILER:
                out[p], p = NEUTRAL, nodes[p].parent
        elif up == CONTENT:
            out[k] = BOILER if n.tag in NOT_MAIN else None if n.mark == "boiler" else CONTENT
        elif up is None:
            out[k] = None
    return out


def features(node: Node, hide: bool = False) -> tuple[str, ...]:
    """Names of the potentials below a frame: by the sort of block, its whole text, its place and text of its own."""
    tag = kind(node, hide)
    sort = "p" if tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "li") else "div" if tag in ("div", "section", "body", "td", "center", "content") else "other"
    return f"{sort} whole={node.whole}", f"{sort} place={node.place}", f"{sort} own={own(node)}"


def tally(nodes: list[Node], y: list[int | None], counts: Counter, weight: float = 1.0, hidden: bool = True) -> None:
    """hidden: count a page that marks its article a second time as one that does not."""
    marked = marks_article(nodes)
    for hide in (False, True) if marked and hidden else (not marked,):
        page = "marked" if marked and not hide else "plain"
        for k, n in enumerate(nodes[1:], 1):
            if y[k] is None or y[n.parent] is None:
                continue
            counts[f"edge\t{page} {kind(n, hide)}\t{y[n.parent]}\t{y[k]}"] += weight
            if y[n.parent] == NEUTRAL:
                for f in features(n, hide):
                    counts[f"node\t{f}\t\t{y[k]}"] += weight


#: Fixed pages with hand-written labels (y: content, b: surroundings, n: frame; inherited), for shapes that a table may lack.
SENTENCE = "This is a whole sentence of the story, as long as such sentences tend to be. "
FIXED_PAGES = [
    page.replace("{w}", SENTENCE)
    for page in (
        '<body y=n><header y=b><h1>Site</h1></header><div id="content" y=c><h1>Title</h1><p>{w}{w}</p><p>{w}</p><h2>Part</h2><ul><li>One thing.</li><li>Two.</li></ul><blockquote><p>{w}</p></blockquote><table><tr><td>1</td><td>2</td></tr></table><p>{w}{w}{w}</p>'
        '<div class="comments" y=b><p>{w}</p><p>{w}</p></div></div><div class="sidebar" y=b><ul><li><a href="/a">Other</a></li></ul></div><div class="cookie-notice" y=b><p>{w}</p></div><form y=b><p>Name</p></form><div class="ad" y=b><p>{w}</p></div><footer y=b><p>Copyright</p></footer></body>',
        '<body y=n><nav y=b><a href="/">Home</a></nav><div class="wrap" y=n><div class="post-body" y=c><h1>Title</h1><p>{w}{w}</p><p>No.</p><p>{w}</p></div><aside class="sidebar" y=b><p>{w}</p></aside></div><footer y=b>Copyright</footer></body>',
        "<body y=n><p y=c>{w}{w}</p><p y=c>{w}</p></body>",
        "<body y=n><div y=c><h1>Title</h1><p>{w}</p></div></body>",
        "<body y=n><h1 y=c>Title</h1><p y=c>{w}{w}</p><p y=c>Short.</p><ul y=c><li>One thing.</li></ul><h2 y=c>Part</h2><p y=c>{w}</p></body>",
        "<div y=c>{w}{w}{w}{w}{w}{w}{w}{w}{w}</div>",
        "<p y=c>{w}{w}</p>",
        "<body y=c>{w}{w}<p>{w}</p><div class=ad y=b>{w}</div></body>",
        '<html y=n><body y=n><div y=b><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></div><div y=n><div y=c><h1>Title</h1><div><p>{w}{w}</p></div><section><p>{w}</p></section></div><div y=b><a href="/x">More</a> <a href="/y">Most</a></div></div><div y=b>Copyright</div></body></html>',
        '<body y=n><table y=n><tr y=n><td y=b><a href="/">Home</a></td><td y=c><p>{w}{w}{w}</p></td></tr></table></body>',
        '<body y=n><header y=b><p>Site</p></header><main y=n><article y=c><header y=b><h1>T</h1><p>By me</p></header><h1>Title</h1><p>{w}{w}</p><div><p>{w}</p></div><section><h2>Part</h2><p>{w}</p></section><figure><figcaption>{w}</figcaption></figure>'
        '<ol><li>{w}</li></ol><pre>x</pre><dl><dt>a</dt><dd>b</dd></dl><h3>s</h3><h4>t</h4><table><tr><th>1</th><td>2</td></tr></table><aside y=b><p>{w}</p></aside><nav y=b><ul><li>n</li></ul></nav><form y=b><p>{w}</p></form><section class="comments" y=b><p>{w}</p></section>'
        '<div class="ad" y=b>{w}</div><footer y=b><p>{w}</p></footer></article></main><section y=b><p>{w}</p></section><div y=b><p>{w}</p></div><p y=b>{w}</p><aside y=b><p>{w}</p></aside><nav y=b><p>n</p></nav><dialog y=b><p>{w}</p></dialog><footer y=b><p>{w}</p></footer></body>',
        "<body y=n><main y=c><h1>Title</h1><p>{w}</p><p>{w}</p></main><div y=b><p>{w}</p></div></body>",
    )
]


def fixed() -> Counter:
    counts: Counter = Counter()
    for page in FIXED_PAGES:
        nodes, _ = parse(page, teach=True)
        y = [NEUTRAL] * len(nodes)
        for k, n in enumerate(nodes[1:], 1):
            y[k] = y[n.parent] if n.given is None else n.given
        tally(nodes, y, counts, FIXED_WEIGHT, hidden=False)
    return counts


class Tree:
    """Potentials from counts, and the marginals of a page's blocks."""

    def __init__(self, counts: dict[str, float]):
        edge: dict[tuple[str, int], np.ndarray] = defaultdict(lambda: np.zeros(3))
        node: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        for key, n in counts.items():
            sort, name, up, y = key.split("\t")
            if sort == "edge":
                edge[name, int(up)][int(y)] += n
                edge[name.partition(" ")[0], int(up)][int(y)] += n
            elif sort == "node":
                node[name][int(y)] += n
        self.edges: dict[str, np.ndarray] = {}
        for name in {x for x, _ in edge} | {"marked", "plain"}:
            rows = []
            for up in range(3):
                every = edge[name.partition(" ")[0], up] + 1.0
                rows.append((edge[name, up] + 1e-3 * every / every.sum()) / (edge[name, up].sum() + 1e-3) if " " in name else every / every.sum())
            self.edges[name] = np.array(rows)
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
        many: Counter = Counter()
        for name, n in node.items():
            sums[name.partition("=")[0]] += n
            many[name.partition("=")[0]] += 1
        self.nodes = {name: (n + 1.0) / (sums[name.partition("=")[0]] + many[name.partition("=")[0]] + 1.0) for name, n in node.items()}

    def tables(self, nodes: list[Node]) -> list[list[list[float]]]:
        """For each node (3 states of its parent) x (its own 3); the features count below a frame."""
        page = "marked" if marks_article(nodes) else "plain"
        known: dict[tuple, list] = {}
        out = []
        for x in nodes:
            key = (kind(x), *features(x))
            if key not in known:
                t = self.edges.get(f"{page} {key[0]}", self.edges[page]).copy()
                for f in key[1:]:
                    t[NEUTRAL] *= self.nodes.get(f, 1.0)
                t[NEUTRAL] /= t[NEUTRAL].sum()
                known[key] = t.tolist()
            out.append(known[key])
        return out

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(state) of each node; the root is a frame. Features that the potentials of a row rest on are normalised in it."""
        n, table = len(nodes), self.tables(nodes)
        up, message = [[1.0, 1.0, 1.0] for _ in range(n)], [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):  # children come after their parents
            a, b, c = up[k]
            m = [r[0] * a + r[1] * b + r[2] * c for r in table[k]]
            s = m[0] + m[1] + m[2]
            message[k] = (m[0] / s, m[1] / s, m[2] / s)
            p = up[nodes[k].parent]
            x, y, z = p[0] * message[k][0], p[1] * message[k][1], p[2] * message[k][2]
            s = x + y + z
            up[nodes[k].parent] = [x / s, y / s, z / s]
        belief = [(0.0, 0.0, 1.0)] * n
        for k in range(1, n):
            p, t, m = belief[nodes[k].parent], table[k], message[k]
            f = [p[i] / max(m[i], 1e-300) for i in range(3)]
            v = [(f[0] * t[0][j] + f[1] * t[1][j] + f[2] * t[2][j]) * up[k][j] for j in range(3)]
            s = v[0] + v[1] + v[2]
            belief[k] = (v[0] / s, v[1] / s, v[2] / s)
        return np.array(belief)

    def extract(self, page: str | None, threshold: float = 0.5) -> str:
        if not page:
            return ""
        nodes, texts = parse(page)
        p = self.marginals(nodes)[:, CONTENT]
        return "\n".join(t for k, t in texts if p[k] >= threshold)


def train(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Counts over all pages that mark their article, by tag and feature: a few hundred numbers, whatever the table.

    They weigh as so many pages, TABLE_WEIGHT, whatever the number of pages they are the mean of.
    """

    def run(batches):
        counts: Counter = Counter()
        for pdf in full(batches):
            for page in pdf["html"]:
                if page:
                    nodes, _ = parse(page)
                    if (y := labels(nodes)) is not None:
                        counts["pages"] += 1
                        tally(nodes, y, counts)
        if counts:
            yield pd.DataFrame({"key": list(counts), "n": [float(v) for v in counts.values()]})

    sums = pages.select(F.col(html).cast("string").alias("html")).mapInPandas(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n"))
    counts = {r.key: r.n for r in sums.collect()}
    many = counts.pop("pages", 1.0)
    return Counter({k: n * TABLE_WEIGHT / many for k, n in counts.items()}) + fixed()


def main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", model: dict[str, float] | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty page, or one of which no block is content, has an empty text. Broken markup is read
    as far as it goes, in time linear in the page: open tags end with the page, stray end tags count for
    nothing. A block whose probability is just the threshold stays. Repeated rows, null ids and very long
    pages are rows like any other; an empty table gives none. Columns beside the three named are not read.
    """
    Scratch(pages.sparkSession, "html")
    shared = pages.sparkSession.sparkContext.broadcast(dict(model if model is not None else train(pages, html)))

    def run(batches):
        tree = Tree(shared.value)
        for batch in batches:
            text = [tree.extract(page) for page in batch.column("__html").to_pylist()]
            yield replaced(batch, ("__html",), {"text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})

    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("__html"))
    return source.mapInArrow(run, source.drop("__html").schema.add("text", "string").add("n_chars", "long"))
