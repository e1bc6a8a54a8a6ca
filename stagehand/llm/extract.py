"""Operator 5: main-text extraction by minimum cut.

A page is cut into text blocks. A classifier gives each block two costs, of
calling it boilerplate and of calling it content; they are the capacities from
the source and to the sink. Blocks that follow each other and blocks that share
a parent are joined by smoothness edges, weaker the further apart they are in
the tree. The minimum cut, found by maximum flow, is the labelling of least
total cost; the source side is the main text.

Each page is labelled alone, inside an Arrow batch, without a shuffle.

Defined results: null or empty html gives an empty text; markup that never
closes, or closes what was not open, ends where its parent ends; script, style
and the like end at their own end tag, or at the end of the page; a null url
stays null; repeated rows are each extracted; an empty table gives no rows; no
text is dropped for its length, and the time for a page grows with its length
however its markup is made; other columns are ignored.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import slices

TEXTS = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>"  # in HTML a CDATA marker ends at the first > as well
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>", re.S)
_CUT_TAG = re.compile(r"</?[a-zA-Z][^>]*\Z")
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)", re.S)

#: Elements whose content is no page text.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp template object svg canvas audio video noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var math mi mn mo mrow ms mtext msub msup msubsup mfrac msqrt".split())
#: An open element of the first set ends when an element of the second begins.
_BLOCKS_END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                          "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
             "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}}
_ENDERS = frozenset().union(*_ENDED_BY.values())
#: Elements nested deeper than this are read as part of the innermost one, as browsers do.
_DEPTH = 512
_SCOPE = frozenset("html body article aside blockquote div dl fieldset figure footer form header main nav ol section table ul".split())

_BOILER_TAGS = frozenset("nav footer aside form menu dialog button select datalist fieldset legend noscript head".split())
# Names of page parts that are no main text.
_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion "
    "recommended recommendations related replies reply search share sharing sidebar signin signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget alert complementary contentinfo respond".split())
#: Those that stay so however much of the page's text they hold.
_NEVER_MAIN = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus gdpr replies reply respond".split())
#: Parts of a hyphenated name that say where or how a page part is, not what it is.
_PLACES = frozenset("left right top bottom list box area section block item items link links bar inner posts articles buttons".split())
_HEADERS = frozenset("header topnav siteheader site-header pageheader page-header main-header top-header".split())
_MAIN_WORDS = re.compile(r"(?<![a-z])(?:article|articlebody|body|content|entry|main|post|prose|story|text)(?![a-z])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True, eq=False)
class _Node:
    tag: str
    parent: _Node | None
    depth: int
    boiler: float  # evidence of the element and all around it
    main: float
    in_article: bool
    hint: float = 0.0  # of ``boiler``, what the element's own name gave and much text inside it takes back
    chars: int = 0     # of the blocks inside, links left out
    relief: float = 0.0


@dataclass(slots=True)
class Block:
    node: _Node
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _part(name: str) -> str | None:
    """The page part that a class, id or role names as a whole: its last word that is no place, if it is a part."""
    words = [w for w in name.split("-") if w and not w.isdigit()]
    while len(words) > 1 and words[-1] in _PLACES:
        words.pop()
    return words[-1] if words and words[-1] in _PARTS else None


def _evidence(tag: str, attrs: str, parent: _Node | None) -> _Node:
    boiler, main = (parent.boiler, parent.main) if parent else (0.0, 0.0)
    in_article = bool(parent and parent.in_article) or tag in ("article", "main")
    if tag in _BOILER_TAGS or tag == "header" and not (parent and parent.in_article):
        boiler += 12
    if tag in ("article", "main"):
        main += 6
    hint = 0.0
    if attrs:
        names = []
        for name, a, b, c, bare in _ATTR.findall(attrs):
            name, value = (name or bare).lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                names += _CAMEL.sub("-", value).lower().replace("_", "-").split()
            elif name == "aria-label":
                names.append("-".join(value.lower().split()))
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                boiler += 30
        if names and tag not in ("html", "body"):
            parts = {p for p in map(_part, names) if p}
            if tag not in ("article", "main") and (parts or not in_article and _HEADERS.intersection(names)):
                boiler += 12
                hint = 0.0 if parts & _NEVER_MAIN else 12.0
            elif _MAIN_WORDS.search(" ".join(names)):
                main += 2
    return _Node(tag, parent, parent.depth + 1 if parent else 0, boiler, main, in_article, hint)


def _take_back_hints(nodes: list[_Node], blocks: list[Block]) -> None:
    """An element that holds most of the text is no sidebar, whatever its name: its
    own hint is taken back from all inside it. Most of the text is half of the
    article's, or of the page's where no article is marked. One pass up, one down."""
    article = [b for b in blocks if b.node.in_article]
    for b in article or blocks:
        b.node.chars += len(b.text) - min(b.link_chars, len(b.text))
    total = sum(n.chars for n in nodes)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
    for n in nodes:
        n.relief = n.parent.relief if n.parent is not None else 0.0
        if n.hint and 2 * n.chars > total:
            n.relief += n.hint


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, character references decoded, white space made one space."""
    root = _evidence("html", "", None)
    stack, nodes = [root], [root]
    out: list[Block] = []
    block: Block | None = None
    links = at = 0
    opened: Counter[str] = Counter()

    def text(a: int, z: int) -> None:
        nonlocal block
        if z <= a:
            return
        piece = page[a:z]
        if "&" in piece:
            piece = entities.unescape(piece)
        if block is None:
            if not piece.strip():
                return
            holder = top = stack[-1]
            while holder.tag in _INLINE and holder.parent is not None:
                holder = holder.parent
            block = Block(holder if holder.boiler >= top.boiler else top)
            out.append(block)
        block.parts.append(piece)
        if links:
            block.link_chars += len(piece.strip())

    def pop_to(k: int) -> None:
        nonlocal links, block
        for n in stack[k:]:
            opened[n.tag] -= 1
            links -= n.tag == "a"
            if n.tag not in _INLINE:
                block = None
        del stack[k:]

    pos, size, last = 0, len(page), page.rfind(">")
    while True:
        m = _TOKEN.search(page, pos) if pos <= last or page.find("<!--", pos) >= 0 else None
        if m is None:
            break
        text(at, m.start())
        at = pos = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "br":
                text_break = block
                if text_break is not None:
                    text_break.parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            if tag not in _INLINE:
                block = None
            continue
        if tag in _RAW and not m["attrs"].rstrip().endswith("/"):
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            at = pos = closing.end() if closing else size
            continue
        if tag in ("br", "wbr", "img"):
            if block is not None and tag == "br":
                block.parts.append(" ")
            continue
        if tag in _BLOCKS_END_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        for k in range(len(stack) - 1, 0, -1) if tag in _ENDERS else ():
            if tag in _ENDED_BY.get(stack[k].tag, ()):
                pop_to(k)
                break
            if stack[k].tag not in _INLINE and stack[k].tag != "p" and stack[k].tag not in _ENDED_BY:
                break
        if tag in _VOID:
            block = None
            continue
        if tag not in _INLINE:
            block = None
        if len(stack) >= _DEPTH:
            continue
        stack.append(_evidence(tag, m["attrs"], stack[-1]))
        nodes.append(stack[-1])
        opened[tag] += 1
        links += tag == "a"
    cut = _CUT_TAG.search(page, at)
    text(at, cut.start() if cut else size)
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    if any(n.hint for n in nodes):
        _take_back_hints(nodes, out)
    return out


def costs(b: Block, has_article: bool) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content).
    ``has_article``: the page marks its article, so text outside of it is suspect."""
    n, tag = len(b.text), b.node.tag
    keep, drop = 1.0 + b.node.main, b.node.boiler - b.node.relief
    keep += min(n / 80, 5.0)
    if tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"):
        keep += 1.5
    if b.text[-1:] in ".!?…”\"»":
        keep += 0.5
    linked = min(1.0, b.link_chars / n)
    drop += 6.0 * linked if linked > 0.3 else 0.0
    if n < 25 and tag not in ("p", "h1", "h2", "h3", "td", "th", "li"):
        drop += 1.0
    if has_article and not b.node.in_article:
        drop += 2.0
    if re.match(r"(?:©|\(c\)|copyright\b)", b.text, re.I):
        drop += 4.0
    return keep, drop


def _tree_distance(a: _Node, b: _Node) -> int:
    d = 0
    while a is not b and d < 8:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        d += 1
    return d


def min_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: ``keep[i]`` is paid if i is cut from
    the source, ``drop[i]`` if it stays on the source side, ``w`` for each edge
    whose ends differ. Dinic's maximum flow on the residual graph."""
    n = len(keep)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, forward: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(forward)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):  # the flow source - i - sink is pushed at once; the rest stays
        if keep[i] > drop[i]:
            add(source, i, keep[i] - drop[i], 0.0)
        elif drop[i] > keep[i]:
            add(i, sink, drop[i] - keep[i], 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(adj[u]):
                path.append(adj[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def label(blocks: list[Block]) -> list[bool]:
    has_article = any(b.node.in_article for b in blocks)
    pairs = [costs(b, has_article) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    last_child: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 2.0 / (1 + _tree_distance(blocks[i - 1].node, b.node))))
        parent = id(b.node.parent)
        if last_child.get(parent, i - 1) != i - 1:
            edges.append((last_child[parent], i, 0.5))
        last_child[parent] = i
    return min_cut([k for k, _ in pairs], [d for _, d in pairs], edges)


def main_text(page: str) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    blocks = blocks_of(page)
    kept = [b.text for b, content in zip(blocks, label(blocks), strict=True) if content]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page (schema ``TEXTS``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            got = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch({
                "page_id": b.column(0), "url": b.column(1), "text": pa.array([g[0] for g in got], pa.string()),
                "n_chars": [len(g[0]) for g in got], "n_blocks": [g[1] for g in got], "n_kept": [g[2] for g in got]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, TEXTS)
