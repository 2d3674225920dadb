"""Main text of a web page by a minimum cut between content and boilerplate.

A page is split into text blocks at block-level tags; scripts, styles, heads and
form controls have no text. A fixed linear classifier gives each block the cost
of either label, which are its capacities to the two terminals. It weighs the
block's length, share of links, punctuation and tag path; names of classes and
ids count as one feature among these, the less the more words the name has.

Smoothness edges join blocks that follow one another and blocks with the same or a
near container in the document tree; they are weak where a block or its container is
marked as something else than its neighbour, as a sidebar beside an article is. The
maximum flow gives the labelling of least total cost, so a short line or a
list within an article is kept, and a long line within a list of links goes.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches, struct, tidy

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: One attribute; a quoted value only begins. Quotes elsewhere are plain characters, as in browsers.
_ATTR = re.compile(r"[\s/]*+(?:(?P<name>=[^\s/<>=]*+|[^\s/<>=]++)(?:\s*+=\s*+(?:(?P<quote>[\"'])|[^\s<>]*+))?+)?+")
#: Names of attributes that say what an element is or whether it is seen.
TELLING = ("class", "id", "role", "aria-label", "itemprop", "style", "hidden", "aria-hidden")
_SCRIPT = re.compile(r"<!--|-->|<(?P<close>/?)script(?=[\s/>])", re.I)
_ATTRS = re.compile(r"([^\s/<>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button", "canvas", "title", "xmp", "noembed", "noframes"}
#: Of these, the ones that hold characters only: nothing but their own close tag ends them.
RAW_TEXT = {"script", "style", "noscript", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
_SAME = {t: re.compile(rf"<(?P<close>/?){t}(?=[\s/>])", re.I) for t in RAW - RAW_TEXT}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", "optgroup", "option", "label"}
#: What opens inside a paragraph and so ends it.
ENDS_P = BLOCK - {"html", "head", "body", "label"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Logit of content that an element by itself gives to the blocks in it. A block has the
#: lowest negative and the highest positive of its path.
BY_TAG = {"nav": -5.0, "footer": -5.0, "aside": -5.0, "form": -5.0, "menu": -5.0, "dialog": -5.0, "head": -9.0, "search": -5.0, "fieldset": -4.0, "address": -1.0, "header": -3.5, "article": 1.0, "main": 0.8}
BY_ROLE = {"navigation": -5.0, "banner": -4.0, "contentinfo": -5.0, "complementary": -5.0, "search": -5.0, "form": -5.0, "dialog": -5.0, "alert": -4.0, "alertdialog": -5.0, "menu": -5.0, "menubar": -5.0, "toolbar": -5.0, "main": 0.8, "article": 1.0}
BY_WORD = {
    **dict.fromkeys(("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "sitemap", "skip"), -4.0),
    **dict.fromkeys(("footer", "copyright", "colophon", "bottom"), -4.0),
    **dict.fromkeys(("sidebar", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "trending", "popular", "teaser", "outbrain", "taboola"), -4.5),
    **dict.fromkeys(("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "sponsors"), -4.5),
    **dict.fromkeys(("cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer", "privacy"), -4.5),
    **dict.fromkeys(("comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reviews"), -4.5),
    **dict.fromkeys(("share", "sharing", "social", "login", "signin", "search", "form", "tags", "masthead", "print"), -4.0),
    **dict.fromkeys(("article", "content", "post", "entry", "story", "main", "maincontent", "articlebody", "body", "text", "prose"), 0.6),
}
UNSEEN = -9.0
#: Of a name's weight what counts if it has three words or more, since these are seldom names of a page's parts.
LONG_NAME = 0.3
#: Bounds of what a block's length says, and what it says to be all link.
SHORT, LONG, LINKS = -0.6, 2.0, 3.0
#: Weights of edges; FOLLOWS within a container, FOLLOWS_OUT beyond it.
FOLLOWS, FOLLOWS_OUT, SAME_PARENT, NEAR_PARENT = 1.2, 0.4, 1.6, 0.4
#: Of an edge's weight what is left between blocks that are marked as different things.
TURN = 0.1
_LEGAL = re.compile(r"\xa9|copyright|all rights reserved", re.I)


@dataclass
class Node:
    tag: str
    parent: Node | None
    low: float = 0.0  # the least hint of the path
    high: float = 0.0  # the greatest
    mark: Node | None = None  # the nearest element of the path that gives a hint
    link: bool = False
    heading: bool = False
    box: Node | None = None  # the nearest container of several blocks

    def __post_init__(self) -> None:
        if self.parent is None or (self.tag in BLOCK and self.tag not in ("p", *HEADINGS, "li", "td", "th", "tr", "dt", "dd")):
            self.box = self
        else:
            self.box = self.parent.box


@dataclass
class Block:
    node: Node
    parts: list[str | Block] = field(default_factory=list)  # text, and blocks of inline elements that are marked
    link_chars: int = 0
    inner: bool = False
    text: str = ""  # its own, without that of the blocks in it


def _own(tag: str, attrs: str, inside_content: bool) -> float | None:
    """None: says nothing. A negative hint is kept against any positive one of the same element."""
    said = []
    if tag in BY_TAG:
        said.append(0.0 if tag == "header" and inside_content else BY_TAG[tag])
    if attrs:
        for name, a, b, c in _ATTRS.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden":
                said += [] if value in ("false", "until-found") else [UNSEEN]
            elif name == "aria-hidden":
                said += [UNSEEN] if value == "true" else []
            elif name == "style":
                said += [UNSEEN] if _UNSEEN.search(value) else []
            elif name == "role":
                said += [BY_ROLE[x] for x in value.split() if x in BY_ROLE]
            elif name in TELLING and tag not in ("html", "body"):
                for x in value.split() if name != "aria-label" else [value.strip()]:
                    words = [w for w in _SPLIT.split(x) if w]
                    part = LONG_NAME if len(words) > 2 else 1.0
                    said += [part * BY_WORD[w] for w in {*words, "".join(words)} if w in BY_WORD] + [UNSEEN] * (x == "hidden")
    return None if not said else min(said) if min(said) < 0 else max(said)


def _read_tag(page: str, at: int, dead: set[int]) -> tuple[int, str] | None:
    """Where a tag ends whose name ends at ``at``, and its attributes; None if a ``<`` or the end comes first.

    Quoted values of attributes that say nothing are left out. dead: places after
    quoted values that lead to no end, so that no stretch is read again and again.
    """
    said, seen = [], []
    while True:
        m = _ATTR.match(page, at)
        end = m.end()
        if not m["quote"]:
            said.append(m[0])
            if page[end : end + 1] == ">":
                return end + 1, "".join(said)
            if end > at and page[end : end + 1] not in ("<", ""):
                at = end
                continue
            break
        close = page.find(m["quote"], end)
        if close < 0:
            break
        said.append(m[0] + (page[end:close] if m["name"].lower() in TELLING else "") + m["quote"])
        at = close + 1
        if at in dead:
            break
        seen.append(at)
    dead.update(seen)
    return None


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the close tag of an element of characters begins, or the page ends."""
    if tag != "script":
        m = _RAW_END[tag].search(page, at)
        return m.start() if m else len(page)
    depth = 0  # 1: after <!--, 2: and in a script of its own there
    while m := _SCRIPT.search(page, at):
        at = m.end()
        if m[0] == "<!--":
            if not depth:
                depth, at = 1, at - 2
        elif m[0] == "-->":
            depth = 0
        elif m["close"]:
            if depth < 2:
                return m.start()
            depth = 1
        elif depth:
            depth = 2
    return len(page)


def _tokens(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """Tags as (name, whether it closes, attributes) and text as ("", False, text), each with its end; without comments, in linear time."""
    at, n = 0, len(page)
    dead: set[int] = set()
    ends = page.rfind(">")
    foreign = ""
    while at < n:
        if page[at] != "<":
            lt = page.find("<", at)
            lt = n if lt < 0 else lt
            yield "", False, page[at:lt], lt
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, at)
        if m:
            read = _read_tag(page, m.end(), dead)
            if read:
                at, attrs = read
                tag = m[2].lower()
                yield tag, m[1] == "/", attrs, at
                if tag in ("svg", "math") and not foreign:
                    foreign = "" if m[1] or attrs.endswith("/") else tag
                elif m[1] and tag == foreign:
                    foreign = ""
                elif tag in RAW_TEXT and not m[1] and not foreign:
                    at = _raw_end(page, tag, at)
                continue
        elif page[at + 1 : at + 2] in ("!", "?") and at < ends:
            at = page.find(">", at) + 1
            continue
        at += 1
        yield "", False, "<", at


def _closed(page: str, tag: str, at: int) -> bool:
    """Whether the close tag of an element comes before another of its kind opens."""
    m = _SAME[tag].search(page, at)
    return m is not None and m["close"] == "/"


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order of their beginnings, without empty ones."""
    root = Node("", None)
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of each tag in the stack
    in_blocks: list[int] = []  # places of block-level elements
    out: list[Block] = []
    current: Block | None = None
    around: list[tuple[int, Block | None]] = []  # the places of marked inline elements, and the blocks they interrupt
    skip, skip_closed = "", False

    def cut(k: int) -> None:
        nonlocal current
        while len(stack) > k:
            t = stack.pop().tag
            places[t].pop()
            if t in BLOCK:
                in_blocks.pop()
        while around and around[-1][0] >= k:
            current = around.pop()[1]

    for tag, close, t, end in _tokens(page):
        if skip:
            if close and tag == skip:
                skip = ""
                continue
            if skip_closed or close or tag not in BLOCK or tag in ("option", "optgroup", "hr"):
                continue
            skip = ""  # one that never ends hides no block after it
        if not tag:
            if current is None:
                current = Block(stack[-1])
                out.append(current)
            current.parts.append(t)
            if stack[-1].link:
                current.link_chars += len(t)
            continue
        if close:
            if places[tag] and (tag in BLOCK or not in_blocks or in_blocks[-1] < places[tag][-1]):
                cut(places[tag][-1])
            if tag in BLOCK:
                current = None
            continue
        if tag in RAW:
            if not t.endswith("/") or tag not in ("svg", "math"):
                skip, skip_closed = tag, tag in RAW_TEXT or _closed(page, tag, end)
            continue
        if tag in BLOCK:
            around[:] = [(k, None) for k, _ in around]
            if tag in ENDS_P and in_blocks and stack[in_blocks[-1]].tag == "p":
                cut(in_blocks[-1])
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                ends = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, (tag,))
                for i in range(len(in_blocks) - 1, -1, -1):
                    if stack[in_blocks[i]].tag in ends:
                        cut(in_blocks[i])
                        if tag != "tr":
                            break
                        continue
                    if stack[in_blocks[i]].tag != "p":
                        break
            if tag == "body":
                cut(1)
            current = None
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input") and current is not None:
                current.parts.append(" " if tag != "wbr" else "")
            continue
        up = stack[-1]
        own = _own(tag, t, up.high > 0)
        places[tag].append(len(stack))
        if tag in BLOCK:
            in_blocks.append(len(stack))
        elif own is not None and own < 0:
            if current is None:
                current = Block(up)
                out.append(current)
            around.append((len(stack), current))
            inner = Block(up, inner=True)
            current.parts.append(inner)
            current = inner
            out.append(inner)
        node = Node(tag, up, min(up.low, own or 0.0), max(up.high, own or 0.0), None, up.link or tag == "a", up.heading or tag in HEADINGS)
        node.mark = up.mark if own is None else node
        stack.append(node)
        if around and around[-1][0] == len(stack) - 1 and current is not None:
            current.node = node
    for b in out:
        b.text = _plain([x for x in b.parts if isinstance(x, str)])
        if not b.text:
            for x in b.parts:
                if isinstance(x, Block):
                    x.inner = b.inner
    return [b for b in out if b.text]


def _plain(parts: list[str]) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def logit(b: Block) -> float:
    """The classifier: positive where content is likelier."""
    words = b.text.count(" ") + 1
    z = 0.2 + b.node.low + b.node.high + min(LONG, max(SHORT, 1.2 * math.log(words / 10)))
    z -= LINKS * min(1.0, b.link_chars / max(1, len(b.text)))
    if b.text[-1] in ".!?:…\"'”":
        z += 0.5
    if b.node.heading:
        z += 1.0
    if words < 25 and _LEGAL.search(b.text):
        z -= 2.0
    return z


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: by order, and between neighbours in the same or the next outer container."""
    out: dict[tuple[int, int], float] = {}

    def add(i: int, j: int, w: float) -> None:
        a, b = bs[i].node, bs[j].node
        if a.mark is not b.mark and a.low != b.low:
            w *= TURN
        out[i, j] = out.get((i, j), 0) + w

    last: dict[int, int] = {}
    near: dict[int, int] = {}
    for j, b in enumerate(bs):
        if j:
            add(j - 1, j, FOLLOWS if bs[j - 1].node.box is b.node.box else FOLLOWS_OUT)
        c = b.node.box
        if id(c) in last:
            add(last[id(c)], j, SAME_PARENT)
        last[id(c)] = j
        if c.parent is not None:
            o = id(c.parent.box)
            if o in near and near[o] != j:
                add(near[o], j, NEAR_PARENT)
            near[o] = j
    return [(i, j, w) for (i, j), w in out.items()]


def min_cut(z: list[float], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: content) of least cost; of several such labellings the one with the fewest content blocks.

    A node's two terminal capacities are first cancelled against each other, which
    is the flow along source, node, sink; what remains flows over smoothness edges
    in phases: levels by distance from the nodes with excess, then augmenting
    paths along them until none is left (Dinic).
    """
    n = len(z)
    room = [_softplus(x) - _softplus(-x) for x in z]  # > 0: still joined to the source, < 0: to the sink
    to: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    cap: list[float] = []
    for i, j, w in smooth:
        to[i].append(len(head))
        head.append(j)
        cap.append(w)
        to[j].append(len(head))
        head.append(i)
        cap.append(w)
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if room[i] > eps]
        for i in queue:
            level[i] = 0
        far = -1  # the level of the nearest deficit
        for i in queue:
            if far >= 0 and level[i] >= far:
                break
            for e in to[i]:
                j = head[e]
                if level[j] < 0 and cap[e] > eps:
                    level[j] = level[i] + 1
                    if room[j] < -eps:
                        far = level[j]
                    queue.append(j)
        if far < 0:
            return [v >= 0 for v in level]  # reachable from the source: content
        used = [0] * n
        for start in queue:
            if level[start] or room[start] <= eps:
                continue
            path: list[int] = []
            i = start
            while room[start] > eps:
                if path and room[i] < -eps:
                    f = min(room[start], -room[i], *(cap[e] for e in path))
                    room[start] -= f
                    room[i] += f
                    for e in path:
                        cap[e] -= f
                        cap[e ^ 1] += f
                    path, i = [], start
                    continue
                if used[i] < len(to[i]) and level[i] < far:
                    e = to[i][used[i]]
                    if cap[e] > eps and level[head[e]] == level[i] + 1:
                        path.append(e)
                        i = head[e]
                    else:
                        used[i] += 1
                elif path:
                    e = path.pop()
                    i = head[e ^ 1]
                    used[i] += 1
                else:
                    break


def _text(b: Block, keep: dict[int, bool]) -> str:
    """Its text with that of the marked inline elements in it that are content."""
    return _plain([x if isinstance(x, str) else _text(x, keep) if keep.get(id(x)) else "" for x in b.parts])


def extract(page: str) -> tuple[str, int, int, int]:
    """Main text, how many blocks it has, how many the page has, and how many labels differ from the classifier's alone."""
    bs = blocks(page)
    z = [logit(b) for b in bs]
    keep = min_cut(z, edges(bs))
    by_block = {id(b): k for b, k in zip(bs, keep, strict=True)}
    kept = [t for b, k in zip(bs, keep, strict=True) if k and not b.inner and (t := _text(b, by_block))]
    return "\n\n".join(kept), len(kept), len(bs), sum(k != (x > 0) for k, x in zip(keep, z, strict=True))


def _run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        rows = [extract(x.as_py()) if x.is_valid else ("", 0, 0, 0) for x in arr]
        yield struct({"text": pa.array([r[0] for r in rows], pa.string())} | {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("n_blocks", "n_page_blocks", "n_smoothed"), 1)})


def extract_main(df: DataFrame, html: str = "html", into: str = "main") -> DataFrame:
    """Add the struct column ``into``: text (empty if there is none), n_blocks, n_page_blocks, n_smoothed.

    A null or empty page, and one without content, has an empty text. A block whose two
    labels cost the same is boilerplate. Pages of any length and depth are read as a whole,
    in time linear in their length but for the flow. Rows are kept as they are, repeated
    ones included; other columns pass through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    return df.withColumn(into, arrow_udf(tidy(_run), "text string, n_blocks long, n_page_blocks long, n_smoothed long")(F.col(html)))


def contract(pages: DataFrame) -> DataFrame:
    return extract_main(pages.select("page_id", "url", "html"), into="m").select("page_id", "url", "m.text", F.length("m.text").cast("long").alias("n_chars"), "m.n_blocks", "m.n_page_blocks", "m.n_smoothed")
