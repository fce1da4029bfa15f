"""Main text of web pages by a tree-structured graphical model.

Every block element of the DOM carries a hidden label: content or not. A node's own evidence is a logistic model of its
features; each parent-child edge has a 2 x 2 potential. Sum-product messages, first up from the leaves and then down from
the root, give each node's marginal, and the text of blocks with a marginal of one half or more is the main text.

Both parts are trained from labelled pages: the small set below, whose elements carry their label in the attribute y, and
a bounded sample of the table's own pages. Those are labelled by their structure alone: what stands in the page's article
or main element is content, but for landmark elements there; blocks with names of their own are left out of training.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import NO_ID, batches_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes select datalist".split())
BLOCK = frozenset("html body div p article main section nav header footer aside form h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend details summary hr center dialog menu search hgroup button head".split())
CLOSES_P = BLOCK - {"html", "body", "head", "button", "caption", "td", "th", "tr", "thead", "tbody", "tfoot", "legend", "summary"}
SELF_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
_LANDMARKS = frozenset("nav header footer aside button dialog menu search".split())
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot body html".split())
SCOPE = frozenset("html body div article main section nav header footer aside form ul ol dl table blockquote figure details td th fieldset dialog".split())

_GOOD = re.compile(r"article|content|entry|story|post(?!er)|main|body|text|prose")
_BAD = {
    "ad": re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|adsense|banner|sponsor\w*|promo\w*|outbrain|taboola)(?:$|[\s_-]|\d)"),
    "menu": re.compile(r"nav|menu|breadcrumb|toolbar|pagination|pager|tabs|skip"),
    "side": re.compile(r"side|widget|related|recommend|popular|trending|rail|more-|toc"),
    "talk": re.compile(r"comment|repl(?:y|ies)|disqus|discuss|respond|thread|feedback"),
    "note": re.compile(r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|newsletter|subscri|signup|sign-up|paywall|toast|disclaimer"),
    "edge": re.compile(r"foot|head(?!line|ing)|masthead|copyright|legal|logo|topbar|site-"),
    "share": re.compile(r"share|social|follow|like|tags|byline-links|print"),
    "form": re.compile(r"form|login|search|input|captcha"),
}
_TAGS = "article main section nav header footer aside form p h1 h2 h3 h4 ul ol li table td blockquote pre figure figcaption address details button dialog fieldset dl dd div".split()
_NAMES = [*(f"<{t}>" for t in _TAGS), "<article> in clutter", "<main> in clutter", "other", "good", *_BAD, "in:clutter", *(f"in:{k}" for k in ("nav", "header", "footer", "aside", "form", "article", "main")), "text", "links", "short", "stops", "empty", "bias"]
_AT = {n: i for i, n in enumerate(_NAMES)}
WIDTH = len(_NAMES)


class Node:
    __slots__ = ("tag", "parent", "names", "y", "parts", "linked", "kids", "open")

    def __init__(self, tag: str, parent: int, names: str, y: str | None):
        self.tag, self.parent, self.names, self.y = tag, parent, names, y
        #: runs of (position in the page, text) directly in this block
        self.parts: list[list] = []
        self.linked, self.kids, self.open = 0, 0, False


def parse(page: str) -> list[Node]:
    """Block elements of the page in order, parents first; inline elements only add to the text of their block. Broken
    markup is mended the usual way: a new block closes an open p, and an end tag closes what stands open inside."""
    nodes = [Node("html", -1, "", None)]
    #: open block elements, and for each tag the places in the stack where it stands; a tag is looked up, never searched for
    stack: list[tuple[str, int]] = [("html", 0)]
    places: dict[str, list[int]] = defaultdict(list)
    order = p = 0
    #: depth of the stack where the open link began; 0 outside links
    link = 0

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def say(text: str) -> None:
        nonlocal order
        if text:
            n = nodes[stack[-1][1]]
            if n.parts and n.open:
                n.parts[-1][1].append(text)
            elif not text.isspace():
                order += 1
                n.parts.append([order, [text]])
                n.open = True
            if link:
                n.linked += len(text)

    def cut() -> None:
        nodes[stack[-1][1]].open = False

    def close(k: int) -> None:
        nonlocal link
        while len(stack) > k:
            cut()
            places[stack.pop()[0]].pop()
        cut()
        if link > len(stack):
            link = 0

    while p < len(page):
        m = _TOKEN.search(page, p)
        if not m:
            say(page[p:])
            break
        say(page[p : m.start()])
        p = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if tag == "br":
                say(" ")
            elif tag == "a":
                link = 0
            elif places[tag]:
                k = places[tag][-1]
                if tag in TABLE_PARTS or k > last(("td", "th", "table")):
                    close(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, p)
                p = end.end() if end else len(page)
            if tag == "svg" or tag == "select":
                say(" ")
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                say(" ")
            continue
        if tag in BLOCK:
            if tag in CLOSES_P and places["p"] and places["p"][-1] > last(SCOPE):
                close(places["p"][-1])
            if tag in SELF_CLOSE:
                while (k := last(SELF_CLOSE[tag])) > last(SCOPE - {"td", "th"}):
                    close(k)
            cut()
            if tag == "hr" or tag in ("html", "body") and len(nodes) > 1 and (tag == "html" or places[tag]):
                continue
            names, y = "", None
            if attributes:
                a = {x[0].lower(): x[1] or x[2] or x[3] for x in _ATTRIBUTE.findall(attributes)}
                names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')} {a.get('itemprop', '')} {a.get('aria-label', '')}".lower().strip()
                if "hidden" in a or "display:none" in a.get("style", "").replace(" ", "") or a.get("aria-hidden") == "true":
                    names += " hidden-popup"
                y = a.get("y")
            parent = stack[-1][1]
            nodes[parent].kids += 1
            nodes.append(Node(tag, parent, names, y))
            places[tag].append(len(stack))
            stack.append((tag, len(nodes) - 1))
        elif tag == "a" and not attributes.endswith("/"):
            link = len(stack)
    return nodes


def words_of(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


_names_cache: dict[str, tuple[int, ...]] = {}


def named(names: str) -> tuple[int, ...]:
    """Features of an element's class, id and role; the cache is emptied when full."""
    if names not in _names_cache:
        if len(_names_cache) > 20_000:
            _names_cache.clear()
        bad = [_AT[k] for k, r in _BAD.items() if r.search(names)]
        _names_cache[names] = tuple(bad or ([_AT["good"]] if _GOOD.search(names) else []))
    return _names_cache[names]


def wrappers(nodes: list[Node]) -> list[bool]:
    """Forms that wrap a page: they hold landmarks or an article, or three paragraphs and half of the page's text."""
    n = len(nodes)
    size = [sum(len(s) for _, parts in x.parts for s in parts) for x in nodes]
    holds, paragraphs = [x.tag in ("article", "main", "nav", "header", "footer") for x in nodes], [x.tag == "p" for x in nodes]
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        size[up] += size[i]
        holds[up] |= holds[i]
        paragraphs[up] += paragraphs[i]
    return [x.tag == "form" and (holds[i] or paragraphs[i] >= 3 and 2 * size[i] >= size[0]) for i, x in enumerate(nodes)]


def cluttered(nodes: list[Node], wrap: list[bool]) -> list[bool]:
    """Whether a node is a landmark, a form that doesn't wrap the page, or named as clutter, or stands within such a node."""
    out: list[bool] = []
    for n, w in zip(nodes, wrap, strict=True):
        own = not w and (n.tag in _LANDMARKS or n.tag == "form" or bool(n.names) and any(_NAMES[k] in _BAD for k in named(n.names)))
        out.append(own or n.parent >= 0 and out[n.parent])
    return out


def forms(nodes: list[Node]) -> list[bool]:
    return wrappers(nodes) if any(x.tag == "form" for x in nodes) else [False] * len(nodes)


def evidence(nodes: list[Node]) -> list[list[tuple[int, float]]]:
    """Sparse features of every node: its own tag, names and text, and the landmark elements around it. A form that wraps
    the page counts as a div. An article within clutter (a comment, a teaser) is another feature than one in the open, and
    what stands in it isn't in an article."""
    around: list[frozenset] = []
    out = []
    wrap = forms(nodes)
    lost = cluttered(nodes, wrap)
    for n, wrapper, clutter in zip(nodes, wrap, lost, strict=True):
        up = around[n.parent] if n.parent >= 0 else frozenset()
        tag = "div" if wrapper else f"{n.tag}> in clutter" if clutter and n.tag in ("article", "main") else n.tag
        here = up | {tag} if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else up
        around.append(here | {"clutter"} if clutter else here)
        f = [(_AT["bias"], 1.0), (_AT.get(f"<{tag}" if clutter and ">" in tag else f"<{tag}>", _AT["other"]), 1.0)]
        f += [(k, 1.0) for k in named(n.names)] if n.names else []
        f += [(_AT[f"in:{t}"], 1.0) for t in up]
        size = sum(len(s) for _, parts in n.parts for s in parts)
        if size:
            text = n.parts[0][1][0]
            f.append((_AT["text"], math.log1p(size) / 6))
            f.append((_AT["links"], min(1.0, n.linked / size)))
            if size < 40:
                f.append((_AT["short"], 1.0))
            if size > 60 and any(s.rstrip()[-1:] in ".!?…" for s in (text, n.parts[-1][1][-1])):
                f.append((_AT["stops"], 1.0))
        else:
            f.append((_AT["empty"], 1.0))
        out.append(f)
    return out


def kinds(nodes: list[Node]) -> list[int]:
    """Which potential joins each node to its parent: 1 for landmarks and blocks named as clutter, which say little of what
    they stand in, 2 for plain blocks in an article or main element in the open, whose lot they share, and 0 for all others."""
    wrap = forms(nodes)
    lost = cluttered(nodes, wrap)
    own = [n.tag in _LANDMARKS or n.tag == "form" and not w or bool(n.names) and any(_NAMES[k] in _BAD for k in named(n.names)) for n, w in zip(nodes, wrap, strict=True)]
    return [1 if o else 2 if n.parent >= 0 and nodes[n.parent].tag in ("article", "main") and not lost[n.parent] else 0 for n, o in zip(nodes, own, strict=True)]


class Model:
    """weights of the node evidence; edge[k][a][b] = log potential of parent a and child b for children of kind k."""

    def __init__(self, weights: np.ndarray, edge: list[list[list[float]]]):
        self.weights, self.edge = weights.tolist(), edge

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node by sum-product on the tree."""
        w, edges = self.weights, [self.edge[k] for k in kinds(nodes)]
        own = [sum(w[k] * v for k, v in f) for f in evidence(nodes)]  # log odds
        n = len(nodes)
        below = own[:]  # log odds with what the subtree says
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            e = edges[i]
            up[i] = _message(below[i], e[0][0], e[0][1], e[1][0], e[1][1])
            below[nodes[i].parent] += up[i]
        full = below[:]
        for i in range(1, n):
            p, e = nodes[i].parent, edges[i]
            full[i] = below[i] + _message(full[p] - up[i], e[0][0], e[1][0], e[0][1], e[1][1])
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in full]


def _message(odds: float, k00: float, k01: float, k10: float, k11: float) -> float:
    """Log odds that the far end sees: its state a against the near end's state b with log odds; k[a][b] is the potential."""
    a0, b0, a1, b1 = k00, k01 + odds, k10, k11 + odds
    top0, top1 = max(a0, b0), max(a1, b1)
    return top1 + math.log(math.exp(a1 - top1) + math.exp(b1 - top1)) - top0 - math.log(math.exp(a0 - top0) + math.exp(b0 - top0))


def main_text(page: str, model: Model) -> str:
    """Blocks of content in page order, joined by two line feeds. A page without any block element is one block, and its text."""
    nodes = parse(page)
    bare = all(n.tag in ("html", "body", "head") for n in nodes)
    p = [1.0] * len(nodes) if bare else model.marginals(nodes)
    blocks = sorted((order, parts) for n, x in zip(nodes, p, strict=True) if x >= 0.5 for order, parts in n.parts)
    return "\n\n".join(t for t in (words_of(parts) for _, parts in blocks) if t)


def marked(nodes: list[Node]) -> list[int]:
    """Labels of a built-in example, from the attributes y, which children inherit. Pages of a table are never read so."""
    y: list[int] = []
    for n in nodes:
        y.append(int(n.y) if n.y in ("0", "1") else y[n.parent] if n.parent >= 0 else 0)
    return y


def structural(nodes: list[Node]) -> list[int | None]:
    """Labels of a page by its structure: content is what stands in an article or main element, not within a landmark of
    another kind there. A form is no content unless it wraps the page.
    Named blocks of an article may be anything and have no label, nor has what stands in them."""
    y: list[int | None] = []
    for n, wrapper in zip(nodes, wrappers(nodes), strict=True):
        own = y[n.parent] if n.parent >= 0 else 0
        if n.tag in ("article", "main"):
            own = 1 if own == 0 else own
        elif n.tag in _LANDMARKS or n.tag == "form" and not wrapper:
            own = 0
        elif own == 1 and n.names:
            own = None
        y.append(own)
    return y


def plain(nodes: list[Node]) -> list[Node]:
    """The same page with its article and main elements written as div, so that the model also learns from the rest."""
    out = []
    for n in nodes:
        c = Node("div" if n.tag in ("article", "main") else n.tag, n.parent, n.names, n.y)
        c.parts, c.linked, c.kids = n.parts, n.linked, n.kids
        out.append(c)
    return out


def train(pages: list[str], steps: int = 300, decay: float = 1e-4) -> Model:
    """Weights and potentials by gradient ascent on the likelihood of the labelled trees, each page with the same weight.

    The gradient is observed less expected counts, of node features and of parent-child label pairs; the expectations are
    the marginals that sum-product gives, for all trees at once, level by level. Every page is there twice, the second time
    without the names of its article and main elements."""
    rows, labels, parent, kind, depth, weight = [], [], [], [], [], []
    built_in = [(tree := parse(page), marked(tree)) for page in examples()]
    for share, own in ((3.0, built_in), (1.0, [(tree := parse(page), structural(tree)) for page in pages])):
        for tree, y in own:
            for nodes in (tree, plain(tree)):
                known = [i for i in range(len(nodes)) if y[i] is not None and (i == 0 or y[nodes[i].parent] is not None)]
                at = {i: len(rows) + k for k, i in enumerate(known)}
                found, sort = evidence(nodes), kinds(nodes)
                for i in known:
                    rows.append(found[i])
                    labels.append(y[i])
                    parent.append(at[nodes[i].parent] if i else -1)
                    kind.append(sort[i])
                    depth.append(depth[parent[-1]] + 1 if i else 0)
                    weight.append(share / len(known) / len(own))
    x = np.zeros((len(rows), WIDTH))
    for i, f in enumerate(rows):
        for k, v in f:
            x[i, k] += v
    y, parent, kind, depth, c = np.array(labels), np.array(parent), np.array(kind), np.array(depth), np.array(weight)
    c /= c.sum()
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind[child], y[parent[child]], y[child]), c[child])
    start = np.log((seen + 1e-3) / (seen + 1e-3).sum(axis=2, keepdims=True))
    theta = np.concatenate([np.zeros(WIDTH), start.ravel()])
    low, m, s = np.concatenate([np.zeros(WIDTH), start.ravel()]), np.zeros_like(theta), np.zeros_like(theta)

    def message(odds, e):
        return np.logaddexp(e[:, 1, 0], e[:, 1, 1] + odds) - np.logaddexp(e[:, 0, 0], e[:, 0, 1] + odds)

    for step in range(1, steps + 1):
        e = theta[WIDTH:].reshape(3, 2, 2)
        below, up = x @ theta[:WIDTH], np.zeros(len(x))
        for own in reversed(levels):
            up[own] = message(below[own], e[kind[own]])
            np.add.at(below, parent[own], up[own])
        full = below.copy()
        for own in levels:
            full[own] += message(full[parent[own]] - up[own], e[kind[own]].transpose(0, 2, 1))
        pair = e[kind[child]] + (full[parent[child]] - up[child])[:, None, None] * np.array([0, 1])[:, None] + below[child][:, None, None] * np.array([0, 1])
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair *= (c[child] / pair.sum(axis=(1, 2)))[:, None, None]
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, kind[child], pair)
        g = np.concatenate([x.T @ (c * (1 / (1 + np.exp(-np.clip(full, -40, 40))) - y)), (expected - seen).ravel()]) + decay * (theta - low)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(3, 2, 2).tolist())


def examples() -> list[str]:
    """Labelled pages: layouts built from the same parts, with the label in y."""
    say = "The river rose slowly through the night and by morning it had reached the lower fields. Farmers moved their animals to the hill before noon, and nobody was hurt."
    brief = "They waited for news."
    items = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in ("Home", "World", "Sport", "Weather", "Contact"))
    body = f"<h1>River reaches the lower fields</h1><p>{say}</p><p>{brief}</p><h2>What comes next</h2><p>{say} {say}</p><ul><li>{say}</li><li>{brief}</li></ul><blockquote><p>{say}</p></blockquote><p>Read <a href='/x'>the report</a> of last year. {brief}</p><table><tr><td>Monday</td><td>{brief}</td></tr></table><pre>level 3.2</pre><h3>{brief}</h3><dl><dt>Gauge</dt><dd>{say}</dd></dl><h4>{brief}</h4><ol><li>{say}</li></ol><figure><img src=a><figcaption>{brief}</figcaption></figure>"
    clutter = [
        f'<nav y="0"><ul>{items}</ul></nav>', f'<div class="menu" y="0"><ul>{items}</ul></div>', f'<ul id="breadcrumbs" y="0">{items}</ul>',
        f'<header y="0"><div>The Valley Times</div><p>{brief}</p></header>', f'<div id="masthead" class="site-header" y="0"><h1>The Valley Times</h1><p>{say}</p></div>',
        f'<aside y="0"><h3>More</h3><p>{say}</p></aside>', f'<div class="sidebar" y="0"><h3>Popular now</h3><p>{say}</p><ul>{items}</ul></div>', f'<div class="related" y="0"><h3>Related</h3><ul>{items}</ul></div>',
        f'<div class="cookie-notice" y="0"><p>We use cookies on this page. {say}</p><button>Accept</button></div>', f'<div class="notice" y="0">{say}</div>', f'<div role="alert" class="alert" y="0"><p>{say}</p></div>',
        f'<div class="ad" y="0">{say}</div>', f'<div class="advert" y="0"><p>{say}</p></div>', f'<section class="sponsored" y="0"><p>{say}</p></section>', f'<div id="ad-3" class="banner" y="0">{brief}</div>',
        f'<form y="0"><p>{brief}</p><fieldset><label>Name</label><input></fieldset><button>Send</button></form>', f'<div class="newsletter signup" y="0"><p>{say}</p></div>', f'<div class="login-form" y="0"><p>{brief}</p></div>',
        f'<div class="share" y="0"><a href="/f">Share</a></div>',
        f'<section class="comments" y="0"><h3>Comments</h3><div class="comment"><p>{say}</p></div><div class="comment"><p>{brief}</p></div></section>', f'<div id="comments" y="0"><ol><li><p>{say}</p></li></ol></div>', f'<div id="disqus_thread" y="0"><p>{say}</p></div>',
        f'<article class="comment" y="0"><p>{say}</p></article>', f'<section class="comments" y="0"><article><p>{say}</p></article><article><p>{brief}</p></article></section>', f'<div class="related" y="0"><article><p>{say}</p></article></div>', f'<aside y="0"><article><p>{say}</p></article></aside>', f'<footer y="0"><p>{say}</p></footer>', f'<div class="footer" y="0"><p>Copyright. {say}</p></div>', '<footer y="0">&copy; The Valley Times. All rights reserved.</footer>',
    ]
    frames = ['<article y="1">{}</article>', '<main y="1">{}</main>', '<main y="1"><article>{}</article></main>', '<div class="content" y="1">{}</div>', '<div id="article-body" y="1">{}</div>', '<div y="1">{}</div>', '<section y="1">{}</section>', '<div class="wrap"><div class="post" y="1">{}</div></div>', '<article y="1"><div class="entry-content">{}</div></article>']
    bodies = [body, f"<p>{say}</p><p>{say} {say}</p>", f"<h1>River reaches the lower fields</h1><p>{say}</p>", f"<p>{say}</p>", f"<h1>{brief}</h1><p>{brief}</p>", f"<p>{brief}</p>", f"{say}<br>{say}", f"<h2>What comes next</h2><p>{say}</p><p>{brief}</p><ul><li>{say}</li></ul>"]
    own = f'<header y="0"><p>{brief}</p></header>{{}}<aside y="0"><p>{say}</p></aside><footer y="0"><p>{brief}</p></footer>'
    out = []
    for k in range(32 * len(frames)):
        mine = [clutter[(5 * k + j * 7) % len(clutter)] for j in range(9)]
        inner = bodies[k // 4 % len(bodies)] + (mine[8] if k % 2 else "")
        if k % 3 == 1:
            inner = inner.replace(f"<p>{brief}</p>", f"<p>{brief}</p>" + mine[7], 1)
        if k % 5 == 3:
            inner = own.format(inner)
        before, after = "".join(mine[: k % 5]), "".join(mine[4 : 4 + k % 4])
        if k % 4 == 3:
            page = f'<body y="1">{before}{inner}{after}</body>' if before or after else f"<body>{before}{frames[k % len(frames)].format(inner)}</body>"
        elif k % 7 == 2:
            page = f'<body><form action="/" y="0">{mine[0]}{before}{frames[k % 4 if k % 4 < 3 else 4].format(inner)}{after}</form></body>'
        else:
            page = f"<body>{before}{frames[k % len(frames)].format(inner)}{after}</body>"
        out.append(f"<html>{page}</html>")
    # an article of one block, alone or with clutter beside it
    for k, frame in enumerate([*frames, "{}"]):
        for j, inner in enumerate(bodies[3:7]):
            mine = [clutter[(3 * k + 7 * j + i) % len(clutter)] for i in range(4)]
            for before, after in (("", ""), (mine[0], ""), (mine[0] + mine[1], mine[2] + mine[3])):
                top = "" if "{}" != frame or before or after else ' y="1"'
                own_ = inner.replace("<p>", '<p y="1">') if frame == "{}" else inner
                if "<p>" in inner or frame != "{}":
                    out.append(f"<html><body{top}>{before}{frame.format(own_)}{after}</body></html>")
    # pages without an article
    out += [f"<html><body>{''.join(clutter[(k + 3 * j) % len(clutter)] for j in range(5))}</body></html>" for k in range(24)]
    return out


def _extract(model):
    def run(batches):
        for ids, pages in batches_of(batches, ["page", "html"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([main_text(h, model.value) for h in pages], pa.string())], ["page", "text"])

    return run


def fitted(pages: DataFrame, sample: int = 200, longest: int = 200_000) -> Model:
    """A model from the built-in examples and at most sample pages of at most longest characters that mark an article or
    main element, those with the smallest hashes: a bound of 40 MB on what training brings to the driver."""
    own = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") <= longest)).select("html", F.xxhash64("page_id", "html").alias("k"))
    return train(sorted(r["html"] for r in own.orderBy("k").limit(sample).toLocalIterator()))


def main_texts(pages: DataFrame, model: Model) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    text is empty for null, empty and text-free pages. Rows that repeat are extracted each; null page_id and url stay
    null. Other columns are left out whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    p = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    extract = _extract(spark.sparkContext.broadcast(model))

    def run(batches):
        for b in batches:
            for out in extract([b]):
                yield pa.RecordBatch.from_arrays([out.column(0), b.column(b.schema.get_field_index("url")), out.column(1)], ["page", "url", "text"])

    out = p.mapInArrow(run, "page long, url string, text string")
    return out.select(F.when(F.col("page") != NO_ID, F.col("page")).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
