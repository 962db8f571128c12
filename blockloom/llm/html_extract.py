"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree. Every block element gets features: its kind and those around it, the words
in its attributes, text and link density of its subtree, depth, and how it compares with its
siblings. Trees score each element as content or not; decoding picks the best set of elements in
which nothing below a dropped element is kept, so choices of ancestors and descendants agree.

There are no labelled pages. The trees are fitted on a bounded sample of the pages themselves:
elements that say what they are (an ``article``, a ``nav``) teach by themselves, and each sampled page
is also rearranged into layouts built from its own blocks, whose roles are known, often with the
telling names taken off, so that density and siblings have to decide.
"""

from __future__ import annotations

import html
import math
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, boost, calibrate
from .rows import add_columns, parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sampled pages and element rows that the trees are fitted on.
SAMPLE_PAGES, SAMPLE_NODES = 400, 60_000
LAYOUTS = 4

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template head title svg iframe object canvas audio video select option textarea button "
    # A formula once more, as its source.
    "annotation annotation-xml".split()
)
RAW = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr br input "
    # Formulas.
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced "
    "menclose mpadded mphantom mstyle mtable mtr mtd".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split()
)
# Elements that end an open one of the same family, and where that search stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
GROUPS = (
    ("nav", "menu"),
    ("header",),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "dialog"),
    ("article", "main"),
    ("section",),
    ("div", "center"),
    ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("ul", "ol", "dl"),
    ("li", "dt", "dd"),
    ("table", "tr", "td", "th", "tbody", "thead"),
    ("figure", "figcaption"),
    ("body", "html"),
)
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
# Attribute words that tell a role.
WORDS = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc topbar skip".split(),
    "header masthead banner logo branding hero".split(),
    "footer foot copyright colophon contentinfo legal imprint".split(),
    "sidebar side aside widget related recommended recommend popular trending complementary rail more promo teaser".split(),
    "ad ads advert adverts advertisement advertising sponsor sponsored adsense dfp outbrain taboola commercial".split(),
    "cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay newsletter subscribe paywall".split(),
    "comment comments reply replies respond disqus discussion reader feedback".split(),
    "form search login signup signin register contact share sharing social follow tags meta byline author".split(),
    "article articlebody post entry content main story text body blogposting newsarticle prose copy".split(),
)
WORD_OF = {w: i for i, ws in enumerate(WORDS) for w in ws}
GOOD_WORDS = len(WORDS) - 1
GOOD_GROUP = 5
BAD_GROUPS = frozenset((0, 2, 3, 4))

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)[^>]*+>|<!--(?:.*?-->|>|.*)|<[!?/][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "parts", "own", "own_links", "block", "truth", "index", "depth")

    def __init__(self, tag: str, words: tuple[int, ...], parent, block: bool, truth=None):
        self.tag, self.words, self.parent, self.block, self.truth = tag, words, parent, block, truth
        self.children, self.parts, self.own, self.own_links = [], [], 0, 0
        self.depth = parent.depth + 1 if parent is not None else 0


def _attribute_words(attributes: str) -> tuple[tuple[int, ...], bool]:
    found, hidden = set(), False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            found.update(WORD_OF[w] for w in map(str.lower, WORD_SPLIT.findall(value)) if w in WORD_OF)
    return tuple(sorted(found)), hidden


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only leave their text, marked if in a link.

    Tags that are not closed or closed twice are put right as browsers do, in short: a block ends an
    open paragraph, list items and cells end their like, an unknown end tag is ignored.
    """
    root = Node("html", (), None, True)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements, inline ones with their block
    links = 0
    at = 0

    def text(start: int, end: int) -> None:
        if start >= end:
            return
        node = stack[-1][1]
        if node is None:
            return
        raw = page[start:end]
        if "&" in raw:
            raw = html.unescape(raw)
        node.parts.append(raw)
        if links:
            node.own_links += len(raw)

    def close_to(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    # No tag ends behind the last ">": looking for one there would start again at every "<".
    last = page.rfind(">") + 1
    for m in TAG.finditer(page, 0, last):
        if m.start() < at:
            continue  # inside raw text
        text(at, m.start())
        at = m.end()
        if at == last and m[0].startswith("<!--") and not m[0].endswith("-->") and m[0] != "<!-->":
            at = len(page)  # a comment that is never closed
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close_to(depth)
                    break
                # An inline end tag does not close blocks.
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "hr":
            if stack[-1][1] is not None:
                stack[-1][1].parts.append(" ")
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            like, stop = SIBLINGS[tag]
            deepest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in like:
                    deepest = depth
            if deepest:
                close_to(deepest)
        if tag in VOID:
            continue
        attributes = m[3] or ""
        node = stack[-1][1]
        words, hidden = _attribute_words(attributes) if attributes.strip() else ((), False)
        if tag in HIDDEN or hidden or node is None:
            inner = None
        elif tag in INLINE:
            # Part of the sentence around it, whatever it calls itself.
            inner = node
        else:
            truth = None
            if "data-role=" in attributes:
                truth = 'data-role="1"' in attributes
            inner = Node(tag, words, node, True, truth)
            node.children.append(inner)
            node.parts.append(inner)
        if tag in RAW:
            # Raw text ends at its own end tag only.
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                break
        if not attributes.endswith("/") or tag not in ("svg", "path", "use"):
            stack.append((tag, inner))
            links += tag == "a"
    text(at, len(page))
    return root


def order(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order; without recursion, pages may be deep."""
    found, work = [], [root]
    while work:
        node = work.pop()
        node.index = len(found)
        found.append(node)
        work.extend(reversed(node.children))
    return found


NUMBERS = (
    "depth children place siblings own_log text_log link_share own_link_share text_per_tag page_share parent_share "
    "page_place punctuation word_length same_before same_after sibling_text longest_sibling"
).split()
N_FEATURES = 2 * len(GROUPS) + 2 * len(WORDS) + len(NUMBERS)


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features per node of a page."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    own, links, marks, letters, spaces = (np.zeros(n) for _ in range(5))
    parent = np.array([v.parent.index if v.parent is not None else -1 for v in nodes])
    groups, words = len(GROUPS), len(WORDS)
    for i, v in enumerate(nodes):
        run = "".join([p for p in v.parts if isinstance(p, str)])
        length = len(run)
        v.own = length if run and not run.isspace() else 0
        own[i], links[i] = v.own, min(v.own_links, v.own)
        marks[i] = run.count(",") + run.count(".") + run.count(";") + run.count("!") + run.count("?")
        spaces[i] = run.count(" ")
        row, above = x[i], parent[i]
        group = GROUP_OF.get(v.tag, -1)
        if above >= 0:
            row[groups : 2 * groups] = x[above, groups : 2 * groups]
            row[2 * groups + words : 2 * groups + 2 * words] = x[above, 2 * groups + words : 2 * groups + 2 * words]
        if group >= 0:
            row[group] = 1
            row[groups + group] = min(3, row[groups + group] + 1)
        for w in v.words:
            row[2 * groups + w] = 1
            row[2 * groups + words + w] = min(3, row[2 * groups + words + w] + 1)
    text, link, tags, mark, space = own.copy(), links.copy(), np.ones(n), marks.copy(), spaces.copy()
    start = np.concatenate([[0], np.cumsum(own)[:-1]])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        link[p] += link[i]
        tags[p] += tags[i]
        mark[p] += mark[i]
        space[p] += space[i]
    total = max(text[0], 1.0)
    base = 2 * groups + 2 * words
    up = np.maximum(parent, 0)
    siblings = np.array([len(nodes[p].children) for p in up])
    place = np.zeros(n)
    before, after, beside, longest = (np.zeros(n) for _ in range(4))
    for v in nodes:
        kids = v.children
        if not kids:
            continue
        at = [c.index for c in kids]
        most = text[at].max()
        for k, c in enumerate(kids):
            i = c.index
            place[i] = k / len(kids)
            before[i] = k > 0 and kids[k - 1].tag == c.tag
            after[i] = k + 1 < len(kids) and kids[k + 1].tag == c.tag
            beside[i] = (text[at[k - 1]] if k else 0) + (text[at[k + 1]] if k + 1 < len(kids) else 0)
            longest[i] = text[i] / max(most, 1)
    some = np.maximum(text, 1)
    columns = (
        np.minimum([v.depth for v in nodes], 12),
        [len(v.children) for v in nodes],
        place,
        siblings,
        np.log1p(own),
        np.log1p(text),
        link / some,
        links / np.maximum(own, 1),
        np.log1p(text / tags),
        text / total,
        text / np.maximum(text[up], 1),
        start / total,
        mark / some,
        some / (space + 1),
        before,
        after,
        np.log1p(beside),
        longest,
    )
    for k, c in enumerate(columns):
        x[:, base + k] = c
    return x


def _role(v: Node) -> int | None:
    """What an element says about itself or its surroundings: 0, 1 or None."""
    good = False
    while v is not None:
        if v.truth is not None:
            return int(v.truth)
        group = GROUP_OF.get(v.tag, -1)
        if group in BAD_GROUPS or any(w != GOOD_WORDS for w in v.words):
            return 0
        good = good or group == GOOD_GROUP or GOOD_WORDS in v.words
        v = v.parent
    return 1 if good else None


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """The best consistent choice: a node is kept only if its parent is.

    A node is worth its log-odds, times the logarithm of its text; a container has a part of that
    of its subtree, so that a strong no for the whole outweighs doubtful parts, and the reverse.
    """
    n = len(nodes)
    weight = np.log1p([v.own for v in nodes])
    below = np.zeros(n)
    value = np.clip(score, -8, 8) * weight
    for i in range(n - 1, 0, -1):
        below[nodes[i].parent.index] += below[i] + weight[i]
    value = value + np.clip(score, -8, 8) * 0.3 * below
    best = value.copy()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent.index] += best[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = bool(keep[nodes[i].parent.index] and best[i] > 0)
    return keep


def render(root: Node, nodes: list[Node], keep: list[bool]) -> str:
    """Blocks of the kept nodes in page order, joined by an empty line.

    A block is a run of text between the borders of block elements; white space inside becomes one
    space. Text right under the page, outside all elements, counts as an element of its own.
    """
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            blocks.append(line)

    work: list = [root]
    while work:
        item = work.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif keep[item.index]:
            flush()
            work.append(None)
            work.extend(reversed(item.parts))
        else:
            flush()
    flush()
    return "\n\n".join(blocks)


# --- training --------------------------------------------------------------------------------

# Layouts of rearranged pages. A name in the first list holds content; each entry of
# the others is a tag with attributes that holds something else. Empty attributes take the name off.
CONTENT_SHELLS = (
    "article", 'div class="post-content"', 'main id="content"', 'section class="story"', "div", "section", 'div class="c1"', "article",
)
SHELLS = (
    ("nav", 'ul class="menu"', "div", 'div class="breadcrumbs"', "ul"),
    ('header class="site-header"', "header", 'div id="masthead"', "div"),
    ("footer", 'div class="footer"', "div", 'div class="legal"'),
    ("aside", 'div class="sidebar widget"', 'div class="related"', "div"),
    ('div class="ad"', 'div id="sponsored-box"', 'section class="promo"', "div", "aside"),
    ('div class="cookie-notice"', 'div role="alert"', 'div id="newsletter"', "div"),
    ('section class="comments"', 'div id="comments"', 'ol class="comment-list"', "section"),
    ("form", 'form class="search"', 'div class="login-form"', "form"),
)


def _shell(rng: random.Random, opening: str, inner: str, role: int) -> str:
    tag = opening.split(" ")[0]
    return f'<{opening} data-role="{role}">{inner}</{tag}>'


def _phrase(rng: random.Random, words: list[str], low: int, high: int) -> str:
    n = rng.randint(low, high)
    at = rng.randrange(max(1, len(words) - n))
    return html.escape(" ".join(words[at : at + n]), quote=False)


def rearranged(blocks: list[str], rng: random.Random) -> str:
    """A layout with the given content blocks and other parts made of their words."""
    words = " ".join(blocks).split()
    title = _phrase(rng, words, 3, 10)
    body = [f"<h1>{title}</h1>"] if rng.random() < 0.8 else []
    for b in blocks:
        plain = html.escape(b, quote=False)
        if rng.random() < 0.15:
            body.append(f"<h2>{_phrase(rng, words, 2, 7)}</h2>")
        if rng.random() < 0.12:
            items = "".join(f"<li>{_phrase(rng, words, 4, 20)}</li>" for _ in range(rng.randint(2, 5)))
            body.append(f"<ul>{items}</ul>")
        if rng.random() < 0.1:
            body.append(f"<blockquote><p>{plain}</p></blockquote>")
        elif rng.random() < 0.15:
            link = _phrase(rng, words, 1, 3)
            body.append(f'<p>{plain} <a href="/x">{link}</a> {_phrase(rng, words, 2, 9)}</p>')
        else:
            body.append(f"<p>{plain}</p>" if rng.random() < 0.9 else f"<div>{plain}</div>")
        if rng.random() < 0.08:
            body.append(_shell(rng, rng.choice(SHELLS[4]), f"<p>{_phrase(rng, words, 3, 25)}</p>", 0))
    content = _shell(rng, rng.choice(CONTENT_SHELLS), "".join(body), 1)

    def other(kind: int) -> str:
        if kind in (0, 2, 3) and rng.random() < 0.8:
            items = "".join(f'<li><a href="/{i}">{_phrase(rng, words, 1, 4)}</a></li>' for i in range(rng.randint(3, 9)))
            inner = f"<ul>{items}</ul>" if rng.random() < 0.7 else items.replace("li>", "span>")
            if rng.random() < 0.4:
                inner = f"<h3>{_phrase(rng, words, 1, 3)}</h3>" + inner
        elif kind == 6:
            inner = "".join(
                f'<div class="comment"><p>{_phrase(rng, words, 4, 60)}</p></div>' if rng.random() < 0.6 else
                f"<li><b>{_phrase(rng, words, 1, 2)}</b><p>{_phrase(rng, words, 4, 60)}</p></li>"
                for _ in range(rng.randint(1, 5))
            )
        elif kind == 7:
            inner = f"<label>{_phrase(rng, words, 1, 3)}</label><input><p>{_phrase(rng, words, 2, 12)}</p>"
        else:
            inner = f"<p>{_phrase(rng, words, 2, 30)}</p>" if rng.random() < 0.6 else _phrase(rng, words, 2, 20)
            if rng.random() < 0.4:
                inner += f' <a href="/y">{_phrase(rng, words, 1, 3)}</a>'
        opening = rng.choice(SHELLS[kind])
        bare = opening in ("div", "section", "ul")
        # A container without a name is only told apart where its links are dense or its text short.
        if bare and kind in (4, 5, 6):
            opening = SHELLS[kind][0]
        return _shell(rng, opening, inner, 0)

    before = "".join(other(k) for k in (1, 0, 5, 4) if rng.random() < 0.6)
    behind = "".join(other(k) for k in (6, 3, 7, 4, 2) if rng.random() < 0.6)
    if rng.random() < 0.4:
        content = f"<div>{content}{behind}</div>"
        behind = ""
    return f"<html><body>{before}{content}{behind}</body></html>"


def training_rows(page: str, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and roles from a page as it is and from its rearranged layouts."""
    rng = random.Random(seed)
    root = parse(page)
    nodes = order(root)
    told = [_role(v) for v in nodes]
    # A container around both says nothing.
    known = np.array([t is not None and i > 0 for i, t in enumerate(told)])
    x = features(nodes)
    if known.any():
        yield x[known], np.array([told[i] for i in np.flatnonzero(known)])
    blocks = render(root, nodes, [t != 0 for t in told]).split("\n\n")
    blocks = [b for b in blocks if len(b.split()) > 3]
    for _ in range(LAYOUTS if blocks else 0):
        shown = rng.sample(blocks, min(len(blocks), rng.randint(1, 12)))
        nodes = order(parse(rearranged(shown, rng)))
        told = [_role(v) if v.truth is None and any(_has_truth(v)) else v.truth for v in nodes]
        known = np.array([t is not None for t in told])
        if known.any():
            yield features(nodes)[known], np.array([int(told[i]) for i in np.flatnonzero(known)])


def _has_truth(v: Node) -> Iterator[bool]:
    while v is not None:
        if v.truth is not None:
            yield True
            return
        v = v.parent


def fit(
    pages: DataFrame, page: str = "html", order_by: str = "url", sample_pages: int = SAMPLE_PAGES, sample_nodes: int = SAMPLE_NODES
) -> Forest:
    """Fit on at most ``sample_pages`` pages and ``sample_nodes`` elements; pages stay on the workers.

    Drawn are the pages with the smallest hashes of ``order_by``. Without pages, or with one kind of
    element only, the trees are a constant.
    """
    src = pages.select(F.col(page).alias("page"), F.xxhash64(order_by).alias("h")).filter(F.length("page") > 0)
    # Narrow first: only hashes are ranked.
    cut = src.select("h").orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    if cut is None:
        return Forest(0.0, [])
    drawn = src.filter(F.col("h") <= F.lit(cut)).limit(2 * sample_pages)
    share = max(20, sample_nodes // sample_pages)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                for text, seed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows = list(training_rows(text, seed))
                    if not rows:
                        continue
                    x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    some = np.random.default_rng(seed % 2**32).permutation(len(y))[:share]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[some].tolist(), pa.list_(pa.float32())), pa.array(y[some].astype(np.int32)), pa.array([seed] * len(some))],
                        ["x", "y", "h"],
                    )

    found = drawn.mapInArrow(make, "x array<float>, y int, h long").limit(sample_nodes).collect()
    if not found:
        return Forest(0.0, [])
    found.sort(key=lambda r: (r["h"], r["y"], r["x"]))
    x = np.array([r["x"] for r in found], np.float64)
    y = np.array([r["y"] for r in found])
    unseen = np.array([r["h"] for r in found]) % 4 == 0
    # Both kinds weigh the same.
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).mean()), 0.5 / max(1e-9, (y == 0).mean())) if 0 < y.mean() < 1 else None
    return calibrate(boost(x[~unseen], y[~unseen], weight[~unseen] if weight is not None else None), x[unseen], y[unseen])


def extract_text(page: str, forest: Forest) -> str:
    return extract_batch([page], forest)[0]


def extract_batch(pages: list[str], forest: Forest) -> list[str]:
    """Main texts of some pages, scored together."""
    trees = [order(root) for root in map(parse, pages)]
    if not trees:
        return []
    score = forest.log_odds(np.concatenate([features(nodes) for nodes in trees]).astype(np.float64))
    res, at = [], 0
    for nodes in trees:
        keep = decode(nodes, score[at : at + len(nodes)])
        at += len(nodes)
        res.append(render(nodes[0], nodes, keep))
    return res


def extract(pages: DataFrame, forest: Forest, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page; null and empty pages give an empty text.

    Other columns pass through, one with the name of the output is replaced; repeated pages are
    extracted each; an empty table gives an empty one. Pages of any length and depth are read whole.
    """
    # A forest has a fixed number of leaves.
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def kernel():
        return lambda texts: [extract_batch(texts, shared.value)]

    return add_columns(pages, page, f"{out} string", kernel)
