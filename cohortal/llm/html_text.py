"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each block of a page gets features of its subtree (text density, links), its
attributes, depth and siblings. The words of its class, id, role and label are
hashed tokens; how much each speaks for the article is learned from pages composed
by rule with known parts. Boosted trees, fitted on other such pages, give the odds
that a block belongs to the article. Decoding picks the best set of kept blocks in
which no block is kept below one that is dropped.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortal.llm.shared import table

# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, up to their end tag; of the first their text is not markup.
CODE = frozenset("script style".split())
RAW = CODE | frozenset("textarea title noscript iframe xmp noembed noframes template svg select button object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of these kinds, up to the nearest list or table.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html menu".split())
#: Groups of element names that are features.
TAG_GROUPS = ("p", "h1 h2 h3", "h4 h5 h6", "li", "ul ol menu dl", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset", "table tbody tr td th", "blockquote pre figure figcaption", "#text")
#: Buckets of hashed tokens; composed pages from which tokens, and from which trees are learned.
BUCKETS, TOKEN_PAGES, TREE_PAGES = 1 << 18, 400, 400
_ARTICLE, _BESIDE = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form"))
_OWN = 11  # features of a node itself, besides its name and words
_GROUP = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group.split()}
#: Quotes hold a value together only behind an equals sign; a tag may end with the page.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*>?""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "parent", "children", "text", "words", "depth", "chars", "linked", "tags", "stops", "n_words", "blocks", "keep")

    def __init__(self, tag: str, parent: Node | None, words: tuple[int, ...] = ()):
        self.tag, self.parent, self.children, self.words = tag, parent, [], words
        self.text: list[str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.linked = self.tags = self.stops = self.n_words = self.blocks = 0
        self.keep = False
        if parent:
            parent.children.append(self)


@functools.lru_cache(maxsize=20_000)
def attribute_tokens(attributes: str) -> tuple[int, ...]:
    """Buckets of the distinct words in class, id, role and label, ASCII letters lower-cased."""
    found = {w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _LETTERS.findall(m[1])}
    return tuple(sorted({zlib.crc32(w.encode()) % BUCKETS for w in found}))


def parse(page: str) -> Node:
    """The block elements of a page; runs of text and inline elements become ``#text`` nodes in their block."""
    root = top = Node("#page", None)
    open_tags: list[tuple[str, Node]] = []
    links, run, at = 0, None, 0

    def add(raw: str) -> None:
        nonlocal run
        if raw:
            if run is None:
                if raw.isspace():
                    return
                run = Node("#text", top)
            run.text.append(raw)
            if links:
                run.linked += len(raw)

    def close(i: int) -> None:
        nonlocal top, run, links
        for tag, _ in open_tags[i:]:
            links -= tag == "a"
        if any(tag not in INLINE for tag, _ in open_tags[i:]):
            run = None
        top = open_tags[i][1]
        del open_tags[i:]

    skip_to, endless = 0, set()
    for m in _TOKEN.finditer(page):
        if m.start() < skip_to:
            continue
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if tag not in endless and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                if end:
                    at = skip_to = end.end()
                    continue
                endless.add(tag)
            # Without an end tag the element is only its own tag, and code what stands before the next one.
            if tag in CODE and not m[3].endswith("/"):
                at = max(at, page.find("<", at) % (len(page) + 1))
            continue
        if tag == "br":
            add(" ")
        if tag in INLINE:
            if run:
                run.tags += 1
            if tag not in VOID:
                open_tags.append((tag, top))
                links += tag == "a"
            continue
        if tag in CLOSES_P:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == "p":
                    close(i)
                    break
                if open_tags[i][0] not in INLINE:
                    break
        for i in range(len(open_tags) - 1, -1, -1) if tag in SIBLINGS else ():
            if open_tags[i][0] in SIBLINGS[tag]:
                close(i)
                break
            if open_tags[i][0] in SCOPE:
                break
        run = None
        if tag not in VOID:
            open_tags.append((tag, top))
            if tag not in ("html", "body"):
                top = Node(tag, top, attribute_tokens(m[3]) if "=" in m[3] else ())
    add(page[at:])
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first, with their text decoded and subtree sums made."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        if node.tag == "#text":
            text = " ".join(html.unescape("".join(node.text)).split())
            node.text = [text]
            node.chars, node.blocks = len(text), 1 if text else 0
            node.n_words, node.stops = text.count(" ") + 1 if text else 0, len(_STOPS.findall(text))
            node.linked = min(node.linked, node.chars)
        node.tags += 1
        if p := node.parent:
            p.chars += node.chars
            p.linked += node.linked
            p.tags += node.tags
            p.stops += node.stops
            p.n_words += node.n_words
            p.blocks += node.blocks
    return order


def token_weights(trees: list[list[Node]], good: list[list[bool]]) -> np.ndarray:
    """For each bucket how much its tokens speak for the article: log odds of the nodes that have them, beside those of all nodes."""
    counts = np.ones((2, BUCKETS))
    for order, marks in zip(trees, good):
        for node, mark in zip(order, marks):
            for token in node.words:
                counts[int(mark), token] += 1
    share = np.mean([m for marks in good for m in marks])
    weights = np.log(counts[1] / counts[0]) - math.log(share / (1 - share))
    return np.where(counts.sum(0) > 2, weights, 0.0).astype(np.float32)


def node_features(order: list[Node], weights: np.ndarray | None = None) -> np.ndarray:
    """A row of features for each node. ``weights``: of tokens; none: no token says anything."""
    whole = max(1, order[0].chars)
    own = _OWN + len(TAG_GROUPS)  # two for the node's tokens, two for all above, two for its parent's
    in_tag = own + 6
    above = in_tag + len(TAG_GROUPS)
    rows = np.zeros((len(order), above + _OWN + 3))
    place: dict[int, int] = {}
    among: dict[int, tuple[int, int]] = {}  # of each node: place among its siblings, and how many have its tag
    for k, node in enumerate(order):
        place[id(node)] = k
        row, p = rows[k], node.parent
        n = max(1, node.n_words)
        tags = Counter(c.tag for c in node.children)
        among.update((id(c), (i, tags[c.tag])) for i, c in enumerate(node.children))
        index, same = among.get(id(node), (0, 0))
        if p:
            up = rows[place[id(p)]]
            row[own + 2] = min(up[own + 2], up[own])
            row[own + 3] = max(up[own + 3], up[own + 1])
            row[own + 4 : own + 6] = up[own : own + 2]
            row[in_tag:above] = np.maximum(up[in_tag:above], up[_OWN:own])
            row[above : above + _OWN] = up[:_OWN]
            row[above + _OWN] = _GROUP.get(p.tag, -1)
            row[-2:] = up[-2:]
        if node.tag in _ARTICLE:
            row[-2] = 1  # in an element for the article
        if node.tag in _BESIDE:
            row[-1] = 1  # in an element for another part
        row[:_OWN] = (
            node.depth, index / max(1, len(p.children)) if p else 0, len(p.children) if p else 0, same,
            math.log1p(node.chars), node.linked / max(1, node.chars), math.log1p(node.tags), node.chars / node.tags,
            node.stops / n, node.n_words / max(1, node.blocks), node.chars / whole,
        )
        if (g := _GROUP.get(node.tag)) is not None:
            row[_OWN + g] = 1
        if node.words and weights is not None:
            said = weights[list(node.words)]
            row[own], row[own + 1] = min(0.0, said.min()), max(0.0, said.max())
    return rows


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for the logistic loss, on quantile bins."""

    def __init__(self, trees: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.weights: np.ndarray | None = None  # of tokens, beside the trees

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b, n, width = self._binned(x), len(y), self.bins + 1
        self.start = math.log(max(1e-6, y.mean()) / max(1e-6, 1 - y.mean()))
        score, self.model = np.full(n, self.start), []
        flat = b + np.arange(x.shape[1]) * width
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf, splits = np.zeros(n, int), []
            for level in range(self.depth):
                feature, cut = np.zeros(1 << level, int), np.full(1 << level, width)
                for node in range(1 << level):
                    rows = np.flatnonzero(leaf == node)
                    if len(rows) < 20:
                        continue
                    size = x.shape[1] * width
                    gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                    hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    f, c = np.unravel_index(gain[:, :-1].argmax(), gain[:, :-1].shape)
                    if gain[f, c] > 1e-3:
                        feature[node], cut[node] = f, c
                splits.append((feature, cut))
                leaf = leaf * 2 + (b[np.arange(n), feature[leaf]] > cut[leaf])
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            score += value[leaf]
            self.model.append((splits, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for splits, value in self.model:
            leaf = np.zeros(len(x), int)
            for feature, cut in splits:
                leaf = leaf * 2 + (b[rows, feature[leaf]] > cut[leaf])
            score += value[leaf]
        return score


# Words by which the composed pages name their parts, and words that name none.
WORD_GROUPS = (
    "article content main post entry story body text prose blog news",
    "nav navbar navigation menu breadcrumb breadcrumbs topnav links toc pager pagination",
    "header masthead topbar banner branding logo hero",
    "footer copyright legal colophon foot",
    "side sidebar aside widget related recommend recommended share social rail trending popular",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted",
    "comment comments reply replies discussion respond disqus feedback",
    "cookie cookies notice consent alert popup modal newsletter subscribe gdpr privacy message warning dialog overlay",
    "form search login signup signin contact",
)
NEUTRAL = "col row container wrap inner box item block page clearfix left right wide first last grid cell js".split()


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page composed by rule, and the words that mark its article's blocks (each text begins with its mark)."""
    marks, n = set(), [0]

    def text(words: int, article: bool) -> str:
        n[0] += 1
        mark = f"m{n[0]}x"
        if article:
            marks.add(mark)
        out = [mark]
        while len(out) < words:
            out += ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 12))]
            out[-1] += rng.choice([".", ".", ",", "?"])
        return " ".join(out[: max(1, words)])

    def named(tags: str, group: int) -> tuple[str, str]:
        """An element of some kind: the proper one, or a plain one with a telling name."""
        tag, word = rng.choice(tags.split()), rng.choice(WORD_GROUPS[group].split())
        plain = tag in ("div", "section", "ul", "p")
        name = rng.choice([word, f"{word}-{rng.choice(['box', 'wrap', 'area', 'x1'])}", f"the_{word}"])
        return f'<{tag} {rng.choice(["class", "id"])}="{beside(name)}">' if plain or rng.random() < 0.3 else f"<{tag}{bare()}>", f"</{tag}>"

    def beside(name: str) -> str:
        """A telling name among neutral ones."""
        names = [name, *rng.choices(NEUTRAL, k=rng.choice([0, 0, 0, 1, 2]))]
        rng.shuffle(names)
        return " ".join(names)

    def bare() -> str:
        """An attribute that tells nothing, or none."""
        if rng.random() < 0.85:
            return ""
        word = rng.choice(NEUTRAL) if rng.random() < 0.5 else "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
        return f' class="{word}{rng.choice(["", "-1", " " + rng.choice(NEUTRAL)])}"'

    def links(k: int) -> str:
        items = "".join(f"<li><a href='/{i}'>{text(rng.randint(1, 4), False)}</a></li>" for i in range(k))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else " ".join(f"<a href='/{i}'>{text(2, False)}</a>" for i in range(k))

    def part(kind: str) -> str:
        tags, group, make = {
            "nav": ("nav nav div", 1, lambda: links(rng.randint(3, 9))),
            "header": ("header header div", 2, lambda: f"<{(h := rng.choice(['p', 'h2', 'div']))}>{text(rng.randint(1, 8), False)}</{h}>"),
            "footer": ("footer footer div", 3, lambda: rng.choice(["&copy; ", "<p>"]) + text(rng.randint(3, 30), False)),
            "side": ("aside aside div section", 4, lambda: f"<h3>{text(2, False)}</h3>" + links(4) + (f"<p>{text(rng.randint(5, 40), False)}</p>" if rng.random() < 0.6 else "")),
            "ad": ("div div aside section", 5, lambda: rng.choice(["<p>", ""]) + text(rng.randint(2, 40), False)),
            "comments": ("section div div", 6, lambda: "".join(f"<{(t := rng.choice(['p', 'div', 'li']))}>{text(rng.randint(3, 60), False)}</{t}>" for _ in range(rng.randint(1, 6)))),
            "notice": ("div section div", 7, lambda: f"{rng.choice(['<p>', ''])}{text(rng.randint(4, 40), False)}"),
            "form": ("form form div", 8, lambda: f"<label>{text(2, False)}</label><input name='q'><button>ok</button>"),
        }[kind]
        begin, end = named(tags, group)
        return begin + make() + end

    def article() -> str:
        blocks = []
        if rng.random() < 0.85:
            blocks.append(f"<h1>{text(rng.randint(1, 14), True)}</h1>")
        for _ in range(rng.choice([0, 1, 2, 4, 8, 15, 40]) if blocks else rng.randint(1, 12)):
            r = rng.random()
            if r < 0.8:
                blocks.append(f"<p{bare()}>{rng.choice(['', '<b>'])}{text(int(math.exp(rng.uniform(0, 5.3))), True)}{rng.choice(['', '<br>', '</p>'])}")
            elif r < 0.88:
                blocks.append(f"<h{rng.randint(2, 4)}>{text(rng.randint(1, 8), True)}</h2>")
            elif r < 0.94:
                blocks.append("<ul>" + "".join(f"<li>{text(rng.randint(1, 20), True)}</li>" for _ in range(3)) + "</ul>")
            else:
                blocks.append(f"<blockquote>{text(rng.randint(5, 40), True)}</blockquote>")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            blocks.insert(rng.randint(0, len(blocks)), part(rng.choice(["ad", "side", "notice", "form"])))
        begin, end = named(rng.choice(["article article", "main section", "div"]), 0)
        inner = begin + "".join(blocks) + end
        return f"<{(t := rng.choice(['main', 'div']))}{bare()}>{inner}</{t}>" if rng.random() < 0.4 else inner

    before = [part(k) for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.5]
    after = [part(k) for k in ("comments", "side", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    return f"<html><head><title>{text(3, False)}</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>", marks


@functools.cache
def trained(token_pages: int = TOKEN_PAGES, tree_pages: int = TREE_PAGES, seed: int = 3) -> BoostedTrees:
    """The model: tokens' weights from a fixed number of composed pages, trees from a fixed number of others."""
    rng, trees, goods = random.Random(seed), [], []
    for _ in range(token_pages + tree_pages):
        page, marks = training_page(rng)
        order = nodes_of(parse(page))
        good: set[int] = set()
        for node in reversed(order):
            if id(node) in good or (node.tag == "#text" and node.text[0].split(" ")[0] in marks):
                good |= {id(node), id(node.parent)}
        trees.append(order)
        goods.append([id(node) in good for node in order])
    weights = token_weights(trees[:token_pages], goods[:token_pages])
    rows = np.concatenate([node_features(t, weights) for t in trees[token_pages:]])
    model = BoostedTrees().fit(rows, np.concatenate(goods[token_pages:]).astype(float))
    model.weights = weights
    return model


def decode(order: list[Node], odds: np.ndarray) -> list[str]:
    """Texts of the kept blocks in page order.

    The best choice along the tree, bottom up: a subtree is dropped whole, or its
    root is kept and each child is at its best. A block of text weighs more the
    longer it is. The page itself is always kept.
    """
    drop, keep = {}, {}
    own = dict(zip(map(id, order), odds.tolist()))
    for node in reversed(order):
        # Text that is all a block holds is judged as the block is.
        alone = node.tag == "#text" and node.parent.parent and all(c.tag == "#text" for c in node.parent.children)
        o = own[id(node.parent if alone else node)]
        weight = 1 + (math.log1p(node.chars) if node.tag == "#text" else 0)
        yes, no = -weight * math.log1p(math.exp(-min(30.0, max(-30.0, o)))), -weight * math.log1p(math.exp(min(30.0, max(-30.0, o))))
        keep[id(node)] = yes + sum(max(keep[id(c)], drop[id(c)]) for c in node.children)
        drop[id(node)] = no + sum(drop[id(c)] for c in node.children)
    out = []
    for node in order:
        node.keep = node.parent is None or (node.parent.keep and keep[id(node)] > drop[id(node)])
        if node.keep and node.tag == "#text" and node.text[0]:
            out.append(node.text[0])
    return out


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page; empty for null, empty and textless pages."""
    trees = [nodes_of(parse(p or "")) for p in pages]
    if not trees:
        return []
    odds = model.log_odds(np.concatenate([node_features(t, model.weights) for t in trees]))
    ends = np.cumsum([0, *map(len, trees)])
    return ["\n".join(decode(t, odds[a:b])) for t, a, b in zip(trees, ends, ends[1:])]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``pages``: page_id, url, html; other columns are not read. Character references
    are decoded, white space in a block becomes one space, blocks are joined by a
    line feed in page order. Null and empty pages have an empty text. Each row
    stands for itself, whatever its id; an empty table gives no rows.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 200):
                batch = whole.slice(begin, 200)
                texts = extract(batch.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))
