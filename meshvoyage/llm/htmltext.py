"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element gets the probability that it holds main text, from the density
and size of its subtree, the tokens of its attributes and of those around it, its
depth, and its siblings.  Decoding takes the most probable choice of nodes in which
whatever lies below a dropped node is dropped.  The trees are fitted here, on pages
that ``pagemaker`` lays out with known main text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pagemaker

#: Pages the trees are fitted on; the only bound of the model.
TRAINING_PAGES = 1800
TREES, DEPTH, RATE, BINS, LEAST = 90, 5, 0.2, 32, 15
#: Share of the rows and of the features that each tree is grown on.
ROWS, COLUMNS = 0.6, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text, whatever stands in them.
SILENT = frozenset("head script style noscript template iframe object svg canvas math audio video map select button textarea option datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
#: A start tag in the key's group closes an open element of the group, up to the boundary.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "tbody"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

#: Groups of attribute tokens; each is a feature of a node, its parent and its ancestors.
TOKENS = {
    "main": "article content entry main post story text body blog prose copy",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs crumbs toolbar tabs pagination pager sitemap topbar links toc",
    "frame": "header head masthead banner footer foot bottom copyright colophon legal logo branding top site",
    "side": "sidebar side aside widget rail related recommended more popular trending secondary complementary box",
    "ad": "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion promoted banner commercial outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay paywall warning message dialog announcement newsletter subscribe",
    "talk": "comment comments commentlist reply replies respond discussion disqus reader feedback thread review",
    "form": "form search login signup signin register contact input field",
    "share": "share sharing social follow tools meta tags byline buttons",
}
GROUPS = list(TOKENS)
OF_TOKEN = {}
for _g, _names in enumerate(TOKENS.values()):
    for _name in _names.split():
        OF_TOKEN.setdefault(_name, []).append(_g)
KINDS = ["p", "h1", "h2", "li", "ul", "div", "article", "main", "section", "nav", "aside", "header", "footer", "form", "table", "td", "blockquote", "pre", "figure", "dl", "span", "body"]
KIND = {k: i for i, k in enumerate(KINDS)} | {"h3": 2, "h4": 2, "h5": 2, "h6": 2, "ol": 4, "menu": 4, "th": 15, "tr": 15, "tbody": 15, "dt": 3, "dd": 3, "figcaption": 18, "html": 21, "ins": 20}


@lru_cache(maxsize=50_000)
def _tokens(attributes: str) -> tuple[int, ...]:
    counts = [0] * len(GROUPS)
    for value in ATTRIBUTE.findall(attributes):
        for token in SPLIT.split(value):
            token = token.lower()
            for g in OF_TOKEN.get(token, ()) or OF_TOKEN.get(token.rstrip("s"), ()):
                counts[g] += 1
    return tuple(min(c, 3) for c in counts)


class Page:
    """The block elements of a page, in document order, and its text in pieces.

    Inline elements belong to the block around them, unless an attribute token marks
    them.  ``pieces`` are (node, text, new block begins here).
    """

    __slots__ = ("parent", "kind", "attributes", "depth", "tags", "pieces", "links")

    def __init__(self, source: str):
        self.parent, self.kind, self.attributes, self.depth, self.tags, self.links = [-1], ["body"], [""], [0], [0], [0]
        self.pieces: list[tuple[int, str, bool]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        # The open elements: (name, node, silent).  Node 0 is the page itself.
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        at, fresh, in_link, end = 0, True, 0, len(source)
        pieces, tags = self.pieces, self.tags

        def text(piece: str) -> None:
            nonlocal fresh
            if piece and not stack[-1][2]:
                pieces.append((stack[-1][1], html.unescape(piece) if "&" in piece else piece, fresh))
                fresh = False
                if in_link:
                    self.links[stack[-1][1]] += len(piece)

        while at < end:
            found = TOKEN.search(source, at)
            if found is None:
                text(source[at:])
                break
            if found.start() > at:
                text(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if name == "a" and in_link:
                    in_link -= 1
                if depth:
                    fresh = fresh or any(x[0] not in INLINE for x in stack[depth:])
                    if name in INLINE and any(x[0] not in INLINE for x in stack[depth + 1 :]):
                        continue  # an inline end tag closes no block
                    del stack[depth:]
                elif name not in INLINE:
                    fresh = True
                continue
            if name == "br":
                text(" ") if not fresh else None
                tags[stack[-1][1]] += 1
                continue
            if name not in INLINE:
                self._imply(stack, name)
                fresh = True
            tags[stack[-1][1]] += 1
            if name in VOID:
                continue
            silent = stack[-1][2] or name in SILENT
            if name in RAW:
                close = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                if silent or name in ("script", "style", "title"):
                    if close is None:
                        at = end if name in ("script", "style", "textarea", "title") else at
                    else:
                        at = source.find(">", close.start()) + 1 or end
                    continue
            if attributes.endswith("/") and name in ("svg", "path"):
                continue
            if name == "a":
                in_link += 1
            if name in INLINE and not (attributes and any(_tokens(attributes)[1:])):
                stack.append((name, stack[-1][1], silent))
            else:
                self.parent.append(stack[-1][1])
                self.kind.append(name)
                self.attributes.append(attributes)
                self.depth.append(len(stack))
                tags.append(0)
                self.links.append(0)
                stack.append((name, len(self.parent) - 1, silent))

    @staticmethod
    def _imply(stack: list, name: str) -> None:
        """Close what a block's start tag ends without saying so."""
        group, bounds = CLOSES.get(name, ()), BOUNDS.get(name, ())
        for i in range(len(stack) - 1, 0, -1):
            if group and stack[i][0] in group:
                at = i
                while at > 1 and stack[at - 1][0] in group:
                    at -= 1
                del stack[at:]
                return
            if stack[i][0] == "p" and name not in CLOSES:
                del stack[i:]
                return
            if stack[i][0] in bounds or stack[i][0] not in INLINE and not group:
                return


N_TOKENS = len(GROUPS)
WIDTH = 25 + len(KINDS) + 3 * N_TOKENS


def features(pages: list[Page]) -> np.ndarray:
    """A row for each node of ``pages``, one page after the other."""
    rows = []
    for page in pages:
        n = len(page.parent)
        own, dots, words, starts = [0] * n, [0] * n, [0] * n, [0] * n
        total = 0
        for node, piece, _ in page.pieces:
            size = len(piece)
            if not own[node]:
                starts[node] = total
            own[node] += size
            dots[node] += piece.count(".") + piece.count(",")
            words[node] += piece.count(" ") + 1
            total += size
        parent = page.parent
        sub, links, tags, stops, spaces, paras, nodes = own[:], page.links[:], page.tags[:], dots[:], words[:], [k == "p" for k in page.kind], [1] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            sub[p] += sub[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            stops[p] += stops[i]
            spaces[p] += spaces[i]
            paras[p] += paras[i]
            nodes[p] += nodes[i]
            if not own[p] or starts[i] < starts[p]:
                starts[p] = starts[i] if not own[p] else min(starts[p], starts[i])
        par = np.array(parent)
        par[0] = 0
        tok = np.array([_tokens(a) for a in page.attributes], np.float32)
        above = tok.copy()
        for i in range(1, n):
            above[i] += above[parent[i]]
        above -= tok
        x = np.zeros((n, WIDTH), np.float32)
        own, sub, links, tags, stops, spaces, paras, nodes, starts = (np.array(v, np.float32) for v in (own, sub, links, tags, stops, spaces, paras, nodes, starts))
        kinds = np.array([KIND.get(k, 20) for k in page.kind])
        brothers = np.bincount(par[1:], minlength=n).astype(np.float32) if n > 1 else np.zeros(n, np.float32)
        sizes = np.bincount(par[1:], weights=sub[1:], minlength=n) if n > 1 else np.zeros(n)
        alike, longest, text_alike = {}, {}, {}
        pairs = list(zip(par.tolist(), kinds.tolist(), strict=True))
        for pair, size in zip(pairs, sub.tolist(), strict=True):
            alike[pair] = alike.get(pair, 0) + 1
            longest[pair] = max(longest.get(pair, 0), size)
            text_alike[pair] = text_alike.get(pair, 0) + size
        order = np.zeros(n, np.float32)
        seen = [0] * n
        for i in range(1, n):
            order[i] = seen[parent[i]]
            seen[parent[i]] += 1
        density = links / np.maximum(sub, 1)
        cols = [
            np.log1p(own), np.log1p(sub), density, np.log1p(tags), np.log1p(sub / (tags + 1)), stops / np.maximum(spaces, 1), np.log1p(spaces),
            np.log1p(paras), np.log1p(nodes), np.array(page.depth, np.float32), brothers[par], order / np.maximum(brothers[par], 1),
            np.array([alike[x] for x in pairs], np.float32), sub / np.maximum(sub[par], 1), np.log1p(sizes[par] / np.maximum(brothers[par], 1)),
            density[par], np.log1p(sub[par]), np.log1p(paras[par]), starts / max(total, 1), sub / max(total, 1), brothers, kinds[par].astype(np.float32),
            np.log1p(np.array([longest[x] for x in pairs], np.float32)), np.log1p(np.array([text_alike[x] / alike[x] for x in pairs], np.float32)), np.array([alike[x] for x in pairs], np.float32) / np.maximum(brothers[par], 1),
        ]
        x[:, : len(cols)] = np.stack(cols, axis=1)
        x[np.arange(n), len(cols) + kinds] = 1
        x[:, len(cols) + len(KINDS) :] = np.concatenate([tok, tok[par], above], axis=1)
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.float32)


class Trees:
    """Boosted trees of fixed depth for a yes-no label, by histograms of binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.int64)
        inner = (1 << DEPTH) - 1
        self.feature, self.cut = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32)
        self.leaf = np.zeros((TREES, 1 << DEPTH), np.float32)
        rate = float(np.clip((y * weight).sum() / weight.sum(), 0.01, 0.99))
        self.bias = np.log(rate / (1 - rate))
        score = np.full(len(y), self.bias)
        rng = np.random.default_rng(5)
        for t in range(TREES):
            some = np.sort(rng.permutation(len(y))[: int(ROWS * len(y))])
            cols = np.sort(rng.permutation(x.shape[1])[: int(COLUMNS * x.shape[1])])
            flat = binned[np.ix_(some, cols)] + np.arange(len(cols)) * BINS
            p = 1 / (1 + np.exp(-score))
            grad, hess = (y - p) * weight, p * (1 - p) * weight
            stats = [np.repeat(v, len(cols)) for v in (grad[some], hess[some])]
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width, cells = 1 << level, len(cols) * BINS
                key = (node[some][:, None] * cells + flat).ravel()
                shape = (width, len(cols), BINS)
                g, h, c = (np.bincount(key, weights=v, minlength=width * cells).reshape(shape).cumsum(axis=2) for v in (*stats, None))
                g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[(c < LEAST) | (c_all - c < LEAST)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                for k in range(width):
                    f, b = divmod(int(best[k]), BINS)
                    at = width - 1 + k
                    if gain[k, f, b] > 1e-6 and b < len(self.cuts[cols[f]]):
                        self.feature[t, at], self.cut[t, at] = cols[f], self.cuts[cols[f]][b]
                at = width - 1 + node
                node = 2 * node + (x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            g, h = np.bincount(node, grad, 1 << DEPTH), np.bincount(node, hess, 1 << DEPTH)
            self.leaf[t] = RATE * g / (h + 1)
            score += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.bias, np.float32), np.arange(len(x))
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t][at]] > self.cut[t][at])
            out += self.leaf[t][node]
        return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """For each node whether it is kept: the likeliest choice in which no node below a dropped one is."""
    n = len(page.parent)
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    keep, drop = yes[:], no[:]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """The kept text: white space in a block is one space, blocks are joined by two line feeds."""
    blocks, now = [], []
    # A dropped piece between kept ones of one block does not end it.
    pending = False
    for node, piece, fresh in page.pieces:
        pending = pending or fresh
        if kept[node]:
            if pending and now:
                blocks.append("".join(now))
                now = []
            pending = False
            now.append(piece)
    blocks.append("".join(now))
    tidy = (" ".join(b.split()) for b in blocks)
    return "\n\n".join(b for b in tidy if b)


@lru_cache(maxsize=1)
def model() -> Trees:
    """The trees, fitted on TRAINING_PAGES generated pages; the same in every run."""
    pages, labels, weights = [], [], []
    for source in pagemaker.pages(TRAINING_PAGES):
        page = Page(source)
        main = [False] * len(page.parent)
        for k, (node, piece, fresh) in enumerate(page.pieces):
            if pagemaker.MARK in piece:
                main[node] = True
                page.pieces[k] = (node, piece.replace(pagemaker.MARK, ""), fresh)
        for i in range(len(main) - 1, 0, -1):
            main[page.parent[i]] |= main[i]
        pages.append(page)
        labels.append(main)
        weights.append([1.0] * len(main))
    x = features(pages)
    return Trees().fit(x, np.concatenate(labels).astype(float), np.concatenate(weights))


def _extract(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            texts: list[str] = []
            sources = batch.column(batch.num_columns - 1).to_pylist()
            for k in range(0, len(sources), 256):
                pages = [Page(s or "") for s in sources[k : k + 256]]
                odds, at = trees.score(features(pages)), 0
                for page in pages:
                    size = len(page.parent)
                    texts.append(text_of(page, decode(page, odds[at : at + size])))
                    at += size
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "_text", "_n"])

    return run


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html, and n_chars, its code points.

    A null or empty html, or one without main text, gives an empty text.  Unclosed
    and misnested elements are read as browsers mostly do.  Whole pages are read, of
    any length; repeated rows are read alike.  Columns called like ``text_col`` or
    n_chars are replaced; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(html_col).alias("_html"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[:-1]] + ["_text string, _n bigint"])
    done = plain.mapInArrow(_extract(shared), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("_text").alias(text_col), F.col("_n").alias("n_chars"))
