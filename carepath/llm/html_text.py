"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each run of text is a node that is content or not. The potential between a
parent and a child depends on their kinds (article to p, body to nav, ...); evidence at a node is
what its id, class and role hint at, and for a run of text its length and its share of links. All
are counted in labelled pages. Sum-product messages go up and then down the tree, level by level
for a whole batch of pages, and give each run of text its exact marginal; runs that are content
with probability 1/2 or more make the text. Nodes with content below them are content, so a
subtree that is not content has none inside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import valid
from carepath.llm.page_maker import labelled_pages

#: Labelled pages that the model is trained on.
TRAINING_PAGES = 800
#: Elements nested deeper than this hang at this depth, as in browsers; no text goes.
DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_QUOTE_OR_END = re.compile(r"[^\"'>]*")
_HINTS = re.compile(r"(?:^|\s)(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose inside is script, style, a form's or the head's and no text of the page; their closing tags.
_DARK = {t: re.compile(rf"</{t}(?![^\s/>])", re.I) for t in "script style title textarea select".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a run of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp".split())
_KINDS = {t: k for k, ts in enumerate(("body html", "article", "main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dd dt", "nav", "header", "footer", "aside", "form fieldset button", "table thead tbody tfoot tr", "td th caption", "figure figcaption", "blockquote", "pre", "details summary dialog")) for t in ts.split()}
_OTHER, _TEXT = 20, 21
_N_KINDS = 22
#: An opening tag closes what stands before it.
_P_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_AGAINST = frozenset("ad ads advert adverts advertisement adverttext banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer foot header head masthead topbar top comment comments commentlist reply replies respond disqus cookie cookies consent notice alert gdpr popup modal dialog overlay newsletter subscribe signup login search share sharing social related recommended more widget tags pagination pager copyright legal disclaimer form toolbar skip".split())
_FOR = frozenset("article content main post entry story body text page bodytext maincontent richtext".split())


@dataclass
class Pages:
    """The nodes of some pages, parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    hint: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, kind: int, hint: int = 0, size: int = 0, links: int = 0, text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.hint.append(hint)
        self.size.append(size)
        self.links.append(links)
        self.text.append(text)
        return len(self.parent) - 1


def _hint(attributes: str) -> int:
    """0: none, 1: against, 2: for, 3: both."""
    if "=" not in attributes:
        return 0
    words = {w.lower() for m in _HINTS.finditer(attributes) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")}
    return (1 if words & _AGAINST else 0) + (2 if words & _FOR else 0)


def _references(text: str) -> str:
    """Decodes character references; numbers too large for any character become U+FFFD."""
    if "&#" in text:
        text = _MANY_ZEROS.sub(r"\1", text)
        text = _TOO_LARGE.sub("\uFFFD", text)
    return html.unescape(text)


_MANY_ZEROS = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
_TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def tags(source: str) -> Iterator[tuple[str, bool, str, str, bool]]:
    """(text before, closing, tag, attributes, last) of every tag in order; the last has the text that is left.

    Each place is looked at a bounded number of times. A quote that never closes is a plain
    character; a tag or comment that never ends takes the rest of the page, as in browsers.
    """
    at, n, text = 0, len(source), 0
    last = {q: source.rfind(q) for q in "'\""}
    while (lt := source.find("<", at)) >= 0:
        after = source[lt + 1 : lt + 4]
        if after[:1] in ("!", "?"):
            end = source.find("-->" if after == "!--" else ">", lt + 2)
            yield source[text:lt], False, "", "", False
            at = text = n if end < 0 else end + (3 if after == "!--" else 1)
            continue
        closing = after[:1] == "/"
        name = _NAME.match(source, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        k = name.end()
        while k < n:
            k = _TO_QUOTE_OR_END.match(source, k).end()
            if k >= n or source[k] == ">":
                break
            k = k + 1 if last[source[k]] == k else source.find(source[k], k + 1) + 1
        yield source[text:lt], closing, name.group().lower(), source[name.end() : k], False
        at = text = k + 1
        if not closing and (dark := _DARK.get(name.group().lower())) and not source.endswith("/", name.end(), k):
            found = dark.search(source, at)
            end = source.find(">", found.end()) if found else -1
            at = text = n if end < 0 else end + 1
    yield source[text:], False, "", "", True


def add_page(pages: Pages, source: str) -> int:
    """Adds a page's nodes; its root. Tags need not be closed or well nested.

    Open elements are kept in a stack and, for each tag, as a list of places in it, so that what a
    tag closes is found without a search.
    """
    root = pages.add(-1, _KINDS["body"])
    stack: list[tuple[str, int]] = [("html", root)]
    open_at: dict[str, list[int]] = {}
    run: list[str] = []
    linked, in_link = 0, 0

    def end_run() -> None:
        nonlocal linked
        text = " ".join(_references("".join(run)).split()) if run else ""
        if text:
            share = linked / len(text)
            size = 0 if len(text) < 20 else 1 if len(text) < 80 else 2 if len(text) < 200 else 3
            pages.add(stack[min(len(stack), DEPTH) - 1][1], _TEXT, 0, size, 0 if share < 0.1 else 1 if share < 0.6 else 2, text)
        run.clear()
        linked = 0

    def nearest(names: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

    def close(k: int) -> None:
        while k and len(stack) > k:
            open_at[stack.pop()[0]].pop()

    for text, closing, tag, attributes, last in tags(source):
        if text:
            run.append(text)
            if in_link:
                linked += len(text)
        if last or not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in _DARK:
            continue
        if tag in _VOID:
            run.append(" ")
            if tag == "hr":
                end_run()
            continue
        end_run()
        if tag in ("html", "head"):
            continue
        in_link = 0
        if closing:
            close(nearest((tag,)))
            continue
        if tag in _P_ENDS and stack[-1][0] == "p":
            close(len(stack) - 1)
        elif tag in _CLOSES and (k := nearest(_CLOSES[tag])) > nearest(_SCOPE.get(tag, ())):
            close(k)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, pages.add(stack[min(len(stack), DEPTH) - 1][1], _KINDS.get(tag, _OTHER), _hint(attributes))))
    end_run()
    return root


@dataclass(frozen=True)
class Model:
    """Log potentials: of a root, of (parent kind, child kind, parent state, child state), of hints by kind group, sizes and links by state."""

    root: np.ndarray
    edge: np.ndarray
    hint: np.ndarray
    size: np.ndarray
    links: np.ndarray

    def marginals(self, p: Pages) -> np.ndarray:
        """The probability of content of every node, by messages up and down all trees at once."""
        parent, depth, kind = np.array(p.parent), np.array(p.depth), np.array(p.kind)
        leaf = kind == _TEXT
        up = np.where(leaf[:, None], self.size[np.array(p.size)] + self.links[np.array(p.links)], self.hint[np.array(p.hint)])
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        sent = np.zeros((len(kind), 2))
        for nodes in levels[:0:-1]:
            e = self.edge[kind[parent[nodes]], kind[nodes]]
            sent[nodes] = np.logaddexp(e[:, :, 0] + up[nodes, None, 0], e[:, :, 1] + up[nodes, None, 1])
            np.add.at(up, parent[nodes], sent[nodes])
        belief = up.copy()
        if levels:
            belief[levels[0]] += self.root
        for nodes in levels[1:]:
            e = self.edge[kind[parent[nodes]], kind[nodes]]
            rest = belief[parent[nodes]] - sent[nodes]
            belief[nodes] += np.logaddexp(rest[:, 0, None] + e[:, 0, :], rest[:, 1, None] + e[:, 1, :])
            belief[nodes] -= belief[nodes].max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def train(pages: Iterator[tuple[str, set[str]]]) -> Model:
    """Counts the potentials in labelled pages: (html, the texts of it that are content)."""
    p, content = Pages(), []
    for source, kept in pages:
        start = len(p.parent)
        add_page(p, source)
        content += [t is not None and t in kept for t in p.text[start:]]
    state = np.array(content, int)
    parent, kind = np.array(p.parent), np.array(p.kind)
    for i in range(len(state) - 1, -1, -1):  # what has content below it is content
        if state[i] and parent[i] >= 0:
            state[parent[i]] = 1
    leaf, inner = kind == _TEXT, kind != _TEXT
    log = lambda c: np.log(c / c.sum(axis=-1, keepdims=True))
    edge, by_child = np.zeros((_N_KINDS, _N_KINDS, 2, 2)), np.zeros((_N_KINDS, 2, 2))
    below = parent >= 0
    np.add.at(edge, (kind[parent[below]], kind[below], state[parent[below]], state[below]), 1)
    by_child[:] = edge.sum(axis=0)
    every = by_child.sum(axis=0)
    prior = (by_child + 2 * every / every.sum(axis=-1, keepdims=True)) / (by_child.sum(axis=-1, keepdims=True) + 2)
    edge = log(edge + 1.0 * prior + 1e-6)
    per_state = lambda values, n, mask: log(np.array([np.bincount(np.array(values)[mask & (state == s)], minlength=n) + 0.5 for s in (0, 1)])).T
    return Model(np.log(np.array([0.05, 0.95])), edge, per_state(p.hint, 4, inner), per_state(p.size, 4, leaf), per_state(p.links, 3, leaf))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    A null or empty html gives an empty text, an empty table no row, and what is no UTF-8 becomes
    U+FFFD. A run of text whose two marginals tie is content. Time grows with the length of a page,
    whatever its markup. Repeated rows come back as often; other columns are not looked at. One
    pass without a shuffle.
    """
    model = train(labelled_pages(TRAINING_PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Pages()
            roots = [add_page(p, s or "") for s in b.column(2).to_pylist()]
            content = model.marginals(p) >= 0.5
            ends = [*roots[1:], len(p.parent)]
            texts = [" ".join(p.text[k] for k in range(a, z) if p.text[k] is not None and content[k]) for a, z in zip(roots, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), valid(F.col(url_col)).alias("url"), valid(F.col(html_col)).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
