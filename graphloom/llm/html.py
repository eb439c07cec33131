"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements and of the runs of text between them. Each node is
content or not; its features (tag, names in class, id and role, length, share of link text)
give a potential, each parent and child share one, and sum-product messages up and down
the tree give exact content marginals. Runs with a marginal of a half at least are the main
text, in page order; if there are none, the likeliest ones, unless they are unlikely. Potentials are fitted by gradient ascent on the exact log-likelihood of
labelled pages; training_pages() writes such pages by rule in many layouts, and fit()
takes any others.

Messages run level by level over all pages of a slice at once, so a page costs time linear in
its nodes. Comments, scripts, styles and other raw elements never become text.

Defined cases: null or empty html gives empty text; a page without markup is one block; tags left
open or closed twice are repaired the way browsers close paragraphs, items and cells; an element of media or
the like that is never closed hides nothing; references that don't decode, or that markup parts, stay as they are; repeated rows are extracted each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_names
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

#: Elements that stand apart from the text around them; all others are inline.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math textarea title head canvas audio video noembed noframes".split()) - {"head"}
#: Of these, an element that is never closed goes to the end of the page; and those that hold others of their name.
UNENDING = frozenset("script style textarea title".split())
NESTED = frozenset("svg object template math".split())
#: Log-odds of the likeliest run from which a page without any likelier one is still taken to have a text, and how far others may lie below.
FAINT, NEAR_BEST = -3.5, 1.0
#: Open elements that a start tag closes first, and the elements that bound the search.
_CLOSES = {
    **{t: ({"p"}, {"table", "td", "th", "button"}) for t in BLOCKS - {"button", "option", "html", "head", "body"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th", "p"}, {"tr"}),
    "th": ({"td", "th", "p"}, {"tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_LENGTHS = np.array([1, 20, 60, 150, 400, 1000])
_SHARES = np.array([0.05, 0.25, 0.5, 0.8])


class Tree:
    """Nodes in page order: parent, features and, of runs, their text."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.features: list[list[str]] = [["tag root"]]
        self.text: list[str | None] = [None]
        self.length: list[int] = [0]
        self.linked: list[int] = [0]

    def add(self, parent: int, features: list[str], text: str | None = None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.features.append(features)
        self.text.append(text)
        self.length.append(0)
        self.linked.append(0)
        return len(self.parent) - 1


def _names(attributes: str) -> list[str]:
    out = []
    for m in _NAMES.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display:\s*none|visibility:\s*hidden", value)):
            out.append("name hidden")
        elif kind in ("class", "id", "role"):
            out += ["name " + w for w in _WORD.findall(value)]
    return out


@lru_cache(maxsize=64)
def _tags_of(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?![^\s/>])[^>]*>", re.I)


def _after_raw(page: str, name: str, at: int) -> int:
    """Where the raw element that starts before `at` ends. One of text (script, style, ...) that is never closed goes to the
    end, as in browsers; of the others such a tag is passed over alone, so that the text behind it stays."""
    depth = 1
    for m in _tags_of(name).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name in NESTED:
            depth += not m[0].endswith("/>")
        elif name not in UNENDING:
            return at  # a second one starts: the first was never closed
        if not depth:
            return m.end()
    return len(page) if name in UNENDING else at


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("", 0)]
    run: list[str] = []
    run_links = links = 0

    def end_run() -> None:
        nonlocal run_links
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                at = stack[-1][1]
                i = tree.add(at, [f"in {stack[-1][0] or 'root'}"], text)
                linked = min(run_links, len(text))
                tree.length[i], tree.linked[i] = len(text), linked
            run_links = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            # references are decoded piece by piece: what markup parts is no reference
            piece = html_names.unescape(page[at:upto])
            run.append(piece)
            if links:
                run_links += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                end_run()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        attributes = m[3]
        if name in RAW:
            if not attributes.endswith("/>"):
                at = _after_raw(page, name, at)
            run.append(" ")
            continue
        if name == "a":
            links += 1
            continue
        if name not in BLOCKS:
            if name in ("br", "img", "input"):
                run.append(" ")
            continue
        end_run()
        links = 0
        shut, bound = _CLOSES.get(name, (set(), set()))
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bound:
                    break
                if stack[k][0] in shut:
                    del stack[k:]
                    if name not in ("li", "dt", "dd", "tr", "td", "th"):
                        break
                    if k <= 1 or stack[-1][0] not in shut:
                        break
        if name in VOID:
            continue
        node = tree.add(stack[-1][1], ["tag " + name, *_names(attributes)])
        stack.append((name, node))
    end_run()
    return tree


def _finish(tree: Tree) -> None:
    """Sum lengths up the tree and turn them into features."""
    for i in range(len(tree.parent) - 1, 0, -1):
        p = tree.parent[i]
        tree.length[p] += tree.length[i]
        tree.linked[p] += tree.linked[i]
    for i, own in enumerate(tree.features):
        kind = "run" if tree.text[i] is not None else "box"
        n = tree.length[i]
        own.append(f"{kind} length {int(np.searchsorted(_LENGTHS, n, 'right'))}" if kind == "run" else "box")
        own.append(f"{kind} links {int(np.searchsorted(_SHARES, tree.linked[i] / n if n else 0, 'right'))}")


class Forest:
    """Trees of many pages as arrays, by level."""

    def __init__(self, trees: list[Tree], slots: dict[str, int], grow: bool = False):
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.array(t.parent, np.int64) + f for t, f in zip(trees, self.first)])
        depth = np.concatenate([np.array(t.depth, np.int64) for t in trees])
        self.text = [x for t in trees for x in t.text]
        is_run = np.array([x is not None for x in self.text])
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)[1:]
        self.edge = np.where(is_run, 1, 0)
        node, slot = [], []
        i = 0
        for t in trees:
            _finish(t)
            for own in t.features:
                for f in own:
                    k = slots.setdefault(f, len(slots)) if grow else slots.get(f)
                    if k is not None:
                        node.append(i)
                        slot.append(k)
                i += 1
        self.node, self.slot, self.n = np.array(node, np.int64), np.array(slot, np.int64), i


def _soft(a, b):
    return np.logaddexp(a, b)


def marginals(forest: Forest, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of content of each node, and of each edge: parent's without the child, child's from below, pair).

    pair[e] = (both not, only child, only parent, both): the log-potential of edge kind e.
    """
    up = np.bincount(forest.node, weights[forest.slot], forest.n)
    t00, t01, t10, t11 = (pair[forest.edge, k] for k in range(4))
    sent = np.zeros(forest.n)
    for nodes in reversed(forest.levels):
        a = up[nodes]
        sent[nodes] = _soft(t10[nodes], t11[nodes] + a) - _soft(t00[nodes], t01[nodes] + a)
        np.add.at(up, forest.parent[nodes], sent[nodes])
    belief, rest = up.copy(), np.zeros(forest.n)
    for nodes in forest.levels:
        r = belief[forest.parent[nodes]] - sent[nodes]
        rest[nodes] = r
        belief[nodes] += _soft(t01[nodes], t11[nodes] + r) - _soft(t00[nodes], t10[nodes] + r)
    return belief, rest, up, sent


class Model:
    def __init__(self, slots: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.slots, self.weights, self.pair = slots, weights, pair

    def extract(self, pages: list[str | None]) -> list[str]:
        trees = [parse(p or "") for p in pages]
        forest = Forest(trees, self.slots)
        belief = marginals(forest, self.weights, self.pair)[0]
        belief[[x is None for x in forest.text]] = -np.inf
        content = belief >= 0
        out = []
        for a, b in zip(forest.first.tolist(), forest.first[1:].tolist()):
            if not content[a:b].any() and belief[a:b].max() > FAINT:
                content[a:b] = belief[a:b] >= belief[a:b].max() - NEAR_BEST
            out.append("\n\n".join(forest.text[i] for i in range(a, b) if forest.text[i] is not None and content[i]))
        return out


def fit(pages: list[tuple[str, list[str]]], steps: int = 150, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """Potentials from pages with their content blocks, by gradient ascent on the log-likelihood (Adam steps)."""
    slots: dict[str, int] = {}
    trees = [parse(p) for p, _ in pages]
    forest = Forest(trees, slots, grow=True)
    label = np.zeros(forest.n)
    for (_, blocks), a, b in zip(pages, forest.first.tolist(), forest.first[1:].tolist()):
        wanted = set(blocks)
        own = np.zeros(b - a)
        mass = np.zeros(b - a)
        for i in range(b - 1, a - 1, -1):
            text = forest.text[i]
            if text is not None:
                mass[i - a], own[i - a] = len(text), len(text) * (text in wanted)
            if i > a:
                p = int(forest.parent[i]) - a
                mass[p] += mass[i - a]
                own[p] += own[i - a]
        label[a:b] = own > 0
    weights, pair = np.zeros(len(slots)), np.array([[0.5, -0.5, -0.5, 0.5], [1.0, -1.0, -1.0, 1.0]])
    has = np.ones(forest.n, bool)
    has[forest.first[:-1]] = False
    up_label = np.where(has, label[np.maximum(forest.parent, 0)], 0)
    seen = np.stack([(1 - up_label) * (1 - label), (1 - up_label) * label, up_label * (1 - label), up_label * label], 1)
    m1, m2 = [np.zeros_like(weights), np.zeros_like(pair)], [np.zeros_like(weights), np.zeros_like(pair)]
    total = len(pages)
    for step in range(1, steps + 1):
        belief, rest, up, _ = marginals(forest, weights, pair)
        p = 1 / (1 + np.exp(-belief))
        g_w = np.bincount(forest.slot, (label - p)[forest.node], len(slots)) / total - decay * weights
        t = pair[forest.edge]
        joint = np.stack([t[:, 0], t[:, 1] + up, t[:, 2] + rest, t[:, 3] + rest + up], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        g_p = np.stack([((seen - joint)[has & (forest.edge == e)]).sum(0) / total for e in range(len(pair))]) - decay * pair
        for k, (x, g) in enumerate(((weights, g_w), (pair, g_p))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            x += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return Model(slots, weights, pair)


# --- labelled pages -----------------------------------------------------------------------------

_SYLLABLES = "ba den tor mi sel ra quo van lu fer nix oma pli".split()
_MAIN = ["article", "main", "section", "div"]
_MAIN_NAMES = "content post article entry story body main text prose page".split()
#: Names that sites give to what is around the main text.
_AROUND = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav links pagination pager toc tabs".split(),
    "header": "header masthead topbar banner logo branding hero site".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "aside": "sidebar aside widget rail related recommended trending popular tags archive".split(),
    "notice": "cookie consent notice alert gdpr privacy banner popup modal overlay message disclaimer toast".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion partner affiliate adsense dfp".split(),
    "form": "newsletter subscribe signup search login form contact feedback poll".split(),
    "comments": "comments comment reply replies discussion responses respond disqus thread reader".split(),
    "share": "share sharing social follow byline meta author byauthor timestamp".split(),
}


def training_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages in many layouts with the blocks of their main text, written by rule."""
    r = random.Random(seed)

    def prose(low: int, high: int) -> str:
        n_words = r.randint(low, r.choice([low + 3, high, high]))
        text = " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(n_words))
        return text.capitalize() + r.choice(["", ".", ".", "!"])

    def rich(text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and r.random() < 0.4:
            i = r.randrange(len(parts))
            parts[i] = r.choice(["<b>%s</b>", "<a href='/x'>%s</a>", "<em>%s</em>", "%s<br>", "<span class=hl>%s</span>"]) % parts[i]
        return " ".join(parts)

    def named(tag: str, names: list[str], inner: str) -> str:
        k = r.choice(["class", "class", "id"])
        word = r.choice(names) if r.random() < 0.85 else prose(1, 1).strip(".!").lower()  # a name that tells nothing
        name = r.choice(["%s", "%s", "site-%s", "%s-box", "page-%s"]) % word
        return f'<{tag} {k}="{name}">{inner}</{tag}>'

    def links(k: int) -> str:
        items = [f'<a href="/{i}">{prose(1, 3)}</a>' for i in range(k)]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items)])()

    def bare(tag: str, names: list[str], inner: str) -> str:
        return f"<{tag}>{inner}</{tag}>" if tag != "div" and r.random() < 0.6 else named(r.choice([tag, "div"]), names, inner)

    def around(kind: str) -> str:
        names = _AROUND[kind]
        if kind == "nav":
            return bare("nav", names, links(r.randint(2, 8)))
        if kind == "header":
            return bare("header", names, r.choice([f"<h1>{prose(1, 4)}</h1>", f"<p>{prose(1, 8)}</p>", links(3), f"<a href=/>{prose(1, 3)}</a>"]) + (around("nav") if r.random() < 0.4 else ""))
        if kind == "footer":
            return bare("footer", names, r.choice(["&copy; %s &middot; %s", "<p>%s</p><p>%s</p>", "<div>%s</div>%s"]) % (prose(1, 4), r.choice([prose(3, 20), links(3)])))
        if kind == "aside":
            return bare("aside", names, f"<h3>{prose(1, 4)}</h3>" + r.choice([links(4), f"<p>{prose(4, 30)}</p>"]))
        if kind == "form":
            return bare("form", names, f"<p>{prose(2, 12)}</p><label>{prose(1, 2)}</label><input name=q><button>{prose(1, 2)}</button>")
        if kind == "comments":
            one = "".join(named("div", names, f"<p>{prose(3, 30)}</p>") for _ in range(r.randint(1, 4)))
            return named(r.choice(["div", "section", "ol"]), names, f"<h2>{prose(1, 3)}</h2>" + one)
        if kind == "share":
            return named("div", names, r.choice([links(3), prose(1, 4)]))
        return named(r.choice(["div", "div", "section", "aside"]), names, r.choice([prose(2, 30), f"<p>{prose(2, 40)}</p>", f"<a href='/y'>{prose(1, 8)}</a>"]))

    out = []
    for _ in range(n):
        blocks: list[str] = []

        def block(tag: str, low: int = 1, high: int = 60) -> str:
            text = prose(low, high)
            blocks.append(text)
            return f"<{tag}>{rich(text)}" + ("" if tag == "p" and r.random() < 0.1 else f"</{tag}>")

        parts = [block("h1", 2, 12)] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 2, 4, 8, 16]) or (not parts)):
            kind = r.random()
            if kind < 0.75:
                parts.append(block("p"))
            elif kind < 0.83:
                parts.append(block(r.choice(["h2", "h3"]), 1, 8))
            elif kind < 0.9:
                parts.append("<ul>" + "".join(block("li", 1, 15) for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.93:
                parts.append("<blockquote>" + block("p") + "</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table><tr>" + block("td", 1, 4) + block("td", 1, 4) + "</tr></table>")
            else:
                parts.append(block("pre", 2, 20))
            if r.random() < 0.08:
                parts.append(around(r.choice(["ad", "share", "notice", "aside", "form"])))
        if r.random() < 0.15:
            parts.append(around("comments"))
        inner = "".join(parts)
        tag = r.choice(_MAIN)
        body = named(tag, _MAIN_NAMES, inner) if tag == "div" or r.random() < 0.4 else f"<{tag}>{inner}</{tag}>"
        if r.random() < 0.06:
            body = inner
        before = [around(k) for k in ("notice", "header", "nav", "ad", "aside", "form") if r.random() < 0.45]
        after = [around(k) for k in ("aside", "comments", "ad", "form", "notice", "footer", "share") if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        wrap = r.random()
        whole = "".join([*before, body, *after])
        if wrap < 0.3:
            whole = f'<div class="{r.choice(["wrapper", "container", "page", "layout"])}">{whole}</div>'
        head = f"<head><title>{prose(2, 6)}</title><style>p{{}}</style></head>" if r.random() < 0.8 else ""
        out.append((f"<!DOCTYPE html><html>{head}<body>{whole}</body></html>" if r.random() < 0.9 else whole, blocks))
    for _ in range(n // 20):
        text = prose(3, 60)
        out.append((text if r.random() < 0.5 else f"<p>{text}</p>", [text]))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(training_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    c.prepare(pages.sparkSession)
    used = model or default_model()
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = used.extract(some.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(c.tidy(run), f"page_id {kinds['page_id']}, url string, text string, n_chars long")
