"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element is a node that is content or not. A node's own evidence (tag, words in class, id and role, length of its
text, share of links) enters as log-odds; potentials connect parent and child. Sum-product messages go up and down the tree
and give each node's exact marginal. Evidence weights and potentials are trained from labelled pages, which this module
generates: page layouts of many kinds, whose elements are labelled as they are laid out.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import chunks, frame, lean, slices, utf8
from skirmish.session import share_code

# Element kinds of HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = set("annotation annotation-xml maction maligngroup malignmark math menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= MATH
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
DROPPED = set("audio button canvas datalist head iframe noscript object script select style svg template textarea title video".split())
CLOSES_P = set("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TELLING = set("article aside footer form header main nav".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "thead"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}
# Words of class, id and role by what they tell.
HINTS = {
    "advert": "ad ads advert adverts advertisement advertising banner promo promoted sponsor sponsored sponsors adsense adbox adslot doubleclick partner",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager toc skip topnav submenu sitemap",
    "frame": "header masthead footer foot copyright colophon legal topbar bottombar site-header credits logo branding",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular more complementary archive tags tagcloud",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay dialog newsletter subscribe subscription signup paywall privacy message",
    "comments": "comment comments commentlist disqus reply replies respond discussion reader-comments feedback reviews",
    "form": "form search login signin register contact input",
    "share": "share sharing social follow facebook twitter",
    "content": "content article post entry story body main text prose articlebody page-content post-content entry-content document",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Block elements in page order; a parent comes before its children. runs: (node, text), also in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[frozenset[str]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, hints: frozenset[str], label: int) -> int:
        for where, v in ((self.parent, parent), (self.tag, tag), (self.hints, hints), (self.own, 0), (self.linked, 0), (self.label, label)):
            where.append(v)
        return len(self.parent) - 1


def _read_hints(attributes: str) -> frozenset[str]:
    found = set()
    for name, a, b, c in _ATTR.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
            found |= {HINT_OF[w] for w in _WORD.findall((a or b or c).lower()) if w in HINT_OF}
    return frozenset(found)


_common_hints = functools.lru_cache(maxsize=4096)(_read_hints)


def _hints(attributes: str) -> frozenset[str]:
    return _common_hints(attributes) if len(attributes) < 256 else _read_hints(attributes)


def _label(attributes: str) -> int:
    """What generated pages say of an element."""
    m = re.search(r'data-y="([01])"', attributes)
    return int(m[1]) if m else -1


def parse(page: str, labelled: bool = False) -> Tree:
    """The block elements of a page and their text. Broken markup closes as browsers would; dropped elements have no text.

    Every step but closing looks at a bounded number of open elements, so the time is linear in the page, however many of
    them stay open. Only pages for training are labelled.
    """
    tree = Tree()
    stack: list[tuple[str, int, bool]] = [("#root", tree.add(-1, "#root", frozenset(), -1), False)]  # tag, node, dropped
    where: dict[str, list[int]] = {"#root": [0]}  # of each tag, its places in the stack
    blocks = [0]  # the places of elements that aren't inline
    links, at, size = 0, 0, len(page)

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            t, _, _ = stack.pop()
            where[t].pop()
            links -= t == "a"
            if blocks[-1] == len(stack):
                blocks.pop()

    def last(tags: set[str]) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def write(piece: str, raw: bool = False) -> None:
        _, node, dropped = stack[-1]
        if piece and not dropped:
            text = entities.unescape(piece) if "&" in piece and not raw else piece
            tree.runs.append((node, text))
            n = len(text.strip())
            tree.own[node] += n
            if links:
                tree.linked[node] += n

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            write(page[at:])
            break
        write(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag == "br":
            write(" ")
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        elif tag in SIBLINGS:
            while (i := last(SIBLINGS[tag])) > last(STOPS[tag]):
                close(i)
                if tag not in ("tr", "tbody"):
                    break
        _, node, dropped = stack[-1]
        gone = dropped or tag in DROPPED
        if tag not in INLINE:
            node = tree.add(node, tag, _hints(m[3]), _label(m[3]) if labelled else -1)
        if m[3].endswith("/") and tag not in RAW and (tag not in INLINE or tag in MATH):
            continue
        if tag not in INLINE:
            blocks.append(len(stack))
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, gone))
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            write(page[at : end.start() if end else size], raw=True)
            at = end.end() if end else size
            close(len(stack) - 1)
    return tree


def evidence(tree: Tree) -> list[list[str]]:
    """The features of each node: its own, and the telling tags and hints that it stands under."""
    out = []
    under: list[frozenset[str]] = []
    for i, (tag, parent) in enumerate(zip(tree.tag, tree.parent, strict=True)):
        above = frozenset() if parent < 0 else under[parent] | tree.hints[parent] | ({tree.tag[parent]} & TELLING)
        under.append(above)
        own, links = tree.own[i], tree.linked[i]
        f = [f"tag {tag}", *(f"hint {h}" for h in tree.hints[i]), *(f"under {h}" for h in above)]
        size = "none" if not own else "word" if own < 20 else "line" if own < 80 else "some" if own < 200 else "much"
        f += [f"own {size}", f"own {size} in {tag}"]
        if own:
            f.append("links " + ("none" if not links else "few" if links < 0.3 * own else "many" if links < 0.7 * own else "all"))
        if tag in ("p", "div", "section", "td") and own >= 80 and links < 0.3 * own:
            f.append("prose")
        out.append(f)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    pair: np.ndarray  # log potentials [parent state, child state]

    def unary(self, tree: Tree) -> np.ndarray:
        w = self.weights
        return np.array([self.bias + sum(w.get(x, 0.0) for x in f) for f in evidence(tree)])


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(parent: np.ndarray, depth: np.ndarray, odds: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The probability of state 1 at each node of a forest, by sum-product messages up and then down its levels.

    parent: -1 for roots; odds: log-odds of state 1 on a node's own evidence.
    """
    n = len(parent)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n else []
    belief = np.zeros((n, 2))  # own evidence and what children say
    belief[:, 1] = odds
    up = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        b = belief[level]
        up[level] = np.stack([_log_sum(b[:, 0] + pair[s, 0], b[:, 1] + pair[s, 1]) for s in (0, 1)], axis=1)
        up[level] -= up[level].max(axis=1, keepdims=True)
        np.add.at(belief, parent[level], up[level])
    total = belief.copy()
    for level in levels[1:]:
        above = total[parent[level]] - up[level]  # the parent's belief without this child
        down = np.stack([_log_sum(above[:, 0] + pair[0, s], above[:, 1] + pair[1, s]) for s in (0, 1)], axis=1)
        total[level] += down - down.max(axis=1, keepdims=True)
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700)))


def depths(parent: list[int]) -> np.ndarray:
    out = np.zeros(len(parent), np.int64)
    for i, p in enumerate(parent):
        out[i] = 0 if p < 0 else out[p] + 1
    return out


def labelled_pages(n: int, seed: int = 17) -> Iterator[str]:
    """Generated pages whose block elements carry data-y, 1 for content."""
    rng = np.random.default_rng(seed)
    syllables = "la mi to ren sul ka po det vor in as ke lo ru ban ti mo sen".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(int(rng.integers(lo, hi)))).capitalize()

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def named(key: str) -> str:
        if rng.random() < 0.2:
            return ""
        return f' {pick("class", "class", "id")}="{pick(*HINTS[key].split())}{pick("", " x1", "-box", " left")}"'

    def el(tag: str, inside: str, y: int, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-y="{y}">{inside}</{tag}>'

    def link_list(k: str, y: int = 0) -> str:
        items = "".join(el("li", f'<a href="/{words(1, 2)}">{words(1, 4)}</a>', y) for _ in range(int(rng.integers(2, 9))))
        return el(k, items, y)

    def paragraph(most: int = 120) -> str:
        text = words(1, most) + pick(".", ".", "!", "")
        if rng.random() < 0.2:
            text += f' <a href="#">{words(1, 4)}</a> ' + words(2, 30)
        if rng.random() < 0.2:
            text = f"<b>{text}" + pick("</b>", "<br>", "")
        return f'<p data-y="1">{text}' + pick("</p>", "</p>", "</p>", "")

    def article() -> str:
        parts = [el(pick("h1", "h1", "h2"), words(2, 10), 1)] if rng.random() < 0.9 else []
        short = rng.random() < 0.35  # verse, lists of lines, short remarks
        for _ in range(int(rng.integers(1, 60 if short else 12))):
            kind = rng.random() * (0.8 if short else 1)
            if kind < 0.75:
                parts.append(paragraph(6 if short else 120))
            elif kind < 0.8:
                parts.append(el(pick("h2", "h3"), words(1, 6), 1))
            elif kind < 0.86:
                parts.append(el(pick("ul", "ol"), "".join(el("li", words(3, 30), 1) for _ in range(int(rng.integers(2, 6)))), 1))
            elif kind < 0.9:
                parts.append(el("blockquote", el("p", words(5, 60), 1), 1))
            elif kind < 0.93:
                parts.append(el("table", el("tr", el("td", words(1, 6), 1) + el("td", words(1, 6), 1), 1), 1))
            elif kind < 0.97:
                parts.append(el("div", words(2, 20), 0, named("advert") or ' class="ad"'))
            else:
                parts.append(el("div", link_list("ul"), 0, named("share") or ' class="share"'))
        return "".join(parts)

    def boilerplate() -> list[str]:
        options = [
            lambda: el("nav", link_list("ul"), 0, named("menu") if rng.random() < 0.5 else ""),
            lambda: el("div", link_list("ul"), 0, named("menu") or ' class="menu"'),
            lambda: el("header", el(pick("h1", "div", "p"), words(1, 5), 0) + (link_list("ul") if rng.random() < 0.5 else ""), 0, named("frame") if rng.random() < 0.5 else ""),
            lambda: el("div", words(2, 40), 0, named("advert") or ' class="ad"'),
            lambda: el("div", el("p", words(2, 40), 0), 0, named("advert") or ' class="ads"'),
            lambda: el("div", el("p", words(6, 50), 0), 0, named("notice") or ' class="cookie"'),
            lambda: el("aside", el(pick("h3", "h2"), words(1, 4), 0) + pick(link_list("ul"), el("p", words(5, 50), 0)), 0, named("side") if rng.random() < 0.5 else ""),
            lambda: el("form", el("p", words(1, 12), 0) + "<input name=q>", 0, named("form") if rng.random() < 0.5 else ""),
            lambda: el(pick("div", "section", "ol"), el("h3", words(1, 3), 0) + "".join(el(pick("div", "li", "article"), el("p", words(3, 70), 0), 0, named("comments")) for _ in range(int(rng.integers(1, 5)))), 0, named("comments") or ' id="comments"'),
        ]
        return [options[i]() for i in rng.choice(len(options), int(rng.integers(1, 5)), replace=False)]

    for _ in range(n):
        blocks = boilerplate()
        cut = int(rng.integers(0, len(blocks) + 1))
        main, shape = article(), rng.random()
        if shape < 0.4:
            main = el("article", main, 1, named("content") if rng.random() < 0.3 else "")
        elif shape < 0.55:
            main = el("main", main, 1)
        elif shape < 0.8:
            main = el(pick("div", "section"), main, 1, named("content") or ' class="content"')
        elif shape < 0.9:
            main = el("div", main, 1)
        if rng.random() < 0.3 and shape < 0.9:
            main = el("div", main, 0, pick("", ' id="wrap"', ' class="container"'))
        foot = [el("footer", words(2, 20) if rng.random() < 0.6 else el("p", words(2, 20), 0) + link_list("ul"), 0)] if rng.random() < 0.7 else [el("div", words(2, 20), 0, named("frame") or ' class="footer"')]
        yield f'<!DOCTYPE html><html data-y="0"><head><title>{words(2, 5)}</title></head><body data-y="0">' + "".join([*blocks[:cut], main, *blocks[cut:], *foot]) + "</body></html>"


@functools.lru_cache(maxsize=1)
def train(n: int = 600) -> Model:
    """Evidence weights and the potential of equal neighbours, by penalised maximum pseudo-likelihood.

    Given its neighbours' labels, a node's log-odds are its evidence plus the sum of its neighbours' signs times a weight; so
    one logistic regression, fitted by Newton steps, learns all weights together.
    """
    rows, y, near = [], [], []
    for page in labelled_pages(n):
        tree = parse(page, labelled=True)
        sign = [0 if v < 0 else 2 * v - 1 for v in tree.label]
        around = [sign[p] if p >= 0 else 0 for p in tree.parent]
        for i, p in enumerate(tree.parent):
            if p >= 0:
                around[p] += sign[i]
        for f, label, a in zip(evidence(tree), tree.label, around, strict=True):
            if label >= 0:
                rows.append(f)
                y.append(label)
                near.append(a)
    names = sorted({x for f in rows for x in f})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 2))
    for i, f in enumerate(rows):
        x[i, [at[k] for k in f]] = 1
    x[:, -2], x[:, -1] = near, 1
    y = np.array(y, dtype=float)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), 1.0)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    j = w[-2] / 2
    return Model(dict(zip(names, w[:-2].tolist(), strict=True)), float(w[-1]), np.array([[j, -j], [-j, j]]))


def texts_of(pages: list[str], model: Model) -> list[str]:
    """The main texts: blocks of nodes that are more likely content than not, in page order."""
    trees = [parse(p) for p in pages]
    sizes = np.array([len(t.parent) for t in trees])
    start = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, start, strict=True)]) if trees else np.zeros(0, int)
    depth = np.concatenate([depths(t.parent) for t in trees]) if trees else np.zeros(0, int)
    odds = np.concatenate([model.unary(t) for t in trees]) if trees else np.zeros(0)
    content = marginals(parent, depth, odds, model.pair) >= 0.5
    out = []
    for t, s in zip(trees, start, strict=True):
        blocks: list[str] = []
        last, piece = -1, []
        for node, text in [*t.runs, (-1, "")]:
            if node != last:
                if piece and (line := " ".join("".join(piece).split())):
                    blocks.append(line)
                last, piece = node, []
            if node >= 0 and content[s + node]:
                piece.append(text)
        out.append("\n".join(blocks))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. A null or empty page has an empty text; other columns don't matter.

    Repeated rows are pages of their own and have equal texts. Pages are read whole, however long; few long ones at once.
    """
    share_code(pages.sparkSession)
    model = model or train()
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices((whole.slice(i, j - i) for i, j in chunks(utf8(whole.column("html"))[1], 4 << 20)), 256):
                texts = texts_of([x or "" for x in b.column("html").to_pylist()], model)
                yield frame({"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return pages.select("page_id", "url", F.col("html")).mapInArrow(lean(read), schema)
