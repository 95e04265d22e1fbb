"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: runs of text between the starts and ends of block elements. Each has
features of its ancestors (tags, words of class, id and role) and of its text (length, links,
punctuation, marks such as the copyright sign). A conditional random field with two labels, trained on
labelled pages, scores each block together with its neighbours, and Viterbi decoding picks the labels.

The labelled pages are made by ``labelled_pages``: layouts of many kinds around invented words, so that
only structure and shape can be learnt. Training takes a few seconds on the driver and is the same for
every input; the model is a table of a few hundred weights.
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

from inkwell.llm.common import slices

TEXT = "page_id long, url string, text string, n_chars long"

# Fixed values of HTML: elements by how they end a block, hold no text, or hold none to show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded semantics annotation annotation-xml".split())
#: What they hold is left out once their own end tag comes; without one, what follows them may be the page.
UNSEEN = frozenset("script style noscript template head title iframe object audio video canvas select textarea datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: Other notations of a formula, which are not shown beside it.
NOTATION = frozenset(("annotation", "annotation-xml"))
#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that end an open one of their own kind, and where the search for it stops.
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tag: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: int
    hidden: bool


@dataclass
class _Element:
    tag: str
    names: frozenset[str] = frozenset()
    hidden: bool = False
    closed: bool = False


@dataclass
class _Parser:
    stack: list[_Element] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    found: list[tuple[Block, list[_Element]]] = field(default_factory=list)

    def blocks(self) -> list[Block]:
        """The blocks outside of unseen elements; an element that something else than its end tag ended counts as none."""
        return [b for b, unseen in self.found if not any(e.closed for e in unseen)]

    def end_head(self) -> None:
        if self.stack and self.stack[-1].tag == "head":
            self.pop_to(len(self.stack) - 1)

    def text(self, data: str) -> None:
        if not data.isspace():
            self.end_head()
        data = entities.unescape(data) if "&" in data else data
        self.parts.append(data)
        if any(e.tag == "a" for e in self.stack):
            self.linked += len(data.strip())

    def flush(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", "".join(self.parts)).strip()
            if text:
                outer = [e for e in self.stack if e.tag not in INLINE]
                block = Block(text, outer[-1].tag if outer else "", tuple(e.tag for e in outer), frozenset().union(*(e.names for e in self.stack)) if self.stack else frozenset(), self.linked, any(e.hidden for e in self.stack))
                self.found.append((block, [e for e in self.stack if e.tag in UNSEEN]))
            self.parts, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        self.flush()
        del self.stack[k:]

    def find(self, tag: str, stops: tuple[str, ...] = ()) -> int:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                return k
            if self.stack[k].tag in stops:
                return -1
        return -1

    def start(self, tag: str, attributes: str) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        block = tag not in INLINE
        if block:
            self.flush()
        if tag in ENDS_P and (k := self.find("p", ("table", "td", "th", "button"))) >= 0:
            self.pop_to(k)
        if tag in ENDS_OWN and (k := self.find(tag, ENDS_OWN[tag])) >= 0:
            self.pop_to(k)
        if tag in VOID:
            return
        e = _Element(tag)
        if attributes and "=" in attributes or "hidden" in attributes:
            names, hidden = [], False
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "").lower()
                if name in ("class", "id", "role", "aria-label", "itemprop"):
                    names += _NAME.findall(value)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
            e.names, e.hidden = frozenset(names), hidden
        self.stack.append(e)

    def end(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.flush()
            return
        k = self.find(tag)
        if k < 0:
            return
        self.stack[k].closed = True
        if tag in INLINE:
            if any(e.tag not in INLINE for e in self.stack[k + 1 :]):
                return
            del self.stack[k]
        else:
            self.pop_to(k)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in page order; none for null or for a page without text. Broken markup is read as far as it goes."""
    p, at, page = _Parser(), 0, page or ""
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            p.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            p.end(tag)
            continue
        closed = m[3].rstrip().endswith("/") and tag not in RAW
        p.start(tag, m[3])
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            p.end(tag)
        elif tag in NOTATION and not closed and (stop := re.compile(rf"</{tag}\s*>", re.I).search(page, at)):
            at = stop.end()
            p.end(tag)
        elif closed and any(p.find(x, ("foreignobject",)) >= 0 for x in ("svg", "math")):
            p.end(tag)
    if at < len(page):
        p.text(page[at:])
    p.flush()
    return p.blocks()


_MARKS = {"copyright": re.compile(r"©|\bcopyright\b|\(c\)", re.I), "arrow": re.compile(r"[»›→|·]"), "dots": re.compile(r"\.\.\.|…")}


def block_features(b: Block) -> list[str]:
    """The names of the features that hold for a block."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    out = ["bias", f"tag={b.tag}", f"words={min(6, words.bit_length())}", f"links={0 if not b.linked else 1 + (2 * b.linked > n)}", f"ends={b.text[-1] in '.!?:;。'}", f"stops={min(3, sum(map(b.text.count, '.,;')))}"]
    out += [f"in={t}" for t in set(b.tags)] + [f"name={x}" for x in b.names]
    out += [f"mark={k}" for k, r in _MARKS.items() if r.search(b.text)]
    if b.hidden:
        out.append("hidden")
    return out


@dataclass
class Model:
    """Weights of features by label (boilerplate, content) and of steps between labels."""

    number: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        get = self.number.get
        return np.array([self.weights[[i for f in block_features(b) if (i := get(f)) is not None]].sum(axis=0) for b in blocks]).reshape(-1, 2)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        s = self.scores(blocks).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        x, y, back = s[0][0], s[0][1], []
        for u, v in s[1:]:
            from_a, from_b = x + aa >= y + ba, x + ab >= y + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            x, y = (x + aa if from_a else y + ba) + u, (x + ab if from_b else y + bb) + v
        out = [int(y > x)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Maximum likelihood by Adam; all pages go through the forward and backward sums together."""
    number: dict[str, int] = {}
    rows, labels, lengths = [], [], []
    for blocks, y in pages:
        lengths.append(len(blocks))
        labels += y
        rows += [[number.setdefault(f, len(number)) for f in block_features(b)] for b in blocks]
    size = np.array([len(r) for r in rows])
    row, index = np.repeat(np.arange(len(rows)), size), np.array([i for r in rows for i in r])
    y, lengths = np.array(labels), np.array(lengths)
    n, longest, total = len(lengths), int(lengths.max()), len(rows)
    first = np.cumsum(lengths) - lengths
    place = first[:, None] + np.arange(longest)
    there = np.arange(longest) < lengths[:, None]
    place = np.where(there, place, 0)
    gold = np.zeros((total, 2))
    gold[np.arange(total), y] = 1
    inner = np.ones(total, dtype=bool)
    inner[first] = False
    gold_steps = np.zeros((2, 2))
    np.add.at(gold_steps, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    w, t = np.zeros((len(number), 2)), np.zeros((2, 2))
    m, v = np.zeros((len(number) + 2, 2)), np.zeros((len(number) + 2, 2))
    for k in range(1, steps + 1):
        s = np.stack([np.bincount(row, weights=w[index, c], minlength=total) for c in (0, 1)], axis=1)[place]
        a, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        a[:, 0] = s[:, 0]
        for i in range(1, longest):
            step = np.logaddexp.reduce(a[:, i - 1, :, None] + t, axis=1) + s[:, i]
            a[:, i] = np.where(there[:, i, None], step, a[:, i - 1])
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        for i in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(t + (s[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            b[:, i] = np.where(there[:, i + 1, None], step, 0)
        p = np.exp(a + b - z[:, None, None])[there]
        pair = a[:, :-1, :, None] + t + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = np.exp(pair[there[:, 1:]]).sum(axis=0)
        diff = p - gold
        g = np.stack([np.bincount(index, weights=diff[row, c], minlength=len(number)) for c in (0, 1)], axis=1)
        g = np.vstack([g, expected - gold_steps]) / total + decay * np.vstack([w, t])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, t = w - move[:-2], t - move[-2:]
    return Model(number, w, t)


# Layouts of the training pages: where content stands, and what stands around it. None stands for no attribute.
_HOLDERS = [("article", None), ("article", "post"), ("main", None), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("section", "story"), ("div", "main-content"), ("div", "text"), ("div", None)]
_AROUND = {
    "nav": [("nav", None), ("nav", "menu"), ("div", "nav"), ("div", "navbar"), ("ul", "menu"), ("div", "breadcrumb"), ("div", "pagination")],
    "header": [("header", None), ("div", "header"), ("div", "masthead"), ("div", "topbar")],
    "footer": [("footer", None), ("div", "footer"), ("div", "copyright"), ("div", "bottom")],
    "side": [("aside", None), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("div", "recommended")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad"), ("ins", "adsbygoogle")],
    "notice": [("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("div", "popup"), ("div", "newsletter"), ("div", "modal"), ("dialog", None), ("div", "share"), ("div", "social")],
    "form": [("form", None), ("form", "search"), ("div", "login"), ("div", "subscribe")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "comment"), ("div", "disqus"), ("div", "replies")],
}


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with the blocks of their main text, of invented words in layouts of many kinds."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: bool(rng.random() < p)

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick(["ba", "ce", "do", "fi", "gu", "ha", "je", "ko", "li", "mu", "né", "or", "pa", "ri", "st", "tz"]) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high))))

    def sentence() -> str:
        text = words(3, 16)
        return text[:1].upper() + (text[1:].replace(" ", ", ", 1) if chance(0.5) else text[1:]) + pick([".", ".", ".", "?", "!"])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 7)))) if chance(0.85) else words(1, 60)

    def attribute(name: str | None) -> str:
        return "" if name is None else f' {pick(["class", "class", "id"])}="{name}{pick(["", "", "", "-1", " box", " wide"])}"'

    def inline(text: str) -> str:
        x = rng.random()
        if x < 0.1:
            return f"<b>{text}"
        if x < 0.2:
            first, _, rest = text.partition(" ")
            return f'<a href="/{first}">{first}</a> {rest}' if rest else text
        return f"<em>{text}</em>" if x < 0.25 else text

    def around(kind: str) -> str:
        tag, name = pick(_AROUND[kind])
        if kind == "nav":
            items = [words(1, 3) for _ in range(int(rng.integers(2, 9)))]
            body = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in items)
            body = body if tag == "ul" else f"<ul>{body}</ul>" if chance(0.7) else " ".join(f'<a href="/{x}">{x}</a>' for x in items)
        elif kind == "header":
            body = f"<h1>{words(1, 5)}</h1>" if chance(0.4) else f'<a href="/">{words(1, 4)}</a><p>{words(1, 8)}</p>'
        elif kind == "footer":
            body = f"{pick(['&copy; ', '© 2020 ', 'Copyright ', ''])}{words(1, 4)} {pick(['&middot;', '|', '-'])} {paragraph() if chance(0.6) else words(1, 9)}"
        elif kind in ("side", "ad", "notice"):
            body = paragraph() if chance(0.5) else "".join(f"<p>{paragraph()}</p>" for _ in range(int(rng.integers(1, 4))))
            if chance(0.3):
                body = f"<h3>{words(1, 4)}</h3>" + body
        elif kind == "form":
            body = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 3)}</button>" + (f"<p>{sentence()}</p>" if chance(0.5) else "")
        else:
            body = f"<h3>{words(1, 3)}</h3>" + "".join(f'<{x} class="comment"><b>{words(1, 3)}</b><p>{paragraph()}</p></{x}>' for x in [pick(["div", "li", "article"]) for _ in range(int(rng.integers(1, 5)))])
        return f"<{tag}{attribute(name)}>{body}</{tag}>"

    out = []
    for _ in range(n):
        truth, inside = [], []

        def say(tag: str, text: str, truth=truth, inside=inside) -> None:
            truth.append(_BLANK.sub(" ", text).strip())
            inside.append(f"<{tag}>{inline(text)}" + (f"</{tag}>" if tag != "p" or chance(0.9) else ""))

        if chance(0.75):
            say("h1", words(1, 10))
        for _ in range(int(rng.integers(0 if truth else 1, 9))):
            x = rng.random()
            if x < 0.8:
                say("p", paragraph())
            elif x < 0.88:
                say(pick(["h2", "h3"]), words(1, 8))
            elif x < 0.94:
                inside.append("<ul>")
                for _ in range(int(rng.integers(1, 5))):
                    say("li", words(1, 12))
                inside.append("</ul>")
            else:
                say(pick(["blockquote", "pre", "figcaption"]), paragraph())
            if chance(0.12):
                inside.append(around(pick(["ad", "side", "notice"])))
        tag, name = pick(_HOLDERS)
        if chance(0.15) and name is not None:
            inside.append(around("comments"))
        body = f"<{tag}{attribute(name)}>{''.join(inside)}{pick(['', '<br>'])}</{tag}>"
        before = "".join(around(k) for k in ("nav", "header", "notice", "ad", "form") if chance(0.45))
        after = "".join(around(k) for k in ("comments", "side", "ad", "form", "footer") if chance(0.45))
        if name is None and tag == "div":
            before = before or around("nav")
        if chance(0.3):
            before, after = f'<div class="{pick(["wrapper", "page", "container"])}">' + before, after + "</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{margin:0}}</style></head><body>{before}<!-- {words(1, 3)} -->{body}{after}</body></html>", truth))
    return out


def label_blocks(blocks: list[Block], truth: list[str]) -> list[int]:
    """1 for the blocks that are the truth's, found in order."""
    out, at = [], 0
    for b in blocks:
        hit = at < len(truth) and b.text == truth[at]
        at += hit
        out.append(int(hit))
    return out


def trained_model(pages: list[tuple[str, list[str]]] | None = None) -> Model:
    """A model from labelled pages: (html, blocks of the main text). The made ones are used where none are given."""
    data = []
    for page, truth in pages or labelled_pages():
        blocks = leaf_blocks(page)
        if blocks:
            data.append((blocks, label_blocks(blocks, truth)))
    return train(data)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """The model from the made pages, trained once in a session."""
    return trained_model()


def main_text(page: str | None, model: Model) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row. A null or empty page has an empty text; repeated rows each have theirs."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(x, model) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, TEXT)
