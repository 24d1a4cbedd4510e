"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is scanned once into leaf blocks: runs of text between block-level tags,
each with the elements above it. A block's features are its own and its
ancestors' tags, the words of their class, id and role attributes, and facts
about the text (length, link share, punctuation, place). Two labels, main and
rest, are chained: weights of features and of label transitions are fitted by
conditional likelihood (forward-backward, Adagrad, L2), and pages are decoded
by Viterbi.

Training pages are labelled: a bounded sample (``SAMPLE_PAGES``) of the corpus
whose own markup names the article and the parts around it, and
``DRAWN_PAGES`` pages drawn from templates, whose labels are known as they are
written; these vary the markup, so that the model does not hang on one tag.

Defined cases: null or empty html has no blocks and the text is empty; a
cut-off tag at the end is dropped; unclosed elements end with their parent, an
unclosed head with what cannot stand in it; deep and unbalanced pages of any
length take time in proportion to their length; repeated rows get equal
answers; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.session import table_path

SAMPLE_PAGES, DRAWN_PAGES = 200, 1000
HASH_BITS = 14
#: Blocks of one training sequence; longer pages are several sequences.
SEQUENCE = 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements whose content is no text of the page.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_SILENT = frozenset("head template noscript svg math select option button object audio video canvas datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
#: Elements that the start of another of their kind (or of a block, for p) closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
#: Elements that can stand in a head without ending it.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_SCOPE = frozenset("ul ol dl table div article section main body blockquote".split())
_SPACE = re.compile(r"\s+")


class Element:
    """An element that tells something of the text in it, and the one above it.

    ``fresh`` are the (hashed) names that no element above has, ``tail`` those
    of the last tags; so a path's names are the fresh ones of its elements and
    one tail, however deep it is.
    """

    __slots__ = ("above", "tag", "words", "names", "fresh", "tail", "inside", "rest")

    def __init__(self, above: Element | None, tag: str, words: list[str], open_names: Counter[int]):
        self.above, self.tag, self.words = above, tag, words
        # a word and its beginning: comment, comments, commentlist
        self.names = {_hash("a:" + tag)} | {_hash(x) for w in words for x in ("w:" + w, "s:" + w[:6])}
        self.fresh = tuple(h for h in self.names if not open_names[h])
        for h in self.names:
            open_names[h] += 1
        ends = {_hash("t:" + tag), _hash("u:" + (f"{above.tag}/{tag}" if above else tag))}
        self.tail = tuple(h for h in ends if not open_names[h])
        self.inside = above is not None and above.inside or tag in ("article", "main") or "r=main" in words
        self.rest = above is not None and above.rest or tag in _REST_TAGS or any(w[2:] in REST_WORDS for w in words)


@dataclass
class Block:
    text: str
    where: Element | None  # the innermost element above that tells something
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """One entry for each element above: tag and the words of its attributes."""
        out, at = [], self.where
        while at is not None:
            out.append(" ".join([at.tag, *at.words]))
            at = at.above
        return tuple(reversed(out))


@dataclass
class _Scan:
    """Elements open at a place of the page, and the text since the last block edge.

    Places in the stack are kept by tag, and of blocks and scopes, so that no
    tag of the page is looked for by walking through all open elements.
    """

    stack: list[tuple[str, Element | None, bool]] = field(default_factory=list)
    places: defaultdict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    block_places: list[int] = field(default_factory=list)
    scope_places: list[int] = field(default_factory=list)
    open_names: Counter[int] = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    silent: int = 0

    def text(self, raw: str) -> None:
        if self.silent and raw.strip():
            self.end_head("")
        if raw and not self.silent:
            t = unescape(raw) if "&" in raw else raw
            self.pieces.append(t)
            if self.links:
                self.linked += len(t.strip())

    def flush(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", "".join(self.pieces)).strip()
            if text:
                self.blocks.append(Block(text, self.stack[-1][1] if self.stack else None, self.linked))
            self.pieces, self.linked = [], 0

    def pop(self) -> None:
        tag, element, own = self.stack.pop()
        for places, held in ((self.places[tag], True), (self.block_places, tag in _BLOCK), (self.scope_places, tag in _SCOPE)):
            if held:
                places.pop()
        if own:
            self.open_names.subtract(element.names)
        self.links -= tag == "a"
        self.silent -= tag in _SILENT

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def end_head(self, tag: str) -> None:
        """What cannot stand in a head ends an open one, a body also what is open within it."""
        if tag == "body" and self.places["head"]:
            self.close("head")
        elif self.stack and self.stack[-1][0] == "head" and tag not in _HEAD:
            self.pop()

    def open(self, tag: str, attributes: str, closed: bool) -> None:
        self.end_head(tag)
        if tag in _BLOCK:
            self.flush()
            self._imply_ends(tag)
        elif tag == "br":
            self.text(" ")
        if tag in _VOID or closed and tag not in _BLOCK and tag not in _SILENT and tag != "a":
            return
        if tag == "a" and self.places["a"]:
            self.close("a")
        words = []
        for m in _ATTRIBUTE.finditer(attributes):
            kind = m[1].lower()
            words += [("r=" if kind == "role" else "c=") + w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower()) if w]
        above = self.stack[-1][1] if self.stack else None
        own = tag in _BLOCK or bool(words)
        place = len(self.stack)
        self.stack.append((tag, Element(above, tag, words, self.open_names) if own else above, own))
        for places, held in ((self.places[tag], True), (self.block_places, tag in _BLOCK), (self.scope_places, tag in _SCOPE)):
            if held:
                places.append(place)
        self.links += tag == "a"
        self.silent += tag in _SILENT

    def _imply_ends(self, tag: str) -> None:
        """A block ends the paragraphs, and some the elements of their kind, that are open within the innermost scope."""
        scope = self.scope_places[-1] if self.scope_places else -1
        ended = []
        for t in ("p", *_CLOSES.get(tag, ())):
            places = self.places[t]
            at = bisect_right(places, scope)
            ended += places[at:at + 1]
        if ended:
            self.cut(min(ended))

    def close(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        places = self.places[tag]
        if not places:
            return
        # the end of an inline element does not reach beyond a block
        if tag not in _BLOCK and tag not in _SILENT and tag != "a" and self.block_places and self.block_places[-1] > places[-1]:
            return
        self.cut(places[-1])


def leaf_blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    scan, at, html = _Scan(), 0, html or ""
    while True:
        m = _TAG.search(html, at)
        if m is None:
            scan.text(html[at:])
            break
        scan.text(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), (m[3] if m[2] else m[6]) or ""
        if m[0][-1:] != ">":
            break  # cut off within a tag
        if m[1] or m[4]:
            scan.close(tag)
        elif tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            if end is None:
                break
            at = html.find(">", end.start()) + 1 or len(html)
        else:
            scan.open(tag, attributes, attributes.endswith("/"))
    scan.flush()
    return scan.blocks


_MEMO: dict[str, int] = {}


def _hash(name: str) -> int:
    h = _MEMO.get(name)
    if h is None:
        h = zlib.crc32(name.encode()) >> (32 - HASH_BITS)
        if len(_MEMO) < 100_000:
            _MEMO[name] = h
    return h


_ROOT = ("t:", "u:")  # the names of a path without elements


def _path_hashes(where: Element | None, memo: dict[Element, frozenset[int]]) -> frozenset[int]:
    """All names of a path; elements that add none share the set of the one above."""
    chain, at = [], where
    while at is not None and at not in memo:
        chain.append(at)
        at = at.above
    names = memo[at] if at is not None else frozenset()
    for at in reversed(chain):
        names = memo[at] = names.union(at.fresh) if at.fresh else names
    return names.union(where.tail if where is not None else map(_hash, _ROOT))


def _text_names(b: Block, place: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    stops = sum(b.text.count(c) for c in ".!?;")
    return ["bias", f"words:{min(7, words.bit_length())}", f"links:{0 if not share else 1 + int(share * 3)}", f"stops:{min(3, stops)}",
            f"commas:{min(3, b.text.count(','))}", f"end:{b.text[-1] in '.!?…»”)'}", f"sign:{any(c in b.text for c in '©®»›')}",
            f"first:{min(place, 3)}", f"last:{min(n - 1 - place, 2)}", f"digits:{sum(c.isdigit() for c in b.text[:200]) * 5 > min(200, len(b.text))}"]


def features(blocks: list[Block]) -> list[list[int]]:
    n = len(blocks)
    memo: dict[Element, frozenset[int]] = {}
    return [sorted(_path_hashes(b.where, memo).union(_hash(x) for x in _text_names(b, i, n))) for i, b in enumerate(blocks)]


@dataclass
class Crf:
    """Label 1 (main) has feature weights; labels have transition weights [from, to], start and end weights."""

    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def emissions(self, blocks: list[Block]) -> list[float]:
        w, n, out = self.weights, len(blocks), []
        above: dict[Element | None, float] = {None: 0.0}
        for i, b in enumerate(blocks):
            chain, at = [], b.where
            while at not in above:
                chain.append(at)
                at = at.above
            score = above[at]
            for at in reversed(chain):
                score = above[at] = score + sum(w[h] for h in at.fresh)
            tail = b.where.tail if b.where is not None else {_hash(x) for x in _ROOT}
            out.append(float(score + sum(w[h] for h in tail) + sum(w[_hash(x)] for x in _text_names(b, i, n))))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        """The likeliest labels; of equal paths the one that keeps less."""
        (a00, a01), (a10, a11) = self.move.tolist()
        s0, s1 = self.start.tolist()
        back, first = [], True
        for e in scores:
            if first:
                x0, x1, first = s0, s1 + e, False
                continue
            from0, from1 = int(x1 + a10 > x0 + a00), int(x1 + a11 > x0 + a01)
            x0, x1 = max(x0 + a00, x1 + a10), max(x0 + a01, x1 + a11) + e
            back.append((from0, from1))
        if first:
            return []
        label = int(x1 + self.end[1] > x0 + self.end[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        labels = self.viterbi(self.emissions(blocks))
        return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def fit_crf(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum conditional likelihood over labelled sequences, all at once, by Adagrad."""
    parts = [(f[i:i + SEQUENCE], y[i:i + SEQUENCE]) for f, y in pages for i in range(0, len(f), SEQUENCE)]
    n, size = len(parts), 1 << HASH_BITS
    length = np.array([len(y) for _, y in parts])
    flat = [(p * SEQUENCE + i, x) for p, (f, _) in enumerate(parts) for i, xs in enumerate(f) for x in xs]
    where, which = (np.array(c, np.int64) for c in zip(*flat, strict=True))
    gold = np.zeros((n, SEQUENCE), np.int64)
    live = np.arange(SEQUENCE) < length[:, None]
    for p, (_, y) in enumerate(parts):
        gold[p, :len(y)] = y
    last = length - 1
    rows = np.arange(n)
    w, move, start, end = np.zeros(size), np.zeros((2, 2)), np.zeros(2), np.zeros(2)
    past = [np.full_like(x, 1e-8) for x in (w, move, start, end)]
    for _ in range(rounds):
        e = np.bincount(where, w[which], n * SEQUENCE).reshape(n, SEQUENCE)
        emit = np.stack([np.zeros_like(e), e], 2)
        fwd, bwd = np.zeros((n, SEQUENCE, 2)), np.zeros((n, SEQUENCE, 2))
        fwd[:, 0] = start + emit[:, 0]
        for t in range(1, SEQUENCE):
            fwd[:, t] = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + emit[:, t]
        bwd[:] = end
        for t in range(SEQUENCE - 2, -1, -1):
            on = emit[:, t + 1] + bwd[:, t + 1]
            step = np.logaddexp(move[:, 0] + on[:, :1], move[:, 1] + on[:, 1:])
            bwd[:, t] = np.where((t < last)[:, None], step, end)
        z = np.logaddexp.reduce(fwd[rows, last] + end, 1)
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * live
        both = (fwd[:, :-1, :, None] + move + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        on = live[:, 1:, None, None]
        expected = (np.exp(np.where(on, both, -np.inf))).sum((0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        one_hot = np.eye(2)
        p_first = np.stack([1 - p1[:, 0], p1[:, 0]], 1)
        p_last = np.stack([1 - p1[rows, last], p1[rows, last]], 1)
        miss = ((gold - p1) * live).ravel()
        grads = [np.bincount(which, miss[where], size) / n - l2 * w, (seen - expected) / n - l2 * move,
                 (one_hot[gold[:, 0]] - p_first).mean(0) - l2 * start, (one_hot[gold[rows, last]] - p_last).mean(0) - l2 * end]
        for x, g, h in zip((w, move, start, end), grads, past, strict=True):
            h += g * g
            x += rate * g / np.sqrt(h)
    return Crf(w, move, start, end)


#: Words in class, id and role by which a page's own markup names what is not its article (fixed values).
REST_WORDS = frozenset("""ad ads advert advertisement banner breadcrumb comment comments commentlist cookie disqus footer form header login menu
nav navbar navigation newsletter notice pagination popup promo related reply respond share sidebar social sponsor subscribe widget""".split())
_REST_TAGS = frozenset("nav aside footer header form menu dialog fieldset".split())


def markup_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by a page's own markup, or None if it names no article."""
    out = [int(b.where is not None and b.where.inside and not b.where.rest) for b in blocks]
    return out if any(out) else None


def drawn_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page drawn from templates, and the label of each of its blocks."""
    syllables = "ba ce di lo mu ne ra si to ve wi xo ka le mi no pu re sa te".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    labels: list[int] = []

    def words(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize()

    def sentences(n: int) -> str:
        return " ".join(words(rng.randint(4, 18)).replace(" ", rng.choice([", ", " ", " "]), 1) + rng.choice(".....!?") for _ in range(n))

    def say(label: int, html: str) -> str:
        labels.append(label)
        return html

    def link(n: int = 2) -> str:
        return f'<a href="/{word()}">{words(rng.randint(1, n))}</a>'

    def wrap(tag: str, names: list[str], inner: list[str]) -> str:
        name = rng.choice(names)
        attribute = rng.choice(["class", "class", "id"])
        return f'<{tag} {attribute}="{name}">' + "".join(inner) + f"</{tag}>" if name else f"<{tag}>" + "".join(inner) + f"</{tag}>"

    def menu() -> str:
        items = [say(0, f"<li>{link()}</li>") for _ in range(rng.randint(2, 7))]
        return rng.choice([lambda: wrap("nav", ["", "main-nav", "navbar"], ["<ul>", *items, "</ul>"]),
                           lambda: wrap("div", ["menu", "navigation", "breadcrumb", "topnav", "pagination"], ["<ul>", *items, "</ul>"]),
                           lambda: wrap("ul", ["menu", "nav", "links", "breadcrumbs"], items)])()

    def header() -> str:
        inner = [say(0, f"<{t}>{words(3)}</{t}>") for t in rng.sample(["div", "p", "h1", "h2"], rng.randint(1, 2))]
        return rng.choice([lambda: wrap("header", ["", "site-header", "masthead"], inner), lambda: wrap("div", ["header", "page-header", "topbar", "branding"], inner)])()

    def footer() -> str:
        inner = [say(0, f"<p>&copy; 20{rng.randint(10, 30)} {words(2)}</p>"), *[say(0, f"<p>{sentences(1)}</p>") for _ in range(rng.randint(0, 2))]]
        return rng.choice([lambda: wrap("footer", ["", "site-footer"], inner), lambda: wrap("div", ["footer", "bottom", "copyright", "legal"], inner)])()

    def notice() -> str:
        return wrap("div", ["cookie-notice", "notice", "banner", "cookie-consent", "alert", "popup", "gdpr"], [say(0, f"<p>{sentences(rng.randint(1, 2))}</p>")])

    def advert() -> str:
        return wrap(rng.choice(["div", "aside", "section"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"], [say(0, rng.choice([sentences(1), f"<p>{sentences(2)}</p>", link(6)]))])

    def form() -> str:
        return '<form action="/x">' + say(0, f"<p>{sentences(1)}</p>") + say(0, f"<label>{words(2)}</label><input type=text> <button>{word()}</button>") + "</form>"

    def sidebar() -> str:
        inner = [say(0, f"<h3>{words(2)}</h3>"), *[say(0, rng.choice([f"<p>{link(6)}</p>", f"<p>{sentences(1)}</p>", f"<li>{link(5)}</li>"])) for _ in range(rng.randint(1, 5))]]
        return wrap(rng.choice(["aside", "div", "section", "aside"]), ["sidebar", "side", "widget", "related", "recommended", "most-read", "sidebar-right"], inner)

    def comments() -> str:
        one = lambda: wrap(rng.choice(["div", "li", "article"]), ["comment", "comment", "reply", "comment-body"], [
            say(0, rng.choice([f"<p><b>{word()}</b></p>", f"<div class=author>{words(2)}</div>", f"<h4>{words(1)}</h4>"])),
            *[say(0, f"<p>{sentences(rng.randint(1, 4))}</p>") for _ in range(rng.randint(1, 2))]])
        inner = [say(0, f"<h3>{words(1)}</h3>"), *[one() for _ in range(rng.randint(1, 4))]]
        return wrap(rng.choice(["section", "div", "ol"]), ["comments", "comment-list", "commentlist", "disqus", "responses", "discussion"], inner)

    def share() -> str:
        return wrap("div", ["share", "social", "share-buttons", "tags"], [say(0, " ".join(link(1) for _ in range(3)))])

    def body() -> str:
        out = [say(1, f"<h1>{words(rng.randint(3, 9))}</h1>")] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.72:
                out.append(say(1, f"<p>{sentences(rng.randint(1, 6))}" + rng.choice(["</p>", "</p>", "<br></p>", ""]) + "<!-- x -->"))
            elif kind < 0.8:
                out.append(say(1, f"<h2>{words(rng.randint(2, 6))}</h2>"))
            elif kind < 0.86:
                out += ["<ul>", *[say(1, f"<li>{rng.choice([sentences(1), words(4)])}</li>") for _ in range(rng.randint(2, 4))], "</ul>"]
            elif kind < 0.9:
                out.append(say(1, f"<blockquote><p>{sentences(2)}</p></blockquote>"))
            elif kind < 0.94:
                out.append(say(1, f"<p>{sentences(1)} {link(3)} {sentences(1)}</p>"))
            else:
                out.append(rng.choice([advert, share, sidebar])())
        if rng.random() < 0.2:
            out.append(rng.choice([share, comments, form])())
        tag, names = rng.choice([("article", ["", "post"]), ("article", [""]), ("main", [""]), ("div", ["content", "main-content", "post-body", "entry-content", "article-body", "story", "text"]),
                                 ("section", ["story", "article", "content"]), ("td", ["content", "main"]), ("div", [""])])
        return wrap(tag, names, out)

    before = [rng.choice([menu, header, notice, advert, sidebar, form])() for _ in range(rng.randint(1, 4))]
    middle = body()
    after = [rng.choice([footer, comments, sidebar, menu, advert, notice, form])() for _ in range(rng.randint(0, 3))] + [footer()]
    inner = "".join([*before, middle, *after])
    return f"<html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{inner}</body></html>", labels


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, drawn_pages: int = DRAWN_PAGES) -> Crf:
    """Fit on labelled pages: a bounded sample of (url, html), and drawn ones."""
    n = max(1, pages.count())
    part = min(1.0, sample_pages / n)
    drawn = pages.filter(F.pmod(F.xxhash64(F.lit("sample"), "url", "html"), F.lit(1 << 30)) < int(part * (1 << 30)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, ys = [], []
            for html in batch.column("html").to_pylist():
                blocks = leaf_blocks(html)
                labels = markup_labels(blocks)
                if labels:
                    fs.append(features(blocks))
                    ys.append(labels)
            yield pa.RecordBatch.from_arrays([pa.array(fs, pa.list_(pa.list_(pa.int32()))), pa.array(ys, pa.list_(pa.int32()))], ["f", "y"])

    rows = sorted((r.f, r.y) for r in drawn.select(F.col("html").cast("string").alias("html")).mapInArrow(label, "f array<array<int>>, y array<int>").collect())
    rng = random.Random(3)
    for _ in range(drawn_pages):
        html, labels = drawn_page(rng)
        blocks = leaf_blocks(html)
        assert len(blocks) == len(labels), html
        rows.append((features(blocks), labels))
    return fit_crf(rows)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """Main text of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [shared.value.main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(table_path(sf_dir, "pages"))
    return extract(pages, fit(pages.select("url", "html")))
