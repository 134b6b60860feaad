"""Main text of web pages by a conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text that no block element, line
break or rule parts. A linear chain over the blocks labels each as main text or
not, from features of its ancestors (tags, words of class and id), of its text
(length, links, punctuation) and of its place; Viterbi decodes the best chain.

The field is trained here, on a bounded sample of pages that label themselves:
inside of an article or main element, outside of what is marked as a menu, a
form and the like. The same texts are also laid out anew, in templates that
mark the parts in other ways or not at all, so that the field does not lean on
one element. Extraction is a map over the pages, without a shuffle. A page is
read in time and memory that grow with its length, however broken or deep it is:
what a failed tag has scanned is not scanned again, and blocks share what stands
above them.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import new_name, ship, table

PAGES = 150  # pages learned from, at most
PAGE_CHARS = 50_000  # longest page learned from
EPOCHS = 6

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # text up to the end tag, or to the end of the page
HIDDEN = frozenset("noscript template svg select".split())  # left out up to the matching end tag, if there is one
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var object math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom "
    "msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
# What ends an open svg or math element; in these parts of an svg it may stand.
BREAKS_OUT = CLOSES_P | frozenset(
    "b big body br center code dd dt em embed head i img li listing meta menu nobr ruby s small span strike strong "
    "sub sup tt u var".split()
)
OF_HTML = frozenset("foreignobject desc title".split())
BOILER = frozenset("nav header footer aside form menu dialog button".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer form "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup "
    "promo related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split()
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
# A tag without "<" in it and without ">" in its quotes; a failed match stops at the next "<".
_PLAIN_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/<>\"']*+)(?=[\s/>])([^<>\"']*+(?:(?:\"[^<>\"]*+\"|'[^<>']*+')[^<>\"']*+)*+)>"
)
_NAME = re.compile(r"[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_LABELLED = r"(?i)<(article|main)[\s/>]|\bdata-main\s*="  # in pages that may label themselves


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the tags and marking words above it, and the text in links.

    ``tags`` and ``marks`` are shared by the blocks that have the same above
    them; ``path`` numbers the sequences of tags of a page.
    """

    text: str
    parent: str
    tags: frozenset[str]
    marks: frozenset[str]
    path: int
    linked: int
    main: bool | None


class _Level(NamedTuple):
    """An open element, and what it and all elements around it amount to."""

    tag: str
    name: str
    tags: frozenset[str]
    marks: frozenset[str]
    path: int
    main: bool | None


class _Ahead:
    """The next match of a pattern from places that never go back; every character is looked at once."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.found = pattern, page, -1

    def __call__(self, at: int) -> int:
        if self.found < at:
            match = self.pattern.search(self.page, at)
            self.found = match.start() if match else len(self.page)
        return self.found


class _Tokens:
    """The tokens of a page: ``(begin, end, name, closing, attributes)``, no name for text and comments.

    What a failed tag has found out about its quotes is kept, so that a page of
    broken tags is read in linear time.
    """

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.last = page.rfind(">")
        self.name_end, self.special = _Ahead(_NAME_END, page), _Ahead(_QUOTE_OR_END, page)
        self.ends: dict[int, int] = {}

    def _tag_end(self, at: int) -> int:
        """Where the tag closes whose attributes begin at ``at``, -1 if a quote in it never does."""
        page, ends, seen = self.page, self.ends, []
        at = self.special(at)
        while at < self.size and page[at] != ">" and at not in ends:
            seen.append(at)
            closing = page.find(page[at], at + 1)
            found = _QUOTE_OR_END.search(page, closing + 1) if closing >= 0 else None
            at = found.start() if found else self.size
        end = ends[at] if at in ends else at if at < self.size else -1
        for quote in seen:
            ends[quote] = end
        return end

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        page = self.page
        if page[at] != "<":
            end = page.find("<", at)
            return at, self.size if end < 0 else end, "", False, ""
        plain = _PLAIN_TAG.match(page, at)
        if plain:
            return at, plain.end(), plain[2].lower(), bool(plain[1]), plain[3]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, self.size if end < 0 else end + 3, "!", False, ""
        if at >= self.last:
            return at, at + 1, "", False, ""
        if page[at + 1] in "!?":
            return at, page.find(">", at) + 1, "!", False, ""
        closing = page[at + 1] == "/"
        start = at + 1 + closing
        if not _NAME.match(page, start):
            return at, at + 1, "", False, ""
        stop = self.name_end(start)
        end = self._tag_end(stop)
        if end < 0:
            return at, at + 1, "", False, ""
        return at, end + 1, page[start:stop].lower(), closing, page[stop:end]


class _Reader:
    """Reads a page into blocks; ``known`` are the tags and marking words that matter, all if None."""

    def __init__(self, known: tuple[frozenset[str], frozenset[str]] | None = None) -> None:
        self.known = known
        self.blocks: list[Block] = []
        self.root = _Level("", "", frozenset(), frozenset(), 0, None)
        self.stack: list[_Level] = [self.root]
        self.open: Counter[str] = Counter()
        self.paths: dict[tuple[int, str], int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self.place = self.root
        self.unclosed: set[str] = set()

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            above = self.place
            linked = min(self.linked, len(text))
            self.blocks.append(Block(text, above.name, above.tags, above.marks, above.path, linked, above.main))
        self.pieces, self.linked = [], 0

    def _text(self, data: str) -> None:
        data = html.unescape(data)
        if not self.pieces:
            self.place = self.stack[-1]
        self.pieces.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())

    def _push(self, tag: str, words: list[str], main: bool | None) -> None:
        above, name = self.stack[-1], tag
        if self.known is not None:
            name = tag if tag in self.known[0] else "?"
            words = [w for w in words if w in self.known[1]]
        tags = above.tags if name in above.tags else above.tags | {name}
        marks = above.marks if above.marks.issuperset(words) else above.marks.union(words)
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
        self.stack.append(_Level(tag, name, tags, marks, path, above.main if main is None else main))
        self.open[tag] += 1

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        return tag

    def _open(self, tag: str, attributes: str, closed: bool) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            return
        if tag in BREAKS_OUT and self.open["math"]:
            self._close("math")
        if tag in CLOSES_P and self.open["p"]:
            self._close("p")
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd") and self.stack[-1].tag == tag:
            self._pop()
        if closed:
            return
        words, main = [], None
        if attributes and "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "").lower()
                if name.lower() == "data-main":
                    main = value == "1"
                else:
                    words.extend(_WORD.findall(value))
        self._push(tag, words, main)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def _behind(self, tag: str, tokens: _Tokens, at: int) -> int:
        """Where the page goes on behind an element that is left out; behind its start tag if it is never closed."""
        if tag in self.unclosed and tag != "svg":
            return at
        page = tokens.page
        if tag != "svg":
            depth, place, pattern = 1, at, re.compile(rf"<(/?){tag}\b", re.I)
            while place <= tokens.last:
                found = pattern.search(page, place)
                end = page.find(">", found.end()) if found else -1
                if end < 0:
                    break
                place = end + 1
                depth += -1 if found.group(1) else 1
                if not depth:
                    return place
            self.unclosed.add(tag)
            return at
        inside, first, place = Counter({"svg": 1}), None, at
        inner = _Tokens(page) if "svg" not in self.unclosed else tokens
        while place < tokens.size:
            begin, place, name, closing, attributes = inner.next(place)
            if closing:
                if inside[name]:
                    inside[name] -= 1
                    if not inside["svg"]:
                        return place
                elif self.open[name] or name == "p":
                    return begin
            elif name and name != "!":
                if name in BREAKS_OUT:
                    first = begin if first is None else first
                    if "svg" in self.unclosed or not any(inside[t] for t in OF_HTML):
                        return begin
                if name not in VOID and not attributes.endswith("/"):
                    inside[name] += 1
        self.unclosed.add("svg")
        return tokens.size if first is None else first

    def read(self, page: str) -> list[Block]:
        tokens, at, end = _Tokens(page), 0, len(page)
        while at < end:
            begin, at, tag, closing, attributes = tokens.next(at)
            if not tag:
                self._text(page[begin:at])
                continue
            if tag == "!":
                continue
            if closing:
                self._close(tag)
                continue
            closed = attributes.endswith("/")
            if tag in RAW and not closed:
                self._flush()
                stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
                stop = page.find(">", stop.end()) if stop else -1
                at = stop + 1 if stop >= 0 else end
                continue
            if tag in HIDDEN and not closed:
                self._flush()
                at = self._behind(tag, tokens, at)
                continue
            self._open(tag, attributes, closed)
        self._flush()
        return self.blocks


def blocks_of(page: str, known: tuple[frozenset[str], frozenset[str]] | None = None) -> list[Block]:
    return _Reader(known).read(page)


def features(blocks: list[Block]) -> Iterator[list[str]]:
    """What the field sees of each block; it knows no text but its form."""
    for i, b in enumerate(blocks):
        size, words = len(b.text), b.text.count(" ") + 1
        linked = b.linked / size
        last = b.text[-1]
        seen = [
            "bias",
            f"size:{min(8, int(math.log2(size)))}",
            f"words:{min(6, int(math.log2(words)))}",
            f"linked:{int(linked * 3.99)}",
            f"ends:{'stop' if last in '.!?…' else 'letter' if last.isalnum() else 'other'}",
            f"parent:{b.parent}",
            f"first:{i == 0}",
        ]
        if "©" in b.text:
            seen.append("copyright")
        seen.extend(f"tag:{t}" for t in b.tags)
        seen.extend(f"mark:{m}" for m in b.marks)
        if b.marks & BOILER_WORDS:
            seen.append("boiler-mark")
        if BOILER.intersection(b.tags):
            seen.append("boiler-tag")
        if i and blocks[i - 1].path != b.path:
            seen.append("turn")
        yield seen


@dataclass(frozen=True)
class Field:
    """Weights of the features for main text, and of the four steps between labels."""

    weights: dict[str, float]
    steps: tuple[float, float, float, float]

    def known(self) -> tuple[frozenset[str], frozenset[str]]:
        """Tags and marking words that can change a block's weight."""
        named = lambda kind: {f.partition(":")[2] for f in self.weights if f.startswith(kind)}
        return frozenset(named("tag:") | named("parent:") | BOILER), frozenset(named("mark:") | BOILER_WORDS)


def _emissions(weights: dict[str, float], seen: Iterable[list[str]]) -> list[float]:
    get = weights.get
    return [sum(get(f, 0.0) for f in block) for block in seen]


def viterbi(field: Field, seen: Iterable[list[str]]) -> list[bool]:
    """The best labels of a chain; a block's weight counts for main text, its absence for none."""
    emitted = _emissions(field.weights, seen)
    if not emitted:
        return []
    scores, back = (0.0, 0.0), []
    a, b, c, d = field.steps  # other to other, other to main, main to other, main to main
    for i, e in enumerate(emitted):
        if not i:
            scores = (0.0, e)
            continue
        other, main = scores
        back.append((main + c > other + a, main + d > other + b))
        scores = (max(other + a, main + c), max(other + b, main + d) + e)
    label = scores[1] > scores[0]
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def _log_add(x: float, y: float) -> float:
    high, low = (x, y) if x > y else (y, x)
    return high + math.log1p(math.exp(low - high)) if high - low < 40 else high


def _expected(emitted: list[float], steps: tuple) -> tuple[list[float], list[float]]:
    """Marginals of main text and expected steps, by forward and backward sums."""
    n = len(emitted)
    forward, backward = [(0.0, emitted[0])], [(0.0, 0.0)]
    a, b, c, d = steps
    for e in emitted[1:]:
        o, m = forward[-1]
        forward.append((_log_add(o + a, m + c), _log_add(o + b, m + d) + e))
    for e in reversed(emitted[1:]):
        o, m = backward[-1]
        backward.append((_log_add(o + a, m + e + b), _log_add(o + c, m + e + d)))
    backward.reverse()
    total = _log_add(*forward[-1])
    marginal = [math.exp(min(0.0, forward[i][1] + backward[i][1] - total)) for i in range(n)]
    counts = [0.0] * 4
    for i in range(1, n):
        (o, m), (p, q), e = forward[i - 1], backward[i], emitted[i]
        for k, value in enumerate((o + a + p, o + b + q + e, m + c + p, m + d + q + e)):
            counts[k] += math.exp(min(0.0, value - total))
    return marginal, counts


def train_field(pages: list[tuple[list[list[str]], list[bool]]], epochs: int = EPOCHS, rate: float = 0.3) -> Field:
    """Maximum likelihood by AdaGrad over the pages, in a fixed order, with a small penalty."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    steps, step_squares = [0.0] * 4, [1e-6] * 4
    for _ in range(epochs):
        for seen, labels in pages:
            marginal, counts = _expected(_emissions(weights, seen), tuple(steps))
            slope: dict[str, float] = defaultdict(float)
            for block, label, p in zip(seen, labels, marginal, strict=True):
                for f in block:
                    slope[f] += label - p
            for f, g in slope.items():
                g -= 0.01 * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / math.sqrt(squares[f])
            for x, y in itertools.pairwise(labels):
                counts[2 * x + y] -= 1
            for k in range(4):
                g = -counts[k] - 0.01 * steps[k]
                step_squares[k] += g * g
                steps[k] += rate * g / math.sqrt(step_squares[k])
    return Field(dict(weights), tuple(steps))


def own_labels(blocks: list[Block]) -> list[bool] | None:
    """Labels from a page's own markup; None if it names no article and no main element."""
    if any(b.main is not None for b in blocks):
        return [bool(b.main) for b in blocks]
    inside = [bool(b.tags & {"article", "main"}) for b in blocks]
    if not any(inside):
        return None
    return [
        i and not BOILER.intersection(b.tags) - {"header"} and not b.marks & BOILER_WORDS
        for b, i in zip(blocks, inside, strict=True)
    ]


def relaid(main: list[str], rest: list[str], turn: int) -> str:
    """A labelled page of the main texts and others, in one of many layouts."""
    own = lambda x: html.escape(x)
    pick = iter(itertools.cycle(rest or ["Home"]))
    few = lambda n: [own(next(pick)[:60]) for _ in range(n)]
    links = lambda n: "".join(f'<li><a href="#">{t[:20]}</a></li>' for t in few(n))
    body = [f"<h1>{own(main[0][:80])}</h1>"]
    kind = ("p", "p", "div", "p", "section", "p")[turn % 6]
    for i, t in enumerate(main):
        if i and i % 5 == 0 and turn % 3 == 0:
            body.append(f"<h2>{own(t[:40])}</h2>")
        if i % 4 == 3 and turn % 4 == 1:
            body.append(f"<ul><li>{own(t)}</li></ul>")
        elif i % 4 == 3 and turn % 4 == 2:
            body.append(f"<blockquote>{own(t)}</blockquote>")
        else:
            body.append(f"<{kind}>{own(t)}</{kind}>")
        if i % 3 == 1 and turn % 2:
            body.append(f'<div class="{("ad", "promo", "advert", "sponsored")[turn % 4]}" data-main="0">{few(1)[0]}</div>')
    holder = ("article", "main", 'div id="content"', 'div class="post-body"', 'div class="entry"', "section")[turn % 6]
    menu = (
        f"<nav><ul>{links(6)}</ul></nav>",
        f'<div class="menu"><ul>{links(5)}</ul></div>',
        f"<header><a href='/'>{few(1)[0]}</a><ul>{links(4)}</ul></header>",
        f'<div id="top-nav">{links(6)}</div>',
    )[turn % 4]
    long = [own(t) for t in rest if len(t) > 40] or few(2)
    said = own(main[-1])
    notes = (
        f'<section class="comments"><h3>{few(1)[0]}</h3><p>{said}</p><p>{long[0]}</p></section>',
        f"<aside><h3>{few(1)[0]}</h3><p>{long[0]}</p><ul>{links(4)}</ul></aside>",
        f'<div class="sidebar"><p>{long[0]}</p><ul>{links(5)}</ul></div>',
        f'<div id="comments"><ol><li class="comment"><p>{said}</p></li><li class="comment">{long[0]}</li></ol></div>',
        f'<form action="/s"><label>{few(1)[0]}</label><input name="q"><button>{few(1)[0]}</button></form>',
    )[turn % 5]
    notice = f'<div class="{("cookie-notice", "notice", "banner")[turn % 3]}"><p>{long[-1]}</p></div>'
    foot = f"<footer>&copy; {few(1)[0]}</footer>" if turn % 3 else f'<div class="footer">&copy; {few(1)[0]}</div>'
    parts = [menu, notice if turn % 2 else "", f'<{holder} data-main="1">', *body]
    end = f"</{holder.split()[0]}>"
    notes = f'<div data-main="0">{notes}</div>'
    parts += [notes, end] if turn % 7 in (1, 4) else [end, notes]
    return f"<html><body>{''.join(parts)}{foot}</body></html>"


def labelled_pages(pages: list[str]) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of the pages that label themselves, and of their texts laid out anew."""
    found, main, rest = [], [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = own_labels(blocks)
        if not labels or not any(labels):
            continue
        found.append((list(features(blocks)), labels))
        main.append([b.text for b, y in zip(blocks, labels, strict=True) if y])
        rest.append([b.text for b, y in zip(blocks, labels, strict=True) if not y])
    if not found:  # nothing to learn from: layouts of plain sentences
        main = [["A first sentence of some length stands here.", "Another one follows it, as long as that."] * 4]
        rest = [["Home", "About us", "All rights are reserved by the owner of this page."]]
        main, rest = main * 30, rest * 30
    for turn, (texts, others) in enumerate(zip(main, rest, strict=True)):
        for k in range(2):
            blocks = blocks_of(relaid(texts, others, 2 * turn + k))
            found.append((list(features(blocks)), own_labels(blocks)))
    return sorted(found, key=lambda x: xxhash.xxh64_intdigest(repr(x[1]) + repr(sorted(x[0][0]))))


def main_text(field: Field, page: str, known: tuple[frozenset[str], frozenset[str]] | None = None) -> str:
    blocks = blocks_of(page, known or field.known())
    return " ".join(b.text for b, y in zip(blocks, viterbi(field, features(blocks)), strict=True) if y)


def main_text_of(field: Field, page: Column) -> Column:
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = field.known()
        for pages in batches:
            yield pd.Series([main_text(field, p, known) for p in pages], dtype="object")

    return F.pandas_udf(extracted, "string")(page)


def labelled_sample(pages: DataFrame) -> list[str]:
    """At most ``PAGES`` pages that mark an article or main element, picked in the order of a hash of the page."""
    fit = pages.where(F.length("html").between(1, PAGE_CHARS) & F.col("html").rlike(_LABELLED))
    order = fit.select(F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(PAGES)
    some = fit.select("html", F.xxhash64("html").alias("h")).join(F.broadcast(order), "h").select("html").distinct()
    return sorted(r["html"] for r in some.limit(PAGES).collect())


def page_field(pages: DataFrame) -> Field:
    """Learn from at most ``PAGES`` pages that label themselves."""
    return train_field(labelled_pages(labelled_sample(pages)))


def with_main_text(pages: DataFrame, field: Field, name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page.

    A null or empty page, and one without main text, has the empty text; equal
    pages have equal texts; broken markup is read as far as it goes. An empty
    table stays empty; a column that is named like the result is an error.
    """
    new_name(pages, name)
    ship(pages.sparkSession)
    return pages.withColumn(name, main_text_of(field, F.coalesce("html", F.lit(""))))


def op10_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = with_main_text(pages, page_field(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
