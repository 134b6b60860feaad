"""Blocks of broken pages, the chain against all labellings, and extraction on held-out layouts."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import html_text as H
from kinfold.llm.common import table


def texts(page):
    return [b.text for b in H.blocks_of(page)]


def test_blocks():
    assert texts("") == [] and texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a <b>b</b>c<br>d<p>e</p>") == ["a bc", "d", "e"]
    assert texts("<ul><li>one<li>two</ul>x") == ["one", "two", "x"]
    assert texts("<script>var a='</p><p>no'</script>yes<style>p{}</style>") == ["yes"]
    assert texts("<SCRIPT>no</script >a<!-- <p>no</p> --><!DOCTYPE x>b") == ["ab"]
    assert texts("a<script>never ends <p>b") == ["a"] and texts("x <!-- open") == ["x"]
    assert texts('<p title="1 > 0">a\n\n  b&nbsp;c</p>1 < 2') == ["a b c", "1 < 2"]
    assert texts("</div></p>a<p/>b<") == ["a", "b<"]
    assert texts("<" * 5000) == ["<" * 5000]
    marked = H.blocks_of('<div id="side-bar" class="Ad Box"><a href="#">link</a> text</div>')[0]
    assert marked.marks >= {"side", "bar", "ad", "box"} and marked.linked == 4 and "div" in marked.tags


def test_foreign_and_hidden_elements():
    assert texts("a<svg><path d='x'><p>b</p>c") == ["a", "b", "c"]
    assert texts("<div>a<svg><g></div>b") == ["a", "b"] and texts("a<svg><text>no</text>") == ["a"]
    assert texts("a<svg>no<svg>no</svg>no</svg>b") == ["a", "b"] and texts("a<svg/>b") == ["a", "b"]
    assert texts("a<svg><foreignObject><p>no</p></foreignObject>no</svg>b") == ["a", "b"]
    assert texts("a<svg><foreignObject><p>b<p>c<svg><desc><p>d") == ["a", "b", "c", "d"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<p>b") == ["let x=1 be", "b"]
    assert texts("<div>a <math><mi>x<p>b</p>c</div>d") == ["a x", "b", "c", "d"]
    assert "math" not in H.blocks_of("<math><mi>x<p>b")[1].tags
    assert texts("a <object>b <object>c</object> d</object> e<p>f") == ["a b c d e", "f"]
    assert texts("<object data='x'><p>a</p><p>b") == ["a", "b"]
    assert texts("a<template>no<template>no</template>no</template>b<select><option>no</select>c") == ["a", "b", "c"]
    assert texts("a<select><option>b<p>c") == ["a", "b", "c"]


def brute_best(field, seen):
    weights = [sum(field.weights.get(f, 0.0) for f in s) for s in seen]
    a = np.array(field.steps).reshape(2, 2)
    score = lambda y: sum(w for w, k in zip(weights, y) if k) + sum(a[i, j] for i, j in itertools.pairwise(y))
    return max(itertools.product((0, 1), repeat=len(seen)), key=score), weights, score


def test_viterbi_and_marginals_equal_all_labellings():
    draw = random.Random(2)
    for n in range(1, 8):
        names = [[f"f{draw.randrange(5)}" for _ in range(2)] for _ in range(n)]
        field = H.Field({f"f{i}": draw.gauss(0, 1) for i in range(5)}, tuple(draw.gauss(0, 1) for _ in range(4)))
        best, weights, score = brute_best(field, names)
        assert tuple(map(int, H.viterbi(field, names))) == best
        every = list(itertools.product((0, 1), repeat=n))
        p = np.exp([score(y) for y in every])
        p /= p.sum()
        marginal, counts = H._expected(weights, field.steps)
        assert np.allclose(marginal, [sum(q for q, y in zip(p, every) if y[i]) for i in range(n)])
        steps = [sum(q for q, y in zip(p, every) for x, z in itertools.pairwise(y) if 2 * x + z == k) for k in range(4)]
        assert np.allclose(counts, steps)
    assert H.viterbi(H.Field({}, (0.0,) * 4), []) == []


def test_whole_pages_of_the_table(spark):
    """The text of each page is that of its article element, and layouts not learned from are read right."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    found = H.op10_html(spark, "/root/testdata/sf0.1").join(pages.select("page_id", "html"), "page_id").collect()
    assert len(found) == pages.count()
    field = H.page_field(pages)
    right = []
    for i, r in enumerate(found):
        blocks = H.blocks_of(r.html)
        assert r.text == " ".join(b.text for b in blocks if "article" in b.tags) and r.n_chars == len(r.text)
        if i < 300:
            main = [b.text for b in blocks if "article" in b.tags]
            other = [b.text for b in blocks if "article" not in b.tags]
            anew = H.blocks_of(H.relaid(main, other, 1000 + i))
            right += [x == y for x, y in zip(H.own_labels(anew), H.viterbi(field, H.features(anew)), strict=True)]
    assert np.mean(right) > 0.99


def test_cases(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (3, "u", "<p>" + "word " * 200_000), (4, "u", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    field = H.page_field(pages)
    got = H.with_main_text(pages, field, "found").select("page_id", "found").collect()
    assert sorted(len(r.found) for r in got if r.page_id != 3) == [0, 0, 0, 0]
    assert H.with_main_text(pages.limit(0), H.page_field(pages.limit(0)), "found").count() == 0
    with pytest.raises(ValueError, match="columns named"):
        H.with_main_text(pages, field, "Text")


BROKEN = {
    "open elements": "<div>x",
    "open links": "<a href='x",
    "angle brackets": "a<b ",
    "no ends": "<a ",
    "quotes": "<a \"'>",
    "names": "<a",
    "foreign": "<svg><foreignobject><p>",
    "raw text": "<script></script ",
    "left out": "<template ",
    "declarations": "<!x",
    "svg in depth": "<div><svg></svg>",
}


@pytest.mark.parametrize("name", [*BROKEN, "stray ends in depth", "many names"])
@pytest.mark.parametrize("last", ["", ">", "'>\">"])
def test_broken_and_deep_pages_are_read_in_linear_time(name, last):
    size = 1_000_000
    page = (BROKEN.get(name, "") * size)[: size if name in BROKEN else 0]
    if name == "stray ends in depth":
        page = "<div>" * (size // 10) + "</p>x" * (size // 10)
    elif name == "many names":
        page = "".join(f'<x{i} class="w{i}a">t' for i in range(size // 20))
    field = H.Field({"bias": 1.0, "tag:div": -0.5}, (0.1, -0.1, -0.1, 0.1))
    start = time.process_time()
    H.main_text(field, page + last)
    assert time.process_time() - start < 15  # seconds; a square would take hours
    longest = 4000  # and what is read is what the definition of a tag says
    assert list(_read(page[:longest] + last)) == list(_defined(page[:longest] + last))


_DEFINED = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S
)


def _read(page):
    tokens, at = H._Tokens(page), 0
    while at < len(page):
        begin, at, name, closing, attributes = tokens.next(at)
        yield page[begin:at], name, closing, attributes


def _defined(page):
    for found in _DEFINED.finditer(page):
        name = (found[2] or "").lower() or ("!" if found[0][:2] in ("<!", "<?") else "")
        yield found[0], name, bool(found[1]), found[3] or ""


def test_tokens_equal_their_definition():
    draw = random.Random(6)
    for _ in range(4000):
        page = "".join(draw.choice(["<", ">", '"', "'", "a", " ", "/", "!", "--", "<!--", "-->", "=", "<b "]) for _ in range(25))
        assert list(_read(page)) == list(_defined(page)), page


def test_rare_labelled_pages_are_learned_from(spark):
    plain = [f"<div>page {i}</div>" for i in range(600)]
    marked = ["<ARTICLE><p>one</p></ARTICLE>", "<main id='x'>two</main>", "<article>three</article>"]
    pages = spark.createDataFrame([(p,) for p in plain + marked], "html string")
    assert H.labelled_sample(pages) == sorted(marked)
