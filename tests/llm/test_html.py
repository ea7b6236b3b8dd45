"""Main text of pages: planted articles in made-up layouts, broken markup, and time on long pages."""

import random
import time
from html import escape

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text


def text_of(html, path=None):
    return html_text.extract(html_text.parse(html), path)


def _sentence(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor &", "sit <", "amet", "é", "ñandú", "x"]) for _ in range(n)) + "."


FRAMES = [
    "<body>{nav}{ad}<article>{main}</article>{comments}{footer}</body>",
    "<body class='has-sidebar comments-open'>{nav}<main><div class='post'>{main}</div>{comments}</main>{side}{footer}</body>",
    "<body>{header}<form id='aspnetForm' action='/x'><div class='page-wrapper'>{nav}<div id='content'>{main}</div>{side}</div></form>{footer}</body>",
    "<body><div id='page'>{nav}<div class='entry-content'>{main}</div><div class='social-share'>{ad}</div></div>{footer}</body>",
    "<body>{ad}<table><tr><td class='sidebar'>{nav}</td><td class='main-text'>{main}</td></tr></table>{footer}</body>",
    "<body>{header}{nav}<section>{main}</section>{side}{comments}</body>",
]


def planted(seed):
    """(html, the article's blocks): written down while the page is made, not by parsing it."""
    rng = random.Random(seed)
    blocks, main = [], ""
    for k in range(rng.randint(3, 9)):
        text = _sentence(rng, rng.randint(20, 60))
        kind = rng.randrange(5)
        shown = escape(text)
        if kind == 1:
            words = shown.split(" ")
            shown = " ".join([words[0], f"<b>{words[1]}</b>", f"<a href='/a>b'>{words[2]}</a>", *words[3:]])
        if kind == 2:
            shown = shown.replace(" ", "\n  ", 3).replace(" ", "<br>", 1) + rng.choice(["", "<script>if (a < b) x('</p>')</script>", "<!-- <p>no</p> -->", "<button>", "<svg><text>no</text></svg>", "<select><option>no</select>"])
        if kind == 3:
            main += f"<ul><li>{shown}<li>{shown}</ul>"
            blocks += [text, text]
        elif kind == 4:
            main += f"<h2 class='warning'>{shown}</h2>"
            blocks.append(text)
        else:
            main += f"<p>{shown}" + ("</p>" if rng.random() < 0.7 else "")
            blocks.append(text)
    parts = {
        "main": "<header class='entry-header'><h1>Title of it</h1></header>" + main,
        "nav": "<nav>" + "".join(f"<li><a href='/{i}'>menu {i}</a>" for i in range(rng.randint(3, 30))) + "</nav>",
        "ad": "<div class='ad-slot-3'>buy now</div>",
        "side": f"<div class='sidebar'><p>{_sentence(rng, 30)}</p></div>",
        "comments": "<div id='comments'>" + "".join(f"<article class='comment-body'><p>{escape(_sentence(rng, rng.randint(5, 120)))}</p></article>" for _ in range(rng.randint(1, 8))) + "</div>",
        "footer": f"<footer>&copy; {_sentence(rng, 9)}</footer>",
        "header": "<header><h1>Site</h1><form>Search <input></form></header>",
    }
    html = "<!DOCTYPE html><html><head><title>T</title></head>" + FRAMES[seed % len(FRAMES)].format(**{k: v for k, v in parts.items()}) + "</html>"
    return html, "\n".join(["Title of it", *blocks])


@pytest.mark.parametrize("seed", range(60))
def test_planted_articles(seed):
    html, want = planted(seed)
    assert text_of(html) == want


@pytest.mark.parametrize("n", [5, 5_000, 50_000])
def test_unfinished_tags_of_any_length(n):
    article = "<article>" + "<p>some words of text here</p>" * 9
    assert text_of(article + "<a href='" + "x" * n) == text_of(article + "<a href=" + "x" * n) == text_of(article)
    assert text_of(article + "<!-- " + "x" * n) == text_of(article + "<p title='" + "x" * n + ">") == text_of(article)


def test_broken_markup_hides_no_text():
    assert text_of("<p>three <") == "three <" and text_of("<p>a < b > c") == "a < b > c"
    for name in ["button", "select", "object", "svg", "video", "textarea", "template", "noscript", "iframe"]:
        assert text_of(f"<article><p>a<{name} class='x'>b</p><p>c</p></article>") == "ab\nc"
        assert text_of(f"<article><p>a<{name}>no</{name}> b</p></article>") == "a b"
        assert text_of(f"<article><{name}><p>a</p><{name}>no</{name}><p>b</p></article>") == ("a\nb" if name not in html_text.RAW else "b")
    assert text_of("<form><h1>T</h1><p>the text of the page</p></form>") == "T\nthe text of the page"
    assert text_of("<article><header><h1>T</h1></header><p>x <math><mi>y</mi></math></p></article>") == "T\nx y"
    for name in ["warning", "post-tags-explained", "related-work", "has-ads"]:
        assert text_of(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a\nb"
    assert text_of("<body><h1>T</h1><p>lead</p><div class='content'><p>text</p></div></body>") == "T\nlead\ntext"
    assert text_of("<p>a</p><p>It isn't <a title=don't>b</a> and can't</p>") == "a\nIt isn't b and can't"
    assert text_of("<p>a <span class='ad'>no</span>b<span hidden>no</span></p>") == "a b"


def test_time_is_linear():
    n = 60_000
    pages = ["<div>" * n + "x" + "</div>" * n, "<a x='>'" * n, "<b " * n, "</b>" * n, "<select>" * n, "<textarea>" * n, "<div>" * n + "</p>" * n, "<!--" * n, "<li><b>" * n, "<p>" * n + "x" * n, "&amp" * n, "<a \"'" * n]
    for page in pages:
        began = time.process_time()
        html_text.votes(html_text.parse(page))
        assert time.process_time() - began < 15, page[:20]


def test_a_host_outvotes_a_page(spark):
    """Eight pages of a host say where its articles stand; a ninth, whose promotion is longer than its article, follows them."""
    article = "<div class='c{i}'>" + "<p>the words of an article, a good many of them</p>" * 6 + "</div><div class='x'><p>a promotion</p></div>"
    odd = "<div class='c9'><p>few words</p></div><div class='x'><p>a promotion that is much longer than the article of this page, which has few words</p></div>"
    rows = [(i, "http://h.org/a", article.format(i=i)) for i in range(8)] + [(9, "http://h.org/b", odd), (10, "http://other.org/b", odd)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "few words" and got[10].startswith("a promotion")


def test_very_long_pages(spark):
    text = "<p>" + "some words " * 20 + "</p>"
    rows = [(1, "http://h.org/" + "a" * 200_000, "<article>" + text * 20_000 + "</article>"), (2, None, "<div>" * 20_000 + text)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("n_blocks", F.size(F.split("text", "\n"))).collect()}
    assert got[1].n_blocks == 20_000 and got[2].text == ("some words " * 20).strip()
