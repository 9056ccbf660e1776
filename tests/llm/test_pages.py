"""Main text of pages whose parts are known."""

import json

import pytest

from scriptoria.llm import wrappers

HEAD = "<!DOCTYPE html><html><head><title>Site</title><style>p{x}</style><script>var a='<p>no</p>';</script></head><body>"
TOP = "<header class=top><a href=/>Site</a></header><ul class='main-menu'><li>Home<li>About</ul><div id=cookie-notice>We use cookies</div>"
END = "<aside>Side</aside><div class='ad ad-12'>Buy</div><form>Name <input></form><section id=comments><p>Nice post, thanks a lot</p></section><footer>&copy; Site</footer></body></html>"


def page(k, plain=False):
    body = f"<h1>Title {k}</h1><p>First   text of page {k} &amp; more<br>with a line</p><!-- c --><p>Second <b>bold {k}</b> text that is rather long and goes on<p>Unclosed {k}"
    box = f"<div class=story>{body}<div>Tell your friends</div></div>" if plain else f"<article>{body}</article>"
    want = f"Title {k}\n\nFirst text of page {k} & more with a line\n\nSecond bold {k} text that is rather long and goes on\n\nUnclosed {k}"
    return HEAD + TOP + box + END, want


@pytest.mark.parametrize("plain", [False, True])
def test_main_text(spark, plain):
    rows = [(k, f"https://h.example.com/{k}", page(k, plain)[0]) for k in range(6)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k].text == page(k, plain)[1]
        assert got[k].n_chars == len(got[k].text)


def test_copies_lose_nothing(spark):
    rows = [(k, "https://c.example.com/", page(1)[0]) for k in range(5)] + [(9, "https://single.example.com/", page(9, True)[0])]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(5)} == {page(1)[1]}
    assert got[9] == page(9)[1] + "\n\nTell your friends"


def test_expression_has_optional_repeated_and_slots():
    trees = []
    for k in range(3):
        tree = wrappers.blank()
        wrappers.fold(tree, wrappers.parse(f"<div><h2>Same</h2><p>a{k}</p>" + "<p>b</p>" * k + ("<hr>" if k else "") + "</div>"))
        trees.append(json.loads(json.dumps(tree)))
    one = wrappers.align(wrappers.align(trees[0], trees[1]), trees[2])
    assert wrappers.expression(one) == "<><div><h2>'Same'</> <p>#</>+ <hr></>?</></>"


def test_given_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        assert got[p.page_id] == "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_edges(spark):
    rows = [(1, None, None), (1, None, ""), (2, "x", "<p"), (None, "https://a/", "plain text"), (3, "https://a/", "<div>" * 300 + "deep" + "</div>" * 300), (3, "https://a/", "<p>" + "long " * 50_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' text", "1 host")
    got = wrappers.extract(frame).collect()
    assert len(got) == 6
    assert sorted(len(r.text) for r in got) == [0, 0, 0, 4, 10, 249_999]  # a tag cut by the end of the page is no text
    assert wrappers.extract(frame.where("false")).count() == 0
