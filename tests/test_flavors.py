import os
import re

import pytest
from helpers import rows

from scriptoria.operators import extract as X
from scriptoria.plans import corpus, queries_rendering, registry  # noqa: F401
from scriptoria.plans.corpus import parse_corpus
from scriptoria.session import discard
from scriptoria.sinks.flavors import render_flavor, work_pages
from scriptoria.sources.markup import node_texts

HEAD = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="T08n0251"><teiHeader><titleStmt><title level="m" xml:lang="zh-Hant">Heart</title>'
    "<author>X</author></titleStmt><extent>2</extent></teiHeader><text><body>"
)
# body, Markdown (stripped), HTML
CASES = [
    ('<p> a\nb <lb n="1"/>c </p><p>d</p>', "ab c ^1\n\n\n\nd", '<p> a\nb <br><span class="line-num" id="lb-1">1</span>c </p><p>d</p>'),
    ('<p>x<note place="inline"> k <note>in</note></note><note n="3">no</note></p>', "x（k in）",
     '<p>x<span class="note-inline" data-type="">( k )</span><sup class="note-ref" data-n="3">[3]</sup></p>'),
    ('<div><mulu level="3" type="h"> T </mulu><head>T</head></div><div><head> U </head></div>', "##### T\n\n\n\n### U",
     '<div class="div-" data-type=""><span class="mulu" data-type="h" data-n="" hidden>T</span><h3 class="head-">T</h3></div><div class="div-" data-type=""><h3 class="head-"> U </h3></div>'),
    ('<mulu n="9" level="7"/><mulu type="卷">j</mulu>', "###### 9",
     '<span class="mulu" data-type="" data-n="9" hidden>9</span><span class="mulu" data-type="卷" data-n="" hidden>j</span>'),
    ('<lg type="r"><l> a </l><l> </l><l>b</l></lg>', "> a  \n> b",
     '<div class="verse" data-type="r"><span class="verse-line"> a </span><span class="verse-line"> </span><span class="verse-line">b</span></div>'),
    ('<list><item n="1">a</item><item><p> b </p></item></list>', "1. a\n- b",
     '<ul class="list" data-rend=""><li data-n="1">a</li><li><p> b </p></li></ul>'),
    ('<table> <row><cell>a</cell><cell cols="2"> <p>b</p> </cell></row>\n<row><cell>c</cell></row><row/></table>',
     "| a | b |\n| --- | --- |\n| c |  |\n|  |  |",
     '<table class="cbeta-table"> <tr><td>a</td><td colspan="2"> <p>b</p> </td></tr>\n<tr><td>c</td></tr><tr></tr></table>'),
    ('<quote type="q"> <p> a </p> <quote>b</quote></quote>', "> a\n\n \n\n> b",
     '<blockquote class="quote" data-type="q" data-source=""> <p> a </p> <blockquote class="quote" data-type="" data-source="">b</blockquote></blockquote>'),
    ('<p type="dharani">om<lb n="7"/></p><p>z</p><p> <unclear> </unclear></p>', "> 🔔 om\n\n\n\nz",
     '<p class="dharani">om<br><span class="line-num" id="lb-7">7</span></p><p>z</p><p> <span class="unclear" data-cert="" data-reason=""> </span></p>'),
    ('<app><lem wit="A">a</lem><lem>b</lem><rdg>c</rdg></app><tt><t xml:lang="sa">s</t><t xml:lang="zh">z</t><t xml:lang="zh">y</t></tt>', "az",
     '<span class="lem" data-wit="A">a</span><span class="lem" data-wit="">b</span><span class="rdg" data-wit="" hidden>c</span>'
     '<div class="translation" data-type=""><span class="t-text" lang="sa">s</span><span class="t-text" lang="zh">z</span><span class="t-text" lang="zh">y</span></div>'),
    ('<juan fun="open"><jhead>j</jhead></juan><p><hi rend="bold">b</hi><hi style="s">i</hi><foreign xml:lang="sa">f</foreign><unclear>u</unclear></p><juan fun="close"> end </juan><trailer>t</trailer>',
     "**b**i*f*〔u〕\n\n\n\n---\n*end*\n\n\n\n---\n*t*",
     '<h2 class="juan-title" data-fun="open">j</h2><p><b>b</b><span style="s">i</span><span class="foreign" lang="sa">f</span><span class="unclear" data-cert="" data-reason="">u</span></p>'
     '<h2 class="juan-title" data-fun="close">end</h2><p class="trailer">t</p>'),
    ('<ref target="x/T30n1579_p1">r &lt; s</ref><ref target="#q"> u </ref><g ref="#CB9"/><choice><sic>w</sic><corr>v</corr></choice><byline type="au">by</byline>',
     "[[T30n1579|r < s]]u[CB9]v\n\n*by*",
     '<a class="ref" href="x/T30n1579_p1">r &lt; s</a><a class="ref" href="#q"> u </a><span class="gaiji" data-cb="CB9">[CB9]</span>'
     '<span class="sic" hidden>w</span>v<p class="byline" data-type="au">by</p>'),
    ("", "", ""),
    ("<p/><p> </p><head/>", "", '<p></p><p> </p><h3 class="head-"></h3>'),
]


@pytest.fixture(scope="module")
def pos(spark):
    files = [(f"f{k:02d}", HEAD + body + "</body></text></TEI>") for k, (body, _, _) in enumerate(CASES)]
    return parse_corpus(spark.createDataFrame(files, "doc_path string, content string").repartition(3))


@pytest.mark.parametrize("flavor", ["markdown", "html"])
def test_every_tag(pos, flavor):
    got = {r.doc_path: r.rendered for r in render_flavor(pos, flavor).collect()}
    for k, (body, md, html) in enumerate(CASES):
        text = got[f"f{k:02d}"]
        assert (text.strip() if flavor == "markdown" else text) == (md if flavor == "markdown" else html), body


def test_heading_is_text_of_the_body(pos):
    heads = node_texts(pos, "head").filter("region = 'body'")
    assert rows(heads, "text") == [(" U ",), ("",), ("T",)]


def test_volumes_and_pages(spark):
    body = '<milestone unit="juan" n="1"/><p>a</p><p>b</p><milestone unit="juan" n="2"/><p>c</p>'
    files = spark.createDataFrame([("f", HEAD + body + "</body></text></TEI>"), ("broken", "<TEI>")], "doc_path string, content string")
    pos = parse_corpus(files)
    pages = work_pages(render_flavor(pos), X.extract_metadata(pos)).orderBy("juan").collect()
    assert [p.path for p in pages] == ["T/T08/T08n0251_Heart/000001.md", "T/T08/T08n0251_Heart/000002.md"]
    assert pages[0].content.startswith('---\nsutra_id: T0251\ntitle: Heart\nauthor: X\ncanon: T\nvolume: "08"\n')
    assert pages[0].content.endswith("# Heart\n\n## 卷一\n\na\n\nb") and pages[1].content == "## 卷二\n\nc"


@pytest.mark.parametrize("flavor", ["markdown", "html"])
def test_events_kept_by_document_are_not_shuffled(spark, pos, flavor):
    files = [(f"f{k:02d}", HEAD + body + "</body></text></TEI>") for k, (body, _, _) in enumerate(CASES)]
    kept = parse_corpus(spark.createDataFrame(files, "doc_path string, content string"), tasks=5)
    got = render_flavor(kept, flavor, dealt=True)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "1, unboundedfollowing" not in plan  # such a frame is read anew for every row of a document
    assert rows(got) == rows(render_flavor(pos, flavor))
    files = [re.sub("^file:/+", "/", f) for f in kept.inputFiles()]
    assert all(map(os.path.exists, files))
    discard(kept)
    assert files and not any(map(os.path.exists, files))


def test_pages_share_files(spark, sf, monkeypatch):
    batches = []
    settings = corpus.settings
    monkeypatch.setattr(corpus, "settings", lambda *a, **b: batches.append(b) or settings(*a, **b))
    pages = registry.QUERIES["rendered_pages"](spark, sf)
    assert 0 < len(pages.inputFiles()) < pages.count() // 10
    assert batches == [{"spark__sql__execution__arrow__maxRecordsPerBatch": "500"}]


def test_volumes_of_a_work_from_two_files(spark):
    body = '<milestone unit="juan" n="{}"/><p>{}</p>'
    files = [(p, HEAD + body.format(n, p) + "</body></text></TEI>") for p, n in (("x", 2), ("a", 3), ("b", 2))]
    pos = parse_corpus(spark.createDataFrame(files, "doc_path string, content string"))
    pages = work_pages(render_flavor(pos), X.extract_metadata(pos)).collect()
    text = {p.content.rsplit("\n", 1)[1]: p.content for p in pages}
    assert {k for k, v in text.items() if v.startswith("---")} == {"b"} and all("## 卷" in v for v in text.values())


def test_no_events(pos):
    assert render_flavor(pos.limit(0)).count() == 0
