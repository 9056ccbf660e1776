from helpers import rows
from pyspark.sql import functions as F

from scriptoria.operators import extract as X
from scriptoria.operators.census import child_patterns, note_census, tag_census
from scriptoria.plans.corpus import build_tables, parse_corpus
from scriptoria.sinks.render import render, render_works
from scriptoria.sources.markup import flatten_markup, node_texts, parse_errors

TEI = (
    '<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://example.org/cb" xml:id="{id}">'
    '<teiHeader><fileDesc><titleStmt><title level="m" xml:lang="zh-Hant">心經</title><title level="s" xml:lang="zh">藏</title>'
    "<author>唐 玄奘譯</author></titleStmt><extent>2卷</extent>"
    '<publicationStmt><idno type="X"><idno type="canon">T</idno>.<idno type="vol">8</idno>.<idno type="no">251</idno></idno>'
    "<availability><p>free</p></availability></publicationStmt>"
    "<sourceDesc><bibl>本</bibl></sourceDesc></fileDesc>"
    '<profileDesc><langUsage><language ident="zh-Hant">漢</language><language ident="sa">梵</language>'
    '<language ident="pi">巴</language></langUsage></profileDesc></teiHeader>'
    '<text><body><milestone unit="juan" n="1"/><cb:mulu level="1" type="品">序</cb:mulu>'
    '<lb n="0848a01"/><p>觀自在<note place="inline">注<note>內</note>文</note>菩薩<g ref="#CB1"/><space quantity="2"/>行</p>'
    '<app n="1"><lem>深</lem><rdg wit="宋">甚</rdg><rdg wit="元">探</rdg></app><lb n="0848a02"/>'
    "<choice><sic>誤</sic><corr>正</corr></choice><div><p>前</p><milestone unit=\"juan\" n=\"2\"/>"
    '<p>後<note n="2" type="mod">異</note></p></div></body></text></TEI>'
)


def docs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_path string, content string")


def glyphs(spark):
    return spark.createDataFrame(
        [("CB1", "𥙡", None, None, None)],
        "cb_id string, uni_char string, norm_uni_char string, norm_big5_char string, composition string",
    )


def test_corpus_tables(spark):
    pos = parse_corpus(docs(spark, ("f1", TEI.format(id="T08n0251"))), glyphs(spark))
    t = build_tables(pos)
    assert rows(t["catalog"], "sutra_id", "canon", "volume", "title", "author", "total_juan") == [
        ("T0251", "T", "08", "心經", "唐 玄奘譯", 2)
    ]
    assert rows(t["content"], "juan", "plain_text") == [(1, "觀自在菩薩𥙡　　行深正前"), (2, "後")]
    assert rows(t["notes"], "juan", "line_id", "note_type", "place", "content") == rows(
        spark.createDataFrame(
            [(1, "0848a01", "", "inline", "注文"), (1, "0848a01", "", "", "內"), (2, "0848a02", "mod", "", "異")],
            "a int, b string, c string, d string, e string",
        )
    )
    assert rows(t["toc"], "juan", "level", "type", "title") == [(1, 1, "品", "序")]
    app = t["apparatus"].collect()[0]
    assert app.lem_text == "深" and [tuple(r) for r in app.readings] == [("宋", "甚"), ("元", "探")]


def test_ids(spark):
    ids = spark.createDataFrame([("T08n0251",), ("B00na002",), ("J01nA042",), ("weird",)], "x string")
    parts = X.work_id_parts("x")
    got = {r.x: (r.sutra_id, r.canon) for r in ids.select("x", *[c.alias(n) for n, c in parts.items()]).collect()}
    assert got == {
        "T08n0251": ("T0251", "T"), "B00na002": ("Ba002", "B"), "J01nA042": ("JA042", "J"), "weird": ("weird", ""),
    }


def test_first_and_last_file_win(spark):
    a, b = TEI.format(id="T08n0251"), TEI.format(id="T09n0251").replace("心經", "別名").replace("後<", "末<")
    t = build_tables(parse_corpus(docs(spark, ("f1", a), ("f2", b))))
    assert rows(t["catalog"], "sutra_id", "title") == [("T0251", "心經")]
    assert dict(rows(t["content"], "juan", "plain_text"))[2] == "末"


def test_header(spark):
    e = flatten_markup(docs(spark, ("f1", TEI.format(id="T08n0251"))))
    h = X.extract_header(e).collect()[0]
    assert (h.title_zh, h.canon_name_zh, h.canon_ref, h.source, h.languages, h.availability, h.witnesses) == (
        "心經", "藏", "T.8.251", "本", "梵、巴", "free", None,
    )


def test_single_milestone_takes_whole_body(spark):
    xml = '<TEI><text><body><p>前</p><milestone unit="juan" n="3"/><p>後</p></body></text></TEI>'
    pos = parse_corpus(docs(spark, ("f", xml)))
    assert rows(X.extract_text(pos), "juan", "plain_text") == [(3, "前後")]


def test_note_classes(spark):
    xml = (
        '<TEI><text><body><p><note n="1" type="orig">o</note><note n="1" type="mod">m</note><app n="1"><lem>a'
        '<note n="9" type="add">in</note></lem><rdg>b</rdg></app><note n="2" type="mod">辨【大】＊，辯【宋】</note>'
        '<note type="star">s</note><note n="3" type="cf1">T01</note><note place="inline">夾</note><note>t</note>'
        '<note n="4" type="add">x</note></p></body></text></TEI>'
    )
    n = X.classify_notes(parse_corpus(docs(spark, ("f", xml))))
    assert [(r.note_class, r.note_idx) for r in n.orderBy("seq").collect()] == [
        ("skip", None), ("paired", 1), ("transparent", None), ("mod", 2), ("skip", None), ("cf", 3), ("inline", None),
        ("transparent", None), ("numbered", 4),
    ]
    assert rows(n.filter("note_class = 'mod'"), "object_text") == [("辨",)]
    app = X.link_apparatus_notes(X.extract_apparatus(parse_corpus(docs(spark, ("f", xml)))), n)
    assert rows(app, "n", "note_idx", "note_text") == [("1", 1, "m")]


def test_back_matter_belongs_to_the_volume_of_its_anchor(spark):
    xml = (
        '<TEI><text><body><milestone unit="juan" n="1"/><p><anchor xml:id="a1"/><note n="1" type="mod">one</note></p><lb n="0002"/>'
        '<milestone unit="juan" n="2"/><p><anchor xml:id="a2"/><note n="1" type="mod">two</note><note n="2" type="mod">only</note></p></body><back>'
        "<app from='#a1' n='1'><lem>x</lem></app><app from='#a2' n='1'><lem>y</lem></app><app from='#0002' n='2'><lem>z</lem></app><app from='#zz' n='3'><lem>w</lem></app>"
        "</back></text></TEI>"
    )
    pos = parse_corpus(docs(spark, ("f", xml)))
    app = X.link_apparatus_notes(X.extract_apparatus(pos), X.classify_notes(pos))
    assert rows(app, "lem_text", "juan", "note_text") == [("w", 1, None), ("x", 1, "one"), ("y", 2, "two"), ("z", 1, "only")]


def test_back_matter_apparatus_is_preferred(spark):
    xml = (
        "<TEI><text><body><app><lem>x</lem></app></body><back><app from='#b1' n='2'><lem>y</lem><rdg wit='W'>z</rdg></app>"
        "</back></text></TEI>"
    )
    a = X.extract_apparatus(parse_corpus(docs(spark, ("f", xml))))
    assert rows(a, "line_id", "lem_text") == [("#b1", "y")]


def test_parallel_terms_refs_pages_verses(spark):
    xml = (
        '<TEI><text><body><tt n="5"><t xml:lang="zh-Hant">佛</t><t xml:lang="sa">buddha</t><t>q</t></tt>'
        '<ref target="../T30/T30n1579.xml#x"/><pb n="0001a" xml:id="T01.0001.0001a"/><pb n="0001b" xml:id="T01.0001.0001b"/>'
        "<lg><l>諸行無常，</l><l>是 生</l></lg></body></text></TEI>"
    )
    pos = parse_corpus(docs(spark, ("f", xml)))
    assert rows(X.extract_parallel_terms(pos), "n", "zh_text", "foreign") == [("5", "佛", "SA: buddha ｜ ?: q")]
    assert rows(X.extract_refs(pos), "ref_target") == [("T30n1579",)]
    assert rows(X.extract_page_refs(pos), "image_ref") == [("Tv01p0001",)]
    assert rows(X.extract_verse_lines(pos), "n_chars") == [(2,), (4,)]


def test_broken_file_is_an_error_row(spark):
    e = flatten_markup(docs(spark, ("ok", "<a>x</a>"), ("bad", "<a><b>")))
    assert rows(parse_errors(e), "doc_path") == [("bad",)]
    assert rows(tag_census(e), "tag", "n") == [("a", 1)]


def test_html_dialect(spark):
    html = "<body><p>one<p>two <b>x</b><script>var t='</p>'</script><br>tail&amp;</body>"
    e = flatten_markup(docs(spark, ("h", html)), dialect="html")
    assert [r.text for r in node_texts(e, "p").orderBy("seq").collect()] == ["one", "two xtail&"]


def test_census(spark):
    e = flatten_markup(docs(spark, ("f1", TEI.format(id="T08n0251"))))
    assert rows(child_patterns(e, "app"), "children", "n") == [("lem,rdg,rdg", 1)]
    combos = note_census(e).filter("grouping = 'combination'")
    assert rows(combos, "type", "place", "parent", "has_n", "n") == [
        ("", "", "note", "no", 1), ("", "inline", "p", "no", 1), ("mod", "", "p", "yes", 1),
    ]


def test_render(spark):
    pos = parse_corpus(docs(spark, ("f1", TEI.format(id="T08n0251"))), glyphs(spark))
    r = render(pos, "html").orderBy("juan").collect()
    assert "<p>觀自在<span class='note-inline'>（注" in r[0].rendered and "甚" not in r[0].rendered
    works = X.extract_metadata(pos)
    w = render_works(render(pos), works).orderBy("juan").collect()
    assert w[1].content.startswith("## 卷二\n\n") and w[0].file_name == "T0251 心經"


def test_partition_invariance(spark):
    d = docs(spark, *[(f"f{i}", TEI.format(id=f"T08n{i:04d}")) for i in range(6)])
    one = build_tables(parse_corpus(d.coalesce(1)))
    many = build_tables(parse_corpus(d.repartition(6)))
    for name in ("catalog", "content", "notes", "toc"):
        assert rows(one[name].drop("doc_path", "seq")) == rows(many[name].drop("doc_path", "seq"))
    assert one["content"].select(F.count_distinct("sutra_id")).first()[0] == 6


def test_positions_of_the_parse_equal_the_windows(spark):
    """The task that parses a file tells line, volume and back matter as windows over its events would, without a shuffle."""
    mark = '<milestone unit="juan" n="{}"/>'
    xml = [
        TEI.format(id="T08n0251"), "<TEI>broken", "<TEI><text><body><lb/><p>a</p><lb n='2'/><p>b</p></body><back><lb n='9'/><p>c</p></back></text></TEI>",
        "<TEI><text><body><p>a</p>" + "".join(mark.format(n) + f"<p>{n}</p>" for n in (" 3 ", "+4", "x", "1.5", "99999999999", "-2", "")) + "</body></text></TEI>",
        "<TEI><text><body><p>a</p>" + mark.format(7) + "<p>b</p>" + mark.format("q") + "<p>c</p></body></text></TEI>",
        "<TEI><text><body><p>a</p><milestone unit='juan'/><p>b</p><milestone unit='x' n='5'/><milestone unit='juan' n='2'/><p>c</p></body></text></TEI>",
        "<TEI><text><front>" + mark.format(8) + "<lb n='0'/></front><body><p>a</p></body></text></TEI>", "",
    ]
    d = docs(spark, *[(f"f{k}", x) for k, x in enumerate(xml)])
    cols = ["doc_path", "seq", "line_id", "has_back", "juan"]
    for initial in (1, 4):
        placed = flatten_markup(d, initial=initial, flush_rows=7)
        want = X.positioned(flatten_markup(d), initial)
        assert rows(placed.select(cols)) == rows(want.select(cols)) and set(placed.columns) == set(want.columns)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()


def test_event_table_is_read_by_kind_and_sizes_need_no_texts(spark):
    """A scan of one kind leaves the others' files alone; characters per volume come without a list of texts."""
    pos = parse_corpus(docs(spark, ("f1", TEI.format(id="T08n0251")), ("f2", TEI.format(id="T09n0252")), ("f3", "<a><b>")), glyphs(spark))
    assert {f.split("/")[-2] for f in pos.inputFiles()} == {"kind=start", "kind=text", "kind=end", "kind=error"}
    t = build_tables(pos)
    want = rows(t["content"].select("sutra_id", "juan", F.length("plain_text").cast("long").alias("n")), "sutra_id", "juan", "n")
    assert rows(t["sizes"], "sutra_id", "juan", "n_chars") == want and len(want) == 4
    assert "listagg" not in t["sizes"]._jdf.queryExecution().toString().lower()


def test_line_numbers_shuffles_once(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["line_numbers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "attrs#" not in plan.split("Exchange hashpartitioning")[0]
