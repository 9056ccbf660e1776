import json
import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_markup import TEI

from scriptoria.operators import extract as X
from scriptoria.operators import quality as Q
from scriptoria.operators.catalog import notes_for
from scriptoria.operators.tree import nav_quality
from scriptoria.plans.corpus import build_tables, parse_corpus
from scriptoria.sinks import render as R
from scriptoria.session import materialize, scratch_path, shared_dir
from scriptoria.sinks import tables as T
from scriptoria.sources import catalogs, corpus, documents, lexicons, navigation
from scriptoria.sources.markup import flatten_markup


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def test_scan(spark, tmp_path):
    for name in ("T/T08/T08n0251_001.xml", "T/T08/T08n0252_002.xml", "T/T09/T09n0262_001.xml", "X/X01/X01n0001.xml"):
        put(tmp_path / name, TEI.format(id=name.split("/")[-1][:8]))
    root = str(tmp_path)
    assert corpus.scan_corpus(spark, root).count() == 4
    assert rows(corpus.scan_corpus(spark, root, "T", "08"), "work_no", "file_juan") == [("0251", 1), ("0252", 2)]
    assert rows(corpus.scan_corpus(spark, root, "T", work="251"), "canon", "volume", "work_no") == [("T", "08", "0251")]


def test_corpus_write_is_idempotent(spark, tmp_path):
    d = spark.createDataFrame([("f1", TEI.format(id="T08n0251")), ("f2", TEI.format(id="X08n0001"))], "doc_path string, content string")
    t = build_tables(parse_corpus(d))
    out = str(tmp_path / "db")
    T.write_corpus({k: t[k] for k in ("catalog", "content")}, out)
    T.write_corpus({"content": t["content"].filter("canon = 'T'")}, out)
    assert rows(T.read_table(spark, out, "content"), "sutra_id", "juan") == [("T0251", 1), ("T0251", 2), ("X0001", 1), ("X0001", 2)]
    more = build_tables(parse_corpus(spark.createDataFrame([("f3", TEI.format(id="T08n0252"))], "doc_path string, content string")))
    T.write_corpus({k: more[k] for k in ("catalog", "content")}, out)
    one = build_tables(parse_corpus(spark.createDataFrame([("f1", "<TEI xml:id='T08n0251'><text><body><p>x</p></body></text></TEI>")], "doc_path string, content string")))
    T.write_corpus({k: one[k] for k in ("catalog", "content", "notes")}, out)
    assert rows(T.read_table(spark, out, "content"), "sutra_id", "juan") == [("T0251", 1), ("T0252", 1), ("T0252", 2), ("X0001", 1), ("X0001", 2)]
    assert rows(T.read_table(spark, out, "catalog"), "sutra_id") == [("T0251",), ("T0252",), ("X0001",)]


def test_cluster_needs_a_shared_folder():
    class Stub:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Stub)


def test_reconciliation_passes_on_own_tables(spark):
    d = spark.createDataFrame([("f1", TEI.format(id="T08n0251")), ("f2", "<TEI xml:id='T01n0001'><text><body><p>x</p></body></text></TEI>")], "doc_path string, content string")
    pos = parse_corpus(d)
    t = build_tables(pos)
    src = Q.source_counts(pos, X.doc_works(pos))
    tab = Q.table_counts(t["content"], t["notes"], t["apparatus"], t["toc"])
    got = Q.reconcile_counts(src, tab, "sutra_id", ["juans", "notes", "apps", "toc_entries"])
    assert rows(got, "sutra_id", "juans_source", "notes_source", "apps_source", "toc_entries_source", "status") == [
        ("T0001", 1, 0, 0, 0, "pass"), ("T0251", 2, 3, 1, 1, "pass"),
    ]
    assert rows(Q.verification_summary(got)) == [("pass", 2)]


NAV = (
    "<html><body><nav><span>甲部</span><ol><li><span>一</span><ol><li><cblink>T0001 長經</cblink></li></ol></li>"
    "<li><cblink>T0002 短經</cblink></li></ol><span>乙部</span><ol><li><cblink>T0003 某</cblink></li></ol>"
    "<li><span>X</span><ol><li><cblink>X0001 疏</cblink></li></ol></li></nav></body></html>"
)


def test_nav(spark):
    e = flatten_markup(spark.createDataFrame([("nav", NAV)], "doc_path string, content string"))
    n = navigation.read_nav(e, "category")
    names = {r.id: r.title for r in n.collect()}
    got = [(r.title, names.get(r.parent_id), r.sutra_id, r.sort_order) for r in n.orderBy("sort_order").collect()]
    assert got == [
        ("甲部", None, None, 1), ("一", "甲部", None, 2), ("T0001 長經", "一", "T0001", 3), ("T0002 短經", "甲部", "T0002", 4),
        ("乙部", None, None, 5), ("T0003 某", "乙部", "T0003", 6), ("X", None, None, 7), ("X0001 疏", "X", "X0001", 8),
    ]
    assert rows(nav_quality(n, toc=n.limit(2)), "table_name", "rows", "roots") == [("category", 8, 3), ("toc", 2, None)]


TOC = (
    "<toc><nav type='catalog'><ol><li><cblink href='XML/a.xml#p1'>序</cblink><ol><li><cblink href='XML/a.xml'>一</cblink></li></ol></li>"
    "<li><span>二</span></li></ol></nav><nav type='juan'><ol><li><cblink href='XML/a.xml#b#c'>卷一</cblink></li>"
    "<li><span>x</span></li><li><cblink href='XML/b.xml'>卷二</cblink></li></ol></nav></toc>"
)


def test_toc(spark):
    e = flatten_markup(spark.createDataFrame([("toc/T/T0001.xml", TOC)], "doc_path string, content string"))
    assert rows(navigation.read_toc(e), "seq", "level", "parent_idx", "title", "file_ref", "page_id") == [
        (1, 0, None, "序", "XML/a.xml", "p1"), (2, 1, 1, "一", "XML/a.xml", ""), (3, 0, None, "二", "", ""),
    ]
    assert rows(navigation.read_juan_index(e), "sutra_id", "juan", "file_ref", "page_id") == [
        ("T0001", 1, "XML/a.xml#b", "c"), ("T0001", 2, "XML/b.xml", ""),
    ]


def test_mulu(spark):
    js = 'var mulu_txt = `{"T01n0001.xml":[["0001a01","序"],["0001b11","1 大本"]],"T01n0002_003.xml":[["x","y"]]}`;\nvar j = 1;'
    df = spark.createDataFrame([("d/T01_mulu.js", js), ("d/other.js", js)], "path string, value string")
    assert rows(navigation.read_mulu(df), "canon", "volume", "sutra_id", "juan", "seq", "line_id", "title") == rows(
        spark.createDataFrame(
            [("T", "01", "T0001", None, 1, "0001a01", "序"), ("T", "01", "T0001", None, 2, "0001b11", "1 大本"), ("T", "01", "T0002", 3, 1, "x", "y")],
            "a string, b string, c string, d int, e int, f string, g string",
        )
    )


def test_catalog_files(spark, tmp_path):
    p = put(tmp_path / "catalog.txt", "T , 阿含 , x , 01 , 0001 , 22 , 長阿含經 , 佛陀耶舍\nT , 般若 , x , 08 , 0251 , 1 , 心經\nbad , line\n")
    assert rows(catalogs.read_catalog_txt(spark, p), "sutra_id", "category", "author") == [("T0001", "阿含", "佛陀耶舍"), ("T0251", "般若", "")]
    p = put(tmp_path / "bookdata.txt", "T, a, b, 大正藏\nX, a, b, 卍續藏\n", "utf-16")
    assert rows(catalogs.read_bookdata(spark, p)) == [("T", "大正藏"), ("X", "卍續藏")]
    p = put(tmp_path / "canons.json", json.dumps({"T": {"title-zh": "大正藏", "title-en": "T."}}))
    assert rows(catalogs.read_canons(spark, p)) == [("T", "大正藏", "T.")]
    p = put(tmp_path / "glyphs.json", json.dumps({"CB1": {"composition": "[a]", "uni_char": "b"}}))
    assert rows(catalogs.read_gaiji(spark, p), "cb_id", "uni_char", "composition") == [("CB1", "b", "[a]")]


def test_dictionaries(spark, tmp_path):
    d = tmp_path / "d"
    p = put(d / "a.json", json.dumps({"meta": {"id": "a", "entry_count": 2}, "entries": [{"term": "x", "definition": "y"}]}))
    assert rows(lexicons.read_dictionary(spark, p), "dict_id", "meta_count", "term") == [("a", 2, "x")]
    u = tmp_path / "u"
    put(u / "o.json", json.dumps({"般若": ["a", "b"], "經": "c", " ": "z"}))
    put(u / "l.json", json.dumps([{"word": "w", "meaning": "m"}, {"title": "n", "heteronyms": [{"pinyin": "p", "definitions": [{"def": "d"}]}]}, 3]))
    assert rows(lexicons.read_user_json(spark, str(u)), "dict_id", "term", "definition") == [
        ("user.json.l", "n", "【p】\n❶ d"), ("user.json.l", "w", "m"), ("user.json.o", "經", "c"), ("user.json.o", "般若", "a"),
        ("user.json.o", "般若", "b"),
    ]
    p = put(tmp_path / "c.csv", "Term,x,word,Meaning\na,1,b,m\n,2,,n\n")
    assert rows(lexicons.read_user_csv(spark, p), "dict_id", "term", "definition") == [("user.csv.c", "b", "m")]


def test_user_dictionary_layouts(spark, tmp_path):
    u = tmp_path / "u"
    put(u / "a.json", json.dumps([
        {"entry": 5, "value": True}, {"term": None, "key": "k", "meaning": None, "content": "c"}, {"term": "", "word": "w", "def": "x"}, {"word": "e", "heteronyms": [], "def": "f"}, "s", {"def": "no term"},
    ]))
    put(u / "o.json", json.dumps({"n": 7, "x": None, "l": ["p", 2, None], "m": {"q": 1}}))
    put(u / "bad.json", "[1,")
    put(u / "text.json", '"only a string"')
    assert rows(lexicons.read_user_json(spark, str(u)), "dict_id", "term", "definition") == [
        ("user.json.a", "5", "true"), ("user.json.a", "e", "f"), ("user.json.a", "k", "c"),
        ("user.json.o", "l", "2"), ("user.json.o", "l", "p"), ("user.json.o", "m", '{"q":1}'), ("user.json.o", "n", "7"),
    ]
    assert rows(lexicons.broken_user_json(spark, str(u)), "dict_id") == [("user.json.bad",), ("user.json.text",)]
    v = tmp_path / "v"
    put(v / "one.csv", 'word,id,Term ,meaning,def\nw,1,t,m,"d, ""e""\nf"\n')
    put(v / "two.csv", "value,key\nonly\nx,y\n")
    put(v / "none.csv", "a,b\n1,2\n")
    put(v / "empty.csv", "")
    assert rows(lexicons.read_user_csv(spark, str(v)), "dict_id", "term", "definition") == [("user.csv.one", "t", 'd, "e"\nf'), ("user.csv.two", "y", "x")]


LOG = (
    "### \U0001f552 10:05 | T0235 金剛經 · 卷1\n\n> q1\n> q2\n\n\U0001f4dd **感悟**：好\n\n---\n"
    "### \U0001f552 11:00 | T0001 長經 · 卷2\n\n\U0001f4dd **感悟**：二\n\n---\n\n---\n"
)


def test_note_logs(spark):
    n = documents.parse_notes_log(spark.createDataFrame([("2024-01-02.md", LOG)], "path string, value string"))
    assert rows(n, "time", "sutra_title", "quote", "content") == [
        ("10:05", "T0235 金剛經 · 卷1", "q1\nq2", "好"), ("11:00", "T0001 長經 · 卷2", "", "二"),
    ]
    named, missing = notes_for(spark.createDataFrame([("T0235",), ("X1",)], "sutra_id string"), n)
    assert rows(named, "sutra_id", "content") == [("T0235", "好")] and rows(missing) == [("X1",)]


def test_markdown_and_outline(spark):
    md = "---\ntitle: '經'\nauthor: 某\n---\nbody"
    r = documents.read_markdown(spark.createDataFrame([(md,), ("plain",)], "value string")).collect()
    assert (r[0].title, r[0].author, r[1].title) == ("經", "某", None)
    book = "\U0001f4d6"
    text = (
        f"## x\n- `T0 ` no\n  - {book} 甲\n    - `T1` 一\n    - **子**\n      - `T2` 二\n  - {book} 乙\n\t- `T3` 三\n"
        f"- other\n    - `T4` 四\n  - {book} 丙\n    - {book} 丁\n      - `T5` 五\n    - `T6` 六\n"
    )
    o = documents.read_outline(spark.createDataFrame([("d", text)], "doc_path string, value string"))
    got = [(r.sutra_id, r.group_title[-1]) for r in o.orderBy("line_no").collect()]
    assert got == [("T1", "甲"), ("T2", "甲"), ("T3", "乙"), ("T5", "丁"), ("T6", "丙")]


def test_verse_csv_and_exports(spark, tmp_path):
    p = put(tmp_path / "v.csv", "verse,source\na|b,S\nc\n")
    assert rows(documents.read_verse_csv(spark, p)) == [("a|b", "S"), ("c", "")]
    df = spark.createDataFrame([("T1", "甲")], "sutra_id string, title string")
    T.export_csv(df, str(tmp_path / "out"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out"))) == [("T1", "甲")]
    T.export_map_json(df, str(tmp_path / "js"))
    assert rows(spark.read.json(str(tmp_path / "js")), "sutra_id") == [("T1",)]


def test_indexes(spark):
    cat = spark.createDataFrame([("T1", "T", "01", "甲"), ("T2", "T", "01", "乙"), ("X1", "X", "02", "丙")], "sutra_id string, canon string, volume string, title string")
    bulei = spark.createDataFrame([("T1", "部")], "sutra_id string, bu_lei string")
    canons = spark.createDataFrame([("T", "大正")], "canon string, title_zh string")
    pages = R.build_indexes(R.work_category(cat, bulei, canons))
    assert rows(pages, "kind", "page", "n_works") == [
        ("canon", "T/01", 2), ("canon", "X/02", 1), ("category", "X", 1), ("category", "大正", 1), ("category", "部", 1),
    ]


def test_quality(spark, tmp_path):
    a = spark.createDataFrame([(1, "甲乙。丙丁。甲乙。"), (2, "同"), (3, ""), (4, "獨")], "k int, a string")
    b = spark.createDataFrame([(1, "甲乙。戊丁。"), (2, "同，"), (3, None), (5, "x")], "k int, b string")
    c = Q.compare_texts(a, b, ["k"], "a", "b")
    assert rows(c, "k", "ratio", "left_len", "right_len", "band") == [(1, 0.4, 6, 4, "differs"), (2, 1.0, 1, 1, "match"), (3, 1.0, 0, 0, "match")]
    assert [(d.op, d.times, d.text) for d in c.filter("k = 1").first().diffs] == [("removed", 1, "甲乙"), ("added", 1, "戊丁"), ("removed", 1, "丙丁")]
    t = spark.createDataFrame([(1, "文＝辯【宋】文"), (2, "x #CB12"), (3, "ok")], "i int, text string")
    assert rows(Q.detect_leaks(t), "i", "leak", "unresolved_glyph") == [(1, "校勘替换式", False), (2, None, True)]
    sup = spark.createDataFrame([(0x4E00, 0x9FFF), (32, 126)], "lo int, hi int")
    assert rows(Q.char_coverage(spark.createDataFrame([("甲é𥙡é",)], "text string"), sup), "ch", "n") == [("é", 2), ("𥙡", 1)]
    h = Q.length_histogram(spark.createDataFrame([(x,) for x in (4, 4, 5, 5, 5, 5, 7, 7, 7, 7)], "n int"), "n")
    assert rows(Q.positional_percentiles(h)) == [(5, 7, 7, 7, 7, 15)]
    h = Q.length_histogram(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "n int"), "n")
    assert Q.positional_percentiles(h).first().p50 == 3
    put(tmp_path / "a.png", bytes.fromhex("89504E470D0A1A0A00"))
    put(tmp_path / "x/b.png", b"")
    put(tmp_path / "x/c.png", b"GIF89a..")
    assert sorted(r.status for r in Q.audit_assets(corpus.scan_assets(spark, str(tmp_path))).collect()) == ["invalid", "valid", "zero_byte"]
    v = Q.validate_schema(spark, {"t": {"i", "text"}, "u": {"x"}, "h": {"n", "zz"}}, {"t": t, "h": h})
    assert rows(v) == [("h", "schema_invalid", "zz"), ("t", "ok", ""), ("u", "missing", "")]
    assert rows(Q.overall_health(v)) == [(2, "degraded")]
    drift = Q.schema_drift(spark.createDataFrame([("a",), ("b",)], "tag string"), spark.createDataFrame([("b",), ("c",)], "tag string"))
    assert rows(drift) == [("a", "documented"), ("c", "scanned")]
    assert t.agg(F.count("*")).first()[0] == 3


def stack_outline(text, marker=chr(0x1F4D6)):
    """(line number, heading's line, id) by one stack over the whole file."""
    out, stack = [], []
    for no, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        wide = line.replace("\t", "    ")
        indent = len(wide) - len(wide.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if marker in line:
            stack.append((indent, no))
        elif re.match(r"^\s*-\s+\*\*(.+?)\*\*\s*$", line):
            if stack:
                stack.append((indent, stack[-1][1]))
        elif (m := re.search(r"`([A-Za-z0-9]+)`\s+(.+)", line)) and stack:
            out.append((no, stack[-1][1], m.group(1)))
    return out


def test_long_outlines_in_ranges(spark):
    rnd, book, texts = random.Random(11), chr(0x1F4D6), {}
    for d in range(12):
        lines = []
        for k in range(120):
            lead = rnd.choice(["", " ", "  ", "\t", "      ", "\t  "])
            lines.append(lead + rnd.choice([f"- {book} g{k}", "- **b**", f"- `T{k}` t", f"- `T{k}` t", "- text", ""]))
        texts[f"d{d}"] = "\n".join(lines)
    df = spark.createDataFrame(list(texts.items()), "doc_path string, value string")
    for size in (3, 17, 10_000):
        got = documents.read_outline(df, lines=size)
        assert rows(got, "doc_path", "line_no", "group_no", "sutra_id") == sorted(((d, *x) for d, t in texts.items() for x in stack_outline(t)), key=repr), size


def test_written_files_are_scanned_by_folder(spark):
    root = scratch_path(spark, "written")
    names = ["A/A01/A01n0001.xml", "A/A02/A02n0002.xml", "B/B01/B01n0001.xml"]
    files = spark.createDataFrame([(n, f"<TEI>{n}é</TEI>") for n in names] + [("B/B01/B01n0002.xml", None)], "path string, content string")
    assert T.write_files(files, root) == 4
    assert T.write_files(files.limit(0), root) == 0
    assert T.write_files(files, root) == 4  # a second run leaves the same files
    found = corpus.scan_corpus(spark, root)
    assert sorted((r.canon, r.volume, r.work_no, bytes(r.content).decode()) for r in found.collect()) == [
        (n[0], n[3:5], n[-8:-4], f"<TEI>{n}é</TEI>") for n in names
    ]
    pruned = corpus.scan_corpus(spark, root, "A", "02")
    assert corpus.scan_corpus(spark, root, "A", "09").count() == corpus.scan_corpus(spark, root, "C").count() == 0
    assert [f.rsplit("/", 1)[1] for f in pruned.inputFiles()] == ["A02n0002.xml"]  # other folders are not even listed


def test_many_files_are_listed_and_read_by_few_tasks(spark, tmp_path):
    want = []
    for name in ("T00n0001.xml", "T/T00n0002.xml", *(f"T/T08/T08n{i:04}.xml" for i in range(150)), "T/T08/deep/T08n0999.xml", "X/X01/X01n 1#%.xml"):
        put(tmp_path / name, f"<TEI>{name}é</TEI>")
        want.append((f"file:{tmp_path}/{name}", f"<TEI>{name}é</TEI>"))
    for name in ("T/T08/.T08n0001.xml", "_X/X01/X01n0002.xml", "T/T08/T08n0001.txt"):
        put(tmp_path / name, "<TEI/>")
    put(tmp_path / "X/X01/X01n0003.xml", "")
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(str(tmp_path))
    found = corpus.scan_corpus(spark, str(tmp_path))
    assert sorted((r.doc_path, bytes(r.content).decode()) for r in found.collect()) == sorted(want)
    assert rows(found, "doc_path", "n_bytes") == rows(plain, "path", "length")
    assert rows(corpus.scan_corpus(spark, str(tmp_path), "T"), "work_no") == [(f"{i:04}",) for i in range(150)]
    assert corpus.scan_corpus(spark, str(tmp_path), "T", work="7").count() == 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.rdd.getNumPartitions() <= parts and plain.rdd.getNumPartitions() > parts


def test_layout_drift(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from scriptoria.sources.layouts import read_layouts

    root = scratch_path(spark, "layouts")
    wide = spark.range(3).selectExpr("id", "'x' AS text", "named_struct('a', 1, 'b', array(1.5D)) AS extra")
    wide.select("id", "text").coalesce(1).write.parquet(f"{root}/p=1")
    wide.coalesce(1).write.parquet(f"{root}/p=2")
    spark.range(2).selectExpr("cast(id AS int) id").coalesce(1).write.mode("append").parquet(f"{root}/p=2")
    spark.range(1).selectExpr("'no footer' AS value").coalesce(1).write.text(f"{root}/text")
    bad = spark.read.text(f"{root}/text").select(F.lit("p=3/bad.parquet").alias("path"), F.col("value").alias("content"))
    T.write_files(bad, root)
    expected = StructType([StructField("id", LongType()), StructField("text", StringType())])
    found = Q.layout_drift(read_layouts(spark, root), expected, root)
    got = sorted((r.folder, r.problem, r["column"] or "", r.expected, r.found if r.problem != "unreadable" else None, r.n_files, r.n_rows) for r in found.collect())
    assert got == [
        ("p=2", "extra", "extra", None, "struct<a:int,b:array<double>>", 1, 3),
        ("p=2", "missing", "text", "string", None, 1, 2),
        ("p=2", "type", "id", "bigint", "int", 1, 2),
        ("p=3", "unreadable", "", None, None, 1, 0),
    ]
    assert Q.layout_drift(read_layouts(spark, f"{root}/p=1"), expected, root).count() == 0


def test_sheets_are_read_as_wide_as_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"x\ny",word,meaning,more\n1,t,"m\n2",3\n5,u,v\n')
    (tmp_path / "b.csv").write_text("no,columns\n1,2\n")
    found = lexicons.read_user_csv(spark, str(tmp_path))
    assert rows(found, "dict_id", "term", "definition") == [("user.csv.a", "t", "m\n2"), ("user.csv.a", "u", "v")]
    assert not re.search(r"\bc3#", found._jdf.queryExecution().sparkPlan().toString())


def test_values_of_an_object_leave_their_file_alone(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a": "1", "b": ["x", 2, null], "c": {"k": "v"}, "d": null, "e": "[\\"s\\"]"}')
    got = rows(lexicons.read_user_json(spark, str(tmp_path)), "term", "definition")
    assert got == sorted([("a", "1"), ("b", "x"), ("b", "2"), ("c", '{"k":"v"}'), ("e", '["s"]')], key=repr)


def test_a_load_computes_its_tables_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    schema = "canon string, sutra_id string, text string"

    def load(texts):
        rows_ = [("T", f"T{k}", x) for k, x in enumerate(texts)]
        T.write_corpus({"content": spark.createDataFrame(rows_, schema).mapInArrow(count, schema)}, str(tmp_path / "c"))

    load("abc")
    assert computed.value == 3
    load("xy")
    assert computed.value == 5
    assert rows(T.read_table(spark, str(tmp_path / "c"), "content"), "sutra_id", "text") == [("T0", "x"), ("T1", "y"), ("T2", "c")]


def test_contents_are_counted_before_works_are_joined(spark):
    files = spark.createDataFrame([("f", '<x><body><milestone unit="juan" n="1"/><note>a</note><app/><app/></body></x>')], "doc_path string, content string")
    works = spark.createDataFrame([("f", "T1")], "doc_path string, sutra_id string")
    got = Q.raw_counts(files, works)
    assert rows(got, "sutra_id", "juans", "notes", "apps", "toc_entries") == [("T1", 1, 1, 2, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_extract(")  # below the join


def test_cuts_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "k", 2)], "`a.b` int, kind string, `c d` int")
    assert materialize(df).collect() == df.collect()
    kept = materialize(df.withColumnRenamed("a.b", "ab"), by="kind", buckets=(3, "ab"))
    assert kept.columns == ["ab", "kind", "c d"] and rows(kept) == [(1, "k", 2)]
