import difflib
import random

from helpers import rows
from pyspark.sql import functions as F

from scriptoria.operators import catalog as K
from scriptoria.operators import lexicon as L
from scriptoria.operators import neardup as N
from scriptoria.operators import verse as V
from scriptoria.operators.mentions import person_mentions, rank_mentions


def test_verse_scores(spark):
    cases = {
        "諸行無常 是生滅法 生滅滅已 寂滅為樂": 85, "諸法從緣生 諸法從緣滅 我佛大沙門 常作如是說": 80,
        "爾時世尊說 比丘當諦聽 甲乙丙丁 戊己庚辛": 45, "一二三 四五六七 一二三四 五六七": 50, "一二 三四": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.s for r in df.select("t", V.score_verse(V.verse_sentences("t")).alias("s")).collect()}
    assert got == cases
    fmt = spark.range(1).select(
        V.format_verse(F.array(*[F.lit(x) for x in "abcd"])).alias("e"), V.format_verse(F.array(*[F.lit(x) for x in "abc"])).alias("o")
    ).first()
    assert (fmt.e, fmt.o) == ("a，b。c，d。", "a，b，c。")


def test_mining(spark):
    md = "x\n> 諸行無常　是生滅法  \n> 生滅滅已　寂滅為樂\ny\n> 短\n> 諸行無常，是生滅法，生滅滅已，空空空空"
    df = spark.createDataFrame([(1, md, "經", "某譯"), (2, md, "論", "")], "doc_id int, value string, title string, author string")
    got = V.mine_verses(df)
    assert rows(got, "doc_id", "text", "source", "score") == [(1, "諸行無常，是生滅法。生滅滅已，寂滅為樂。", "《經》／某譯", 85)]
    known = spark.createDataFrame([("諸行「無常是生",)], "verse string")
    assert V.mine_verses(df, known).count() == 0


def test_doctrinal_selection(spark):
    data = [
        ("般若波羅蜜，照見五蘊空。", "《心經》／玄奘譯"), ("般若波羅蜜，照見五蘊空。", "某／民國"), ("短", "《心經》"),
        ("鐘聲過寺塔，鶴鷗帆潮渡。", "某寺志"), ("般若波羅蜜，照見五蘊空，別。", "《法華經》"), ("諸法因緣生，緣謝法還滅。", "《阿含》"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i int, text string, source string")
    j = V.judge_verses(df, spark.createDataFrame([("諸法因緣生，緣謝法還滅。",)], "verse string"))
    assert [r.reason for r in j.orderBy("i").collect()] == ["kept", "modern", "low", "low", "kept", "dup"]
    # bonus 30, length 12 -> 15, two five-character sentences -> 20, 般若 + 空 + 五蘊 -> 12, no admonition word
    assert j.filter("i = 0").first().score == 77
    assert rows(V.select_verses(j, "i"), "i") == [(0,), (4,)]
    assert rows(V.source_distribution(V.select_verses(j, "i"))) == [("心經", 1), ("法華經", 1)]


def test_sources_and_corrections(spark):
    df = spark.createDataFrame([(1, "心经／玄奘", "a|b"), (2, "某書", "c")], "id int, source string, verse string")
    al = spark.createDataFrame([("心经", "般若波羅蜜多心經")], "alias string, canonical string")
    assert rows(V.normalize_source(df, al), "id", "source_norm") == [(1, "《般若波羅蜜多心經》 ／ 玄奘"), (2, "某書")]
    fixes = spark.createDataFrame(
        [(1, "verse", "a ｜ b", "x", "n1"), (2, "verse", "zzz", "y", "n2"), (2, "source", "no", "甲", "n3")],
        "id int, field string, old string, new string, note string",
    )
    out, log = V.apply_corrections(df, fixes, "id")
    assert rows(out, "id", "verse", "source") == [(1, "x", "心经／玄奘"), (2, "c", "甲")]
    assert rows(log, "note") == [("n1",), ("n3",)]


def test_daily_verse(spark):
    v = spark.createDataFrame([(1, "builtin"), (2, "builtin"), (7, "custom")], "id int, type string")
    d = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-04",)], "date string").select(F.to_date("date").alias("date"))
    assert [r.id for r in V.daily_verse(v, d).orderBy("date").collect()] == [1, 7, 1]
    pin = spark.createDataFrame([(2, "builtin")], "id int, type string")
    assert rows(V.daily_verse(v, d, pin), "id", "pinned") == [(2, True)] * 3
    gone = spark.createDataFrame([(9, "builtin")], "id int, type string")
    assert rows(V.daily_verse(v, d, gone), "pinned") == [(False,)] * 3


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(rnd.randint(4, 24))) for _ in range(25)]
    texts = base + [b[: len(b) // 2] + rnd.choice("甲乙") + b[len(b) // 2 :] for b in base[:15]] + base[:3]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    reps = sorted(first.items(), key=lambda x: x[1])
    want = set()
    for k, (a, i) in enumerate(reps):
        for b, j in reps[k + 1 :]:
            r = difflib.SequenceMatcher(None, a, b).ratio()
            if r > 0.7:
                want.add((i, j, round(r, 9)))
    got = {(r.id_a, r.id_b, round(r.ratio, 9)) for r in N.near_duplicates(df, "i", "t").collect()}
    assert got == want and len(want) > 10


def test_mentions(spark):
    c = spark.createDataFrame([("T1", 1, "玄奘法師與玄奘法師弟子"), ("T1", 4, "玄奘法師")], "sutra_id string, juan int, plain_text string")
    p = spark.createDataFrame([("p1", "玄奘法師"), ("p2", "玄奘法師"), ("p3", "法師弟子"), ("p4", "善男子")], "person_id string, name string")
    assert rows(person_mentions(c, p), "person_id", "n") == [("p1", 3), ("p3", 1)]
    assert rows(person_mentions(c, p, volumes=3), "person_id", "n") == [("p1", 2), ("p3", 1)]
    auth = spark.createDataFrame([("T1", "p1")], "sutra_id string, person_id string")
    ranked = rank_mentions(person_mentions(c, p, auth))
    assert [(r.person_id, r.n) for r in ranked.orderBy("rank").collect()] == [("p2", 3), ("p3", 1)]


SENSE = "struct<def:string,quote:array<string>,example:array<string>>"


def test_senses(spark):
    het = f"array<struct<bopomofo:string,pinyin:string,definitions:array<{SENSE}>>>"
    df = spark.createDataFrame(
        [([("ㄅㄛ", "bō", [("", None, None), ("<i>智</i>", ["q"], ["e"])]), (None, "x", None)],), (None,)], f"h {het}"
    )
    got = [r.s for r in df.select(L.flatten_senses("h").alias("s")).collect()]
    assert got == ["【ㄅㄛ / bō】\n❷ 智\n　　\U0001f4d6 q\n　　例：e\n\n【x】", ""]


def test_lookup(spark):
    raw = spark.createDataFrame(
        [("d1", 0, "般若", "一"), ("d1", 1, "般若", "二"), ("d2", 0, "般若", "三"), ("d2", 1, "icon.png", "x"), ("d2", 2, "經", "四"), ("d2", 3, "別", "五")],
        "dict_id string, pos int, term string, definition string",
    )
    meta = spark.createDataFrame([("d1", "甲", "s", "tc", "l", 2), ("d2", "乙", "s", "tc", "l", 9)], "dict_id string, name string, source string, char_type string, license string, meta_count bigint")
    entries, dicts = L.build_dictionary(raw, meta, to_sc=[("經", "经")])
    assert rows(dicts, "dict_id", "entry_count") == [("d1", 2), ("d2", 3)]
    user = spark.createDataFrame([("u", "般若", 0, "a"), ("u", "般若", 1, "b")], "dict_id string, term string, pos int, definition string")
    q = spark.createDataFrame([("般若",), ("经",), ("無",)], "query string")
    got = L.lookup(q, entries, dicts, user)
    assert rows(got, "query", "dict_id", "definition") == [("经", "d2", "四"), ("般若", "d1", "一"), ("般若", "d2", "三"), ("般若", "u", "a")]
    assert L.lookup(q, entries, dicts, user, dedupe=False).count() == 6
    assert rows(L.dictionary_quality(raw, meta), "dict_id", "count_mismatch", "short_defs") == [("d1", False, 2), ("d2", True, 4)]
    need = spark.createDataFrame([("般若",), ("涅槃",)], "term string")
    assert rows(L.must_have_terms(raw, need)) == [("涅槃", 0, False), ("般若", 2, True)]
    defs = spark.createDataFrame([(1, "Dharma", "law of nature"), (2, "karma", "law")], "id int, term string, definition string")
    ask = spark.createDataFrame([("law NATURE",)], "query string")
    assert rows(L.search_definitions(defs, ask)) == [("law NATURE", 1)]


def test_catalog_overlay(spark):
    d = spark.createDataFrame([("T1", ["X"]), ("T2", ["Y"])], "k string, v array<string>")
    u = spark.createDataFrame([("T1", [])], "k string, v array<string>")
    ks = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "k string")
    assert rows(K.overlay(d, u, "k", ["v"], ks)) == [("T1", [], "user"), ("T2", ["Y"], "default"), ("T3", None, "none")]
    m = spark.range(1).select(K.merge_overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"))
    assert m.first().m == {"a": 1, "b": 3}
    content = spark.createDataFrame([("T1", 1, "ab"), ("T1", 2, "c"), ("T1", 2, "d")], "sutra_id string, juan int, plain_text string")
    cat = spark.createDataFrame([("T1", "A"), ("T2", None)], "sutra_id string, category string")
    stats = K.catalog_stats(cat, content)
    assert rows(stats, "sutra_id", "juan_count", "total_chars") == [("T1", 2, 4), ("T2", 0, None)]
    toc = spark.createDataFrame([("T1",), ("T1",)], "sutra_id string")
    bulei = spark.createDataFrame([("T2", "部")], "sutra_id string, bu_lei string")
    full = K.catalog_full(stats, toc, toc.limit(0), bulei)
    assert [r.sutra_id for r in K.order_catalog(full).collect()] == ["T1", "T2"]  # a blank category sorts as "zzz"
    assert rows(K.rollup_catalog(full), "level", "label", "works", "chars") == [
        ("bu_lei", "(未分類)", 1, 4), ("bu_lei", "部", 1, 0), ("category", "(未分類)", 1, 0), ("category", "A", 1, 4), ("total", "", 2, 4),
    ]
