import random

from helpers import rows
from pyspark.sql import functions as F

from scriptoria.operators import firstwins as W
from scriptoria.operators import joins as J
from scriptoria.operators import relate as R
from scriptoria.operators import tree as T
from scriptoria.plans import registry

registry.load_all()
QUERIES = registry.QUERIES


def members(spark, *m):
    return spark.createDataFrame(list(m), "group_id int, sutra_id string, title string")


def test_classifiers(spark):
    t = spark.createDataFrame(
        [("大乘本生心地觀經淺註", ""), ("光讚經", ""), ("金剛經禮懺", ""), ("中論頌", ""), ("禮懺", "T0840"), ("某某文句後", "")],
        "t string, i string",
    )
    got = {r.t: r.c for r in t.select("t", R.classify_title("t", "i").alias("c")).collect()}
    assert got == {
        "大乘本生心地觀經淺註": "commentary", "光讚經": "original", "金剛經禮懺": "ignore", "中論頌": "original",
        "禮懺": "original", "某某文句後": "commentary",
    }
    s = spark.createDataFrame(
        [("心經疏", "X1"), ("大意經", "X2"), ("大意經", "T1510"), ("某論", "X3"), ("佛說經論", "T0005"), ("注語錄", "X4"), ("玄義", "X5")],
        "t string, i string",
    )
    got = [r.c for r in s.select(R.is_commentary("t", "i", True).alias("c")).collect()]
    assert got == [True, False, True, True, False, False, True]


def test_match_commentaries(spark):
    o = members(spark, (1, "a", "大乘本生心地觀經"), (1, "b", "放光般若經"), (1, "c", "光讚經"), (2, "d", "獨經"))
    c = members(spark, (1, "x", "大乘本生心地觀經淺註"), (1, "y", "放光般若經疏"), (1, "z", "無關記"), (2, "w", "無關記"))
    assert rows(R.match_commentaries(o, c), "sutra_id", "commentary_id", "score") == [("a", "x", 80), ("b", "y", 50), ("d", "w", 0)]


def brute_scores(os, cs):
    import re

    from scriptoria.functions.text import TITLE_PREFIXES, TITLE_SUFFIXES

    pre = re.compile("^(?:" + "|".join(TITLE_PREFIXES) + ")")
    suf = re.compile("(?:" + "|".join(TITLE_SUFFIXES) + ")$")
    core = lambda t: suf.sub("", pre.sub("", t)).strip()
    out = set()
    for c in cs:
        scored = []
        for o in os:
            cand = [0]
            if o in c:
                cand.append(10 * len(o))
            if len(core(o)) >= 2 and core(o) in c:
                cand.append(10 * len(core(o)))
            if len(core(c)) >= 2 and core(c) in o:
                cand.append(8 * len(core(c)))
            stem = o.replace("佛說", "")
            cand.append(max([n for n in range(3, min(len(stem), 12) + 1) if stem[:n] in c], default=0))
            scored.append((max(cand), o))
        top = max(s for s, _ in scored)
        out |= {(o, c, s) for s, o in scored if s == top and s > 0}
    return out


def test_title_matching_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda lo, hi: "".join(rnd.choice("佛說大乘經論心") for _ in range(rnd.randint(lo, hi)))
    os, cs = sorted({word(1, 6) for _ in range(25)}), sorted({word(2, 9) for _ in range(40)})
    o = members(spark, *[(1, f"o{i}", t) for i, t in enumerate(os)])
    c = members(spark, *[(1, f"c{i}", t) for i, t in enumerate(cs)])
    got = {tuple(r) for r in R.match_titles(o, c).select("o_title", "c_title", "score").collect()}
    assert got == brute_scores(os, cs)


def test_chains_and_merge(spark):
    m = members(
        spark, (1, "o", "金剛經"), (1, "a", "金剛經疏"), (1, "b", "金剛經疏記"), (1, "c", "大乘起信論疏"), (1, "d", "起信論疏鈔"),
        (2, "e", "無經注"),
    )
    got = R.extract_relations(m)
    assert rows(got, "sutra_id", "commentary_id", "rule") == [
        ("a", "b", 2), ("c", "d", 2), ("o", "a", 1), ("o", "b", 1), ("o", "c", 1), ("o", "d", 1),
    ]
    titles = spark.createDataFrame([("p", "佛說人經"), ("q", "人經註"), ("r", "甲")], "sutra_id string, title string")
    cites = spark.createDataFrame([("q", "p"), ("q", "q"), ("r", "p"), ("zz", "p")], "source_id string, target_id string")
    cf = R.citation_pairs(cites, titles)
    assert rows(cf, "sutra_id", "commentary_id") == [("p", "q")]
    merged = R.merge_relations(got, cf)
    nested = {r.sutra_id: [(c.id, c.match_type) for c in r.commentaries] for r in R.nest_pairs(merged).collect()}
    assert nested["o"] == [(x, "bulei_catalog") for x in "abcd"] and nested["p"] == [("q", "xml_cf_tag")]
    assert rows(R.fanout(merged)) == [(1, 3, False), (2, 2, False)]


def test_contains_join_counts_like_python(spark):
    rnd = random.Random(1)
    texts = {i: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 50))) for i in range(30)}
    names = ["aba", "aaa", "abab", "bbb", "aab"]
    t = spark.createDataFrame(list(texts.items()), "i int, t string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    want = sorted((i, x, s.count(x)) for i, s in texts.items() for x in names if x in s)
    assert rows(J.contains_join(t, n, "i", "t", "name"), "i", "name", "n") == sorted(want, key=repr)


def test_names_are_looked_up_where_a_text_is(spark, monkeypatch):
    texts = [(1, "x", "annanna 𝄞bel𝄞bel"), (2, "y", None), (3, "z", "bel"), (3, "z", "bella belly"), (None, "z", "bella")]
    names = ["anna", "nna", "bel", "bella", "𝄞bel", "be", "", None, "bella"]
    t = spark.createDataFrame(texts, "i int, k string, t string")
    n = spark.createDataFrame([(x, j) for j, x in enumerate(names)], "name string, j int")
    found = J.occurrences(t, n, ["i", "k"], "t", "name")
    want = [(i, k, p, x, j) for i, k, s in texts if s for j, x in enumerate(names) if x and len(x) > 2 for p in range(len(s)) if s.startswith(x, p)]
    assert rows(found) == sorted(want, key=repr)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a place
    counts = rows(J.contains_join(t, n, ["i", "k"], "t", "name"))
    assert rows(J.occurrences(t, n.limit(0), ["i", "k"], "t", "name")) == []
    monkeypatch.setattr(J, "fits_broadcast", lambda df: False)
    assert rows(J.occurrences(t, n, ["i", "k"], "t", "name")) == rows(found) and rows(J.contains_join(t, n, ["i", "k"], "t", "name")) == counts


def test_bounded_groups_splits_large_groups(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("m"))
    got = W.bounded_groups(df, ["k"], F.struct("m"), "m", "items", 30).collect()
    assert len(got) > 1 and sorted(x.m for r in got for x in r["items"]) == list(range(100))


def test_carry_forward_and_runs_in_chunks(spark):
    rnd = random.Random(2)
    data = [("k", i, rnd.choice([None, None, i]), rnd.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int, hit boolean")
    whole = rows(W.carry_forward(df, ["k"], "i", "v", "o"), "i", "o")
    assert whole == rows(W.carry_forward(df, ["k"], "i", "v", "o", chunk=7), "i", "o")
    one = rows(W.runs(df, ["k"], "i", F.col("hit")), "i", "run_start")
    assert one == rows(W.runs(df, ["k"], "i", F.col("hit"), chunk=7), "i", "run_start")
    start, want = None, []
    for _, i, _, hit in data:
        start = (i if start is None else start) if hit else None
        if hit:
            want.append((i, start))
    assert one == sorted(want, key=repr)


def test_dedupe_prefix_is_the_sequential_rule(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(120)]
    seen, want = set(), []
    for i, t in enumerate(texts):
        if any(len(t) >= n and t[:n] in seen for n in (6, 10, 14)):
            continue
        seen |= {t[:n] for n in (6, 10, 14) if len(t) >= n}
        want.append((i,))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows(W.dedupe_prefix(df, "t", 6, ["i"]), "i") == sorted(want, key=repr)


# -- trees -----------------------------------------------------------------------------------------

NODES = [
    (1, None, "甲部", None, 1), (2, 1, "一 ／ 疏", None, 2), (3, 2, "T0001 心經", "T0001", 3), (4, 2, "X0001 心經疏", "X0001", 4),
    (5, None, "乙部", None, 5), (6, 5, "T0001 心經", "T0001", 6), (7, 5, "小類", None, 7), (8, 7, "T0002 金經", "T0002", 8),
    (9, 5, "X0002 金經註", "X0002", 9),
]


def tree(spark):
    return T.expand_tree(spark.createDataFrame(NODES, "id bigint, parent_id bigint, title string, sutra_id string, sort_order bigint"))


def test_tree(spark):
    t = tree(spark)
    assert rows(t, "id", "depth", "root_id") == [
        (1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 0, 5), (6, 1, 5), (7, 1, 5), (8, 2, 5), (9, 1, 5),
    ]
    assert rows(T.derive_category(t)) == [("T0001", "甲部"), ("T0002", "乙部"), ("X0001", "甲部"), ("X0002", "乙部")]
    assert dict(rows(T.leaf_counts(t), "id", "n_leaves"))[5] == 3
    assert rows(T.slim_outline(t), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(T.outline_groups(t), "group_id", "sutra_id") == [(2, "T0001"), (2, "X0001")]
    assert rows(T.catalog_from_nav(t), "sutra_id", "title")[0] == ("T0001", "心經")
    keys = spark.createDataFrame([("T0001",), ("T0002",)], "sutra_id string")
    assert rows(T.sibling_commentaries(keys, t), "sutra_id", "group_title", "commentary_id") == [
        ("T0001", "一 ／ 疏", "X0001"), ("T0002", "乙部", "X0002"),
    ]
    stats = {(r.metric, r.key): r.value for r in T.tree_stats(t).collect()}
    assert stats[("leaves", "")] == 5 and stats[("duplicate_id", "T0001")] == 2 and stats[("max_depth", "")] == 2


def test_cycles_are_reported(spark):
    pairs = [(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 6), (8, 8), (9, 2)]
    df = spark.createDataFrame([(i, p, f"n{i}", None, i) for i, p in pairs], "id bigint, parent_id bigint, title string, sutra_id string, sort_order bigint")
    assert rows(T.expand_tree(df), "id", "depth", "root_id") == [(1, 0, 1), (2, 1, 1), *[(i, None, None) for i in range(3, 9)], (9, 2, 1)]


def test_deep_tree(spark):
    n = 700
    df = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", None, i) for i in range(n)], "id bigint, parent_id bigint, title string, sutra_id string, sort_order bigint")
    last = T.expand_tree(df).filter(f"id = {n - 1}").first()
    assert last.depth == n - 1 and [c.id for c in last.chain] == list(range(n - 1))


def test_volumes(spark):
    works = spark.createDataFrame([("T0220b", 0), ("T0001", 0), ("T0002a", 0), ("T0003", 5), ("X1", 0)], "sutra_id string, juan_count int")
    toc = spark.createDataFrame([("T0001", 22), ("T0002", 7)], "sutra_id string, n int")
    assert rows(T.volume_count(works, toc), "sutra_id", "total_juan") == [("T0001", 22), ("T0002a", 7), ("T0003", 5), ("T0220b", 200), ("X1", 1)]
    keys = spark.createDataFrame([("T0220b", 1), ("T0001", 2), ("T0002a", 1), ("T9", 1)], "sutra_id string, juan int")
    index = spark.createDataFrame([("T0001", 2, "a.xml"), ("T0220", 201, "gone.xml")], "sutra_id string, juan int, file_ref string")
    files = spark.createDataFrame([("T0001", 2, "b.xml"), ("T0001", 9, "a.xml"), ("T0220", 201, "c.xml"), ("T0002", 1, "d.xml")], "sutra_id string, juan int, path string")
    assert rows(T.resolve_volume(keys, index, files), "sutra_id", "path") == [("T0001", "a.xml"), ("T0002a", "d.xml"), ("T0220b", "c.xml"), ("T9", None)]


def test_numbers_of_works_are_not_cut(spark, tmp_path):
    part = [(k, "small gizmo", "LARGE") for k in (841, 1420, 10015, 15050, 169301, 2732001)]
    spark.createDataFrame([(*p, "B") for p in part], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.commentary for r in QUERIES["classify_title"](spark, str(tmp_path)).collect()}
    assert got == {841: False, 1420: False, 10015: True, 15050: True, 169301: True, 2732001: True}
