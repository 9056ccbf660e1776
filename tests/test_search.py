import random

from helpers import rows
from pyspark.sql import functions as F

from scriptoria.operators import search as S


def queries(spark, *q):
    return spark.createDataFrame([(x,) for x in q], "query string")


def test_index_scan_and_brute_force_agree(spark):
    rnd = random.Random(3)
    texts = {i: "".join(rnd.choice("abcA ") for _ in range(rnd.randint(0, 60))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    qs = ["ab", "aba", "aaa", "c a", "zzz", "x%", '"a', "abca"]
    q = queries(spark, *qs)
    want = set()
    for query in qs:
        for i, t in texts.items():
            n = sum(t.lower().startswith(query, p) for p in range(len(t)))
            if n:
                want.add((query, i, n))
    scan = S.search_fulltext(docs, q, k=100)
    index = S.build_trigram_index(docs, "doc_id", "text")
    indexed = S.search_fulltext(docs, q, k=100, index=index)
    assert set(rows(scan, "query", "doc_id", "tf")) == want
    assert rows(scan) == rows(indexed)


def test_batches_of_any_size_take_one_path(spark):
    docs = spark.createDataFrame([(1, "banana bandana"), (2, "nothing")], "doc_id int, text string")
    q = ["ana", "an", "no"]
    small = rows(S.search_fulltext(docs, queries(spark, *q)))
    many = spark.createDataFrame([(x,) for x in q] + [(f"q{i}z",) for i in range(5000)], "query string")
    assert rows(S.search_fulltext(docs, many)) == small


def test_stored_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id int, text string")
    postings, stats = S.build_trigram_index(docs, "doc_id", "text")
    S.write_index(postings, str(tmp_path / "p"), "doc_id", buckets=4)
    stored = spark.read.parquet(str(tmp_path / "p"))
    got = S.search_fulltext(docs, queries(spark, "beta", "gam"), index=(stored, stats))
    assert rows(got, "query", "doc_id") == [("beta", 1), ("beta", 2), ("gam", 2)]


def test_snippet(spark):
    df = spark.createDataFrame([("0123456789abcdefghij",)], "t string")
    r = df.select(S.snippet("t", F.lit("abc"), 9).alias("s"), S.snippet("t", F.lit("01"), 30).alias("u")).first()
    assert (r.s, r.u) == ("…789<mark>abc</mark>def…", "<mark>01</mark>23456789abcdefghij")


def catalog(spark):
    return spark.createDataFrame(
        [("T0251", "心經", "心经", "玄奘", 1, 0), ("T0252", "大心經", "大心经", "", 1, 1), ("X0001", "論", "论", "a", 2, 2)],
        "sutra_id string, title string, title_sc string, author string, total_juan int, pos int",
    )


PAIRS = [("經", "经"), ("論", "论")]


def test_titles(spark):
    got = S.search_titles(queries(spark, "心經", "t02"), catalog(spark), pairs=PAIRS)
    assert rows(got, "query", "rank", "sutra_id") == [("t02", 1, "T0251"), ("t02", 2, "T0252"), ("心經", 1, "T0251"), ("心經", 2, "T0252")]
    assert rows(S.scan_titles(queries(spark, "论"), catalog(spark), pairs=PAIRS), "sutra_id") == [("X0001",)]
    assert rows(S.search_works(queries(spark, "x0"), catalog(spark)), "sutra_id", "total_juan") == [("X0001", 2)]


def test_title_batches_of_any_size_take_one_path(spark):
    q = ["心經", "t02", "論", "x", ""]
    want = rows(S.search_titles(queries(spark, *q), catalog(spark), pairs=PAIRS))
    assert len(want) == 2 + 2 + 1 + 1 + 3
    many = queries(spark, *q, *[f"none{i}" for i in range(5000)])
    assert rows(S.search_titles(many, catalog(spark), pairs=PAIRS)) == want


def test_unified_search(spark):
    content = spark.createDataFrame([("T0251", 1, "观自在<菩萨>"), ("X0001", 2, "自在")], "sutra_id string, juan int, plain_text_sc string")
    both = S.search(queries(spark, "自在", "心經", "自"), catalog(spark), content, lang="sc", to_sc=PAIRS)
    full = both.filter("section = 'fulltext'")
    assert rows(full, "query", "sutra_id", "juan", "snippet") == [
        ("自在", "T0251", 1, "观<mark>自在</mark>&lt;菩萨&gt;"), ("自在", "X0001", 2, "<mark>自在</mark>"),
    ]
    assert rows(both.filter("section = 'title'"), "query", "title") == [("心經", "大心经"), ("心經", "心经")]
    assert rows(S.search(queries(spark, "心經"), catalog(spark), to_sc=PAIRS), "sutra_id") == [("T0251",), ("T0252",)]


def test_persons(spark):
    p = spark.createDataFrame(
        [("1", "玄奘", "", None, 602), ("2", "玄奘子", "", None, None), ("3", "甲", "玄奘師", None, 1), ("4", "乙", "", "玄奘寺", 5)],
        "person_id string, name string, aliases string, place_origin string, birth_year int",
    )
    got = S.search_persons(queries(spark, "玄奘"), p)
    assert [r.person_id for r in got.orderBy("rank").collect()] == ["1", "2", "4", "3"]


def test_places_of_texts_meet_a_small_batch_where_they_are(spark):
    """The texts' places, many times the texts, are never the broadcast side; every length of query and a repeat count once."""
    titles = ["abcabcab", "xxabc", "b", "", None, "zzzzzz", "ABCabc"]
    cat = spark.createDataFrame([(f"T{i}", t, t, i, i) for i, t in enumerate(titles)], "sutra_id string, title string, title_sc string, total_juan int, pos int")
    qs = ["a", "ab", "abc", "abca", "zz", "t1", "", "q"]
    found = S.search_works(spark.createDataFrame([(q,) for q in qs], "query string"), cat)
    want = {(q, f"T{i}") for q in qs for i, t in enumerate(titles) if q.upper() in f"T{i}" or q in (t or "").lower()}
    got = [(r.query, r.sutra_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "anchor" in x]
    assert joins and all("BroadcastHashJoin" in x and "BuildRight" in x for x in joins)


def test_marks_fold_the_case_of_every_letter(spark):
    docs = spark.createDataFrame([(1, "x ÉENAÏ y"), (2, "x éenaï y")], "doc_id int, text string")
    found = S.search_fulltext(docs, queries(spark, "éenaï"))
    assert sorted(r.snippet for r in found.collect()) == ["x <mark>ÉENAÏ</mark> y", "x <mark>éenaï</mark> y"]


def test_rows_of_a_document_meet_and_its_trigrams_are_not_shuffled(spark):
    texts = [(1, "Abab𝄞𝄞𝄞"), (None, "aaaa"), (2, None), (1, "abab"), (3, "ab"), (None, "\0aaa\0"), (4, "x" * 9)]
    want = {}
    for d, t in texts:
        for i in range(len(t or "") - 2):
            key = (t[i : i + 3].lower(), d)
            want[key] = want.get(key, 0) + 1
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    postings, _ = S.build_trigram_index(docs, "doc_id", "text")
    assert rows(postings, "term", "doc_id", "tf") == sorted(((*k, n) for k, n in want.items()), key=repr)
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan  # no row a place, and none is grouped by its trigram
