import random
from collections import deque

from helpers import rows
from pyspark.sql import functions as F

from scriptoria.operators import chrono as C
from scriptoria.operators import graph as G
from scriptoria.operators import joins as J


def persons(spark, ids):
    return spark.createDataFrame(
        [(i, f"name {i}", None, None, n, None) for n, i in enumerate(ids)],
        "person_id string, name string, dynasty string, sect string, birth_year int, death_year int",
    )


def edges(spark, pairs, kind="teacher"):
    return spark.createDataFrame([(a, b, kind, f"{a}{b}") for a, b in pairs], "source_id string, target_id string, edge_type string, description string")


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "person_id string")


def test_ego_network_fixture(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "A"), ("C", "missing")])
    nodes, es = G.ego_network(keys(spark, "A"), e, persons(spark, "ABCD"), 3)
    assert rows(nodes, "person_id", "level", "student_count") == [("A", 0, 2), ("B", 1, 1), ("C", 1, 2), ("D", -1, 1)]
    assert rows(es, "source_id", "target_id", "dangling") == [
        ("A", "B", False), ("A", "C", False), ("B", "C", False), ("C", "D", False), ("C", "missing", True), ("D", "A", False),
    ]
    kept, kept_edges = G.prune_graph(nodes, es, 2)
    assert rows(kept, "person_id") == [("A",), ("D",)] and rows(kept_edges, "source_id", "target_id") == [("D", "A")]
    assert rows(G.graph_layers(nodes, es), "node", "layer") == [("A", 0), ("B", 1), ("C", 1), ("D", -1)]


def test_ego_network_is_breadth_first(spark):
    rnd = random.Random(8)
    ids = [f"n{i}" for i in range(25)]
    pairs = sorted({(rnd.choice(ids), rnd.choice(ids)) for _ in range(45)})
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()
    for ego in ids:
        dist, todo = {ego: 0}, deque([ego])
        while todo:
            x = todo.popleft()
            if dist[x] < 3:
                for y in out.get(x, ()):
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        todo.append(y)
        want |= {(ego, n, d) for n, d in dist.items()}
    egos = keys(spark, *ids)
    steps = spark.createDataFrame(pairs, "_from string, _to string")
    assert {tuple(r) for r in G._bfs(egos, steps, 3).select("ego", "node", "level").collect()} == want


def test_profile(spark):
    p = persons(spark, "ABCD")
    e = edges(spark, [("A", "B"), ("B", "C")]).unionByName(edges(spark, [("B", "D"), ("B", "B")], "social"))
    works = spark.createDataFrame([("B", "T1", "authored"), ("C", "T1", "x")], "person_id string, scripture_id string, relation string")
    got = rows(G.person_profile(keys(spark, "B"), p, e, works), "section", "other_id")
    assert got == [("scripture", "T1"), ("social", "B"), ("social", "D"), ("student", "C"), ("teacher", "A")]
    ws = spark.createDataFrame([("T1",)], "sutra_id string")
    assert rows(G.persons_of_work(ws, works, p), "section", "person_id") == [("authored", "B"), ("mentioned", "C")]


def test_places(spark):
    p = persons(spark, "AB").withColumn("place_origin", F.when(F.col("person_id") == "A", "長安\nPL001\n PL002 "))
    pl = spark.createDataFrame(
        [("PL001", None, 34.0, 108.0, "d", "寺廟;x"), ("PL002", "乙", None, None, "d", "山峰"), ("PL003", "丙", 30.0, 100.0, "d", "山峰")],
        "place_id string, name_zh string, latitude double, longitude double, district string, category string",
    )
    assert rows(G.explode_places(p), "place_name", "place_id") == [("長安", "PL001"), ("長安", "PL002")]
    assert rows(G.map_layers(p, pl), "layer", "place_id", "name", "n_persons") == [
        ("mountain", "PL003", "丙", None), ("origin", "PL001", "長安", 1), ("temple", "PL001", None, None),
    ]
    assert rows(G.person_places(keys(spark, "A"), p, pl), "place_id") == [("PL001",), ("PL002",)]
    assert rows(G.bin_places(pl, 2), "n_places") == [(2,)]
    assert rows(G.origin_persons(p, pl), "place_id", "part") == [("PL001", 0)]


def test_chronicle_fixture(spark):
    dyn = spark.createDataFrame([("d1", "唐", "chinese"), ("d2", "奈良", "japanese")], "dynasty_id string, name_zh string, type string")
    eras = spark.createDataFrame([("e1", "d1", "甲", 618, 626), ("e2", "d1", "乙", 630, 649), ("e3", "d2", "丙", 700, 710)], "era_id string, dynasty_id string, name_zh string, start_year int, end_year int")
    periods = C.build_periods(eras, dyn)
    assert rows(periods.filter("dynasty = '唐'"), "label", "start", "end") == [("627–629", 627, 629), ("乙", 630, 649), ("甲", 618, 626)]
    people = spark.createDataFrame(
        [("a", 618, None, None), ("b", None, 650, None), ("c", 628, None, None), ("d", 700, None, None), ("e", None, None, "劉宋"), ("f", None, None, "某"), ("g", None, None, None)],
        "person_id string, birth_year int, death_year int, dynasty string",
    )
    placed = C.place_persons(people, periods)
    assert rows(placed, "person_id", "p_period_id") == [
        ("a", "隋"), ("b", "唐_甲"), ("c", "唐_627–629"), ("d", None), ("e", "南北朝_待考"), ("f", "待考"), ("g", "待考"),
    ]
    assert rows(C.chronicle(people, periods).filter("person_id = 'e'"), "p_start", "p_end") == [(589, 589)]
    assert (None, None, None, 1) in rows(C.period_counts(placed), "p_dynasty_order", "p_start", "p_period_id", "person_count")


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(6)
    periods = sorted((rnd.randint(-50, 50), rnd.randint(0, 30), f"p{i}") for i in range(15))
    periods = [(s, s + n, i) for s, n, i in periods]
    pts = [(k, rnd.randint(-60, 90)) for k in range(150)]
    want = sorted(((k, min(((s, i) for s, e, i in periods if s <= v <= e), default=(0, None))[1]) for k, v in pts), key=repr)
    got = J.assign_interval(
        spark.createDataFrame(pts, "k int, v int"), spark.createDataFrame(periods, "s int, e int, period_id string"), "v", "s", "e", ["period_id"]
    )
    assert rows(got, "k", "period_id") == want
