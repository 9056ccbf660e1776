"""Queries: category trees, teacher graph, places and the chronicle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chrono as C
from ..operators import graph as G
from ..operators import tree as H
from ..operators.joins import assign_interval
from .registry import Tables, query

# -- trees: region > nation > customer ---------------------------------------------------------------

_SEGMENT_TITLES = {"BUILDING": "疏", "MACHINERY": "經", "AUTOMOBILE": "玄義", "HOUSEHOLD": "論", "FURNITURE": "語錄疏"}
_CASE_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENT_TITLES.items())
_SQL_NODES = f"""
nodes AS (
  SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, '註 ' || r_name AS title, NULL::VARCHAR AS sutra_id, r_regionkey::BIGINT AS sort_order FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name || CASE WHEN n_nationkey < 12 THEN ' ／ 疏' ELSE '' END, NULL::VARCHAR, 100 + n_nationkey FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'X' || lpad(c_custkey::VARCHAR, 7, '0') || ' 題' || CASE c_mktsegment {_CASE_TITLES} END,
    'X' || lpad(c_custkey::VARCHAR, 7, '0'), 1000 + c_custkey FROM customer)
"""
_SQL_TREE = f"""
{_SQL_NODES},
tree AS (
  SELECT n.*, 0 AS depth, []::BIGINT[] AS anc, id AS root_id, title AS root_title FROM nodes n WHERE parent_id IS NULL
  UNION ALL
  SELECT n.*, t.depth + 1, list_append(t.anc, t.id), t.root_id, t.root_title FROM nodes n JOIN tree t ON n.parent_id = t.id)
"""


def tree_nodes(t: Tables) -> DataFrame:
    cols = ["id", "parent_id", "title", "sutra_id", "sort_order"]
    none = F.lit(None).cast("string")
    r = t.region.select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("parent_id"),
        F.concat(F.lit("註 "), "r_name").alias("title"), none.alias("sutra_id"), F.col("r_regionkey").cast("bigint").alias("sort_order"),
    )
    nid = (F.col("n_nationkey") + 100).cast("bigint")
    mark = F.when(F.col("n_nationkey") < 12, " ／ 疏").otherwise("")
    n = t.nation.select(
        nid.alias("id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.concat("n_name", mark).alias("title"),
        none.alias("sutra_id"), nid.alias("sort_order"),
    )
    cid, sid = F.col("c_custkey") + 1000, F.concat(F.lit("X"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    kind = F.create_map(*[F.lit(x) for kv in _SEGMENT_TITLES.items() for x in kv])[F.col("c_mktsegment")]
    c = t.customer.select(
        cid.alias("id"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"),
        F.concat(sid, F.lit(" 題"), kind).alias("title"), sid.alias("sutra_id"), cid.alias("sort_order"),
    )
    return r.select(cols).unionByName(n).unionByName(c)


@query("expand_tree", f"WITH RECURSIVE {_SQL_TREE} SELECT id, depth, root_id, array_to_string(anc, '/') AS path FROM tree")
def expand_tree(t: Tables) -> DataFrame:
    path = F.array_join(F.transform("chain", lambda c: c["id"].cast("string")), "/")
    return H.expand_tree(tree_nodes(t)).select("id", "depth", "root_id", path.alias("path"))


@query("derive_category", f"WITH RECURSIVE {_SQL_TREE} SELECT sutra_id, root_title AS bu_lei FROM tree WHERE sutra_id IS NOT NULL")
def derive_category(t: Tables) -> DataFrame:
    return H.derive_category(H.expand_tree(tree_nodes(t)))


@query(
    "leaf_counts",
    f"""
    WITH RECURSIVE {_SQL_TREE}, l AS (SELECT unnest(list_append(anc, id)) AS id FROM tree WHERE sutra_id IS NOT NULL)
    SELECT t.id, title, count(l.id) AS n_leaves FROM tree t LEFT JOIN l ON t.id = l.id GROUP BY t.id, title
    """,
)
def leaf_counts(t: Tables) -> DataFrame:
    return H.leaf_counts(H.expand_tree(tree_nodes(t)))


@query(
    "slim_outline",
    f"""
    WITH RECURSIVE {_SQL_TREE}, m AS (SELECT id, anc FROM tree WHERE contains(title, '／')), up AS (SELECT DISTINCT unnest(anc) AS id FROM m)
    SELECT id, title FROM tree WHERE id IN (SELECT id FROM m) OR id IN (SELECT id FROM up)
      OR list_has_any(anc, (SELECT list(id) FROM m))
    """,
)
def slim_outline(t: Tables) -> DataFrame:
    return H.slim_outline(H.expand_tree(tree_nodes(t))).select("id", "title")


@query(
    "catalog_from_nav",
    f"WITH {_SQL_NODES} SELECT sutra_id, 'X' AS canon, regexp_replace(title, '^X[0-9]+ ', '') AS title FROM nodes WHERE sutra_id IS NOT NULL",
)
def catalog_from_nav(t: Tables) -> DataFrame:
    nodes = tree_nodes(t)
    return H.catalog_from_nav(nodes, nodes).select("sutra_id", "canon", "title")


@query(
    "sibling_groups",
    """
    WITH c AS (SELECT 'X' || lpad(c_custkey::VARCHAR, 7, '0') AS sutra_id, c_nationkey AS nation, n_regionkey AS region,
        c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AS always, c_mktsegment = 'HOUSEHOLD' AS loose, n_nationkey < 12 AS by_nation
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
    f AS (SELECT *, always OR (loose AND by_nation) AS in_nation, always OR loose AS in_region FROM c),
    n AS (SELECT nation, count(CASE WHEN in_nation THEN 1 END) AS k FROM f GROUP BY nation),
    r AS (SELECT region, count(CASE WHEN in_region THEN 1 END) AS k FROM f GROUP BY region),
    k AS (SELECT f.*, n.k - in_nation::INT AS nn, r.k - in_region::INT AS rr FROM f JOIN n USING (nation) JOIN r USING (region))
    SELECT sutra_id, CASE WHEN nn > 0 THEN 100 + nation ELSE region END AS folder_id, CASE WHEN nn > 0 THEN nn ELSE rr END AS n_commentaries FROM k
    """,
)
def sibling_groups(t: Tables) -> DataFrame:
    tree = H.expand_tree(tree_nodes(t))
    keys = tree.filter(F.col("sutra_id").isNotNull())
    return H.sibling_groups(keys, tree).select("sutra_id", "folder_id", "n_commentaries")


@query(
    "tree_stats",
    f"""
    WITH RECURSIVE {_SQL_TREE}
    SELECT 'nodes' AS metric, '' AS key, count(*) AS value FROM tree
    UNION ALL SELECT 'leaves', '', count(sutra_id) FROM tree UNION ALL SELECT 'categories', '', count(*) - count(sutra_id) FROM tree
    UNION ALL SELECT 'max_depth', '', max(depth) FROM tree UNION ALL SELECT 'malformed_ids', '', 0 UNION ALL SELECT 'categories_with_id', '', 0
    UNION ALL SELECT 'depth', depth::VARCHAR, count(*) FROM tree GROUP BY depth
    UNION ALL SELECT 'canon_leaves', 'X', count(sutra_id) FROM tree
    """,
)
def tree_stats(t: Tables) -> DataFrame:
    return H.tree_stats(H.expand_tree(tree_nodes(t)))


@query(
    "nav_quality",
    f"""
    WITH {_SQL_NODES}
    SELECT 'category' AS table_name, count(*) AS rows, count(*) - count(parent_id) AS roots, 0 AS untitled, count(sutra_id) AS with_id FROM nodes
    UNION ALL SELECT 'customers', count(*), NULL, NULL, NULL FROM customer
    """,
)
def nav_quality(t: Tables) -> DataFrame:
    return H.nav_quality(tree_nodes(t).withColumn("tree_type", F.lit("category")), customers=t.customer)


@query(
    "volume_count",
    """
    WITH w AS (SELECT 'T' || lpad(p_partkey::VARCHAR, 7, '0') || CASE WHEN p_size > 40 THEN 'a' ELSE '' END AS sutra_id,
        CASE WHEN p_size < 10 THEN p_size ELSE 0 END AS juan_count, 'T' || lpad(p_partkey::VARCHAR, 7, '0') AS base FROM part),
    toc AS (SELECT 'T' || lpad(l_partkey::VARCHAR, 7, '0') AS id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT sutra_id, CASE WHEN juan_count > 0 THEN juan_count ELSE coalesce(n, 1) END AS total_juan FROM w LEFT JOIN toc ON base = id
    """,
)
def volume_count(t: Tables) -> DataFrame:
    works = t.part.select(
        F.concat(F.lit("T"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.when(F.col("p_size") > 40, "a").otherwise("")).alias("sutra_id"),
        F.when(F.col("p_size") < 10, F.col("p_size")).otherwise(0).alias("juan_count"),
    )
    toc = t.lineitem.groupBy(F.concat(F.lit("T"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("sutra_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return H.volume_count(works, toc).select("sutra_id", "total_juan")


@query(
    "resolve_volume",
    """
    WITH k AS (SELECT DISTINCT l_orderkey AS w, l_linenumber AS v FROM lineitem),
    idx AS (SELECT l_orderkey AS w, l_linenumber AS v, min(l_partkey) AS part FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    fil AS (SELECT p_partkey AS part FROM part WHERE p_size > 10),
    nam AS (SELECT o_orderkey AS w, 1 AS v FROM orders WHERE o_orderstatus = 'F')
    SELECT k.w AS sutra_no, k.v AS juan, CASE WHEN fil.part IS NOT NULL THEN 'p' || fil.part WHEN nam.w IS NOT NULL THEN 'o' || nam.w END AS path
    FROM k LEFT JOIN idx ON k.w = idx.w AND k.v = idx.v LEFT JOIN fil ON idx.part = fil.part LEFT JOIN nam ON k.w = nam.w AND k.v = nam.v
    """,
)
def resolve_volume(t: Tables) -> DataFrame:
    sid = lambda c: F.concat(F.lit("T"), F.lpad(F.col(c).cast("string"), 9, "0")).alias("sutra_id")
    keys = t.lineitem.select(sid("l_orderkey"), F.col("l_linenumber").alias("juan"))
    index = t.lineitem.filter("l_returnflag = 'A'").groupBy(sid("l_orderkey"), F.col("l_linenumber").alias("juan")).agg(
        F.concat(F.lit("p"), F.min("l_partkey")).alias("file_ref")
    )
    listed = t.part.filter("p_size > 10").select(F.lit("-").alias("sutra_id"), F.lit(0).alias("juan"), F.concat(F.lit("p"), "p_partkey").alias("path"))
    named = t.orders.filter("o_orderstatus = 'F'").select(sid("o_orderkey"), F.lit(1).alias("juan"), F.concat(F.lit("o"), "o_orderkey").alias("path"))
    got = H.resolve_volume(keys, index, listed.unionByName(named))
    return got.select(F.substring("sutra_id", 2, 9).cast("bigint").alias("sutra_no"), "juan", "path")


# -- graph: parts as persons -------------------------------------------------------------------------

_SQL_EDGES = """
te AS (SELECT DISTINCT s, d FROM (SELECT p_partkey AS s, p_partkey // 2 AS d FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE s > 0),
se AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS d FROM lineitem)
"""


def graph_edges(t: Tables) -> DataFrame:
    p = t.part.filter("p_partkey > 0")
    targets = F.array_distinct(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)))
    none = F.lit(None).cast("string").alias("description")
    teach = p.select(F.col("p_partkey").alias("source_id"), F.explode(targets).alias("target_id"), F.lit("teacher").alias("edge_type"), none)
    social = t.lineitem.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).distinct()
    return teach.unionByName(social.select("source_id", "target_id", F.lit("social").alias("edge_type"), none))


def graph_persons(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("dynasty"),
        F.col("p_type").alias("sect"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("birth_year"),
        F.lit(None).cast("int").alias("death_year"),
    )


_SQL_EGO = f"""
{_SQL_EDGES},
down AS (SELECT p_partkey AS ego, p_partkey AS node, 0 AS lv FROM part UNION SELECT ego, d, lv + 1 FROM down JOIN te ON node = s WHERE lv < 2),
up AS (SELECT p_partkey AS ego, p_partkey AS node, 0 AS lv FROM part UNION ALL SELECT d, s, 1 FROM te),
dn AS (SELECT ego, node, min(lv) AS lv FROM down GROUP BY ALL), un AS (SELECT ego, node, min(lv) AS lv FROM up GROUP BY ALL),
nodes AS (SELECT ego, node, arg_min(lv, abs(lv) * 10 + CASE WHEN lv < 0 THEN 0 ELSE 1 END) AS level
          FROM (SELECT * FROM dn UNION ALL SELECT ego, node, -lv FROM un) GROUP BY ALL)
"""


@query(
    "ego_nodes",
    f"""
    WITH RECURSIVE {_SQL_EGO}, sc AS (SELECT s, count(*) AS c FROM te GROUP BY s)
    SELECT ego, node AS person_id, level, coalesce(c, 0) AS student_count FROM nodes LEFT JOIN sc ON node = s
    """,
)
def ego_nodes(t: Tables) -> DataFrame:
    p = graph_persons(t)
    nodes, _ = G.ego_network(p, graph_edges(t), p, 3)
    return nodes.select("ego", "person_id", "level", "student_count")


@query(
    "ego_edges",
    f"""
    WITH RECURSIVE {_SQL_EGO},
    e AS (SELECT DISTINCT ego, s, d FROM (SELECT ego, s, d FROM dn JOIN te ON node = s UNION ALL SELECT ego, s, d FROM un JOIN te ON node = d))
    SELECT e.ego, s AS source_id, d AS target_id, a.node IS NULL OR b.node IS NULL AS dangling
    FROM e LEFT JOIN nodes a ON a.ego = e.ego AND a.node = s LEFT JOIN nodes b ON b.ego = e.ego AND b.node = d
    """,
)
def ego_edges(t: Tables) -> DataFrame:
    p = graph_persons(t)
    _, edges = G.ego_network(p, graph_edges(t), p, 3)
    return edges.select("ego", "source_id", "target_id", "dangling")


@query(
    "prune_graph",
    f"""
    WITH RECURSIVE {_SQL_EGO}, r AS (SELECT *, row_number() OVER (PARTITION BY ego ORDER BY abs(level), level, node) AS rn FROM nodes),
    k AS (SELECT * FROM r WHERE rn <= 4),
    e AS (SELECT DISTINCT ego, s, d FROM (SELECT ego, s, d FROM dn JOIN te ON node = s UNION ALL SELECT ego, s, d FROM un JOIN te ON node = d))
    SELECT e.ego, s AS source_id, d AS target_id FROM e JOIN k a ON a.ego = e.ego AND a.node = s JOIN k b ON b.ego = e.ego AND b.node = d
    """,
)
def prune_graph(t: Tables) -> DataFrame:
    p = graph_persons(t)
    _, edges = G.prune_graph(*G.ego_network(p, graph_edges(t), p, 3), 4)
    return edges.select("ego", "source_id", "target_id")


@query(
    "graph_layers",
    f"""
    WITH RECURSIVE {_SQL_EGO},
    e AS (SELECT DISTINCT ego, s, d FROM (SELECT ego, s, d FROM dn JOIN te ON node = s UNION ALL SELECT ego, s, d FROM un JOIN te ON node = d)),
    ne AS (SELECT e.* FROM e JOIN nodes a ON a.ego = e.ego AND a.node = s JOIN nodes b ON b.ego = e.ego AND b.node = d),
    st AS (SELECT ego, s AS f, d AS t, 1 AS v FROM ne UNION SELECT ego, d, s, -1 FROM ne),
    l0 AS (SELECT ego, node, 0 AS layer FROM nodes WHERE node = ego),
    {", ".join(f"""w{k} AS (SELECT l.ego, t AS node, min(l.layer + v) AS layer FROM l{k - 1}_new l JOIN st ON st.ego = l.ego AND f = l.node WHERE abs(l.layer + v) <= 2 GROUP BY ALL),
    l{k}_new AS (SELECT w.* FROM w{k} w ANTI JOIN l{k - 1} l ON l.ego = w.ego AND l.node = w.node), l{k} AS (SELECT * FROM l{k - 1} UNION ALL SELECT * FROM l{k}_new)""" for k in range(1, 9)).replace("l0_new", "l0")}
    SELECT * FROM l8
    """,
)
def graph_layers(t: Tables) -> DataFrame:
    p = graph_persons(t)
    return G.graph_layers(*G.ego_network(p, graph_edges(t), p, 3))


@query(
    "person_profile",
    f"""
    WITH {_SQL_EDGES}, p AS (SELECT p_partkey AS id, p_name AS name FROM part),
    so AS (SELECT s AS a, d AS b FROM se UNION ALL SELECT d, s FROM se WHERE s <> d),
    sk AS (SELECT a, b FROM so JOIN p ON b = id JOIN part ON a = p_partkey),
    sc AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders JOIN part ON o_custkey = p_partkey),
    x AS (SELECT d AS a, s AS b, 'teacher' AS section FROM te UNION ALL SELECT s, d, 'student' FROM te
          UNION ALL SELECT a, b, 'social' FROM sk)
    SELECT a AS person_id, section, b AS other_id, name FROM x JOIN p ON b = id
    UNION ALL SELECT a, 'scripture', b, NULL FROM sc
    """,
)
def person_profile(t: Tables) -> DataFrame:
    p = graph_persons(t)
    works = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("scripture_id"), F.col("o_orderstatus").alias("relation"))
    return G.person_profile(p, p, graph_edges(t), works).select("person_id", "section", "other_id", "name")


@query(
    "persons_of_work",
    """
    SELECT o_orderkey AS sutra_id, CASE WHEN o_orderstatus = 'F' THEN 'authored' ELSE 'mentioned' END AS section, p_partkey AS person_id, p_name AS name
    FROM orders JOIN part ON o_custkey = p_partkey
    """,
)
def persons_of_work(t: Tables) -> DataFrame:
    rel = F.when(F.col("o_orderstatus") == "F", "authored").otherwise("cited")
    links = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("scripture_id"), rel.alias("relation"))
    keys = t.orders.select(F.col("o_orderkey").alias("sutra_id"))
    return G.persons_of_work(keys, links, graph_persons(t)).select("sutra_id", "section", "person_id", "name")


@query("student_counts", f"WITH {_SQL_EDGES} SELECT s AS person_id, count(*) AS student_count FROM te GROUP BY s")
def student_counts(t: Tables) -> DataFrame:
    return G.student_counts(graph_edges(t))


# -- places ------------------------------------------------------------------------------------------


def places(t: Tables) -> DataFrame:
    """Nations as places; every fifth-region place has no coordinates."""
    tag = F.when(F.col("n_regionkey") == 1, "寺廟;x").when(F.col("n_regionkey") == 2, "山峰").otherwise("縣")
    return t.nation.select(
        F.concat(F.lit("PL"), "n_nationkey").alias("place_id"), F.when(F.col("n_nationkey") > 3, F.col("n_name")).alias("name_zh"),
        F.when(F.col("n_regionkey") != 4, F.col("n_nationkey") * 2.5).alias("latitude"), (F.col("n_nationkey") * 7.0).alias("longitude"),
        F.col("n_regionkey").cast("string").alias("district"), tag.alias("category"),
    )


def placed_persons(t: Tables) -> DataFrame:
    origin = F.concat(F.lit("town "), F.col("c_mktsegment"), F.lit("\nPL"), F.col("c_nationkey"), F.lit("\n PL"), F.floor(F.col("c_nationkey") / 2), F.lit(" "))
    return t.customer.select(
        F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sect"),
        F.lit(None).cast("string").alias("dynasty"), F.when(F.col("c_acctbal") > 0, origin).alias("place_origin"),
    )


_SQL_PLACES = """
pl AS (SELECT 'PL' || n_nationkey AS place_id, CASE WHEN n_nationkey > 3 THEN n_name END AS name_zh,
        CASE WHEN n_regionkey <> 4 THEN n_nationkey * 2.5 END::DOUBLE AS latitude, n_nationkey * 7.0::DOUBLE AS longitude,
        n_regionkey::VARCHAR AS district, n_regionkey FROM nation),
who AS (SELECT c_custkey AS person_id, 'town ' || c_mktsegment AS place_name, unnest(['PL' || c_nationkey, 'PL' || (c_nationkey // 2)]) AS place_id
        FROM customer WHERE c_acctbal > 0)
"""


@query(
    "map_layers",
    f"""
    WITH {_SQL_PLACES}
    SELECT 'origin' AS layer, place_id, coalesce(name_zh, first_name) AS name, latitude, longitude, n_persons FROM pl JOIN
      (SELECT place_id, count(*) AS n_persons, arg_min(place_name, person_id) AS first_name FROM who GROUP BY place_id) USING (place_id)
      WHERE latitude IS NOT NULL
    UNION ALL SELECT CASE n_regionkey WHEN 1 THEN 'temple' ELSE 'mountain' END, place_id, name_zh, latitude, longitude, NULL
    FROM pl WHERE latitude IS NOT NULL AND n_regionkey IN (1, 2)
    """,
)
def map_layers(t: Tables) -> DataFrame:
    return G.map_layers(placed_persons(t), places(t)).select("layer", "place_id", "name", "latitude", "longitude", "n_persons")


@query("person_places", f"WITH {_SQL_PLACES} SELECT person_id, place_id, latitude FROM who JOIN pl USING (place_id)")
def person_places(t: Tables) -> DataFrame:
    p = placed_persons(t)
    return G.person_places(p, p, places(t)).select("person_id", "place_id", "latitude")


@query(
    "origin_persons",
    f"""
    WITH {_SQL_PLACES} SELECT place_id, count(*) AS n, min(person_id) AS first_person, max(person_id) AS last_person
    FROM who JOIN pl USING (place_id) WHERE latitude IS NOT NULL GROUP BY place_id
    """,
)
def origin_persons(t: Tables) -> DataFrame:
    parts = G.origin_persons(placed_persons(t), places(t), 50)
    return parts.groupBy("place_id").agg(
        F.sum(F.size("persons")).alias("n"), F.min(F.col("persons")[0]["person_id"]).alias("first_person"),
        F.max(F.try_element_at("persons", F.lit(-1))["person_id"]).alias("last_person"),
    )


@query(
    "graph_stats",
    f"""
    WITH {_SQL_EDGES} SELECT (SELECT count(*) FROM part) AS persons, (SELECT count(*) FROM te) AS edges,
      (SELECT count(*) FROM nation WHERE n_regionkey <> 4) AS places, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS scriptures
    """,
)
def graph_stats(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("scripture_id"))
    return G.graph_stats(graph_persons(t), graph_edges(t), places(t), links)


_SQL_TILE = """
loc AS (SELECT c_custkey, c_acctbal / 125 AS lat, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon FROM customer),
tile AS (SELECT *, greatest(0, least(63, floor((lon + 180.0) / 360.0 * 64)))::BIGINT AS x,
  greatest(0, least(63, floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 64)))::BIGINT AS y FROM loc)
"""


@query(
    "bin_places",
    f"""
    WITH {_SQL_TILE} SELECT x AS tile_x, y AS tile_y, count(*) AS n_places, round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude
    FROM tile GROUP BY ALL
    """,
)
def bin_places(t: Tables) -> DataFrame:
    lon = (F.col("c_custkey") * 7919 % 36000) / 100.0 - 180
    p = t.customer.select((F.col("c_acctbal") / 125).alias("latitude"), lon.alias("longitude"))
    return G.bin_places(p, 6).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(
    "tile_list",
    """
    WITH b AS (SELECT min(n_nationkey)::INT AS lo, max(n_nationkey)::INT AS hi, n_regionkey AS r FROM nation GROUP BY n_regionkey),
    z AS (SELECT *, unnest([2, 4]) AS zoom FROM b), n AS (SELECT *, pow(2, zoom)::INT AS n FROM z),
    e AS (SELECT zoom, n, floor((lo * 3.0 + 180) / 360 * n)::INT AS x0, floor((hi * 3.0 + 180) / 360 * n)::INT AS x1,
      floor((1 - ln(tan(radians(hi * 2.0)) + 1 / cos(radians(hi * 2.0))) / pi()) / 2 * n)::INT AS y0,
      floor((1 - ln(tan(radians(lo * 2.0)) + 1 / cos(radians(lo * 2.0))) / pi()) / 2 * n)::INT AS y1 FROM n),
    c AS (SELECT zoom, greatest(0, least(n - 1, x0)) AS x0, greatest(0, least(n - 1, x1)) AS x1,
      greatest(0, least(n - 1, y0)) AS y0, greatest(0, least(n - 1, y1)) AS y1 FROM e)
    SELECT DISTINCT zoom, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM c)
    """,
)
def tile_list(t: Tables) -> DataFrame:
    b = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"))
    boxes = b.select(
        (F.col("lo") * 2.0).alias("min_lat"), (F.col("lo") * 3.0).alias("min_lon"), (F.col("hi") * 2.0).alias("max_lat"),
        (F.col("hi") * 3.0).alias("max_lon"), F.explode(F.array(F.lit(2), F.lit(4))).alias("zoom"),
    )
    return T.tile_list(boxes)


# -- chronicle ---------------------------------------------------------------------------------------

_ERA_DYNASTIES = ["唐", "北宋", "南宋", "大明", "大清"]
_ERA_BASE = [600, 950, 1120, 1360, 1640]
_NAMES = ["唐", "劉宋", "金", "某", ""]
_SQL_LIST = "[" + ", ".join(f"'{x}'" for x in _ERA_DYNASTIES) + "]"
_SQL_PERIODS = f"""
dyn(o, dynasty, ds, de) AS (VALUES {", ".join(f"({i}, '{n}', {s}, {e})" for i, (n, s, e) in enumerate(C.DYNASTIES))}),
era AS (SELECT n_nationkey AS era_id, replace({_SQL_LIST}[n_regionkey + 1], '大', '') AS dynasty, n_name AS label,
          {_ERA_BASE}[n_regionkey + 1] + 13 * n_nationkey AS s, {_ERA_BASE}[n_regionkey + 1] + 13 * n_nationkey + n_nationkey % 9 * 8 AS e FROM nation),
lagged AS (SELECT *, lag(e) OVER (PARTITION BY dynasty ORDER BY s, era_id) AS pe FROM era),
eras AS (SELECT dynasty, label, s, e FROM era UNION ALL SELECT dynasty, (pe + 1) || '–' || (s - 1), pe + 1, s - 1 FROM lagged WHERE s - pe > 1),
periods AS (
  SELECT dynasty || '_' || label AS period_id, label, dynasty, o, greatest(s, ds) AS s, least(e, de) AS e, true AS is_sub FROM eras JOIN dyn USING (dynasty)
    WHERE greatest(s, ds) <= least(e, de)
  UNION ALL SELECT dynasty, dynasty, dynasty, o, ds, de, false FROM dyn WHERE dynasty NOT IN (SELECT dynasty FROM eras))
"""


def periods(t: Tables) -> DataFrame:
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), F.col(i))
    dynasties = t.region.select("r_regionkey", pick(_ERA_DYNASTIES, "r_regionkey").alias("name_zh"), F.lit("chinese").alias("type"))
    start = pick(_ERA_BASE, "n_regionkey") + 13 * F.col("n_nationkey")
    eras = t.nation.select(
        F.col("n_nationkey").alias("era_id"), F.col("n_regionkey").alias("dynasty_id"), F.col("n_name").alias("name_zh"),
        start.alias("start_year"), (start + F.col("n_nationkey") % 9 * 8).alias("end_year"),
    )
    return C.build_periods(eras, dynasties.withColumnRenamed("r_regionkey", "dynasty_id"))


def chronicle_persons(t: Tables) -> DataFrame:
    """Orders as persons: years from the price, some without birth, some without any year."""
    year = F.floor(F.col("o_totalprice") / 250).cast("int")
    names = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return t.orders.select(
        F.col("o_orderkey").alias("person_id"), F.when(F.col("o_orderstatus") == "O", year).alias("birth_year"),
        F.when(F.col("o_orderstatus") == "F", year + 30).alias("death_year"), F.nullif(names, F.lit("")).alias("dynasty"),
        F.col("o_orderpriority").alias("sect"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("is_monk"),
    )


_SQL_PLACED = f"""
{_SQL_PERIODS},
person AS (SELECT o_orderkey AS person_id, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 250)::INT END AS yr,
  ['唐', '南北朝', '南宋', '待考', '待考'][substring(o_orderpriority, 1, 1)::INT] AS d FROM orders),
claim AS (SELECT person_id, arg_min(struct_pack(period_id, o, s), struct_pack(s, o, period_id)) AS p FROM person JOIN periods ON yr BETWEEN s AND e GROUP BY person_id),
placed AS (
  SELECT person_id, p.period_id AS period_id, p.o AS o, p.s AS s, p IS NOT NULL AS placed FROM person LEFT JOIN claim USING (person_id) WHERE yr IS NOT NULL
  UNION ALL SELECT person_id, CASE WHEN d = '待考' THEN d ELSE d || '_待考' END, coalesce(o, 999), coalesce(de, 9999), true
    FROM person LEFT JOIN dyn ON d = dynasty WHERE yr IS NULL)
"""


@query("periods", f"WITH {_SQL_PERIODS} SELECT period_id, label, dynasty, s AS start_year, e AS end_year, is_sub FROM periods")
def period_table(t: Tables) -> DataFrame:
    return periods(t).select("period_id", "label", "dynasty", F.col("start").alias("start_year"), F.col("end").alias("end_year"), "is_sub")


@query("chronicle", f"WITH {_SQL_PLACED} SELECT person_id, period_id FROM placed WHERE placed")
def chronicle(t: Tables) -> DataFrame:
    return C.chronicle(chronicle_persons(t), periods(t)).select("person_id", F.col("p_period_id").alias("period_id"))


@query("period_counts", f"WITH {_SQL_PLACED} SELECT o AS dynasty_order, s AS start_year, period_id, count(*) AS person_count FROM placed GROUP BY ALL")
def period_counts(t: Tables) -> DataFrame:
    counts = C.period_counts(C.place_persons(chronicle_persons(t), periods(t)))
    return C.order_periods(counts).select(
        F.col("p_dynasty_order").alias("dynasty_order"), F.col("p_start").alias("start_year"), F.col("p_period_id").alias("period_id"), "person_count"
    )


@query(
    "assign_interval",
    """
    WITH p AS (SELECT s_suppkey AS period_id, floor(s_acctbal * 10)::INT AS s, floor(s_acctbal * 10)::INT + s_nationkey * 40 AS e FROM supplier),
    v AS (SELECT o_orderkey, floor(o_totalprice / 5)::INT AS v FROM orders)
    SELECT o_orderkey, arg_min(period_id, struct_pack(s, period_id)) AS period_id FROM v LEFT JOIN p ON v BETWEEN s AND e GROUP BY o_orderkey
    """,
)
def intervals(t: Tables) -> DataFrame:
    start = F.floor(F.col("s_acctbal") * 10).cast("int")
    p = t.supplier.select(F.col("s_suppkey").alias("period_id"), start.alias("s"), (start + F.col("s_nationkey") * 40).alias("e"))
    v = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 5).cast("int").alias("v"))
    return assign_interval(v, p, "v", "s", "e", ["period_id"]).select("o_orderkey", "period_id")
