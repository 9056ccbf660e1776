"""Queries: title classification, text-to-commentary relations, citations, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import catalog as K
from ..operators import joins as J
from ..operators import relate as R
from ..session import scratch_path
from ..sources.documents import read_outline
from .registry import Tables, query

# Titles made of the part's name and a genre word for its type.
_GENRES = {"ECONOMY": "疏", "SMALL": "經", "LARGE": "論頌", "MEDIUM": "玄義", "STANDARD": "禮懺", "PROMO": "大意經"}
_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GENRES.items()) + " END"
_SQL_TITLES = f"ti AS (SELECT p_partkey, 'T' || lpad(p_partkey::VARCHAR, 4, '0') AS sutra_id, p_name || ' ' || {_CASE} AS title, p_type, p_brand FROM part)"


def titles(t: Tables) -> DataFrame:
    genre = F.create_map(*[F.lit(x) for kv in _GENRES.items() for x in kv])[F.col("p_type")]
    number = F.col("p_partkey").cast("string")
    return t.part.select(
        "p_partkey", F.concat(F.lit("T"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("sutra_id"),
        F.concat_ws(" ", "p_name", genre).alias("title"), "p_type", "p_brand",
    )


@query(
    "classify_title",
    f"""
    WITH {_SQL_TITLES}
    SELECT p_partkey, CASE WHEN sutra_id IN ('T0226', 'T0840', 'T0841') THEN 'original' WHEN p_type = 'STANDARD' THEN 'ignore'
      WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN 'original' ELSE 'commentary' END AS class,
      CASE p_type WHEN 'ECONOMY' THEN true WHEN 'MEDIUM' THEN true WHEN 'STANDARD' THEN false
        WHEN 'LARGE' THEN p_partkey > 1420 OR p_partkey BETWEEN 1505 AND 1535
        ELSE p_partkey BETWEEN 1505 AND 1535 OR p_partkey BETWEEN 1693 AND 1821 OR p_partkey BETWEEN 2732 AND 2865 END AS commentary
    FROM ti
    """,
)
def classify_title(t: Tables) -> DataFrame:
    return titles(t).select(
        "p_partkey", R.classify_title("title", "sutra_id").alias("class"), R.is_commentary("title", "sutra_id", True).alias("commentary")
    )


def _members(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Per brand: the nouns of small parts as originals, full names with type as commentaries."""
    key = F.col("p_brand").alias("group_id")
    o = t.part.filter("p_size <= 25").select(key, F.col("p_partkey").alias("sutra_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("title"))
    c = t.part.filter("p_size > 25").select(key, F.col("p_partkey").alias("sutra_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"))
    return o, c


_SQL_MATCH = """
o AS (SELECT p_brand AS group_id, split_part(p_name, ' ', 2) AS title, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY ALL),
c AS (SELECT p_brand AS group_id, p_name || ' ' || lower(p_type) AS title, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL),
g AS (SELECT group_id, sum(n) AS k FROM o GROUP BY group_id),
s AS (SELECT o.group_id, o.title AS o_title, c.title AS c_title, o.n AS n_originals, c.n AS n_commentaries, k,
    greatest(CASE WHEN contains(c.title, o.title) THEN 10 * length(o.title) ELSE 0 END,
      CASE WHEN length(c.title) >= 2 AND contains(o.title, c.title) THEN 8 * length(c.title) ELSE 0 END,
      coalesce(list_max(list_filter(range(3, least(12, length(o.title)) + 1), lambda m: contains(c.title, left(o.title, m)))), 0)) AS score
  FROM o JOIN c USING (group_id) JOIN g USING (group_id)),
r AS (SELECT *, rank() OVER (PARTITION BY group_id, c_title ORDER BY score DESC) AS rk FROM s WHERE k > 1 AND score > 0),
m AS (SELECT group_id, o_title, c_title, score, n_originals, n_commentaries FROM r WHERE rk = 1
      UNION ALL SELECT group_id, o_title, c_title, 0, n_originals, n_commentaries FROM s WHERE k = 1)
"""


@query("match_titles", f"WITH {_SQL_MATCH} SELECT * FROM m")
def match_titles(t: Tables) -> DataFrame:
    return R.match_titles(*_members(t))


@query(
    "chain_titles",
    """
    WITH t AS (SELECT DISTINCT p_brand AS group_id, CASE WHEN p_size > 25 THEN p_name ELSE '新 ' || p_name || ' ' || lower(p_type) END AS title FROM part)
    SELECT a.group_id, a.title AS a_title, b.title AS b_title FROM t a JOIN t b ON a.group_id = b.group_id AND contains(b.title, a.title)
      AND length(b.title) > length(a.title)
    """,
)
def chain_titles(t: Tables) -> DataFrame:
    title = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", F.lit("新"), "p_name", F.lower("p_type")))
    return R.chain_titles(t.part.select(F.col("p_brand").alias("group_id"), title.alias("title")))


def _citations(t: Tables) -> DataFrame:
    """Commentary part cites a neighbouring part: the previous number, and half the number."""
    p = F.col("p_partkey")
    return t.part.select(p.alias("source_id"), F.explode(F.array(p - 1, F.floor(p / 2), p)).alias("target_id"))


def _cited_titles(t: Tables) -> DataFrame:
    title = F.when(F.col("p_size") > 20, F.concat(F.lit("佛說"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("(x)"))).otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("sutra_id"), title.alias("title"))


_SQL_CITED = """
t AS (SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN '佛說' || split_part(p_name, ' ', 2) || '(x)' ELSE p_name END AS title,
        CASE WHEN p_size > 20 THEN split_part(p_name, ' ', 2) ELSE p_name END AS clean FROM part),
ci AS (SELECT DISTINCT p_partkey AS s, unnest([p_partkey - 1, p_partkey // 2]) AS d FROM part),
cp AS (SELECT d AS sutra_id, b.title AS sutra_title, s AS commentary_id, a.title AS commentary_title
  FROM ci JOIN t a ON s = a.id JOIN t b ON d = b.id WHERE s <> d AND contains(a.title, b.clean))
"""


@query("citation_pairs", f"WITH {_SQL_CITED} SELECT * FROM cp")
def citation_pairs(t: Tables) -> DataFrame:
    return R.citation_pairs(_citations(t), _cited_titles(t))


def _outline_pairs(t: Tables) -> DataFrame:
    """Outline relation: a part belongs to the part of half its number when both have the same noun."""
    p = t.part.select("p_partkey", "p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    o = p.select(F.col("p_partkey").alias("sutra_id"), F.col("p_name").alias("sutra_title"), F.col("noun").alias("n2"))
    j = p.filter("p_partkey > 0").join(o, (F.floor(F.col("p_partkey") / 2) == F.col("sutra_id")) & (F.col("noun") == F.col("n2")))
    return j.select("sutra_id", "sutra_title", F.col("p_partkey").alias("commentary_id"), F.col("p_name").alias("commentary_title"))


_SQL_MERGED = f"""
{_SQL_CITED},
op AS (SELECT b.p_partkey AS sutra_id, b.p_name AS sutra_title, a.p_partkey AS commentary_id, a.p_name AS commentary_title FROM part a JOIN part b
       ON a.p_partkey // 2 = b.p_partkey AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) WHERE a.p_partkey > 0),
merged AS (SELECT *, 'bulei_catalog' AS match_type FROM op
       UNION ALL SELECT *, 'xml_cf_tag' FROM cp WHERE (sutra_id, commentary_id) NOT IN (SELECT (sutra_id, commentary_id) FROM op))
"""


def _merged(t: Tables) -> DataFrame:
    return R.merge_relations(_outline_pairs(t), R.citation_pairs(_citations(t), _cited_titles(t)))


@query("merge_relations", f"WITH {_SQL_MERGED} SELECT * FROM merged")
def merge_relations(t: Tables) -> DataFrame:
    return _merged(t)


@query(
    "nest_pairs",
    f"""
    WITH {_SQL_MERGED} SELECT sutra_id, arg_min(sutra_title, match_type) AS title, string_agg(commentary_id::VARCHAR, ',' ORDER BY commentary_id) AS ids
    FROM merged GROUP BY sutra_id
    """,
)
def nest_pairs(t: Tables) -> DataFrame:
    ids = F.array_join(F.transform("commentaries", lambda c: c["id"].cast("string")), ",")
    return R.nest_pairs(_merged(t)).select("sutra_id", "title", ids.alias("ids"))


@query(
    "fanout",
    f"""
    WITH {_SQL_MERGED}, p AS (SELECT commentary_id, count(*) AS n_texts FROM merged GROUP BY 1)
    SELECT n_texts, count(*) AS n_commentaries, n_texts > 8 AS anomaly FROM p GROUP BY n_texts
    """,
)
def fanout(t: Tables) -> DataFrame:
    return R.fanout(_merged(t))


@query(
    "new_pairs",
    "SELECT DISTINCT l_orderkey AS sutra_id, l_partkey AS commentary_id FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')",
)
def new_pairs(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_orderkey").alias("sutra_id"), F.col("l_partkey").alias("commentary_id"), "l_returnflag")
    return R.new_pairs(pairs.drop("l_returnflag").distinct(), pairs.filter("l_returnflag = 'R'"))


# -- overlays and enrichment -------------------------------------------------------------------------


@query(
    "overlay",
    """
    SELECT o_orderkey AS k, coalesce(l.q, CASE WHEN d.doc_id IS NOT NULL THEN d.n_chars END) AS v,
      CASE WHEN l.q IS NOT NULL THEN 'user' WHEN d.doc_id IS NOT NULL THEN 'default' ELSE 'none' END AS source
    FROM orders LEFT JOIN documents d ON o_orderkey = d.doc_id LEFT JOIN (SELECT doc_id, quality AS q FROM labels) l ON o_orderkey = l.doc_id
    """,
)
def overlay(t: Tables) -> DataFrame:
    default = t.documents.select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v"))
    user = t.labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("bigint").alias("v"))
    return K.overlay(default, user, "k", ["v"], t.orders.select(F.col("o_orderkey").alias("k")))


@query(
    "merge_overlay",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE json_extract_string(props, '$.k')::INT END AS k, event_type AS t FROM events""",
)
def merge_overlay(t: Tables) -> DataFrame:
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("t"), "event_type"))
    patch = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit("-1"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    m = K.merge_overlay(base, patch)
    return t.events.select("event_id", m["k"].cast("int").alias("k"), m["t"].alias("t"))


@query(
    "fill_missing",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN coalesce(c_mktsegment, '') ELSE o_orderstatus END AS author,
      CASE WHEN o_orderpriority < '3' THEN o_orderpriority ELSE c_name END AS category
    FROM orders LEFT JOIN customer ON o_orderkey = c_custkey WHERE o_orderpriority < '3' OR c_name IS NOT NULL
    """,
)
def fill_missing(t: Tables) -> DataFrame:
    base = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("author"),
        F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("category"),
    )
    extra = t.customer.select(F.col("c_custkey").alias("o_orderkey"), F.col("c_mktsegment").alias("author"), F.col("c_name").alias("category"))
    return J.fill_missing(base, extra, "o_orderkey", ["author", "category"]).filter(F.col("category").isNotNull())


@query(
    "full_outer_counts",
    """
    WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT k, coalesce(a.n, 0) AS n_source, coalesce(b.n, 0) AS n_table FROM a FULL JOIN b USING (k)
    """,
)
def outer_counts(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return J.full_outer_counts(a, b, "k", ["n"])


@query("leaf_entries", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey // 2 <> 0)")
def leaf_entries(t: Tables) -> DataFrame:
    return P.leaf_entries(t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("parent"))).select("id")


@query(
    "optional_filters",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey > 3 AND contains(lower(s_name), '#00000000') AND s_acctbal IS NOT NULL",
)
def optional_filters(t: Tables) -> DataFrame:
    cond = P.all_of(F.col("s_nationkey") > 3, None, P.match_text("s_name", F.lit("SUPPLIER#00000000")))
    return P.located(t.supplier.filter(cond), "s_acctbal").select("s_suppkey")


# -- an outline of four levels, written and read back -----------------------------------------------

_BOOK = chr(0x1F4D6)
_SQL_OUTLINE = f"""
c AS (SELECT c_custkey AS k, c_custkey // 500 AS g, c_nationkey % 3 AS a, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END AS b, 'T' || lpad(c_custkey::VARCHAR, 6, '0') AS id FROM customer),
r AS (SELECT *, row_number() OVER w AS nth, min(k) OVER (PARTITION BY g, a, b) AS f, first_value(id) OVER w AS first_id FROM c WINDOW w AS (PARTITION BY g, a, b ORDER BY k)),
i AS (SELECT *, 'K' || CASE WHEN b = '' THEN k ELSE f END || CASE WHEN b = '' OR nth = 1 THEN '經' WHEN nth = 2 THEN '經疏' WHEN nth = 3 THEN '經疏記' ELSE '經疏鈔' END AS title FROM r),
ln AS (
    SELECT g, -1 AS a, '' AS b, 0 AS o, 0 AS k, '- {_BOOK} doc ' || g AS line, NULL AS id, NULL AS title FROM (SELECT DISTINCT g FROM c)
    UNION ALL SELECT g, a, '', 0, 0, '  - **part ' || a || '**', NULL, NULL FROM (SELECT DISTINCT g, a FROM c)
    UNION ALL SELECT g, a, b, 1, 0, '    - {_BOOK} ' || b, NULL, NULL FROM (SELECT DISTINCT g, a, b FROM c WHERE b <> '')
    UNION ALL SELECT g, a, b, 2, k, '    - `' || id || '` ' || title, id, title FROM i
    UNION ALL SELECT g, 9, '', 0, 0, '- `T0` stray', NULL, NULL FROM (SELECT DISTINCT g FROM c)),
nl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a, b, o, k) - 1 AS no FROM ln)
"""


def _outline_items(t: Tables) -> DataFrame:
    """Customers as works in the groups of outline files of 500 each: a book, bold parts, segments in them, works at two levels."""
    seg = F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).otherwise(F.lit(""))
    c = t.customer.select(
        F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 500).alias("g"), (F.col("c_nationkey") % 3).alias("a"), seg.alias("b"),
        F.concat(F.lit("T"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"),
    )
    item = F.struct("k", "id")
    groups = c.groupBy("g", "a", "b").agg(F.array_sort(F.collect_list(item)).alias("works"))
    name = lambda n: F.when(n == 0, "經").when(n == 1, "經疏").when(n == 2, "經疏記").otherwise("經疏鈔")
    title = lambda w, n: F.when(F.col("b") == "", F.concat(F.lit("K"), w["k"], F.lit("經"))).otherwise(F.concat(F.lit("K"), F.col("works")[0]["k"], name(n)))
    deep = F.when(F.col("b") == "", "    - `").otherwise("      - `")
    lines = F.transform("works", lambda w, n: F.concat(deep, w["id"], F.lit("` "), title(w, n)))
    head = F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(f"    - {_BOOK} "), "b")))
    parts = groups.select("g", "a", "b", F.concat(head, lines).alias("lines")).groupBy("g", "a").agg(F.array_sort(F.collect_list(F.struct("b", "lines")))["lines"].alias("lines"))
    parts = parts.select("g", F.struct("a", F.concat(F.array(F.concat(F.lit("  - **part "), "a", F.lit("**"))), F.flatten("lines")).alias("lines")).alias("p"))
    whole = parts.groupBy("g").agg(F.array_sort(F.collect_list("p"))["lines"].alias("parts"))
    text = F.concat(F.array(F.concat(F.lit(f"- {_BOOK} doc "), "g")), F.flatten("parts"), F.array(F.lit("- `T0` stray")))
    path = scratch_path(t.spark, "outline")
    whole.select("g", F.array_join(text, "\n").alias("value")).write.partitionBy("g").text(path)
    files = t.spark.read.text(path, wholetext=True).select(F.concat(F.lit("doc "), F.col("g").cast("string")).alias("doc_path"), "value")
    return read_outline(files, lines=50)


@query(
    "outline_file",
    f"""WITH {_SQL_OUTLINE},
    h AS (SELECT g, a, b, no, line FROM nl WHERE o = 1 OR a = -1)
    SELECT 'doc ' || n.g AS doc_path, h.no AS group_no, trim(h.line) AS group_title, n.no AS line_no, n.id AS sutra_id, n.title
    FROM nl n JOIN h ON h.g = n.g AND CASE WHEN n.b = '' THEN h.a = -1 ELSE h.a = n.a AND h.b = n.b END WHERE n.id IS NOT NULL""",
)
def outline_file(t: Tables) -> DataFrame:
    return _outline_items(t)


@query(
    "outline_relations",
    f"""WITH {_SQL_OUTLINE},
    m AS (SELECT g, a, b, id, nth FROM i WHERE b <> '')
    SELECT x.id AS sutra_id, y.id AS commentary_id, x.nth::INT AS rule FROM m x JOIN m y USING (g, a, b) WHERE x.nth <= 2 AND y.nth > x.nth""",
)
def outline_relations(t: Tables) -> DataFrame:
    """From outline files to relations: commentaries of a text, then commentaries of its first commentary."""
    members = _outline_items(t).select(F.concat_ws("#", "doc_path", "group_no").alias("group_id"), "sutra_id", "title")
    return R.extract_relations(members).select("sutra_id", "commentary_id", "rule")
