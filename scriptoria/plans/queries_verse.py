"""Queries: verse mining and selection over the lines of the documents, sources, corrections, daily picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.compat import WS
from ..operators import firstwins as W
from ..operators import neardup as N
from ..operators import verse as V
from .registry import Tables, query

# The documents are in Latin script, so words stand for sentences and these words for the keywords.
DOCTRINE = ["the", "la", "der", "que", "tion", "ou"]
NARRATIVE = ["and", "un", "es"]
WHOLE_LINE = r"[^\n]+"
TABLES = {
    "bonus": {"src1": 40, "src10": 35, "src3": 30},
    "concepts": {"the": 4, "tion": 5, "la": 3, "er": 2, "que": 4, "in": 1, "on": 3},
    "admonition": ["an", "re", "th", "ou", "ch", "zz"],
    "story": ["edon", "with", "elle"],
    "imagery": ["for", "les", "is", "ti"],
    "gazetteer": ["src7", "src17"],
    "ritual": ["／de"],
}


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PUNCT = V.SENTENCE_PUNCTUATION.replace("'", "''")
_SQL_BLOCKS = rf"""
bl AS (SELECT doc_id, lang, source, unnest(bs) AS b, unnest(range(0, len(bs))) AS block_no FROM
       (SELECT doc_id, lang, source, regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '(?m)((?:^[^\n]+(?:\n|\z))+)', 1) AS bs FROM documents)),
se AS (SELECT doc_id, lang, source, block_no, list_filter(list_transform(string_split_regex(b, '[，。；！？、{WS}]+'),
         lambda s: translate(s, '{_PUNCT}', '')), lambda s: s <> '') AS s FROM bl),
le AS (SELECT *, list_transform(s, lambda x: length(x)) AS l, len(s) AS n FROM se),
mo AS (SELECT *, l[list_position(list_transform(l, lambda x: len(list_filter(l, lambda y: y = x))),
                 list_max(list_transform(l, lambda x: len(list_filter(l, lambda y: y = x)))))] AS m FROM le WHERE n BETWEEN 4 AND 12),
pe AS (SELECT *, len(list_filter(l, lambda x: x = m)) AS p, array_to_string(s, '') AS f FROM mo
       WHERE list_min(l) >= 3 AND list_max(l) <= 7 AND len(list_filter(l, lambda x: abs(x - m) <= 1)) >= n * 0.8),
sc AS (SELECT *, CASE WHEN p = n THEN 40 WHEN p >= n * 0.8 THEN 30 ELSE 20 END + CASE WHEN m IN (5, 7) THEN 20 WHEN m IN (4, 6) THEN 15 ELSE 10 END
    + CASE WHEN n <= 8 THEN 20 ELSE 10 END
    + CASE WHEN len(list_filter({_sql_list(DOCTRINE)}, lambda w: contains(f, w))) >= 3 THEN 20
           WHEN len(list_filter({_sql_list(DOCTRINE)}, lambda w: contains(f, w))) = 2 THEN 15
           WHEN len(list_filter({_sql_list(DOCTRINE)}, lambda w: contains(f, w))) = 1 THEN 10 ELSE 0 END
    - CASE WHEN len(list_filter({_sql_list(NARRATIVE)}, lambda w: contains(f, w))) >= 2 THEN 15 ELSE 0 END AS score FROM pe),
ok AS (SELECT doc_id, block_no, score, '《' || source || '》／' || lang AS source,
    CASE WHEN n % 2 = 0 THEN array_to_string(list_transform(range(1, n, 2), lambda i: s[i] || '，' || s[i + 1]), '。') ELSE array_to_string(s, '，') END || '。' AS text
  FROM sc WHERE score >= 50)
"""


def _docs(t: Tables) -> DataFrame:
    """Every line of a document as a block of its own."""
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("value"), F.col("source").alias("title"), F.col("lang").alias("author"))


_BANDS = {"line_pattern": WHOLE_LINE, "doctrine": DOCTRINE, "narrative": NARRATIVE}


@query("verse_candidates", f"WITH {_SQL_BLOCKS} SELECT doc_id, block_no, score, text FROM ok")
def verse_candidates(t: Tables) -> DataFrame:
    rows = V.verse_candidates(_docs(t), **_BANDS)
    return rows.select("doc_id", "block_no", "score", V.format_verse("sentences").alias("text"))


@query(
    "mine_verses",
    rf"""
    WITH {_SQL_BLOCKS},
    fp AS (SELECT *, left(translate(regexp_replace(text, '[{WS}]+', '', 'g'), '，。、；：！？|', ''), 6) AS fp FROM ok),
    known AS (SELECT DISTINCT left(translate(regexp_replace(text, '[{WS}]+', '', 'g'), '，。、；：！？「」『』（）|·', ''), 6) AS fp FROM benchmark),
    r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id, block_no) AS rn FROM fp WHERE fp NOT IN (SELECT fp FROM known))
    SELECT doc_id, block_no, text, source, score FROM r WHERE rn = 1
    """,
)
def mine_verses(t: Tables) -> DataFrame:
    return V.mine_verses(_docs(t), t.benchmark.select(F.col("text").alias("verse")), **_BANDS)


def _lines(t: Tables) -> DataFrame:
    """Every line as a verse with a source text; conversations stand in for excluded sources."""
    d = t.documents.select("doc_id", F.concat(F.lit("《"), "source", F.lit("》／"), "lang").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return d.withColumn("text", F.replace("text", F.lit("."), F.lit("。"))).withColumn("text", F.replace("text", F.lit(","), F.lit("，")))


_C = TABLES["concepts"]
_SQL_DEPTH = " + ".join(f"contains(t, '{w}')::INT * {n}" for w, n in _C.items())
_SQL_STORY = f"len(list_filter({_sql_list(TABLES['story'])}, lambda w: contains(t, w)))"
_SQL_IMAGE = f"len(list_filter({_sql_list(TABLES['imagery'])}, lambda w: contains(t, w)))"
_SQL_JUDGED = rf"""
li AS (SELECT doc_id, '《' || source || '》／' || lang AS src, source, lang, unnest(ls) AS raw, unnest(range(0, len(ls))) AS line_no
       FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)),
tx AS (SELECT doc_id, line_no, src, source, lang, replace(replace(raw, '.', '。'), ',', '，') AS t FROM li),
sn AS (SELECT *, length(t) AS n, list_filter(list_transform(string_split_regex(t, '[，。；！？]'),
        lambda s: regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda s: length(s) >= 2) AS s FROM tx),
ln AS (SELECT *, list_transform(s, lambda x: length(x)) AS l FROM sn),
md AS (SELECT *, l[list_position(list_transform(l, lambda x: len(list_filter(l, lambda y: y = x))),
                 list_max(list_transform(l, lambda x: len(list_filter(l, lambda y: y = x)))))] AS m FROM ln),
rt AS (SELECT *, len(list_filter(l, lambda x: abs(x - m) <= 1)) / len(l) AS r, least(35, {_SQL_DEPTH}) AS depth FROM md),
sc AS (SELECT *, CASE WHEN n BETWEEN 10 AND 150 AND len(s) >= 2 THEN
    CASE WHEN contains(src, 'src1') THEN 40 WHEN contains(src, 'src10') THEN 35 WHEN contains(src, 'src3') THEN 30 ELSE 0 END
    + CASE WHEN n <= 30 THEN 15 WHEN n <= 50 THEN 20 WHEN n <= 70 THEN 15 WHEN n <= 100 THEN 10 ELSE 5 END
    + CASE WHEN r >= 0.9 AND m IN (5, 7) THEN 20 WHEN r >= 0.9 AND m IN (4, 6) THEN 18 WHEN r >= 0.8 THEN 14 WHEN r >= 0.7 THEN 8 ELSE 3 END
    + depth + least(15, 2 * len(list_filter({_sql_list(TABLES["admonition"])}, lambda w: contains(t, w))))
    - CASE WHEN contains(src, 'src7') OR contains(src, 'src17') THEN 20 ELSE 0 END - CASE WHEN contains(src, '／de') THEN 15 ELSE 0 END
    - CASE WHEN regexp_matches(t, '\[\d+\]') THEN 3 ELSE 0 END
    - CASE WHEN {_SQL_STORY} >= 2 THEN 12 WHEN {_SQL_STORY} = 1 THEN 4 ELSE 0 END
    - CASE WHEN {_SQL_IMAGE} >= 3 AND depth < 10 THEN 10 ELSE 0 END END AS score FROM rt),
fp AS (SELECT *, translate(regexp_replace(t, '[{WS}]+', '', 'g'), '，。、；：！？|', '') AS bare FROM sc),
ex AS (SELECT translate(regexp_replace(text, '[{WS}]+', '', 'g'), '，。、；：！？「」『』（）|·', '') AS b FROM benchmark),
kn AS (SELECT DISTINCT left(b, 6) AS k FROM ex WHERE length(b) >= 6 UNION SELECT DISTINCT left(b, 10) FROM ex WHERE length(b) >= 10),
ju AS (SELECT *, CASE WHEN left(bare, 6) IN (SELECT k FROM kn) OR left(bare, 10) IN (SELECT k FROM kn) THEN 'dup'
    WHEN coalesce(score, -1) < 35 THEN 'low' ELSE 'kept' END AS reason FROM fp)
"""


def judged(t: Tables) -> DataFrame:
    return V.judge_verses(_lines(t), t.benchmark.select(F.col("text").alias("verse")), tables=TABLES)


@query("judge_verses", f"WITH {_SQL_JUDGED} SELECT doc_id, line_no, score, reason FROM ju")
def judge_verses(t: Tables) -> DataFrame:
    return judged(t).select("doc_id", "line_no", "score", "reason")


@query("skip_counts", f"WITH {_SQL_JUDGED} SELECT reason, count(*) AS n FROM ju GROUP BY reason")
def skip_counts(t: Tables) -> DataFrame:
    return V.skip_counts(judged(t))


_SQL_SELECTED = f"""
{_SQL_JUDGED}, un AS (SELECT *, row_number() OVER (PARTITION BY left(bare, 12) ORDER BY score DESC, doc_id, line_no) AS rn FROM ju WHERE reason = 'kept'),
top AS (SELECT * FROM un WHERE rn = 1 ORDER BY score DESC, doc_id, line_no LIMIT 2000)
"""


@query("select_verses", f"WITH {_SQL_SELECTED} SELECT doc_id, line_no, score FROM top")
def select_verses(t: Tables) -> DataFrame:
    return V.select_verses(judged(t), ["doc_id", "line_no"]).select("doc_id", "line_no", "score")


@query("source_distribution", f"WITH {_SQL_SELECTED} SELECT source AS book, count(*) AS n FROM top GROUP BY 1 ORDER BY n DESC, book LIMIT 20")
def source_distribution(t: Tables) -> DataFrame:
    return V.source_distribution(V.select_verses(judged(t), ["doc_id", "line_no"]))


@query(
    "dedupe_prefix",
    rf"""
    WITH f AS (SELECT doc_id, left(translate(regexp_replace(text, '[{WS}]+', '', 'g'), '，。、；：！？|', ''), 12) AS fp FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS rn FROM f)
    SELECT doc_id FROM r WHERE rn = 1 OR length(fp) < 12
    """,
)
def dedupe_prefix(t: Tables) -> DataFrame:
    return W.dedupe_prefix(t.documents, "text", 12, ["doc_id"]).select("doc_id")


@query(
    "first_person_by_name",
    "SELECT p_name AS name, min(p_partkey) AS person_id FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY p_name",
)
def first_person(t: Tables) -> DataFrame:
    persons = t.part.select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("name"))
    return W.first_person_by_name(persons, t.supplier.select(F.col("s_suppkey").alias("person_id"))).select("name", "person_id")


@query(
    "normalize_source",
    """
    SELECT doc_id, CASE WHEN regexp_matches(source, '^src.$') THEN '《Book ' || source || '》' ELSE source END || ' ／ ' || lang AS source_norm FROM documents
    """,
)
def normalize_source(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", F.concat(F.lit("《"), "source", F.lit("》 ／／ "), "lang").alias("source"))
    names = t.documents.filter(F.length("source") == 4).select(F.col("source").alias("alias")).distinct()
    aliases = names.withColumn("canonical", F.concat(F.lit("Book "), "alias"))
    return V.normalize_source(df, aliases, key="doc_id").select("doc_id", "source_norm")


@query(
    "apply_corrections",
    """
    SELECT p_partkey, CASE WHEN s_nationkey < 10 THEN 'fixed ' || s_name ELSE p_name END AS verse,
      CASE WHEN s_nationkey >= 20 THEN s_name ELSE p_brand END AS source,
      (CASE WHEN s_nationkey < 10 THEN 1 ELSE 0 END + CASE WHEN s_nationkey >= 20 THEN 1 ELSE 0 END) AS n_changes
    FROM part LEFT JOIN supplier ON p_partkey = s_suppkey
    """,
)
def apply_corrections(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("verse"), F.col("p_brand").alias("source"))
    base = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey"))
    key = F.col("s_suppkey").alias("p_partkey")
    verse = base.select(
        key, F.lit("verse").alias("field"), F.when(F.col("s_nationkey") < 10, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise("no").alias("old"),
        F.concat(F.lit("fixed "), "s_name").alias("new"), F.lit("v").alias("note"),
    )
    source = base.filter("s_nationkey >= 20").select(key, F.lit("source").alias("field"), F.lit("?").alias("old"), F.col("s_name").alias("new"), F.lit("s").alias("note"))
    out, log = V.apply_corrections(rows, verse.unionByName(source), "p_partkey")
    n = log.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_changes"))
    return out.join(n, "p_partkey", "left").select("p_partkey", "verse", "source", F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


@query(
    "daily_verse",
    """
    WITH v AS (SELECT 'builtin' AS type, s_suppkey AS id FROM supplier UNION ALL SELECT 'custom', n_nationkey FROM nation),
    p AS (SELECT *, row_number() OVER (ORDER BY type, id) - 1 AS pos, count(*) OVER () AS n FROM v),
    d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)
    SELECT date::VARCHAR AS date, type, id FROM d JOIN p ON (dayofyear(date) - 1) % n = pos
    """,
)
def daily_verse(t: Tables) -> DataFrame:
    verses = V.union_with_provenance(t.supplier.select(F.col("s_suppkey").alias("id")), t.nation.select(F.col("n_nationkey").cast("bigint").alias("id")))
    dates = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return V.daily_verse(verses, dates).select(F.col("date").cast("string").alias("date"), "type", "id")


@query(
    "delimiters",
    """
    SELECT p_partkey, p_name || ' ｜ ' || p_type AS unified, [p_name, p_type] AS lines, replace(p_name, 'e', '為') AS repaired FROM part
    """,
)
def delimiters(t: Tables) -> DataFrame:
    raw = F.concat("p_name", F.lit("| "), "p_type")
    return t.part.select(
        "p_partkey", T.unify_delimiter(raw).alias("unified"), T.split_lines(raw).alias("lines"),
        T.repair_conversion(T.to_script("p_name", [("e", "爲")])).alias("repaired"),
    )


@query("near_duplicates")
def near_duplicates(t: Tables) -> DataFrame:
    names = t.part.select("p_partkey", F.col("p_name").alias("n"), "p_type")
    rows = names.select("p_partkey", N.verse_key(F.concat_ws(" ｜ ", "n", F.lower("p_type"))).alias("text"))
    return N.near_duplicates(rows, "p_partkey", "text").withColumn("ratio", F.round("ratio", 6))


@query(
    "distinct_texts",
    "SELECT text, min(doc_id) AS rep_id, count(*) AS copies FROM documents GROUP BY text",
)
def distinct_texts(t: Tables) -> DataFrame:
    return N.distinct_texts(t.documents, "doc_id", "text")
