"""Queries: dictionaries built from the parts table, lookups, senses and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import lexicon as L
from ..operators import rewrite as W
from .registry import Tables, query

_UP = [(chr(c), chr(c - 32)) for c in range(ord("a"), ord("z") + 1)]


def raw_entries(t: Tables) -> DataFrame:
    """Every part is an entry of its brand's dictionary; some are media files or lack a definition."""
    term = F.when(F.col("p_size") == 7, F.concat("p_name", F.lit(".png"))).otherwise(F.concat(F.lit("　"), "p_name", F.lit(" ")))
    definition = F.when(F.col("p_size") == 9, F.lit(" ")).otherwise(F.concat(F.lit("<b>"), "p_type", F.lit("</b> "), "p_size"))
    return t.part.select(F.col("p_brand").alias("dict_id"), F.col("p_partkey").alias("pos"), term.alias("term"), definition.alias("definition"))


def meta(t: Tables) -> DataFrame:
    per = t.part.groupBy(F.col("p_brand").alias("dict_id")).agg(F.count(F.lit(1)).alias("meta_count"))
    return per.select(
        "dict_id", F.lower("dict_id").alias("name"), F.lit("s").alias("source"), F.lit("tc").alias("char_type"), F.lit("free").alias("license"), "meta_count"
    )


_SQL_ENTRIES = """
en AS (SELECT p_brand AS dict_id, p_partkey AS pos, p_name AS term, upper(p_name) AS term_tc, p_type || ' ' || p_size AS definition
       FROM part WHERE p_size NOT IN (7, 9)),
di AS (SELECT p_brand AS dict_id, lower(p_brand) AS name, count(CASE WHEN p_size NOT IN (7, 9) THEN 1 END) AS entry_count FROM part GROUP BY ALL)
"""


@query("build_entries", f"WITH {_SQL_ENTRIES} SELECT dict_id, pos, term, term_tc, term AS term_sc, definition FROM en")
def build_entries(t: Tables) -> DataFrame:
    entries, _ = L.build_dictionary(raw_entries(t), meta(t), to_tc=_UP)
    return entries.select("dict_id", "pos", "term", "term_tc", "term_sc", "definition")


@query("build_dictionaries", f"WITH {_SQL_ENTRIES} SELECT dict_id, name, entry_count, 'builtin' AS origin FROM di UNION ALL SELECT 'user', 'user', (SELECT count(DISTINCT c_mktsegment) FROM customer), 'user'")
def build_dictionaries(t: Tables) -> DataFrame:
    _, dicts = L.build_dictionary(raw_entries(t), meta(t), to_tc=_UP)
    user = t.customer.select(F.lit("user").alias("dict_id"), F.col("c_mktsegment").alias("term"))
    return L.list_dictionaries(dicts, user)


def _keys(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return t.part.select(name.alias("query"))


def _user(t: Tables) -> DataFrame:
    return t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(
        F.lit("user").alias("dict_id"), F.col("p_name").alias("term"), F.col("s_suppkey").cast("int").alias("pos"), F.col("s_name").alias("definition")
    )


_SQL_LOOKUP = f"""
{_SQL_ENTRIES}, ke AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS query FROM part),
hits AS (
  SELECT query, dict_id, term, pos, definition, 0 AS origin, entry_count FROM ke JOIN en ON query = term OR query = term_tc JOIN di USING (dict_id)
  UNION ALL SELECT query, 'user', p_name, s_suppkey, s_name, 1, NULL FROM supplier JOIN part ON s_suppkey = p_partkey JOIN ke ON query = p_name)
"""


@query(
    "lookup",
    f"""
    WITH {_SQL_LOOKUP}
    SELECT query, dict_id, term, pos, definition FROM (SELECT *, row_number() OVER (PARTITION BY query, dict_id, term
      ORDER BY origin, entry_count DESC NULLS LAST, dict_id, pos) AS r FROM hits) WHERE r = 1
    """,
)
def lookup(t: Tables) -> DataFrame:
    entries, dicts = L.build_dictionary(raw_entries(t), meta(t), to_tc=_UP)
    return L.lookup(_keys(t), entries, dicts, _user(t)).select("query", "dict_id", "term", "pos", "definition")


@query("lookup_all_senses", f"WITH {_SQL_LOOKUP} SELECT query, dict_id, count(*) AS n_senses FROM hits GROUP BY ALL")
def lookup_all(t: Tables) -> DataFrame:
    entries, dicts = L.build_dictionary(raw_entries(t), meta(t), to_tc=_UP)
    hits = L.lookup(_keys(t), entries, dicts, _user(t), dedupe=False)
    return hits.groupBy("query", "dict_id").agg(F.count(F.lit(1)).alias("n_senses"))


@query(
    "dictionary_quality",
    """
    WITH e AS (SELECT p_brand AS dict_id, CASE WHEN p_size = 9 THEN ' ' ELSE '<b>' || p_type || '</b> ' || p_size END AS d FROM part)
    SELECT dict_id, count(*) AS entry_count, 0 AS empty_terms, count(CASE WHEN d = ' ' THEN 1 END) AS empty_defs,
      count(CASE WHEN length(d) BETWEEN 1 AND 4 THEN 1 END) AS short_defs, round(avg(length(d)), 6) AS avg_def_length, max(length(d)) AS max_def_length,
      min(length(d)) AS min_def_length, false AS count_mismatch, count(CASE WHEN length(d) BETWEEN 1 AND 4 THEN 1 END) > count(*) * 0.1 AS many_short
    FROM e GROUP BY dict_id
    """,
)
def dictionary_quality(t: Tables) -> DataFrame:
    q = L.dictionary_quality(raw_entries(t), meta(t)).withColumn("avg_def_length", F.round("avg_def_length", 6))
    return q.drop("encoding_issues", "meta_count")


@query(
    "must_have_terms",
    """
    WITH w AS (SELECT DISTINCT p_name AS term FROM part WHERE p_size < 4 UNION SELECT r_name FROM region)
    SELECT term, count(DISTINCT p_brand) AS n_dicts, count(p_brand) > 0 AS found FROM w LEFT JOIN part ON p_name = term GROUP BY term
    """,
)
def must_have_terms(t: Tables) -> DataFrame:
    need = t.part.filter("p_size < 4").select(F.col("p_name").alias("term")).union(t.region.select("r_name"))
    return L.must_have_terms(t.part.select(F.col("p_brand").alias("dict_id"), F.col("p_name").alias("term")), need)


def lexicon(t: Tables) -> DataFrame:
    """Documents as lexicon entries: the first word is the head-word, every line is a sense."""
    word = F.substring_index("text", " ", 1)
    senses = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(
            F.when(F.length(s) > 50, s).otherwise("").alias("def"), F.when(i == 0, F.array(F.left(s, F.lit(5)))).alias("quote"),
            F.array(F.length(s).cast("string")).alias("example"),
        ),
    )
    reading = F.struct(F.col("lang").alias("bopomofo"), F.when(F.col("doc_id") > 50, F.col("source")).otherwise("").alias("pinyin"), senses.alias("definitions"))
    return t.documents.select(
        "doc_id", word.alias("title"), F.array(reading).alias("heteronyms"), F.length(word).alias("stroke_count"), F.col("lang").alias("radical")
    )


_SQL_SENSES = r"""
l AS (SELECT doc_id, '【' || lang || CASE WHEN doc_id > 50 THEN ' / ' || source ELSE '' END || '】' AS head,
  list_filter(list_transform(string_split(text, chr(10)), lambda s, i: CASE WHEN length(s) > 50 THEN
    CASE WHEN i <= 10 THEN substring('❶❷❸❹❺❻❼❽❾❿', i, 1) ELSE '(' || i || ')' END || ' ' || s
    || CASE WHEN i = 1 THEN chr(10) || '　　' || chr(128214) || ' ' || left(s, 5) ELSE '' END || chr(10) || '　　例：' || length(s) END), lambda x: x IS NOT NULL) AS senses
  FROM documents)
"""


@query("flatten_senses", f"WITH {_SQL_SENSES} SELECT doc_id, array_to_string(list_prepend(head, senses), chr(10)) AS entry FROM l")
def flatten_senses(t: Tables) -> DataFrame:
    return lexicon(t).select("doc_id", F.array_join(L.reading_texts("heteronyms"), "\n\n").alias("entry"))


@query(
    "lexicon_profile",
    r"""
    WITH w AS (SELECT split_part(text, ' ', 1) AS title, text FROM documents)
    SELECT count(*) AS entries, count(CASE WHEN length(title) = 1 THEN 1 END) AS one_char, count(CASE WHEN length(title) = 2 THEN 1 END) AS two_chars,
      count(CASE WHEN length(title) NOT IN (1, 2) THEN 1 END) AS longer, count(*) AS with_reading,
      count(CASE WHEN len(list_filter(string_split(text, chr(10)), lambda s: length(s) > 50)) > 0 THEN 1 END) AS with_definition,
      count(CASE WHEN length(title) > 0 THEN 1 END) AS with_strokes, count(CASE WHEN regexp_matches(title, '[{}]') THEN 1 END) AS malformed
    FROM w
    """,
)
def lexicon_profile(t: Tables) -> DataFrame:
    return L.lexicon_profile(lexicon(t))


@query("radical_counts", "SELECT lang AS radical, count(*) AS n FROM documents GROUP BY lang")
def radical_counts(t: Tables) -> DataFrame:
    return L.radical_counts(lexicon(t))


@query(
    "search_definitions",
    r"""
    WITH e AS (SELECT doc_id AS id, list_distinct(string_split_regex(lower(source || ' ' || text), '[^\p{L}\p{N}\p{Mn}]+')) AS ws FROM documents),
    q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT c_mktsegment FROM customer
          UNION SELECT lang || ' ' || source FROM documents
          UNION SELECT array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{Mn}]+'), lambda w: length(w) > 6)[1:2], ' ') FROM benchmark),
    t AS (SELECT query, list_distinct(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}\p{Mn}]+'), lambda w: w <> '')) AS ts FROM q)
    SELECT query, id FROM t, e WHERE len(ts) > 0 AND list_has_all(ws, ts)
    """,
)
def search_definitions(t: Tables) -> DataFrame:
    entries = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("term"), F.col("text").alias("definition"))
    long = F.slice(F.filter(L.word_tokens("text"), lambda w: F.length(w) > 6), 1, 2)
    q = (
        t.part.select(F.col("p_name").alias("query")).union(t.customer.select("c_mktsegment"))
        .union(t.documents.select(F.concat_ws(" ", "lang", "source"))).union(t.benchmark.select(F.array_join(long, " "))).distinct()
    )
    return L.search_definitions(entries, q)


@query(
    "see_also",
    """
    SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN '参见：' || s_name || '；n' || s_nationkey WHEN s_nationkey < 15 THEN 'body' ELSE s_name END AS definition,
      CASE WHEN s_nationkey < 5 THEN 2 WHEN s_nationkey < 15 THEN 1 ELSE 0 END AS n_refs, CASE WHEN s_nationkey < 5 THEN 'n' || s_nationkey END AS alt
    FROM supplier
    """,
)
def see_also(t: Tables) -> DataFrame:
    ref = lambda c: F.concat(F.lit("<SEEALSO>"), c, F.lit("</SEEALSO>"))
    n = F.concat(F.lit("n"), F.col("s_nationkey"))
    body = F.when(F.col("s_nationkey") < 5, F.concat(ref(F.col("s_name")), ref(n))).when(F.col("s_nationkey") < 15, F.concat(F.lit("body "), ref(n))).otherwise(F.col("s_name"))
    out = P.extract_see_also(t.supplier.withColumn("definition", body))
    return out.select("s_suppkey", "definition", F.size("see_also").alias("n_refs"), P.alt_terms("see_also")[0].alias("alt"))


_SQL_PHRASES = "p AS (SELECT DISTINCT substring(w, 1, 2 + len(w) % 4) AS src FROM (SELECT string_split(text, ' ')[1] AS w FROM documents) WHERE regexp_full_match(w, '[A-Za-z]{5,20}'))"


@query(
    "rewrite_phrases",
    f"""
    WITH {_SQL_PHRASES}, r AS (SELECT string_agg(src, '|' ORDER BY len(src) DESC, src) AS pattern FROM p)
    SELECT doc_id, length(new) AS n_chars, md5(new) AS digest FROM (SELECT doc_id, regexp_replace(text, pattern, '<\\0>', 'g') AS new FROM documents, r)
    """,
)
def rewrite_phrases(t: Tables) -> DataFrame:
    """Texts rewritten by a table of overlapping phrases: beginnings of two to five letters of first words."""
    word = F.split("text", " ")[0]
    words = t.documents.select(word.alias("w")).filter(F.col("w").rlike("^[A-Za-z]{5,20}$"))
    phrases = words.select(F.substring("w", F.lit(1), 2 + F.length("w") % 4).alias("src")).distinct()
    found = W.rewrite_phrases(t.documents.select("doc_id", "text"), "text", phrases.withColumn("dst", F.concat(F.lit("<"), "src", F.lit(">"))))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
