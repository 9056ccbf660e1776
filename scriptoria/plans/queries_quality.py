"""Queries: audits over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import WS
from ..functions.text import drop_ws
from ..operators import quality as Q
from ..operators.align import align_texts
from .registry import Tables, query

# Personal data and secrets stand in for leaked notes.
PATTERNS = [(r"token=[^\s]+", "token"), (r"[a-z0-9]+@[a-z0-9.]+", "mail"), (r"\+\d[\d ()-]{6,}", "phone")]


@query(
    "detect_leaks",
    r"""
    WITH h AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, 'token=[^\s]+') THEN 'token' WHEN regexp_matches(text, '[a-z0-9]+@[a-z0-9.]+') THEN 'mail'
        WHEN regexp_matches(text, '\+\d[\d ()-]{6,}') THEN 'phone' END AS leak FROM documents),
    x AS (SELECT *, regexp_extract(text, CASE leak WHEN 'token' THEN '(token=[^\s]+)' WHEN 'mail' THEN '([a-z0-9]+@[a-z0-9.]+)' ELSE '(\+\d[\d ()-]{6,})' END, 1) AS hit FROM h WHERE leak IS NOT NULL),
    p AS (SELECT *, instr(text, hit) AS hit_at FROM x), s AS (SELECT *, greatest(1, hit_at - 15) AS s FROM p)
    SELECT doc_id, leak, translate(substring(text, s, hit_at - s + length(hit) + 15), chr(10), ' ') AS leak_context FROM s
    """,
)
def detect_leaks(t: Tables) -> DataFrame:
    return Q.detect_leaks(t.documents.select("doc_id", "text"), patterns=PATTERNS).select("doc_id", "leak", "leak_context")


@query(
    "char_coverage",
    """
    WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
    SELECT ch, unicode(ch)::BIGINT AS code, count(*) AS n FROM c WHERE ch <> '' AND NOT (unicode(ch) BETWEEN 32 AND 126 OR unicode(ch) BETWEEN 224 AND 239) GROUP BY ch
    """,
)
def char_coverage(t: Tables) -> DataFrame:
    supported = t.spark.createDataFrame([(32, 126), (224, 239)], "lo int, hi int")
    return Q.char_coverage(t.documents, supported)


_SQL_LINES = f"""
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
nn AS (SELECT length(regexp_replace(line, '[{WS}]+', '', 'g')) AS length, line FROM li)
"""


def _line_lengths(t: Tables) -> DataFrame:
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return Q.length_histogram(lines, F.length(drop_ws("line")), F.col("line"))


@query(
    "length_histogram",
    f"""
    WITH {_SQL_LINES} SELECT length, count(*) AS n, min(line) AS example, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct
    FROM nn WHERE length > 0 GROUP BY length
    """,
)
def length_histogram(t: Tables) -> DataFrame:
    return _line_lengths(t).withColumn("pct", F.round("pct", 6))


@query(
    "length_percentiles",
    f"""
    WITH {_SQL_LINES}, l AS (SELECT list_sort(list(length)) AS l FROM nn WHERE length > 0), n AS (SELECT *, len(l) AS n FROM l)
    SELECT l[(n * 50) // 100 + 1] AS p50, l[(n * 90) // 100 + 1] AS p90, l[(n * 95) // 100 + 1] AS p95, l[(n * 99) // 100 + 1] AS p99, l[n] AS max_length,
      l[(n * 95) // 100 + 1] + 8 AS layout_width FROM n
    """,
)
def length_percentiles(t: Tables) -> DataFrame:
    return Q.positional_percentiles(_line_lengths(t))


@query(
    "reconcile_lengths",
    """
    WITH a AS (SELECT source, count(*) AS docs, sum(length(text)) AS chars FROM documents GROUP BY 1),
    b AS (SELECT source, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY 1)
    SELECT source, a.docs AS docs_source, b.docs AS docs_table, a.chars::BIGINT AS chars_source, b.chars::BIGINT AS chars_table,
      CASE WHEN a.chars = b.chars THEN 'pass' ELSE 'fail' END AS status FROM a JOIN b USING (source)
    """,
)
def reconcile_lengths(t: Tables) -> DataFrame:
    def counted(chars) -> DataFrame:
        return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(chars).alias("chars"))

    got = Q.reconcile_counts(counted(F.length("text")), counted(F.col("n_chars")), "source", ["docs", "chars"])
    return got.drop("docs_ok", "chars_ok")


@query(
    "verification_summary",
    "SELECT CASE WHEN length(text) = n_chars THEN 'pass' ELSE 'fail' END AS status, count(*) AS n FROM documents GROUP BY 1",
)
def verification_summary(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", F.length("text").cast("bigint").alias("chars"))
    b = t.documents.select("doc_id", F.col("n_chars").alias("chars"))
    return Q.verification_summary(Q.reconcile_counts(a, b, "doc_id", ["chars"]))


def _sql_compare(pairs: str, keys: str) -> str:
    """Agreement of the pairs (keys, a, b) by segments."""
    return f"""
    WITH p AS ({pairs}),
    g AS (SELECT {keys}, 1 AS l, 0 AS r, unnest(string_split_regex(a, '[.!?\\n。！？；]+')) AS s FROM p
          UNION ALL SELECT {keys}, 0, 1, unnest(string_split_regex(b, '[.!?\\n。！？；]+')) FROM p),
    n AS (SELECT {keys}, l, r, regexp_replace(s, '[{WS}]+', '', 'g') AS s FROM g),
    c AS (SELECT {keys}, s, sum(l) AS l, sum(r) AS r FROM n WHERE s <> '' GROUP BY ALL),
    f AS (SELECT {keys}, sum(least(l, r) * length(s)) AS m, sum(l * length(s)) AS ll, sum(r * length(s)) AS rl, count(*) FILTER (l <> r) AS d FROM c GROUP BY ALL),
    x AS (SELECT {keys}, coalesce(2 * m / (ll + rl), 1.0) AS ratio, coalesce(ll, 0)::BIGINT AS left_len, coalesce(rl, 0)::BIGINT AS right_len, coalesce(d, 0) AS n_diffs
          FROM p LEFT JOIN f USING ({keys}))
    SELECT {keys}, round(ratio, 6) AS ratio, left_len, right_len, n_diffs::INTEGER AS n_diffs,
      CASE WHEN ratio >= 0.99 THEN 'match' WHEN ratio >= 0.95 THEN 'close' ELSE 'differs' END AS band FROM x
    """


def _compared(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    got = Q.compare_texts(a, b, keys, "a", "b", normalize=False)
    return got.select(*keys, F.round("ratio", 6).alias("ratio"), "left_len", "right_len", F.size("diffs").alias("n_diffs"), "band")


@query(
    "compare_texts",
    _sql_compare("SELECT x.conv_id, x.turn, x.text AS a, y.text AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 2", "conv_id, turn"),
)
def compare_texts(t: Tables) -> DataFrame:
    """Each turn of a conversation against the same role's next turn, as two editions of one text."""
    c = t.conversations
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("b"))
    return _compared(a, b, ["conv_id", "turn"])


@query(
    "compare_documents",
    _sql_compare("SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1", "doc_id"),
)
def compare_documents(t: Tables) -> DataFrame:
    """Each document against the next one by id."""
    a = t.documents.select("doc_id", F.col("text").alias("a"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return _compared(a, b, ["doc_id"])


@query(
    "comparison_summary",
    "WITH r AS (" + _sql_compare("SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1", "doc_id") + """)
    SELECT count(*) AS pairs, sum(n_diffs)::BIGINT AS total_diffs, round(avg(ratio), 5) AS avg_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio,
      count(*) FILTER (band = 'match') AS passed FROM r""",
)
def comparison_summary(t: Tables) -> DataFrame:
    a = t.documents.select("doc_id", F.col("text").alias("a"))
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    got = Q.comparison_summary(Q.compare_texts(a, b, ["doc_id"], "a", "b", normalize=False))
    return got.select("pairs", "total_diffs", F.round("avg_ratio", 5).alias("avg_ratio"), F.round("min_ratio", 6).alias("min_ratio"), F.round("max_ratio", 6).alias("max_ratio"), "passed")


@query(
    "compare_copies",
    f"""
    WITH d AS (SELECT text, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(*) > 1)
    SELECT first_id, last_id, 1.0::DOUBLE AS ratio, 'match' AS band, length(regexp_replace(text, '[.!?\\n。！？；{WS}]+', '', 'g')) AS n_chars FROM d
    """,
)
def compare_copies(t: Tables) -> DataFrame:
    h = F.sha2(F.col("text"), 256)
    same = t.documents.groupBy(h.alias("h")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = ["first_id", "last_id"]
    a = same.join(t.documents.select(F.col("doc_id").alias("first_id"), F.col("text").alias("a")), "first_id").select(*keys, "a")
    b = same.join(t.documents.select(F.col("doc_id").alias("last_id"), F.col("text").alias("b")), "last_id").select(*keys, "b")
    return Q.compare_texts(a, b, keys, "a", "b", normalize=False).select(*keys, "ratio", "band", F.col("left_len").alias("n_chars"))


_CUT = r"[.!?\n。！？；]+"


def _sql_known_edits() -> str:
    side = {"l": "side = 0", "r": "side = 1"}
    bounds = ", ".join(f'coalesce(max(upto) FILTER ({own} AND m), 0) AS {s}f, coalesce(max(upto) FILTER ({own} AND NOT m), max(upto) FILTER ({own} AND m), 0) AS {s}t' for s, own in side.items())
    around = lambda s: f"substring({s}w, greatest({s}f - 10, 0) + 1, {s}f - greatest({s}f - 10, 0)) || '【' || {s}c || '】' || substring({s}w, {s}t + 1, 10)"
    return f"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{_CUT}'), lambda s: regexp_replace(s, '[{WS}]+', '', 'g')), lambda s: s <> '') AS l FROM documents),
    u AS (SELECT doc_id, len(l) AS n, unnest(l) AS seg, unnest(range(len(l))) AS i FROM s),
    k AS (SELECT doc_id, n, i, i || ':' || seg AS label, CASE WHEN n >= 40 AND i = 1 THEN 'move' WHEN i % 7 = 3 THEN 'change' WHEN i % 11 = 5 THEN 'drop' ELSE 'keep' END AS e FROM u),
    units AS (SELECT doc_id, 0 AS side, i AS a, 0 AS b, label AS seg, e = 'keep' AS m FROM k
        UNION ALL SELECT doc_id, 1, i, 0, label, true FROM k WHERE e = 'keep'
        UNION ALL SELECT doc_id, 1, i, 0, '≠' || i || '≠', false FROM k WHERE e = 'change'
        UNION ALL SELECT doc_id, 1, i, 1, '±' || i || '±', false FROM k WHERE e = 'keep' AND i % 13 = 6
        UNION ALL SELECT doc_id, 1, 14, 2, label, false FROM k WHERE e = 'move'),
    p AS (SELECT *, (sum(length(seg)) OVER w)::BIGINT AS upto, sum(m::INT) OVER w AS gap FROM units WINDOW w AS (PARTITION BY doc_id, side ORDER BY a, b)),
    t AS (SELECT doc_id, string_agg(seg, '' ORDER BY a, b) FILTER (side = 0) AS lw, string_agg(seg, '' ORDER BY a, b) FILTER (side = 1) AS rw,
        coalesce(sum(length(seg)) FILTER (side = 0 AND m), 0) AS same FROM units GROUP BY doc_id),
    b AS (SELECT doc_id, gap, {bounds} FROM p GROUP BY doc_id, gap HAVING count(*) FILTER (NOT m) > 0),
    d AS (SELECT b.*, lw, rw, substring(lw, lf + 1, lt - lf) AS lc, substring(rw, rf + 1, rt - rf) AS rc FROM b JOIN t USING (doc_id)),
    x AS (SELECT doc_id, count(*) AS n_diffs, string_agg(concat_ws('/', CASE WHEN rc = '' THEN 'delete' WHEN lc = '' THEN 'insert' ELSE 'replace' END, lf, rf, {around("l")}, {around("r")}), '|' ORDER BY lf, rf) AS diffs
        FROM d GROUP BY doc_id),
    y AS (SELECT doc_id, coalesce(length(lw), 0) AS left_len, coalesce(length(rw), 0) AS right_len, coalesce(same, 0) AS same FROM documents LEFT JOIN t USING (doc_id))
    SELECT y.doc_id, CASE WHEN left_len + right_len = 0 THEN 1.0 ELSE round(2 * same / (left_len + right_len), 6) END::DOUBLE AS ratio, left_len::BIGINT AS left_len, right_len::BIGINT AS right_len,
        coalesce(n_diffs, 0)::BIGINT AS n_diffs, coalesce(diffs, '') AS diffs, (SELECT count(*) FROM k WHERE k.doc_id = y.doc_id AND e = 'move')::BIGINT AS n_moves
    FROM y LEFT JOIN x ON x.doc_id = y.doc_id"""


@query("diff_known_edits", _sql_known_edits())
def diff_known_edits(t: Tables) -> DataFrame:
    """Every document against a copy with changed, dropped, added and moved segments: each edit with its surroundings."""
    cut = F.filter(F.transform(F.split("text", _CUT), drop_ws), lambda s: s != "")
    segs = t.documents.select("doc_id", F.coalesce(cut, F.array().cast("array<string>")).alias("l"))
    label = lambda s, i: F.concat(i.cast("string"), F.lit(":"), s)
    named = lambda mark, i: F.concat(F.lit(mark), i.cast("string"), F.lit(mark))
    none, moved, second = F.array().cast("array<string>"), F.size("l") >= 40, label(F.get("l", F.lit(1)), F.lit(1))

    def edited(s, i):
        kept = F.when(i % 13 == 6, F.array(label(s, i), named("±", i))).when(moved & (i == 14), F.array(label(s, i), second)).otherwise(F.array(label(s, i)))
        return F.when(moved & (i == 1), none).when(i % 7 == 3, F.array(named("≠", i))).when(i % 11 == 5, none).otherwise(kept)

    join = lambda a: F.array_join(a, "\n")
    left = segs.select("doc_id", join(F.transform("l", label)).alias("a"))
    right = segs.select("doc_id", join(F.flatten(F.transform("l", edited))).alias("b"))
    found = align_texts(left, right, ["doc_id"], "a", "b", normalize=False)
    told = F.transform("diffs", lambda d: F.concat_ws("/", d["op"], d["left_at"].cast("string"), d["right_at"].cast("string"), d["left_context"], d["right_context"]))
    return found.select(
        "doc_id", F.round("ratio", 6).alias("ratio"), "left_len", "right_len", F.size("diffs").cast("long").alias("n_diffs"), F.array_join(told, "|").alias("diffs"),
        F.size("moves").cast("long").alias("n_moves"),
    )
