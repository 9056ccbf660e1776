"""Queries over marked-up volumes that Spark derives from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import let
from ..functions.text import escape_html
from ..operators import catalog as K
from ..operators import census
from ..operators import extract as X
from ..operators import quality as Q
from ..operators.firstwins import carry_forward, keep_first, keep_last, next_sibling, number_rows, runs
from ..session import materialize, scratch_path
from ..sinks import render as R
from ..sinks.tables import read_table, write_corpus
from ..sources.markup import attr, starts
from .corpus import build_tables, parse_corpus
from .registry import Tables, query

LINES_PER_VOLUME = 10


def tei_documents(t: Tables) -> DataFrame:
    """Each document as a marked-up volume file.

    Ten lines make a volume. Every line has a line mark; a line of at most 60 characters is a heading
    mark, other lines are paragraphs whose first word carries an apparatus entry; a long line is
    followed by a note pair.
    """
    lines = F.split(F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " "), "\n")
    d = t.documents.withColumn("_lines", lines)

    def line(s, i):
        return let(escape_html(s), lambda esc: let(F.substring_index(esc, " ", 1), lambda word: marked(s, esc, word, i)))

    def marked(s, esc, word, i):
        rest = F.substring(esc, F.length(word) + 1, F.length(esc))
        app = F.concat(
            F.lit('<app n="'), i + 1, F.lit('" from="#l'), i + 1, F.lit('"><lem>'), word, F.lit('</lem><rdg wit="A">'), F.lit("~"), word,
            F.lit('</rdg><rdg wit="B">x</rdg></app>'),
        )
        note = F.when(
            F.length(s) > 400,
            F.concat(F.lit('<note n="'), i + 1, F.lit('" type="mod" place="foot">'), F.length(s), F.lit("<note place=\"inline\">in</note></note>")),
        ).otherwise(F.lit(""))
        mark = F.when(i % LINES_PER_VOLUME == 0, F.concat(F.lit('<milestone unit="juan" n="'), (i / LINES_PER_VOLUME + 1).cast("int"), F.lit('"/>')))
        return F.concat(
            F.coalesce(mark, F.lit("")), F.lit('<lb n="'), i + 1, F.lit('"/>'),
            F.when(F.length(s) <= 60, F.concat(F.lit('<mulu level="'), F.length(s) % 4, F.lit('" type="h">'), esc, F.lit("</mulu>")))
            .otherwise(F.concat(note, F.lit("<p>"), app, rest, F.lit("</p>"))),
        )

    body = F.array_join(F.transform("_lines", line), "")
    number = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    head = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="'), F.upper("lang"),
        F.lpad(F.regexp_extract("source", r"(\d+)", 1), 2, "0"), F.lit("n"), number,
        F.lit('"><teiHeader><titleStmt><title level="m" xml:lang="zh-Hant">'), "source", F.lit(" "), "lang",
        F.lit("</title><author> by "), "source", F.lit(" </author></titleStmt><extent>"), F.size("_lines"),
        F.lit(" lines</extent></teiHeader><text><body>"),
    )
    return d.select(number.alias("doc_path"), F.concat(head, body, F.lit("</body></text></TEI>")).alias("content"))


_PARSED: dict[tuple, DataFrame] = {}


def parsed(t: Tables) -> DataFrame:
    """The event table of the documents, parsed and written once for the same files (folder, time and size of each)."""
    files = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    stamp = files.distinct().agg(F.expr("bit_xor(xxhash64(file_path, file_modification_time, file_size))"), F.count(F.lit(1))).first()
    key = (t.spark.sparkContext.applicationId, t.sf_dir, *stamp)
    if key not in _PARSED:
        _PARSED[key] = parse_corpus(tei_documents(t))
    return _PARSED[key]


_SQL_LINES = """
clean AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g'), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, lang, upper(lang) || lpad(doc_id::VARCHAR, 7, '0') AS sutra_id, unnest(ls) AS s, unnest(range(1, len(ls) + 1)) AS i FROM clean),
marked AS (SELECT *, (i - 1) // 10 + 1 AS juan, split_part(s, ' ', 1) AS word, length(s) <= 60 AS is_head FROM lines)
"""
_STRIP = "regexp_replace({}, '^[\\s\\x{{A0}}\\x{{3000}}\\x{{2028}}\\x{{85}}\\x0B\\x1C-\\x1F]+|[\\s\\x{{A0}}\\x{{3000}}\\x{{2028}}\\x{{85}}\\x0B\\x1C-\\x1F]+$', '', 'g')"


@query(
    "corpus_catalog",
    f"""
    WITH {_SQL_LINES}
    SELECT upper(lang) || lpad(doc_id::VARCHAR, 7, '0') AS sutra_id, upper(lang) AS canon,
      lpad(regexp_extract(source, '(\\d+)', 1), 2, '0') AS volume, source || ' ' || lang AS title, 'by ' || source AS author,
      len(ls) AS total_juan FROM clean
    """,
)
def corpus_catalog(t: Tables) -> DataFrame:
    return build_tables(parsed(t))["catalog"].select("sutra_id", "canon", "volume", "title", "author", "total_juan")


@query(
    "corpus_content",
    f"""
    WITH {_SQL_LINES}
    SELECT sutra_id, juan, coalesce(string_agg(CASE WHEN NOT is_head THEN s END, '' ORDER BY i), '') AS plain_text
    FROM marked GROUP BY ALL
    """,
)
def corpus_content(t: Tables) -> DataFrame:
    return build_tables(parsed(t))["content"].select("sutra_id", "juan", "plain_text")


@query(
    "corpus_notes",
    f"""
    WITH {_SQL_LINES}, n AS (SELECT * FROM marked WHERE length(s) > 400)
    SELECT sutra_id, juan, i::VARCHAR AS line_id, 'mod' AS note_type, 'foot' AS place, length(s)::VARCHAR AS content FROM n
    UNION ALL SELECT sutra_id, juan, i::VARCHAR, '', 'inline', 'in' FROM n
    """,
)
def corpus_notes(t: Tables) -> DataFrame:
    n = build_tables(parsed(t))["notes"]
    return n.select("sutra_id", "juan", "line_id", "note_type", "place", "content")


@query(
    "corpus_toc",
    f"""
    WITH {_SQL_LINES}, h AS (SELECT sutra_id, juan, length(s) % 4 AS level, 'h' AS type, {_STRIP.format("s")} AS title FROM marked WHERE is_head)
    SELECT * FROM h WHERE title <> ''
    """,
)
def corpus_toc(t: Tables) -> DataFrame:
    return build_tables(parsed(t))["toc"].select("sutra_id", "juan", "level", "type", "title")


@query(
    "corpus_apparatus",
    f"""
    WITH {_SQL_LINES}
    SELECT sutra_id, juan, '#l' || i AS line_id, {_STRIP.format("word")} AS lem_text,
      'A=' || {_STRIP.format("'~' || word")} || '|B=x' AS readings FROM marked WHERE NOT is_head
    """,
)
def corpus_apparatus(t: Tables) -> DataFrame:
    a = build_tables(parsed(t))["apparatus"]
    shown = F.array_join(F.transform("readings", lambda r: F.concat_ws("=", r["wit"], r["text"])), "|")
    return a.select("sutra_id", "juan", "line_id", "lem_text", shown.alias("readings"))


@query(
    "note_classes",
    f"""
    WITH {_SQL_LINES}, n AS (SELECT * FROM marked WHERE length(s) > 400)
    SELECT sutra_id, juan, i::VARCHAR AS n, 'mod' AS note_class, row_number() OVER (PARTITION BY sutra_id, juan ORDER BY i) AS note_idx FROM n
    UNION ALL SELECT sutra_id, juan, '', 'transparent', NULL FROM n
    """,
)
def note_classes(t: Tables) -> DataFrame:
    pos = parsed(t)
    n = X.classify_notes(pos).join(X.doc_works(pos), "doc_path")
    return n.select("sutra_id", "juan", "n", "note_class", "note_idx")


@query(
    "note_census",
    f"""
    WITH {_SQL_LINES}, c AS (SELECT count(*) AS n FROM marked WHERE length(s) > 400)
    SELECT 'combination' AS grouping, 'mod' AS type, 'foot' AS place, 'body' AS parent, 'yes' AS has_n, n FROM c
    UNION ALL SELECT 'combination', '', 'inline', 'note', 'no', n FROM c
    UNION ALL SELECT 'type', 'mod', NULL, NULL, NULL, n FROM c
    UNION ALL SELECT 'place', NULL, 'foot', NULL, NULL, n FROM c UNION ALL SELECT 'place', NULL, 'inline', NULL, NULL, n FROM c
    UNION ALL SELECT 'parent', NULL, NULL, 'body', NULL, n FROM c UNION ALL SELECT 'parent', NULL, NULL, 'note', NULL, n FROM c
    """,
)
def note_census(t: Tables) -> DataFrame:
    return census.note_census(parsed(t))


@query(
    "child_patterns",
    f"""
    WITH {_SQL_LINES}, k AS (
      SELECT i, CASE WHEN i % 10 = 1 THEN 'milestone,' ELSE '' END || 'lb,' ||
        CASE WHEN is_head THEN 'mulu' WHEN length(s) > 400 THEN 'note,p' ELSE 'p' END AS x, doc_id FROM marked),
    b AS (SELECT string_agg(x, ',' ORDER BY i) AS children FROM k GROUP BY doc_id)
    SELECT children, count(*) AS n FROM b GROUP BY children ORDER BY n DESC, children LIMIT 30
    """,
)
def child_patterns(t: Tables) -> DataFrame:
    return census.child_patterns(parsed(t), "body")


@query(
    "reconcile_counts",
    f"""
    WITH {_SQL_LINES}
    SELECT sutra_id, max(juan) AS juans, 2 * count(CASE WHEN length(s) > 400 THEN 1 END) AS notes,
      count(CASE WHEN NOT is_head THEN 1 END) AS apps, count(CASE WHEN is_head THEN 1 END) AS toc_entries,
      CASE WHEN count(CASE WHEN is_head THEN 1 END) = count(CASE WHEN is_head AND {_STRIP.format("s")} <> '' THEN 1 END)
        THEN 'pass' ELSE 'fail' END AS status
    FROM marked GROUP BY sutra_id
    """,
)
def reconcile_counts(t: Tables) -> DataFrame:
    """Tags counted in the files as text against the tables as they are read back after a load."""
    path = scratch_path(t.spark, "reconcile")
    tables = build_tables(parsed(t))
    names = ("content", "notes", "apparatus", "toc")
    write_corpus({n: tables[n].withColumn("canon", F.substring("sutra_id", 1, 2)) for n in names}, path)
    stored = [read_table(t.spark, path, n) for n in names]
    works = X.doc_works(parsed(t))
    got = Q.reconcile_counts(Q.raw_counts(tei_documents(t), works), Q.table_counts(*stored), "sutra_id", ["juans", "notes", "apps", "toc_entries"])
    return got.select("sutra_id", *[F.col(f"{m}_source").alias(m) for m in ("juans", "notes", "apps", "toc_entries")], "status")


@query(
    "render_volumes",
    f"""
    WITH {_SQL_LINES}
    SELECT sutra_id, juan, string_agg(CASE WHEN is_head THEN '<a class=''mulu''>' || s || '</a>' ELSE
      CASE WHEN length(s) > 400 THEN '<span class=''note-inline''>（' || length(s) || '<span class=''note-inline''>（in）</span>）</span>' ELSE '' END
      || '<p>' || s || '</p>' END, '' ORDER BY i) AS rendered
    FROM marked GROUP BY ALL
    """,
)
def render_volumes(t: Tables) -> DataFrame:
    pos = parsed(t)
    return R.render(pos, "html").join(X.doc_works(pos), "doc_path").select("sutra_id", "juan", "rendered")


@query(
    "catalog_full",
    f"""
    WITH {_SQL_LINES}, v AS (SELECT sutra_id, juan, sum(CASE WHEN is_head THEN 0 ELSE length(s) END) AS c FROM marked GROUP BY ALL),
    w AS (SELECT sutra_id, count(*) AS juan_count, sum(c)::BIGINT AS total_chars FROM v GROUP BY sutra_id),
    h AS (SELECT sutra_id, count(*) AS toc_entries FROM marked WHERE is_head AND {_STRIP.format("s")} <> '' GROUP BY sutra_id)
    SELECT sutra_id, juan_count, total_chars, coalesce(toc_entries, 0) AS toc_entries, juan_count AS nav_juans,
      CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE '' END AS bu_lei
    FROM w LEFT JOIN h USING (sutra_id) LEFT JOIN labels ON substring(sutra_id, 3)::BIGINT = labels.doc_id
    """,
)
def catalog_full(t: Tables) -> DataFrame:
    return _catalog_full(t).select("sutra_id", "juan_count", "total_chars", "toc_entries", "nav_juans", "bu_lei")


def _catalog_full(t: Tables) -> DataFrame:
    tab = build_tables(parsed(t))
    for name in ("catalog", "sizes"):  # read twice each
        tab[name] = materialize(tab[name], name)
    bulei = t.labels.join(tab["catalog"].select("sutra_id", F.col("doc_path").cast("bigint").alias("doc_id")), "doc_id").select(
        "sutra_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("bu_lei")
    )
    return K.catalog_full(K.catalog_stats(tab["catalog"], tab["sizes"]), tab["toc"], tab["sizes"].select("sutra_id"), bulei)


@query(
    "rollup_catalog",
    f"""
    WITH {_SQL_LINES}, v AS (SELECT doc_id, lang, juan, sum(CASE WHEN is_head THEN 0 ELSE length(s) END) AS c FROM marked GROUP BY ALL),
    w AS (SELECT doc_id, lang, count(*) AS vols, sum(c) AS chars FROM v GROUP BY ALL),
    x AS (SELECT CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE '(未分類)' END AS b, upper(lang) AS l, vols, chars
          FROM w LEFT JOIN labels USING (doc_id))
    SELECT CASE WHEN grouping(b) = 0 THEN 'bu_lei' WHEN grouping(l) = 0 THEN 'category' ELSE 'total' END AS level,
      coalesce(b, l, '') AS label, count(*) AS works, sum(vols)::BIGINT AS volumes, sum(chars)::BIGINT AS chars
    FROM x GROUP BY GROUPING SETS ((b), (l), ())
    """,
)
def rollup_catalog(t: Tables) -> DataFrame:
    return K.rollup_catalog(_catalog_full(t).withColumn("category", F.col("canon")))


@query(
    "index_pages",
    """
    SELECT 'canon' AS kind, upper(lang) || '/' || lpad(regexp_extract(source, '(\\d+)', 1), 2, '0') AS page, count(*) AS n_works
    FROM documents GROUP BY ALL
    UNION ALL
    SELECT 'category', CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' ELSE upper(lang) END, count(*)
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL
    """,
)
def index_pages(t: Tables) -> DataFrame:
    full = _catalog_full(t)
    canons = t.documents.select(F.upper("lang").alias("canon"), F.lit("").alias("title_zh")).distinct()
    pages = R.build_indexes(R.work_category(full.drop("bu_lei"), full.select("sutra_id", "bu_lei"), canons))
    return pages.groupBy("kind", "page").agg(F.max("n_works").alias("n_works"))


@query(
    "header_fields",
    """
    SELECT doc_id, source || ' ' || lang AS title_zh, 'by ' || source AS author,
      len(string_split(text, chr(10))) || ' lines' AS extent FROM documents
    """,
)
def header_fields(t: Tables) -> DataFrame:
    h = X.extract_header(parsed(t))
    return h.select(F.col("doc_path").cast("bigint").alias("doc_id"), "title_zh", "author", "extent")


@query(
    "line_numbers",
    f"WITH {_SQL_LINES} SELECT doc_id, i AS seq, i::VARCHAR AS n, CASE WHEN is_head THEN 'mulu' WHEN length(s) > 400 THEN 'note' ELSE 'p' END AS next_tag FROM marked",
)
def line_numbers(t: Tables) -> DataFrame:
    body = starts(parsed(t)).filter(F.col("region") == "body").select("doc_path", "parent_id", F.col("seq").alias("at"), "tag", attr("n").alias("n"))
    body = body.repartition("doc_path")  # one shuffle of the columns that count for both windows; a key is one file
    sib = next_sibling(body, ["doc_path", "parent_id"], ["at"], ["tag"]).filter("tag = 'lb'")
    out = number_rows(sib, ["doc_path"], ["at"], "seq")
    return out.select(F.col("doc_path").cast("bigint").alias("doc_id"), "seq", "n", "next_tag")


# -- first wins, carry forward, runs ---------------------------------------------------------------


@query(
    "first_and_last",
    """
    SELECT * FROM (
      SELECT o_custkey, 'first' AS which, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders
      UNION ALL
      SELECT o_custkey, 'last', o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders)
    WHERE r = 1
    """,
)
def first_and_last(t: Tables) -> DataFrame:
    order = ["o_orderdate", "o_orderkey"]
    first = keep_first(t.orders, ["o_custkey"], order).select("o_custkey", F.lit("first").alias("which"), "o_orderkey")
    last = keep_last(t.orders, ["o_custkey"], order).select("o_custkey", F.lit("last").alias("which"), "o_orderkey")
    return first.unionByName(last).withColumn("r", F.lit(1))


@query(
    "carry_forward",
    """
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events
    """,
)
def carry(t: Tables) -> DataFrame:
    errors = F.when(F.col("event_type") == "error", F.col("value"))
    return carry_forward(t.events, ["user_id"], "event_id", errors, "last_error", chunk=100_000).select("event_id", "user_id", "last_error")


@query(
    "runs",
    """
    WITH f AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS hit FROM events),
    p AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY user_id ORDER BY event_id), false) AS prev FROM f),
    s AS (SELECT *, last_value(CASE WHEN hit AND NOT prev THEN event_id END IGNORE NULLS)
            OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run_start FROM p)
    SELECT user_id, run_start, count(*) AS n_rows, max(event_id) AS run_end FROM s WHERE hit GROUP BY ALL
    """,
)
def run_lengths(t: Tables) -> DataFrame:
    r = runs(t.events, ["user_id"], "event_id", F.col("event_type").isin("view", "click"), chunk=100_000)
    return r.groupBy("user_id", "run_start").agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_id").alias("run_end"))


def back_documents(t: Tables) -> DataFrame:
    """Each document as a file of volumes of ten lines whose apparatus stands in the back matter, tied to anchors."""
    clean = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " ")
    lines = F.split(clean, "\n")

    def line(s, i):
        mark = F.when(i % LINES_PER_VOLUME == 0, F.concat(F.lit('<milestone unit="juan" n="'), (i / LINES_PER_VOLUME + 1).cast("int"), F.lit('"/>')))
        note = F.when(F.length(s) > 400, F.concat(F.lit('<note type="mod" n="'), i % LINES_PER_VOLUME + 1, F.lit('">'), F.length(s), F.lit("</note>")))
        return F.concat(F.coalesce(mark, F.lit("")), F.lit('<p><anchor xml:id="a'), i, F.lit('"/>'), F.coalesce(note, F.lit("")), escape_html(s), F.lit("</p>"))

    def app(s, i):
        return F.concat(F.lit('<app from="#a'), i, F.lit('" n="'), i % LINES_PER_VOLUME + 1, F.lit('"><lem>'), F.length(s), F.lit("</lem></app>"))

    number = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    head = F.concat(F.lit('<TEI xml:id="T01n'), number, F.lit('"><text><body>'))
    content = F.concat(head, F.array_join(F.transform(lines, line), ""), F.lit("</body><back>"), F.array_join(F.transform(lines, app), ""), F.lit("</back></text></TEI>"))
    return t.documents.select(number.alias("doc_path"), content.alias("content"))


@query(
    "apparatus_back",
    f"WITH {_SQL_LINES} SELECT doc_id, juan, ((i - 1) % 10 + 1)::VARCHAR AS n, length(s)::VARCHAR AS lem_text FROM marked",
)
def apparatus_back(t: Tables) -> DataFrame:
    found = X.extract_apparatus(parse_corpus(back_documents(t)))
    return found.select(F.col("doc_path").cast("bigint").alias("doc_id"), "juan", "n", "lem_text")


@query(
    "apparatus_notes",
    f"""
    WITH {_SQL_LINES}, k AS (SELECT doc_id, juan, (i - 1) % 10 + 1 AS n, length(s) AS z FROM marked),
    v AS (SELECT doc_id, n, count(*) AS c, max(z) AS z FROM k WHERE z > 400 GROUP BY ALL)
    SELECT k.doc_id, k.juan, k.n::VARCHAR AS n, (CASE WHEN k.z > 400 THEN k.z WHEN v.c = 1 THEN v.z END)::VARCHAR AS note_text FROM k LEFT JOIN v USING (doc_id, n)
    """,
)
def apparatus_notes(t: Tables) -> DataFrame:
    pos = parse_corpus(back_documents(t))
    found = X.link_apparatus_notes(X.extract_apparatus(pos), X.classify_notes(pos))
    return found.select(F.col("doc_path").cast("bigint").alias("doc_id"), "juan", "n", "note_text")


@query(
    "load_twice",
    f"""
    WITH {_SQL_LINES}
    SELECT sutra_id, juan, CASE WHEN (sutra_id LIKE '%0') THEN 'again' ELSE coalesce(string_agg(CASE WHEN NOT is_head THEN s END, '' ORDER BY i), '') END AS plain_text
    FROM marked GROUP BY sutra_id, juan
    """,
)
def load_twice(t: Tables) -> DataFrame:
    """All works are loaded, then those whose number ends in 0 once more with another text, and the table read back."""
    path = scratch_path(t.spark, "load")
    content = build_tables(parsed(t))["content"].select("sutra_id", F.substring("sutra_id", 1, 2).alias("canon"), "juan", "plain_text")
    write_corpus({"content": content}, path)
    write_corpus({"content": content.filter(F.endswith("sutra_id", F.lit("0"))).withColumn("plain_text", F.lit("again"))}, path)
    return read_table(t.spark, path, "content").select("sutra_id", "juan", "plain_text")
