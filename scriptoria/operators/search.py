"""Full-text and title search for batches of queries.

Whatever the size of the batch, texts meet queries by equi-joins: long texts by windows on their first characters,
titles and names by the first characters of each place, stored indexes by the rarest trigrams of a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, quote_regex, strip, text_windows
from ..functions.grams import count_trigrams
from ..functions.predicates import fold_ascii, match_text
from ..functions.text import escape_keep_mark, to_script
from ..session import broadcast_if_small, fits_broadcast, materialize
from .firstwins import top_k
from .joins import occurrences

K1, B, MIN_IDF = 1.2, 0.75, 1e-6


ANCHOR = 3  # characters of a needle that a place of a short text is looked up by


def _pairs(df: DataFrame, queries: DataFrame, probes, keep=("query",)) -> DataFrame:
    """Rows of ``df`` (short texts) once per query that one of the probes finds.

    A probe is (text, needles, mode). Every place of a text (``contains``; the first one for ``prefix``) is looked up by
    equality under its first characters, as many as the needles have and three at most, and the rest of the needle is
    compared where they meet. The needles are written once and measured: a small batch is broadcast, so that the places of
    the texts, many times the texts themselves, never leave their task; a larger one is joined by a shuffle. A query that
    several needles find counts at the first.
    """
    flat = [(i, text, n, mode) for i, (text, needles, mode) in enumerate(probes) for n in needles]
    needles = F.array(*[
        F.struct(F.lit(i).alias("probe"), F.lit(k).alias("nth"), F.coalesce(n, F.lit("")).alias("key")) for k, (i, _, n, _) in enumerate(flat)
    ])
    q = queries.select(*keep, F.explode(needles).alias("_k")).select(*keep, "_k.*").withColumn("anchor", F.left("key", F.lit(ANCHOR)))
    q = materialize(q, "needles")
    # At most four sizes of anchors a probe; a text of which no needle is looked for forms no places.
    sizes = sorted(tuple(r) for r in q.select("probe", F.length("anchor")).distinct().collect())
    if not sizes:
        return df.crossJoin(q.select(*keep)).filter(F.lit(False))

    def places(probe, size):
        c, mode = F.coalesce(probes[probe][0], F.lit("")), probes[probe][2]
        at = lambda i: F.struct(F.lit(probe).alias("probe"), i.cast("int").alias("at"), F.substring(c, i, F.lit(size)).alias("anchor"))
        last = F.lit(1) if mode == "prefix" or size == 0 else F.length(c) - size + 1  # the empty query is in every text
        return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), last), at))

    every = F.flatten(F.filter(F.array(*[places(*s) for s in sizes]), lambda p: p.isNotNull()))
    rows = df.withColumn("_k", F.explode(every)).select(*df.columns, "_k.*")
    hit = rows.join(F.broadcast(q) if fits_broadcast(q) else q.hint("merge"), ["probe", "anchor"])

    def found(i, text, mode):
        t = F.coalesce(text, F.lit(""))
        return (F.col("probe") == i) & (F.startswith(t, F.col("key")) if mode == "prefix" else F.position(F.col("key"), t) == F.col("at"))

    # A place counts only if it is the needle's first in the text.
    hit = hit.filter(reduce(lambda a, b: a | b, [found(i, text, mode) for i, (text, _, mode) in enumerate(probes)]))
    test = {"contains": F.contains, "prefix": F.startswith}
    earlier = F.lit(False)
    for k, (_, t, n, m) in enumerate(flat[:-1]):
        earlier = earlier | ((F.col("nth") > k) & F.coalesce(test[m](t, n), F.lit(False)))
    return hit.filter(~earlier).drop("probe", "nth", "at", "key", "anchor")


# -- index -----------------------------------------------------------------------------------------


def trigrams(col: Column | str) -> Column:
    return text_windows(col, 3, 3)


def build_trigram_index(content: DataFrame, doc: str, text: str, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """``postings(term, doc, tf)`` and ``doc_stats(doc, n_tokens)``.

    The rows of a document meet in one task, which counts its trigrams, so texts are shuffled and trigrams are not; with
    ``unique`` (a document is known to have one row) nothing is shuffled.
    """
    base = content.select(doc, F.lower(text).alias("_t"))
    together = base if unique else base.repartition(doc).sortWithinPartitions(doc)
    stats = base.select(doc, F.greatest(F.length("_t") - 2, F.lit(0)).cast("bigint").alias("n_tokens"))
    return count_trigrams(together, doc, "_t"), stats


def write_index(postings: DataFrame, path: str, doc: str, buckets: int = 64) -> None:
    """Store postings by term bucket, sorted by term so that a lookup reads few row groups.

    Files are cut by range of (bucket, term, doc): a hot term is split by document.
    """
    p = postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    p.repartitionByRange("bucket", "term", doc).sortWithinPartitions("bucket", "term").write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(path)


def candidates(postings: DataFrame, queries: DataFrame, doc: str, rarest: int = 3) -> DataFrame:
    """Documents that may hold a query of at least three characters.

    Only the rarest trigrams of each query are looked up, so the long posting lists of frequent
    trigrams are counted but never joined; the caller verifies the text, which keeps the result exact.
    A query with a trigram that no document has finds nothing.
    """
    q = queries.select("query", F.array_distinct(text_windows(F.lower("query"), 3, 3)).alias("_terms"))
    terms = q.select("query", F.size("_terms").alias("_need"), F.explode("_terms").alias("term"))
    on = ["term"]
    if "bucket" in postings.columns:
        terms = terms.withColumn("bucket", F.pmod(F.hash("term"), postings.select(F.max("bucket") + 1).scalar()))
        on = ["bucket", "term"]
    # The terms are measured once; everything joined with the postings is a subset of them.
    small = F.broadcast if fits_broadcast(terms) else (lambda side: side)
    sizes = (
        postings.join(small(terms.select(*on).distinct()), on, "left_semi")
        .groupBy(*on).agg(F.count(F.lit(1)).alias("_df"))
    )
    known = terms.join(sizes, on)
    whole = known.groupBy("query").agg(F.count(F.lit(1)).alias("_got"), F.first("_need").alias("_need")).filter("_got = _need")
    picked = top_k(known, ["query"], ["_df", "term"], rarest).join(whole.select("query"), "query", "left_semi")
    picked = picked.select("query", F.least("_need", F.lit(rarest)).alias("_need"), *on)
    hit = postings.join(small(picked), on)
    return (
        hit.groupBy("query", doc)
        .agg(F.count(F.lit(1)).alias("_got"), F.first("_need").alias("_need"))
        .filter(F.col("_got") == F.col("_need"))
        .select("query", doc)
    )


# -- scoring ---------------------------------------------------------------------------------------


def phrase_count(text: Column | str, needle: Column | str) -> Column:
    """Occurrences including overlapping ones (an index phrase matches at every position)."""
    t, n = as_col(text), as_col(needle)
    knotty = F.exists(F.sequence(F.lit(1), F.length(n) - 1), lambda i: F.left(n, i) == F.right(n, i))
    apart = ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("bigint")
    looked = F.regexp_count(t, F.concat(F.lit("(?="), quote_regex(n), F.lit(")"))).cast("bigint")
    return F.when(knotty, looked).otherwise(apart)


def bm25(tf: Column, n_tokens: Column, n_hits: Column, n_docs: Column, avg_tokens: Column) -> Column:
    """Okapi BM25, negated so that smaller is better."""
    idf = F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(MIN_IDF))
    return -(idf * tf * (K1 + 1)) / (tf + K1 * (1 - B + B * n_tokens / avg_tokens))


def snippet(text: Column | str, query: Column | str, width: int = 30) -> Column:
    """Window of ``width`` characters around the first match, matches marked, cut ends shown by an ellipsis."""
    t, q = as_col(text), as_col(query)
    at = F.position(F.lower(q), F.lower(t))
    start = F.greatest(F.lit(1), at - F.floor((F.lit(width) - F.length(q)) / 2).cast("int"))
    win = F.substring(t, start, F.greatest(F.lit(width), F.length(q)))
    size = F.greatest(F.lit(width), F.length(q))
    marked = F.regexp_replace(win, F.concat(F.lit("(?iu)"), quote_regex(q)), F.lit("<mark>$0</mark>"))
    return F.concat(
        F.when(start > 1, F.lit("…")).otherwise(F.lit("")),
        marked,
        F.when(start + size - 1 < F.length(t), F.lit("…")).otherwise(F.lit("")),
    )


def _verified(queries: str, width: int) -> Column:
    """Those of an array of queries that the text ``_text`` (``_low`` in lower case) holds, with count and snippet."""
    return F.transform(
        F.filter(queries, lambda q: F.contains(F.col("_low"), q["needle"])),
        lambda q: F.struct(
            q["query"].alias("query"),
            phrase_count(F.col("_low"), q["needle"]).alias("tf"),
            snippet(F.col("_text"), q["query"], width).alias("snippet"),
        ),
    ).alias("matches")


def _matches(content: DataFrame, queries: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """Documents with their length and the arrays of their matches; the text itself is dropped.

    Exactly one row of each document has ``is_doc`` set.
    """
    needle = queries.select("query", F.lower("query").alias("needle")).distinct()
    n_tokens = F.greatest(F.length(text) - 2, F.lit(0)).cast("bigint")
    hits = occurrences(content.select(doc, F.lower(text).alias("_low")), needle, doc, "_low", "needle", prefix=2)
    per_doc = hits.groupBy(doc, "query").agg(F.count(F.lit(1)).alias("tf"))
    texts = content.select(doc, F.col(text).alias("_text"), n_tokens.alias("n_tokens"))
    one = F.struct("query", "tf", snippet("_text", "query", width).alias("snippet"))
    found = texts.join(per_doc, doc).select(doc, "n_tokens", F.lit(False).alias("is_doc"), F.array(one).alias("matches"))
    every = texts.select(doc, "n_tokens", F.lit(True).alias("is_doc"), F.array().cast(found.schema["matches"].dataType).alias("matches"))
    return found.unionByName(every)


def search_fulltext(
    content: DataFrame,
    queries: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    k: int = 20,
    width: int = 30,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Top ``k`` documents per query (at least two characters, literal text) by BM25.

    With an ``index`` only candidate documents are verified; two-character queries, which have no
    trigram, are still answered by the scan. Matches are kept without their text, in a table that the
    three passes over them (hit counts, corpus size, ranking) share.
    """
    q = queries.select("query").filter(F.length(strip("query")) >= 2).distinct()
    if index is None:
        rows = materialize(_matches(content, q, doc, text, width), "matches")
        docs = rows.filter("is_doc")
    else:
        postings, docs = index
        long_q = q.filter(F.length("query") >= 3)
        cand = candidates(postings, long_q, doc).groupBy(doc).agg(
            F.collect_set(F.struct("query", F.lower("query").alias("needle"))).alias("_cand")
        )
        base = content.select(doc, F.col(text).alias("_text")).join(cand, doc).withColumn("_low", F.lower("_text"))
        verified = base.select(
            doc,
            F.greatest(F.length("_text") - 2, F.lit(0)).cast("bigint").alias("n_tokens"),
            F.lit(True).alias("is_doc"),
            _verified("_cand", width),
        )
        short_q = q.filter(F.length("query") == 2)
        scanned = _matches(content, short_q, doc, text, width).filter(F.size("matches") > 0)
        rows = materialize(verified.unionByName(scanned), "matches")
    size = docs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("avg")))
    hits = rows.select(doc, "n_tokens", F.inline("matches"))
    n_hits = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"))
    scored = (
        hits.join(n_hits, "query")
        .withColumn("_size", size.scalar())
        .withColumn(
            "score", F.round(bm25(F.col("tf"), F.col("n_tokens"), F.col("n_hits"), F.col("_size.n"), F.col("_size.avg")), 6)
        )
    )
    return top_k(scored, ["query"], ["score", doc], k, "rank").select("query", "rank", doc, "tf", "score", "snippet")


# -- titles ----------------------------------------------------------------------------------------


def search_titles(queries: DataFrame, catalog: DataFrame, k: int = 20, pairs=()) -> DataFrame:
    """Works whose id starts with a query or whose title holds it in either script, best ``k`` per query."""
    q = queries.select("query").distinct().withColumn("query_sc", to_script("query", list(pairs)))
    fold = fold_ascii
    probes = [(fold("sutra_id"), [fold("query")], "prefix"), (fold("title_sc"), [fold("query_sc")], "contains"), (fold("title"), [fold("query")], "contains")]
    hit = _pairs(catalog, q, probes, ("query", "query_sc"))
    rank = (
        F.when(match_text("sutra_id", F.col("query"), "prefix"), 0)
        .when(match_text("title_sc", F.col("query_sc"), "prefix"), 1)
        .otherwise(2)
    )
    hit = hit.withColumn("match_rank", rank).drop("query_sc")
    return top_k(hit, ["query"], ["match_rank", "sutra_id"], k, "rank")


def scan_titles(queries: DataFrame, catalog: DataFrame, k: int = 50, pairs=(), pos: str = "pos") -> DataFrame:
    """Degraded title search without an index: first ``k`` matches in catalogue order."""
    q = queries.select("query").distinct().withColumn("query_sc", to_script("query", list(pairs)))
    cat = catalog if "title_sc" in catalog.columns else catalog.withColumn("title_sc", to_script("title", list(pairs)))
    probes = [(F.upper("sutra_id"), [F.upper("query")], "prefix"), (F.lower("title"), [F.lower("query")], "contains"), (F.col("title_sc"), [F.col("query_sc")], "contains")]
    hit = _pairs(cat, q, probes, ("query", "query_sc")).drop("query_sc")
    return top_k(hit, ["query"], [pos], k, "rank")


def search_works(
    queries: DataFrame, catalog: DataFrame, k: int = 20, to_tc=(), to_sc=(), pos: str = "pos"
) -> DataFrame:
    """Works whose id holds the query, or whose title holds it in either script, with their volume count."""
    trimmed = strip("query")
    q = queries.select("query").distinct().select(
        "query", F.upper(trimmed).alias("u"), F.lower(to_script(trimmed, list(to_tc))).alias("tc"),
        F.lower(to_script(trimmed, list(to_sc))).alias("sc"),
    )
    probes = [(F.upper("sutra_id"), [F.col("u")], "contains"), (F.lower("title"), [F.col("tc"), F.col("sc")], "contains")]
    hit = _pairs(catalog, q, probes, ("query", "u", "tc", "sc"))
    return top_k(hit, ["query"], [pos], k, "rank").select("query", "rank", "sutra_id", "title", "total_juan")


def search_persons(queries: DataFrame, persons: DataFrame, k: int = 20, pairs=()) -> DataFrame:
    """Persons by name, alias or place: exact name, then name prefix, then place, then the rest."""
    q = queries.select("query").distinct().withColumn("query_t", to_script("query", list(pairs)))
    cols = ["name", "aliases", "place_origin"]
    p = persons.select("*", *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in cols])

    def either(x, test):
        return test(x["query"]) | test(x["query_t"])

    probes = [(fold_ascii(f"_{c}"), [fold_ascii(n) for n in ("query", "query_t")], "contains") for c in cols]
    hit = _pairs(p, q, probes, ("query", "query_t"))
    row = {"query": F.col("query"), "query_t": F.col("query_t")}
    rank = (
        F.when(either(row, lambda s: F.col("_name") == s), 0)
        .when(either(row, lambda s: match_text("_name", s, "prefix")), 1)
        .when(either(row, lambda s: match_text("_place_origin", s)), 2)
        .otherwise(3)
    )
    hit = hit.withColumn("match_rank", rank).drop("query_t", *[f"_{c}" for c in cols])
    return top_k(hit, ["query"], ["match_rank", F.col("birth_year").asc_nulls_first(), "person_id"], k, "rank")


def attach_catalog(hits: DataFrame, catalog: DataFrame, key: str = "sutra_id") -> DataFrame:
    return hits.join(broadcast_if_small(catalog), key)


def search(
    queries: DataFrame,
    catalog: DataFrame,
    content: DataFrame | None = None,
    lang: str = "tc",
    to_sc=(),
    to_tc=(),
    k: int = 20,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Title section first, then the full-text section; without ``content`` only titles are searched.

    ``content`` has ``sutra_id``, ``juan`` and ``plain_text_sc``. Snippets and titles come back in the
    reader's script, with markup escaped except for the highlight.
    """
    title = F.col("title_sc") if lang == "sc" else F.col("title")
    blank = F.lit(None).cast("string")
    titles = search_titles(queries, catalog, k, to_sc) if content is not None else scan_titles(queries, catalog, 50, to_sc)
    out = titles.select(
        "query", F.lit("title").alias("section"), "rank", "sutra_id", title.alias("title"),
        F.coalesce("author", F.lit("")).alias("author"), F.lit(None).cast("int").alias("juan"), blank.alias("snippet"),
    )
    if content is None:
        return out
    q = queries.select(to_script("query", list(to_sc)).alias("query"), F.col("query").alias("_q"))
    keyed = content.select("sutra_id", "juan", "plain_text_sc", F.struct("sutra_id", "juan").alias("_doc"))
    found = search_fulltext(keyed, q, "_doc", "plain_text_sc", k, index=index).join(q, "query")
    shown = F.col("snippet") if lang == "sc" else to_script("snippet", list(to_tc))
    full = attach_catalog(found.withColumn("sutra_id", F.col("_doc.sutra_id")), catalog).select(
        F.col("_q").alias("query"), F.lit("fulltext").alias("section"), "rank", "sutra_id", title.alias("title"),
        F.coalesce("author", F.lit("")).alias("author"), F.col("_doc.juan").cast("int").alias("juan"),
        escape_keep_mark(shown).alias("snippet"),
    )
    return out.unionByName(full)
