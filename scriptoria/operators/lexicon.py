"""Dictionaries: build, sense flattening, batch lookup, definition search and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, null_if_empty, strip, text_or_empty
from ..functions.predicates import drop_junk_terms
from ..functions.text import strip_tags, to_script
from ..session import broadcast_if_small
from .firstwins import keep_first
from .joins import join_any_form

SENSE_MARKS = "❶❷❸❹❺❻❼❽❾❿"
QUOTE_LEAD = "\n　　" + chr(0x1F4D6) + " "
EXAMPLE_LEAD = "\n　　例："


def reading_texts(heteronyms: Column | str, clean: bool = False) -> Column:
    """One text per reading: reading marks, then numbered senses with quotations and examples.

    A sense without definition still uses up its number; ``clean`` removes tags from definitions.
    """
    marks = F.array(*[F.lit(m) for m in SENSE_MARKS])

    def sense(d: Column, i: Column) -> Column:
        text = strip(strip_tags(d["def"])) if clean else d["def"]
        number = F.when(i < len(SENSE_MARKS), F.get(marks, i)).otherwise(F.concat(F.lit("("), i + 1, F.lit(")")))
        extra = F.concat(
            F.array_join(F.transform(F.coalesce(d["quote"], F.array()), lambda q: F.concat(F.lit(QUOTE_LEAD), q)), ""),
            F.array_join(F.transform(F.coalesce(d["example"], F.array()), lambda e: F.concat(F.lit(EXAMPLE_LEAD), e)), ""),
        )
        return F.when(text_or_empty(text) != "", F.concat(number, F.lit(" "), text, extra))

    def reading(h: Column) -> Column:
        marks_text = F.concat_ws(" / ", null_if_empty(h["bopomofo"]), null_if_empty(h["pinyin"]))
        head = F.when(marks_text != "", F.concat(F.lit("【"), marks_text, F.lit("】")))
        senses = F.transform(F.coalesce(h["definitions"], F.array()), sense)
        return F.array_join(F.filter(F.concat(F.array(head), senses), lambda x: x.isNotNull()), "\n")

    return F.filter(F.transform(F.coalesce(as_col(heteronyms), F.array()), reading), lambda x: x != "")


def flatten_senses(heteronyms: Column | str) -> Column:
    """All readings of an entry as one text, separated by blank lines."""
    return F.array_join(reading_texts(heteronyms, clean=True), "\n\n")


def build_dictionary(raw: DataFrame, meta: DataFrame, to_tc=(), to_sc=()) -> tuple[DataFrame, DataFrame]:
    """``entries`` with keys in both scripts and ``dictionaries`` with their number of valid entries.

    ``raw`` has dict_id, pos, term, definition; ``meta`` has dict_id, name, source, char_type, license.
    """
    clean = drop_junk_terms(raw)
    entries = clean.select(
        F.xxhash64("dict_id", "pos", "term").alias("id"), "dict_id", "pos", "term",
        to_script("term", list(to_tc)).alias("term_tc"), to_script("term", list(to_sc)).alias("term_sc"), "definition",
    )
    counts = entries.groupBy("dict_id").agg(F.count(F.lit(1)).alias("entry_count"))
    dictionaries = meta.join(counts, "dict_id", "left").withColumn(
        "entry_count", F.coalesce("entry_count", F.lit(0).cast("bigint"))
    )
    return entries, dictionaries


def dedupe_lookup(df: DataFrame, keys=("query", "dict_id", "term"), order=None) -> DataFrame:
    """First sense per (query, dictionary, term), best dictionary first."""
    return keep_first(df, list(keys), order or [F.col("entry_count").desc(), "dict_id", "pos"])


def lookup(
    keys: DataFrame, entries: DataFrame, dictionaries: DataFrame, user: DataFrame | None = None, dedupe: bool = True
) -> DataFrame:
    """Look a batch of words up in all dictionaries; user entries match the raw word and come last.

    ``keys`` has the column ``query``. With ``dedupe`` a dictionary shows one sense per term.
    """
    q = keys.select("query").distinct()
    d = broadcast_if_small(dictionaries.select("dict_id", F.col("name").alias("dict_name"), "char_type", "entry_count"))
    hits = join_any_form(q, entries, "query", ["term_tc", "term_sc", "term"]).join(d, "dict_id")
    cols = ["query", "dict_id", "dict_name", "char_type", "entry_count", "term", "pos", "definition"]
    found = hits.select(*cols, F.lit(0).alias("origin"))
    if user is not None:
        u = q.join(user, q["query"] == user["term"])
        blank = F.lit(None)
        found = found.unionByName(
            u.select(
                "query", "dict_id", F.col("dict_id").alias("dict_name"), blank.cast("string").alias("char_type"),
                blank.cast("bigint").alias("entry_count"), "term", F.col("pos"), "definition", F.lit(1).alias("origin"),
            )
        )
    order = ["origin", F.col("entry_count").desc_nulls_last(), "dict_id", "pos"]
    return keep_first(found, ["query", "dict_id", "term"], order) if dedupe else found


def list_dictionaries(dictionaries: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """All dictionaries with provenance; user dictionaries count their distinct terms."""
    out = dictionaries.select("dict_id", "name", "entry_count", F.lit("builtin").alias("origin"))
    if user is None:
        return out
    mine = user.groupBy("dict_id").agg(F.count_distinct("term").alias("entry_count"))
    return out.unionByName(
        mine.select("dict_id", F.col("dict_id").alias("name"), "entry_count", F.lit("user").alias("origin"))
    )


def word_tokens(col: Column | str) -> Column:
    return F.filter(F.split(F.lower(as_col(col)), r"[^\p{L}\p{N}\p{Mn}]+"), lambda w: w != "")


def search_definitions(entries: DataFrame, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """Entries whose term and definition hold every word of a query."""
    q = queries.select("query", F.array_distinct(word_tokens("query")).alias("_w")).filter(F.size("_w") > 0)
    need = broadcast_if_small(q.select("query", F.size("_w").alias("_need"), F.explode("_w").alias("_token")))
    tokens = entries.select(
        id_col, F.explode(F.array_distinct(word_tokens(F.concat_ws(" ", "term", "definition")))).alias("_token")
    )
    return (
        tokens.join(need, "_token")
        .groupBy("query", id_col)
        .agg(F.count(F.lit(1)).alias("_got"), F.first("_need").alias("_need"))
        .filter(F.col("_got") == F.col("_need"))
        .select("query", id_col)
    )


def dictionary_quality(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Quality counts per dictionary: size against metadata, empty, short and badly encoded entries."""
    term, definition = text_or_empty("term"), text_or_empty("definition")
    n = F.length(definition)
    bad = F.lit(chr(0xFFFD))
    stats = entries.groupBy("dict_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(strip(term) == "").alias("empty_terms"),
        F.count_if(strip(definition) == "").alias("empty_defs"),
        F.count_if((n > 0) & (n < 5)).alias("short_defs"),
        F.count_if(F.contains(F.concat(term, definition), bad)).alias("encoding_issues"),
        F.avg(n).alias("avg_def_length"),
        F.max(n).alias("max_def_length"),
        F.min(n).alias("min_def_length"),
    )
    out = stats.join(broadcast_if_small(meta.select("dict_id", "meta_count")), "dict_id", "left")
    return out.withColumn("count_mismatch", F.col("entry_count") != F.coalesce("meta_count", F.lit(0))).withColumn(
        "many_short", F.col("short_defs") > F.col("entry_count") * 0.1
    )


def must_have_terms(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """For each required term, in how many dictionaries it is a head-word."""
    found = (
        entries.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
        .select("term", "dict_id")
        .distinct()
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_dicts"))
    )
    return (
        terms.select("term")
        .distinct()
        .join(found, "term", "left")
        .select("term", F.coalesce("n_dicts", F.lit(0)).alias("n_dicts"), F.col("n_dicts").isNotNull().alias("found"))
    )


def lexicon_profile(raw: DataFrame) -> DataFrame:
    """One row: entries by head-word length, with reading, definition, stroke count, or malformed."""
    n = F.length(text_or_empty("title"))
    hets = F.coalesce("heteronyms", F.array())
    return raw.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(n == 1).alias("one_char"),
        F.count_if(n == 2).alias("two_chars"),
        F.count_if((n != 1) & (n != 2)).alias("longer"),
        F.count_if(F.exists(hets, lambda h: text_or_empty(h["bopomofo"]) != "")).alias("with_reading"),
        F.count_if(
            F.exists(hets, lambda h: F.exists(F.coalesce(h["definitions"], F.array()), lambda d: text_or_empty(d["def"]) != ""))
        ).alias("with_definition"),
        F.count_if(F.coalesce("stroke_count", F.lit(0)) > 0).alias("with_strokes"),
        F.count_if(F.col("title").rlike("[{}]")).alias("malformed"),
    )


def radical_counts(raw: DataFrame) -> DataFrame:
    return raw.filter(text_or_empty("radical") != "").groupBy("radical").agg(F.count(F.lit(1)).alias("n"))
