"""Audits: count reconciliation, edition comparison, leaks, schema checks, assets, coverage, profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.compat import as_col
from ..functions.text import drop_ws, normalize_for_compare
from ..sources.markup import attr, starts
from .extract import extract_apparatus, extract_notes
from .joins import full_outer_counts

# Patterns of variant notes that leaked into running text, with their labels.
LEAK_PATTERNS = [
    ("【大】＊", "【大】＊"),
    ("【宋】＊", "【宋】＊"),
    ("【元】＊", "【元】＊"),
    ("【明】＊", "【明】＊"),
    ("【三】＊", "【三】＊"),
    ("＝.{1,8}【(?:宋|元|明|三|聖|甲|乙)】", "校勘替换式"),
    ("〔.{1,6}〕－【(?:宋|元|明|三|聖)】", "校勘删除式"),
    (r"＋\(.{1,8}\)【(?:宋|元|明|三|聖)】", "校勘增加式"),
]
UNRESOLVED_GLYPH = r"#CB\d+"
PNG_MAGIC = "89504E470D0A1A0A"
# Bands of agreement with a reference edition.
MATCH_BANDS = [(0.99, "match"), (0.95, "close")]

SEGMENT_END = r"[.!?\n。！？；]+"


# -- reconciliation --------------------------------------------------------------------------------


def reconcile_counts(source: DataFrame, table: DataFrame, key: str, measures) -> DataFrame:
    """Counts of the source against counts of the tables per work, with a verdict per measure and overall."""
    both = full_outer_counts(source, table, key, measures)
    ok = [F.col(f"{m}_source") == F.col(f"{m}_table") for m in measures]
    both = both.select("*", *[c.alias(f"{m}_ok") for m, c in zip(measures, ok)])
    passed = ok[0]
    for c in ok[1:]:
        passed = passed & c
    return both.withColumn("status", F.when(passed, "pass").otherwise("fail"))


def source_counts(pos: DataFrame, works: DataFrame) -> DataFrame:
    """Volumes, non-empty notes, apparatus entries and table-of-contents marks per work, from the events."""
    ids = works.select("doc_path", "sutra_id")
    mark = starts(pos, "milestone").filter((F.col("region") == "body") & (attr("unit") == "juan"))
    body = starts(pos, "body").select("doc_path", "seq", F.lit(None).cast("string").alias("n"))
    marks = mark.select("doc_path", "seq", F.coalesce(F.col("attrs")["n"], F.lit("1")).alias("n"))
    per_doc = marks.unionByName(body).groupBy("doc_path").agg(
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("seq", F.col("n").try_cast("int").alias("v"))))).alias("m")
    )
    values = F.transform("m", lambda x: x["v"])
    juans = (
        F.when(F.size("m") == 0, F.array(F.lit(1)))
        .when(F.size("m") == 1, F.array(F.coalesce(values[0], F.lit(1))))
        .otherwise(F.concat(values, F.when(F.coalesce(values[0], F.lit(1)) != 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
    )
    vol = (
        per_doc.select("doc_path", F.explode(juans).alias("juan")).filter(F.col("juan").isNotNull()).join(ids, "doc_path")
        .groupBy("sutra_id").agg(F.count_distinct("juan").alias("juans"))
    )

    def per_work(df: DataFrame, name: str) -> DataFrame:
        return df.join(ids, "doc_path").groupBy("sutra_id").agg(F.count(F.lit(1)).alias(name))

    out = vol
    for df, name in (
        (extract_notes(pos), "notes"),
        (extract_apparatus(pos), "apps"),
        (starts(pos, "mulu").filter(F.col("region") == "body"), "toc_entries"),
    ):
        out = out.join(per_work(df, name), "sutra_id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def raw_counts(files: DataFrame, works: DataFrame) -> DataFrame:
    """Tags of the body per work, counted in the files as text (doc_path, content): no parser or extractor takes part.

    Every volume mark with a number is a volume, one if there is none; notes, apparatus entries and table-of-contents
    marks are counted as written, so an extraction that loses or invents rows shows up.
    """
    body = F.regexp_extract("content", r"(?s)<body[^>]*>(.*)</body>", 1)

    def tags(name: str) -> Column:
        return F.regexp_count("_body", F.lit(rf"<{name}[\s>/]")).cast("bigint")

    marks = F.regexp_extract_all("_body", F.lit(r'<milestone[^>]*unit="juan"[^>]*n="(\d+)"'), F.lit(1))
    # Counted before the join, so that the contents are not shuffled.
    per_file = files.select("doc_path", body.alias("_body")).select(
        "doc_path", F.array_distinct(marks).alias("m"), tags("note").alias("notes"), tags("app").alias("apps"), tags("mulu").alias("toc_entries")
    )
    per_file = per_file.join(works.select("doc_path", "sutra_id"), "doc_path")
    sums = [F.sum(c).alias(c) for c in ("notes", "apps", "toc_entries")]
    volumes = F.greatest(F.lit(1), F.size(F.array_distinct(F.flatten(F.collect_list("m"))))).cast("bigint")
    return per_file.groupBy("sutra_id").agg(volumes.alias("juans"), *sums)


def table_counts(content: DataFrame, notes: DataFrame, apparatus: DataFrame, toc: DataFrame) -> DataFrame:
    """The same counts from the written tables (each with ``sutra_id``)."""
    parts = [
        df.groupBy("sutra_id").agg(F.count(F.lit(1)).alias(n))
        for df, n in ((content, "juans"), (notes, "notes"), (apparatus, "apps"), (toc, "toc_entries"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "sutra_id", "full_outer")
    return out.fillna(0)


def verification_summary(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


# -- edition comparison ----------------------------------------------------------------------------


def compare_texts(
    left: DataFrame, right: DataFrame, keys, left_text: str, right_text: str, pattern: str = SEGMENT_END, normalize: bool = True
) -> DataFrame:
    """Agreement of two editions per key, aligned by sentence.

    Texts are cut at ``pattern``; a segment is normalised and equal segments of both sides are paired one to one, wherever
    they stand. ``ratio`` is twice the characters of the paired segments over the characters of both sides (1 if both are
    empty). ``diffs`` lists the segments left over on one side, in order, with the number of times. Rows of one key are
    aggregated per segment before they meet, so only unequal segments are gathered.
    """
    keys = list(keys)
    norm = normalize_for_compare if normalize else drop_ws
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)

    def segments(df: DataFrame, text: str, side: int) -> DataFrame:
        cut = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), pattern)).alias("position", "_raw"))
        one = cut.select(*keys, "position", norm("_raw").alias("segment")).filter(F.col("segment") != "")
        return one.withColumn("l", F.lit(1 - side)).withColumn("r", F.lit(side))

    rows = segments(left, left_text, 0).unionByName(segments(right, right_text, 1)).withColumn("_h", F.xxhash64("segment"))
    counted = rows.groupBy(*keys, "_h", "segment").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.min("position").alias("position"))
    size, extra = F.length("segment"), F.col("l") - F.col("r")
    diff = F.struct("position", F.when(extra > 0, "removed").otherwise("added").alias("op"), F.abs(extra).alias("times"), F.col("segment").alias("text"))
    found = counted.groupBy(*keys).agg(
        F.sum(F.least("l", "r") * size).alias("_paired"),
        F.sum(F.col("l") * size).alias("left_len"),
        F.sum(F.col("r") * size).alias("right_len"),
        F.array_sort(F.collect_list(F.when(extra != 0, diff))).alias("diffs"),
    )
    total = F.col("left_len") + F.col("right_len")
    out = both.join(found, keys, "left").select(
        *keys, F.coalesce(2 * F.col("_paired") / total, F.lit(1.0)).alias("ratio"),
        *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("left_len", "right_len")],
        F.coalesce("diffs", F.array().cast(found.schema["diffs"].dataType)).alias("diffs"),
    )
    band = F.lit("differs")
    for floor, name in reversed(MATCH_BANDS):
        band = F.when(F.col("ratio") >= floor, name).otherwise(band)
    return out.withColumn("band", band)


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.size("diffs")).alias("total_diffs"),
        F.avg("ratio").alias("avg_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
        F.count_if(F.col("band") == "match").alias("passed"),
    )


# -- text checks -----------------------------------------------------------------------------------


def detect_leaks(df: DataFrame, text: str = "text", patterns=None, context: int = 15) -> DataFrame:
    """First matching leak pattern of each text with context, and whether glyph references are left."""
    pats = patterns or LEAK_PATTERNS
    c = F.col(text)
    label = F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for p, n in pats])
    hit = F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, f"({p})", 1)) for p, _ in pats])
    at = F.position(hit, c)
    start = F.greatest(F.lit(1), at - context)
    around = F.substring(c, start, (at - start) + F.length(hit) + context)
    return df.select(
        *[x for x in df.columns if x != text], label.alias("leak"), F.translate(around, "\n", " ").alias("leak_context"),
        c.rlike(UNRESOLVED_GLYPH).alias("unresolved_glyph"),
    ).filter(F.col("leak").isNotNull() | F.col("unresolved_glyph"))


def char_coverage(df: DataFrame, supported: DataFrame, text: str = "text") -> DataFrame:
    """Characters of the texts that no supported range covers, with their frequency.

    ``supported`` has code-point ranges (lo, hi). Characters are counted first, so the range test runs
    on the alphabet and not on the corpus; ranges are looked up by blocks of 256 code points.
    """
    chars = df.select(F.explode(F.split(F.col(text), "")).alias("ch")).filter(F.col("ch") != "")
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    code = F.ascii("ch").cast("bigint")
    counts = counts.withColumn("code", code).withColumn("_b", F.shiftright("code", 8))
    blocks = supported.select("lo", "hi", F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8))).alias("_b"))
    covered = counts.join(blocks, "_b").filter(F.col("code").between(F.col("lo"), F.col("hi"))).select("ch").distinct()
    return counts.join(covered, "ch", "left_anti").select("ch", "code", "n")


def audit_assets(assets: DataFrame) -> DataFrame:
    """Status of each asset (zero_byte, invalid, valid), from size and leading bytes."""
    status = F.when(F.col("length") == 0, "zero_byte").when(F.col("magic") == PNG_MAGIC, "valid").otherwise("invalid")
    return assets.select("path", "length", status.alias("status"))


def validate_schema(spark: SparkSession, spec: dict[str, set[str]], tables: dict[str, DataFrame]) -> DataFrame:
    """One row per required table: ok, missing or schema_invalid with the missing columns."""
    rows = []
    for name in sorted(spec):
        if name not in tables:
            rows.append((name, "missing", ""))
            continue
        lack = sorted(set(spec[name]) - set(tables[name].columns))
        rows.append((name, "schema_invalid" if lack else "ok", ", ".join(lack)))
    return spark.createDataFrame(rows, "table_name string, status string, missing_columns string")


def layout_drift(layouts: DataFrame, expected: StructType, root: str) -> DataFrame:
    """Where stored files differ from the expected columns, per folder below ``root``.

    ``layouts`` comes from ``read_layouts``. A problem is ``missing`` (an expected column that a file lacks), ``extra``,
    ``type`` (another type than expected) or ``unreadable``; n_files and n_rows count the files that have it. Folders
    without a problem have no rows; the partition columns stand in the folder names, so they are not expected.
    """
    wanted = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in expected])
    names = F.transform(wanted, lambda c: c["column"])
    found = F.map_from_entries("columns")

    def problem(kind, column, want, have):
        return F.struct(F.lit(kind).alias("problem"), column.alias("column"), want.alias("expected"), have.alias("found"))

    none = F.lit(None).cast("string")
    lacking = F.transform(F.filter(wanted, lambda c: ~F.map_contains_key(found, c["column"])), lambda c: problem("missing", c["column"], c["type"], none))
    changed = F.transform(
        F.filter(wanted, lambda c: F.coalesce(F.element_at(found, c["column"]) != c["type"], F.lit(False))),
        lambda c: problem("type", c["column"], c["type"], F.element_at(found, c["column"])),
    )
    extra = F.transform(F.filter("columns", lambda c: ~F.array_contains(names, c["column"])), lambda c: problem("extra", c["column"], none, c["type"]))
    broken = F.array(problem("unreadable", none, none, F.col("error")))
    every = F.when(F.col("error").isNotNull(), broken).otherwise(F.concat(lacking, changed, extra))
    plain = F.regexp_replace("path", "^file:/+", "/")
    start = re.sub("^file:/+", "/", root.rstrip("/"))
    folder = F.substring(F.regexp_replace(plain, "/[^/]*$", ""), F.lit(len(start) + 2), F.length(plain))
    rows = layouts.select(folder.alias("folder"), "n_rows", F.inline(every))
    return rows.groupBy("folder", "problem", "column", "expected", "found").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"))


def overall_health(checks: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status") != "ok")
    return checks.agg(bad.alias("failed"), F.when(bad > 0, "degraded").otherwise("ok").alias("overall"))


# -- length profile --------------------------------------------------------------------------------


def length_histogram(df: DataFrame, length: Column | str, example: Column | str | None = None) -> DataFrame:
    """Number of rows per length with share in percent and an example."""
    cols = [as_col(length).alias("length")] + ([as_col(example).alias("_e")] if example is not None else [])
    rows = df.select(*cols).filter(F.col("length") > 0)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("_e").alias("example")] if example is not None else [])
    hist = rows.groupBy("length").agg(*aggs)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return hist.withColumn("pct", F.col("n") / total * 100)


def positional_percentiles(hist: DataFrame, points=(50, 90, 95, 99)) -> DataFrame:
    """Value at zero-based position ``int(n * p)`` of the sorted lengths, from the histogram.

    The histogram has one row per distinct length, so its running total is a small single-task window.
    """
    w = Window.orderBy("length")
    run = hist.select(
        "length", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    aggs = [
        F.min(F.when(F.col("upto") > F.floor(F.col("total") * p / 100), F.col("length"))).alias(f"p{p}") for p in points
    ]
    return run.agg(*aggs, F.max("length").alias("max_length")).withColumn("layout_width", F.col("p95") + 8)


def schema_drift(documented: DataFrame, scanned: DataFrame, col: str = "tag") -> DataFrame:
    """Values only documented or only scanned."""
    d, s = documented.select(col).distinct(), scanned.select(col).distinct()
    return (
        d.join(s, col, "left_anti").withColumn("only_in", F.lit("documented"))
        .unionByName(s.join(d, col, "left_anti").withColumn("only_in", F.lit("scanned")))
    )


def length_profile(verse_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histogram with examples and positional percentiles of verse lines (``line``, ``n_chars``)."""
    hist = length_histogram(verse_lines, "n_chars", "line")
    return hist, positional_percentiles(hist)
