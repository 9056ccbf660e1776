"""Rule-table rendering of the event stream, and index pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import null_if_empty
from ..functions.text import safe_name, to_cn_numeral
from ..operators.firstwins import bounded_groups
from ..sources.markup import ordered_text

# Rendering rules: tag, text before, text after, whether the content is shown.
MARKDOWN_RULES = [
    ("head", "\n\n#### ", "\n\n", True),
    ("p", "\n\n", "\n\n", True),
    ("lg", "\n\n", "\n\n", True),
    ("l", "> ", "  \n", True),
    ("byline", "\n\n*", "*\n\n", True),
    ("mulu", "\n\n### ", "\n\n", True),
    ("note", "（", "）", True),
    ("rdg", "", "", False),
    ("sic", "", "", False),
    ("orig", "", "", False),
    ("back", "", "", False),
    ("docNumber", "", "", False),
]
HTML_RULES = [
    ("head", "<h3>", "</h3>", True),
    ("p", "<p>", "</p>", True),
    ("lg", "<div class='verse'>", "</div>", True),
    ("l", "<span class='line'>", "</span>", True),
    ("byline", "<p class='byline'>", "</p>", True),
    ("mulu", "<a class='mulu'>", "</a>", True),
    ("note", "<span class='note-inline'>（", "）</span>", True),
    ("rdg", "", "", False),
    ("sic", "", "", False),
    ("orig", "", "", False),
    ("back", "", "", False),
    ("docNumber", "", "", False),
]


def rules_table(spark: SparkSession, flavor: str) -> DataFrame:
    rows = MARKDOWN_RULES if flavor == "markdown" else HTML_RULES
    return spark.createDataFrame(rows, "tag string, open string, close string, shown boolean")


def render(pos: DataFrame, flavor: str = "markdown", rules: DataFrame | None = None) -> DataFrame:
    """Rendered text per (document, volume): start and end tags become the texts of their rules.

    A hidden element hides everything below it: hidden tags are tested on the ancestors in the row.
    """
    r = F.broadcast(rules if rules is not None else rules_table(pos.sparkSession, flavor))  # a rule table, a dozen rows
    hidden = r.filter(~F.col("shown")).agg(F.collect_set("tag")).scalar()
    body = pos.filter(F.col("region") == "body").withColumn("_hidden", hidden)
    body = body.filter(
        ~F.arrays_overlap("ancestor_tags", "_hidden") & ~F.coalesce(F.array_contains("_hidden", F.col("tag")), F.lit(False))
    ).drop("_hidden")
    marked = body.join(r, "tag", "left")
    piece = (
        F.when(F.col("kind") == "text", F.translate("text", "\n\r", ""))
        .when(F.col("kind") == "start", F.col("open"))
        .when(F.col("kind") == "end", F.col("close"))
    )
    return marked.withColumn("_piece", piece).groupBy("doc_path", "juan").agg(ordered_text("_piece").alias("rendered"))


def render_works(rendered: DataFrame, works: DataFrame, multi: str = "## 卷") -> DataFrame:
    """Volumes of each work under their headings, ready to be written in (sutra_id, juan) order.

    One row per volume: a work of any size is the ordered sequence of its rows and is never one string.
    """
    ids = works.select("doc_path", "sutra_id", "title")
    out = rendered.join(ids, "doc_path")
    heading = F.concat(F.lit(multi), to_cn_numeral("juan"), F.lit("\n\n"))
    name = F.concat_ws(" ", "sutra_id", safe_name("title"))
    return out.select("sutra_id", "juan", name.alias("file_name"), F.concat(heading, "rendered").alias("content"))


def write_works(rendered_works: DataFrame, path: str) -> None:
    """Text files by work, volumes in order (works are spread over tasks by range)."""
    (
        rendered_works.repartitionByRange("sutra_id", "juan")
        .sortWithinPartitions("sutra_id", "juan")
        .select("sutra_id", "content")
        .write.mode("overwrite")
        .partitionBy("sutra_id")
        .text(path)
    )


def work_category(catalog: DataFrame, bulei: DataFrame, canons: DataFrame) -> DataFrame:
    """Category of each work: root category, else the canon's short name, else the canon code."""
    return (
        catalog.join(bulei.select("sutra_id", "bu_lei"), "sutra_id", "left")
        .join(canons.select("canon", F.col("title_zh").alias("_cn")), "canon", "left")
        .withColumn("shelf", F.coalesce(null_if_empty("bu_lei"), null_if_empty("_cn"), "canon"))
        .drop("_cn")
    )


def build_indexes(shelved: DataFrame, limit: int = 1000) -> DataFrame:
    """Index pages: works grouped by canon and volume, and by shelf, with counts.

    ``shelved`` comes from :func:`work_category`. Pages list at most about ``limit`` works per part.
    """
    item = F.struct("sutra_id", "title")
    parts = []
    for kind, keys in (("canon", ["canon", "volume"]), ("category", ["shelf"])):
        label = F.concat_ws("/", *keys)
        rows = shelved.withColumn("page", label)
        counts = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n_works"))
        listed = bounded_groups(rows, ["page"], item, "sutra_id", "works", limit).join(counts, "page")
        lines = F.array_join(
            F.transform("works", lambda w: F.concat(F.lit("- [["), w["sutra_id"], F.lit(" "), w["title"], F.lit("]]"))), "\n"
        )
        parts.append(listed.select(F.lit(kind).alias("kind"), "page", "part", "n_works", lines.alias("content")))
    return parts[0].unionByName(parts[1])
