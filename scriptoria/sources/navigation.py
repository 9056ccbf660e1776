"""Navigation files: category trees, per-work tables of contents and line indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import first_group, strip
from ..functions.text import canon_of, work_id
from ..operators.firstwins import number_rows
from .markup import attr, node_texts, starts


def _last_ancestor(tag: str) -> Column:
    """Id of the closest ancestor with this tag, or null."""
    pairs = F.arrays_zip(F.col("ancestors").alias("id"), F.col("ancestor_tags").alias("tag"))
    return F.get(F.transform(F.reverse(F.filter(pairs, lambda p: p["tag"] == tag)), lambda p: p["id"]), F.lit(0))


def _labels(texts: DataFrame) -> DataFrame:
    """Label of each list item: its first direct link, else its first direct span."""
    parent = F.try_element_at("ancestor_tags", F.lit(-1))
    direct = texts.filter(F.col("tag").isin("cblink", "span") & (parent == "li"))
    best = F.struct(F.when(F.col("tag") == "cblink", 0).otherwise(1), F.col("seq"))
    return direct.groupBy("doc_path", F.col("parent_id").alias("node_id")).agg(
        F.min_by(F.struct("tag", strip("text").alias("text"), attr("href").alias("href")), best).alias("label")
    )


def read_nav(elements: DataFrame, tree_type: str, narrow_ids: bool = False) -> DataFrame:
    """Adjacency list of a category tree.

    Sections (spans under the navigation element) own the lists that follow them; list items nest; an
    item directly under the navigation element is a root. ``id`` is unique within one file.
    """
    nav = starts(elements, "nav").groupBy("doc_path").agg(F.min("node_id").alias("_nav"))
    t = node_texts(elements, "cblink", "span", "li").join(nav, "doc_path")
    t = t.filter(F.array_contains("ancestors", F.col("_nav")))
    parent = F.try_element_at("ancestor_tags", F.lit(-1))
    sections = t.filter((F.col("tag") == "span") & (F.col("parent_id") == F.col("_nav"))).select(
        "doc_path", "node_id", "seq", F.lit("section").alias("kind"), strip("text").alias("title"),
        F.lit(None).cast("bigint").alias("li_parent"), F.lit(False).alias("in_section"),
    )
    items = t.filter(F.col("tag") == "li").join(_labels(t), ["doc_path", "node_id"], "left")
    items = items.select(
        "doc_path", "node_id", "seq",
        F.when(F.col("label.tag") == "span", "group").otherwise("leaf").alias("kind"),
        F.coalesce("label.text", strip("text")).alias("title"),
        _last_ancestor("li").alias("li_parent"),
        (parent == "ol").alias("in_section"),
    ).filter(F.col("title") != "")
    run = Window.partitionBy("doc_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("kind") == "section", F.col("node_id")), ignorenulls=True).over(run)
    rows = sections.unionByName(items).withColumn("_section", section)
    rows = number_rows(rows, ["doc_path"], ["seq"], "sort_order")
    sid = F.when(F.col("kind") == "leaf", work_id("title", narrow_ids))
    return rows.select(
        "doc_path",
        F.col("node_id").alias("id"),
        F.lit(tree_type).alias("tree_type"),
        F.when(F.col("kind") == "section", F.lit(None))
        .otherwise(F.coalesce("li_parent", F.when(F.col("in_section"), F.col("_section"))))
        .alias("parent_id"),
        "title",
        sid.alias("sutra_id"),
        F.col("sort_order").cast("bigint").alias("sort_order"),
    )


def _refs() -> tuple[Column, Column]:
    """File and page of a link, split at the last hash."""
    href = F.coalesce(F.col("label.href"), F.lit(""))
    has = F.contains(href, F.lit("#"))
    page = F.when(has, F.substring_index(href, "#", -1)).otherwise(F.lit(""))
    file = F.when(has, F.left(href, F.length(href) - F.length(page) - 1)).otherwise(href)
    return file, page


def _toc_items(elements: DataFrame, nav_type: str) -> DataFrame:
    navs = starts(elements, "nav").filter(attr("type") == nav_type).select("doc_path", F.col("node_id").alias("nav_id"))
    t = node_texts(elements, "cblink", "span", "li")
    items = t.filter(F.col("tag") == "li").withColumn("nav_id", _last_ancestor("nav"))
    name = F.regexp_replace(F.element_at(F.split("doc_path", "/"), -1), r"\.xml$", "")
    return (
        items.join(navs, ["doc_path", "nav_id"])
        .join(_labels(t), ["doc_path", "node_id"])
        .withColumn("sutra_id", name)
        .withColumn("canon", canon_of(name))
        .withColumn("title", F.col("label.text"))
    )


def read_toc(elements: DataFrame) -> DataFrame:
    """Chapter tree of each work: level, number and number of the parent entry."""
    file, page = _refs()
    items = _toc_items(elements, "catalog").filter(F.col("title") != "")
    items = items.withColumn("_li", _last_ancestor("li")).withColumn(
        "level", (F.size(F.filter("ancestor_tags", lambda t: t == "ol")) - 1).cast("int")
    )
    items = number_rows(items, ["doc_path", "nav_id"], ["seq"], "_no")
    parents = items.select("doc_path", F.col("node_id").alias("_li"), F.col("_no").alias("parent_idx"))
    return items.join(parents, ["doc_path", "_li"], "left").select(
        "sutra_id", "canon", "level", "parent_idx", F.col("_no").alias("seq"), "title",
        file.alias("file_ref"), page.alias("page_id"),
    )


def read_juan_index(elements: DataFrame) -> DataFrame:
    """Volume index of each work: linked items of the first list level, numbered in order."""
    file, page = _refs()
    top = (F.try_element_at("ancestor_tags", F.lit(-1)) == "ol") & (F.try_element_at("ancestor_tags", F.lit(-2)) == "nav")
    items = _toc_items(elements, "juan").filter((F.col("label.tag") == "cblink") & top)
    items = number_rows(items, ["doc_path", "nav_id"], ["seq"], "juan")
    return items.select("sutra_id", "canon", "juan", "title", file.alias("file_ref"), page.alias("page_id"))


def read_mulu(files: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """Line indexes: a JSON object between back-quotes, file name to ``[line, title]`` pairs."""
    name = F.element_at(F.split(path_col, "/"), -1)
    body = F.regexp_extract(text_col, r"(?s)`\s*(\{.*?\})\s*`", 1)
    parsed = files.filter(name.rlike(r"^[A-Z]+\d+_mulu\.js$")).select(
        F.regexp_extract(name, r"^([A-Z]+)(\d+)", 1).alias("canon"),
        F.regexp_extract(name, r"^([A-Z]+)(\d+)", 2).alias("volume"),
        F.explode(F.from_json(body, "map<string,array<array<string>>>")).alias("_file", "_entries"),
    )
    m = r"^([A-Z]+)\d+n(\d+[a-zA-Z]*)"
    entries = parsed.filter(F.col("_file").rlike(m + r"\.xml") | F.col("_file").rlike(m + r"_\d+\.xml")).select(
        "canon", "volume",
        F.concat(F.regexp_extract("_file", m, 1), F.regexp_extract("_file", m, 2)).alias("sutra_id"),
        first_group("_file", r"_(\d+)\.xml").cast("int").alias("juan"),
        F.posexplode("_entries").alias("_i", "_e"),
    )
    return entries.filter(F.size("_e") >= 2).select(
        "canon", "volume", "sutra_id", "juan", (F.col("_i") + 1).alias("seq"),
        F.col("_e")[0].alias("line_id"), F.col("_e")[1].alias("title"),
    )
