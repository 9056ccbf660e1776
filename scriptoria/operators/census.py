"""Markup census: tags, attributes, note formats and child patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import attr, ordered_text, starts
from .firstwins import top_k


def tag_census(elements: DataFrame) -> DataFrame:
    return starts(elements).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def attr_census(elements: DataFrame) -> DataFrame:
    keys = starts(elements).select("tag", F.explode(F.map_keys("attrs")).alias("attr"))
    return keys.groupBy("tag", "attr").agg(F.count(F.lit(1)).alias("n"))


def namespaces(elements: DataFrame) -> DataFrame:
    return starts(elements).filter(F.col("ns").isNotNull()).select("ns").distinct()


def attr_samples(elements: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` smallest distinct values of each tag's attributes."""
    values = starts(elements).select("tag", F.explode("attrs").alias("attr", "value")).filter(F.col("value") != "")
    return top_k(values.distinct(), ["tag", "attr"], ["value"], k)


def note_census(elements: DataFrame, k: int = 50) -> DataFrame:
    """Most frequent (type, place, parent, has_n) combinations and the one-column marginals.

    ``grouping`` names the grouping set; each set keeps its ``k`` most frequent rows.
    """
    notes = starts(elements, "note").select(
        attr("type").alias("type"), attr("place").alias("place"),
        F.coalesce(F.try_element_at("ancestor_tags", F.lit(-1)), F.lit("ROOT")).alias("parent"),
        F.when(attr("n") != "", "yes").otherwise("no").alias("has_n"),
    )
    sets = [["type", "place", "parent", "has_n"], ["type"], ["place"], ["parent"]]
    cols = [F.col(c) for c in ("type", "place", "parent", "has_n")]
    cube = notes.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    name = (
        F.when(F.col("gid") == 0, "combination").when(F.col("gid") == 7, "type").when(F.col("gid") == 11, "place").otherwise("parent")
    )
    named = cube.withColumn("grouping", name).filter(
        ~(F.col("grouping").isin("type") & (F.col("type") == "")) & ~(F.col("grouping").isin("place") & (F.col("place") == ""))
    )
    order = [F.col("n").desc(), F.col("type").asc_nulls_first(), F.col("place").asc_nulls_first(), F.col("parent").asc_nulls_first(), F.col("has_n").asc_nulls_first()]
    return top_k(named.drop("gid"), ["grouping"], order, k)


def notes_inside(elements: DataFrame, parent: str) -> DataFrame:
    """Note types directly inside one kind of element."""
    inside = starts(elements, "note").filter(F.try_element_at("ancestor_tags", F.lit(-1)) == parent)
    kind = F.when(attr("type") == "", "(empty)").otherwise(attr("type"))
    return inside.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def child_patterns(elements: DataFrame, tag: str, k: int = 30) -> DataFrame:
    """Most frequent sequences of child tags of one kind of element."""
    s = starts(elements)
    children = s.filter(F.try_element_at("ancestor_tags", F.lit(-1)) == tag).select(
        "doc_path", F.col("parent_id").alias("node_id"), F.col("tag").alias("text"), "seq"
    )
    own = s.filter(F.col("tag") == tag).select("doc_path", "node_id", F.lit(None).cast("string").alias("text"), "seq")
    lists = children.unionByName(own).groupBy("doc_path", "node_id").agg(ordered_text("text", "seq", ",").alias("children"))
    counts = lists.groupBy("children").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "children").limit(k)
