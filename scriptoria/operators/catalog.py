"""Catalogue statistics, enrichment, roll-ups and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import null_if_empty

UNCLASSIFIED = "(未分類)"


def work_sizes(content: DataFrame, key: str = "sutra_id", volume: str = "juan", text: str = "plain_text", chars: str = "n_chars") -> DataFrame:
    """Distinct volumes and characters per work; rows are reduced to volumes before the work is formed.

    A table with a column ``chars`` needs no texts.
    """
    volumes = content.groupBy(key, volume).agg(F.sum(chars if chars in content.columns else F.length(text)).alias("_c"))
    return volumes.groupBy(key).agg(F.count(volume).alias("juan_count"), F.sum("_c").alias("total_chars"))


def catalog_stats(catalog: DataFrame, content: DataFrame) -> DataFrame:
    """Catalogue with volume count and characters (works without content stay, with zero volumes)."""
    out = catalog.join(work_sizes(content), "sutra_id", "left")
    return out.withColumn("juan_count", F.coalesce("juan_count", F.lit(0)))


def catalog_full(stats: DataFrame, toc: DataFrame, juan_index: DataFrame, bulei: DataFrame) -> DataFrame:
    """Catalogue enriched with table-of-contents entries, indexed volumes and root category."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sutra_id").agg(F.count(F.lit(1)).alias(name))

    out = stats.join(counted(toc, "toc_entries"), "sutra_id", "left").join(counted(juan_index, "nav_juans"), "sutra_id", "left")
    out = out.join(bulei.select("sutra_id", "bu_lei"), "sutra_id", "left")
    for c in ("toc_entries", "nav_juans", "total_chars"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("bu_lei", F.coalesce("bu_lei", F.lit("")))


def order_catalog(df: DataFrame) -> DataFrame:
    """Export order: category with blanks last, then id."""
    return df.orderBy(F.coalesce(null_if_empty("bu_lei"), F.lit("zzz")), "sutra_id")


def rollup_catalog(df: DataFrame) -> DataFrame:
    """Works, volumes and characters by root category, by canon name and in total (one pass, grouping sets)."""
    label = lambda c: F.coalesce(null_if_empty(c), F.lit(UNCLASSIFIED)).alias(c)
    rows = df.select(label("bu_lei"), label("category"), "juan_count", F.coalesce("total_chars", F.lit(0)).alias("total_chars"))
    sets = [[F.col("bu_lei")], [F.col("category")], []]
    out = rows.groupingSets(sets, F.col("bu_lei"), F.col("category")).agg(
        F.count(F.lit(1)).alias("works"), F.sum("juan_count").alias("volumes"), F.sum("total_chars").alias("chars"),
        F.grouping_id().alias("gid"),
    )
    level = F.when(F.col("gid") == 1, "bu_lei").when(F.col("gid") == 2, "category").otherwise("total")
    return out.select(level.alias("level"), F.coalesce("bu_lei", "category", F.lit("")).alias("label"), "works", "volumes", "chars")


def overlay(default: DataFrame, user: DataFrame, key: str, cols, keys: DataFrame | None = None) -> DataFrame:
    """User rows replace default rows wholesale; ``source`` says user, default or none (for unknown ``keys``)."""
    cols = list(cols)
    d = default.select(key, *[F.col(c).alias(f"_d_{c}") for c in cols], F.lit(True).alias("_in_d"))
    u = user.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols], F.lit(True).alias("_in_u"))
    both = d.join(u, key, "full_outer")
    pick = F.col("_in_u").isNotNull()
    out = both.select(
        key, *[F.when(pick, F.col(f"_u_{c}")).otherwise(F.col(f"_d_{c}")).alias(c) for c in cols],
        F.when(pick, "user").otherwise("default").alias("source"),
    )
    if keys is None:
        return out
    return keys.select(key).distinct().join(out, key, "left").withColumn("source", F.coalesce("source", F.lit("none")))


def merge_overlay(base, patch):
    """Map column with the entries of ``patch`` replacing those of ``base`` (top-level keys)."""
    kept = F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)


def notes_for(keys: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes whose title names the work (newest first), and the keys without any.

    For a key of the second table the answer is the whole log, which is not repeated per key. Titles
    hold the work id, so the match is an equi-join on the ids found in them.
    """
    k = keys.select("sutra_id").distinct()
    ids = F.array_distinct(F.regexp_extract_all("sutra_title", F.lit(r"([A-Z]+[a-zA-Z]*\d+[a-zA-Z]*)"), F.lit(1)))
    named = notes.select("*", F.explode(ids).alias("sutra_id")).join(k, "sutra_id")
    missing = k.join(named.select("sutra_id").distinct(), "sutra_id", "left_anti")
    return named.orderBy("sutra_id", F.col("log_path").desc(), F.col("pos").desc()), missing
