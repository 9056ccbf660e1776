"""Category trees kept as adjacency lists ``(id, parent_id, title, sutra_id, sort_order)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import null_if_empty
from ..functions.text import SUBWORK_VOLUMES, base_work, canon_of, global_volume, work_title
from ..session import broadcast_if_small, materialize
from .firstwins import keep_first
from .relate import folder_is_commentary, is_commentary


def expand_tree(nodes: DataFrame) -> DataFrame:
    """Add ``chain`` (ancestors from the root down, as structs), ``depth``, ``root_id`` and ``root_title``.

    Ancestor pointers are doubled: each round joins every node with the node its chain has reached, so a tree of depth d
    takes log2(d) rounds however deep or wide it is. Each round is written out, which keeps the plan short. A node whose
    chain meets the node itself lies on a cycle; it and all nodes below it have no root: they are returned with null
    ``chain``, ``depth`` and ``root_id``.
    """
    cols = ["id", "parent_id", "title", "sutra_id", "sort_order"]
    me = F.struct("id", "title", "sutra_id", "sort_order")
    empty = F.array().cast("array<struct<id:bigint,title:string,sutra_id:string,sort_order:bigint>>")
    base = nodes.select(
        F.col("id").cast("bigint").alias("id"), F.col("parent_id").cast("bigint").alias("parent_id"), "title", "sutra_id",
        F.col("sort_order").cast("bigint").alias("sort_order"),
    )
    state = materialize(base.select(*cols, F.col("parent_id").alias("ptr"), empty.alias("chain"), F.lit(False).alias("lost")), "tree")
    while not state.filter(F.col("ptr").isNotNull()).isEmpty():
        up = state.select(
            F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.concat("chain", F.array(me)).alias("_chain"), F.col("lost").alias("_lost")
        )
        done = state.filter(F.col("ptr").isNull())
        moved = (
            state.filter(F.col("ptr").isNotNull())
            .join(up, F.col("ptr") == F.col("_id"), "left")
            .select(*cols, F.col("_ptr").alias("ptr"), F.concat(F.coalesce("_chain", empty), "chain").alias("chain"), F.coalesce("_lost", F.lit(False)).alias("lost"))
        )
        lost = F.col("lost") | F.exists("chain", lambda x: x["id"] == F.col("id"))
        moved = moved.withColumn("lost", lost).withColumn("ptr", F.when(~F.col("lost"), F.col("ptr"))).withColumn("chain", F.when(~F.col("lost"), F.col("chain")))
        state = materialize(done.unionByName(moved), "tree")
    top = F.get("chain", F.lit(0))
    return state.select(
        *cols, "chain", F.when(~F.col("lost"), F.size("chain")).alias("depth"),
        *[F.when(~F.col("lost"), F.coalesce(top[c], F.col(c))).alias(f"root_{n}") for n, c in (("id", "id"), ("title", "title"), ("order", "sort_order"))],
    )


def catalog_from_nav(*trees: DataFrame) -> DataFrame:
    """Works named by the trees; the first tree, then the first node, wins."""
    parts = [
        t.filter(F.col("sutra_id").isNotNull()).select("sutra_id", "title", "sort_order", F.lit(i).alias("_tree"))
        for i, t in enumerate(trees)
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = keep_first(rows, ["sutra_id"], ["_tree", "sort_order"])
    return first.select(
        "sutra_id", canon_of("sutra_id").alias("canon"), work_title("title").alias("title"),
        F.lit("").alias("author"), F.lit("").alias("category"), F.lit(0).alias("juan_count"),
    )


def derive_category(tree: DataFrame) -> DataFrame:
    """Root category per work; the first root wins and nodes below a work are not visited."""
    below_work = F.exists("chain", lambda c: c["sutra_id"].isNotNull())
    works = tree.filter(F.col("sutra_id").isNotNull() & (F.col("depth") > 0) & ~below_work)
    return works.groupBy("sutra_id").agg(
        F.min_by("root_title", F.struct("root_order", "depth", "sort_order")).alias("bu_lei")
    )


def leaves(tree: DataFrame) -> DataFrame:
    """Childless nodes that carry a work id."""
    parents = tree.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    return tree.filter(F.col("sutra_id").isNotNull()).join(parents, "id", "left_anti")


def leaf_counts(tree: DataFrame) -> DataFrame:
    """Number of leaves below (or at) every node."""
    at = leaves(tree).select(F.explode(F.concat(F.transform("chain", lambda c: c["id"]), F.array("id"))).alias("id"))
    counts = at.groupBy("id").agg(F.count(F.lit(1)).alias("n_leaves"))
    return tree.select("id", "title").join(counts, "id", "left").select(
        "id", "title", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves")
    )


def filter_tree(tree: DataFrame, pred: Callable[[Column], Column]) -> DataFrame:
    """Nodes that match, with their ancestors and their whole subtrees; ``pred`` tests a title."""
    inside = pred(F.col("title")) | F.exists("chain", lambda c: pred(c["title"]))
    above = (
        tree.filter(pred(F.col("title")))
        .select(F.explode(F.transform("chain", lambda c: c["id"])).alias("id"))
        .distinct()
        .withColumn("_above", F.lit(True))
    )
    return tree.join(above, "id", "left").filter(inside | F.col("_above")).drop("_above")


def slim_outline(tree: DataFrame, mark: str = "／") -> DataFrame:
    """Only the branches whose title holds the mark that separates text and commentaries."""
    return filter_tree(tree, lambda t: F.contains(t, F.lit(mark)))


def outline_groups(tree: DataFrame, mark: str = "／") -> DataFrame:
    """Works with their group: the nearest ancestor whose title holds the mark."""
    marked = F.filter("chain", lambda c: F.contains(c["title"], F.lit(mark)))
    return (
        tree.filter(F.col("sutra_id").isNotNull() & (F.size(marked) > 0))
        .withColumn("_g", F.try_element_at(marked, F.lit(-1)))
        .select(
            F.col("_g.id").alias("group_id"), F.col("_g.title").alias("group_title"), "sutra_id",
            work_title("title").alias("title"), "sort_order",
        )
    )


def folder_commentaries(tree: DataFrame) -> DataFrame:
    """Commentaries in the subtree of every folder: ``(folder_id, sutra_id, title, sort_order)``."""
    works = tree.filter(F.col("sutra_id").isNotNull()).select(
        "sutra_id", work_title("title").alias("title"), "sort_order", F.explode("chain").alias("f")
    )
    hit = works.filter(is_commentary("title", "sutra_id", folder_is_commentary("f.title")))
    return hit.groupBy(F.col("f.id").alias("folder_id"), "sutra_id").agg(
        F.min_by("title", "sort_order").alias("title"), F.min("sort_order").alias("sort_order")
    )


def sibling_groups(keys: DataFrame, tree: DataFrame, commentaries: DataFrame | None = None) -> DataFrame:
    """Folder whose commentaries belong to each key: the parent, or the grandparent when the parent has none.

    One row per key with the number of commentaries other than the key itself.
    """
    fc = commentaries if commentaries is not None else folder_commentaries(tree)
    node = keep_first(tree.filter((F.col("depth") > 0) & F.col("sutra_id").isNotNull()), ["sutra_id"], ["sort_order"])
    up = F.slice(F.reverse("chain"), 1, 2)
    cand = keys.select("sutra_id").distinct().join(node, "sutra_id").select("sutra_id", F.posexplode(up).alias("lvl", "f"))
    cand = cand.select("sutra_id", "lvl", F.col("f.id").alias("folder_id"), F.col("f.title").alias("group_title"))
    sizes = fc.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    own = fc.select("folder_id", "sutra_id", F.lit(1).alias("_own"))
    cand = cand.join(sizes, "folder_id", "left").join(own, ["folder_id", "sutra_id"], "left")
    cand = cand.withColumn("n", F.coalesce("n", F.lit(0)) - F.coalesce("_own", F.lit(0)))
    pick = F.struct(F.when(F.col("n") > 0, F.col("lvl")).otherwise(10 - F.col("lvl")).alias("p"))
    best = cand.groupBy("sutra_id").agg(F.min_by(F.struct("folder_id", "group_title", "n"), pick).alias("b"))
    return best.select("sutra_id", "b.folder_id", "b.group_title", F.col("b.n").alias("n_commentaries"))


def sibling_commentaries(keys: DataFrame, tree: DataFrame) -> DataFrame:
    """Commentaries of each key work, from the folder chosen by :func:`sibling_groups`."""
    fc = materialize(folder_commentaries(tree), "folders")
    groups = sibling_groups(keys, tree, fc)
    pairs = groups.join(fc.withColumnRenamed("sutra_id", "commentary_id"), "folder_id")
    return pairs.filter(F.col("commentary_id") != F.col("sutra_id")).select(
        "sutra_id", "group_title", "commentary_id", "title", "sort_order"
    )


def _sub_volumes(col: str) -> Column:
    pairs = [x for i, _, n in SUBWORK_VOLUMES for x in (F.lit(i), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


def volume_count(works: DataFrame, toc_counts: DataFrame, key: str = "sutra_id", explicit: str = "juan_count") -> DataFrame:
    """Add ``total_juan``: explicit count, else the sub-work table, else the index of the work or its base, else 1."""
    t = toc_counts.select(F.col("sutra_id").alias("_k"), F.col("n").alias("_n"))
    own = t.select(F.col("_k").alias(key), F.col("_n").alias("_own"))
    base = t.select(F.col("_k").alias("_base"), F.col("_n").alias("_up"))
    out = works.withColumn("_base", base_work(key)).join(own, key, "left").join(base, "_base", "left")
    toc = F.coalesce("_own", F.lit(1))
    return out.withColumn(
        "total_juan",
        F.coalesce(
            F.nullif(F.col(explicit), F.lit(0)),
            _sub_volumes(key),
            F.when(toc <= 1, F.greatest(toc, F.coalesce("_up", F.lit(1)))).otherwise(toc),
        ),
    ).drop("_base", "_own", "_up")


def resolve_volume(keys: DataFrame, juan_index: DataFrame, files: DataFrame) -> DataFrame:
    """File of each (work, volume): index position, then file name, then both for the base id.

    ``juan_index`` has (sutra_id, juan, file_ref); ``files`` has (sutra_id, juan, path). Sub-works are
    looked up by base id and global volume only.
    """
    k = keys.select("sutra_id", "juan").distinct()
    shifted = global_volume(k)
    is_sub = _sub_volumes("sutra_id").isNotNull()
    base = F.when(is_sub, F.col("base_id")).otherwise(base_work("sutra_id"))
    probes = shifted.withColumn("_b", base).select(
        "sutra_id", "juan",
        F.explode(F.array(
            F.struct(F.lit(0).alias("p"), F.when(~is_sub, F.col("sutra_id")).alias("w")),
            F.struct(F.lit(2).alias("p"), F.col("_b").alias("w")),
        )).alias("s"), "global_volume",
    ).select("sutra_id", "juan", "s.p", F.col("s.w").alias("_w"), F.col("global_volume").alias("_v")).filter(
        F.col("_w").isNotNull()
    )
    listed = juan_index.select(F.col("sutra_id").alias("_w"), F.col("juan").alias("_v"), F.col("file_ref").alias("path"))
    existing = files.select("path").distinct()
    by_index = probes.join(listed, ["_w", "_v"]).join(existing, "path", "left_semi")
    by_name = probes.join(files.select(F.col("sutra_id").alias("_w"), F.col("juan").alias("_v"), "path"), ["_w", "_v"])
    hits = by_index.select("sutra_id", "juan", "p", "path").unionByName(
        by_name.select("sutra_id", "juan", (F.col("p") + 1).alias("p"), "path")
    )
    found = hits.groupBy("sutra_id", "juan").agg(F.min(F.struct("p", "path")).alias("h"))
    return k.join(found, ["sutra_id", "juan"], "left").select("sutra_id", "juan", F.col("h.path").alias("path"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """Tree statistics as ``(metric, key, value)`` rows."""
    parents = tree.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).distinct()
    t = tree.join(parents.withColumn("_p", F.lit(True)), "id", "left").withColumn(
        "leaf", F.col("_p").isNull() & F.col("sutra_id").isNotNull()
    )

    def rows(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("bigint").alias("value"))

    totals = t.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("leaf").alias("leaves"),
        F.count_if(~F.col("leaf")).alias("categories"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_if(F.col("leaf") & ~F.col("sutra_id").rlike("^[A-Z]+[a-zA-Z]*[0-9]+[a-zA-Z]*$")).alias("malformed_ids"),
        F.count_if(F.col("_p").isNotNull() & F.col("sutra_id").isNotNull()).alias("categories_with_id"),
    )
    names = totals.columns
    totals = totals.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n).cast("bigint"))]).alias("metric", "value"))
    per_depth = t.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    per_canon = t.filter("leaf").groupBy(canon_of("sutra_id").alias("canon")).agg(F.count(F.lit(1)).alias("n"))
    dup = t.filter("leaf").groupBy("sutra_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        totals.select("metric", F.lit("").alias("key"), "value")
        .unionByName(rows(per_depth, "depth", F.col("depth"), F.col("n")))
        .unionByName(rows(per_canon, "canon_leaves", F.col("canon"), F.col("n")))
        .unionByName(rows(dup, "duplicate_id", F.col("sutra_id"), F.col("n")))
    )


def nav_quality(nodes: DataFrame, **tables: DataFrame) -> DataFrame:
    """Row counts of the navigation tables and number of roots and untitled nodes per tree."""
    out = nodes.groupBy("tree_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if(null_if_empty("title").isNull()).alias("untitled"),
        F.count("sutra_id").alias("with_id"),
    )
    out = out.withColumnRenamed("tree_type", "table_name")
    none = F.lit(None).cast("bigint")
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", none.alias("roots"), none.alias("untitled"), none.alias("with_id")
        )
        out = out.unionByName(counted)
    return out
