"""Teacher-student and social graph: profiles, ego networks, layers, places and map layers.

``persons(person_id, name, dynasty, sect, birth_year, death_year, ...)``,
``edges(source_id, target_id, edge_type, description, ref)``, ``places(place_id, ...)``.
Results are long tables; no person's neighbours are gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import strip, text_or_empty
from ..functions.predicates import has_tag, located, match_text
from ..functions.text import tile_xy
from ..session import materialize
from .firstwins import bounded_groups, top_k

# Place categories of the map layers.
TEMPLE_TAG, MOUNTAIN_TAG = "寺廟", "山峰"


def _typed(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("edge_type") == kind)


def teachers(keys: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Teachers of each key person."""
    e = _typed(edges, "teacher").select(
        F.col("target_id").alias("person_id"), F.col("source_id").alias("other_id"), "description"
    )
    return _others(keys, e, persons)


def students(keys: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    e = _typed(edges, "teacher").select(
        F.col("source_id").alias("person_id"), F.col("target_id").alias("other_id"), "description"
    )
    return _others(keys, e, persons)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Social edges in both directions; a self-loop counts once."""
    e = _typed(edges, "social")
    forth = e.select(F.col("source_id").alias("person_id"), F.col("target_id").alias("other_id"), "description")
    back = e.filter(F.col("source_id") != F.col("target_id")).select(
        F.col("target_id").alias("person_id"), F.col("source_id").alias("other_id"), "description"
    )
    return forth.unionByName(back)


def social_peers(keys: DataFrame, edges: DataFrame, persons: DataFrame, k: int | None = None) -> DataFrame:
    """Social contacts of each key person; the first ``k`` by id if a page size is given."""
    peers = _others(keys, _both_ways(edges), persons)
    return peers if k is None else top_k(peers, ["person_id"], ["other_id", F.col("description").asc_nulls_first()], k)


def _others(keys: DataFrame, pairs: DataFrame, persons: DataFrame) -> DataFrame:
    p = persons.select(F.col("person_id").alias("other_id"), "name", "dynasty", "sect", "birth_year")
    return keys.select("person_id").distinct().join(pairs, "person_id").join(p, "other_id")


def scriptures_of(keys: DataFrame, person_scriptures: DataFrame) -> DataFrame:
    return keys.select("person_id").distinct().join(person_scriptures, "person_id")


def persons_of_work(keys: DataFrame, person_scriptures: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons of each work, split into authors and mentioned persons."""
    section = F.when(F.col("relation") == "authored", "authored").otherwise("mentioned")
    return (
        keys.select("sutra_id").distinct()
        .join(person_scriptures.withColumnRenamed("scripture_id", "sutra_id"), "sutra_id")
        .join(persons, "person_id")
        .select(
            "sutra_id", section.alias("section"), "relation", "person_id", "name", text_or_empty("dynasty").alias("dynasty"),
            text_or_empty("sect").alias("sect"), "birth_year", "death_year",
        )
    )


def student_counts(edges: DataFrame) -> DataFrame:
    return _typed(edges, "teacher").groupBy(F.col("source_id").alias("person_id")).agg(
        F.count(F.lit(1)).alias("student_count")
    )


def person_attributes(keys: DataFrame, persons: DataFrame, json_cols=("aliases", "text_refs")) -> DataFrame:
    """Attributes of each key person; JSON fields also as arrays (null when malformed, the raw text stays)."""
    p = persons
    for c in json_cols:
        if c in persons.columns:
            p = p.withColumn(f"{c}_list", F.from_json(c, "array<string>"))
    return keys.select("person_id").distinct().join(p, "person_id")


def person_profile(
    keys: DataFrame, persons: DataFrame, edges: DataFrame, person_scriptures: DataFrame, social_limit: int | None = None
) -> DataFrame:
    """Profile rows ``(person_id, section, other_id, name, dynasty, sect, birth_year, note)``.

    Sections: teacher, student, social, scripture. Reading order inside a section is birth year (nulls
    first) for students and (note, id) for scriptures.
    """
    cols = ["person_id", "other_id", "name", "dynasty", "sect", "birth_year"]

    def part(df: DataFrame, section: str, note: Column) -> DataFrame:
        return df.select(*cols, F.lit(section).alias("section"), note.alias("note"))

    none = F.lit(None).cast("string")
    works = scriptures_of(keys, person_scriptures).select(
        "person_id", F.col("scripture_id").alias("other_id"), none.alias("name"), none.alias("dynasty"),
        none.alias("sect"), F.lit(None).cast("int").alias("birth_year"), F.lit("scripture").alias("section"),
        F.col("relation").alias("note"),
    )
    return (
        part(teachers(keys, edges, persons), "teacher", F.col("description"))
        .unionByName(part(students(keys, edges, persons), "student", none))
        .unionByName(part(social_peers(keys, edges, persons, social_limit), "social", F.col("description")))
        .unionByName(works)
    )


# -- ego networks ----------------------------------------------------------------------------------


def _expand(frontier: DataFrame, steps: DataFrame, seen: DataFrame, level: int) -> DataFrame:
    """Next breadth-first level of every ego: new (ego, node) pairs only."""
    new = frontier.join(steps, frontier["node"] == steps["_from"]).select("ego", F.col("_to").alias("node")).distinct()
    return new.join(seen.select("ego", "node"), ["ego", "node"], "left_anti").withColumn("level", F.lit(level))


def _bfs(egos: DataFrame, steps: DataFrame, levels: int) -> DataFrame:
    """Nodes within ``levels`` steps of each ego; every level is written once and read by the next."""
    frontier = egos.select(F.col("person_id").alias("ego"), F.col("person_id").alias("node"), F.lit(0).alias("level"))
    seen = frontier
    for level in range(1, levels + 1):
        frontier = materialize(_expand(frontier, steps, seen, level), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def ego_network(keys: DataFrame, edges: DataFrame, persons: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around every ego at once.

    Down: nodes up to ``depth - 1`` steps and the edges leaving them. Up: direct teachers and the edges
    entering the ego and its teachers. Each node has its minimal distance (``level``, negative upwards);
    an edge to a node that is not returned has ``dangling`` set.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be between 1 and 5")
    t = _typed(edges, "teacher")
    extra = [c for c in ("description", "ref") if c in t.columns]
    down = t.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to")).distinct()
    up = t.select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to")).distinct()
    egos = keys.select("person_id").distinct()
    below = _bfs(egos, down, depth - 1)
    above = _bfs(egos, up, 1)
    levels = (
        below.unionByName(above.withColumn("level", -F.col("level")))
        .groupBy("ego", "node")
        .agg(F.min_by("level", F.struct(F.abs("level"), "level")).alias("level"))
    )
    p = persons.select("person_id", "name", "dynasty", "sect", "birth_year", "death_year").join(
        student_counts(edges), "person_id", "left"
    ).withColumn("student_count", F.coalesce("student_count", F.lit(0)))
    nodes = levels.join(p, levels["node"] == p["person_id"]).drop("node")

    out_edges = below.join(t, below["node"] == t["source_id"]).select("ego", "source_id", "target_id", *extra)
    in_edges = above.join(t, above["node"] == t["target_id"]).select("ego", "source_id", "target_id", *extra)
    all_edges = out_edges.unionByName(in_edges).distinct()
    known = nodes.select("ego", F.col("person_id").alias("_n"), F.lit(True).alias("_known"))
    for end in ("source_id", "target_id"):
        all_edges = (
            all_edges.join(known.withColumnRenamed("_n", end), ["ego", end], "left")
            .withColumnRenamed("_known", f"_{end}")
        )
    dangling = F.col("_source_id").isNull() | F.col("_target_id").isNull()
    all_edges = all_edges.withColumn("dangling", dangling).select("ego", "source_id", "target_id", *extra, "dangling")
    return nodes, all_edges


def graph_layers(nodes: DataFrame, edges: DataFrame, reach: int = 2) -> DataFrame:
    """Signed layer (students positive, teachers negative) of the nodes met within ``reach`` layers."""
    e = edges.filter(~F.col("dangling")) if "dangling" in edges.columns else edges
    e = materialize(
        e.select("ego", F.col("source_id").alias("_from"), F.col("target_id").alias("_to"), F.lit(1).alias("_d"))
        .unionByName(e.select("ego", F.col("target_id").alias("_from"), F.col("source_id").alias("_to"), F.lit(-1).alias("_d")))
        .distinct(),
        "steps",
    )
    frontier = nodes.filter(F.col("person_id") == F.col("ego")).select("ego", F.col("ego").alias("node"), F.lit(0).alias("layer"))
    seen = frontier
    while True:
        step = (
            frontier.join(e.withColumnRenamed("_from", "node"), ["ego", "node"])
            .withColumn("layer", F.col("layer") + F.col("_d"))
            .filter(F.abs("layer") <= reach)
            .groupBy("ego", F.col("_to").alias("node"))
            .agg(F.min("layer").alias("layer"))
        )
        frontier = materialize(step.join(seen.select("ego", "node"), ["ego", "node"], "left_anti"), "layer")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def prune_graph(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """First ``n`` nodes of each ego by distance, and the edges both of whose ends are kept."""
    kept = top_k(nodes, ["ego"], [F.abs("level"), "level", "person_id"], n)
    ids = kept.select("ego", "person_id")
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("person_id", end), ["ego", end], "left_semi")
    return kept, edges


def graph_stats(persons: DataFrame, edges: DataFrame, places: DataFrame, person_scriptures: DataFrame) -> DataFrame:
    """One row: persons, teacher edges, located places, distinct scriptures."""
    one = persons.agg(F.count(F.lit(1)).alias("persons"))
    return one.select(
        "persons",
        edges.agg(F.count_if(F.col("edge_type") == "teacher")).scalar().alias("edges"),
        places.agg(F.count("latitude")).scalar().alias("places"),
        person_scriptures.agg(F.count_distinct("scripture_id")).scalar().alias("scriptures"),
    )


# -- places ----------------------------------------------------------------------------------------


def explode_places(persons: DataFrame, col: str = "place_origin", prefix: str = "PL") -> DataFrame:
    """One row per place id written on its own line; ``place_name`` is the first line."""
    lines = F.transform(F.split(strip(F.col(col)), "\n"), strip)
    return (
        persons.filter(F.col(col).isNotNull())
        .withColumn("place_name", F.get(lines, F.lit(0)))
        .withColumn("place_id", F.explode(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix)))))
    )


def person_places(keys: DataFrame, persons: DataFrame, places: DataFrame) -> DataFrame:
    who = explode_places(keys.select("person_id").distinct().join(persons, "person_id"))
    return who.select("person_id", "place_id").join(
        places.select("place_id", "name_zh", "latitude", "longitude", "district"), "place_id"
    )


def origins(persons: DataFrame, places: DataFrame, sect: str | None = None) -> DataFrame:
    """Located places of origin with their number of persons."""
    p = persons.filter(F.col("place_origin").isNotNull())
    if sect:
        p = p.filter(match_text("sect", F.lit(sect)))
    who = explode_places(p)
    per = who.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("n_persons"), F.min_by("place_name", "person_id").alias("_first")
    )
    return located(places).join(per, "place_id").select(
        "place_id", F.coalesce(F.nullif("name_zh", F.lit("")), "_first").alias("name"), "latitude", "longitude",
        "district", "n_persons",
    )


def origin_persons(persons: DataFrame, places: DataFrame, limit: int = 1000) -> DataFrame:
    """Persons of each located origin as sorted arrays (very long lists continue in further parts)."""
    who = explode_places(persons).select("place_id", "person_id", "name", "sect", "dynasty")
    who = who.join(located(places).select("place_id"), "place_id", "left_semi")
    item = F.struct("person_id", "name", "sect", "dynasty")
    return bounded_groups(who, ["place_id"], item, "person_id", "persons", limit)


def map_layers(persons: DataFrame, places: DataFrame, sect: str | None = None, limit: int | None = None) -> DataFrame:
    """Origins, temples and mountains as one table with a ``layer`` column; ``limit`` is a page size per layer, by id."""
    cols = ["place_id", "name", "latitude", "longitude", "district"]
    layers = origins(persons, places, sect).select(F.lit("origin").alias("layer"), *cols, "n_persons")
    for layer, tag in (("temple", TEMPLE_TAG), ("mountain", MOUNTAIN_TAG)):
        hit = located(places).filter(has_tag("category", tag)).withColumnRenamed("name_zh", "name")
        layers = layers.unionByName(hit.select(F.lit(layer).alias("layer"), *cols, F.lit(None).cast("bigint").alias("n_persons")))
    return layers if limit is None else top_k(layers, ["layer"], ["place_id"], limit)


def bin_places(places: DataFrame, zoom: int) -> DataFrame:
    """Located places grouped by map tile, with the centre of each group."""
    x, y = tile_xy("latitude", "longitude", F.lit(zoom))
    return (
        located(places)
        .groupBy(x.alias("tile_x"), y.alias("tile_y"))
        .agg(
            F.count(F.lit(1)).alias("n_places"),
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
        )
    )
