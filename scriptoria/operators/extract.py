"""Structural extraction from the event table.

All windows and aggregations are keyed by ``doc_path`` first. One document is one file, which a single task has already
parsed, so no key here is larger than a file. That task adds the positions where the corpus is built;
:func:`positioned` adds them to an event table that comes without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import as_col, first_group, null_if_empty, strip, try_int
from ..functions.text import drop_punctuation, drop_ws, note_object, page_ref
from ..sources.markup import attr, attr_of, child_of, node_texts, ordered_text, starts, under
from .firstwins import keep_first, next_sibling

WORK_ID_PATTERN = r"^([A-Z]+)(\d+)n([a-zA-Z]*)(\d+[a-zA-Z]?)"

# Note classes, and punctuation that does not count in a verse line.
SKIPPED_NOTE_TYPES = ["star", "K33"]
CROSS_REFERENCE_PREFIXES = ["cf1", "cf2", "cf3", "cf4", "cf5", "cf6", "cf.", "cf", "f1:"]
INLINE_PLACES = ["inline", "inline2", "interlinear"]
INLINE_TYPES = ["authorial"]
VERSE_PUNCTUATION = "。，、；：「」『』（）！？…—.,;:!?"
KEPT_NOTE_CLASSES = ["numbered", "paired", "mod", "cf"]


def _doc() -> Window:
    return Window.partitionBy("doc_path")


def positioned(elements: DataFrame, initial: int = 1) -> DataFrame:
    """Add ``juan`` (volume in document order), ``line_id`` (latest line mark, '' before the first) and ``has_back``.

    A document with at most one volume mark belongs to that volume entirely.
    """
    run = _doc().orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_start, in_body = F.col("kind") == "start", F.col("region") == "body"
    mark = F.when(
        is_start & in_body & (F.col("tag") == "milestone") & (attr("unit") == "juan"),
        try_int(F.coalesce(F.col("attrs")["n"], F.lit("1"))),
    )
    line = F.when(is_start & in_body & (F.col("tag") == "lb"), attr("n"))
    return (
        elements.withColumn("_mark", mark)
        .withColumn("_running", F.last("_mark", ignorenulls=True).over(run))
        .withColumn("line_id", F.coalesce(F.last(line, ignorenulls=True).over(run), F.lit("")))
        .withColumn("_n", F.count("_mark").over(_doc()))
        .withColumn("_only", F.max("_mark").over(_doc()))
        .withColumn("has_back", F.max(F.col("tag") == "back").over(_doc()))
        .withColumn(
            "juan",
            F.when(F.col("_n") <= 1, F.coalesce("_only", F.lit(initial))).otherwise(F.coalesce("_running", F.lit(initial))),
        )
        .drop("_mark", "_running", "_n", "_only")
    )


def work_id_parts(xml_id: Column | str) -> dict[str, Column]:
    """``sutra_id``, ``canon`` and ``volume`` of an id such as ``T08n0251``; other ids are kept whole."""
    c = as_col(xml_id)
    number = F.concat(F.regexp_extract(c, WORK_ID_PATTERN, 3), F.regexp_extract(c, WORK_ID_PATTERN, 4))
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0"))
    canon = F.regexp_extract(c, WORK_ID_PATTERN, 1)
    ok = c.rlike(WORK_ID_PATTERN)
    return {
        "sutra_id": F.when(ok, F.concat(canon, padded)).otherwise(c),
        "canon": canon,
        "volume": F.regexp_extract(c, WORK_ID_PATTERN, 2),
    }


def doc_works(elements: DataFrame) -> DataFrame:
    """``(doc_path, sutra_id, canon, volume)`` from the root element's id."""
    root = elements.filter((F.col("kind") == "start") & (F.col("node_id") == 0))
    return root.select("doc_path", *[c.alias(n) for n, c in work_id_parts(attr("id")).items()])


def extract_metadata(elements: DataFrame) -> DataFrame:
    """Catalogue row per document: ids, title, author and number of volumes."""
    is_start, is_text = F.col("kind") == "start", F.col("kind") == "text"
    in_header = F.col("region") == "header"

    def lead_text(tag: str, cond: Column) -> Column:
        """Text right after the first matching start tag (null when a child element comes first)."""
        here = in_header & (F.col("tag") == tag)
        at = F.min(F.when(is_start & here & cond, F.col("seq")))
        first = F.min(F.when(is_text & here, F.struct("seq", "text")))
        return F.struct(at.alias("at"), first.alias("t"))

    by_doc = elements.filter((F.col("node_id") == 0) | in_header).groupBy("doc_path").agg(
        F.max(F.when(is_start & (F.col("node_id") == 0), attr("id"))).alias("xml_id"),
        lead_text("author", child_of("titleStmt")).alias("_author"),
        lead_text("extent", F.lit(True)).alias("_extent"),
    )

    def leading(name: str) -> Column:
        s = F.col(name)
        return F.when(s["t"]["seq"] == s["at"] + 1, s["t"]["text"])

    titles = node_texts(elements, "title").filter((attr("level") == "m") & (attr("lang") == "zh-Hant"))
    title = keep_first(titles, ["doc_path"], ["seq"]).select("doc_path", strip("text").alias("_title"))
    return by_doc.join(title, "doc_path", "left").select(
        "doc_path",
        "xml_id",
        *[c.alias(n) for n, c in work_id_parts("xml_id").items()],
        F.coalesce(null_if_empty("_title"), "xml_id").alias("title"),
        strip(F.coalesce(leading("_author"), F.lit(""))).alias("author"),
        F.coalesce(first_group(leading("_extent"), r"(\d+)").cast("int"), F.lit(1)).alias("total_juan"),
    )


def extract_header(elements: DataFrame) -> DataFrame:
    """Extended header fields per document; absent fields are null."""
    header = elements.filter(F.col("region") == "header")
    n = node_texts(
        header, "title", "author", "extent", "idno", "bibl", "p", "witness", "language", "edition"
    ).withColumn("value", null_if_empty(strip("text")))
    tag, lang = F.col("tag"), attr("lang")
    parent = F.try_element_at("ancestor_tags", F.lit(-1))

    def first(cond: Column, required: bool = True) -> Column:
        """Value of the first matching element; with ``required`` the first one that is not empty."""
        cond = cond & F.col("value").isNotNull() if required else cond
        return F.min_by("value", F.when(cond, F.col("seq")))

    def last(cond: Column) -> Column:
        return F.max_by("value", F.when(cond & F.col("value").isNotNull(), F.col("seq")))

    def idno(kind: str) -> Column:
        return last((tag == "idno") & (parent == "idno") & (attr("type") == kind))

    def listed(cond: Column, sep: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(cond & F.col("value").isNotNull(), F.struct("seq", "value"))))
        return null_if_empty(F.array_join(F.transform(items, lambda s: s["value"]), sep))

    in_title = (tag == "title") & (parent == "titleStmt")
    fields = n.groupBy("doc_path").agg(
        last(in_title & (attr("level") == "m") & F.contains(lang, F.lit("zh"))).alias("title_zh"),
        last(in_title & (attr("level") == "s") & F.contains(lang, F.lit("zh"))).alias("canon_name_zh"),
        last(in_title & (attr("level") == "s") & (lang == "")).alias("canon_name_en"),
        first((tag == "author") & (parent == "titleStmt"), False).alias("author"),
        first(tag == "extent", False).alias("extent"),
        idno("canon").alias("canon_code"),
        idno("vol").alias("vol"),
        idno("no").alias("no"),
        first((tag == "bibl") & (parent == "sourceDesc"), False).alias("source"),
        first((tag == "p") & (parent == "msDesc"), False).alias("ms_desc"),
        first((tag == "p") & (parent == "projectDesc") & F.contains(lang, F.lit("zh")), False).alias("contributors"),
        first((tag == "p") & (parent == "punctuation"), False).alias("punctuation"),
        listed((tag == "witness") & under("tagsDecl"), " ").alias("witnesses"),
        listed((tag == "language") & (parent == "langUsage") & (attr("ident") != "zh-Hant"), "、").alias("languages"),
        first((tag == "p") & (parent == "availability"), False).alias("availability"),
        first((tag == "edition") & (parent == "editionStmt"), False).alias("edition"),
    )
    ref = F.concat_ws(".", null_if_empty("canon_code"), null_if_empty("vol"), null_if_empty("no"))
    return fields.withColumn("canon_ref", null_if_empty(ref))


def body_text(pos: DataFrame) -> DataFrame:
    """Running-text events of the body."""
    return pos.filter((F.col("kind") == "text") & (F.col("region") == "body") & F.col("nearest_skip").isNull())


def extract_text(pos: DataFrame) -> DataFrame:
    """Plain text per (document, volume)."""
    return body_text(pos).groupBy("doc_path", "juan").agg(ordered_text().alias("plain_text"))


def volume_pieces(pos: DataFrame) -> DataFrame:
    """Running-text events of the body, and an empty one for each marked volume."""
    marked = starts(pos, "milestone").filter((F.col("region") == "body") & (attr("unit") == "juan"))
    empty = marked.select("doc_path", "juan", F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("text"))
    return body_text(pos).select("doc_path", "juan", "seq", "text").unionByName(empty)


def split_volumes(pos: DataFrame) -> DataFrame:
    """As :func:`extract_text`, but every marked volume has a row even when it holds no text."""
    return volume_pieces(pos).groupBy("doc_path", "juan").agg(ordered_text().alias("plain_text"))


def extract_notes(pos: DataFrame) -> DataFrame:
    """Non-empty notes of the body with their line and volume."""
    n = node_texts(pos, "note", keep=("line_id", "juan")).filter(F.col("region") == "body")
    return n.select(
        "doc_path", "seq", "juan", "line_id", attr("type").alias("note_type"), attr("place").alias("place"),
        strip("text").alias("content"),
    ).filter(F.col("content") != "")


def extract_toc(pos: DataFrame) -> DataFrame:
    """Table-of-contents marks; the title falls back to ``n`` and a bad level counts as 0."""
    m = node_texts(pos, "mulu", keep=("juan",)).filter(F.col("region") == "body")
    return m.select(
        "doc_path", "seq", "juan",
        F.coalesce(try_int(F.col("attrs")["level"]), F.lit(0)).alias("level"),
        attr("type").alias("type"), attr("n").alias("n"),
        F.coalesce(null_if_empty(strip("text")), attr("n")).alias("title"),
    ).filter(F.col("title") != "")


def extract_apparatus(pos: DataFrame, initial: int = 1) -> DataFrame:
    """Variant apparatus: base reading and array of variant readings, from the back matter when there is one.

    An entry in the back matter belongs to the volume of the anchor or line mark that its ``from`` names, else to the
    initial volume.
    """
    body = starts(pos, "anchor", "lb").filter(F.col("region") == "body")
    name = F.when(F.col("tag") == "anchor", attr("id")).otherwise(attr("n"))
    anchors = body.select("doc_path", name.alias("_ref"), "juan", "seq").filter(F.col("_ref") != "")
    anchors = anchors.groupBy("doc_path", "_ref").agg(F.min_by("juan", "seq").alias("_at"))
    pos = pos.filter(F.col("region") == F.when(F.col("has_back"), "back").otherwise("body"))
    parts = node_texts(pos, "lem", "rdg").filter(child_of("app")).select(
        "doc_path",
        F.col("parent_id").alias("node_id"),
        F.when(F.col("tag") == "lem", F.struct("seq", strip("text").alias("text"))).alias("lem"),
        F.when(F.col("tag") == "rdg", F.struct("seq", attr("wit").alias("wit"), strip("text").alias("text"))).alias("rdg"),
    )
    # Start tags of <app> join the same aggregation as one more row per node.
    apps = starts(pos, "app").withColumn("_ref", F.ltrim(attr("from"), F.lit("#"))).join(anchors, ["doc_path", "_ref"], "left")
    volume = F.when(F.col("region") == "back", F.coalesce("_at", F.lit(initial))).otherwise(F.col("juan"))
    apps = apps.select("doc_path", "node_id", F.struct("seq", volume.alias("juan"), "attrs").alias("app"))
    grouped = (
        apps.unionByName(parts, allowMissingColumns=True)
        .groupBy("doc_path", "node_id")
        .agg(
            F.first("app", ignorenulls=True).alias("app"),
            F.max("lem").alias("lem"),
            F.array_sort(F.collect_list("rdg")).alias("rdgs"),
        )
    )
    return grouped.filter(F.col("app").isNotNull()).select(
        "doc_path", F.col("app.seq").alias("seq"), F.col("app.juan").alias("juan"),
        attr_of("app.attrs", "from").alias("line_id"), attr_of("app.attrs", "n").alias("n"),
        F.coalesce("lem.text", F.lit("")).alias("lem_text"),
        F.transform("rdgs", lambda r: F.struct(r["wit"].alias("wit"), r["text"].alias("text"))).alias("readings"),
    ).filter((F.col("lem_text") != "") | (F.size("readings") > 0))


def classify_notes(pos: DataFrame) -> DataFrame:
    """Every body note with its class and, for kept notes, a running number per volume.

    Classes: ``skip``, ``paired`` (an apparatus with the same number follows), ``mod`` (stand-alone
    variant note), ``cf`` (cross reference), ``inline``, ``numbered``, ``transparent``.
    """
    body = pos.filter((F.col("kind") == "start") & (F.col("region") == "body"))
    sib = body.select("doc_path", "parent_id", "node_id", "seq", "tag", attr("n").alias("n"), attr("type").alias("type"))
    sib = next_sibling(sib, ["doc_path", "parent_id"], ["seq"], ["tag", "n", "type"]).filter(F.col("tag") == "note")
    texts = node_texts(pos, "note", keep=("line_id", "juan")).filter(F.col("region") == "body")
    rows = texts.join(sib.select("doc_path", "node_id", "next_tag", "next_n", "next_type"), ["doc_path", "node_id"])

    ntype, n, place = attr("type"), attr("n"), attr("place")
    nested = under("note") | under("lem") | under("rdg")
    same_n = F.coalesce(F.col("next_n") == n, F.lit(False))
    before_mod = F.coalesce((F.col("next_tag") == "note") & (F.col("next_type") == "mod"), F.lit(False)) & same_n
    before_app = F.coalesce(F.col("next_tag").isin("app", "tt"), F.lit(False)) & same_n
    is_cf = ntype.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in CROSS_REFERENCE_PREFIXES) + ")")
    empty = strip("text") == ""
    numbered = F.when(before_app, "paired").otherwise("numbered")
    cls = (
        F.when(ntype.isin(SKIPPED_NOTE_TYPES), "skip")
        .when(ntype == "orig", F.when(before_mod | nested | (n == ""), "skip").otherwise("numbered"))
        .when(ntype == "mod", F.when(nested, "skip").when(before_app, "paired").otherwise("mod"))
        .when(is_cf, F.when(nested | empty, "skip").otherwise("cf"))
        .when(nested, "transparent")
        .when(place.isin(INLINE_PLACES) | ntype.isin(INLINE_TYPES), F.when(empty, "skip").otherwise("inline"))
        .when(n != "", numbered)
        .otherwise("transparent")
    )
    rows = rows.select(
        "doc_path", "seq", "node_id", "juan", "line_id", n.alias("n"), ntype.alias("note_type"), place.alias("place"),
        F.col("text").alias("content"), cls.alias("note_class"),
    ).withColumn("kept", F.col("note_class").isin(KEPT_NOTE_CLASSES))
    w = Window.partitionBy("doc_path", "juan", "kept").orderBy("seq")
    return rows.withColumn("note_idx", F.when(F.col("kept"), F.row_number().over(w))).withColumn(
        "object_text", F.when(F.col("note_class") == "mod", note_object("content"))
    )


def link_apparatus_notes(apparatus: DataFrame, notes: DataFrame) -> DataFrame:
    """Left-join each apparatus entry with the first kept note of its number.

    A note of the entry's own volume comes first, and there one that stands before its apparatus (``paired``). Another
    volume's note is taken only if no second volume of the document has that number.
    """
    kept = notes.filter(F.col("kept") & (F.col("n") != ""))
    order = F.struct((F.col("note_class") != "paired").alias("apart"), "seq")
    first = kept.groupBy("doc_path", "n", F.col("juan").alias("_juan")).agg(F.min_by(F.struct("note_idx", F.col("content").alias("note_text")), order).alias("_note"))
    first = first.withColumn("_volumes", F.count(F.lit(1)).over(Window.partitionBy("doc_path", "n")))
    entry = ["doc_path", "seq"]
    own = F.col("_juan") == F.col("juan")
    pairs = apparatus.select(*entry, "juan", "n").join(first, ["doc_path", "n"]).filter(own | (F.col("_volumes") == 1))
    best = pairs.groupBy(*entry).agg(F.max_by("_note", own).alias("_note"))
    return apparatus.join(best, entry, "left").select(*apparatus.columns, "_note.note_idx", "_note.note_text")


def extract_parallel_terms(pos: DataFrame) -> DataFrame:
    """Bilingual groups: Chinese text, Siddham text and the labelled foreign variants."""
    t = node_texts(pos, "t").filter(child_of("tt") & (F.col("region") == "body"))
    lang = attr("lang")
    zh, sidd = F.contains(lang, F.lit("zh")), F.contains(lang, F.lit("Sidd"))
    t = t.select(
        "doc_path", F.col("parent_id").alias("node_id"), "seq",
        F.when(zh, F.col("text")).alias("zh"),
        F.when(~zh & sidd, F.col("text")).alias("sidd"),
        F.when(~zh, F.concat(F.coalesce(null_if_empty(F.upper(lang)), F.lit("?")), F.lit(": "), "text")).alias("other"),
    )
    grouped = t.groupBy("doc_path", "node_id").agg(
        ordered_text("zh").alias("zh_text"),
        ordered_text("sidd").alias("siddham_text"),
        ordered_text("other", delimiter=" ｜ ").alias("foreign"),
    )
    group = starts(pos, "tt").select("doc_path", "node_id", attr("n").alias("n"), attr("type").alias("type"))
    return grouped.join(group, ["doc_path", "node_id"])


def extract_refs(elements: DataFrame) -> DataFrame:
    """Cross-reference edges: link targets that hold a file id."""
    target = F.coalesce(F.col("attrs")["target"], F.col("attrs")["href"], F.col("attrs")["cRef"])
    return (
        elements.filter((F.col("kind") == "start") & target.isNotNull())
        .select("doc_path", "seq", "tag", first_group(target, r"([A-Z]+\d+n[a-z]?\d+[a-z]?)").alias("ref_target"))
        .filter(F.col("ref_target").isNotNull())
    )


def extract_page_refs(elements: DataFrame) -> DataFrame:
    """Viewer references of the first column of each page."""
    return (
        starts(elements, "pb")
        .select("doc_path", "seq", attr("n").alias("page_id"), page_ref(attr("id")).alias("image_ref"))
        .filter(F.col("page_id").endswith("a") & F.col("image_ref").isNotNull())
    )


def extract_verse_lines(pos: DataFrame) -> DataFrame:
    """Verse lines with their length in characters other than punctuation and white space."""
    lines = node_texts(pos, "l").filter(under("lg"))
    return lines.select(
        "doc_path", "seq", strip("text").alias("line"), F.length(drop_ws(drop_punctuation("text", VERSE_PUNCTUATION))).alias("n_chars")
    ).filter(F.col("n_chars") > 0)
