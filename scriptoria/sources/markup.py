"""Flatten markup to an event table: one row per start tag, text piece and end tag.

Mixed content needs document order, which the XML data source does not keep, so each file is
tokenised once inside a task (standard-library parsers, Arrow batches out). Everything after this
stage is DataFrame code. The task writes the ids and tags of the open elements as one text each, made once per
element and not once per event; ``unfolded`` makes arrays of them where a query reads them.

A text event belongs to the node ``x`` of its ``ancestors`` if no skipped element was opened between
them: ``nearest_skip IS NULL OR nearest_skip <= x`` (ids are handed out in document order, so a
smaller id among the ancestors of one event is the outer one).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce
from html.parser import HTMLParser
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, text_or_empty
from ..functions.text import resolve_glyph

ELEMENTS_DDL = (
    "doc_path string, seq bigint, kind string, tag string, ns string, depth int, node_id bigint, "
    "parent_id bigint, id_path string, tag_path string, nearest_skip bigint, "
    "region string, attrs map<string,string>, text string"
)  # of the table as it is written; ``unfolded`` adds the arrays
POSITIONS_DDL = "line_id string, has_back boolean, juan int"

# Elements whose content is no running text (notes, variants, anchors, rejected
# readings, empty elements; glyph references carry their text in a synthetic event).
TEI_SKIP = {
    "note", "rdg", "anchor", "back", "mulu", "charDecl", "teiHeader",
    "sic", "orig", "lb", "pb", "milestone", "space", "caesura", "g",
}
HTML_SKIP = {"script", "style", "template"}
HTML_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# A new element of these kinds closes an open one of the same kind, up to the nearest container.
HTML_IMPLIED_END = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
HTML_CONTAINERS = {"div", "article", "section", "ul", "ol", "table", "nav", "body", "blockquote"}
TEI_REGIONS = {"teiHeader": "header", "body": "body", "back": "back"}  # a head is a heading here
HTML_REGIONS = {"head": "header", "body": "body"}
IDEOGRAPHIC_SPACE = chr(0x3000)

_ARROW = pa.schema(
    [
        ("doc_path", pa.string()),
        ("seq", pa.int64()),
        ("kind", pa.string()),
        ("tag", pa.string()),
        ("ns", pa.string()),
        ("depth", pa.int32()),
        ("node_id", pa.int64()),
        ("parent_id", pa.int64()),
        ("id_path", pa.string()),  # ids of the ancestors with blanks between them
        ("tag_path", pa.string()),  # their tags with slashes between them
        ("nearest_skip", pa.int64()),
        ("region", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
    ]
)
_PLACED = pa.schema([*_ARROW, ("line_id", pa.string()), ("has_back", pa.bool_()), ("juan", pa.int32())])
WIDTH = len(_ARROW) + 1
_INTEGER = re.compile("[+-]?[0-9]+")
_BLANK = "".join(map(chr, range(0x21))) + "\x7f"  # what a cast to a number leaves out at both ends


class _Events:
    """Collects the events of one document; the same for both dialects.

    ``cells`` has ``WIDTH`` entries an event, the columns of ``_ARROW`` (attributes as names and values in turn) and the
    line mark. An open element is (id, tag, ids and tags down to it, skip, region).
    """

    def __init__(self, path: str, skip: set[str], regions: dict[str, str]):
        self.path, self.skip, self.region_of = path, skip, regions
        self.cells: list = []  # one list and no row objects, which the garbage collector would visit again and again
        self.n = 0
        self.tags: list[str] = []
        self.above: list[tuple] = []
        self.here: tuple = (None, None, "", "", None, "front")
        self.pending: list[str] = []
        self.next_id = 0
        self.line = ""
        self.marks: list[tuple[int, int]] = []  # volume marks and their rows
        self.has_back: bool | None = None

    def _text(self, tag, text, attrs=()):
        node, _, ids, tags, skip, region = self.here
        if tag is not None and self.has_back is None:
            self.has_back = False
        self.cells += (self.path, self.n, "text", tag, None, len(self.tags), node, node, ids, tags, skip, region, attrs, text, self.line)
        self.n += 1

    def flush(self):
        if self.pending:
            text = "".join(self.pending)
            self.pending.clear()
            self._text(self.here[1], text)

    def start(self, tag, ns, attrs):
        if self.pending:
            self.flush()
        if tag == "g":
            self._text("g", None, tuple(x for k, v in attrs if k == "ref" for x in (k, v)))
        elif tag == "space":
            q = dict(attrs).get("quantity", "1").strip()
            self._text("space", IDEOGRAPHIC_SPACE * (int(q) if q.lstrip("+-").isdigit() else 1))
        elif tag == "caesura":
            self._text("caesura", IDEOGRAPHIC_SPACE)
        up = self.here
        parent, _, ids, tags, skip, region = up
        node = self.next_id
        self.next_id = node + 1
        if tag in self.skip:
            skip = node
        region = self.region_of.get(tag, region)
        if tag == "back":
            self.has_back = True
        elif self.has_back is None:
            self.has_back = False
        if region == "body" and (tag == "lb" or tag == "milestone"):
            self._mark(tag, attrs)
        depth = len(self.tags)
        flat = tuple(chain.from_iterable(attrs)) if attrs else ()
        self.cells += (self.path, self.n, "start", tag, ns, depth, node, parent, ids, tags, skip, region, flat, None, self.line)
        self.n += 1
        self.above.append(up)
        self.tags.append(tag)
        self.here = (node, tag, f"{ids} {node}", f"{tags}/{tag}", skip, region) if depth else (node, tag, str(node), tag, skip, region)

    def _mark(self, tag, attrs):
        attrs = dict(reversed(attrs))  # of equal names the first counts
        if tag == "lb":
            self.line = attrs.get("n", "")
        elif attrs.get("unit") == "juan" and (n := _int(attrs.get("n", "1"))) is not None:
            self.marks.append((self.n, n))

    def end(self):
        if self.pending:
            self.flush()
        node, tag, _, _, skip, region = self.here
        self.tags.pop()
        self.here = up = self.above.pop()
        self.cells += (self.path, self.n, "end", tag, None, len(self.tags), node, up[0], up[2], up[3], skip, region, (), None, self.line)
        self.n += 1

    def volumes(self, initial: int) -> list[int]:
        """Volume of each row (see ``extract.positioned``)."""
        if len(self.marks) <= 1:
            return [self.marks[0][1] if self.marks else initial] * self.n
        out = [initial] * self.marks[0][0]
        for (at, volume), (end, _) in zip(self.marks, [*self.marks[1:], (self.n, 0)]):
            out += [volume] * (end - at)
        return out


def _split(name: str) -> tuple[str, str | None]:
    return (name.rsplit("}", 1)[1], name[1:].rsplit("}", 1)[0]) if name.startswith("{") else (name, None)


class _TeiTarget:
    """Strict XML; attribute names keep their local part (``xml:id`` becomes ``id``)."""

    def __init__(self, events: _Events):
        self.e, self.names = events, {}
        self.data, self.close = events.pending.append, events.flush

    def _name(self, name):
        self.names[name] = parts = _split(name)
        return parts

    def start(self, tag, attrs):
        names = self.names
        local, ns = names.get(tag) or self._name(tag)
        self.e.start(local, ns, [((names.get(k) or self._name(k))[0], v) for k, v in attrs.items()] if attrs else ())

    def end(self, _tag):
        self.e.end()


class _HtmlTarget(HTMLParser):
    """Tolerant HTML: unclosed elements end with their container."""

    def __init__(self, events: _Events):
        super().__init__(convert_charrefs=True)
        self.e = events

    def _pop_to(self, tag, stop=frozenset()):
        for i in range(len(self.e.tags) - 1, -1, -1):
            if self.e.tags[i] == tag:
                while len(self.e.tags) > i:
                    self.e.end()
                return
            if self.e.tags[i] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in HTML_IMPLIED_END:
            self._pop_to(tag, HTML_CONTAINERS)
        seen = {}
        for k, v in attrs:
            seen.setdefault(k, v if v is not None else "")
        self.e.start(tag, None, list(seen.items()))
        if tag in HTML_VOID:
            self.e.end()

    def handle_endtag(self, tag):
        if tag not in HTML_VOID:
            self._pop_to(tag)

    def handle_data(self, data):
        self.e.pending.append(data)


def _parse(path: str, content, dialect: str) -> _Events:
    events = _Events(path, *((TEI_SKIP, TEI_REGIONS) if dialect == "tei" else (HTML_SKIP, HTML_REGIONS)))
    try:
        if dialect == "tei":
            parser = ET.XMLParser(target=_TeiTarget(events))
            parser.feed(content)
            parser.close()
        else:
            html = _HtmlTarget(events)
            html.feed(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"))
            html.close()
            events.flush()
            while events.tags:
                events.end()
    except Exception as exc:  # a broken file is reported, never fails the job
        events = _Events(path, set(), {})
        events.cells += (path, 0, "error", None, None, 0, None, None, "", "", None, "front", (), f"{type(exc).__name__}: {exc}", "")
        events.n = 1
    return events


def _int(text: str) -> int | None:
    """As ``try_int``."""
    text = text.strip(_BLANK)
    value = int(text) if len(text) < 4000 and _INTEGER.fullmatch(text) else None
    return value if value is not None and -(1 << 31) <= value < 1 << 31 else None


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    def array(values, field):
        if not pa.types.is_map(field.type):
            return pa.array(values, type=field.type)
        flat = list(chain.from_iterable(values))
        ends = np.cumsum([0, *map(len, values)]) // 2
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[::2], pa.string()), pa.array(flat[1::2], pa.string()))

    return pa.RecordBatch.from_arrays([array(c, f) for c, f in zip(columns, schema)], schema=schema)


def flat_events(
    df: DataFrame, content_col: str = "content", dialect: str = "tei", path_col: str = "doc_path", flush_rows: int = 20_000,
    initial: int | None = None,
) -> DataFrame:
    """As :func:`flatten_markup`, with the ids and tags of the ancestors as texts; this form is the one to write."""
    schema = _ARROW if initial is None else _PLACED

    def run(batches):
        cells: list = []
        backs: list[bool | None] = []
        volumes: list[int] = []

        def cut(lo, hi):
            part = cells[lo * WIDTH : hi * WIDTH]
            return _batch([*(part[k::WIDTH] for k in range(WIDTH)), backs[lo:hi], volumes[lo:hi]], schema)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                events = _parse(path, content if content is not None else "", dialect)
                cells += events.cells
                backs += [events.has_back] * events.n
                volumes += events.volumes(initial or 0)
                whole = len(backs) // flush_rows * flush_rows
                for at in range(0, whole, flush_rows):
                    yield cut(at, at + flush_rows)
                if whole:
                    cells, backs, volumes = cells[whole * WIDTH :], backs[whole:], volumes[whole:]
        if backs:
            yield cut(0, len(backs))

    return df.select(F.col(path_col).cast("string"), F.col(content_col)).mapInArrow(run, ELEMENTS_DDL if initial is None else f"{ELEMENTS_DDL}, {POSITIONS_DDL}")


def unfolded(events: DataFrame) -> DataFrame:
    """With ids and tags of the ancestors as arrays (``ancestors``, ``ancestor_tags``) too."""

    def items(name: str, between: str) -> Column:
        return F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, between))

    return events.withColumns({"ancestors": items("id_path", " ").cast("array<bigint>"), "ancestor_tags": items("tag_path", "/")})


def flatten_markup(df: DataFrame, *args, **options) -> DataFrame:
    """Event table of every document; ``dialect`` is ``tei`` (strict) or ``html`` (tolerant).

    With ``initial`` it has the columns of ``extract.positioned``, which the task that parses a document knows already.
    Arguments are those of :func:`flat_events`.
    """
    return unfolded(flat_events(df, *args, **options))


def parse_errors(elements: DataFrame) -> DataFrame:
    return elements.filter(F.col("kind") == "error").select("doc_path", F.col("text").alias("error"))


def fill_glyphs(elements: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """Put the resolved character into the text events of glyph references."""
    is_g = (F.col("kind") == "text") & (F.col("tag") == "g")
    ref = F.when(is_g, F.regexp_replace(F.coalesce(F.col("attrs")["ref"], F.lit("")), "^#+", ""))
    if glyphs is None:
        fallback = F.concat(F.lit("["), ref, F.lit("]"))
        return elements.withColumn("text", F.when(is_g, fallback).otherwise(F.col("text")))
    out = resolve_glyph(elements.withColumn("_ref", ref), "_ref", glyphs, "_g")
    return out.withColumn("text", F.when(is_g, F.col("_g")).otherwise(F.col("text"))).drop("_ref", "_g")


def attr(name: str, default: str | None = "") -> Column:
    """Attribute value; a missing attribute is the empty string unless ``default`` is None."""
    v = F.col("attrs")[name]
    return v if default is None else F.coalesce(v, F.lit(default))


def starts(elements: DataFrame, *tags: str) -> DataFrame:
    cond = F.col("kind") == "start"
    return elements.filter(cond & F.col("tag").isin(*tags) if tags else cond)


def ordered_text(text: str = "text", seq: str = "seq", delimiter: str = "") -> Column:
    """Pieces joined in document order (empty string when there is none)."""
    d = delimiter.replace("'", "''")
    return F.coalesce(F.expr(f"listagg({text}, '{d}') WITHIN GROUP (ORDER BY {seq})"), F.lit(""))


def own_nodes(tags) -> Column:
    """Ids of the ancestors with one of the tags whose running text this event belongs to."""
    pairs = F.arrays_zip(F.col("ancestors").alias("id"), F.col("ancestor_tags").alias("tag"))
    skip = F.col("nearest_skip")
    mine = F.filter(pairs, lambda p: p["tag"].isin(*tags) & (skip.isNull() | (skip <= p["id"])))
    return F.transform(mine, lambda p: p["id"])


def node_texts(elements: DataFrame, *tags: str, keep=()) -> DataFrame:
    """One row per element with one of the tags: its text, attributes and the ``keep`` columns of its start.

    Start and text events meet in a single aggregation keyed by (document, node).
    """
    keep = ["tag", "attrs", "parent_id", "region", "seq", "ancestors", "ancestor_tags", *keep]
    is_start = (F.col("kind") == "start") & F.col("tag").isin(*tags)
    # Cheap test first: only text below one of the tags goes through the ancestor search.
    path = F.concat(F.lit("/"), "tag_path", F.lit("/"))
    is_text = (F.col("kind") == "text") & reduce(or_, [F.contains(path, F.lit(f"/{t}/")) for t in tags])
    own = F.when(is_start, F.array("node_id")).otherwise(own_nodes(tags))
    rows = elements.filter(F.col("kind").isin("start", "text")).filter(is_start | is_text).select(
        "doc_path",
        F.explode(own).alias("node_id"),
        F.when(is_start, F.struct(*keep)).alias("_start"),
        F.col("seq").alias("_at"),
        F.when(F.col("kind") == "text", F.col("text")).alias("_text"),
    )
    return (
        rows.groupBy("doc_path", "node_id")
        .agg(
            F.first("_start", ignorenulls=True).alias("_start"),
            ordered_text("_text", "_at").alias("text"),
        )
        .select("doc_path", "node_id", *[F.col(f"_start.{c}").alias(c) for c in keep], "text")
    )


def child_of(parent_tag: str) -> Column:
    """The event's direct parent has this tag."""
    return F.try_element_at("ancestor_tags", F.lit(-1)) == parent_tag


def under(tag: str) -> Column:
    return F.array_contains("ancestor_tags", tag)


def attr_of(col: Column | str, name: str) -> Column:
    return text_or_empty(as_col(col)[name])
