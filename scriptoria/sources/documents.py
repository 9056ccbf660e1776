"""Verse tables, note logs, Markdown documents and outlines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import WS, as_col, first_group, rstrip, strip, text_or_empty
from ..session import materialize


def read_verse_csv(spark: SparkSession, path: str) -> DataFrame:
    """Verse and source columns; short rows get an empty source."""
    raw = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    verse = raw.columns[0]
    source = F.col(f"`{raw.columns[1]}`") if len(raw.columns) > 1 else F.lit(None).cast("string")
    return raw.select(
        strip(text_or_empty(F.col(f"`{verse}`"))).alias("verse"), strip(text_or_empty(source)).alias("source")
    ).filter(F.col("verse") != "")


CLOCK = chr(0x1F552)
MEMO = chr(0x1F4DD)


def parse_notes_log(df: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """Note entries of an append-only log: time, title line, quoted lines and remark."""
    entries = df.select(F.col(path_col).alias("log_path"), F.posexplode(F.split(text_col, "---\n")).alias("pos", "_b"))
    lines = F.split(strip("_b"), "\n")
    head = F.get(F.filter(lines, lambda s: F.startswith(s, F.lit(f"### {CLOCK}"))), F.lit(0))
    head = F.replace(text_or_empty(head), F.lit(f"### {CLOCK} "), F.lit(""))
    quotes = F.filter(lines, lambda s: F.startswith(s, F.lit("> ")))
    quotes = F.transform(quotes, lambda s: strip(F.substring(s, F.lit(3), F.length(s))))
    label = f"{MEMO} **感悟**："
    memo = F.element_at(
        F.concat(F.array(F.lit("")), F.filter(lines, lambda s: F.startswith(s, F.lit(f"{MEMO} ")))), F.lit(-1)
    )
    content = F.when(F.startswith(memo, F.lit(label)), strip(F.replace(memo, F.lit(label), F.lit("")))).otherwise(
        strip(F.substring(memo, F.lit(3), F.length(memo)))
    )
    cut = F.instr(head, " | ")
    return entries.select(
        "log_path",
        "pos",
        strip(F.when(cut > 0, F.left(head, cut - 1)).otherwise(head)).alias("time"),
        strip(F.when(cut > 0, F.substring(head, cut + 3, F.length(head))).otherwise(F.lit(""))).alias("sutra_title"),
        F.array_join(quotes, "\n").alias("quote"),
        content.alias("content"),
    ).filter((F.col("content") != "") | (F.col("quote") != ""))


def read_markdown(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Documents with front matter: adds ``title``, ``author`` and the ``meta`` map (null without one)."""
    block = first_group(text_col, r"(?s)\A---(.*?)---")
    unquote = lambda v: F.regexp_replace(strip(v), r"^(['\"])(.*)\1$", "$2")
    pairs = F.filter(F.split(block, "\n"), lambda s: s.rlike(r"^[^:#\s][^:]*:"))
    meta = F.map_from_entries(
        F.transform(
            pairs,
            lambda s: F.struct(
                strip(F.substring_index(s, ":", 1)).alias("key"),
                unquote(F.regexp_replace(s, "^[^:]*:", "")).alias("value"),
            ),
        )
    )
    return (
        df.withColumn("meta", meta)
        .withColumn("title", F.col("meta")["title"])
        .withColumn("author", text_or_empty(F.col("meta")["author"]))
    )


def indent_of(line: Column | str, tab: int = 4) -> Column:
    """Indentation width with tabs expanded."""
    c = F.replace(as_col(line), F.lit("\t"), F.lit(" " * tab))
    return F.length(c) - F.length(F.regexp_replace(c, f"^[{WS}]+", ""))


RANGE = 10_000  # lines of a file that one task reads in order


def _outline_range(marker: str):
    """Stack of one range of lines: items with their heading, and what is open at its end.

    A heading that must be looked for before the range is named by the least indentation so far (``need``): it is the last
    one open at the start of the range that is indented less.
    """
    item, bold = re.compile(r"`([A-Za-z0-9]+)`\s+(.+)"), re.compile(r"^\s*-\s+\*\*(.+?)\*\*\s*$")

    def run(table: pa.Table) -> pa.Table:
        lines = sorted(zip(table["line_no"].to_pylist(), table["line"].to_pylist()))
        out: dict[str, list] = {f.name: [] for f in OUTLINE}
        stack: list[tuple[int, tuple]] = []  # (indentation, (heading's line, its title, need))
        least = None

        def give(kind: str, no: int, indent: int, group: tuple, sutra_id=None, title=None) -> None:
            for name, value in zip(out, (table["doc_path"][0].as_py(), table["range"][0].as_py(), kind, no, indent, *group, sutra_id, title)):
                out[name].append(value)

        for no, line in lines:
            wide = line.replace("\t", "    ")
            indent = len(wide) - len(wide.lstrip())
            least = indent if least is None else min(least, indent)
            while stack and stack[-1][0] >= indent:
                stack.pop()
            above = stack[-1][1] if stack else (None, None, least)
            if marker in line:
                stack.append((indent, (no, line.strip(), None)))
            elif bold.match(line):
                stack.append((indent, above))
            elif found := item.search(line.strip()):
                give("item", no, indent, above, found.group(1), found.group(2).strip())
        for indent, group in stack:
            give("open", -1, indent, group)
        give("least", -1, least, (None, None, None))
        return pa.table(out, schema=OUTLINE)

    return run


OUTLINE = pa.schema([
    ("doc_path", pa.string()), ("range", pa.int64()), ("kind", pa.string()), ("line_no", pa.int64()), ("indent", pa.int64()),
    ("group_no", pa.int64()), ("group_title", pa.string()), ("need", pa.int64()), ("sutra_id", pa.string()), ("title", pa.string()),
])
OPENED = pa.schema([("doc_path", pa.string()), ("range", pa.int64()), ("indent", pa.int64()), ("group_no", pa.int64()), ("group_title", pa.string())])


def _open_before(table: pa.Table) -> pa.Table:
    """Headings open at the start of each range of one file, from what each range leaves open."""
    ranges: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        ranges.setdefault(r["range"], []).append(r)
    stack: list[tuple[int, int, str]] = []
    out = []
    for k in sorted(ranges):
        out += [(table["doc_path"][0].as_py(), k, *s) for s in stack]
        least = next(r["indent"] for r in ranges[k] if r["kind"] == "least")
        below = [s for s in stack if s[0] < least]
        for r in sorted((r for r in ranges[k] if r["kind"] == "open"), key=lambda r: r["indent"]):
            if r["group_no"] is not None:
                below.append((r["indent"], r["group_no"], r["group_title"]))
            elif outer := [s for s in stack if s[0] < r["need"]]:
                below.append((r["indent"], *outer[-1][1:]))
        stack = below
    return pa.Table.from_pylist([dict(zip(OPENED.names, r)) for r in out], schema=OPENED)


def read_outline(df: DataFrame, doc_col: str = "doc_path", text_col: str = "value", marker: str = chr(0x1F4D6), lines: int = RANGE) -> DataFrame:
    """Items of an indented outline with the group heading that encloses them.

    The parent of a line is the nearest earlier line with smaller indentation among headings (lines with the marker) and
    bold sub-headings; a bold line passes on its parent's group. Items without a heading are left out. A file is cut into
    ranges of ``lines`` lines, each read with a stack by a task of its own; what the ranges of a file leave open is merged
    in order (at most one row for each indentation and range) and joined to the items whose heading stands before their range.
    """
    rows = df.select(F.col(doc_col).alias("doc_path"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    rows = rows.filter(strip("line") != "").select("doc_path", F.floor(F.col("no") / lines).alias("range"), F.col("no").cast("long").alias("line_no"), "line")
    ddl = "doc_path string, range long, kind string, line_no long, indent long, group_no long, group_title string, need long, sutra_id string, title string"
    read = materialize(rows.groupBy("doc_path", "range").applyInArrow(_outline_range(marker), ddl), "outline")
    ends = read.filter("kind <> 'item'").groupBy("doc_path").applyInArrow(_open_before, "doc_path string, range long, indent long, group_no long, group_title string")
    opened = ends.groupBy("doc_path", "range").agg(F.array_sort(F.collect_list(F.struct("indent", "group_no", "group_title"))).alias("before"))
    items = read.filter("kind = 'item'").join(opened, ["doc_path", "range"], "left")
    outer = F.element_at(F.filter("before", lambda b: b["indent"] < F.col("need")), -1)
    pick = lambda c: F.coalesce(F.col(c), F.when(F.size(F.filter("before", lambda b: b["indent"] < F.col("need"))) > 0, outer[c]))
    found = items.select("doc_path", pick("group_no").alias("group_no"), pick("group_title").alias("group_title"), "line_no", "sutra_id", "title")
    return found.filter("group_no is not null")
