"""Text normalisation and scalar functions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import broadcast_if_small
from .compat import WS, WS_CHARS, as_col, first_group, null_if_empty, strip

# Repairs of over-eager conversion to traditional script, applied in this order.
CONVERSION_REPAIRS = [
    ("爲", "為"),
    ("唸佛", "念佛"),
    ("唸彌", "念彌"),
    ("唸清", "念清"),
    ("師雲", "師云"),
    ("鹹無", "咸無"),
    ("慾了", "欲了"),
    ("嗜慾", "嗜欲"),
    ("無慾更", "無欲更"),
]

# Punctuation removed before two editions are compared.
COMPARE_PUNCTUATION = (
    "，。、；：！？「」『』（）〔〕【】…—─　．·,.:;!?\"'()[]{}|/\\＊＝〈〉《》－"
)

# Title prefixes and suffixes that do not belong to the core name.
TITLE_PREFIXES = ["佛說", "大乘", "聖佛母", "佛母", "大方廣佛", "大方廣", "御注", "新譯", "佛垂", "御註"]
TITLE_SUFFIXES = ["波羅蜜多經", "波羅蜜經", "波羅蜜多", "波羅蜜", "經", "律", "論", "本願", "功德", "大明呪"]

# Sub-works of the one text that is split over lettered ids: (id, first-volume offset, volumes).
SUBWORK_VOLUMES = [
    ("T0220a", 0, 200),
    ("T0220b", 200, 200),
    ("T0220c", 400, 137),
    ("T0220d", 537, 28),
    ("T0220e", 565, 8),
    ("T0220f", 573, 2),
    ("T0220g", 575, 1),
    ("T0220h", 576, 1),
    ("T0220i", 577, 1),
    ("T0220j", 578, 5),
    ("T0220k", 583, 5),
    ("T0220l", 588, 1),
    ("T0220m", 589, 1),
    ("T0220n", 590, 2),
    ("T0220o", 592, 8),
]

CN_DIGITS = "一二三四五六七八九"

# -- script conversion ---------------------------------------------------------------------------


def script_pairs(mapping: DataFrame, direction: str) -> list[tuple[str, str]]:
    """Pairs of a ``script_map(src, dst, direction)`` table, longest source first.

    The table is a dictionary of the script (one row per character or phrase), not data: its size does not follow the corpus.
    """
    rows = mapping.filter(F.col("direction") == direction).select("src", "dst").distinct().collect()
    return sorted(((r.src, r.dst) for r in rows), key=lambda p: (-len(p[0]), p[0]))


def to_script(col: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Convert script. Single characters use ``translate``; phrase tables use one longest-match pass."""
    c = as_col(col)
    if not pairs:
        return c
    if all(len(s) == 1 and len(d) == 1 for s, d in pairs):
        return F.translate(c, "".join(s for s, _ in pairs), "".join(d for _, d in pairs))
    table = dict(pairs)
    pattern = re.compile("|".join(re.escape(s) for s, _ in pairs))

    @F.pandas_udf(StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pattern.sub(lambda m: table[m.group(0)], t))

    return convert(c)


def repair_conversion(col: Column | str, fixes=CONVERSION_REPAIRS) -> Column:
    c = as_col(col)
    for old, new in fixes:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# -- missing glyphs ------------------------------------------------------------------------------


def glyph_text(glyphs: DataFrame) -> DataFrame:
    """``(cb_id, glyph)``: the first non-empty of the character columns, then the composition."""
    order = ["uni_char", "norm_uni_char", "norm_big5_char", "composition"]
    return glyphs.select("cb_id", F.coalesce(*[null_if_empty(c) for c in order]).alias("glyph"))


def resolve_glyph(df: DataFrame, id_col: str, glyphs: DataFrame, out: str = "glyph") -> DataFrame:
    """Left-join the glyph table on an id such as ``#CB1``; unknown ids become ``[id]``."""
    g = broadcast_if_small(glyph_text(glyphs).dropDuplicates(["cb_id"])).withColumnRenamed("glyph", "_glyph")
    key = F.regexp_replace(F.col(id_col), "^#+", "")
    return (
        df.withColumn("_gid", key)
        .join(g, F.col("_gid") == g["cb_id"], "left")
        .withColumn(out, F.coalesce("_glyph", F.concat(F.lit("["), F.col("_gid"), F.lit("]"))))
        .drop("_gid", "_glyph", "cb_id")
    )


# -- whitespace, markup, punctuation ---------------------------------------------------------------


def squeeze_ws(col: Column | str) -> Column:
    """Trim and turn each run of white space into one blank."""
    return F.regexp_replace(F.translate(strip(col), WS_CHARS, " " * len(WS_CHARS)), "  +", " ")


def drop_ws(col: Column | str) -> Column:
    return F.translate(as_col(col), WS_CHARS, "")


def drop_line_breaks(col: Column | str) -> Column:
    return F.translate(as_col(col), "\n\r", "")


@F.pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def only_references(col: Column | str, names) -> Column:
    """Markup in which only the named references, closed by a semicolon, are left to decode; other ampersands are text.

    Decoders of HTML also take references without a semicolon (``&amp<``) and the whole table of names.
    """
    return F.regexp_replace(as_col(col), f"&(?!(?:{'|'.join(names)});)", "&amp;")


def strip_tags(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), "<[^>]+>", "")


def strip_markup(col: Column | str) -> Column:
    """Remove tags, then decode entities, in Arrow batches over all rows (a condition does not keep rows out of Python)."""
    bare = strip_tags(col)
    return F.when(F.contains(bare, F.lit("&")), unescape_entities(bare)).otherwise(bare)


def drop_reference_ids(col: Column | str) -> Column:
    """Remove catalogue numbers, page ids and line ids."""
    c = as_col(col)
    for pattern in (
        rf"\[cf\.[{WS}]*No\.[{WS}]*[^\]]+\]",
        rf"No\.[{WS}]*\d+[{WS}]*\[Nos?\.[{WS}]*[^\]]+\]",
        rf"No\.[{WS}]*\d+",
        r"[A-Z]+\d+n\d+_p\d*[a-c]?\d*",
        r"\d{4}[a-c]\d{2}",
    ):
        c = F.regexp_replace(c, pattern, "")
    return c


def drop_punctuation(col: Column | str, chars: str = COMPARE_PUNCTUATION) -> Column:
    return F.translate(as_col(col), chars, "")


def normalize_for_compare(col: Column | str) -> Column:
    """Bare characters of an edition: no tags, entities, ids, punctuation or white space."""
    return drop_ws(drop_punctuation(drop_reference_ids(strip_markup(col))))


def page_body(col: Column | str) -> Column:
    """Text between the body division and the back matter of a web page, without note anchors."""
    c = as_col(col)
    c = F.regexp_replace(c, r"(?s)^.*?<div id=['\"]body['\"][^>]*>", "")
    c = F.regexp_replace(c, r"(?s)<div id=(?:'back'|\"back\"|['\"][a-z]+-copyright['\"]).*$", "")
    return F.regexp_replace(c, r"(?s)<a class=['\"]noteAnchor['\"][^>]*>.*?</a>", "")


def escape_html(col: Column | str) -> Column:
    c = as_col(col)
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def escape_keep_mark(col: Column | str) -> Column:
    """Escape markup but keep the highlight marks."""
    c = escape_html(col)
    for esc, raw in (("&lt;mark&gt;", "<mark>"), ("&lt;/mark&gt;", "</mark>")):
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def unify_delimiter(col: Column | str) -> Column:
    c = F.regexp_replace(as_col(col), rf"[{WS}]*\|[{WS}]*", " ｜ ")
    return strip(F.regexp_replace(c, "  +", " "))


def split_lines(col: Column | str) -> Column:
    """Split a verse on either bar into trimmed, non-empty lines."""
    parts = F.transform(F.split(as_col(col), r"[｜|]"), strip)
    return F.filter(parts, lambda x: x != "")


# -- identifiers and titles ------------------------------------------------------------------------


def work_id(col: Column | str, narrow: bool = False) -> Column:
    """Leading id of a label; ``narrow`` allows no letters between the canon prefix and the digits."""
    body = r"[A-Z]+\d+[a-zA-Z]*" if narrow else r"[A-Z]+[a-zA-Z]*\d+[a-zA-Z]*"
    return first_group(strip(col) if narrow else col, rf"(?U)^({body})\b")


def work_title(col: Column | str) -> Column:
    """Label text after the id, or the whole label."""
    pattern = rf"^[A-Z]+[a-zA-Z]*\d+[a-zA-Z]*[{WS}]+(.+)"
    return strip(F.coalesce(first_group(col, pattern), as_col(col)))


def canon_of(col: Column | str) -> Column:
    return F.regexp_extract(as_col(col), "^([A-Z]+)", 1)


def base_work(col: Column | str) -> Column:
    """Id without one trailing lower-case letter after a digit; null when there is none."""
    return first_group(col, r"^(.*\d)[a-z]$")


def volume_from_path(col: Column | str) -> Column:
    return F.coalesce(first_group(col, r"_(\d+)\.xml$").cast("int"), F.lit(1))


def global_volume(df: DataFrame, id_col: str = "sutra_id", local_col: str = "juan") -> DataFrame:
    """Add ``base_id`` and ``global_volume``: sub-works are shifted by the offset of their part."""
    rows = [F.struct(F.lit(i).alias("id"), F.lit(o).alias("off")) for i, o, _ in SUBWORK_VOLUMES]
    hit = F.try_element_at(F.filter(F.array(*rows), lambda r: r["id"] == F.col(id_col)), F.lit(1))
    off = F.when(F.col(id_col).rlike("^T0220[a-o]$"), hit["off"])
    return df.withColumn("base_id", F.when(off.isNotNull(), base_work(id_col)).otherwise(F.col(id_col))).withColumn(
        "global_volume", F.col(local_col) + F.coalesce(off, F.lit(0))
    )


def core_name(col: Column | str) -> Column:
    """Title without one known prefix and one known suffix."""
    c = F.regexp_replace(as_col(col), f"^(?:{'|'.join(TITLE_PREFIXES)})", "")
    return strip(F.regexp_replace(c, f"(?:{'|'.join(TITLE_SUFFIXES)})$", ""))


def drop_title_prefix(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), f"^(?:{'|'.join(TITLE_PREFIXES)})", "")


def strip_parens(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), r"[（(].*?[）)]", "")


def strip_volume_suffix(col: Column | str) -> Column:
    return strip(F.regexp_replace(as_col(col), r"卷[上中下一二三四五六七八九十百\d]+$", ""))


def safe_name(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), r'[\\/:*?"<>|]', "_")


def page_ref(col: Column | str) -> Column:
    """Viewer reference of a page id such as ``T01.0001.0001a`` (column ``a`` only), e.g. ``Tv01p0001``."""
    m = r"^([A-Z]+)([^.]*)\.[^.]*\.(?:[^.]*\.)*([^.]*)a$"
    c = as_col(col)
    return F.when(
        c.rlike(m),
        F.concat(
            F.regexp_extract(c, m, 1), F.lit("v"), F.regexp_extract(c, m, 2), F.lit("p"), F.regexp_extract(c, m, 3)
        ),
    )


def note_object(col: Column | str) -> Column:
    """Object text of a variant note: what precedes the base-edition mark."""
    return first_group(col, "^(.+?)【大】")


# -- numbers, dates, places ------------------------------------------------------------------------


def to_cn_numeral(col: Column | str) -> Column:
    """1..99 in Chinese numerals, other numbers as digits."""
    n = as_col(col).cast("int")
    digits = F.array(F.lit(""), *[F.lit(d) for d in CN_DIGITS])
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    head = F.when(tens == 0, F.lit("")).when(tens == 1, F.lit("十")).otherwise(F.concat(F.get(digits, tens), F.lit("十")))
    return F.when((n >= 1) & (n <= 99), F.concat(head, F.get(digits, ones))).otherwise(n.cast("string"))


def rotation_index(date: Column | str, n: Column | str) -> Column:
    return F.pmod(F.dayofyear(as_col(date)) - 1, as_col(n))


def _year_text(y: Column) -> Column:
    return F.when(y < 0, F.concat(F.lit("前"), F.abs(y).cast("string"))).otherwise(y.cast("string"))


def year_label(start: Column | str, end: Column | str) -> Column:
    s, e = as_col(start), as_col(end)
    return F.when(s >= 9999, F.lit("")).otherwise(F.concat(_year_text(s), F.lit("–"), _year_text(e)))


def lifespan_label(birth: Column | str, death: Column | str) -> Column:
    """Life dates; a missing (or zero) end is shown as a question mark, no dates as the empty string."""
    b, d = F.nullif(as_col(birth), F.lit(0)), F.nullif(as_col(death), F.lit(0))
    q = F.lit("?")
    return F.when(b.isNull() & d.isNull(), F.lit("")).otherwise(
        F.concat(F.coalesce(_year_text(b), q), F.lit("–"), F.coalesce(_year_text(d), q))
    )


def tile_xy(lat: Column | str, lon: Column | str, zoom: Column | str) -> tuple[Column, Column]:
    """Web-mercator tile column and row, clamped to the grid."""
    lat, lon, zoom = as_col(lat), as_col(lon), as_col(zoom)
    n = F.pow(F.lit(2.0), zoom)
    r = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n)
    last = n.cast("bigint") - 1

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(v.cast("bigint"), last))

    return clamp(x), clamp(y)


def tile_list(boxes: DataFrame) -> DataFrame:
    """``(min_lat, min_lon, max_lat, max_lon, zoom)`` rows to one row per covered tile."""
    x0, y0 = tile_xy("max_lat", "min_lon", "zoom")
    x1, y1 = tile_xy("min_lat", "max_lon", "zoom")
    return (
        boxes.select("zoom", y0.alias("y0"), y1.alias("y1"), F.explode(F.sequence(x0, x1)).alias("x"))
        .select("zoom", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
        .distinct()
    )
