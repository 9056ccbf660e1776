from helpers import rows
from pyspark.sql import functions as F

from scriptoria.functions import compat as C
from scriptoria.functions import predicates as P
from scriptoria.functions import text as T


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_white_space_is_unicode(spark):
    assert one(spark, C.strip(F.lit("　a b ")), T.squeeze_ws(F.lit("a　\n b")), T.drop_ws(F.lit(" a　b "))) == (
        "a b", "a b", "ab",
    )


def test_ids_and_titles(spark):
    assert one(spark, T.work_id(F.lit("T0220c 大般若波羅蜜多經")), T.work_title(F.lit("T0220c 大般若波羅蜜多經"))) == (
        "T0220c", "大般若波羅蜜多經",
    )
    assert one(spark, T.base_work(F.lit("T0220c")), T.base_work(F.lit("T0220")), T.canon_of(F.lit("JA042"))) == ("T0220", None, "JA")
    df = spark.createDataFrame([("T0220c", 1), ("T0001", 3)], "sutra_id string, juan int")
    assert rows(T.global_volume(df), "base_id", "global_volume") == [("T0001", 3), ("T0220", 401)]
    assert one(spark, T.volume_from_path(F.lit("a/T08n0251_001.xml")), T.volume_from_path(F.lit("T08n0251.xml"))) == (1, 1)
    assert one(spark, T.core_name(F.lit("佛說大乘經")), T.strip_parens(F.lit("甲(乙)（丙）丁"))) == ("大乘", "甲丁")


def test_glyph_fallback(spark):
    g = spark.createDataFrame(
        [("A", "", "x", None, None), ("B", "", None, None, "[口*爾]")],
        "cb_id string, uni_char string, norm_uni_char string, norm_big5_char string, composition string",
    )
    df = spark.createDataFrame([("#A",), ("B",), ("CB9",)], "id string")
    assert rows(T.resolve_glyph(df, "id", g), "glyph") == [("[CB9]",), ("[口*爾]",), ("x",)]


def test_script_conversion(spark):
    chars = [("經", "经"), ("說", "说")]
    phrases = [("後漢", "后汉"), ("後", "后"), ("經", "经")]
    assert one(spark, T.to_script(F.lit("說經"), chars), T.to_script(F.lit("後漢後經"), phrases), T.repair_conversion(F.lit("爲師雲"))) == (
        "说经", "后汉后经", "為師云",
    )


def test_compare_normalisation(spark):
    page = "<html><div id='body'>T08n0251_p0848a01<p>觀，自 在&amp;No. 251 [Nos. 250, 252]</p><div id='back'>x</div>"
    assert one(spark, T.normalize_for_compare(T.page_body(F.lit(page)))) == ("觀自在&",)
    assert one(spark, T.escape_keep_mark(F.lit("<b>&<mark>x</mark>"))) == ("&lt;b&gt;&amp;<mark>x</mark>",)


def test_lines_numbers_labels(spark):
    assert one(spark, T.unify_delimiter(F.lit("a|b  c")), T.split_lines(F.lit("a ｜ |b"))) == ("a ｜ b c", ["a", "b"])
    nums = [T.to_cn_numeral(F.lit(n)) for n in (1, 10, 12, 20, 99, 100)]
    assert one(spark, *nums) == ("一", "十", "十二", "二十", "九十九", "100")
    assert one(spark, T.year_label(F.lit(-221), F.lit(206)), T.lifespan_label(F.lit(None).cast("int"), F.lit(-5))) == (
        "前221–206", "?–前5",
    )
    day = F.to_date(F.lit("2024-12-31"))
    assert one(spark, T.rotation_index(day, F.lit(365)), T.safe_name(F.lit('a/b:"c')), T.page_ref(F.lit("GA01.0001.0002a"))) == (
        0, "a_b__c", "GAv01p0002",
    )


def test_tiles(spark):
    x, y = T.tile_xy(F.lit(35.0), F.lit(105.0), F.lit(5))
    assert one(spark, x, y) == (25, 12)
    box = spark.createDataFrame([(-80.0, -180.0, 80.0, 179.9, 1)], "min_lat double, min_lon double, max_lat double, max_lon double, zoom int")
    assert rows(T.tile_list(box)) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]


def test_predicates(spark):
    df = spark.createDataFrame([("100%",), ("1000",), ("AbC",)], "t string")
    assert rows(df.filter(P.match_text("t", F.lit("100%")))) == [("100%",)]
    assert rows(df.filter(P.match_text("t", F.lit("aBc"), "exact"))) == [("AbC",)]
    ids = spark.createDataFrame([("T1510",), ("T0001",), ("X1510",)], "i string")
    assert rows(ids.filter(P.id_between("i", [(1505, 1535)]))) == [("T1510",)]


def test_dictionary_filters(spark):
    raw = spark.createDataFrame(
        [("icon.png", "x"), ("甲", ""), ("乙", "<b>x</b>"), (" 丙 ", " y ")], "term string, definition string"
    )
    assert rows(P.drop_junk_terms(raw)) == [("丙", "y"), ("乙", "x")]
    see = spark.createDataFrame(
        [("<SEEALSO>甲</SEEALSO><SEEALSO>乙</SEEALSO>",), ("a<SEEALSO>b</SEEALSO>",), ("c",)], "definition string"
    )
    assert rows(P.extract_see_also(see)) == [("a", ["b"]), ("c", []), ("参见：甲；乙", ["甲", "乙"])]
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, parent int")
    assert rows(P.leaf_entries(tree), "id") == [(2,), (3,)]
    assert one(spark, P.alt_terms(F.array(F.lit("a"), F.lit("b"))), P.alt_terms(F.array(F.lit("a")))) == (["b"], None)


def test_only_named_references_are_decoded(spark):
    html = "<h1>a&amp;b&amp</h1>&lt;&eacute;&#39;&copy &copy;"
    df = spark.createDataFrame([(html,)], "html string")
    got = df.select(T.strip_markup(T.only_references("html", ["amp", "lt", "copy"])), T.strip_markup("html")).first()
    assert tuple(got) == ("a&b&amp<&eacute;&#39;&copy ©", "a&b&<é'© ©")
