"""Text-to-commentary relations: title classifiers, matching, chains, citations and the merged map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import alternation, as_col, contains_any, strip
from ..functions.predicates import id_between
from ..functions.text import core_name, drop_title_prefix, strip_parens, strip_volume_suffix
from ..session import materialize
from .firstwins import bounded_groups, keep_first
from .joins import contained_pairs

# Fixed values of the first classifier: ids that are always originals, words of entries to ignore,
# and commentary suffixes (longest genres first, single characters last).
FORCED_ORIGINALS = ["T0226", "T0840", "T0841", "CC0006"]
IGNORED_WORDS = (
    "禮懺 懺法 寶懺 儀軌 行法 念誦 消災 獻供 懺願 日誦 三昧行法 科儀 分門圖 會譯 異本 授記經 鈔經"
).split()
COMMENTARY_SUFFIXES = (
    "玄義釋籤 玄義文句 疏義演 疏鈔玄談 述文贊 掌中樞要 了義燈 筆削記 裂網疏 通玄鈔 發源機要 三德指歸 妙宗鈔 "
    "聞持記 圓中鈔 便蒙鈔 開宗義記 開宗義決 隨聽疏決 隨聽疏 領要鈔 顯幽鈔 探玄記 "
    "義疏 玄義 文句 述記 論疏 釋論 音義 集解 要解 釋籤 玄贊 玄論 遊意 游意 宗要 義記 略纂 纂要 科文 科註 科注 "
    "疏鈔 疏注 疏科 疏記 演義 科拾 句解 通義 會義 精解 綸貫 會解 統論 正眼 觀心釋 略談 音釋 淺解 部旨 演古 直說 "
    "心印疏 訂義 闡說 心鏡 近釋 析義 句釋 類解 集註 集注 直解 纂註 纂注 捷要 續疏 會釋 釋記 補註 補注 宗通 偈釋 "
    "決疑 采微 銷釋 入疏 合論 合註 合注 發隱 問辯 讀教記 格言 別抄 義蘊 學記 俗詮 證義 搜玄 綱目 略策 述贊 寶窟 "
    "照解 順正記 新記 攝釋 決擇記 衷論 融心解 正觀記 圖頌 同異集 開決記 廣釋 略述 開蒙 大意 論義 擊節 卓解 知音 "
    "正訛 正解 石注 郢說 指掌 指疏 筆記 通說 纂釋 淺說 略說 旨贊 挾註 順硃 初津 料簡 約意 要集 補遺 贅言 規矩 解義 "
    "釋義 釋疑 簡註 評林 懸談 懸示 評註 評注 概論 提綱 釋要 小談 直談 要論 添足 貫義 際決 開度 斲輪解 請益說 經鎞 "
    "淺註 淺注 略註 略注 彙纂 如是經義 如是解 易解 口訣 破空論 為為章 膚說 條箇 會本 私志 游刃 無我疏 扶新論 約論 "
    "指南 通贊 玄疏 略疏 注解 註解 注釋 論記 私記 "
    "疏 鈔 抄 記 解 註 注 講 述 贊 讚 科 釋"
).split()
ORIGINAL_SUFFIXES = "經 律 論 戒本 羯磨 法門經".split()

# Fixed values of the second classifier: words that decide in any folder, compounds, words that count
# only in a commentary folder, words that exclude, folder hints, and the id ranges.
BASE_WORDS = "疏 鈔 註 注 箋 抄 科".split()
COMPOUND_WORDS = (
    "義疏 略疏 新疏 通疏 正脈疏 直解 集解 要解 合解 會解 類解 略解 淺解 正解 易解 論解 句解 節解 "
    "直說 郢說 膚說 闡說 請益說 述記 義記 翼記 經記 法記 私記 宗圓記 復古記 玄義 會義 義章 通義 如是經義 分齊章 "
    "科判 科文 科釋 科註 科節 箋要 箋註 集註 集釋 纂註 講義 講記 講錄 講述 釋論 論釋 幽贊 玄贊 述贊 通贊 旨贊 "
    "還源述 義述 音義 音釋 懸談 指南 指歸 綱要 綱目 宗通 宗要 會本 提綱 要旨 文句 玄鏡 懸鏡 節要 釋要 纂要 備覽 要覽 "
    "大意 綸貫 直指 秘錄 撮要 會元 口訣 演義 貫義 部旨 旨槩 大略 示珠指 正眼 發隱 彙纂 決疑 採微 添足 指掌 開度 際決 "
    "知音 擊節 大窾 授手 演古 訂義 備撿 玄籤 隨釋 備釋 傳弘決 搜要 發微錄 顯性錄 披雲集 吞海集 義解 釋義 關法 毘婆沙 事義"
).split()
LOOSE_WORDS = "解 釋 論 說 述 贊 記 談".split()
EXCLUDED_WORDS = "語錄 全集 詩集 年譜 行狀 碑文 塔銘 造像記 懺法 懺儀 禮懺 禮讚".split()
FOLDER_HINTS = "疏 論 註 注 釋 解 科 記 贊 鈔".split()
COMMENTARY_ID_RANGES = [(1505, 1535), (1693, 1821), (2732, 2865)]
ORIGINAL_ID_RANGES = [(0, 1420)]

# One pair that looks like text and commentary but is not (title end, commentary title).
FALSE_PAIR = ("攝大乘論釋", "攝大乘論釋論")


def classify_title(title: Column | str, work: Column | str) -> Column:
    """``original``, ``commentary`` or ``ignore``."""
    t = as_col(title)
    bare = strip_volume_suffix(strip_parens(t))
    longer = [w for w in COMMENTARY_SUFFIXES if len(w) >= 2]
    return (
        F.when(as_col(work).isin(FORCED_ORIGINALS), "original")
        .when(contains_any(t, IGNORED_WORDS), "ignore")
        .when(F.endswith(bare, F.lit("頌")), "original")
        .when(bare.rlike(f"(?:{alternation(COMMENTARY_SUFFIXES)})$"), "commentary")
        .when(bare.rlike(f"(?:{alternation(ORIGINAL_SUFFIXES)})$"), "original")
        .when(contains_any(bare, longer), "commentary")
        .otherwise("original")
    )


def folder_is_commentary(title: Column | str) -> Column:
    return contains_any(title, FOLDER_HINTS)


def is_commentary(title: Column | str, work: Column | str, folder: Column | bool = False) -> Column:
    """Whether a work in a folder is a commentary; ``folder`` says if the folder is of that kind."""
    t, w = F.coalesce(as_col(title), F.lit("")), as_col(work)
    folder = F.lit(folder) if isinstance(folder, bool) else folder
    ends_as_text = F.endswith(strip(strip_parens(t)), F.lit("經"))
    listed = id_between(w, COMMENTARY_ID_RANGES)
    original = id_between(w, ORIGINAL_ID_RANGES) | ends_as_text
    return (
        F.when((t == "") | contains_any(t, EXCLUDED_WORDS), False)
        .when(contains_any(t, BASE_WORDS), True)
        .when(ends_as_text, listed)
        .when(contains_any(t, COMPOUND_WORDS) | listed, True)
        .otherwise(folder & ~original & contains_any(t, LOOSE_WORDS))
    )


# -- matching --------------------------------------------------------------------------------------


def split_group_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Originals and commentaries of ``(group_id, sutra_id, title)`` rows, by the first classifier."""
    m = members.withColumn("_class", classify_title("title", "sutra_id"))
    return m.filter("_class = 'original'").drop("_class"), m.filter("_class = 'commentary'").drop("_class")


def match_titles(originals: DataFrame, commentaries: DataFrame) -> DataFrame:
    """Best-scoring original titles for every commentary title of a group.

    Works on distinct titles: ``(group_id, o_title, c_title, score, n_originals, n_commentaries)``, where
    the counts say how many works share a title. Score is the best of: whole title inside the
    commentary title (10 per character), core name inside it (10), the commentary's core name inside
    the title (8), longest 3 to 12 character prefix of the title inside it (1). Each rule is an
    equi-join of whole strings with substrings, so only pairs that score are ever formed. A group with
    one original accepts all its commentaries (score 0 where nothing matches).
    """
    group = originals.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    o = originals.groupBy("group_id", F.col("title").alias("o_title")).agg(F.count(F.lit(1)).alias("n_originals"))
    c = commentaries.groupBy("group_id", F.col("title").alias("c_title")).agg(F.count(F.lit(1)).alias("n_commentaries"))
    # Distinct titles are written once; six branches below read them.
    o = materialize(o.join(group, "group_id").withColumn("o_core", core_name("o_title")), "originals")
    c = materialize(c.join(group, "group_id").withColumn("c_core", core_name("c_title")), "commentaries")
    lone = c.filter("_n = 1").join(o.drop("_n"), "group_id").withColumn("score", F.lit(0))
    ot = o.filter("_n > 1").select("group_id", "o_title", "o_core")
    ct = c.filter("_n > 1").select("group_id", "c_title", "c_core")
    pair = ["group_id", "o_title", "c_title"]

    stem = F.replace(F.replace(F.col("o_title"), F.lit("佛說"), F.lit("")), F.lit("佛说"), F.lit(""))
    prefixes = ot.select(
        "group_id", "o_title",
        F.explode(F.when(
            F.length(stem) >= 3,
            F.transform(F.sequence(F.lit(3), F.least(F.length(stem), F.lit(12))), lambda n: F.left(stem, n)),
        )).alias("needle"),
    ).withColumn("w", F.lit(1))
    whole = ot.select("group_id", "o_title", F.col("o_title").alias("needle"), F.lit(10).alias("w"))
    core = ot.filter(F.length("o_core") >= 2).select(
        "group_id", "o_title", F.col("o_core").alias("needle"), F.lit(10).alias("w")
    )
    forward = contained_pairs(
        whole.unionByName(core).unionByName(prefixes), ct.select("group_id", "c_title"), "needle", "c_title", ["group_id"]
    ).select(*pair, (F.length("needle") * F.col("w")).alias("score"))
    backward = contained_pairs(
        ct.filter(F.length("c_core") >= 2), ot.select("group_id", "o_title"), "c_core", "o_title", ["group_id"], 2
    ).select(*pair, (F.length("c_core") * 8).alias("score"))
    scored = forward.unionByName(backward).groupBy(*pair).agg(F.max("score").alias("score"))
    top = scored.groupBy("group_id", "c_title").agg(F.max("score").alias("score"))
    best = scored.join(top, ["group_id", "c_title", "score"])
    best = best.join(o, ["group_id", "o_title"]).join(c, ["group_id", "c_title"])
    cols = [*pair, "score", "n_originals", "n_commentaries"]
    return best.select(cols).unionByName(lone.select(cols))


def match_commentaries(originals: DataFrame, commentaries: DataFrame) -> DataFrame:
    """Relation of work ids from :func:`match_titles`."""
    o = originals.select("group_id", F.col("sutra_id").alias("sutra_id"), F.col("title").alias("o_title"))
    c = commentaries.select("group_id", F.col("sutra_id").alias("commentary_id"), F.col("title").alias("c_title"))
    return (
        match_titles(originals, commentaries)
        .join(o, ["group_id", "o_title"])
        .join(c, ["group_id", "c_title"])
        .select(
            "group_id", "sutra_id", F.col("o_title").alias("sutra_title"), "commentary_id",
            F.col("c_title").alias("commentary_title"), "score",
        )
    )


def chain_titles(commentaries: DataFrame) -> DataFrame:
    """Commentary titles A whose full (else prefix-less) title lies inside a longer title B of the group."""
    t = commentaries.select("group_id", "title").distinct()
    needle = t.select("group_id", F.col("title").alias("a_title"), F.col("title").alias("needle"))
    bare = drop_title_prefix("title")
    stripped = t.filter((bare != F.col("title")) & (bare != "")).select(
        "group_id", F.col("title").alias("a_title"), bare.alias("needle")
    )
    hits = contained_pairs(
        needle.unionByName(stripped), t.select("group_id", F.col("title").alias("b_title")), "needle", "b_title", ["group_id"]
    )
    return (
        hits.filter((F.length("b_title") > F.length("needle")) & (F.col("a_title") != F.col("b_title")))
        .select("group_id", "a_title", "b_title")
        .distinct()
    )


def commentary_chains(commentaries: DataFrame) -> DataFrame:
    """Commentary-on-commentary relation of work ids."""
    a = commentaries.select("group_id", "sutra_id", F.col("title").alias("a_title"))
    b = commentaries.select("group_id", F.col("sutra_id").alias("commentary_id"), F.col("title").alias("b_title"))
    return (
        chain_titles(commentaries)
        .join(a, ["group_id", "a_title"])
        .join(b, ["group_id", "b_title"])
        .filter(F.col("sutra_id") != F.col("commentary_id"))
        .select(
            "group_id", "sutra_id", F.col("a_title").alias("sutra_title"), "commentary_id",
            F.col("b_title").alias("commentary_title"),
        )
    )


def drop_false_pairs(pairs: DataFrame) -> DataFrame:
    """Remove pairs with equal titles and the known false pair."""
    end, other = FALSE_PAIR
    false_pair = F.endswith("sutra_title", F.lit(end)) & (F.col("commentary_title") == other)
    return pairs.filter((F.col("sutra_title") != F.col("commentary_title")) & ~false_pair)


def dedupe_pairs(pairs: DataFrame, order=("rule", "group_id")) -> DataFrame:
    """One row per (text, commentary); the first rule wins."""
    return keep_first(pairs, ["sutra_id", "commentary_id"], list(order))


def extract_relations(members: DataFrame) -> DataFrame:
    """Relation pairs of grouped works: matches first, then chains; groups need both kinds of works."""
    originals, commentaries = split_group_members(members)
    commentaries = commentaries.join(originals.select("group_id").distinct(), "group_id", "left_semi")
    direct = match_commentaries(originals, commentaries).drop("score").withColumn("rule", F.lit(1))
    chained = commentary_chains(commentaries).withColumn("rule", F.lit(2))
    return dedupe_pairs(drop_false_pairs(direct.unionByName(chained)))


# -- citations and the merged map ------------------------------------------------------------------


def citation_pairs(citations: DataFrame, titles: DataFrame) -> DataFrame:
    """Citations ``(source_id, target_id)`` whose target title is part of the citing title."""
    t = titles.filter(F.coalesce(F.col("title"), F.lit("")) != "").select("sutra_id", "title")
    src = t.select(F.col("sutra_id").alias("source_id"), F.col("title").alias("commentary_title"))
    dst = t.select(F.col("sutra_id").alias("target_id"), F.col("title").alias("sutra_title"))
    c = citations.select("source_id", "target_id").distinct().filter(F.col("source_id") != F.col("target_id"))
    j = c.join(src, "source_id").join(dst, "target_id")
    clean = F.replace(F.replace(F.col("sutra_title"), F.lit("佛說"), F.lit("")), F.lit("(第"), F.lit(""))
    clean = F.substring_index(clean, "(", 1)

    def inside(x: Column) -> Column:
        return (F.length(x) >= 2) & F.contains(F.col("commentary_title"), x)

    return j.filter(inside(clean) | inside(F.col("sutra_title"))).select(
        F.col("target_id").alias("sutra_id"), "sutra_title", F.col("source_id").alias("commentary_id"), "commentary_title"
    )


def new_pairs(cf: DataFrame, known: DataFrame) -> DataFrame:
    return cf.join(known.select("sutra_id", "commentary_id").distinct(), ["sutra_id", "commentary_id"], "left_anti")


def merge_relations(outline: DataFrame, cited: DataFrame) -> DataFrame:
    """Union of both relation sources as pairs with ``match_type``; the outline wins."""
    cols = ["sutra_id", "sutra_title", "commentary_id", "commentary_title"]
    a = outline.select(*cols).dropDuplicates(["sutra_id", "commentary_id"])
    b = new_pairs(cited.select(*cols).dropDuplicates(["sutra_id", "commentary_id"]), a)
    return a.withColumn("match_type", F.lit("bulei_catalog")).unionByName(
        b.withColumn("match_type", F.lit("xml_cf_tag"))
    )


def nest_pairs(pairs: DataFrame, limit: int = 1000) -> DataFrame:
    """One row per text with its sorted array of commentaries (very long lists continue in further parts)."""
    titles = pairs.groupBy("sutra_id").agg(F.min_by("sutra_title", "match_type").alias("title"))
    item = F.struct(
        F.col("commentary_id").alias("id"), F.col("commentary_title").alias("title"), F.col("match_type").alias("match_type")
    )
    nested = bounded_groups(pairs, ["sutra_id"], item, "commentary_id", "commentaries", limit)
    return nested.join(titles, "sutra_id").select("sutra_id", "title", "part", "commentaries")


def fanout(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """Number of commentaries by how many texts they belong to; ``anomaly`` marks more than ``limit``."""
    per = pairs.groupBy("commentary_id").agg(F.count(F.lit(1)).alias("n_texts"))
    return (
        per.groupBy("n_texts")
        .agg(F.count(F.lit(1)).alias("n_commentaries"))
        .withColumn("anomaly", F.col("n_texts") > limit)
    )


