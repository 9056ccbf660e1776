"""Verse mining: blocks, sentences, scores, formatting, selection, sources, corrections, daily pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import WS, as_col, contains_any, count_words_present, first_group, let, strip
from ..functions.text import drop_ws, repair_conversion, rotation_index, to_script, unify_delimiter
from ..session import broadcast_if_small
from .firstwins import dedupe_prefix, fingerprint, first_seen_mode, select_top_distinct, top_k

# Fixed values of the block score: punctuation, doctrine words, narrative words.
SENTENCE_PUNCTUATION = "，。；！？、：「」『』（）[]\"''…—·"
DOCTRINE_WORDS = (
    "空 無我 涅槃 菩提 般若 法性 真如 佛性 無常 苦 業 輪迴 生死 解脫 禪 定 慧 慈悲 布施 持戒 忍辱 精進 正念 正見 "
    "煩惱 無明 覺悟 菩薩 如來 法身 實相 緣起 因果 戒 道 修行 觀 心"
).split()
NARRATIVE_WORDS = "爾時 世尊 如是 佛告 比丘 善男子 汝等 阿難 舍利弗 須菩提".split()

# Fixed values of the doctrinal score: source bonuses, concept weights, word lists, source patterns.
SOURCE_BONUS = {
    "法句經": 40, "法集要頌經": 40, "出曜經": 35, "法句譬喻經": 35,
    "四十二章經": 40, "佛遺教經": 40, "八大人覺經": 40, "佛說無常經": 35, "吉祥經": 35, "佛本行經": 30, "佛所行讚": 30,
    "金剛經": 30, "金剛般若": 30, "心經": 30, "般若心經": 30, "法華經": 30, "華嚴經": 25, "楞嚴經": 30, "楞伽經": 25,
    "圓覺經": 30, "維摩詰": 30, "維摩經": 30, "涅槃經": 25, "大般涅槃": 25, "地藏經": 25, "藥師經": 25, "無量壽經": 25,
    "阿彌陀經": 25, "大寶積經": 20, "雜阿含經": 20, "長阿含經": 20, "中阿含經": 20, "增一阿含": 20,
    "中論": 30, "大智度論": 30, "瑜伽師地論": 20, "成唯識論": 20, "起信論": 30, "寶性論": 25, "入菩薩行論": 30,
    "十住毘婆沙": 25, "大乘莊嚴經論": 25, "百法明門論": 25,
    "壇經": 40, "六祖壇經": 40, "信心銘": 40, "證道歌": 40, "永嘉證道歌": 40, "參同契": 35, "寶鏡三昧": 35, "碧巖錄": 30,
    "碧巖集": 30, "無門關": 30, "從容錄": 30, "傳燈錄": 25, "景德傳燈": 25, "五燈會元": 25, "五燈嚴統": 25, "禪林寶訓": 35,
    "叢林盛事": 25, "禪關策進": 35, "續傳燈錄": 20,
    "淨土十要": 25, "龍舒淨土文": 25, "觀經": 25, "觀無量壽": 25,
    "費閒歌": 35, "醒世歌": 35, "紫柏尊者全集": 25, "靈峯宗論": 30, "竹窗隨筆": 30, "夢遊集": 25, "傳心法要": 35,
    "臨濟錄": 35, "趙州錄": 30, "指月錄": 25, "大慧語錄": 25, "大慧書": 25, "成佛之道": 25,
    "摩訶止觀": 20, "法華玄義": 20, "天台小止觀": 25,
}
CONCEPT_WEIGHTS = {
    "空": 4, "般若": 5, "涅槃": 5, "菩提": 5, "法性": 5, "真如": 5, "實相": 5, "無我": 5, "緣起": 5, "中道": 5,
    "法身": 4, "佛性": 5, "如來藏": 5, "解脫": 4, "覺悟": 4, "無生": 5, "寂滅": 4, "無住": 4, "不二": 5, "自性": 4,
    "唯心": 4, "唯識": 4, "圓覺": 5, "法界": 4, "三昧": 3, "輪迴": 4, "生死": 3, "無常": 4, "苦": 3, "無明": 4,
    "煩惱": 3, "業": 3, "因果": 4, "三毒": 4, "慈悲": 4, "布施": 3, "持戒": 3, "忍辱": 3, "精進": 3, "禪定": 4,
    "智慧": 4, "六度": 4, "正念": 3, "正見": 3, "八正道": 4, "四諦": 4, "十二因緣": 4, "三法印": 5, "五蘊": 3,
    "心": 2, "道": 2, "戒": 2, "定": 2, "慧": 2, "菩薩": 2, "如來": 2, "佛": 1, "修行": 2, "觀": 2, "念": 2, "悟": 3, "迷": 3,
}
ADMONITION_WORDS = (
    "無常 生死 輪迴 苦海 火宅 迷 放逸 懈怠 精進 勤 莫 當 死 老 病 惜 慎 戒 惡 善 業 報 果 因 回頭 警 覺 醒 度 救 "
    "勿 須 急 速 難 罕"
).split()
STORY_WORDS = "爾時 佛告 善男子 善女人 須菩提 舍利弗 阿難".split()
IMAGERY_WORDS = "鐘 鶴 鷗 帆 潮 渡 寺 塔 殿 閣".split()
GAZETTEER_WORDS = "寺志 山志 塔 碑 銘 圖 志略".split()
RITUAL_WORDS = "念誦 儀軌 真言 陀羅尼 灌頂 曼荼 密教 護摩 壇法".split()
TRANSLATOR_WORDS = "譯 鳩摩羅什 玄奘 不空 義淨".split()
SCRIPTURE_WORDS = (
    "經》 律》 阿含 般若 法華 華嚴 涅槃 寶積 楞嚴 楞伽 圓覺 維摩 金剛 法句 地藏 藥師 觀音 彌陀 無量壽 中論 大智度論 瑜伽 唯識"
).split()
MASTER_WORDS = (
    "語錄 禪師 法師 和尚 大師 壇經 傳燈 五燈 碧巖 無門 信心銘 證道歌 禪林 叢林 寶訓 宗鏡"
).split()
EXISTING_PUNCTUATION = "，。、；：！？「」『』（）|·"
DEFAULT_VERSE = "法門無量誓願學"
DEFAULT_SOURCE = "四弘誓願"


# -- blocks and sentences --------------------------------------------------------------------------


def verse_blocks(text: Column | str, line_pattern: str = r"> [^\n]*") -> Column:
    """Runs of consecutive lines that match the pattern, each as one text.

    A run is a maximal match of whole lines, so the blocks of a document are found inside its row.
    """
    return F.regexp_extract_all(
        as_col(text), F.lit(rf"(?md)((?:^{line_pattern}(?:\n|\z))+)"), F.lit(1)
    )


def quote_block_text(block: Column | str) -> Column:
    """Block text without the quote marks and trailing white space of its lines."""
    lines = F.filter(F.split(as_col(block), "\n"), lambda s: s != "")
    return F.array_join(
        F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, "^> ", ""), f"[{WS}]+$", "")), "\n"
    )


def verse_sentences(text: Column | str) -> Column:
    """Sentences of a block: split at white space and stops, other punctuation removed, empty ones dropped."""
    parts = F.split(as_col(text), f"[，。；！？、{WS}]+")
    return F.filter(F.transform(parts, lambda s: F.translate(s, SENTENCE_PUNCTUATION, "")), lambda s: s != "")


def score_verse(
    sentences: Column | str, doctrine=DOCTRINE_WORDS, narrative=NARRATIVE_WORDS, count=(4, 12), length=(3, 7)
) -> Column:
    """Score of a sentence array, or null when it does not have the shape of a verse."""
    def points(s: Column, lens: Column, mode: Column) -> Column:
        n = F.size(s)
        near = F.size(F.filter(lens, lambda x: F.abs(x - mode) <= 1))
        perfect = F.size(F.filter(lens, lambda x: x == mode))
        regular = F.when(perfect == n, 40).when(perfect >= n * F.lit(0.8), 30).otherwise(20)
        metre = F.when(mode.isin(5, 7), 20).when(mode.isin(4, 6), 15).otherwise(10)
        size = F.when(n.between(4, 8), 20).when(n.between(9, 12), 10).otherwise(0)

        def words(full: Column) -> Column:
            depth = let(
                count_words_present(full, doctrine), lambda d: F.when(d >= 3, 20).when(d >= 2, 15).when(d >= 1, 10).otherwise(0)
            )
            return depth + F.when(count_words_present(full, narrative) >= 2, -15).otherwise(0)

        return F.when(near >= n * F.lit(0.8), regular + metre + size + let(F.array_join(s, ""), words))

    def shaped(s: Column) -> Column:
        def with_lens(lens: Column) -> Column:
            fits = F.forall(lens, lambda x: x.between(*length))
            return F.when(fits, let(first_seen_mode(lens), lambda mode: points(s, lens, mode)))

        return F.when(F.size(s).between(*count), let(F.transform(s, F.length), with_lens))

    return let(as_col(sentences), shaped)


def format_verse(sentences: Column | str) -> Column:
    """Couplets ``a，b。`` for an even number of sentences, otherwise one comma list with a full stop."""
    s = as_col(sentences)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: i % 2 == 1),
        lambda i: F.concat(F.get(s, i - 1), F.lit("，"), F.get(s, i)),
    )
    return F.concat(F.when(F.size(s) % 2 == 0, F.array_join(pairs, "。")).otherwise(F.array_join(s, "，")), F.lit("。"))


def source_label(title: Column | str, author: Column | str) -> Column:
    a = F.coalesce(as_col(author), F.lit(""))
    return F.concat(F.lit("《"), as_col(title), F.lit("》"), F.when(a != "", F.concat(F.lit("／"), a)).otherwise(""))


def existing_fingerprints(verses: DataFrame, col: str, sizes=(6,)) -> DataFrame:
    """Prefixes of known verses (cleaned of quotes and bars as well)."""
    clean = F.translate(drop_ws(col), EXISTING_PUNCTUATION, "")
    prefixes = F.filter(F.array(*[F.when(F.length(clean) >= n, F.left(clean, F.lit(n))) for n in sizes]), lambda x: x.isNotNull())
    return verses.select(F.explode(prefixes).alias("fp")).distinct()


def verse_candidates(
    docs: DataFrame, doc: str = "doc_id", text: str = "value", line_pattern: str = r"> [^\n]*", keep=("title", "author"), **bands
) -> DataFrame:
    """Scored sentence arrays of every block that has the shape of a verse and scores at least 50."""
    blocks = docs.select(doc, *keep, F.posexplode(verse_blocks(text, line_pattern)).alias("block_no", "_b"))
    rows = blocks.withColumn("sentences", verse_sentences(quote_block_text("_b"))).withColumn(
        "score", score_verse("sentences", **bands)
    )
    return rows.filter(F.col("score") >= 50).drop("_b")


def mine_verses(
    docs: DataFrame, existing: DataFrame | None = None, doc: str = "doc_id", text: str = "value",
    line_pattern: str = r"> [^\n]*", **bands,
) -> DataFrame:
    """Verses of a corpus with source and score; the first of each six-character fingerprint is kept."""
    rows = verse_candidates(docs, doc, text, line_pattern, **bands).withColumn("text", format_verse("sentences"))
    known = existing_fingerprints(existing, "verse") if existing is not None else None
    kept = dedupe_prefix(rows, "text", 6, [doc, "block_no"], known)
    return kept.select(doc, "block_no", "text", source_label("title", "author").alias("source"), "score")


# -- doctrinal selection ---------------------------------------------------------------------------


def classify_source(source: Column | str) -> Column:
    s = as_col(source)
    return (
        F.when(F.contains(s, F.lit("民國")), "modern")
        .when(F.contains(s, F.lit("日本")), "skip")
        .when(contains_any(s, TRANSLATOR_WORDS) | contains_any(s, SCRIPTURE_WORDS), "sutra")
        .when(contains_any(s, MASTER_WORDS), "master")
        .otherwise("other")
    )


def _by_weight(table: dict[str, int]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for word, weight in table.items():
        groups.setdefault(weight, []).append(word)
    return dict(sorted(groups.items(), reverse=True))


def source_bonus(source: Column | str, table=None) -> Column:
    """Largest bonus of a name inside the source text: one alternation per bonus, highest first."""
    groups = _by_weight(table or SOURCE_BONUS)
    return F.coalesce(*[F.when(contains_any(source, names), bonus) for bonus, names in groups.items()], F.lit(0))


def weighted_words(text: Column | str, table=None) -> Column:
    """Sum of the weights of the words that occur in the text."""
    parts = [count_words_present(text, words) * w for w, words in _by_weight(table or CONCEPT_WEIGHTS).items()]
    return sum(parts[1:], parts[0])


def score_doctrinal(text: Column | str, source: Column | str, tables: dict | None = None) -> Column:
    """Doctrinal score of a verse and its source; null when the text is excluded.

    ``tables`` may replace ``bonus``, ``concepts``, ``admonition``, ``story``, ``imagery``,
    ``gazetteer`` and ``ritual``.
    """
    cfg = tables or {}
    t, src = as_col(text), as_col(source)
    n = F.length(t)
    brief = F.when(n <= 30, 15).when(n <= 50, 20).when(n <= 70, 15).when(n <= 100, 10).otherwise(5)

    def regularity(lens: Column) -> Column:
        def graded(mode: Column) -> Column:
            ratio = F.size(F.filter(lens, lambda x: F.abs(x - mode) <= 1)) / F.size(lens)
            return let(
                ratio,
                lambda r: F.when((r >= 0.9) & mode.isin(5, 7), 20)
                .when((r >= 0.9) & mode.isin(4, 6), 18)
                .when(r >= 0.8, 14)
                .when(r >= 0.7, 8)
                .otherwise(3),
            )

        return F.when(F.size(lens) >= 2, let(first_seen_mode(lens), graded))

    def content(depth: Column) -> Column:
        image = count_words_present(t, cfg.get("imagery", IMAGERY_WORDS))
        return depth + F.when((depth < 10) & (image >= 3), -10).otherwise(0)

    sents = F.filter(F.transform(F.split(t, "[，。；！？]"), strip), lambda s: F.length(s) >= 2)
    regular = let(F.transform(sents, F.length), regularity)  # null with fewer than two sentences
    depth = let(F.least(weighted_words(t, cfg.get("concepts")), F.lit(35)), content)
    admonition = F.least(count_words_present(t, cfg.get("admonition", ADMONITION_WORDS)) * 2, F.lit(15))
    story = let(
        count_words_present(t, cfg.get("story", STORY_WORDS)), lambda k: F.when(k >= 2, -12).when(k >= 1, -4).otherwise(0)
    )
    penalty = (
        F.when(contains_any(src, cfg.get("gazetteer", GAZETTEER_WORDS)), -20).otherwise(0)
        + F.when(contains_any(src, cfg.get("ritual", RITUAL_WORDS)), -15).otherwise(0)
        + F.when(t.rlike(r"\[\d+\]"), -3).otherwise(0)
    )
    total = source_bonus(src, cfg.get("bonus")) + brief + regular + depth + admonition + story + penalty
    return F.when(n.between(10, 150), total)


def judge_verses(
    verses: DataFrame, existing: DataFrame | None = None, text: str = "text", source: str = "source", min_score: int = 35,
    tables: dict | None = None,
) -> DataFrame:
    """Add source class, score and ``reason``: modern, skip, dup, low or kept (tested in this order)."""
    rows = verses.withColumn("source_class", classify_source(source)).withColumn(
        "score", score_doctrinal(text, source, tables)
    )
    dup = F.lit(False)
    if existing is not None:
        fps = broadcast_if_small(existing_fingerprints(existing, "verse", (6, 10)).withColumn("_known", F.lit(True)))
        for n in (6, 10):
            rows = rows.withColumn("_fp", fingerprint(text, n))
            rows = rows.join(fps.withColumnRenamed("fp", "_fp"), "_fp", "left").withColumnRenamed("_known", f"_k{n}").drop("_fp")
        dup = F.coalesce("_k6", F.lit(False)) | F.coalesce("_k10", F.lit(False))
    reason = (
        F.when(F.col("source_class").isin("modern", "skip"), F.col("source_class"))
        .when(dup, "dup")
        .when(F.coalesce("score", F.lit(-1)) < min_score, "low")
        .otherwise("kept")
    )
    return rows.withColumn("reason", reason).drop("_k6", "_k10")


def select_verses(judged: DataFrame, pos, text: str = "text", k: int = 2000) -> DataFrame:
    """Best ``k`` kept verses, one per twelve-character fingerprint."""
    return select_top_distinct(judged.filter("reason = 'kept'"), text, "score", [pos] if isinstance(pos, str) else pos, 12, k)


def skip_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def source_distribution(df: DataFrame, source: str = "source", k: int = 20) -> DataFrame:
    """Most frequent book titles in the source texts."""
    book = first_group(source, "《([^》]+)》")
    return (
        df.select(book.alias("book")).filter(F.col("book").isNotNull()).groupBy("book").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "book").limit(k)
    )


# -- sources and corrections -----------------------------------------------------------------------


def normalize_source(df: DataFrame, aliases: DataFrame, col: str = "source", key: str = "id", to_tc=()) -> DataFrame:
    """Canonical source: parts between slashes looked up in ``aliases(alias, canonical)``; known books get title marks."""
    clean = F.translate(repair_conversion(to_script(col, list(to_tc))), "《》", "")
    parts = F.filter(F.transform(F.split(clean, "／"), strip), lambda s: s != "")
    exploded = df.select(key, F.posexplode(parts).alias("_i", "alias"))
    known = exploded.join(broadcast_if_small(aliases.select("alias", "canonical")), "alias", "left")
    shown = F.when(F.col("canonical").isNotNull(), F.concat(F.lit("《"), "canonical", F.lit("》"))).otherwise(F.col("alias"))
    joined = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", shown.alias("t")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["t"]), " ／ ")
    return df.join(joined.select(key, text.alias("_n")), key, "left").withColumn(
        f"{col}_norm", F.coalesce("_n", F.col(col))
    ).drop("_n")


def apply_corrections(df: DataFrame, fixes: DataFrame, key: str = "line_no", fields=("verse", "source")) -> tuple[DataFrame, DataFrame]:
    """Apply ``fixes(line_no, field, old, new, note)`` and return (corrected rows, change log).

    A verse fix needs its old text (blanks and bars aside); a source fix always applies.
    """
    out, logs = df, []
    for f in fields:
        mine = fixes.filter(F.col("field") == f).select(
            key, F.col("old").alias("_old"), F.col("new").alias("_new"), F.col("note").alias("_note")
        )
        out = out.join(broadcast_if_small(mine), key, "left")

        def loose(c: Column) -> Column:
            return F.replace(unify_delimiter(c), F.lit(" "), F.lit(""))

        guard = F.lit(True) if f == "source" else loose(F.col(f)) == loose(F.col("_old"))
        hit = F.col("_new").isNotNull() & guard
        logs.append(
            out.filter(hit).select(
                key, F.lit(f).alias("field"), "_note", F.col(f).alias("old"), F.col("_new").alias("new")
            ).withColumnRenamed("_note", "note")
        )
        out = out.withColumn(f, F.when(hit, F.col("_new")).otherwise(F.col(f))).drop("_old", "_new", "_note")
    log = logs[0]
    for extra in logs[1:]:
        log = log.unionByName(extra)
    return out, log


# -- daily pick ------------------------------------------------------------------------------------


def union_with_provenance(builtin: DataFrame, custom: DataFrame, out: str = "type") -> DataFrame:
    return builtin.withColumn(out, F.lit("builtin")).unionByName(custom.withColumn(out, F.lit("custom")), allowMissingColumns=True)


def daily_verse(verses: DataFrame, dates: DataFrame, pins: DataFrame | None = None, cols=("id", "type"), order=("type", "id")) -> DataFrame:
    """Verse of each date: the pinned one if it exists, else the list rotated by day of year.

    Only the first 366 positions can ever be picked, so a bounded top-k numbers the list. An empty list
    gives null columns (:data:`DEFAULT_VERSE` is shown then).
    """
    listed = top_k(verses.select(*cols), [], list(order), 366, "_rank")
    n = verses.agg(F.count(F.lit(1))).scalar()
    picked = dates.withColumn("_n", n).withColumn("_rank", rotation_index("date", F.greatest("_n", F.lit(1))) + 1)
    out = picked.join(F.broadcast(listed), "_rank", "left").select("date", *cols)  # at most 366 rows
    if pins is None:
        return out.withColumn("pinned", F.lit(False))
    pin = pins.join(verses.select(*cols), list(cols), "left_semi").limit(1)
    pin = pin.select(*[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(1).alias("_one"))
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(pin), "_one", "left")  # at most one row
    has = F.col(f"_p_{cols[0]}").isNotNull()
    return out.select(
        "date", *[F.when(has, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in cols], has.alias("pinned")
    )


