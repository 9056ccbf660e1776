"""Persons mentioned in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .firstwins import first_person_by_name, top_k
from .joins import contains_join

# Terms that look like names of three or more characters but are none.
NOT_NAMES = (
    "不可思議 無為法 阿那含 阿羅漢 優婆塞 優婆夷 菩提薩埵 善男子 善女人 善知識 轉輪聖王 忍辱仙 金剛般若 般若波羅 "
    "波羅蜜多 大乘正宗 如法受持 法會因由 究竟無我 離色離相 一體同觀 無得無說 能淨業障 一相無相 金剛般若波羅蜜經"
).split()


def person_mentions(
    content: DataFrame,
    persons: DataFrame,
    authority: DataFrame | None = None,
    volumes: int | None = None,
    min_chars: int = 3,
    stop=NOT_NAMES,
) -> DataFrame:
    """Counts of person names in the text of each work.

    ``content`` has (sutra_id, juan, plain_text). All volumes are read unless ``volumes`` asks for the
    first few. Persons the ``authority`` table (sutra_id, person_id) already links to the work are left
    out. A name stands for its first person; names inside longer names count as well.
    """
    c = content if volumes is None else content.filter(F.col("juan") <= volumes)
    pool = persons.filter((F.length("name") >= min_chars) & ~F.col("name").isin(list(stop)))
    found = contains_join(c, pool, ["sutra_id", "juan"], "plain_text", "name", min_chars)
    per_work = found.groupBy("sutra_id", "name").agg(F.sum("n").alias("n"))
    if authority is None:
        who = first_person_by_name(pool).select("name", "person_id")
        return per_work.join(who, "name").select("sutra_id", "person_id", "name", "n")
    # The first person of the name that the work does not know yet.
    known = authority.select("sutra_id", "person_id").distinct()
    pairs = per_work.join(pool.select("name", "person_id"), "name").join(known, ["sutra_id", "person_id"], "left_anti")
    return pairs.groupBy("sutra_id", "name").agg(F.min("person_id").alias("person_id"), F.first("n").alias("n")).select(
        "sutra_id", "person_id", "name", "n"
    )


def rank_mentions(mentions: DataFrame, k: int = 1000) -> DataFrame:
    """Mentions of each work by count, longer names first on ties."""
    return top_k(mentions, ["sutra_id"], [F.col("n").desc(), F.length("name").desc(), "name"], k, "rank")
