"""Corpus build: files to catalogue, content, notes, apparatus and table-of-contents tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_script
from ..operators import extract as X
from ..operators.firstwins import keep_first, keep_last
from ..session import materialize, settings
from ..sources.markup import fill_glyphs, flat_events, ordered_text, parse_errors, unfolded


FILES_PER_BATCH = "500"  # files that a task holds at a time


def parse_corpus(files: DataFrame, glyphs: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Event table of the files with glyphs filled in and positions added, written once by kind for all extractors.

    ``files`` has doc_path and content. A file is parsed by one task, which also tells the positions, so nothing is shuffled.
    With ``tasks`` the files are dealt to so many tasks by their paths, and the table is kept so: whoever groups its events
    by document does not shuffle them.
    """
    if tasks is not None:
        files = files.repartition(tasks, "doc_path")
    events = fill_glyphs(flat_events(files, initial=1), glyphs)
    with settings(files.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=FILES_PER_BATCH):
        return unfolded(materialize(events, "elements", by="kind", buckets=tasks and (tasks, "doc_path")))


def build_tables(
    pos: DataFrame, to_sc=(), categories: DataFrame | None = None, file_juan: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All corpus tables keyed by work.

    The first file of a work names it in the catalogue; the last file of a (work, volume) gives its
    content. With ``file_juan`` (doc_path, juan) each file is one volume, as in one-file-per-volume
    corpora. ``sizes`` has the characters of each row of ``content``, told without forming its text.
    """
    meta = X.extract_metadata(pos)
    catalog = keep_first(meta, ["sutra_id"], ["doc_path"]).withColumn("title_sc", to_script("title", list(to_sc)))
    if categories is not None:
        catalog = catalog.join(categories.select("canon", F.col("title_zh").alias("category")), "canon", "left")
    ids = X.doc_works(pos).select("doc_path", "sutra_id", "canon")

    if file_juan is not None:
        pos = pos.drop("juan").join(file_juan.select("doc_path", "juan"), "doc_path")
        pieces = X.body_text(pos)
    else:
        pieces = X.volume_pieces(pos)
    text = pieces.groupBy("doc_path", "juan").agg(ordered_text().alias("plain_text"))
    content = keep_last(text.join(ids, "doc_path"), ["sutra_id", "juan"], ["doc_path"])
    sizes = pieces.groupBy("doc_path", "juan").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    sizes = keep_last(sizes.join(ids, "doc_path"), ["sutra_id", "juan"], ["doc_path"])
    content = content.withColumn("plain_text_sc", to_script("plain_text", list(to_sc)))

    def keyed(df: DataFrame) -> DataFrame:
        return df.join(ids, "doc_path")

    return {
        "catalog": catalog.drop("xml_id"),
        "content": content,
        "sizes": sizes,
        "notes": keyed(X.extract_notes(pos)),
        "apparatus": keyed(X.extract_apparatus(pos)),
        "toc": keyed(X.extract_toc(pos)),
        "errors": parse_errors(pos).withColumn("canon", F.lit("")),
    }
