from helpers import rows
from pyspark.sql import functions as F
from test_sources_sinks import LOG, put

from scriptoria.operators.search import build_trigram_index
from scriptoria.streaming.dedupe import first_seen
from scriptoria.streaming.index import apply_batch, compact_batches, compact_index, compacted_upto, maintain_index, read_index
from scriptoria.streaming.notes import note_log, notes_per_day, read_note_stream
from scriptoria.plans import registry

registry.load_all()
QUERIES = registry.QUERIES

DDL = "doc_id int, text string, op string, change_no int"


def run(spark, path, index, ckpt):
    stream = spark.readStream.schema(DDL).json(path)
    maintain_index(stream, index, ckpt).awaitTermination()


def test_index_follows_changes(spark, tmp_path):
    src, index, ckpt = (str(tmp_path / x) for x in ("src", "index", "ckpt"))
    spark.createDataFrame([(1, "abcd", "upsert", 1), (2, "bcde", "upsert", 2), (1, "xyz", "upsert", 3)], DDL).coalesce(1).write.json(src)
    run(spark, src, index, ckpt)
    spark.createDataFrame([(2, None, "delete", 4), (3, "zzzz", "upsert", 5)], DDL).coalesce(1).write.mode("append").json(src)
    run(spark, src, index, ckpt)
    want, _ = build_trigram_index(spark.createDataFrame([(1, "xyz"), (3, "zzzz")], "doc_id int, text string"), "doc_id", "text")
    assert rows(read_index(spark, index), "term", "doc_id", "tf") == rows(want, "term", "doc_id", "tf")
    compact_index(spark, index, str(tmp_path / "new"))
    assert rows(read_index(spark, str(tmp_path / "new")), "term", "doc_id") == rows(want, "term", "doc_id")


def test_changes_of_one_number_leave_versions_and_postings_alike(spark, tmp_path):
    changes = [(i, t, op, 1) for i in range(40) for t, op in ((None, "delete"), (f"text {i}", "upsert"), ("a", "delete"))]
    for k in range(2):
        index = str(tmp_path / f"index{k}")
        apply_batch(spark.createDataFrame(changes[::-1] if k else changes, DDL).repartition(5), 0, index)
        assert {r.doc_id for r in read_index(spark, index).collect()} == set(range(40))


def test_first_seen(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int").write.json(src)
    for time_col in (None, "ts"):
        s = spark.readStream.schema("k string, n int").json(src).withColumn("ts", F.timestamp_seconds("n"))
        name = f"seen_{time_col}"
        first_seen(s, ["k"], time_col).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.table(name), "k") == [("a",), ("b",)]


def test_note_stream(spark, tmp_path):
    put(tmp_path / "log" / "2024-01-02.md", LOG)
    put(tmp_path / "log" / "2024-03-02.md", LOG)
    n = notes_per_day(note_log(read_note_stream(spark, str(tmp_path / "log"))))
    q = n.writeStream.format("memory").outputMode("complete").queryName("notes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("notes").select(F.to_date("day").cast("string"), "sutra_id", "n")) == [
        ("2024-01-02", "T0001", 1), ("2024-01-02", "T0235", 1), ("2024-03-02", "T0001", 1), ("2024-03-02", "T0235", 1),
    ]


def test_compaction_while_changes_go_on(spark, tmp_path):
    index = str(tmp_path / "index")
    batch = lambda *r: spark.createDataFrame(list(r), DDL)
    first, second = batch((1, "abcd", "upsert", 1), (2, "bcde", "upsert", 2)), batch((2, None, "delete", 3), (3, "wxyz", "upsert", 4), (1, "abxx", "upsert", 5), (1, "final", "upsert", 6))
    apply_batch(first, 0, index)
    apply_batch(second, 1, index)
    assert compacted_upto(spark, index) is None
    before = rows(read_index(spark, index), "term", "doc_id", "tf")
    compact_batches(spark, index, 1)
    assert compacted_upto(spark, index) == 1 and rows(read_index(spark, index), "term", "doc_id", "tf") == before
    apply_batch(batch((2, "again", "upsert", 7), (3, None, "delete", 8)), 2, index)
    apply_batch(first, 0, index)  # replays of folded batches change nothing
    apply_batch(batch((9, "never", "upsert", 1)), 3, str(tmp_path / "other"))
    want, _ = build_trigram_index(spark.createDataFrame([(1, "final"), (2, "again")], "doc_id int, text string"), "doc_id", "text")
    assert rows(read_index(spark, index), "term", "doc_id", "tf") == rows(want, "term", "doc_id", "tf")
    compact_batches(spark, index, 2)
    assert compacted_upto(spark, index) == 2 and rows(read_index(spark, index), "term", "doc_id", "tf") == rows(want, "term", "doc_id", "tf")
    compact_batches(spark, index, 1)  # already covered
    assert compacted_upto(spark, index) == 2


def test_table_streams_of_one_file_and_of_a_folder(spark, sf, tmp_path):
    one = rows(QUERIES["stream_note_log"](spark, sf), "sutra_id", "day", "juan", "n", "longest")
    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert one and rows(QUERIES["stream_note_log"](spark, str(tmp_path)), "sutra_id", "day", "juan", "n", "longest") == one


def test_logs_of_a_day_share_a_folder(spark, sf, monkeypatch, tmp_path):
    from scriptoria.plans import queries_streams as Q

    monkeypatch.setattr(Q, "scratch_path", lambda spark, label: str(tmp_path / label))
    got = QUERIES["stream_notes_per_day"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").distinct().count()
    folders = {f.parent.relative_to(tmp_path / "log").as_posix() for f in (tmp_path / "log").rglob("*.txt")}
    assert folders and all(f.startswith("day=") and "/" not in f for f in folders)
