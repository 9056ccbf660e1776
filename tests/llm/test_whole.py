"""Places where an operator once did less than the whole job."""

from types import SimpleNamespace

import numpy as np

import corpus_pipeline
from scriptoria.llm import common, mixing, simhash, suffix_dedup


def test_keep_one_keeps_other_texts_of_an_id(spark):
    rows = [(1, "one text about rivers and boats in the early spring", "a"), (1, "quite another story of mountains snow goats and winter huts", "b"), (2, "one text about rivers and boats in the early spring", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ord string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == rows[:2]


def test_toxic_labels_go_whatever_their_quality(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in known.where("toxic = 1").collect()}
    both = {r.doc_id for r in known.where("toxic = 1 and quality = 0").collect()}
    assert both and both <= {r.doc_id for r in mixing.domains(known).where("domain = 'toxic'").collect()}
    kept = {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, folder).select("doc_id").collect()}
    assert kept and not kept & toxic


def test_windows_around_a_shared_passage_are_spread():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    some = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage = some(160)
    texts = [some(120) + passage + some(120) for _ in range(300)]
    every = SimpleNamespace(value=np.full(1 << suffix_dedup.TABLE_BITS - 3, 255, np.uint8))
    own = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        anchors = suffix_dedup.Names(data, np.array([0, len(data)]), 100).anchors()[0]
        own.append((anchors[(anchors >= 120) & (anchors < 230)] * 2 + 1).astype(np.int64).tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array(own, pa.binary())], ["ord", "text", "own"])
    sent = list(suffix_dedup._round3(100, every, 211)(iter([batch])))
    sizes = [len(x) // 8 for b in sent for x in b.column("name").to_pylist()]
    got = common.gather(iter(sent), name=np.uint64, full=np.uint64, doc=np.int64, pos=np.int32)
    assert sum(sizes) > 5000 and max(sizes) < sum(sizes) / 40  # no bucket holds all windows of one anchor
    assert len(set(zip(got["name"].tolist(), got["full"].tolist()))) == sum(sizes)  # equal windows of the task are one
