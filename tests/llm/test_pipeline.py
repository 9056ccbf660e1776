"""The stages of the pipeline on the small tables."""

import corpus_pipeline
from scriptoria.llm import decontaminate, fertility, mixing
from test_near_copies import brute, joined


def test_stages(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.domain for r in mixing.domains(spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        after = corpus_pipeline.materialize(after, "test")
        ids, was = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was and after.count() == len(ids)
        if name == "quality_rules":
            assert ids == {r.doc_id for r in fertility.judge(docs.select("doc_id", "lang", "text")).where("kept").collect()}
        elif name == "near_dedup":
            rows = sorted((r.doc_id, r.text or "") for r in before.collect())
            first, texts = {}, [t for _, t in rows]
            same = [(first.setdefault(t, k), k) for k, t in enumerate(texts)]
            root = joined([*brute(texts), *same], len(rows))
            assert ids == {rows[k][0] for k in range(len(rows)) if root[k] == k}
        elif name == "decontamination":
            dirty = {r.doc_id for r in decontaminate.matches(before, items).collect()}
            assert dirty and ids == was - dirty
        elif name == "mix_sources":
            gone = [labels.get(i) for i in was - ids]
            assert all(labels.get(i) != "toxic" for i in ids)
            assert gone.count("clean") <= 0.02 * sum(labels.get(i) == "clean" for i in was)
        else:
            assert ids == was
        before = after


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(corpus_pipeline.SHARDS)]
    assert rows and max(sizes) - min(sizes) <= 1
    assert len({r.doc_id for r in rows}) == len(rows)


def test_stages_on_odd_rows(spark, odd, none, sf):
    named = odd.withColumnsRenamed({"shard": "_k", "rate": "k"})
    for name, stage in corpus_pipeline.STAGES[:3]:
        for docs in (named, named.drop("lang"), none):
            after = stage(spark, docs, sf)
            rows = after.collect()
            given = [tuple(r) for r in docs.collect()]
            assert after.columns == docs.columns and all(tuple(r) in given for r in rows), name
