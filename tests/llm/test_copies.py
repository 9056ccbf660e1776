"""Near copies, repeated strings, shards and mixtures against brute force."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptoria.llm import mixing, ring, simhash, suffix_dedup


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(ids, fps, distance):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("direct", [simhash.DIRECT, 2])
def test_components(small, direct):
    rows = sorted((r.doc_id, fingerprint(r.text)) for r in small.collect())
    want = labels([i for i, _ in rows], [f for _, f in rows], 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(small, direct=direct).collect()}
    assert got == {i: (f, want[i]) for i, f in rows}


@pytest.mark.parametrize("direct", [64, 3])
def test_links_of_close_fingerprints(spark, direct):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4, 5, 6, 8) for _ in range(6)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, direct)).collect()
    roots = {r.node: r.root for r in found}
    want = labels(signed, fps, 4)
    assert {f: roots.get(f, f) for f in signed} == want


def test_keep_one(small, odd, none):
    kept = {r.doc_id for r in simhash.keep_one(small).collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(small).collect()}
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect())[None] == 2
    assert max(Counter(r.doc_id for r in got.where("doc_id is not null").collect()).values()) == 1
    assert simhash.keep_one(none).count() == 0


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.doc_id for r in got if r.fp == 0}
    assert zero == {1, 2, None}
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.near_duplicates(none).count() == 0


def removed(rows, length=100):
    """(doc key, text) in order: what stays of each text, and the removed runs."""
    seen, out = set(), []
    for key, text in rows:
        b = (text or "").encode()
        drop = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                drop[i : i + length] = True
            seen.add(w)
        runs = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
        out.append((key, len(b), int(drop.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~drop].tobytes()).hexdigest()))
    return out


def test_repeats(small):
    got = sorted(map(tuple, suffix_dedup.remove_repeats(small).collect()))
    assert got == removed(sorted((r.doc_id, r.text) for r in small.collect()))
    assert sum(r[2] for r in got) > 0


def test_repeats_within_and_across(spark):
    rng = np.random.default_rng(5)
    part = ["".join(chr(97 + x) for x in rng.integers(0, 4, 130)) for _ in range(6)]
    texts = [part[0] + part[1], part[1] + part[0], part[2] * 3, "a" * 350, "b" + "a" * 120, part[3][:99], part[3], "é" * 80 + part[4], part[4] + "é" * 80, part[5][10:] + part[0][5:], ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == removed(rows)
    cut = suffix_dedup.remove_repeats(docs, with_text=True).where("doc_id = 1").first()
    assert hashlib.sha256(cut.kept).hexdigest() == cut.kept_sha256


def test_repeats_edges(odd, none):
    rows = odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = removed([(r.doc_id, r.text) for r in order])
    got = [tuple(r) for r in suffix_dedup.remove_repeats(odd).collect()]
    assert Counter(got) == Counter(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_rounds_leave_no_shuffle_files(small, spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {x.split(",")[0] for x in local.getAllFiles().mkString(",").split(",") if "/shuffle_" in x}

    before = files()
    cut = suffix_dedup.remove_repeats(small)  # all rounds but the cut itself
    for _ in range(100):  # the files are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert cut.count() == small.count()


def test_repeats_of_windows_in_one_task_and_in_many(spark):
    rng = np.random.default_rng(6)
    part = ["".join(chr(97 + x) for x in rng.integers(0, 26, 160)) for _ in range(3)]
    ends = ["".join(chr(97 + x) for x in rng.integers(0, 26, 90)) for _ in range(40)]
    rows = [(k, e + part[k % 3] + ends[(7 * k + 1) % 40] + part[k % 2][:120]) for k, e in enumerate(ends)]
    want = removed(rows)
    for n in (1, 13):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want


def test_ring(small):
    got = ring.shard_rows(small, 7).collect()
    assert Counter(Counter(r.shard for r in got).values()) == Counter([small.count() // 7 + (s < small.count() % 7) for s in range(7)])
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.doc_id: r.size for r in got} == {r.doc_id: len(r.text.encode()) + 16 for r in small.collect()}


def test_ring_places_as_one_by_one(small, spark):
    """Rows in ring order, each to the first point clockwise whose shard has room, arcs in rounds."""
    from bisect import bisect_left

    points = ring.ring(5, 8)
    rows = small.select("doc_id", F.xxhash64("doc_id").alias("at")).collect()
    arcs = Counter(bisect_left([p for p, _ in points], r["at"]) % len(points) for r in rows)
    bounds = [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)]
    room, filled = list(bounds), Counter()
    waiting = {a: [a] * n for a, n in arcs.items()}
    while waiting:
        onward = {}
        for at in sorted(waiting):
            for arc in waiting[at]:
                s = points[at][1]
                if room[s]:
                    room[s] -= 1
                    filled[arc, s] += 1
                else:
                    onward.setdefault((at + 1) % len(points), []).append(arc)
        waiting = onward
    got = Counter((bisect_left([p for p, _ in points], r["at"]) % len(points), r.shard) for r in ring.shard_rows(small.select("doc_id", "text", F.xxhash64("doc_id").alias("at")), 5, 8).collect())
    assert got == filled


def test_ring_does_not_depend_on_partitions(small, spark):
    """Also where a third of all rows are equal, have one key, or have none."""
    hot = small.select("doc_id", "text").unionByName(spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    hot = hot.unionByName(spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text")))

    def placed(docs):
        return sorted(map(repr, ring.shard_rows(docs, 7).select("doc_id", "text_crc32", "shard", "slot").collect()))

    first = placed(hot.repartition(7))
    assert first == placed(hot.repartition(2)) == placed(hot.orderBy(F.desc("text")).coalesce(1))


def test_growing_moves_few_rows(small):
    before = {r.doc_id: r.shard for r in ring.shard_rows(small, 10).collect()}
    after = {r.doc_id: r.shard for r in ring.shard_rows(small, 11).collect()}
    assert sum(before[i] != after[i] for i in before) < len(before) / 2


def test_ring_edges(odd, none):
    clash = odd.withColumns({c: F.lit("x") for c in ("prefix", "size", "slot", "copies", "before", "points")})
    got = ring.shard_rows(clash, 3)
    assert got.columns == [*[c for c in clash.columns if c not in ring.ADDED], *ring.ADDED]
    got = got.collect()
    assert len(got) == odd.count() and {r.size for r in got if r.text is None} == {16}
    assert ring.shard_rows(none, 3).count() == 0


def test_mixing_meets_targets(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.posteriors(docs, mixing.fit(docs, known))
    p = {r.doc_id: r for r in found.collect()}
    truth = {r.doc_id: r.domain for r in mixing.domains(known).collect()}
    assert all(abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in p.values())
    right = sum(max(mixing.DOMAINS, key=lambda d: p[i][f"p_{d}"]) == d for i, d in truth.items())
    assert right > 0.95 * len(truth)
    weights = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}
    rated, target = mixing.rates(found, weights)
    rows = rated.collect()
    assert min(r.rate for r in rows) >= 0
    for d in mixing.DOMAINS:
        assert sum(r.n_tokens * r.rows * r.rate * r[f"p_{d}"] for r in rows) == pytest.approx(target[d], rel=0.02)


def test_held_out_domains(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit(docs, known.where("doc_id % 2 = 0"))
    p = {r.doc_id: r for r in mixing.posteriors(docs, model).collect()}
    truth = {r.doc_id: r.domain for r in mixing.domains(known.where("doc_id % 2 = 1")).collect()}
    assert sum(max(mixing.DOMAINS, key=lambda d: p[i][f"p_{d}"]) == d for i, d in truth.items()) > 0.85 * len(truth)


def test_rates_against_plain_descent(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, int(n), 1, *map(float, q)) for i, (n, q) in enumerate(zip(rng.integers(1, 500, 80), rng.dirichlet([2, 0.5, 0.5], 80)))]
    frame = spark.createDataFrame(rows, "doc_id long, h long, n_tokens long, rows long, p_clean double, p_junk double, p_toxic double")
    rated, target = mixing.rates(frame, {"clean": 1.0}, max_rate=1.5)
    n, p = np.array([r[2] for r in rows], float), np.array([r[4:] for r in rows])
    have, want, r = n @ p, np.array([target[d] for d in mixing.DOMAINS]), np.ones(80)
    for _ in range(mixing.ROUNDS * 50):
        r = np.clip(r - p @ (((n * r) @ p - want) / have), 0, 1.5)
    loss = lambda x: ((((n * x) @ p - want) ** 2) / have).sum()
    got = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
    assert got.min() >= 0 and got.max() <= 1.5
    assert loss(got) <= loss(r) * 1.05 + 1e-6 * want.sum()


def test_mixing_edges(odd, none, spark):
    known = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (-7, 1, 1), (None, 0, 0), (3, None, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    found = mixing.mix(odd, known).collect()
    assert sum(r.rows for r in found) == odd.count()
    clash = odd.withColumns({c: F.lit("x") for c in ("copies", "h", "domain", "p_clean", "rows", "words")})
    assert mixing.apply(clash, known, {"clean": 1.0}).columns == clash.columns
    assert mixing.apply(odd, known.where("false"), {"clean": 1.0}).count() == odd.count()
    assert mixing.mix(none, known).count() == 0
