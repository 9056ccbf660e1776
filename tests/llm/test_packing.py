"""Packing: ids as the tokenizers library gives them, gapless sequences, and as few as plain search finds."""

import random
import zlib
from itertools import product

import numpy as np
import pytest

from scriptoria.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def check(rows, capacity):
    """Every sequence is filled from 0 without gaps up to at most ``capacity``; the number of sequences."""
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity", [2048, 100])
def test_whole_table(spark, small, tokenizer, capacity):
    rows = packing.pack(small.repartition(5), capacity).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in small.collect()}
    assert by_doc.keys() == texts.keys()
    total = 0
    for i, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            body = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(body))
            at += r.length
        assert at == len(ids)
    used = check(rows, capacity)
    assert -(-total // capacity) <= used <= -(-total // capacity) + 1


def test_fullest_is_the_fullest():
    rng = random.Random(2)
    for _ in range(300):
        available = [(n, rng.randint(1, 4)) for n in sorted(rng.sample(range(1, 40), rng.randint(1, 5)), reverse=True)]
        room = rng.randint(0, 90)
        chosen = packing.fullest(available, room)
        best = max(s for s in (sum(n * k for (n, _), k in zip(available, ks)) for ks in product(*(range(c + 1) for _, c in available))) if s <= room)
        assert sum(n * k for n, k in chosen.items()) == best
        assert all(k <= dict(available)[n] for n, k in chosen.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    for capacity in (1, 10, 97):
        counts = {n: rng.choice([1, 2, 30, 100_000]) for n in rng.sample(range(1, capacity + 1), min(capacity, 40))}
        made = packing.plan(counts, capacity)
        used = dict.fromkeys(counts, 0)
        for combination, times in made:
            assert sum(n * c for n, c in combination.items()) <= capacity
            for n, c in combination.items():
                used[n] += c * times
        assert used == counts


def test_plan_of_many_lengths_is_small_and_nearly_full():
    rng = random.Random(6)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    made = packing.plan(counts)
    bins, least = sum(t for _, t in made), -(-sum(n * c for n, c in counts.items()) // 2048)
    assert len(made) < 10_000
    assert bins <= 1.02 * max(least, sum(c for n, c in counts.items() if n > 1024))


def test_odd_texts(spark, odd, none, tokenizer):
    rows = packing.pack(odd).collect()
    check(rows, 2048)
    empty = [r for r in rows if r.doc_id == 2]
    assert [(r.piece, r.start, r.length) for r in empty] == [(0, 0, 1)]
    assert sum(r.doc_id == 4 and r.piece == 0 for r in rows) == 3
    assert sum(r.doc_id is None and r.piece == 0 for r in rows) == 2
    assert packing.pack(none).collect() == []
    special = spark.createDataFrame([(1, "x<|endoftext|>y"), (2, "a" * 300_000)], "doc_id long, text string")
    lengths = {}
    for r in packing.pack(special).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in special.collect()}


def test_sequences(small, tokenizer):
    found = packing.sequences(small, 300).collect()
    ids = [i for r in found for i in r.ids]
    want = [i for r in small.collect() for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]]
    assert sorted(ids) == sorted(want) and max(len(r.ids) for r in found) <= 300
