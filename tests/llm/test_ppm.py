"""Scores against a plain trie over dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from scriptoria.llm import ppm


def model(texts, order):
    """Counts of the longest contexts; a shorter context counts a symbol once for each longer one."""
    counts = defaultdict(Counter)
    for b in texts:
        w = bytes([ppm.START]) * order + b + bytes([ppm.END])
        for i in range(order, len(w)):
            counts[w[i - order : i]][w[i]] += 1
    for k in range(order - 1, -1, -1):
        for context in [c for c in counts if len(c) == k + 1]:
            for symbol in counts[context]:
                counts[context[1:]][symbol] += 1
    return counts


def code(counts, b, order):
    w, total = bytes([ppm.START]) * order + b + bytes([ppm.END]), 0.0
    for i in range(order, len(w)):
        seen = set()
        for k in range(order, -1, -1):
            c = counts.get(w[i - k : i])
            if not c:
                continue
            n, d = sum(v for s, v in c.items() if s not in seen), sum(s not in seen for s in c)
            if w[i] in c:
                total += math.log10((2 * c[w[i]] - 1) / (2 * n))
                break
            if d:
                total += math.log10(d / (2 * n))
            seen = set(c)
        else:
            total -= math.log10(256 - len(seen))
    return total


@pytest.mark.parametrize("options", [{}, {"heads": 20, "block": 5000}])
def test_scores(small, options):
    docs = small.where("doc_id < 60")
    rows = docs.collect()
    lower = {r.doc_id: (r.text or "").encode().lower() for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in lower}
    train = [b for i, b in lower.items() if not held[i]]
    tokens = Counter(w for b in train for w in b.split())
    n, v = sum(tokens.values()) + len(train), len(tokens) + 1
    counts = model(train, ppm.ORDER)
    for r in ppm.score_texts(docs, **options).collect():
        words = lower[r.doc_id].split()
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words) + 1, sum(tokens[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(lower[r.doc_id]) < 3000:
            assert r.score == pytest.approx(code(counts, lower[r.doc_id], ppm.ORDER), rel=1e-5)


def test_probabilities_sum_to_one(small):
    texts = [(r.text or "").encode().lower() for r in small.limit(5).collect()]
    counts = model(texts, 3)
    for context in (b"the", b"e t", b"zzz"):
        total = 0.0
        for s in range(256):
            seen, p = set(), 1.0
            for k in range(3, -1, -1):
                c = counts.get(context[3 - k :])
                if not c:
                    continue
                n, d = sum(v for x, v in c.items() if x not in seen), sum(x not in seen for x in c)
                if s in c:
                    p *= (2 * c[s] - 1) / (2 * n)
                    break
                p *= d / (2 * n) if d else 1
                seen = set(c)
            else:
                p /= 256 - len(seen)
            total += p if s not in () else 0
        assert total == pytest.approx(1, abs=1e-9)


def test_edges(odd, none):
    assert ppm.score_texts(odd).count() == odd.count()
    assert ppm.score_texts(none).count() == 0
    only = ppm.score_texts(odd.where("doc_id = 1")).first()
    assert only.n_tokens == 1
