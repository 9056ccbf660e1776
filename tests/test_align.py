"""Order-preserving comparison: differences rebuild the right text, and known edits are found."""

import difflib
import random

import pytest

from scriptoria.operators import align as A


def apply(left, diffs):
    out, at = [], 0
    for d in diffs:
        assert left[d.left_at : d.left_at + len(d.left_chars)] == d.left_chars
        assert sum(map(len, out)) + d.left_at - at == d.right_at
        out += [left[at : d.left_at], d.right_chars]
        at = d.left_at + len(d.left_chars)
    return "".join([*out, left[at:]])


def run(spark, pairs):
    left = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k long, a string")
    right = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pairs)], "k long, b string")
    return {r.k: r for r in A.align_texts(left, right, ["k"], "a", "b", normalize=False).collect()}


def flat(text):
    return "".join((text or "").replace(".", "").replace("\n", "").split())


def test_round_trip(spark):
    rng = random.Random(1)
    pairs = [("", ""), (None, "a. b."), ("a. b.", None), ("one. two. three.", "one. two. three."), ("x. x. x. y.", "x. y. x. x. x.")]
    for n in [1, 3, 8, 20, 60] * 6:
        words = [f"w{rng.randrange(n)} tail{rng.randrange(3)}" for _ in range(n)]  # many repeats
        other = list(words)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(other) + 1)
            edit = rng.choice("idrm")
            if edit == "i":
                other.insert(k, f"new{rng.randrange(5)}")
            elif other and k < len(other):
                if edit == "d":
                    del other[k]
                elif edit == "r":
                    other[k] = other[k][:3] + "Q" + other[k][3:]
                else:
                    other.insert(rng.randrange(len(other)), other.pop(k))
        pairs.append((". ".join(words), ". ".join(other)))
    found = run(spark, pairs)
    for k, (a, b) in enumerate(pairs):
        r, x, y = found[k], flat(a), flat(b)
        assert apply(x, r.diffs) == y
        assert (r.left_len, r.right_len) == (len(x), len(y))
        changed = sum(len(d.left_chars) + len(d.right_chars) for d in r.diffs)
        assert r.ratio == pytest.approx(1 - changed / (len(x) + len(y)) if x or y else 1.0)
        for d in r.diffs:
            left_from, right_from = max(0, d.left_at - 10), max(0, d.right_at - 10)
            end_l, end_r = d.left_at + len(d.left_chars), d.right_at + len(d.right_chars)
            assert d.left_context == f"{x[left_from:d.left_at]}【{d.left_chars}】{x[end_l:end_l + 10]}"
            assert d.right_context == f"{y[right_from:d.right_at]}【{d.right_chars}】{y[end_r:end_r + 10]}"


def test_agrees_with_a_sequence_matcher_on_small_edits(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(20):
        words = [f"s{rng.randrange(10**6)} t{k}" for k in range(30)]
        other = list(words)
        other[rng.randrange(10)] = "changed here"
        del other[rng.randrange(12, 20)]
        other.insert(rng.randrange(22, 28), "an added one")
        pairs.append((". ".join(words), ". ".join(other)))
    found = run(spark, pairs)
    for k, (a, b) in enumerate(pairs):
        assert found[k].ratio == pytest.approx(difflib.SequenceMatcher(None, flat(a), flat(b), autojunk=False).ratio(), abs=0.03)


def test_moves(spark):
    r = run(spark, [("first. second. third. fourth. fifth.", "second. third. first. fourth. fifth.")])[0]
    assert [tuple(m) for m in r.moves] == [(0, 11, "first")]
    assert [(d.op, d.left_chars, d.right_chars) for d in r.diffs] == [("delete", "first", ""), ("insert", "", "first")]


def test_chain():
    rng = random.Random(5)
    for _ in range(200):
        x = rng.sample(range(12), rng.randint(0, 8))
        chain = A.rising(x)
        best = max((bin(m).count("1") for m in range(1 << len(x)) if (s := [v for i, v in enumerate(x) if m >> i & 1]) == sorted(s)), default=0)
        assert len(chain) == best and [x[i] for i in chain] == sorted(x[i] for i in chain)


def test_texts_stay_out_of_the_rounds(spark, monkeypatch):
    """What is written for the rounds does not grow with the length of the segments."""
    written = {}
    keep = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, label="cut": written.setdefault(label, []).append(df.schema) or keep(df, label))
    long = ["x" * 500 + str(i) for i in range(30)]
    l = spark.createDataFrame([(1, "。".join(long)), (2, ""), (3, None)], "k int, t string")
    r = spark.createDataFrame([(1, "。".join(long[1:15] + ["new"] + long[16:] + long[:1])), (2, "a"), (3, "")], "k int, t string")
    got = {g.k: g for g in A.align_texts(l, r, ["k"], "t", "t", normalize=False).collect()}
    assert [(d.op, len(d.left_chars), len(d.right_chars)) for d in got[1].diffs] == [("delete", 501, 0), ("replace", 502, 3), ("insert", 0, 501)]
    assert [(m.left_at, m.text) for m in got[1].moves] == [(0, long[0])]
    assert (got[2].ratio, got[2].left_len, got[2].right_len, len(got[2].diffs)) == (0.0, 0, 1, 1) and got[3].ratio == 1.0 and got[3].diffs == [] == got[3].moves
    assert all(f.dataType.typeName() != "string" for label, schemas in written.items() if label != "pairs" for s in schemas for f in s)
