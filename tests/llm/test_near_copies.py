"""Near copies at similarity 0.8 against brute-force Jaccard over sets of five-word shingles."""

import random
from collections import Counter, defaultdict

import pytest

from scriptoria.llm import near_copies


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(texts, least=0.8):
    """Pairs of positions of different texts with similarity of at least ``least``."""
    sets, where, shared = [shingles(t) for t in texts], defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for ks in where.values():
        shared.update((a, b) for n, a in enumerate(ks) for b in ks[n + 1 :] if texts[a] != texts[b])
    return {p for p, n in shared.items() if n >= least * len(sets[p[0]] | sets[p[1]])}


def joined(pairs, n):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        s, t = top(a), top(b)
        up[max(s, t)] = min(s, t)
    return [top(x) for x in range(n)]


def edited(text, rng, share):
    words = text.split()
    for k in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("direct", [64, 4])
def test_recall_of_planted_copies(spark, direct):
    rng = random.Random(3)
    base = [" ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))) for _ in range(60)]
    texts = [t for b in base for t in [b, b, *(edited(b, rng, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2))]]
    texts += [edited(base[0], rng, 0.015) for _ in range(150)]  # a large group
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(6)
    links, _ = near_copies.groups(df, direct=direct)
    pairs = brute(texts)
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()}
    first = {}
    same = [(first.setdefault(t, k), k) for k, t in enumerate(texts)]
    for a, b in found:
        assert len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))
    root = joined([*found, *same], len(texts))
    assert sum(root[a] == root[b] for a, b in pairs) >= 0.95 * len(pairs)
    want = joined([*pairs, *same], len(texts))
    assert all(want[a] == want[b] for a, b in found)


def test_stage_on_a_whole_table(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    pairs = brute([texts[i] for i in ids])
    kept = {r.doc_id for r in near_copies.keep_one(docs).select("doc_id").collect()}
    assert {texts[i] for i in kept} <= set(texts.values()) and len({texts[i] for i in kept}) == len(kept)
    left = [(a, b) for a, b in pairs if ids[a] in kept and ids[b] in kept]
    assert pairs and len(left) <= 0.1 * len(pairs)
    touched = {ids[x] for p in pairs for x in p}
    lone = {i for i in ids if i not in touched}
    assert {texts[i] for i in lone} <= {texts[i] for i in kept}  # a text without a near copy always stays once


def test_odd_rows(spark, odd, none):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and near_copies.keep_one(none).collect() == []
    rows = kept.collect()
    given = odd.collect()
    assert Counter(bool(shingles(r.text)) for r in rows)[False] == 1  # empty and null texts are copies of each other
    assert sum("quick brown fox" in (r.text or "") for r in rows) == len(set(joined(brute([r.text for r in given]) | {
        (a, b) for a, x in enumerate(given) for b, y in enumerate(given) if a < b and x.text == y.text}, len(given))) & {k for k, r in enumerate(given) if "quick brown fox" in (r.text or "")})


@pytest.mark.parametrize("direct", [64, 4])
def test_no_pair_at_the_threshold_is_left_out(spark, direct):
    """Pairs at just 0.8, of which fingerprints miss some, in a corpus with a line that most texts share."""
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(12))
    texts = []
    for n in range(300):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(24, 90))]
        whole = len(words) - 4
        cut = 0  # the longest text without its end that still has the similarity
        while whole - cut - 1 >= 0.8 * whole:
            cut += 1
        middle = list(words)
        middle[len(words) // 2] = "x"
        texts += [" ".join(words), " ".join(words[: len(words) - cut]), " ".join(middle)]
        if n % 2:
            texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))) + " " + common, common]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(6)
    links, nodes = near_copies.groups(df, direct=direct)
    pairs, found = brute(texts), {(r.a, r.b) for r in links.collect()}
    assert all(len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b])) for a, b in found)
    same = [(r.id, r.ord) for r in nodes.collect()]
    assert pairs and joined([*found, *same], len(texts)) == joined([*pairs, *same], len(texts))


def test_texts_go_through_joins_compressed(spark, monkeypatch):
    """What is written for the pairs holds compressed texts and no sets of hashes; the first row of each group stays."""
    rng = random.Random(11)
    base = [" ".join(f"v{rng.randrange(300)}" for _ in range(400)) for _ in range(30)]
    texts = [t for b in base for t in (b, edited(b, rng, 0.005), b)]
    written, real = {}, near_copies.materialize

    def seen(df, label="cut"):
        written[label] = out = real(df, label)
        return out

    monkeypatch.setattr(near_copies, "materialize", seen)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in near_copies.keep_one(df).collect()}
    assert kept == {k for k, top in enumerate(joined([(i, j) for i, j in brute(texts)] + [(3 * k, 3 * k + 2) for k in range(30)], len(texts))) if k == top}
    assert "sets" not in written and set(written["texts"].columns) == {"ord", "packed"}
