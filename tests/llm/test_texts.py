"""Per-document operators against plain code."""

import hashlib
import re
from collections import Counter

import pytest

from scriptoria.llm import decontaminate, fertility, licenses, private

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_quality(small):
    got = {r.doc_id: r for r in fertility.judge(small.select("doc_id", "lang", "text")).collect()}
    for r in small.collect():
        text = r.text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (g.n_dup_lines, g.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (g.kept and g.base_failed)


def test_bands_reject_junk_and_keep_clean(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    seen = Counter((r.quality, r.kept) for r in fertility.judge(docs).where("not base_failed").join(labels, "doc_id").collect())
    assert seen[1, False] == 0
    assert seen[0, False] > 2 * seen[0, True]


def test_entropy_is_free_of_length():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 100, 256)
    assert fertility.entropy(np.tile(ids, 5)) == pytest.approx(fertility.entropy(ids))
    assert fertility.entropy(np.zeros(100, np.int64)) == 0
    assert fertility.entropy(np.arange(64)) == pytest.approx(1)


def distance(item, text):
    """Least edit distance of ``item`` to any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_matches(spark):
    item = "seven grey geese cross a frozen lake while the miller counts his sacks of rye and barley again"
    k = decontaminate.budget(len(item))
    assert k >= 3
    texts = [item, item.upper(), item.replace(" ", " \n "), item.replace("grey", "gray"), item.replace("geese", "gese").replace("rye", "ryee"), item[:40] + "XX" + item[41:], item[:-9], item[20:] + " " + item[:20], "nothing of the kind", item.replace("seven", "eight")]
    rows = [(i, f"before it {t} after it") for i, t in enumerate(texts)] + [(50, None), (51, "")]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string"))
    got = {r.doc_id: r.distance for r in found.collect()}
    want = {i: d for i, t in rows if t and (d := distance(decontaminate.normal(item), decontaminate.normal(t))) <= k}
    assert got == want
    assert len(want) >= 6


def test_blocks_agree(small, spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.matches(small, items).collect()))
    assert one == sorted(map(tuple, decontaminate.matches(small, items, block_bytes=2000).collect()))
    texts = {r.doc_id: decontaminate.normal(r.text) for r in small.collect()}
    exact = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if decontaminate.normal(i.text) in t}
    assert {(r[0], r[1]) for r in one if r[2] == 0} == exact
    assert {r.doc_id for r in decontaminate.clean(small, items).collect()} == set(texts) - {r[0] for r in one}


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    changed = mit.replace("free of charge", "at no cost").replace("sublicense,", "")
    rows = [(0, "Code. " + mit), (1, "x " * 500 + changed + " y"), (2, "Released under the MIT License. And under the MIT license: CC-BY-NC"), (3, mit[:200]), (4, "the software is here"), (5, None), (6, "Apache License, Version 2.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].labels, got[0].base_labels, got[0].score) == ("mit", "", 1.0)
    assert got[1].labels == "mit" and 0.7 < got[1].score < 1 and got[1].spans[0].first == 507  # four words before the first change are no long match
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 10, "cc-by-nc,mit")
    assert (got[3].labels, got[4].labels, got[4].n_base, got[4].first_word) == ("", "", 0, None)
    assert 0 < got[3].score < 0.7
    assert (got[5].n_words, got[5].score, got[6].base_labels) == (0, 0.0, "apache-2")


def test_matching_statistics():
    sequences = [[1, 2, 3, 1, 2, 4], [2, 3, 5, 1, 2]]
    machine = licenses.Automaton(sequences)
    text = [1, 2, 3, 5, 1, 2, 4, -1, 2, 3, 1, 2, 4, 9, 3, 5, 1]

    def held(part):
        return {(t, i + len(part) - 1) for t, s in enumerate(sequences) for i in range(len(s)) if s[i : i + len(part)] == part}

    for end, length, state in machine.matches(text, 1):
        part = text[end + 1 - length : end + 1]
        assert machine.ends[state] == held(part)
        assert end + 1 == len(text) or not held(text[end + 1 - length : end + 2])
        assert length == end + 1 or not held(text[end - length : end + 1])


def test_base_spans(small):
    found = {r.doc_id: r for r in private.find(small).collect()}
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    checks = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)), lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15]
    for r in small.collect():
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, r.text or "") if checks[k](m[0]))
        listed = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        g = found[r.doc_id]
        assert g.base == listed and g.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(g.spans.split(","))


def test_disclosing_terms(spark):
    rows = [(i, f"plain{chr(97 + i)} words before Zorblax calls jo@x.org {'on of by at to in'.split()[i]} day {chr(97 + i)} of many others") for i in range(6)]
    rows += [(100 + i, f"plain words before calls and day of many others, part {i}") for i in range(40)] + [(200, "Then zorblax left."), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private.sanitise(docs, {"zorblax": "[someone]"}).collect()}
    assert "[someone] calls [EMAIL] on" in got[0].text or "[someone] [TERM] [EMAIL]" in got[0].text
    assert got[200].text == "Then [someone] left."
    assert got[100].spans == "" and got[201].text is None


@pytest.mark.parametrize("call", [lambda d: fertility.judge(d.withColumn("n_words", d.doc_id).withColumn("kept", d.lang)), lambda d: licenses.scan(d), lambda d: private.find(d)])
def test_edges(odd, none, call):
    assert call(odd).count() == odd.count()
    assert call(none).count() == 0


def test_decontaminate_edges(odd, none, spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old mill"), (None, None)], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontaminate.matches(odd, items).collect()) == [0, 4, 4, 4, 5]
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.clean(odd, items).count() == odd.count() - 5
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(odd, items.where("false")).count() == 0
