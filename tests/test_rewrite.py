"""Leftmost-longest rewriting against a regular expression of all phrases."""

import random
import re

import pytest
from helpers import rows

from scriptoria.operators import rewrite as W


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_one_pass_of_a_regular_expression(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(W, "fits_broadcast", lambda df: False)
    rnd = random.Random(9)
    letters = "ab龍\U0001f600."
    table = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))): rnd.choice(["", "X", "yy", "a"]) for _ in range(12)}
    texts = [None, "", "a", *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))) for _ in range(60)), "ab" * 3000]
    pattern = re.compile("|".join(re.escape(s) for s in sorted(table, key=lambda s: -len(s))))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    phrases = spark.createDataFrame([*table.items(), ("", "no")], "src string, dst string")
    want = [(k, None if t is None else pattern.sub(lambda m: table[m.group(0)], t)) for k, t in enumerate(texts)]
    for window in (4, 256):
        got = W.rewrite_phrases(df, "text", phrases, window=window)
        assert got.columns == ["k", "text"] and rows(got) == sorted(want, key=repr)
    assert rows(W.rewrite_phrases(df, "text", phrases.limit(0), out="new").select("k", "new")) == sorted(enumerate(texts), key=repr)


def test_a_small_table_rewrites_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "aab b"), (2, None)], "k long, text string")
    found = W.rewrite_phrases(df, "text", spark.createDataFrame([("aa", "x"), ("aa", "w"), ("b", None)], "src string, dst string"))
    assert rows(found) == [(1, "w "), (2, None)]
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString()
