"""Very long texts: linear scans that find what the plain patterns and counts find."""

import random
import time

from scriptoria.llm import licenses, private


def test_leftmost_matches_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-_ 2+é") for _ in range(rng.randrange(40)))
        for kind in ("email", "ip"):
            pattern = private.PATTERNS[kind]
            assert [m.span() for m in private.leftmost(kind, pattern, text)] == [m.span() for m in pattern.finditer(text)]


def test_phrase_places_count_words():
    rng = random.Random(4)
    phrases = [("a b", "x"), ("a a", "y"), ("b", "z")]
    for _ in range(300):
        words = [rng.choice("abc").encode() for _ in range(rng.randrange(30))]
        want = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        assert licenses.phrase_places(words, phrases) == want


def test_a_megabyte_of_one_kind():
    begun = time.monotonic()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "a@" * 500_000, "+1" + " " * 1_000_000):
        private.base_spans(text)
    words = b"under the mit license ".split() * 60_000
    assert len(licenses.phrase_places(words, [("under the mit license", "mit")])) == 60_000
    assert time.monotonic() - begun < 20
