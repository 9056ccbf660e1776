"""Licence scans by a generalised suffix automaton of licence tokens (operator 7).

The automaton holds all token sequences of all templates. A file is streamed through it token by token: the state and the
length reached are the matching statistics, the longest suffix of what was read that occurs in some template. A place
where the length cannot grow further ends a maximal match. Matches of at least ``min_match`` tokens (or a whole template)
are placed in the templates that hold them and chained: in one template, in order on both sides, with at most ``max_gap``
tokens between two links in the file. A chain that covers at least ``cover`` of its template labels the file; the score is
the largest share of a template that a chain covers, labelled or not.

The templates are a parameter of bounded size (a few thousand tokens a licence) and are sent to all tasks. Texts are
streamed whole; what is kept of a text is its long matches only.

Contract: a null or empty text has no words, labels or places and score 0; repeated templates and labels count once; repeated
rows come back each; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, query, record, table
from .license_texts import PHRASES, TEMPLATES

MIN_MATCH = 5
MAX_GAP = 12
COVER = 0.7

#: Lower case for A-Z; every other ASCII byte that is no letter or digit separates words.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Automaton:
    """Suffix automaton of several token sequences; states know where their strings end in the templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((t, i))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, p: int, token: int) -> int:
        q = self.next[p].get(token)
        if q is not None:  # another template has this string
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        new = self._state(self.length[p] + 1, {}, 0)
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches (end in the file, length, state) of at least ``least`` tokens; -1 is in no template."""
        out = []
        state = length = 0
        follow = self.next
        for i, token in enumerate(tokens):
            if token >= 0:
                to = follow[state].get(token)
                if to is not None:
                    state, length = to, length + 1
                    continue
            if length >= least:
                out.append((i - 1, length, state))
            if token < 0:
                state = length = 0
                continue
            while state and token not in follow[state]:
                state = self.link[state]
                length = self.length[state]
            to = follow[state].get(token)
            state, length = (to, length + 1) if to is not None else (0, 0)
        if length >= least:
            out.append((len(tokens) - 1, length, state))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], min_match: int, max_gap: int, cover: float):
        seen = list(dict.fromkeys((label, tuple(words_of(text.encode()))) for label, text in templates))
        self.labels = [label for label, w in seen if w]
        sequences = [list(w) for _, w in seen if w]
        self.index: dict[bytes, int] = {}
        self.ids = [[self.index.setdefault(w, len(self.index)) for w in s] for s in sequences]
        self.automaton = Automaton(self.ids)
        self.least = min([min_match, *map(len, self.ids)])
        self.min_match, self.max_gap, self.cover = min_match, max_gap, cover

    def spans(self, words: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """(label, share covered, first word, end word, template) of the best chain of each template."""
        get = self.index.get
        tokens = [get(w, -1) for w in words]
        places: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in self.automaton.matches(tokens, self.least):
            for t, at in self.automaton.ends[state]:
                if length >= min(self.min_match, len(self.ids[t])):
                    places.setdefault(t, []).append((end + 1 - length, at + 1 - length, length))
        out = []
        for t, hits in places.items():
            best: list[tuple[int, int]] = []  # (covered, first word) of the best chain that ends in each hit
            for k, (f, p, n) in enumerate(hits):
                gain = (n, f)
                for j in range(k - 1, -1, -1):  # hits come in the order of their ends in the file
                    f0, p0, n0 = hits[j]
                    if f - (f0 + n0) > self.max_gap:
                        break
                    over = max(0, f0 + n0 - f, p0 + n0 - p)
                    if p0 < p and f0 < f and n - over > 0 and best[j][0] + n - over > gain[0]:
                        gain = (best[j][0] + n - over, best[j][1])
                best.append(gain)
            k = max(range(len(best)), key=lambda k: best[k][0])
            out.append((self.labels[t], min(1.0, best[k][0] / len(self.ids[t])), best[k][1], hits[k][0] + hits[k][2], t))
        return out


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(first word, label) of every place of every phrase."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at, last, word = line.find(wanted), 0, 0
        while at >= 0:
            word, last = word + line.count(b" ", last, at), at  # counted on from the place before
            out.append((word, label))
            at = line.find(wanted, at + 1)
    return out


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])))]
)


def _scan(model):
    built: list[Scanner] = []

    def run(batches):
        if not built:
            built.append(Scanner(*model.value))
        for batch in batches:
            texts, rows = Texts(batch.column("text")), []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                words = words_of(texts.text(i))
                base = phrase_places(words, PHRASES)
                spans = built[0].spans(words)
                good = [s for s in spans if s[1] >= built[0].cover]
                firsts = [f for f, _ in base]
                rows.append((
                    doc_id, len(words), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({label for _, label in base})),
                    ",".join(sorted({label for _, label in base} | {s[0] for s in good})), max([1.0 if base else 0.0, *(s[1] for s in spans)]),
                    [{"label": s[0], "share": s[1], "first": s[2], "end": s[3]} for s in sorted(good, key=lambda s: (s[2], s[3], s[0]))],
                ))
            yield record(FOUND, **dict(zip(FOUND.names, zip(*rows) if rows else ([],) * len(FOUND.names))))

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, cover: float = COVER) -> DataFrame:
    """Base places, labels, score and template spans (in words) of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((TEMPLATES if templates is None else templates, min_match, max_gap, cover))
    fields = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,share:double,first:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(model), fields)


@query("op7_licenses")
def op7(spark, sf_dir):
    """Licence phrases and templates found in every document."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
