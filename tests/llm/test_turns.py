"""Conversation repair against plain search over edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from scriptoria.llm import turns as T

SPACES = " \t\n\x0b\x0c\r"
CLOSE = {"0": "", "s": "ua", "u": "a", "a": ""}


def search(rows):
    """(cost, audit): least over all edits, row by row through the states of the grammar."""

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in "0a":
                options.append((0, ""))
        else:
            letter, gone, extra = rows[i]
            follows = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
            c, e = best(i + 1, state, 0)
            options.append((c + 4, "D" + e))
            if not gone:
                if letter in follows:
                    c, e = best(i + 1, letter, 0)
                    options.append((c + extra, "K" + e))
                for to in "ua":
                    if to in follows and to != letter:
                        c, e = best(i + 1, to, 0)
                        options.append((c + 3 + extra, "R" + e))
        if inserted < 3:
            for to in "ua":
                if to in {"0": "u", "s": "u", "u": "a", "a": "u"}[state]:
                    c, e = best(i, to, inserted + 1)
                    options.append((c + 3, "I" + e))
        return min(options, default=(10**9, ""))

    return best(0, "0", 0)


def brute(given):
    """The contract's row of each conversation, from (conv_id, turn, role, text) before damage."""
    show = lambda x: " " if x is None else str(x)
    convs = {}
    for c, t, r, x in given:
        rows = convs.setdefault(c, [])
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        r, x = show(r), show(x)
        if k == 1:
            x = ""
        elif k == 2:
            x = "".join(y for y in x if y not in ".!?")
        elif k == 4:
            r = "user"
        rows += [] if k == 0 else [(t, r, x)] * (2 if k == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, table, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, r, x in rows:
            body, fault = x.strip(SPACES), None
            if not body:
                fault = "blank"
            elif (r, x) in seen:
                fault = "duplicate"
            elif body[-1] not in ".!?":
                fault = "truncated"
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            table.append((r[:1] or " ", fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
        cost, audit = search(tuple(table))
        state, i, lines = "0", 0, []
        for e in audit:
            if e in "IR":
                state = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
                lines.append({"u": "user:", "a": "assistant:"}[state] + (rows[i][2] if e == "R" else ""))
            elif e == "K":
                state = table[i][0]
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
            i += e != "I"
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(table, table[1:]))
        out[c] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, df, chunk=T.CHUNK):
    found, _ = T.repair(T.damage(df), chunk)
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def compare(spark, df, **kw):
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    have = got(spark, df, **kw)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c: have.get(c, empty) for c in want} == want and have.keys() <= want.keys()


def test_alignment():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [T.Turn(rng.choice("uuaaas x"), rng.random() < 0.25, rng.choice([0, 0, 3])) for _ in range(rng.randint(0, 8))]
        assert T.repaired(rows) == search(tuple(rows)), rows


def test_pieces_join_to_the_whole():
    rng = random.Random(2)
    order = {s: k for k, s in enumerate(T.STATES)}
    for _ in range(300):
        rows = [T.Turn(rng.choice("uuaaasx"), rng.random() < 0.3, rng.choice([0, 0, 3])) for _ in range(rng.randint(1, 9))]
        at, ways = 0, {"0": (0, "")}
        while at < len(rows):
            n = rng.randint(1, 3)
            moves = T.transfers(rows[at : at + n])
            after = {}
            for (a, b), (c, e) in moves.items():
                if a in ways:
                    after[b] = min(after.get(b, (10**9, "")), (ways[a][0] + c, ways[a][1] + e))
            ways, at = after, at + n
        assert min((c + 3 * len(CLOSE[s]), e + "I" * len(CLOSE[s])) for s, (c, e) in ways.items()) == search(tuple(rows)), order


@pytest.mark.parametrize("chunk", [128, 2])
def test_whole_table(spark, sf, chunk):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet")
    compare(spark, df, chunk=chunk)


def test_odd_conversations(spark):
    rows = [
        (None, 1, "user", "Null id. "), (None, None, None, None), (1, None, "user", "a."), (1, 5, "assistant", None), (1, 5, None, "x"), (1, 5, "assistant", "tie."), (1, 5, "assistant", "tie."),
        (2, 0, "system", "s."), (2, 1, "system", "s2."), (2, 2, "user", "odd 　"), (3, None, "user", ""), (4, -3, "", "no role."), (4, 9, "tool", "t!"), (4, 10, "assistant", "\x00 "),
    ]
    rng = random.Random(7)
    rows += [(50, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hot text.", "one", "two!", f"t{t}?"])) for t in range(700)]
    rows += [(51, 3, "user", "the same row.")] * 300 + [(52, 1, "user", "word " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    for chunk in (128, 3):
        compare(spark, df, chunk=chunk)
    assert got(spark, df.where("false")) == {}


def test_detail(spark, sf):
    df = T.damage(spark.read.parquet(f"{sf}/conversations.parquet"))
    found, lines = T.repair(df, chunk=4, detail=True)
    by = {}
    for r in lines.orderBy("conv_id", lines["part"].asc_nulls_last(), "seq", "step").collect():
        by.setdefault(r.conv_id, []).append(r)
    for r in found.collect():
        own = by.get(r.conv_id, [])
        assert "".join(x.edit for x in own) == r.audit
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own if x.role is not None).encode()).hexdigest() == r.sha256
