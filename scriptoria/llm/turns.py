"""Repair of the turn structure of conversations by alignment to an alternating grammar (operator 11).

The turns of a conversation are aligned to the strings of ``(s?(ua)+)?`` (initials of system, user, assistant). The table of
Wagner and Fischer is filled from the end, so one table serves every target length with the same last letter; Ukkonen's
band keeps the cells that an alignment no dearer than the incumbent (a greedy repair) can pass. Every feasible length of
least cost is traced back to its least sequence of edits (Delete, Insert, Keep, Rerole), and the least of these wins.

Edits never span rows, so a conversation may be cut: rows are sorted over the cluster by conversation and turn, and a task
aligns the conversations that lie wholly inside it. Those that reach over the edge of a task, or over ``chunk`` rows, are
aligned piece by piece from every state to every state of the grammar; one task then walks over the few numbers of each
piece, and the edits go back to the rows by a join. Equal rows of a conversation are collapsed to a count before they are
sorted, so neither a hot conversation nor a hot text is one group. What is inherently sequential is the hash over a whole
repaired conversation: it streams the sorted lines of a conversation in bounded memory. The walk holds 48 numbers for each
``chunk`` rows of a conversation.

Contract: nulls in role and text are one space; a null turn comes before all others and is ignored by ``gaps``; rows with
equal turns are ordered by role, then text; a null conversation id is a conversation; a role that is empty or starts with
another letter than s, u or a can only be reroled or deleted; repeated rows are kept as rows (their repeats are duplicates);
very long conversations and texts are treated whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, record, table, tasks

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}  # the letter that follows a state; at 0 an s may come first
STATES = "0sua"
CLOSE = {"0": "", "s": "ua", "u": "a", "a": ""}  # what must follow the last row
LEGAL = {"su", "ua", "au"}
CHUNK = 128


class Turn(NamedTuple):
    letter: str  # initial of the role
    gone: bool  # blank or duplicate: must be deleted
    extra: int  # cost if it stays


# ---------------------------------------------------------------- alignment


class Table:
    """Least costs of aligning rows i.. to the last m letters of an alternating string that ends in ``last``.

    ``costs[i][m - low[i]]``; cells outside the band of alignments that cost at most ``bound`` are absent.
    """

    def __init__(self, rows: list[Turn], last: str, bound: int):
        n = len(rows)
        self.rows, self.last, self.low, self.costs = rows, last, [0] * (n + 1), [[]] * (n + 1)
        self.low[n], self.costs[n] = 0, [0]
        letters = (OTHER[last], last)  # by parity of the distance from the end
        for i in range(n - 1, -1, -1):
            row, left = rows[i], n - i
            low, high = max(0, left - bound // DELETE), left + bound // INSERT
            below, base, size = self.costs[i + 1], self.low[i + 1], len(self.costs[i + 1])
            line: list[int | None] = []
            for m in range(low, high + 1):
                best = None
                k = m - base
                if 0 <= k < size and below[k] is not None:
                    best = below[k] + DELETE
                if not row.gone and 0 < k <= size and below[k - 1] is not None:
                    c = below[k - 1] + row.extra + (0 if row.letter == letters[m & 1] else REROLE)
                    best = c if best is None or c < best else best
                if line and line[-1] is not None and (best is None or line[-1] + INSERT < best):
                    best = line[-1] + INSERT
                line.append(best if best is None or best <= bound else None)
            self.low[i], self.costs[i] = low, line

    def cost(self, i: int, m: int) -> int | None:
        k = m - self.low[i]
        return self.costs[i][k] if 0 <= k < len(self.costs[i]) else None

    def trace(self, i: int, m: int) -> str:
        """The least sequence of edits of an optimal alignment from here."""
        edits, n = [], len(self.rows)
        while i < n:
            row, c = self.rows[i], self.cost(i, m)
            if (d := self.cost(i + 1, m)) is not None and d + DELETE == c:
                edits.append("D")
                i += 1
            elif m and (d := self.cost(i, m - 1)) is not None and d + INSERT == c:
                edits.append("I")
                m -= 1
            else:
                keep = row.letter == (self.last if m & 1 else OTHER[self.last])
                edits.append("K" if keep else "R")
                i, m = i + 1, m - 1
        return "".join(edits)


def _lengths(start: str, last: str, limit: int) -> range:
    """Target lengths that lead from a state to a last letter."""
    if start == last:
        return range(0, limit + 1, 2)
    return range(1 if NEXT[start] == last else 2, limit + 1, 2)


def _ends(rows: list[Turn], start: str, tables: dict[str, Table]) -> dict[str, tuple[int, str]]:
    """State after the rows -> least cost and, of these, least edits."""
    n, found = len(rows), {}

    def offer(state: str, cost: int, edits) -> None:
        if state not in found or cost < found[state][0] or (cost == found[state][0] and edits() < found[state][1]):
            found[state] = (cost, edits())

    systems = [i for i, r in enumerate(rows) if r.letter == "s" and not r.gone] if start == "0" else []
    if start in "0s":
        offer(start, DELETE * n, lambda: "D" * n)
    for i in systems:
        offer("s", DELETE * (n - 1) + rows[i].extra, lambda i=i: "D" * i + "K" + "D" * (n - i - 1))
    for last, t in tables.items():
        limit = max(low + len(line) for low, line in zip(t.low, t.costs))
        for m in _lengths(start, last, limit):
            if (c := t.cost(0, m)) is not None:
                offer(last, c, lambda m=m: t.trace(0, m))
        for i in systems:
            for m in _lengths("s", last, limit):
                if (c := t.cost(i + 1, m)) is not None:
                    offer(last, DELETE * i + rows[i].extra + c, lambda i=i, m=m: "D" * i + "K" + t.trace(i + 1, m))
    return found


def incumbent(rows: list[Turn]) -> int:
    """Cost of the greedy repair: keep what follows, delete the rest, close the string."""
    state, cost = "0", 0
    for r in rows:
        if not r.gone and (r.letter == NEXT[state] or (r.letter == "s" and state == "0")):
            state, cost = r.letter, cost + r.extra
        else:
            cost += DELETE
    return cost + INSERT * len(CLOSE[state])


def repaired(rows: list[Turn]) -> tuple[int, str]:
    """Least cost of a whole conversation and the least edits of that cost."""
    bound = incumbent(rows)
    ends = _ends(rows, "0", {last: Table(rows, last, bound) for last in "ua"})
    return min((c + INSERT * len(CLOSE[s]), e + "I" * len(CLOSE[s])) for s, (c, e) in ends.items())


def transfers(rows: list[Turn]) -> dict[tuple[str, str], tuple[int, str]]:
    """(state before, state after) -> least cost and least edits of a piece; inserts stand before one of its rows."""
    bound, most = 2 * len(rows), DELETE * len(rows) + 2 * INSERT
    while True:
        tables = {last: Table(rows, last, bound) for last in "ua"}
        found = {(a, b): x for a in STATES for b, x in _ends(rows, a, tables).items()}
        if bound >= most or all(found.get((a, b), (bound + 1,))[0] <= bound for a in STATES for b in "ua"):
            return found
        bound = min(2 * bound, most)


def outcome(state: str, letter: str, edit: str) -> str:
    """The state after one edit."""
    return letter if edit == "K" else NEXT[state] if edit in "IR" else state


# ---------------------------------------------------------------- rows in order


def ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number, sorted over the cluster; ``first`` marks where a role and text are first seen."""
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    signature = F.md5(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"))
    rows = materialize(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("signature", signature), "turns")
    earliest = rows.groupBy("conv_id", "signature").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"))
    earliest = earliest.select(F.col("conv_id").alias("c"), F.col("signature").alias("s"), F.col("at.turn").alias("t"), F.lit(True).alias("first"))
    same = rows["conv_id"].eqNullSafe(earliest["c"]) & (rows["signature"] == earliest["s"]) & rows["turn"].eqNullSafe(earliest["t"])
    marked = rows.join(earliest, same, "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    n = tasks(turns.sparkSession)
    return marked.repartitionByRange(n, *by, F.substring("text", 1, 64).asc()).sortWithinPartitions(*by, F.asc("text"))


OUT = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("nth", pa.int64()),
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string()),
    ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("ends", pa.string()),
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("letters", pa.string()),
    ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
])
DDL = """kind string, conv_id long, part int, seq long, nth long, gaps long, blank long, duplicate long, truncated long, illegal long,
    cost long, audit string, sha256 string, low long, high long, turns long, ends string,
    costs array<long>, ranks array<long>, edits array<string>, letters string, role string, text string, edit string"""
BATCH = 4 << 20


def _emit(rows: list[dict]) -> pa.RecordBatch:
    return record(OUT, **{n: [r.get(n) for r in rows] for n in OUT.names})


class Piece:
    """Up to ``chunk`` consecutive rows of one conversation with what is counted on them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.lines = conv_id, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str | None, first: bool) -> None:
        """``text`` is None for a further copy of the row before."""
        gone = extra = 0
        body = text.strip(SPACES) if text is not None else self.body
        self.body = body
        if not body:
            self.blank += 1
            gone = 1
        elif not first:
            self.duplicate += 1
            gone = 1
        elif body[-1] not in ".!?":
            self.truncated += 1
            extra = TRUNCATED
        letter = role[:1] or " "
        if self.rows and self.rows[-1].letter + letter not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append(Turn(letter, bool(gone), extra))
        self.lines.append((role, text))

    def counts(self) -> dict:
        return {"conv_id": self.conv_id, **{n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns")}}


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _lines(state: str, edits: str, turns: list[Turn], lines: list[tuple]) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, row) of every edit; a deleted row has no role."""
    i = 0
    for e in edits:
        letter = turns[i].letter if i < len(turns) and e != "I" else ""
        state = outcome(state, letter, e)
        role, text = lines[i] if i < len(lines) and e != "I" else ("", "")
        yield e, {"I": ROLES.get(state), "R": ROLES.get(state), "K": role, "D": None}[e], text, i
        i += e != "I"


def _align(chunk: int, detail: bool):
    def whole(piece: Piece) -> Iterator[dict]:
        cost, audit = repaired(piece.rows)
        kept = [(e, r, t) for e, r, t, _ in _lines("0", audit, piece.rows, piece.lines)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept if r is not None).encode()).hexdigest()
        yield {"kind": "whole", **piece.counts(), "gaps": gaps(piece.low, piece.high, piece.turns), "cost": cost, "audit": audit, "sha256": digest}
        if detail:
            for nth, (e, r, t) in enumerate(kept):
                yield {"kind": "line", "conv_id": piece.conv_id, "part": -1, "seq": 0, "nth": nth, "edit": e, "role": r, "text": t if r is not None else None}

    def part_of(piece: Piece, part: int, seq: int) -> Iterator[dict]:
        found = transfers(piece.rows)
        keys = [(a, b) for a in STATES for b in STATES]
        order = {e: k for k, e in enumerate(sorted({e for _, e in found.values()}))}
        yield {
            "kind": "piece", "part": part, "seq": seq, **piece.counts(), "ends": piece.rows[0].letter + piece.rows[-1].letter, "letters": "".join(r.letter for r in piece.rows),
            "costs": [found[k][0] if k in found else -1 for k in keys], "ranks": [order[found[k][1]] if k in found else -1 for k in keys],
            "edits": [found[k][1] if k in found else None for k in keys],
        }
        for nth, (role, text) in enumerate(piece.lines):
            if text is not None:
                yield {"kind": "row", "conv_id": piece.conv_id, "part": part, "seq": seq, "nth": nth, "role": role, "text": text}

    def pieces(batches) -> Iterator[tuple[Piece, bool, bool]]:
        """Pieces in order, with: is it all of its conversation in this task, does it touch the edge of the task."""
        now, edge, cut = None, True, False
        for batch in batches:
            for c, turn, role, text, copies, first in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "first"))):
                for k in range(copies):
                    if now is None or c != now.conv_id:
                        if now is not None:
                            yield now, not cut, edge
                            edge = False
                        now, cut = Piece(c), False
                    elif len(now.rows) == chunk:
                        yield now, False, edge
                        body, now, cut = now.body, Piece(c), True
                        now.body = body
                    now.add(turn, role, text if k == 0 else None, first and k == 0)
        if now is not None:
            yield now, not cut, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, size = TaskContext.get().partitionId(), 0, [], 0
        for piece, all_of_it, edge in pieces(batches):
            seq += 1
            for row in whole(piece) if all_of_it and not edge else part_of(piece, part, seq):
                out.append(row)
                size += 300 + len(row.get("text") or "")
                if size > BATCH:
                    yield _emit(out)
                    out, size = [], 0
        if out:
            yield _emit(out)

    return run


# ---------------------------------------------------------------- conversations in pieces

WALK = pa.schema([(f.name, f.type) for f in OUT if f.name in ("conv_id", "part", "seq", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("state", pa.string()), ("chosen", pa.int32())])
WALK_DDL = "conv_id long, part int, seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, state string, chosen int"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cheapest way through the pieces of each conversation: the chosen transfer of each, and one row of totals.

    Of equally cheap ways the least edits win: transfers from one state are told apart by their rank at the first piece
    where they differ, as no sequence of edits of a piece is a prefix of another.
    """
    keys = [(a, b) for a in STATES for b in STATES]

    def solve(conv_id, pieces: list[dict]) -> list[dict]:
        to_go = [{"0": 0, "a": 0, "u": INSERT, "s": 2 * INSERT}]
        for p in reversed(pieces):
            ahead, here = to_go[-1], {}
            for (a, b), c in zip(keys, p["costs"]):
                if c >= 0 and b in ahead and (a not in here or c + ahead[b] < here[a]):
                    here[a] = c + ahead[b]
            to_go.append(here)
        to_go.reverse()
        state, out = "0", []
        total = {n: sum(p[n] for p in pieces) for n in ("blank", "duplicate", "truncated", "illegal", "turns")}
        low = next((p["low"] for p in pieces if p["low"] is not None), None)
        high = None
        for k, p in enumerate(pieces):
            total["illegal"] += k > 0 and pieces[k - 1]["ends"][1] + p["ends"][0] not in LEGAL
            total["turns"] -= p["low"] is not None and p["low"] == high
            high = p["high"] if p["high"] is not None else high
            ways = [(p["ranks"][j], j) for j, (a, b) in enumerate(keys) if a == state and p["costs"][j] >= 0 and b in to_go[k + 1] and p["costs"][j] + to_go[k + 1][b] == to_go[k][a]]
            j = min(ways)[1]
            out.append({"conv_id": conv_id, "part": p["part"], "seq": p["seq"], "state": state, "chosen": j})
            state = keys[j][1]
        turns = total.pop("turns")
        return [*out, {"conv_id": conv_id, **total, "gaps": gaps(low, high, turns), "cost": to_go[0]["0"], "state": state}]

    def give(rows):
        return record(WALK, **{n: [r.get(n) for r in rows] for n in WALK.names})

    names = ("conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "ends", "costs", "ranks")
    now, pieces = None, []
    for batch in batches:
        for values in zip(*(batch.column(n).to_pylist() for n in names)):
            p = dict(zip(names, values))
            if pieces and p["conv_id"] != now:
                yield give(solve(now, pieces))
                pieces = []
            now = p["conv_id"]
            pieces.append(p)
    if pieces:
        yield give(solve(now, pieces))


EDITS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("nth", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])
EDITS_DDL = "conv_id long, part int, seq long, nth long, step long, edit string, new_role string"


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edit of the chosen transfers, and the inserts that close a conversation (part null)."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            last = r["part"] is None
            edits = "I" * len(CLOSE[r["state"]]) if last else r["edits"][r["chosen"]]
            turns = [Turn(x, False, 0) for x in r["letters"] or ""]
            rows = [(step, e, role if e in "IR" else None, nth) for step, (e, role, _, nth) in enumerate(_lines(r["state"], edits, turns, []))]
            n = len(rows)
            if n:
                step, edit, role, nth = map(list, zip(*rows))
                yield record(
                    EDITS, conv_id=[r["conv_id"]] * n, part=[r["part"]] * n, seq=[r["seq"]] * n, step=step, edit=edit, new_role=role,
                    nth=[None if e in "ID" else k for e, k in zip(edit, nth)],
                )


DIGEST = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and hash of each conversation from its lines in order, as a stream."""
    conv_id, edits, lines, digest = None, None, 0, None
    for batch in batches:
        done = []
        for c, e, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edit", "role", "text"))):
            if edits is None or c != conv_id:
                if edits is not None:
                    done.append((conv_id, "".join(edits), digest.hexdigest()))
                conv_id, edits, lines, digest = c, [], 0, hashlib.sha256()
            edits.append(e)
            if role is not None:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        yield record(DIGEST, **dict(zip(DIGEST.names, map(list, zip(*done))))) if done else record(DIGEST, conv_id=[], audit=[], sha256=[])
    if edits is not None:
        yield record(DIGEST, conv_id=[conv_id], audit=["".join(edits)], sha256=[digest.hexdigest()])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, chunk: int = CHUNK, detail: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of every conversation in ``turns``.

    With ``detail`` also the edits in order: (conv_id, part, seq, step, edit, role, text); a deleted row has no role.
    """
    n = tasks(turns.sparkSession)
    done = materialize(ordered(turns).mapInArrow(_align(chunk, detail), DDL), "aligned")
    whole = done.where("kind = 'whole'").select("conv_id", *COUNTS, "audit", "sha256")
    key = F.asc_nulls_first("conv_id")
    pieces = done.where("kind = 'piece'")
    walk = pieces.select("conv_id", "part", "seq", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "ends", "costs", "ranks")
    walk = materialize(walk.repartition(n, "conv_id").sortWithinPartitions(key, "part", "seq").mapInArrow(_walk, WALK_DDL), "walk")
    chosen = walk.where("part is not null").join(pieces.select("part", "seq", "letters", "edits"), ["part", "seq"]).select("conv_id", "part", "seq", "state", "chosen", "letters", "edits")
    tails = walk.where("part is null").select("conv_id", "part", "seq", "state", "chosen", F.lit(None).cast("string").alias("letters"), F.lit(None).cast("array<string>").alias("edits"))
    edits = chosen.unionByName(tails).mapInArrow(_spell, EDITS_DDL)
    rows = done.where("kind = 'row'").select("part", "seq", "nth", F.col("role").alias("old_role"), "text")
    lines = edits.join(rows, ["part", "seq", "nth"], "left").select(
        "conv_id", "part", "seq", "step", "edit",
        F.when(F.col("edit") == "K", F.col("old_role")).otherwise(F.col("new_role")).alias("role"),
        F.when(F.col("edit") == "I", F.lit("")).when(F.col("edit") != "D", F.col("text")).alias("text"),
    )
    if detail:
        lines = materialize(lines, "lines")
    stream = lines.repartition(n, "conv_id").sortWithinPartitions(key, F.asc_nulls_last("part"), "seq", "step")
    digests = stream.mapInArrow(_digest, "conv_id long, audit string, sha256 string")
    totals = walk.where("part is null").select("conv_id", *COUNTS)
    both = totals.alias("t").join(digests.alias("d"), F.expr("t.conv_id <=> d.conv_id")).select("t.*", "d.audit", "d.sha256")
    detailed = None
    if detail:
        own = done.where("kind = 'line'").select("conv_id", "part", "seq", F.col("nth").alias("step"), "edit", "role", "text")
        detailed = own.unionByName(lines)
    return whole.unionByName(both), detailed


def damage(turns: DataFrame) -> DataFrame:
    """The faults of the contract, by crc32 of ``conv_id:turn``: dropped, emptied, cut, repeated and misattributed turns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(named.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


#: The same rows in SQL: no targets and bands, but least (cost, edits) of each state of the grammar, row by row.
SQL = r"""WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
    SELECT *, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT)),
        lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda c, n: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))))) % 20 AS fault FROM named),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM crc WHERE fault <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
    SELECT g, turn, role, text, CASE WHEN role = '' THEN ' ' ELSE role[1] END AS letter, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
        row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS seen
    FROM damaged d JOIN convs c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
faults AS MATERIALIZED (
    SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS duplicate, body <> '' AND seen = 1 AND body[-1] NOT IN ('.', '!', '?') AS truncated,
        lag(letter) OVER (PARTITION BY g ORDER BY i) || letter NOT IN ('su', 'ua', 'au') AS illegal, count(*) OVER (PARTITION BY g) AS n
    FROM placed),
states AS (
    SELECT g, 0::BIGINT AS i, {'c': 0::BIGINT, 'e': ''} AS o, {'c': 1000000000::BIGINT, 'e': ''} AS s, {'c': 1000000000::BIGINT, 'e': ''} AS u, {'c': 1000000000::BIGINT, 'e': ''} AS a FROM convs
    UNION ALL
    SELECT g, i, {'c': o.c + 4, 'e': o.e || 'D'},
        list_min([{'c': s.c + 4, 'e': s.e || 'D'}, {'c': o.c + IF(letter = 's', stay, 1000000000), 'e': o.e || 'K'}]),
        list_min([{'c': u.c + 4, 'e': u.e || 'D'}, {'c': least(o, s, a).c + stay + IF(letter = 'u', 0, 3), 'e': least(o, s, a).e || IF(letter = 'u', 'K', 'R')}]),
        list_min([{'c': a.c + 4, 'e': a.e || 'D'}, {'c': u.c + stay + IF(letter = 'a', 0, 3), 'e': u.e || IF(letter = 'a', 'K', 'R')}])
    FROM (
        SELECT b.g, f.i, letter, CASE WHEN blank OR duplicate THEN 1000000000 WHEN truncated THEN 3 ELSE 0 END AS stay, o, s,
            list_min([u, {'c': a.c + 3, 'e': a.e || 'I'}, {'c': s.c + 3, 'e': s.e || 'I'}, {'c': o.c + 3, 'e': o.e || 'I'}]) AS u,
            list_min([a, {'c': u.c + 3, 'e': u.e || 'I'}, {'c': s.c + 6, 'e': s.e || 'II'}, {'c': o.c + 6, 'e': o.e || 'II'}]) AS a
        FROM states b JOIN faults f ON f.g = b.g AND f.i = b.i + 1)),
best AS (
    SELECT b.g, list_min([o, a, {'c': u.c + 3, 'e': u.e || 'I'}, {'c': s.c + 6, 'e': s.e || 'II'}]) AS w
    FROM states b LEFT JOIN (SELECT g, max(n) AS n FROM faults GROUP BY g) f USING (g) WHERE b.i = coalesce(n, 0)),
steps AS (SELECT g, w.e AS audit, p, w.e[p] AS e, len(replace(w.e[:p - 1], 'I', '')) + 1 AS i, len(replace(w.e[:p], 'D', '')) AS k FROM (SELECT g, w, unnest(range(1, len(w.e) + 1)) AS p FROM best)),
lines AS (
    SELECT t.g, p, CASE WHEN e = 'K' THEN role ELSE IF((k - max(IF(e = 'K' AND letter = 's', 1, 0)) OVER (PARTITION BY t.g)) % 2 = 1, 'user', 'assistant') END || ':' || IF(e = 'I', '', text) AS line, e
    FROM steps t LEFT JOIN faults f ON f.g = t.g AND f.i = t.i)
SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
    count(*) FILTER (duplicate)::BIGINT AS duplicate, count(*) FILTER (truncated)::BIGINT AS truncated, count(*) FILTER (illegal)::BIGINT AS illegal,
    any_value(w.c)::BIGINT AS cost, any_value(w.e) AS audit,
    sha256(coalesce(any_value(whole), '')) AS repaired_sha256
FROM convs c JOIN best USING (g) LEFT JOIN faults USING (g)
    LEFT JOIN (SELECT g, string_agg(line, chr(10) ORDER BY p) FILTER (e <> 'D') AS whole FROM lines GROUP BY g) USING (g)
GROUP BY g, conv_id"""


@query("op11_turns", SQL)
def op11(spark, sf_dir):
    """Faults, cheapest edits and hash of the repaired form of every damaged conversation."""
    given = table(spark, sf_dir, "conversations")
    found, _ = repair(damage(given))
    every = given.select(F.col("conv_id").cast("long")).distinct()
    none = {**{c: F.lit(0).cast("long") for c in COUNTS}, "audit": F.lit(""), "sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    joined = every.alias("e").join(found.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    names = {"sha256": "repaired_sha256"}
    return joined.select("e.conv_id", *[F.coalesce(F.col(f"f.{c}"), d).alias(names.get(c, c)) for c, d in none.items()])
