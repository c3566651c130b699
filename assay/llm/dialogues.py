"""Conversation repair: turns aligned to the nearest sequence of alternating roles.

A conversation should be nothing, or an optional system turn and then user and assistant in turn.
For each length there is one such sequence of roles. The turns are aligned to it by edits (keep,
give another role, delete, insert an empty turn), in a table of costs whose columns count the
roles still to come; sequences of all lengths end alike, so they share its columns. A plain
alignment gives the incumbent cost, and the table is filled only in the band that a cost no higher
can reach. The audits of all cheapest lengths are traced back and the least of them is taken.

Turns meet in one task per conversation, in order, as a stream. The first pass moves a few bytes
per turn and finds the edits; the second moves the texts and applies them as they pass, so no task
holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mapped

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: White space that does not make a turn, and the ends of a whole one.
BLANKS = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
#: Adjacent roles that may follow each other.
LEGAL = ("su", "ua", "au")
#: Cells of a table of costs, four bytes each; a longer conversation folds its columns.
CELLS = 1 << 24

_NEVER = 1 << 29
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _match(initial: str, must: bool, cut: bool, role: str) -> int:
    """The cost of a turn that stays in the place of a role."""
    if must or (role == "s" and initial != "s"):
        return _NEVER
    return (KEEP if initial == role else REROLE) + CUT * cut


def incumbent(initials: list[str], must: list[bool], cut: list[bool]) -> int:
    """The cost of a plain alignment: turns that may stay take the roles one by one, and an odd
    one gets an empty turn behind it."""
    stay = [(i, c) for i, m, c in zip(initials, must, cut) if not m]
    best = DELETE * len(initials)
    for lead in (0, 1):
        rest = stay[lead:]
        if not rest or (lead and stay[0][0] != "s"):
            continue
        cost = DELETE * (len(initials) - len(stay)) + INSERT * (len(rest) % 2) + (CUT * stay[0][1] if lead else 0)
        cost += sum((KEEP if i == "ua"[k % 2] else REROLE) + CUT * c for k, (i, c) in enumerate(rest))
        best = min(best, cost)
    return best


def _table(initials: list[str], must: list[bool], cut: list[bool], low: int, high: int) -> np.ndarray:
    """Cost of the turns from each on, by roles to come less turns to come, from -low to high."""
    n, width = len(initials), low + high + 1
    shift = np.arange(width, dtype=np.int32)
    table = np.empty((n + 1, width), np.int32)
    table[n] = np.where(shift < low, _NEVER, INSERT * (shift - low))
    for i in range(n - 1, -1, -1):
        below, left = table[i + 1], shift - low + n - i  # left: roles to come
        row = np.empty(width, np.int32)
        row[:-1] = below[1:] + DELETE
        row[-1] = _NEVER
        even, odd = (_match(initials[i], must[i], cut[i], role) for role in "ua")
        np.minimum(row, below + np.where(left % 2 == 0, even, odd), out=row, where=left > 0)
        row[left < 0] = _NEVER
        row = np.minimum.accumulate(row - INSERT * shift) + INSERT * shift
        table[i] = np.minimum(row, _NEVER)
    return table


def _traced(table: np.ndarray, low: int, i: int, left: int) -> str:
    """The least audit of the cheapest alignment of the turns from `i` to the last `left` roles."""
    n, out = len(table) - 1, []
    while i < n or left:
        at = left - (n - i) + low
        cost = table[i, at]
        if i < n and at + 1 < table.shape[1] and table[i + 1, at + 1] + DELETE == cost:
            out.append("D")
            i += 1
        elif left and at and table[i, at - 1] + INSERT == cost:
            out.append("I")
            left -= 1
        else:  # KEEP and REROLE differ in cost, by REROLE
            out.append("K" if cost - table[i + 1, at] <= CUT else "R")
            i, left = i + 1, left - 1
    return "".join(out)


def aligned(initials: list[str], must: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, audit) by a banded table for every feasible length."""
    n = len(initials)
    bound = incumbent(initials, must, cut)
    low, high = bound // DELETE, bound // INSERT
    if (n + 1) * (low + high + 1) > CELLS:
        return folded(initials, must, cut)
    table = _table(initials, must, cut, low, high)
    even = [k for k in range(max(0, n - low), n + high + 1) if k % 2 == 0]
    costs = {k: int(table[0, k - n + low]) for k in even}
    # A system turn can only be kept, as the first that stays: those before it are deleted.
    leads: dict[int, dict[int, int]] = {}
    for i in range(min(n, bound // DELETE + 1)):
        if initials[i] == "s" and not must[i]:
            rest = n - i - 1
            ks = [k for k in range(max(2, rest - low), rest + high + 1) if k % 2 == 0]
            leads[i] = {k: DELETE * i + CUT * cut[i] + int(table[i + 1, k - rest + low]) for k in ks}
    best = min([*costs.values(), *(c for found in leads.values() for c in found.values())])
    audits = [_traced(table, low, 0, k) for k, c in costs.items() if c == best]
    for i, found in leads.items():
        audits += ["D" * i + "K" + _traced(table, low, i + 1, k) for k, c in found.items() if c == best]
    return best, min(audits)


def folded(initials: list[str], must: list[bool], cut: list[bool]) -> tuple[int, str]:
    """As `aligned`, for any number of turns: the sequences repeat, so columns of one parity are
    laid over each other, and a column says only which role comes next."""
    n = len(initials)
    costs = np.full((n + 1, 4), _NEVER, np.int64)  # none to come, user next, assistant next, system next
    for i in range(n, -1, -1):
        row = costs[i]
        below = costs[i + 1] if i < n else np.full(4, _NEVER)
        row[:] = np.minimum(below + DELETE, _NEVER)
        row[0] = DELETE * (n - i)
        stay = [_match(initials[i], must[i], cut[i], role) if i < n else _NEVER for role in "uas"]
        for _ in range(2):
            row[2] = min(row[2], INSERT + min(row[0], row[1]), stay[1] + min(below[0], below[1]))
            row[1] = min(row[1], INSERT + row[2], stay[0] + below[2])
        row[3] = min(row[3], stay[2] + below[1])
    best = int(min(costs[0, 0], costs[0, 1], costs[0, 3]))
    i, left, states, out = 0, best, {s for s in (0, 1, 3) if costs[0, s] == best}, []
    after = {1: (2,), 2: (0, 1), 3: (1,)}
    while i < n or 0 not in states or left:
        moves: dict[str, tuple[int, int, set[int]]] = {}
        for s in states:
            steps = []
            if i < n:
                steps.append(("D", DELETE, i + 1, (s,)))
                if s:
                    price = _match(initials[i], must[i], cut[i], " uas"[s])
                    steps.append(("K" if price <= CUT else "R", price, i + 1, after[s]))
            if s in (1, 2):
                steps.append(("I", INSERT, i, after[s]))
            for letter, price, j, nexts in steps:
                for t in nexts:
                    if price + costs[j, t] == left:
                        moves.setdefault(letter, (j, left - price, set()))[2].add(t)
        letter = min(moves)
        i, left, states = moves[letter]
        out.append(letter)
    return best, "".join(out)


def turns_of(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest): nulls of role and text as one space. The order of a
    conversation is by turn (null first), then role and digest of the text."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    kept = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said[0].alias("role"), said[1].alias("text"))
    return kept.withColumn("digest", F.sha2("text", 256))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "digest")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, Iterator[tuple]]]:
    """(conv, whether it begins, rows) for each stretch of one conversation in a batch."""
    last: object = _groups  # no conversation
    for batch in batches:
        names = batch.column(0).to_pylist()
        rows = list(zip(*[c.to_pylist() for c in batch.columns[1:]]))
        start = 0
        while start < len(names):
            stop = start + 1
            while stop < len(names) and names[stop] == names[start]:
                stop += 1
            yield names[start], names[start] != last, rows[start:stop]
            last, start = names[start], stop


class _Faults:
    """What is wrong with a conversation, turn by turn."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.initials: list[str] = []
        self.must: list[bool] = []
        self.cut: list[bool] = []
        self.seen: set[tuple[str, str]] = set()
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, digest: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        key = (role, digest)
        fault = "blank" if blank else "duplicate" if key in self.seen else "truncated" if cut else None
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if self.initials and self.initials[-1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.initials.append(role[:1])
        self.must.append(fault in ("blank", "duplicate"))
        self.cut.append(fault == "truncated")

    def found(self) -> tuple:
        if self.distinct:
            self.counts["gaps"] = self.last - self.first + 1 - self.distinct
        self.counts["cost"], audit = aligned(self.initials, self.must, self.cut)
        return (*self.counts.values(), audit)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, open_, out = pa.null(), None, []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * (2 + len(_COUNTS))
        kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv", *_COUNTS, "audit"])

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    name = None
    for conv, begins, rows in _groups(watched()):
        if begins:
            if open_ is not None:
                out.append((name, *open_.found()))
            name, open_ = conv, _Faults()
            if len(out) >= 1000:
                yield batch()
                out = []
        for row in rows:
            open_.add(*row)
    if open_ is not None:
        out.append((name, *open_.found()))
        yield batch()


def audits(turns: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of `turns`
    (see `turns_of`). A turn's first fault counts: blank, repeated, or not ended."""
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = turns.select(
        "conv", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut")
    )
    kind = turns.schema["conv"].dataType.simpleString()
    return _ordered(rows).mapInArrow(_audited, f"conv {kind}, {_FOUND}")


def _edits(audit: str) -> Iterator[tuple[str, str]]:
    """(letter, role initial) of each edit; no role for a deletion."""
    length = len(audit) - audit.count("D")
    place = 0
    for letter in audit:
        if letter == "D":
            yield letter, ""
        else:
            yield letter, "s" if length % 2 and not place else "ua"[(place - length % 2) % 2]
            place += 1


class _Repair:
    """Applies an audit to the turns of a conversation as they come."""

    def __init__(self, audit: str):
        self.edits, self.place = _edits(audit), 0

    def _put(self, letter: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.place += 1
        return self.place, letter, role, text

    def add(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        for letter, initial in self.edits:
            if letter == "I":
                yield self._put(letter, ROLES[initial], "")
                continue
            if letter != "D":
                yield self._put(letter, ROLES[initial] if letter == "R" else role, text)
            return

    def end(self) -> Iterator[tuple[int, str, str, str]]:
        for letter, initial in self.edits:
            yield self._put(letter, ROLES[initial], "")


def _streams(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, in order."""
    head = found.select("conv", F.struct(*_COUNTS, "audit").alias("found"))
    both = head.withColumn("side", F.lit(0)).unionByName(turns.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return _ordered(both, "side").select("conv", "found", "role", "text")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns that stay or come, in order from 1."""
    kind = turns.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, name, out, field = None, None, [], None

        def batch() -> pa.RecordBatch:
            kinds = [field, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "place", "edit", "role", "text"])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal field
            for b in batches:
                field = b.schema.field(0).type
                yield b

        for conv, begins, rows in _groups(watched()):
            if begins:
                out += [(name, *x) for x in open_.end()] if open_ else []
                name, open_, rows = conv, _Repair(rows[0][0]["audit"]), rows[1:]
            for _, role, text in rows:
                out += [(name, *x) for x in open_.add(role, text)]
            if len(out) >= 1000:
                yield batch()
                out = []
        out += [(name, *x) for x in open_.end()] if open_ else []
        if out:
            yield batch()

    return mapped(_streams(turns, found), run, f"conv {kind.simpleString()}, place long, edit string, role string, text string")


def hashed(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The audits with `repaired_sha256`, of the repaired turns as `role:text`, joined by line
    ends; each text is hashed as it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest, head, out, field = None, None, None, [], None

        def feed(rows: Iterator[tuple[int, str, str, str]]) -> None:
            for place, _, role, text in rows:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())

        def close() -> None:
            if open_:
                feed(open_.end())
                out.append((*head, digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            kinds = [field, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", *_COUNTS, "audit", "repaired_sha256"])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal field
            for b in batches:
                field = b.schema.field(0).type
                yield b

        for conv, begins, rows in _groups(watched()):
            if begins:
                close()
                if len(out) >= 1000:
                    yield batch()
                    out = []
                first = rows[0][0]
                head, open_, digest, rows = (conv, *first.values()), _Repair(first["audit"]), hashlib.sha256(), rows[1:]
            for _, role, text in rows:
                feed(open_.add(role, text))
        close()
        if out:
            yield batch()

    kind = turns.schema["conv"].dataType.simpleString()
    return mapped(_streams(turns, found), run, f"conv {kind}, {_FOUND}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with the damage that the contract asks for, by the crc32
    of `conv_id:turn`; a null in that, and a null role or text, is one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), "".join(ENDS), "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("_")).drop("_")


def repair(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `original` (of `rows` if none): the audit and the hash.

    Rows stand by turn, null turns first, and where turns are equal by role and text; rows
    repeated whole are duplicates. A null conversation is one of its own. A null role or text is
    one space, so such a turn is blank or gets another role. A conversation without rows has
    zeros, an empty audit and the hash of nothing; an empty table has no rows. Other columns take
    no part. The rows of one conversation pass through one task, which holds a few bytes of each.
    """
    turns = turns_of(rows)
    found = hashed(turns, audits(turns)).withColumnRenamed("conv", "conv_id")
    if original is None:
        return found
    names = original.select(F.col("conv_id").alias("name")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return names.join(found, F.col("name").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("name").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
