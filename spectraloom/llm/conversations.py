"""Conversation structure repair by Wagner-Fischer alignment with target strings.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Its turns are aligned with the grammar's string of
every feasible length by edit distance: a turn is kept, re-roled or deleted, an empty turn is inserted, each at
its cost.  Every string ``(ua)^k`` is an end of the next longer one, so one Wagner-Fischer table filled from the
last turn on holds the alignments with all of them, one column for each length; the strings with a
leading ``s`` add one kept turn in front.  A greedy repair gives the incumbent, whose cost bounds the
table to an Ukkonen band: more than a fifth of its slack can't be inserted, more than half of it
can't be deleted.  All lengths of least cost are traced back together, from the first turn on, by the
ASCII-least edit that any of them allows, which compares their audits letter by letter.

Spark shuffles the rows once, by conversation, sorts them by turn, and each task streams through its
conversations.  A table's rows are kept at every ``sqrt(n)`` turns only and filled in again
for the trace, so a long conversation takes the square root of its length in memory, times the band.  What a task
holds is one conversation's turns, as its digest needs them together.

Edge cases: nulls in role or text are one space (a blank turn), in turn or conversation id too where they
are hashed; rows of equal turn go by role and text; a null conversation id is a conversation; a conversation
all of whose rows are dropped is reported with an empty audit; repeated rows are duplicates; an empty
table gives no rows; other columns are not read; very long texts are only stripped, hashed and compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: costs and grammar.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK_CHARS = " \t\n\x0b\x0c\r"
FAR = 1 << 60
#: Bands up to so many cells are filled cell by cell, wider ones as arrays.
NARROW = 64
#: Alignments of so many different strings of turn codes are remembered by a task.
REMEMBERED = 50_000
OUT_ROWS = 2_000

RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


# ---------------------------------------------------------------- alignment of one string of codes
#
# A turn's code is its role's initial (s, u, a, else x), in capitals if the turn is truncated, or D if it must go.


def incumbent(codes: str) -> int:
    """Cost of a repair found from left to right: whatever doesn't fit is deleted."""
    cost, want, system, said = 0, "u", False, 0
    for code in codes:
        low = code.lower()
        if code == "s" and not said and not system:
            system = True
        elif code == "D" or code != low or (low in ROLES and low != want):
            cost += DELETE
        else:
            cost += 0 if low == want else REROLE
            want, said = "a" if want == "u" else "u", said + 1
    if want == "a":
        cost += INSERT
    elif system and not said:
        cost += 2 * INSERT
    return min(cost, DELETE * len(codes))


class Table:
    """The banded table: ``at(i, j)`` is the least cost of making the last ``j`` symbols of ``...uaua`` of the last ``i`` turns."""

    def __init__(self, codes: str, bound: int):
        self.codes = codes
        slack = bound - DELETE * codes.count("D")
        self.low, self.high = -(slack // DELETE), slack // INSERT
        self.width = self.high - self.low + 1
        self.stride = max(NARROW, math.isqrt(len(codes)))
        self.kept = [1] * (len(codes) + 1)  # turns of the last i that need not go
        self.kept[0] = 0
        for i in range(1, len(codes) + 1):
            self.kept[i] = self.kept[i - 1] + (codes[-i] != "D")
        first = [INSERT * d if d >= 0 else FAR for d in range(self.low, self.high + 1)]
        self.marks = {0: first if self.width <= NARROW else np.array(first)}
        self.blocks: dict[int, list] = {}

    def _next(self, row, i: int):
        """Row ``i`` from row ``i - 1``; cell ``d`` of a row is column ``kept + d``."""
        code, kept = self.codes[-i], self.kept[i]
        if self.width <= NARROW:
            return self._cells(row, code, kept)
        columns = kept + np.arange(self.low, self.high + 1)
        if code == "D":
            out = row + DELETE
        else:
            cut = CUT if code.isupper() else 0
            odd, even = (cut + (code.lower() != c) * REROLE for c in "au")
            out = np.minimum(np.append(row[1:], FAR) + DELETE + cut * 0, row + np.where(columns % 2, odd, even))
        out[columns < 0] = FAR
        if code != "D":
            # column 0 has no symbol to match
            zero = -self.low - kept
            if 0 <= zero < self.width:
                out[zero] = row[zero + 1] + DELETE if zero + 1 < self.width else FAR
        steps = INSERT * np.arange(self.width)
        return np.minimum(np.minimum.accumulate(out - steps) + steps, FAR)

    def _cells(self, row: list, code: str, kept: int) -> list:
        out, left = [], FAR
        if code == "D":
            for cell in row:
                left = min(cell + DELETE, left + INSERT)
                out.append(left)
            return out
        cut = CUT if code.isupper() else 0
        low = code.lower()
        cost = (cut + (low != "u") * REROLE, cut + (low != "a") * REROLE)
        last = self.width - 1
        for at, cell in enumerate(row):
            column = kept + self.low + at
            if column < 0:
                out.append(FAR)
                continue
            best = row[at + 1] + DELETE if at < last else FAR
            if column:
                best = min(best, cell + cost[column % 2])
            left = min(best, left + INSERT)
            out.append(left)
        return out

    def rows(self) -> Iterator[tuple[int, object]]:
        """All rows in order; every ``stride``-th is kept."""
        row = self.marks[0]
        yield 0, row
        for i in range(1, len(self.codes) + 1):
            row = self._next(row, i)
            if i % self.stride == 0:
                self.marks[i] = row
            yield i, row

    def row(self, i: int):
        mark = i - i % self.stride
        if mark not in self.blocks:
            if len(self.blocks) > 1:
                self.blocks.pop(max(self.blocks))  # the trace goes down
            block = [self.marks[mark]]
            for k in range(mark + 1, min(mark + self.stride, len(self.codes) + 1)):
                block.append(self._next(block[-1], k))
            self.blocks[mark] = block
        return self.blocks[mark][i - mark]

    def at(self, i: int, j: int) -> int:
        d = j - self.kept[i]
        return int(self.row(i)[d - self.low]) if self.low <= d <= self.high else FAR

    def ends(self, row, i: int) -> list[tuple[int, int]]:
        """``(cost, column)`` of the whole strings ``(ua)^k`` in row ``i``, k from 1."""
        base = self.kept[i] + self.low
        first = next(at for at in range(3) if (base + at) % 2 == 0)
        first = max(first, 2 - base)
        return [(int(row[at]), base + at) for at in range(first, self.width, 2) if row[at] < FAR]

    def trace(self, i: int, columns: set[int]) -> str:
        """The ASCII-least audit of the last ``i`` turns over columns of one cost."""
        audit = []
        while i:
            code = self.codes[-i]
            cut, low = CUT if code.isupper() else 0, code.lower()
            here = {j: self.at(i, j) for j in columns}
            down = {j for j, v in here.items() if self.at(i - 1, j) + DELETE == v}
            if down:
                audit.append("D")
                i, columns = i - 1, down
                continue
            aside = {j - 1 for j, v in here.items() if j and self.at(i, j - 1) + INSERT == v}
            if aside:
                audit.append("I")
                columns = aside
                continue
            fits = {j for j in here if j and low == "ua"[j % 2]}
            same = {j - 1 for j in fits if self.at(i - 1, j - 1) + cut == here[j]}
            audit.append("K" if same else "R")
            columns = same or {j - 1 for j, v in here.items() if j and j not in fits and self.at(i - 1, j - 1) + cut + REROLE == v}
            i -= 1
        return "".join(audit) + "I" * min(columns)


def align(codes: str) -> tuple[int, str]:
    """Least cost of a repair, and the ASCII-least audit of that cost."""
    n = len(codes)
    if not n:
        return 0, ""
    table = Table(codes, incumbent(codes))
    plain: list[tuple[int, int]] = [(DELETE * n, 0)]
    led: list[tuple[int, int, int]] = []  # cost, turns after the leading one, column
    previous = None
    for i, row in table.rows():
        if i and codes[-i] in "sS":
            own = DELETE * (n - i) + (CUT if codes[-i] == "S" else 0)
            found = table.ends(previous, i - 1)
            if found:
                least = min(found)[0]
                led += [(own + cost, i - 1, j) for cost, j in found if cost == least]
        previous = row
    plain += table.ends(previous, n)
    least = min(min(plain)[0], min(led)[0] if led else FAR)
    audits = []
    # all turns deleted is an audit of its own: its column may lie outside the band
    columns = {j for cost, j in plain if cost == least}
    if 0 in columns:
        audits.append("D" * n)
        columns.discard(0)
    if columns:
        audits.append(table.trace(n, columns))
    led = [(i, j) for cost, i, j in led if cost == least]
    if led:
        # more turns deleted in front come first in ASCII order
        after = min(i for i, _ in led)
        audits.append("D" * (n - after - 1) + "K" + table.trace(after, {j for i, j in led if i == after}))
    return least, min(audits)


# ---------------------------------------------------------------- one conversation


def repaired(turns: list[tuple[str, str]], audit: str) -> Iterator[str]:
    """The repaired turns as ``role:text``."""
    given, place = iter(turns), 0
    for edit in audit:
        role, text = next(given) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K" and place == 0 and role[:1] == "s":
            place = -1  # the leading turn; the alternation starts behind it
        elif edit != "K":
            role = ROLES["ua"[place % 2]]
        place += 1
        yield f"{role}:{text}"


def faults(turns: list[tuple[str, str]]) -> str:
    """The turns' codes; every turn's first fault counts: blank, duplicate (both D and B here), truncated."""
    codes, seen = [], set()
    for turn in turns:
        role, text = turn
        said = text.rstrip(BLANK_CHARS)
        if not said:
            codes.append("B")
        elif turn in seen:
            codes.append("D")
        else:
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append(code if said[-1] in ".!?" else code.upper())
        seen.add(turn)
    return "".join(codes)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int, str]] = {}
    names = [f.split()[0] for f in RESULT.split(", ")]
    schema = pa.schema([(name, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name in names])

    def report(conv_id: int | None, numbers: list[int | None], turns: list[tuple[str, str]]) -> tuple:
        found = faults(turns)
        codes = found.replace("B", "D")
        if codes not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[codes] = align(codes)
        cost, audit = known[codes]
        numbered = [t for t in numbers if t is not None]
        gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
        illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256()
        for k, line in enumerate(repaired(turns, audit)):
            digest.update(b"\n" * (k > 0) + line.encode("utf-8", "surrogatepass"))
        return (
            conv_id, gaps, found.count("B"), found.count("D"), sum(c.isupper() and c not in "BD" for c in found),
            illegal, cost, audit, digest.hexdigest(),
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)

    out, current, numbers, turns, begun = [], None, [], [], False
    for batch in batches:
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv_id != current:
                if begun:
                    out.append(report(current, numbers, turns))
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out = []
                current, numbers, turns, begun = conv_id, [], [], True
            if role is not None:  # a dropped row only names its conversation
                numbers.append(turn)
                turns.append((role, text))
    if begun:
        out.append(report(current, numbers, turns))
        yield batch_of(out)


# ---------------------------------------------------------------- tables


def cleaned(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one space for a null role or text."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """The rows after deterministic damage; a dropped row stays without role and text."""

    def named(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % kinds
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        cleaned(rows)
        .withColumn("kind", kind)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") != 0, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
            F.when(F.col("kind") != 0, text).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``, as ``RESULT`` has it; rows without a role are dropped ones."""
    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_audited, RESULT)
