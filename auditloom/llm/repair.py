"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order.

A sound conversation is empty, or it is one system turn or none and then pairs of a
user and an assistant turn. A repair keeps, reroles or deletes each row and inserts
empty turns; the cheapest one is sought, of equal ones that whose audit (the edits'
initials in order) comes first.

It is a choice of the rows that are retained, kept or with a new role. What lies
between two retained rows is deleted, at a price that comes from a running sum; which
turns must be inserted between them depends on their two roles alone. So one row
extends the best choice of each last role: four running minima, each with its rank
among the four audits (of two choices with different last roles no audit is a
prefix of the other, so their order never changes), instead of all pairs of rows.

A conversation may hold a third of all rows. Rows are sorted by ranges, so it
spans many tasks, and cut into segments of at most ``SEGMENT`` rows. A segment is
described by its cheapest choice from each last role before it to each last role
in it, 16 costs; these are joined in order, and each segment is then walked
again between the two roles that were chosen. Only the digest of the repaired text
runs over a conversation's rows in one task, as it is one digest: row by row, nothing
is collected. The audit of a conversation is one value.

Order and nulls: rows are ordered by turn, nulls first; rows of one turn by the
SHA-256 digest of their role and text. A null role or text is one space; a null
``conv_id`` is one conversation. A role counts by its first character; one that
begins with neither s, u nor a (or is empty) can be reroled or deleted only. Repeated rows are
rows of their own, all but the first one duplicates. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, small_batches

DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
#: Rows of a conversation that are chosen from at a time: at most 2 to this power.
SEGMENT_BITS = 16
SPACES = " \t\n\x0b\x0c\r"

# The last retained row's role: none yet, system, user, assistant.
ROLES = ("", "s", "u", "a")
NAMES = ("", "system", "user", "assistant")
#: Turns to insert between the last retained row's role and the next one's, and at the end; None: it cannot follow.
BETWEEN = ((None, 0, 0, 1), (None, None, 0, 1), (None, None, 1, 0), (None, None, 0, 1))
TAIL = (0, 2, 1, 0)
NEVER = 1 << 60


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in by the crc32 of ``conv_id:turn``: rows are dropped, emptied, cut off, repeated or given the role user."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (
        turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))).alias("copy"))
        .drop("copy")
    )


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mark and at: ``at`` numbers all rows by conversation, turn and mark. Equal rows are told apart by where they were read, so ranges can cut them."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    mark = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    keys = ["conv_id", "turn", "mark", "place"]
    placed = rows.withColumn("mark", mark).withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("place")


def _code(duplicate: Column) -> Column:
    """A letter for what the choice needs of a row: its role (of s, u, a, other) and first fault (of none, blank, duplicate, truncated)."""
    said = F.rtrim("text", F.lit(SPACES))
    fault = F.when(said == "", 1).when(duplicate, 2).when(~F.substring(said, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    return F.char(F.lit(65) + 4 * F.when(F.col("role") == "", 3).otherwise(initial) + fault)


@lru_cache(16)
def _moves(letter: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each last role after a row: (last role before it, cost, edits)."""
    own, fault = divmod(ord(letter) - 65, 4)
    into: list[list[tuple[int, int, str]]] = [[(r, DELETE, "D")] for r in range(4)]
    if fault in (0, 3):
        cut = CUT_OFF if fault == 3 else 0
        kept = [(own + 1, "K", cut)] if own < 3 else []
        for r, edit, cost in [*kept, (2, "R", REROLE + cut), (3, "R", REROLE + cut)]:
            into[r] += [(p, cost + INSERT * n, "I" * n + edit) for p in range(4) if (n := BETWEEN[p][r]) is not None]
    return tuple(tuple(x) for x in into)


def choose(codes: str, before: int) -> tuple[list[int], list[int], list[tuple]]:
    """From last role ``before`` over all rows: cost and rank of the best choice for each last role, and each row's steps (last role before it, edits)."""
    cost, rank, steps = [NEVER] * 4, [0] * 4, []
    cost[before] = 0
    for letter in codes:
        best = [min((cost[p] + c, rank[p], edits, p) for p, c, edits in moves) for moves in _moves(letter)]
        steps.append(tuple((x[3], x[2]) for x in best))
        cost = [min(x[0], NEVER) for x in best]
        order = sorted(range(4), key=lambda r: best[r][1:3])
        rank = [order.index(r) for r in range(4)]
    return cost, rank, steps


@lru_cache(1 << 14)
def walk(codes: str, before: int, after: int) -> str:
    """The audit of the best choice from one last role to another."""
    edits = []
    for step in reversed(choose(codes, before)[2]):
        after, edit = step[after]
        edits.append(edit)
    return "".join(reversed(edits))


@lru_cache(1 << 14)
def describe(codes: str) -> tuple[list[int], list[int], int, int, int, int]:
    """Costs and ranks from each last role to each, rows with each fault, and neighbours that must not follow each other."""
    ways = [choose(codes, p)[:2] for p in range(4)]
    faults, roles = [(ord(x) - 65) % 4 for x in codes], [(ord(x) - 65) // 4 for x in codes]
    return sum((x[0] for x in ways), []), sum((x[1] for x in ways), []), *(faults.count(k) for k in (1, 2, 3)), sum(map(_illegal, roles, roles[1:]))


def _illegal(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def segments(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, segment and codes: a letter for each row, in order."""
    same = ["conv_id", "role", "mark"]
    repeats = scratch.table(ordered.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"_{c}") for c in same), "first"), "repeats")
    meets = [ordered[c].eqNullSafe(repeats[f"_{c}"]) for c in same]
    coded = ordered.join(repeats, meets[0] & meets[1] & meets[2], "left").select("conv_id", "at", _code(F.coalesce(F.col("at") > F.col("first"), F.lit(False))).alias("code"))
    rows = F.sort_array(F.collect_list(F.struct("at", "code")))
    return coded.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(F.array_join(F.transform(rows, lambda x: x["code"]), "").alias("codes"))


_FACTS = "blank long, duplicate long, truncated long, illegal long"


def _described(pieces: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        codes = batch.column("codes").to_pylist()
        costs, ranks, *facts = zip(*map(describe, codes), strict=True)
        yield {"conv_id": batch.column("conv_id"), "segment": batch.column("segment"), "costs": costs, "ranks": ranks, "ends": [x[0] + x[-1] for x in codes]} | dict(zip(("blank", "duplicate", "truncated", "illegal"), facts, strict=True))

    return map_arrow(pieces, work, f"conv_id long, segment long, costs array<long>, ranks array<long>, ends string, {_FACTS}")


class _Joined:
    """Segments of one conversation, joined in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.cost, self.rank, self.numbers, self.steps = conv_id, [0, NEVER, NEVER, NEVER], [0] * 4, [], []
        self.facts, self.last = [0] * 4, None

    def add(self, row: dict) -> None:
        best = [min((self.cost[p] + row["costs"][4 * p + r], self.rank[p], row["ranks"][4 * p + r], p) for p in range(4)) for r in range(4)]
        self.steps.append(bytes(x[3] for x in best))
        self.numbers.append(row["segment"])
        self.cost = [min(x[0], NEVER) for x in best]
        order = sorted(range(4), key=lambda r: best[r][1:3])
        self.rank = [order.index(r) for r in range(4)]
        first, last = ((ord(x) - 65) // 4 for x in row["ends"])
        self.facts = [a + row[k] for a, k in zip(self.facts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        self.facts[3] += self.last is not None and _illegal(self.last, first)
        self.last = last

    def rows(self) -> Iterator[tuple]:
        """conv_id, segment, last role before it and in it, turns to insert behind it, cost and facts (those of the conversation, with its last segment)."""
        total, _, after = min((self.cost[r] + INSERT * TAIL[r], self.rank[r], r) for r in range(4))
        tail, facts = TAIL[after], (total, *self.facts)
        for number, step in zip(reversed(self.numbers), reversed(self.steps), strict=True):
            before = step[after]
            yield self.conv_id, number, before, after, tail, *facts
            after, tail, facts = before, 0, (None,) * 5


def _joined(described: DataFrame) -> DataFrame:
    fields = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("tail", pa.int32()), *((k, pa.int64()) for k in ("cost", "blank", "duplicate", "truncated", "illegal"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Joined | None = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
            out.clear()
            return done

        def ended() -> Iterator[pa.RecordBatch]:
            for row in now.rows() if now else ():
                out.append(row)
                if len(out) >= 8192:
                    yield flush()

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    yield from ended()
                    now = _Joined(row["conv_id"])
                now.add(row)
        yield from ended()
        if out:
            yield flush()

    small_batches(described.sparkSession)
    sorted_rows = described.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return sorted_rows.mapInArrow(run, f"conv_id long, segment long, before int, after int, tail int, cost long, {_FACTS}")


class _Repaired:
    """One conversation's repaired text, digested row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audits, self.audit, self.at = conv_id, [], "", 0
        self.digest, self.role, self.empty, self.facts, self.tail = hashlib.sha256(), 0, True, (0,) * 5, 0

    def _say(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _next(self) -> int:
        """The role of a row that is inserted or reroled here."""
        return 3 if self.role == 2 else 2

    def segment(self, row: dict) -> None:
        self.audits.append(row["audit"])
        self.audit, self.at, self.tail = row["audit"], 0, row["tail"]
        if row["cost"] is not None:
            self.facts = tuple(row[k] for k in ("cost", "blank", "duplicate", "truncated", "illegal"))

    def insert(self) -> None:
        self.role = self._next()
        self._say(NAMES[self.role], "")

    def text(self, row: dict) -> None:
        while self.audit[self.at] == "I":
            self.insert()
            self.at += 1
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.role = self._next()
            self._say(NAMES[self.role], row["text"])
        elif edit == "K":
            self.role = ROLES.index(row["role"][0])
            self._say(row["role"], row["text"])

    def row(self) -> tuple:
        for _ in range(self.tail):
            self.insert()
        return self.conv_id, *self.facts, "".join(self.audits) + "I" * self.tail, self.digest.hexdigest()


def _repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation, from its segments' audits and its rows, sorted."""
    fields = pa.schema([("conv_id", pa.int64()), *((k, pa.int64()) for k in ("cost", "blank", "duplicate", "truncated", "illegal")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repaired | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    out += [now.row()] if now else []
                    now = _Repaired(row["conv_id"])
                now.text(row) if row["audit"] is None else now.segment(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.row(), fields, strict=True)], schema=fields)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"conv_id long, cost long, {_FACTS}, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation that has rows."""
    scratch = Scratch(turns.sparkSession, "repair")
    ordered = scratch.table(in_order(turns), "ordered")
    pieces = scratch.table(segments(ordered, scratch), "segments")
    chosen = scratch.table(_joined(_described(pieces)), "chosen").withColumnsRenamed({"conv_id": "_conv", "segment": "_segment"})
    both = pieces.join(chosen, pieces["conv_id"].eqNullSafe(chosen["_conv"]) & (pieces["segment"] == chosen["_segment"])).drop("_conv", "_segment")
    facts = ("tail", "cost", "blank", "duplicate", "truncated", "illegal")

    def audits(batch: pa.RecordBatch) -> Iterator[dict]:
        ways = zip(*(batch.column(c).to_pylist() for c in ("codes", "before", "after")), strict=True)
        yield {c: batch.column(c) for c in ("conv_id", "segment", *facts)} | {"audit": [walk(*x) for x in ways]}

    heads = map_arrow(both, audits, f"conv_id long, segment long, tail int, cost long, {_FACTS}, audit string")
    heads = heads.select("conv_id", F.shiftleft("segment", SEGMENT_BITS).alias("at"), "audit", *facts, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = heads.unionByName(ordered.select("conv_id", "at", "role", "text"), allowMissingColumns=True)
    done = _repaired(rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("audit").isNull()))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    turned = ordered.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("_conv")).agg(gaps)
    return done.join(turned, done["conv_id"].eqNullSafe(turned["_conv"])).select("conv_id", "gaps", *facts[2:], "cost", "audit", "repaired_sha256")


def repair_all(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """``repair`` of ``damaged``, with a row for each conversation of ``turns``; those that have lost all rows need no repair."""
    asked = turns.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    found = repair(damaged)
    rows = asked.join(found, asked["_conv"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("_conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
