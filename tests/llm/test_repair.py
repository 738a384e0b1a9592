"""Repair of conversations against a brute force over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from auditloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at long, mark string, segment long"


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """All ways, the shortest first by (cost, audit): states are the letters of the repaired roles' pattern."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, mark(r[2], r[3])))
    fault, seen = [], set()
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for r in "ua":
                if r in follows[state]:
                    c, a, t = best(i, r, inserted + 1)
                    ways.append((c + 2, "I" + a, (f"{names[r]}:", *t)))
        if i < len(rows):
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a, t))
            _, _, role, text = rows[i]
            if fault[i] in ("", "truncated"):
                cut = int(fault[i] == "truncated")
                if role[:1] in follows[state]:
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((c + cut, "K" + a, (f"{role}:{text}", *t)))
                for r in "ua":
                    if r in follows[state]:
                        c, a, t = best(i + 1, r, 0)
                        ways.append((c + 2 + cut, "R" + a, (f"{names[r]}:{text}", *t)))
        return min(ways, default=(1 << 40, "", ()))

    for i in range(len(rows), -1, -1):  # from the end: no deep recursion
        for state in follows:
            best(i, state, 0)
    cost, audit, told = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": fault.count("blank"), "duplicate": fault.count("duplicate"), "truncated": fault.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(told).encode()).hexdigest(),
    }


def checked(spark, rows, found):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        assert got[conv] == brute_repair(own), own


def random_rows(seed, conversations=120, longest=9):
    random.seed(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "unused", None]
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?  ", None, "x\ny.", "é."]
    rows = []
    for c in [None, *range(conversations)]:
        for t in range(random.randrange(1, longest)):
            rows.append((c, random.choice([t, t, t, max(0, t - 1), t + 3, None]), random.choice(roles), random.choice(texts) if random.random() < 0.6 else f"text {t}."))
    return rows


@pytest.mark.parametrize("bits", [16, 1])
def test_repair_against_brute_force(spark, monkeypatch, bits):
    """Segments of two rows give what whole conversations give."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = random_rows(5)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    checked(spark, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], repair.repair(df))


def test_damage_then_repair_keeps_every_conversation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Say {t}.") for c in range(150) for t in range(1 + c % 3)] + [(None, None, None, None), (7, 0, "user", "Say 0.")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    damaged = brute_damage(rows)
    found = repair.repair_all(df, repair.damage(df))
    lost = {r[0] for r in rows} - {r[0] for r in damaged}
    assert lost
    for r in found.where(found["conv_id"].isin([c for c in lost if c is not None])).collect():
        assert (r["gaps"], r["blank"], r["cost"], r["audit"]) == (0, 0, 0, "") and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found.count() == len({r[0] for r in rows})
    keep = [c for c in {r[0] for r in damaged} if c is not None]
    checked(spark, [r for r in damaged if r[0] is not None], found.where(found["conv_id"].isin(keep)))
    assert repair.repair_all(df.limit(0), df.limit(0)).count() == 0


def test_a_conversation_of_many_rows_spans_tasks_and_segments(spark, monkeypatch):
    """One conversation holds nearly all rows; equal rows are cut too."""
    monkeypatch.setattr(repair, "SEGMENT_BITS", 8)
    random.seed(9)
    rows = [(1, t, random.choice(["user", "assistant", "assistant", "tool"]), random.choice(["Yes.", "cut", f"T{t}."])) for t in range(700)] + [(1, 3, "user", "same.")] * 300 + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        assert len({r["at"] >> 33 for r in repair.in_order(df).collect() if r["conv_id"] == 1}) > 1
        checked(spark, rows, repair.repair(df))
    finally:
        spark.conf.unset(name)
