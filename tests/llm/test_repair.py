"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from millrace.llm.repair import Audits, cheapest, repair

ROLES = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def plain_edits(rows):
    """Cheapest (cost, audit) by trying every sequence of edits up to a bound on inserts; rows are (initial, fault)."""
    best = [None]

    def walk(at, roles, cost, audit):
        if best[0] is not None and cost > best[0][0]:
            return
        if re.fullmatch(r"s?(ua)*u?", roles) is None:
            return
        if at == len(rows) and LEGAL.match(roles):
            best[0] = min(best[0] or (cost, audit), (cost, audit))
        if not audit.endswith("III"):
            for role in "ua":
                walk(at, roles + role, cost + 5, audit + "I")
        if at < len(rows):
            initial, fault = rows[at]
            walk(at + 1, roles, cost + 2, audit + "D")
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                walk(at + 1, roles + (initial or "-"), cost + extra, audit + "K")
                for role in "ua":
                    walk(at + 1, roles + role, cost + 1 + extra, audit + "R")

    walk(0, "", 0, "")
    return best[0]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 1])
def test_cheapest_audit(modulus):
    """Also where the rolling hash hardly tells audits apart."""
    rng = random.Random(modulus)
    for _ in range(150):
        rows = [(rng.choice("suauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(7))]
        cost, _, audit = cheapest(rows, audits=Audits(modulus))
        assert (cost, audit) == plain_edits(rows), rows


def test_audits_compare_as_strings():
    rng = random.Random(2)
    for modulus in ((1 << 61) - 1, 5):
        audits = Audits(modulus)
        nodes = [0]
        for _ in range(600):
            nodes.append(audits.add(rng.choice(nodes[-40:]), rng.choice("DI")))
        for _ in range(800):
            a, b = rng.sample(nodes, 2)
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))
            assert audits.text(audits.lift(a, audits.depth[a] // 3)) == audits.text(a)[: audits.depth[a] - audits.depth[a] // 3]


def plain_repair(rows):
    by_id = {}
    for c, t, role, text in rows:
        kept = by_id.setdefault(c, [])
        show = [" " if v is None else str(v) for v in (c, t)]
        code = zlib.crc32(":".join(show).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 4:
            role = "user"
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [] if code == 0 else [(t, role, text)] * (2 if code == 3 else 1)
    out = []
    for c, kept in by_id.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        coded, seen = [], set()
        for _, role, text in kept:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            coded.append((role[:1], 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit = plain_edits(coded) if len(coded) < 9 else cheapest(coded)[::2]
        lines, at, state = [], 0, ""
        for letter in audit:
            if letter != "D":
                other = "assistant" if state == "u" else "user"
                role = kept[at][1] if letter == "K" else other
                lines.append(f"{role}:{'' if letter == 'I' else kept[at][2]}")
                state = role[:1]
            at += letter != "I"
        turns = {t for t, _, _ in kept if t is not None}
        initials = [i for i, _ in coded]
        out.append((
            c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f == k for _, f in coded) for k in (1, 2, 3)],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "no id."), (7, None, "user", ""), (7, None, "assistant", "x" * 100_000 + "!"), (8, 5, "tool", "?"), (8, 5, "tool", "?"), (9, -4, "", "Empty role.")]
    for c in range(20, 120):
        for t in range(rng.randrange(8)):
            rows.append((c, rng.choice([t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "assistant", "ufo", None]), rng.choice(["Yes.", "No", " \t", "", "Why?  ", "Yes.", None])))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ROLES).withColumn("dropped", F.lit(1)).withColumn("copy", F.lit("x")).repartition(4)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("task_rows", [20_000, 3, 0])
def test_repair(odd, task_rows):
    """In one task a conversation, and cut into parts of a few rows."""
    assert rows_of(repair(odd, task_rows=task_rows, part_rows=20)) == plain_repair(odd_rows())


def test_hot_conversation(spark):
    """A third of all rows in one conversation, in many parts; a third of those are one repeated row."""
    rng = random.Random(4)
    rows = [(1, t // 3 if t % 3 else 5, ("user", "assistant")[t % 2] if t % 3 else "user", f"Turn {t}{rng.choice(['.', '!', ''])}" if t % 3 else "Same.") for t in range(900)]
    rows += [(10 + t // 4, t % 4, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(1800)]
    frame = spark.createDataFrame(rows, ROLES).repartition(5)
    want = plain_repair(rows)
    assert rows_of(repair(frame)) == want and rows_of(repair(frame, task_rows=100, part_rows=90)) == want


def test_given_and_empty(spark):
    frame = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    want = plain_repair([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(repair(frame)) == want
    assert repair(frame.where("conv_id < 0")).count() == 0
