"""Repair of conversation structure by cheapest edits, with an audit of what was done.

A conversation may open with a system turn and then alternates between user and assistant. Rows are kept, given another role or deleted,
and empty rows are inserted, at the least total cost; of equally cheap edits the one whose audit (a letter an edit) is least
in ASCII order counts. The dynamic programme over rows and four states keeps one audit a state as a node of a persistent tree: a
letter on top of another audit, so audits share their beginnings. Nodes know their ancestors at distances 1, 2, 4... and a
rolling hash; where two audits cost the same, the longest common prefix is searched by hash over these ancestors and then verified letter by letter.
Two audits of one state and row count never are prefixes of one another (only inserts could tell them apart, and those cost),
so the lesser one stays the lesser whatever follows.

Conversations are streamed from sorted partitions. One with more rows or bytes than a task should hold is cut: its rows are sorted
over as many parts as needed, each part gives the cost from every state to every other, the sums of what follows are
handed back, and each part finds its audits for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import CRC_TABLE_SQL, crc32_sql, pieces_for

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state an inserted or re-roled row leads to
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 50
WHITE = " \t\n\x0b\x0c\r"


class Audits:
    """Strings as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = (1 << 61) - 1) -> None:
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        above = [node]
        while len(above) <= len(self.up[above[-1]]):
            above.append(self.up[above[-1]][len(above) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + ord(letter)) % self.modulus)
        self.up.append(above)
        return len(self.up) - 1

    def lift(self, node: int, steps: int) -> int:
        while steps:
            low = steps & -steps
            node, steps = self.up[node][low.bit_length() - 1], steps - low
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of equal length are equal, letter by letter down to what they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - depth), self.lift(b, self.depth[b] - depth)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.text(a) < self.text(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # unequal prefixes had one hash


def cheapest(rows: list[tuple[str, int]], begin: int = START, ends: tuple[int, ...] = (0, FAR, FAR, 0), last: bool = True, audits: Audits | None = None) -> tuple[int, int, str]:
    """(cost, state at the end, audit) of the cheapest edits of rows (role initial, fault) from a state; ``ends`` is what each end
    state costs further on. Rows may be inserted before every row, and after all of them if these are the last."""
    audits = audits or Audits()
    best: list[tuple[int, int] | None] = [None] * 4
    best[begin] = (0, 0)

    def offer(to: list, state: int, cost: int, node: int, letter: str) -> None:
        held = to[state]
        if held is None or cost < held[0]:
            to[state] = (cost, audits.add(node, letter))
        elif cost == held[0] and audits.less(made := audits.add(node, letter), held[1]):
            to[state] = (cost, made)

    def insert() -> None:
        for state in (START, SYSTEM):
            if best[state]:
                offer(best, USER, best[state][0] + INSERT, best[state][1], "I")
        user, assistant = best[USER], best[ASSISTANT]
        if user:
            offer(best, ASSISTANT, user[0] + INSERT, user[1], "I")
        if assistant:
            offer(best, USER, assistant[0] + INSERT, assistant[1], "I")

    for initial, fault in rows:
        insert()
        after: list[tuple[int, int] | None] = [None] * 4
        extra = CUT_SHORT if fault == TRUNCATED else 0
        for state, held in enumerate(best):
            if held:
                offer(after, state, held[0] + DELETE, held[1], "D")
                if fault not in (BLANK, DUPLICATE):
                    kept = KEEP.get((state, initial))
                    if kept is not None:
                        offer(after, kept, held[0] + extra, held[1], "K")
                    if kept != NEXT[state]:
                        offer(after, NEXT[state], held[0] + REROLE + extra, held[1], "R")
        best = after
    if last:
        insert()
    cost, _, state, node = min((held[0] + ends[s], k, s, held[1]) for k, s in enumerate(_by_audit(best, audits)) if (held := best[s]))
    return cost, state, audits.text(node)


def _by_audit(best: list[tuple[int, int] | None], audits: Audits) -> list[int]:
    """The reached states in the order of their audits."""
    out: list[int] = []
    for state in (s for s in range(4) if best[s]):
        at = next((i for i, other in enumerate(out) if audits.less(best[state][1], best[other][1])), len(out))
        out.insert(at, state)
    return out


def passage(rows: list[tuple[str, int]]) -> list[int]:
    """The least cost from every state to every state over the rows, with no row inserted at the end."""
    out = []
    for begin in range(4):
        best = [FAR] * 4
        best[begin] = 0
        for initial, fault in rows:
            best[USER] = min(best[USER], min(best[START], best[SYSTEM]) + INSERT)
            best[USER], best[ASSISTANT] = min(best[USER], best[ASSISTANT] + INSERT), min(best[ASSISTANT], best[USER] + INSERT)
            after, extra = [b + DELETE for b in best], CUT_SHORT if fault == TRUNCATED else 0
            if fault not in (BLANK, DUPLICATE):
                for state in range(4):
                    kept = KEEP.get((state, initial))
                    if kept is not None:
                        after[kept] = min(after[kept], best[state] + extra)
                    after[NEXT[state]] = min(after[NEXT[state]], best[state] + REROLE + extra)
            best = after
        out += [min(b, FAR) for b in best]
    return out


class Replay:
    """The repaired rows' ``role:text`` lines, from the audit's letters and the rows, in order."""

    def __init__(self) -> None:
        self.state, self.digest, self.lines = START, hashlib.sha256(), 0

    def feed(self, letters: str, role: str, text: str) -> None:
        """The letters that belong to one row: inserts before it, its own, and at the very end inserts behind it."""
        for letter in letters:
            if letter == "D":
                continue
            self.state = KEEP[self.state, role[:1]] if letter == "K" else NEXT[self.state]
            line = f"{role if letter == 'K' else NAME[self.state]}:{'' if letter == 'I' else text}"
            self.digest.update((("\n" if self.lines else "") + line).encode())
            self.lines += 1


def row_letters(audit: str) -> list[str]:
    """The audit cut into the letters of each row."""
    out, held = [], ""
    for letter in audit:
        held += letter
        if letter != "I":
            out.append(held)
            held = ""
    if held:
        out[-1] += held
    return out


def fault_of(text: str, seen: bool) -> int:
    shown = text.strip(WHITE)
    return BLANK if not shown else DUPLICATE if seen else TRUNCATED if shown[-1] not in ".!?" else FINE


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple[Any, ...]:
    """The result columns of one conversation's rows (turn, role, text), in order."""
    seen: set[tuple[str, str]] = set()
    coded = []
    for _, role, text in rows:
        coded.append((role[:1], fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, _, audit = cheapest(coded) if rows else (0, START, "")
    replay = Replay()
    for letters, (_, role, text) in zip(row_letters(audit), rows):
        replay.feed(letters, role, text)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    count = [sum(f == k for _, f in coded) for k in (BLANK, DUPLICATE, TRUNCATED)]
    return gaps, *count, illegal_pairs([i for i, _ in coded]), cost, audit, replay.digest.hexdigest()


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, dropped, turn, role, text) as one row a conversation, however batches cut it."""
    held, rows, out, open_ = None, [], [], False

    def batch_of(done: list) -> pa.RecordBatch:
        ids = pa.array([c for c, _ in done], kind)
        columns = [pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*[r for _, r in done]))]
        return pa.RecordBatch.from_arrays([ids, *columns], ["conv_id", *RESULT])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, dropped, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ and conv != held:
                out.append((held, repaired(rows)))
                rows = []
            held, open_ = conv, True
            if not dropped:
                rows.append((turn, role, text))
        if out:
            yield batch_of(out)
            out = []
    if open_:
        yield batch_of([(held, repaired(rows))])


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows (conv_id, turn, role, text, dropped, copy) after the contract's damage by crc32 of ``conv_id:turn`` modulo 20; nulls count as one
    space there, and as role and text. A dropped row stays, marked and without text, so that its conversation is known."""
    def shown(name: str):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown(conv_id), F.lit(":"), shown(turn)).cast("binary")) % 20
    words = F.when(code == 0, F.lit("")).when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text))
    return rows.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.when(code == 4, F.lit("user")).otherwise(shown(role)).alias("role"),
        words.alias("text"), (code == 0).alias("dropped"), F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", task_rows: int = 20_000, task_bytes: int = 32_000_000, part_rows: int = 200_000) -> DataFrame:
    """Per conversation of the damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (nulls first), then role and text. Rows with null ids are one conversation. Null roles and texts are one space, so such
    texts are blank and such roles, like empty ones, are never kept. Repeated rows are duplicates of the first. Other columns are not read; an empty table
    gives no rows. Conversations beyond ``task_rows`` rows or ``task_bytes`` bytes take the way over parts of ``part_rows`` rows; only
    the hash of their repaired text is one task's work, row by row, as SHA-256 goes from front to back.
    """
    hurt = damaged(rows, conv_id, turn, role, text)
    size = hurt.where("not dropped").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    scratch = Scratch(rows.sparkSession)
    large = scratch.save(size.where((F.col("n") > task_rows) | (F.col("bytes") > task_bytes)).select(F.col("conv_id").alias("big")))
    kind = hurt.schema["conv_id"].dataType.simpleString()
    hot = large.count()
    small = hurt.join(large, hurt["conv_id"].eqNullSafe(F.col("big")), "left_anti") if hot else hurt
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    streamed = small.select("conv_id", "dropped", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_stream, f"conv_id {kind}, {_TYPES}")
    if not hot:
        return streamed
    rest = hurt.where("not dropped").join(large, hurt["conv_id"].eqNullSafe(F.col("big")), "left_semi")
    return streamed.unionByName(_repair_large(rest, scratch, part_rows).withColumn("conv_id", F.col("conv_id").cast(kind)))


def _coded(rows: pd.DataFrame) -> list[tuple[str, int]]:
    rows = rows.sort_values("pos")
    return list(zip(rows["initial"], rows["fault"].tolist()))


def _part_costs(rows: pd.DataFrame) -> pd.DataFrame:
    coded = _coded(rows)
    initials = [i for i, _ in coded]
    return pd.DataFrame([(rows["conv"].iloc[0], int(rows["part"].iloc[0]), int(rows["pos"].min()), passage(coded), illegal_pairs(initials), initials[0], initials[-1])],
                        columns=["conv", "part", "start", "costs", "illegal", "opens", "closes"])


def _part_ends(parts: pd.DataFrame) -> pd.DataFrame:
    """What every end state of a part costs in the parts after it, from the last part to the first; and the pair over each border."""
    parts, ends, out = parts.sort_values("part"), None, []
    for p in reversed(parts.to_dict("records")):
        if ends is None:  # the last part may insert at its end: one assistant closes a user turn, two rows a lone system turn
            ends = [0, 2 * INSERT, INSERT, 0]
        out.append((p["conv"], p["part"], p["start"], ends, not out))
        costs = list(p["costs"])
        ends = [min(min(costs[4 * a + b] + ends[b] for b in range(4)), FAR) for a in range(4)]
    border = [0, *[illegal_pairs([a, b]) for a, b in zip(parts["closes"], parts["opens"].iloc[1:])]]
    made = pd.DataFrame(out[::-1], columns=["conv", "part", "start", "ends", "last"])
    return made.assign(illegal=(parts["illegal"].to_numpy() + border))


def _part_audits(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """A part's audit and end state from each begin state."""
    e, coded = ends.iloc[0], _coded(rows)
    last = bool(e["last"])
    found = [cheapest(coded, begin, (0, FAR, FAR, 0) if last else tuple(e["ends"]), last) for begin in range(4)]
    return pd.DataFrame([(e["conv"], int(e["part"]), int(e["start"]), int(e["illegal"]), [s for _, s, _ in found], [a for _, _, a in found], int(found[0][0]))],
                        columns=["conv", "part", "start", "illegal", "states", "audits", "cost"])


def _chosen(parts: pd.DataFrame) -> pd.DataFrame:
    """The audits on the way that begins at the start; the first part's cost counts all that follows."""
    parts, state, audits = parts.sort_values("part"), START, []
    for states, found in zip(parts["states"], parts["audits"]):
        audits.append(found[state])
        state = int(states[state])
    cost = [int(parts["cost"].iloc[0])] + [0] * (len(parts) - 1)
    return pd.DataFrame({"conv": parts["conv"], "part": parts["part"], "start": parts["start"], "illegal": parts["illegal"], "audit": audits, "cost": cost})


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, role, text, edit) as one hash a conversation; holds one batch at a time."""
    held, replay, done = None, None, []
    for batch in batches:
        for conv, role, text, edit in zip(*(c.to_pylist() for c in batch.columns)):
            if replay is None or conv != held:
                done += [(held, replay.digest.hexdigest())] if replay else []
                held, replay = conv, Replay()
            replay.feed(edit, role, text)
    done += [(held, replay.digest.hexdigest())] if replay else []
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["conv", "repaired_sha256"])


def _repair_large(rows: DataFrame, scratch: Scratch, part_rows: int) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("string").alias("conv"), "turn", "role", "text").withColumn("number", F.monotonically_increasing_id())
    rows = scratch.save(rows)
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("number")]
    sorted_ = rows.repartitionByRange(pieces_for(rows.count(), part_rows), *order).sortWithinPartitions(*order)
    placed = scratch.save(sorted_.withColumn("pos", F.monotonically_increasing_id()))
    first = placed.groupBy("conv", "role", F.sha2("text", 256).alias("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), FINE).otherwise(TRUNCATED)
    narrow = placed.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "pos", F.shiftrightunsigned("pos", 33).alias("part"))
    repeat = F.col("first").isNull() & (F.col("fault") != BLANK)
    narrow = scratch.save(narrow.join(first, "pos", "left").withColumn("fault", F.when(repeat, DUPLICATE).otherwise(F.col("fault"))).drop("first"))
    costs = narrow.groupBy("conv", "part").applyInPandas(_part_costs, "conv string, part long, start long, costs array<long>, illegal long, opens string, closes string")
    ends = scratch.save(costs.groupBy("conv").applyInPandas(_part_ends, "conv string, part long, start long, ends array<long>, last boolean, illegal long"))
    audits = narrow.groupBy("conv", "part").cogroup(ends.groupBy("conv", "part")).applyInPandas(
        _part_audits, "conv string, part long, start long, illegal long, states array<int>, audits array<string>, cost long")
    chosen = scratch.save(audits.groupBy("conv").applyInPandas(_chosen, "conv string, part long, start long, illegal long, audit string, cost long"))
    edits = chosen.select("start", F.posexplode(F.regexp_extract_all("audit", F.lit(r"I*[DKR](?:I+$)?"), F.lit(0))).alias("at", "edit")).select((F.col("start") + F.col("at")).alias("pos"), "edit")
    hashed = placed.join(edits, "pos").select("conv", "pos", "role", "text", "edit").repartition("conv").sortWithinPartitions("conv", "pos") \
        .select("conv", "role", "text", "edit").mapInArrow(_hashes, "conv string, repaired_sha256 string")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda s: s["audit"]), "")
    whole = chosen.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))

    def faults(kind: int):
        return F.sum((F.col("fault") == kind).cast("long"))

    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    counts = narrow.groupBy("conv").agg(gaps.alias("gaps"), faults(BLANK).alias("blank"), faults(DUPLICATE).alias("duplicate"), faults(TRUNCATED).alias("truncated"))
    same = [F.col("conv").eqNullSafe(F.col(c)) for c in ("c1", "c2")]
    joined = counts.join(whole.withColumnRenamed("conv", "c1"), same[0]).join(hashed.withColumnRenamed("conv", "c2"), same[1])
    return joined.select(F.col("conv").alias("conv_id"), *RESULT)


def repair_sql() -> str:
    """The SQL of ``repair``: one recursive step a row, with the audits as plain strings."""
    def to(state: str, letter: str, cost: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}}}"

    def put_in(state: str) -> str:
        return to(state, "'I'", str(INSERT))

    def taken(state: str, initial: str) -> str:
        return to(state, f"(CASE WHEN x = '{initial}' THEN 'K' ELSE 'R' END)", f"least({REROLE}, CASE WHEN x = '{initial}' THEN 0 ELSE {REROLE} END) + e")

    return rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT k.k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations c JOIN k ON c.conv_id IS NOT DISTINCT FROM k.conv_id),
d AS (SELECT *, {crc32_sql("id")} % 20 AS code FROM r, crc_table),
h AS (SELECT k, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS again, substr(role, 1, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS odd FROM f),
n AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal, list(x ORDER BY i) AS xs, list(fault ORDER BY i) AS fs FROM g GROUP BY k),
w AS (SELECT k, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS s, {{'c': CAST({FAR} AS BIGINT), 'a': ''}} AS y, {{'c': CAST({FAR} AS BIGINT), 'a': ''}} AS u, {{'c': CAST({FAR} AS BIGINT), 'a': ''}} AS a FROM n
  UNION ALL SELECT k, i + 1, {to("s", "'D'", str(DELETE))},
    CASE WHEN ok AND x = 's' THEN list_min([{to("y", "'D'", str(DELETE))}, {to("s", "'K'", "e")}]) ELSE {to("y", "'D'", str(DELETE))} END,
    CASE WHEN ok THEN list_min([{to("u", "'D'", str(DELETE))}, {taken("s", "u")}, {taken("y", "u")}, {taken("a", "u")}]) ELSE {to("u", "'D'", str(DELETE))} END,
    CASE WHEN ok THEN list_min([{to("a", "'D'", str(DELETE))}, {taken("u", "a")}]) ELSE {to("a", "'D'", str(DELETE))} END
  FROM (SELECT k, i, s, y, list_min([u1, {put_in("a0")}]) AS u, list_min([a0, {put_in("u1")}]) AS a, xs[i + 1] AS x, fs[i + 1] NOT IN (1, 2) AS ok, CASE WHEN fs[i + 1] = 3 THEN {CUT_SHORT} ELSE 0 END AS e
    FROM (SELECT w.k, i, s, y, a AS a0, list_min([u, {put_in("s")}, {put_in("y")}]) AS u1, xs, fs FROM w JOIN n USING (k) WHERE i < n))),
z AS (SELECT k, list_min([s, a0, {put_in("u1")}]) AS best FROM (SELECT w.k, s, a AS a0, list_min([u, {put_in("s")}, {put_in("y")}]) AS u1 FROM w JOIN n USING (k) WHERE i = n)),
l AS (SELECT k, generate_subscripts(string_split(best.a, ''), 1) AS j, unnest(string_split(best.a, '')) AS letter FROM z WHERE best.a <> ''),
m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY k ORDER BY j) AS p FROM l),
b AS (SELECT m.*, f.role, f.x, CASE WHEN letter = 'I' THEN '' ELSE text END AS text FROM m LEFT JOIN f ON f.k = m.k AND f.i = m.i WHERE letter <> 'D'),
q AS (SELECT *, p - first_value(CASE WHEN letter = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS place FROM b),
t AS (SELECT k, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM q GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM k LEFT JOIN n USING (k) LEFT JOIN z USING (k) LEFT JOIN t USING (k)"""
