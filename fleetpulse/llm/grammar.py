"""Conversation structure repair: turns aligned to the alternating grammar.

A sound conversation reads ``(s?(ua)+)?`` by the initials of its roles.  For
every feasible length there is exactly one such string, so the cheapest repair
is the best of the alignments to these strings: a Wagner-Fischer table per
length, cut to the band of cells that the best cost found so far (the
incumbent) still allows, lengths nearest to the number of turns first.  The
tables hold costs to the end, so the backtrace runs forward and takes the least
letter among equally cheap edits; the audits of equally cheap lengths are
compared.  Initials of the edits: Delete, Insert, Keep, Rerole.

A conversation may hold a third of all turns, so it is aligned in blocks of
``BLOCK`` turns.  Between two turns a repair is in one of four states: nothing
kept yet, after s, after u, after a.  A block is aligned from each state to the
strings that can follow, which gives the cheapest audit from each state to each
state; inserts go before a turn, so a block's audit ends with its last turn.
``LEVEL`` blocks are put together at a time, up to one row per conversation.
That is exact: an audit fixes its way through the states, and no audit of a
block is the beginning of another one, so least audits of parts make the least
audit.  Texts take no part in this; they meet their audit in a sorted stream,
where the repaired text is digested turn by turn.

Defined cases: a null role or text is one space, and so is a null conv_id or
turn in the number that picks the damage; turns go by number, nulls first, then
by role, then by a hash of role and text; rows without conv_id form one
conversation; repeated rows are repeated turns; an empty role has no initial; no
rows give no rows.  A repaired conversation's audit, a letter a turn, is a value
of one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import per_process, table, text_column
from .turns import JoinedDigest, runs, with_position

#: Turns of a block; blocks that are put together at once.
BLOCK = 16
LEVEL = 64
#: Alignments that a Python process keeps; short conversations are often alike.
KEPT = 1 << 15
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
#: Costs of a turn's blank or duplicate state: it cannot stay.
NEVER = 1 << 60
#: States between turns, and what may come next in each.
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {NOTHING: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
_REACHED = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
#: The grammar's cheapest end in each state.
_TAIL = {NOTHING: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
NAMES = {"u": "user", "a": "assistant"}
_BLANK = " \t\n\x0b\x0c\r"
_SOUND = ("su", "ua", "au")


# --- damage and faults


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage; a repeated row is there twice."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said["text"], "[.!?]", "")).otherwise(said["text"])
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said["role"]).alias("role"), text.alias("text"), kind.alias("kind"), times.alias("times")
    )
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("times").alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """Every row without its text: position, initial of the role, and its first fault if it has one."""
    a = F.xxhash64("role", "text")
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        a.alias("a"),
        F.xxhash64("text", F.lit(BLOCK), "role").alias("b"),
        F.substring(F.rtrim("text", F.lit(_BLANK)), -1, 1).alias("last"),
    )
    at = with_position(light, "conv_id", [F.col("turn"), F.col("role"), F.col("a"), F.col("b")])
    # Copies of a text in one conversation are one row after the combine; each row looks up the first.
    same = F.struct("conv_id", "a", "b").alias("same")
    first = at.groupBy(same).agg(F.min("position").alias("first"))
    at = at.withColumn("same", F.struct("conv_id", "a", "b")).join(first, "same")
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("position") > F.col("first"), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return at.select("conv_id", "turn", "position", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


# --- alignment of a block


def _alignment(turns: str, stay: tuple[int, ...], target: str, incumbent: int) -> tuple[int, str] | None:
    """Cheapest cost and least audit of ``turns`` against ``target``, if the cost is at most ``incumbent``.

    ``stay`` has what a turn costs if it is not deleted.  No insert comes behind
    the last turn.  Cell (i, j) is the cost of turns from i against signs from j;
    a way of cost ``incumbent`` is at most ``incumbent // DELETE`` cells below
    the diagonal and ``incumbent // INSERT`` above it.
    """
    m, n = len(turns), len(target)
    below, above = incumbent // DELETE, incumbent // INSERT
    rows: list[dict[int, int]] = [{} for _ in range(m + 1)]
    rows[m][n] = 0
    for i in range(m - 1, -1, -1):
        after, row, sign = rows[i + 1], rows[i], turns[i]
        for j in range(min(n, i + above), max(0, i - below) - 1, -1):
            best = after.get(j, NEVER) + DELETE
            if j < n:
                best = min(best, row.get(j + 1, NEVER) + INSERT if target[j] != "s" else NEVER)
                change = 0 if target[j] == sign else REROLE if target[j] != "s" else NEVER
                best = min(best, after.get(j + 1, NEVER) + change + stay[i])
            if best <= incumbent:
                row[j] = best
    cost = rows[0].get(0)
    if cost is None:
        return None
    audit, i, j = [], 0, 0
    while i < m:
        left, after = rows[i][j], rows[i + 1]
        if after.get(j, NEVER) + DELETE == left:
            audit.append("D")
            i += 1
            continue
        free = target[j] != "s"
        if free and rows[i].get(j + 1, NEVER) + INSERT == left:
            audit.append("I")
        else:
            audit.append("K" if target[j] == turns[i] else "R")
            i += 1
        j += 1
    return cost, "".join(audit)


def _targets(state: int, most: int) -> Iterator[tuple[int, str]]:
    """The strings that may follow in a state, by the state they reach."""
    yield state, ""
    heads = {NOTHING: ("", "s"), AFTER_S: ("",), AFTER_U: ("",), AFTER_A: ("",)}[state]
    for head in heads:
        for n in range(0 if head else 1, most + 1):
            body = ("ua" * (n // 2 + 1))[:n] if state != AFTER_U else ("au" * (n // 2 + 1))[:n]
            target = head + body
            yield _REACHED[target[-1]], target


def aligned(signs: str, states: Sequence[int] = range(4)) -> list:
    """From each of ``states`` to each state the cheapest (cost, audit) of a block, ``None`` where there is none.

    A turn is two signs: its initial, ``x`` for any other one, and ``.`` if it may
    stay, ``-`` if it is truncated, ``!`` if it must go.
    """
    turns, marks = signs[::2], signs[1::2]
    stay = tuple({".": 0, "-": OPEN, "!": NEVER}[x] for x in marks)
    m = len(turns)
    table = [[None] * 4 for _ in range(4)]
    for state in states:
        found = table[state]
        # With k inserts and the rest kept or deleted nothing needs more than one insert a turn and one more.
        for reached, target in sorted(_targets(state, 2 * m + 1), key=lambda x: (abs(len(x[1]) - m), len(x[1]))):
            known = found[reached]
            limit = known[0] if known else DELETE * m + INSERT * (m + 2)
            gap = len(target) - m
            if (gap * INSERT if gap > 0 else -gap * DELETE) > limit:
                continue
            better = _alignment(turns, stay, target, limit)
            if better is not None and (known is None or better < known):
                found[reached] = better
    return table


def _joined(parts: list) -> list:
    """Tables of neighbouring parts as the table of the whole, from each state to each state."""
    out = []
    for state in range(4):
        # Per state reached: cost, rank of the audit so far among all states, and the way back.
        best: dict[int, tuple[int, int, tuple | None]] = {state: (0, 0, None)}
        for part in parts:
            ways: dict[int, tuple] = {}
            for at, (cost, rank, way) in best.items():
                for reached, step in enumerate(part[at]):
                    if step is not None:
                        new = (cost + step[0], rank, step[1], way)
                        if reached not in ways or new[:3] < ways[reached][:3]:
                            ways[reached] = new
            order = sorted(ways, key=lambda r: ways[r][1:3])
            best = {r: (ways[r][0], k, (ways[r][3], ways[r][2])) for k, r in enumerate(order)}
        row = [None] * 4
        for reached, (cost, _, way) in best.items():
            audit = []
            while way is not None:
                way, piece = way
                audit.append(piece)
            row[reached] = (cost, "".join(reversed(audit)))
        out.append(row)
    return out


_TABLE = "costs array<long>, audits array<string>, first string, last string, illegal long"


def _flat(table) -> tuple[list, list]:
    cells = [c for row in table for c in row]
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _table(costs: list, audits: list) -> list:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [cells[k : k + 4] for k in range(0, 16, 4)]


def block_tables(signs: Column) -> Column:
    """``_TABLE`` of each block of turns; signs behind ``^`` begin a conversation."""

    def row(x: str) -> tuple:
        known = per_process("alignments", dict)
        if x not in known:
            if len(known) >= KEPT:
                known.clear()
            turns = x.removeprefix("^")
            initials = turns[::2]
            illegal = sum(initials[k : k + 2] not in _SOUND for k in range(len(initials) - 1))
            states = range(4) if turns is x else (NOTHING,)
            known[x] = (*_flat(aligned(turns, states)), initials[:1], initials[-1:], illegal)
        return known[x]

    return text_column(_TABLE, row, signs)


def joined_tables(parts: Column) -> Column:
    """``_TABLE`` of an array of neighbouring parts."""
    struct = StructType.fromDDL(_TABLE)
    kind = to_arrow_type(struct)

    def join(arrays: pa.Array) -> pa.Array:
        out = []
        for each in arrays.to_pylist():
            costs, audits = _flat(_joined([_table(p["costs"], p["audits"]) for p in each]))
            seams = sum(a["last"] + b["first"] not in _SOUND for a, b in zip(each, each[1:]))
            illegal = seams + sum(p["illegal"] for p in each)
            out.append({"costs": costs, "audits": audits, "first": each[0]["first"], "last": each[-1]["last"], "illegal": illegal})
        return pa.array(out, kind)

    return F.arrow_udf(join, struct)(parts)


def cheapest(whole: Column) -> Column:
    """Cost and audit of a whole conversation from its table."""

    def row(costs: list, audits: list) -> tuple[int, str]:
        ends = [(costs[r] + INSERT * len(tail), audits[r] + tail) for r, tail in _TAIL.items() if costs[r] is not None]
        return min(ends)

    def choose(tables: pa.Array) -> pa.Array:
        found = [row(t["costs"], t["audits"]) for t in tables.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["cost", "audit"]
        )

    return F.arrow_udf(choose, "cost long, audit string")(whole)


def audits(at: DataFrame) -> DataFrame:
    """conv_id, cost, audit and illegal of every conversation that has turns, from ``placed`` rows."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "!").when(F.col("fault") == "truncated", "-").otherwise(".")
    turn = F.struct("position", F.concat(initial, mark).alias("signs"))
    number = F.floor((F.col("position") - 1) / BLOCK)
    blocks = at.groupBy("conv_id", number.alias("n")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.signs), "").alias("signs")
    )
    begins = F.when(F.col("n") == 0, "^").otherwise("")
    tables = blocks.select("conv_id", "n", block_tables(F.concat(begins, "signs")).alias("t"))
    most = at.agg(F.max("position")).first()[0] or 0
    parts = -(-most // BLOCK)
    while parts > 1:
        grouped = tables.groupBy("conv_id", F.floor(F.col("n") / LEVEL).alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))
        tables = grouped.select("conv_id", "n", joined_tables(F.transform("p", lambda x: x.t)).alias("t"))
        parts = -(-parts // LEVEL)
    return tables.select("conv_id", F.col("t.illegal").alias("illegal"), cheapest(F.col("t")).alias("c")).select(
        "conv_id", "illegal", "c.cost", "c.audit"
    )


# --- the repaired text


class _Repair:
    """Follows an audit along the streamed turns of its conversation."""

    def __init__(self) -> None:
        self.digest, self.audit, self.at, self.state = JoinedDigest(b"\n"), "", 0, NOTHING

    def put(self, initial: str, role: str, text: str) -> None:
        self.state = _REACHED[initial]
        self.digest.add(f"{role}:{text}".encode())

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            sign = _NEXT[self.state]
            self.put(sign, NAMES[sign], "")

    def take(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role[:1], role, text)
        elif edit == "R":
            sign = _NEXT[self.state]
            self.put(sign, NAMES[sign], text)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key and digest of every conversation's repaired text; ``rows`` in the order of ``placed``."""
    key = F.struct("conv_id").alias("key")
    texts = rows.select(
        key, F.lit(1).alias("kind"), "turn", "role", F.xxhash64("role", "text").alias("a"),
        F.xxhash64("text", F.lit(BLOCK), "role").alias("b"), "text",
    )
    first = found.select(key, F.lit(0).alias("kind"), F.col("audit").alias("text"))
    both = texts.unionByName(first, allowMissingColumns=True)
    both = both.select(F.to_json("key").alias("key"), "kind", "turn", "role", "a", "b", "text")

    def step(state: _Repair, row: tuple) -> None:
        _, kind, _, role, _, _, text = row
        if kind == 0:
            state.audit = text
        else:
            state.take(role, text)

    def end(state: _Repair) -> str:
        state.inserts()
        return state.digest.hash.hexdigest()

    return runs(both, "key", ["kind", "turn", "role", "a", "b"], _Repair, step, end, "key string, digest string")


def repaired(turns: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation, after damage."""
    rows = damaged(turns)
    at = placed(rows)
    key = F.to_json(F.struct("conv_id")).alias("key")
    found = audits(at)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = at.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated"))
    )
    every = turns.select("conv_id").distinct().withColumn("key", key)
    known = found.withColumn("key", key).drop("conv_id")
    digests = repaired_digests(rows, found)
    zero = {x: F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (
        every.join(counts.withColumn("key", key).drop("conv_id"), "key", "left")
        .join(known, "key", "left")
        .join(digests, "key", "left")
        .select(
            "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
