"""Repair of conversation structure: the cheapest edits that make the roles ``(system? (user assistant)+)?``.

Each row is kept (0), given the expected role (1) or deleted (2); blank and repeated rows must be deleted, a truncated row
that stays costs 5 more, and an empty turn of the expected role may be inserted anywhere (5). Of all cheapest edit lists
the one whose audit (the initials of its edits in order) comes first is taken.

The edits are found by depth-first branch and bound with an explicit stack. A suffix bound comes from a relaxation with two
states in which system rows are free; the incumbent is a (cost, audit); a table per row and state drops dominated prefixes.

A conversation may be of any length. Rows without their texts are ranged by conversation and turn. A task cuts its rows
into short stretches, searches each one for every pair of states at its ends, and joins the results pairwise, so that a long
conversation leaves one small matrix per task. Only these matrices of one conversation (one per task) meet. The texts are
shuffled once, to be read in order next to their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lethe.llm.common import SPACE, stored

REROLE, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
#: Rows searched at a time; longer conversations are joined from stretches of this length.
STRETCH = 32
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
CLOSED = frozenset((START, ASSISTANT))
EXPECTED = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
AFTER = {"u": USER, "a": ASSISTANT}
#: What is still to be inserted where the rows end.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAMES = {"u": "user", "a": "assistant"}
PART_BITS = 33

Found = dict[tuple[int, int], tuple[int, str]]


def edits(row: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of what may happen to a row, dearest first.

    A row is the initial of its role (x: no known role), a capital if it is truncated, or d if it must be deleted.
    """
    yield "D", DELETE, state
    role, extra = row.lower(), TRUNCATED if row.isupper() else 0
    if role == "d":
        return
    expected = EXPECTED[state]
    if role == expected:
        yield "K", extra, AFTER[role]
        return
    yield "R", REROLE + extra, AFTER[expected]
    if role == "s" and state == START:
        yield "K", extra, SYSTEM


def bounds(rows: str, goals: frozenset[int], tail: bool) -> list[dict[bool, float]]:
    """Per row a lower bound of what the rest costs, by whether an assistant turn is due.

    The relaxation forgets whether a system turn is still allowed: it may be kept wherever a user turn is due.
    """
    ends = {state == USER for state in goals}
    low = {due: 0.0 if due in ends else float("inf") for due in (False, True)}
    if tail:
        low = {due: min(low[due], low[not due] + INSERT) for due in low}
    found = [low]
    for row in reversed(rows):
        low, role = found[-1], row.lower()
        extra = TRUNCATED if row.isupper() else 0
        here = {}
        for due in (False, True):
            here[due] = DELETE + low[due]
            if role != "d":
                change = 0 if role == ("a" if due else "u") else REROLE
                here[due] = min(here[due], change + extra + low[not due])
            if role == "s" and not due:
                here[due] = min(here[due], extra + low[due])
        found.append({due: min(here[due], here[not due] + INSERT) for due in here})
    return found[::-1]


def search(rows: str, entry: int, goals: frozenset[int], tail: bool) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``entry`` over all rows to one of ``goals``; None if there is none.

    Turns are inserted in front of rows, and behind the last one only with ``tail``.
    """
    low = bounds(rows, goals, tail)
    best: tuple[int, str] | None = None
    seen: list[dict[int, tuple[int, str]]] = [{} for _ in range(len(rows) + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + low[at][state == USER]
        if best is None:
            if least == float("inf"):
                continue
        elif least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        # Two prefixes of one cost that end here never begin one another, so the lesser one stays the lesser.
        if state in seen[at] and seen[at][state] <= (cost, audit):
            continue
        seen[at][state] = (cost, audit)
        if at == len(rows):
            if state in goals and (best is None or (cost, audit) < best):
                best = (cost, audit)
            if not tail:
                continue
        stack.append((at, AFTER[EXPECTED[state]], cost + INSERT, audit + "I"))
        if at < len(rows):
            for initial, price, then in edits(rows[at], state):
                stack.append((at + 1, then, cost + price, audit + initial))
    return best


@lru_cache(maxsize=20_000)
def closed(rows: str) -> tuple[int, str]:
    """The cheapest repair of a whole conversation."""
    return search(rows, START, CLOSED, True)


@lru_cache(maxsize=20_000)
def _stretch(rows: str) -> Found:
    found = {(entry, leave): search(rows, entry, frozenset((leave,)), False) for entry in STATES for leave in STATES}
    return {ends: best for ends, best in found.items() if best is not None}


def joined(left: Found, right: Found) -> Found:
    """The cheapest ways over two stretches that follow one another."""
    found: Found = {}
    for (entry, middle), (cost, audit) in left.items():
        for (start, leave), (more, then) in right.items():
            if start == middle:
                way = (cost + more, audit + then)
                if (entry, leave) not in found or way < found[entry, leave]:
                    found[entry, leave] = way
    return found


class Ways:
    """Cheapest ways over rows that come one by one, for every pair of states at the ends."""

    def __init__(self, stretch: int = STRETCH) -> None:
        self._size, self.rows, self._done = stretch, "", []

    def add(self, rows: str) -> None:
        self.rows += rows
        while len(self.rows) > self._size:
            self._push(0, _stretch(self.rows[: self._size]))
            self.rows = self.rows[self._size :]

    def _push(self, level: int, ways: Found) -> None:
        # Equal levels are joined at once, so that long audits are copied seldom.
        while self._done and self._done[-1][0] == level:
            ways, level = joined(self._done.pop()[1], ways), level + 1
        self._done.append((level, ways))

    @property
    def short(self) -> bool:
        return not self._done

    def result(self) -> Found:
        ways = _stretch(self.rows)
        for _, before in reversed(self._done):
            ways = joined(before, ways)
        return ways


class Tally:
    """What is counted along the rows of a conversation; ``then`` adds the rows that follow."""

    FIELDS = ("low", "high", "turns", "first_turn", "last_turn", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal")
    SCHEMA = "low long, high long, turns long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"

    def __init__(self, *values) -> None:
        for name, value in zip(self.FIELDS, values):
            setattr(self, name, value)

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def then(self, other: Tally) -> None:
        if other.low is not None:
            self.low = other.low if self.low is None else self.low
            self.high = other.high
            self.turns += other.turns - (self.last_turn is not None and self.last_turn == other.first_turn)
        self.illegal += other.illegal + (self.last_role + other.first_role not in ("su", "ua", "au"))
        self.last_turn, self.last_role = other.last_turn, other.last_role
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _row(turn: int | None, role: str, fault: str, known: bool, copies: int) -> tuple[Tally, str]:
    """Some copies of one row: what they count and how the search sees them."""
    blank = copies if fault == "blank" else 0
    repeated = 0 if blank else copies - (not known)
    cut = 1 if fault == "truncated" and not known else 0
    letter = role if role in ("s", "u", "a") else "x"
    rows = "d" * copies if blank or known else (letter.upper() if cut else letter) + "d" * (copies - 1)
    turns = 0 if turn is None else 1
    return Tally(turn, turn, turns, turn, turn, role, role, blank, repeated, cut, copies - 1), rows


def _faults(rows: DataFrame, key: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Rows with a digest of role and text and with the faults that a row shows by itself."""
    said, by = F.col("text"), F.col("role")
    plain = rows.select(
        rows[key].alias("key"),
        rows[turn].cast("long").alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"),
        (rows[copies].cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    last = F.substring(F.rtrim(said, F.lit(" \t\n\x0b\f\r")), -1, 1)
    fault = F.when(~said.rlike(f"[^{SPACE[1:-1]}]"), "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    mark = F.unhex(F.md5(F.concat_ws(":", F.char_length(by).cast("string"), by, said).cast("binary")))
    return plain.withColumns({"mark": mark, "fault": fault, "initial": F.substring(by, 1, 1)})


SOLVED = f"at long, turn long, mark binary, whole boolean, ways array<struct<entry:int,leave:int,cost:long,audit:string,place:int>>, {Tally.SCHEMA}"


def _solve(numbered: DataFrame, key_type: T.DataType, stretch: int) -> DataFrame:
    """One row per conversation and task with its tallies and ways; ``whole`` where no other task has rows of it."""
    schema = T.StructType([T.StructField("key", key_type), *T.StructType.fromDDL(SOLVED).fields])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        part, first, group = None, False, None
        out: list[list] = []

        def close(last: bool) -> None:
            if group is None:
                return
            key, at, turn, mark, tally, ways, edge = group
            whole = not (edge or last)
            if whole and ways.short:
                cost, audit = closed(ways.rows)
                found = [{"entry": START, "leave": ASSISTANT, "cost": cost, "audit": audit, "place": 0}]
            else:
                result = ways.result()
                if whole:
                    result = {ends: (c + INSERT * len(TAIL[ends[1]]), a + TAIL[ends[1]]) for ends, (c, a) in result.items() if ends[0] == START}
                    result = {min(result, key=result.get): min(result.values())}
                order = {a: i for i, a in enumerate(sorted({a for _, a in result.values()}))}
                found = [{"entry": e, "leave": x, "cost": c, "audit": a, "place": order[a]} for (e, x), (c, a) in result.items()]
            out.append([key, at, turn, mark, whole, found, *tally.values()])

        def table() -> pa.RecordBatch:
            columns = zip(*out) if out else [[] for _ in target]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)

        known = True
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("part", "at", "key", "turn", "mark", "initial", "fault", "copies")]
            for here, at, key, turn, mark, initial, fault, copies in zip(*columns):
                if copies is None:
                    # The row that follows is the first one of its role and text.
                    known = False
                    continue
                tally, rows = _row(turn, initial, fault, known, copies)
                known = True
                if group is None or here != part or key != group[0]:
                    close(last=here != part)
                    edge = here != part
                    part = here
                    group = (key, at, turn, mark, tally, Ways(stretch), edge)
                else:
                    group[4].then(tally)
                group[5].add(rows)
            if len(out) >= 2000:
                yield table()
                out.clear()
        close(last=True)
        yield table()

    return numbered.mapInArrow(solve, schema)


LINKED = f"at long, leave int, entry int, tail string, total long, {Tally.SCHEMA}"


def _link(solved: DataFrame) -> DataFrame:
    """Which way each stretch of a conversation over several tasks takes, and the tallies of all on the first one."""
    slim = F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["leave"].alias("leave"), w["cost"].alias("cost"), w["place"].alias("place")))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows.sort_values("at").to_dict("records")
        rest = [{state: INSERT * len(tail) for state, tail in TAIL.items()}]
        for part in reversed(parts):
            after: dict[int, float] = {}
            for way in part["ways"]:
                total = way["cost"] + rest[-1].get(way["leave"], float("inf"))
                after[way["entry"]] = min(total, after.get(way["entry"], float("inf")))
            rest.append(after)
        rest.reverse()
        state, out, total = START, [], None
        for i, part in enumerate(parts):
            ways = [w for w in part["ways"] if w["entry"] == state]
            way = min(ways, key=lambda w: (w["cost"] + rest[i + 1].get(w["leave"], float("inf")), w["place"]))
            tally = Tally(*[None if isinstance(v, float) and v != v else v for v in (part[n] for n in Tally.FIELDS)])
            for name in ("low", "high", "first_turn", "last_turn"):
                value = getattr(tally, name)
                setattr(tally, name, None if value is None else int(value))
            if total is None:
                total = tally
            else:
                total.then(tally)
            out.append([part["at"], way["leave"], state, "", None])
            state = way["leave"]
        out[-1][3], out[0][4] = TAIL[state], rest[0][START]
        return pd.DataFrame([[*row, *(total.values() if i == 0 else [None] * len(Tally.FIELDS))] for i, row in enumerate(out)], columns=names).astype({n: "Int64" for n in whole_numbers})

    names = T.StructType.fromDDL(LINKED).names
    whole_numbers = [f.name for f in T.StructType.fromDDL(LINKED) if f.name not in ("leave", "entry", "tail", "first_role", "last_role")]
    return solved.select("key", "at", slim.alias("ways"), *Tally.FIELDS).groupBy("key").applyInPandas(link, LINKED)


def _audits(faults: DataFrame, stretch: int) -> DataFrame:
    """(key, turn, mark, audit, cost, tallies): the edits from this row on; cost and tallies only with the first ones."""
    rows = faults.where(F.col("copies") > 0)
    same = ["key", "turn", "mark", "initial", "fault"]
    merged = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    order = ["key", "turn", "mark"]
    ranged = merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    numbered = stored(ranged.withColumn("part", F.shiftright("at", PART_BITS)), "turns")
    first = numbered.groupBy("key", "mark").agg(F.min("at").alias("at"))
    # A row without copies in front of a row says that its role and text are new.
    heads = first.select(F.shiftright("at", PART_BITS).alias("part"), "at", *[F.lit(None).cast(numbered.schema[c].dataType).alias(c) for c in [*same, "copies"]])
    stream = numbered.select("part", "at", *same, "copies").unionByName(heads)
    stream = stream.repartition("part").sortWithinPartitions("part", "at", F.col("copies").asc_nulls_first())
    solved = stored(_solve(stream, numbered.schema["key"].dataType, stretch), "solved")
    counts = [c for c in Tally.FIELDS if c not in ("first_role", "last_role")]
    whole = solved.where("whole").select("key", "turn", "mark", F.col("ways")[0]["audit"].alias("audit"), F.col("ways")[0]["cost"].alias("cost"), *counts)
    edge = solved.where(~F.col("whole")).drop(*Tally.FIELDS)
    linked = _link(solved.where(~F.col("whole"))).withColumnRenamed("at", "linked")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["leave"] == F.col("leave")))[0]
    spread = edge.join(linked, edge["at"] == linked["linked"])
    spread = spread.select("key", edge["turn"], "mark", F.concat(way["audit"], F.col("tail")).alias("audit"), F.col("total").alias("cost"), *counts)
    return whole.unionByName(spread)


def _in_order(rows: DataFrame, key: str, turn: str, role: str, text: str, copies: str | None, stretch: int) -> DataFrame:
    """Rows in order behind their edits, one conversation after the other; rows without copies only name theirs."""
    faults = _faults(rows, key, turn, role, text, copies)
    audits = _audits(faults, stretch).withColumn("kind", F.lit(0))
    there = F.col("copies") > 0
    spoken = faults.select("key", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "mark", "role", "text")], "copies", F.when(there, 1).otherwise(2).alias("kind"))
    both = spoken.unionByName(audits, allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "turn", "mark", "kind")


class _Walk:
    """Follows the rows of one conversation with their edits; ``say`` gets each turn that stays."""

    def __init__(self, say) -> None:
        self._say, self.state, self.audits, self.at, self.cost, self.tally = say, START, [], 0, 0, None

    def edits(self, audit: str, cost: int | None, tally: list) -> None:
        self.audits.append(audit)
        self.at = 0
        if cost is not None:
            self.cost, self.tally = cost, tally

    def _inserted(self) -> None:
        while self.at < len(self.audits[-1]) and self.audits[-1][self.at] == "I":
            self._turn("I", NAMES[EXPECTED[self.state]], "")
            self.at += 1

    def _turn(self, edit: str, role: str, text: str) -> None:
        self._say(edit, role, text)
        self.state = AFTER.get(role[0], SYSTEM)

    def rows(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._inserted()
            edit = self.audits[-1][self.at]
            self.at += 1
            if edit != "D":
                self._turn(edit, NAMES[EXPECTED[self.state]] if edit == "R" else role, text)

    def end(self) -> None:
        if self.audits:
            self._inserted()


COUNTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")


def _walked(batches: Iterator[pa.RecordBatch], begin, close) -> Iterator:
    """Calls ``begin(key)`` for a new walk and ``close(key, walk)`` at its end; yields after each batch and at the end."""
    key, walk = None, None
    names = ("key", "kind", "role", "text", "copies", "audit", "cost", *COUNTS)
    for batch in batches:
        for name, kind, role, text, copies, audit, cost, *tally in zip(*[batch.column(n).to_pylist() for n in names]):
            if walk is None or name != key:
                if walk is not None:
                    walk.end()
                    close(key, walk)
                key, walk = name, begin(name)
            if kind == 0:
                walk.edits(audit, cost, tally)
            elif kind == 1:
                walk.rows(role, text, copies)
        yield
    if walk is not None:
        walk.end()
        close(key, walk)
    yield


def repaired(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """The turns of the repaired conversations: (key, place, edit, role, text), ``place`` counting from 0.

    Rows are taken by turn, null first, then by a digest of role and text, so that equal rows are neighbors; which of two
    equal rows comes first makes no difference. ``copies`` names a column that says how often a row occurs (0: it was
    lost). Null roles and texts are one space. A null key is a conversation like any other. Other columns are ignored.
    """
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL("place long, edit string, role string, text string").fields])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out = to_arrow_schema(schema), []

        def begin(name):
            places = iter(range(1 << 62))
            return _Walk(lambda edit, by, said: out.append((name, next(places), edit, by, said)))

        for _ in _walked(batches, begin, lambda name, walk: None):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), target)], schema=target)
                out.clear()

    return _in_order(rows, key, turn, role, text, copies, stretch).mapInArrow(turns, schema)


def summaries(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
    stretch: int = STRETCH,
) -> DataFrame:
    """One row per conversation: (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Counts are of the rows as they are, each by its first fault; the hash is that of ``role:text`` of the turns of
    repaired(), joined by line feeds, taken while they pass. A conversation that lost all its rows (``copies`` 0) has zeros,
    an empty audit and the hash of an empty text. An empty table has no rows. Other cases: see repaired().
    """
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(fields).fields])

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, out, hashes = to_arrow_schema(schema), [], {}

        def begin(name):
            hashes.clear()
            sha = hashes[name] = hashlib.sha256()
            turns = iter(range(1 << 62))
            return _Walk(lambda edit, by, said: sha.update((("\n" if next(turns) else "") + f"{by}:{said}").encode()))

        def close(name, walk):
            low, high, turns, blank, duplicate, truncated, illegal = walk.tally or [None, None, 0, 0, 0, 0, 0]
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((name, gaps, blank, duplicate, truncated, illegal, walk.cost, "".join(walk.audits), hashes[name].hexdigest()))

        for _ in _walked(batches, begin, close):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), target)], schema=target)
                out.clear()

    return _in_order(rows, key, turn, role, text, copies, stretch).mapInArrow(summarize, schema)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (key, turn, role, text, copies) as faulty logs have them: a checksum of key and turn picks one in twenty to be
    lost (0 copies), emptied, stripped of sentence ends, repeated (2 copies) or given to the user. Nulls are one space."""

    def spaced(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", spaced(rows[key]), spaced(rows[turn])).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(rows[text]), "[.!?]", "")).otherwise(spaced(rows[text]))
    by = F.when(kind == 4, "user").otherwise(spaced(rows[role]))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(rows[key], rows[turn], by.alias(role), said.alias(text), copies.cast("long").alias("copies"))
