"""Conversation repair against all edit lists, counted one by one."""

import hashlib
import random
from functools import lru_cache

import pytest

from lethe.llm import repair

ROLES = ("system", "user", "assistant", "tool", None, "")
TEXTS = ("Yes.", "No!  ", "cut off", "", " \t\n", None, "Why?\n", "Yes.", "a.b")


def faults(rows):
    """Rows in order with their first fault."""
    spoken = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
    spoken.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))
    seen, out = set(), []
    for turn, role, text in spoken:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """The least (cost, audit) over every edit list, by recursion over rows and the roles that may follow."""

    @lru_cache(None)
    def best(at, state, inserted):
        found = []
        if at == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            _, role, _, fault = rows[at]
            found.append(plus(2, "D", best(at + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for new, price, letter in ((role[:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
                    if new == "s" and state == "" or new == "u" and state != "u" or new == "a" and state == "u":
                        found.append(plus(price + extra, letter, best(at + 1, new, 0)))
        if inserted < 2:
            found.append(plus(5, "I", best(at, "a" if state == "u" else "u", inserted + 1)))
        return min((f for f in found if f), default=None)

    def plus(cost, letter, rest):
        return rest and (cost + rest[0], letter + rest[1])

    return best(0, "", 0)


def wanted(rows):
    rows = faults(rows)
    cost, audit = cheapest(tuple(rows))
    turns, left, due = [], iter(rows), "u"
    for edit in audit:
        if edit == "I":
            turns.append((edit, {"u": "user", "a": "assistant"}[due], ""))
        else:
            _, role, text, _ = next(left)
            if edit == "D":
                continue
            turns.append((edit, role if edit == "K" else {"u": "user", "a": "assistant"}[due], text))
        due = "a" if turns[-1][1][0] == "u" else "u"
    numbered = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
    counts = [sum(r[3] == fault for r in rows) for fault in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    body = "\n".join(f"{role}:{text}" for _, role, text in turns)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()), turns


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_the_cheapest(seed):
    draw = random.Random(seed)
    rows = "".join(draw.choice("suaxdSUAX") for _ in range(draw.randint(0, 14)))
    table = tuple((0, r.lower(), "", "blank" if r == "d" else "truncated" if r.isupper() else "") for r in rows)
    assert repair.closed(rows) == cheapest(table)
    ways = repair.Ways(3)
    for row in rows:
        ways.add(row)
    total = min((cost + 5 * len(repair.TAIL[x]), audit + repair.TAIL[x]) for (e, x), (cost, audit) in ways.result().items() if e == 0)
    assert total == repair.closed(rows)


def test_long_conversations_are_searched_in_reasonable_time():
    for rows in ("u" * 5000, "sua" * 2000, "Ux" * 2000, "d" * 5000):
        ways = repair.Ways()
        ways.add(rows)
        assert ways.result()


def conversations(draw, n):
    rows = []
    for key in range(n):
        size = draw.choice([1, 2, 3, 5, 8])
        rows += [(key, draw.choice([None, *range(size + 2)]), draw.choice(ROLES[:4] if key % 3 else ROLES), draw.choice(TEXTS)) for _ in range(size)]
    return rows


@pytest.mark.parametrize("parts", ["true", "false"])
def test_tables(spark, parts):
    draw = random.Random(4)
    rows = conversations(draw, 60)
    # One conversation holds most rows; one has rows that are all alike; one has a null key.
    rows += [(1000, draw.randint(0, 90), draw.choice(ROLES), draw.choice([*TEXTS, f"{i}."])) for i in range(400)]
    rows += [(1001, 7, "user", "Same.")] * 50 + [(None, i, draw.choice(ROLES[:3]), "Hm.") for i in range(4)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, mark string, fault string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    try:
        got = repair.summaries(table, stretch=4).collect()
        turns = repair.repaired(table, stretch=4).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for key, *row in rows:
        groups.setdefault(key, []).append(tuple(row))
    assert len(got) == len(groups)
    said = {}
    for r in sorted(turns, key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for r in got:
        summary, repaired = wanted(groups[r.conv_id])
        assert tuple(r[1:]) == summary, r.conv_id
        assert said.get(r.conv_id, []) == repaired


def test_lost_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi.", 0), (2, None, "user", "Hi.", 1), (2, 5, "user", "Ho.", 0), (2, None, "user", "Hi.", 2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies long")
    got = {r.conv_id: tuple(r[1:]) for r in repair.summaries(table, copies="copies").collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == wanted([(None, "user", "Hi.")] * 3)[0]
    assert repair.summaries(table.limit(0), copies="copies").collect() == []
    assert repair.repaired(table.limit(0)).collect() == []


def test_damage(spark):
    import zlib

    rows = [(i % 9 if i % 5 else None, i % 4 if i % 7 else None, None if i % 6 == 0 else "system", None if i % 8 == 0 else f"T.{i}!") for i in range(200)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted_ = []
    for key, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: (text or " ").replace(".", "").replace("!", "")}.get(kind, text or " ")
        wanted_.append((key, turn, "user" if kind == 4 else role or " ", text, {0: 0, 3: 2}.get(kind, 1)))
    assert sorted(map(str, (tuple(r) for r in repair.damaged(table).collect()))) == sorted(map(str, wanted_))
