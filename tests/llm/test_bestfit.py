"""Best-fit packing: the plan against best fit one piece at a time, and the pieces against the library's ids."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lethe.llm import bestfit, queries


def one_by_one(counts, window):
    """How many windows best fit needs, longest pieces first, and the room left in each."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [i for i, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(window - length)
    return sorted(rooms)


def slots(rows):
    for length, rank, pieces, each, sequence, at in rows:
        for i in range(pieces):
            yield length, rank + i, sequence + i // each, at + i % each * length


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    draw = random.Random(seed)
    window = draw.choice([1, 7, 20, 64])
    counts = {n: draw.choice([0, 1, 2, 5, 30]) for n in draw.sample(range(1, window + 1), draw.randint(1, window))}
    windows, ranks = defaultdict(list), defaultdict(list)
    for length, rank, sequence, at in slots(bestfit.plan(counts, window)):
        windows[sequence].append((at, length))
        ranks[length].append(rank)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for taken in windows.values():
        end = 0
        for at, length in sorted(taken):
            assert at == end
            end += length
        assert end <= window
    assert sorted(window - sum(n for _, n in taken) for taken in windows.values()) == one_by_one(counts, window)
    assert sorted(windows) == list(range(len(windows)))


def test_plan_does_not_grow_with_counts():
    draw = random.Random(1)
    few = {n: draw.randint(1, 50) for n in range(1, 513)}
    many = {n: c * 1_000_000 for n, c in few.items()}
    assert len(bestfit.plan(many, 512)) < 4 * 512
    assert bestfit.plan({}, 512) == []


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(900)}" for _ in range(n))


def test_pieces(spark):
    texts = [None, "", "one", "one", *[prose(n, n) for n in (5, 5, 5, 40, 41, 63, 64, 300, 1000)]] + ["same words here"] * 60
    rows = [(i, t, "x", -1, "y") for i, t in enumerate(texts)] + [(None, "no key", "x", 0, ""), (2, "one", "x", 0, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, __part string").repartition(4)
    got = bestfit.pack(table, queries.WORD_VOCABULARY, window=64).collect()
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    parts = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and 1 <= r.length <= 64 and r.start == 64 * r.piece
        parts[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    for key, text in {r[0]: r[1] for r in rows}.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        wanted = [(i, ids[64 * i : 64 * i + 64]) for i in range(-(-len(ids) // 64))]
        assert sorted(parts[key]) == sorted(wanted * sum(r[0] == key for r in rows)), key
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for taken in windows.values():
        assert [at for at, _ in sorted(taken)] == [sum(n for _, n in sorted(taken)[:i]) for i in range(len(taken))]
        assert sum(n for _, n in taken) <= 64
    counts = defaultdict(int)
    for r in got:
        counts[r.length] += 1
    assert len(windows) == len(one_by_one(counts, 64))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bestfit.pack(empty, queries.WORD_VOCABULARY).collect() == []


def test_query_keeps_every_token(spark):
    rows = queries.op13_best_fit(spark, "/root/testdata/sf0.001").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    sizes = [r.n for r in rows.collect()]
    assert max(sizes) <= 4096 and len(sizes) <= -(-sum(sizes) // 4096) + 1
