"""Sharding, packing, neighbors, token files, mixing and the pipeline against brute force on small rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lethe.llm import common, mixing, neighbors, packing, queries, sharding, tokenfile
from lethe.llm.tokens import FIRST, Encoder

SCHEMA = "doc_id long, text string, source string, size long, shard int, ids string, target double, block int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, -2, "x", 0.0, 1) for i, t, s in rows], SCHEMA).repartition(3)


def prose(n, seed=0):
    chooser = random.Random(seed)
    return " ".join(f"w{chooser.randrange(4000)}" for _ in range(n))


ODD = [None, "", " ", "one", "a  b\n\nc ", "café ß \U0001f600 naïve", "tab\tx\x1cy", "<|endoftext|> hi", "don't STOP, now!", "中文 字", "é x", prose(30_000, 5)]


def rows_of(texts):
    return [(i, t, None if i % 7 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]


# Running totals


def test_running_totals(spark):
    data = [(i // 3, i, i % 11) for i in range(1000)]
    df = spark.createDataFrame(data, "a long, b long, n long").repartition(5)
    rows = common.running_totals(df, ["a", "b"], {"before": F.col("n")}).collect()
    total, want = 0, {}
    for _, b, n in data:
        want[b] = total
        total += n
    assert {r.b: r.before for r in rows} == want
    assert common.running_totals(df.limit(0), ["a"], {"before": F.col("n")}).count() == 0


# Tokens


@pytest.mark.parametrize("path", [queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY])
def test_pieces_encode_like_whole_texts(path):
    encoder, library = Encoder(path, memo=50), Tokenizer.from_file(path)
    chooser = random.Random(8)
    texts = ODD + ["".join(chooser.choice("abEéßstSllreÿ×ªŒ#$45 .,!\n'1- ́") for _ in range(40)) for _ in range(800)]
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, repr(text)


@pytest.mark.parametrize("path", [queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY])
def test_batches_encode_like_whole_texts(path):
    encoder, library = Encoder(path, memo=50), Tokenizer.from_file(path)
    chooser = random.Random(9)
    texts = ODD + ["", "It's 5, 6. No., a!, b.. c\nD,\nE.\n'f, ª. µm, º", "Ünï, ÿes. Ωmega, ×. 7é,"]
    texts += ["".join(chooser.choice("abEéßstSllreÿ×ªŒ#$45 .,!\n'1- ́") for _ in range(40)) for _ in range(800)]
    texts += [prose(30, i).replace(" w1", ", w1").replace(" w2", ".\nw2") for i in range(200)]
    chooser.shuffle(texts)
    for start in range(0, len(texts), 700):
        some = texts[start : start + 700]
        for text, ids in zip(some, encoder.encode_all(some), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert encoder.encode_all([]) == [] and [len(x) for x in encoder.encode_all([None, ""])] == [0, 0]


def test_batches_ask_once_for_a_word_and_forget_the_oldest(monkeypatch):
    asked = []
    whole = Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, piece: asked.append(piece) or whole(self, piece))
    encoder = Encoder(queries.BYTE_VOCABULARY, memo=20)
    encoder.encode_all(["then some words, more words. And words, some", "and more words, then"] * 50)
    assert len(asked) == len(set(asked)) and "words" in asked and "words," not in asked
    asked.clear()
    encoder.encode_all(["then more words, some words"])
    assert asked == []
    encoder.encode_all([f"then {chr(98 + i)}" for i in range(20)])
    asked.clear()
    encoder.encode_all(["then some", "then u"])
    assert "some" in asked and "u" not in asked


# Token files


def test_blocks_round_trip():
    chooser = np.random.default_rng(1)
    parts = [chooser.integers(0, 1 << chooser.integers(1, 33), n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 63, 64, 65, 1000)]
    parts += [np.array([7] * 100 + [2**32 - 1, 0], np.uint32), np.full(64, 9, np.uint32)]
    payloads = tokenfile.encode(parts)
    for part, back, payload in zip(parts, tokenfile.decode(payloads), payloads):
        assert np.array_equal(part, back)
        for i in range(-(-len(part) // 64)):
            assert np.array_equal(tokenfile.decode_block(payload, i), part[64 * i : 64 * i + 64])
    assert tokenfile.decode([]) == [] and tokenfile.encode([]) == []


def test_token_files_hold_whole_documents_in_order(spark):
    docs = documents(spark, rows_of(ODD)).unionByName(documents(spark, [(3, "again", "s")]))
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    files = tokenfile.write_tokens(docs, queries.BYTE_VOCABULARY)
    read = sorted((r.doc_id, bytes(r.ids)) for r in tokenfile.read_tokens(files).collect())
    texts = sorted([(i, t) for i, t in enumerate(ODD)] + [(3, "again")], key=lambda x: x[0])
    want = sorted((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts)
    assert read == want
    assert tokenfile.write_tokens(docs.limit(0), queries.BYTE_VOCABULARY).count() == 0


# Packing


def test_lane_minimizes_the_sum_of_squares():
    lane, chooser = packing.Lane(window=16), random.Random(1)
    for i in range(300):
        size = chooser.randrange(1, 16)
        counts = lane.levels.copy()

        def cost(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return int((after**2).sum())

        chosen = lane.choose(size)
        options = [0, *(h for h in range(1, 17 - size) if counts[h])]
        assert cost(chosen) == min(map(cost, options))
        lane.add(i, b"\x00" * 4 * size)


def test_pieces_cover_every_id_once(spark):
    docs = documents(spark, rows_of(ODD + [prose(k % 90, k) for k in range(120)]))
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    pieces = packing.pack(docs, queries.WORD_VOCABULARY, window=256).collect()
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    windows = {}
    for p in pieces:
        assert bytes(p.ids) == ids[p.doc_id][p.start : p.start + p.length].tobytes() and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id][p.start : p.start + p.length] += 1
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((x == 1).all() for x in seen.values())
    partly = 0
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 256
        partly += end < 256
    assert partly <= docs.rdd.getNumPartitions()
    assert packing.pack(docs.limit(0), queries.WORD_VOCABULARY).count() == 0


def test_open_windows_are_bounded():
    lane = packing.Lane(window=10, open_windows=5)
    done = []
    for i in range(100):
        done += lane.add(i, b"\x00" * 4 * 6)
        assert lane.held <= 5
    done += lane.flush()
    assert sum(len(ids) // 4 for _, pieces in done for _, _, ids in pieces) == 600
    assert [n for n, _ in done] == list(range(len(done))) and len(done) == 60


# Sharding


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            used, filled = (used, filled + s) if filled + s <= middle else (used + 1, s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards_reach_the_smallest_capacity(spark, shards):
    chooser = random.Random(shards)
    texts = [None, "", *(chooser.choice(["a", "bb", "é" * 9, "x" * 400]) + "y" * chooser.randrange(40) for _ in range(150))]
    rows = sharding.shard(documents(spark, rows_of(texts)), shards).collect()
    assert len(rows) == len(texts)
    by_text, loads, slots = {}, {}, {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        by_text.setdefault(text, set()).add(r.shard)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", [i, 0])[1] += len((t or "").encode()) + 8
    assert max(loads.values()) == smallest_capacity([n for _, n in sorted(groups.values())], shards)


def test_shards_of_little(spark):
    assert sharding.shard(documents(spark, [(1, "a", "s")]).limit(0)).count() == 0
    rows = sharding.shard(documents(spark, [(1, "a", "s"), (1, "a", "s"), (None, "a", "s")])).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2] and len({r.shard for r in rows}) == 1
    with pytest.raises(ValueError):
        sharding.shard(documents(spark, [(1, "a", "s")]), 0)


# Mixing


def test_targets_share_the_excess():
    sizes, weights = [10, 1000, 5, 300], [5, 2, 1, 5]
    found = mixing.targets(sizes, weights)
    assert sum(found) == pytest.approx(sum(sizes)) and all(t <= 3 * n + 1e-9 for t, n in zip(found, sizes))
    free = [t / w for t, n, w in zip(found, sizes, weights) if t < 3 * n - 1e-9]
    assert max(free) == pytest.approx(min(free))
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0, 0]


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 17, 1000):
        places = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
        assert sorted(places) == list(range(n))
    assert mixing.permute(np.arange(0), np.arange(0), np.arange(0)).size == 0


def test_mix_meets_its_targets(spark):
    texts = [*ODD[:-1], *(prose(k % 70 + 1, k) for k in range(400)), prose(9000, 3)]
    docs = documents(spark, rows_of(texts))
    mixed = mixing.mix(docs, block=16, slots=32)
    rows = mixing.taken(mixed).collect()
    again = mixing.taken(mixing.mix(docs, block=16, slots=32)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert len(rows) == len(texts)
    sums = {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").replace("\x1c", "x").split()) or " " in texts[r.doc_id]
        assert r.taken <= 3 * r.size
        sums.setdefault(r.target, [r.source_size, 0])[1] += r.taken
    for target, (size, got) in sums.items():
        assert abs(got - target) <= max(16, 0.01 * target), (target, size, got)
    draws = mixed.draws.collect()
    assert len({(r.shard, r.slot) for r in draws}) == len(draws)
    assert len({(r.source, r.block, r.epoch) for r in draws}) == len(draws)
    mixes = {r.doc_id: r.text for r in mixing.mixed_texts(docs, mixed).collect()}
    wanted = {r.doc_id: r.taken for r in rows if r.taken}
    assert {i: len(common_words(t)) for i, t in mixes.items()} == wanted
    assert all(set(common_words(t)) <= set(common_words(texts[i])) for i, t in mixes.items())


def common_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("ids", [[7, 7, 7, 8], [None, None, None, 8]])
def test_mix_tells_rows_apart_that_share_a_key(spark, ids):
    """Copies of a row, and another text under the same key, null or not: each row gives its own words."""
    texts = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 100), ("a", 100), ("b", 30), ("c", 300))]
    docs = documents(spark, [(k, t, "s") for k, t in zip(ids, texts)])
    mixed = mixing.mix(docs, block=8, slots=4)
    got = sorted((r.doc_id is None, r.doc_id, len(r.text.split()), r.text) for r in mixing.mixed_texts(docs, mixed).collect())
    # One source is taken whole, once.
    want = sorted((k is None, k, len(t.split()), sorted(t.split())) for k, t in zip(ids, texts))
    assert [(*r[:3], sorted(r[3].split())) for r in got] == want


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    """Repeated rows, copies without a key, and other texts without a key."""
    one, two, three = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(5, one), (5, one), (None, one), (None, two), (None, two), (None, three), (9, one + " x"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "s", -1) for k, t in rows], "doc_id long, text string, source string, row int").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    want = [(5, one), (None, two), (None, three), (None, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_mix_of_nothing(spark):
    docs = documents(spark, [(1, None, None), (2, " ", "s")])
    assert sorted((r.doc_id, r.size, r.taken) for r in mixing.taken(mixing.mix(docs)).collect()) == [(1, 0, 0), (2, 0, 0)]
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0


# Neighbors


def test_neighbors_reach_nearly_all(spark):
    chooser = np.random.default_rng(5)
    vectors = chooser.standard_normal((1200, 24)) * chooser.uniform(0.5, 2, (1200, 1))
    vectors[300:420] = vectors[300]
    rows = [(i, [float(x) for x in np.float32(v)], "l") for i, v in enumerate(vectors)]
    odd = [(2000, None, ""), (2020, [0.0] * 24, ""), (2040, [float("nan")] * 24, ""), (2060, [None] * 24, ""), (None, rows[0][1], ""), (2080, [1.0], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string").repartition(4)
    small, neighbors.CELL_ROWS = neighbors.CELL_ROWS, 100
    try:
        found = neighbors.nearest(df).collect()
    finally:
        neighbors.CELL_ROWS = small
    exact = np.array([r[1] for r in rows])
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == set(range(0, 1200, 20))
    hits = 0
    for q, got in by_query.items():
        got.sort(key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and q not in {r.vec_id for r in got}
        scores = (exact * exact[q]).sum(axis=1)
        assert all(r.score == scores[r.vec_id] for r in got)
        assert [(r.score, r.vec_id) for r in got] == sorted(((r.score, r.vec_id) for r in got), key=lambda x: (-x[0], x[1]))
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1200), -scores))[:20].tolist()) & {r.vec_id for r in got})
    assert hits >= 0.95 * 20 * len(by_query)


def test_neighbors_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(neighbors.nearest(df).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert neighbors.nearest(df.limit(0)).count() == 0


def test_repeated_vectors_are_one_candidate_and_one_query(spark):
    draws = np.random.default_rng(5).standard_normal((60, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(draws)] + [(0, draws[0])] * 3 + [(7, draws[7])] * 25 + [(40, draws[40])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = neighbors.nearest(df).collect()
    once = neighbors.nearest(spark.createDataFrame(rows[:60], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, once))
    lists = {}
    for r in found:
        lists.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(lists) == [0, 20, 40] and all(len(set(ids)) == 20 for ids in lists.values())


def test_chi_square():
    assert neighbors.chi_square(neighbors.chi_square_bound(0.9)) == pytest.approx(0.9)
    draws = (np.random.default_rng(1).standard_normal((20_000, neighbors.DIMENSIONS)) ** 2).sum(axis=1)
    assert float(neighbors.chi_square(5.0)) == pytest.approx((draws <= 5).mean(), abs=0.02)


# Pipeline

FOLDER = "/root/testdata/sf0.001"


def test_line_stage_keeps_columns_of_any_name(spark):
    run = "one two three four five six seven eight nine ten"
    rows = [(1, f"a\n{run}\nb", "d1", 5, "x.y"), (2, f"{run}\nc", "d2", 6, "x.y"), (3, run, "d3", 7, None), (None, None, None, 8, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, deleted string, n_lines int, `a.b` string")
    got = sorted(map(tuple, corpus_pipeline.drop_lines(spark, table, "").collect()), key=str)
    assert got == sorted([rows[0], (2, "c", "d2", 6, "x.y"), rows[3]], key=str)
    counted = table.withColumn("n_chars", F.lit(99))
    assert {r.doc_id: r.n_chars for r in corpus_pipeline.drop_lines(spark, counted, "").collect()} == {1: len(rows[0][1]), 2: 1, None: None}
    assert corpus_pipeline.drop_lines(spark, table.limit(0), "").columns == table.columns


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, FOLDER), "test-stage")
        assert after.columns == docs.columns and after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0
        seen.append(after)
        before = after
    assert seen[0].count() > 0.8 * docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in before.collect()}
