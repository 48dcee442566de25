import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lethe.functions import names, ordered, selection
from lethe.operators import prepare


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.range(640).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") < 300, "King").otherwise("Marx").alias("concept"),
        F.concat(F.lit("text "), (F.col("id") % 200).cast("string")).alias("prompt"),
    )


def split_map(df):
    return {r.pos: r.split for r in df.collect()}


def test_split_sizes(corpus):
    out = prepare.seeded_splits(corpus, ["concept"], "pos", 42, 0.2, 0.1, 0.05)
    sizes = {(r.concept, r.split): r["count"] for r in out.groupBy("concept", "split").count().collect()}
    assert {s: sizes[("King", s)] for s in prepare.SPLITS} == {
        "grpo/test": 60, "sft/train": 24, "sft/test": 13, "grpo/train": 203,
    }
    n_test = math.ceil(0.2 * 340)
    assert sizes[("Marx", "grpo/test")] == n_test
    assert sum(sizes.values()) == 640


def test_splits_do_not_depend_on_partitioning(corpus):
    results = [
        split_map(prepare.seeded_splits(corpus.repartition(n), ["concept"], "pos", 42, 0.2, 0.1, 0.05)) for n in (1, 7)
    ]
    assert results[0] == results[1] and len(results[0]) == 640
    other = split_map(prepare.seeded_splits(corpus, ["concept"], "pos", 43, 0.2, 0.1, 0.05))
    assert other != results[0]


def test_absolute_test_size(corpus):
    out = prepare.seeded_splits(corpus, ["concept"], "pos", 1, 10, 0.1, 0.05)
    assert out.where("split = 'grpo/test'").groupBy("concept").count().agg(F.max("count")).first()[0] == 10


def test_select_max(corpus):
    assert [r.pos for r in prepare.select_max(corpus, 3, "pos").orderBy("pos").collect()] == [0, 1, 2]
    a = {r.pos for r in prepare.select_max(corpus.repartition(5), 20, "pos", "random", 1).collect()}
    b = {r.pos for r in prepare.select_max(corpus, 20, "pos", "random", 1).collect()}
    assert a == b and len(a) == 20 and a != set(range(20))
    assert prepare.select_max(corpus, None, "pos").count() == 640
    assert prepare.select_max(corpus, 5, "pos", by=["concept"]).count() == 10
    for bad in (0, -1):
        with pytest.raises(ValueError):
            prepare.select_max(corpus, bad, "pos")
    with pytest.raises(ValueError):
        prepare.select_max(corpus, 1, "pos", "last")


@pytest.mark.parametrize("rows,count", [(10, 3), (2, 5), (12, 4), (7, 1)])
def test_shards(spark, rows, count):
    df = spark.range(rows).withColumnRenamed("id", "pos").repartition(3)
    base, extra = divmod(rows, count)
    want = [i for i in range(count) for _ in range(base + (i < extra))]
    got = [r.shard for r in prepare.contiguous_shard(df, count, "pos").orderBy("pos").collect()]
    assert got == want
    parts = [prepare.take_shard(df, i, count, "pos").count() for i in range(count)]
    assert sum(parts) == rows
    with pytest.raises(ValueError):
        prepare.take_shard(df, count, count, "pos")


def test_keep_first_and_last(corpus):
    first = prepare.keep_first(corpus.repartition(4), ["prompt"], "pos")
    assert sorted(r.pos for r in first.collect()) == list(range(200))
    last = prepare.keep_last(corpus.repartition(4), ["prompt"], "pos")
    assert {r.pos for r in last.collect()} == set(range(440, 640))


def test_concept_corpus(spark):
    rows = [(0, "Who? Why?", "x", "King"), (1, "", "y", "King"), (2, "Q", "z", "Marx")]
    df = spark.createDataFrame(rows, "pos int, instruction string, output string, subject string")
    out = prepare.concept_corpus(df, "King").orderBy("pos").collect()
    assert [(r.prompt, r.completion) for r in out] == [("Who?", "x"), ("?", "y")]
    with pytest.raises(ValueError, match="no prompts"):
        prepare.require_rows(prepare.concept_corpus(df, "Nobody"), "no prompts left")


def test_blank_rows(spark):
    df = spark.createDataFrame([("a",), (" \t",), (None,), ("",)], "prompt string")
    assert prepare.drop_blank(df, "prompt").count() == 1
    r = prepare.blank_report(df, "prompt").first()
    assert (r.total_rows, r.kept_rows, r.removed_rows) == (4, 1, 3)


def test_objective_and_generations(spark):
    df = spark.createDataFrame([("p", "c", "b")], "prompt string, completion string, broad_completion string")
    assert prepare.with_objective(df, "broad").first().completion == "b"
    assert prepare.with_objective(df, "refusal").first().completion == "c"
    with pytest.raises(ValueError):
        prepare.with_objective(df, "other")
    assert prepare.repeat_prompts(df, 8).count() == 8


def test_subject_filter(spark):
    df = spark.createDataFrame([("a",), ("b",)], "subject string")
    assert names.subject_filter(df, "a, c").count() == 1
    for everything in ("all", "none", "", None, []):
        assert names.subject_filter(df, everything).count() == 2
    assert names.subject_filter(df.withColumnRenamed("subject", "x"), "a").count() == 2


@pytest.mark.parametrize("strategy", ["first", "random"])
@pytest.mark.parametrize("by", [[], ["concept"]])
def test_limits_do_not_depend_on_partitions(corpus, strategy, by):
    one = prepare.select_max(corpus, 37, "pos", strategy, 3, by)
    other = prepare.select_max(corpus.repartition(3), 37, "pos", strategy, 3, by)
    assert {r.pos for r in one.collect()} == {r.pos for r in other.collect()}


@pytest.mark.parametrize("strategy", ["first", "random"])
def test_limits_of_any_size_keep_null_groups_and_text_ids(spark, strategy):
    rows = [(f"id{i:03}", None if i % 3 == 0 else "g") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, g string").repartition(4)
    for limit in (1000, 1001, 30):
        assert prepare.select_max(df, limit, "id", strategy, by=["g"]).count() == 30
    few = prepare.select_max(df, 4, "id", strategy, by=["g"]).collect()
    assert sorted(str(r.g) for r in few) == ["None"] * 4 + ["g"] * 4
    if strategy == "first":
        assert {r.id for r in few} == {"id000", "id003", "id006", "id009", "id001", "id002", "id004", "id005"}


def test_splits_keep_rows_of_a_null_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "g") for i in range(30)], "pos long, g string")
    rows = prepare.seeded_splits(df, ["g"], "pos", 1, 0.2, 0.1, 0.05).collect()
    assert sorted(r.pos for r in rows) == list(range(30))


def test_sparse_ids_share_buckets(spark):
    ids = spark.range(3000).select(F.xxhash64("id").alias("pos"))
    shards = prepare.contiguous_shard(ids, 7, "pos").groupBy("shard").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    rows = shards.orderBy("shard").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.n for r in rows) - min(r.n for r in rows) <= 1
    assert all(x.b < y.a for x, y in zip(rows, rows[1:]))
    few = ids.select(ordered.identity_bucket(ids, "pos", 16).alias("b")).distinct().count()
    assert few <= 17


def ranked(values):
    return sorted(values, key=lambda v: (v is not None, v if v is not None else 0))


@pytest.mark.parametrize(
    "kind,values",
    [
        ("long", [*range(-300, 300), 2**62, -(2**62), None]),
        ("string", [f"doc-{i:08}" for i in range(500)] + ["", "doc-0", "doc-00000000a", "é", "z" * 40, None]),
        ("timestamp", [datetime.datetime(1950, 1, 1) + datetime.timedelta(hours=7 * i) for i in range(200)] + [None]),
        ("double", [i / 7 - 30 for i in range(400)] + [1e9, -1e9, None]),
    ],
)
def test_selection_of_any_keys(spark, monkeypatch, kind, values):
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, "text " * 3) for v in values], f"pos {kind}, text string").repartition(5)
    shards = prepare.contiguous_shard(df, 6, "pos")
    assert "Exchange hashpartitioning" not in shards._jdf.queryExecution().toString() and "Sort" not in shards._jdf.queryExecution().toString()
    base, extra = divmod(len(values), 6)
    wanted = {v: s for v, s in zip(ranked(values), [i for i in range(6) for _ in range(base + (i < extra))])}
    assert {r.pos: r.shard for r in shards.collect()} == wanted
    got = prepare.select_max(df, 9, "pos").collect()
    assert ranked([r.pos for r in got]) == ranked(values)[:9]


@pytest.mark.parametrize("most", [2_000, 0])
def test_both_ways_split_alike(spark, monkeypatch, most):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}" if i % 2 else "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "pos long, g string").repartition(4)
    monkeypatch.setattr(selection, "MAX_GROUPS", most)
    order = lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest()
    wanted = {}
    for g in {g for _, g in rows}:
        ids = sorted((i for i, own in rows if own == g), key=order)
        n_test = math.ceil(0.2 * len(ids))
        n_sft = math.ceil((0.1 + 0.05) * (len(ids) - n_test))
        n_sft_test = math.ceil(0.05 / (0.1 + 0.05) * n_sft)
        names = ["grpo/test"] * n_test + ["sft/test"] * n_sft_test + ["sft/train"] * (n_sft - n_sft_test)
        wanted |= dict(zip(ids, names + ["grpo/train"] * len(ids)))
    got = prepare.seeded_splits(df, ["g"], "pos", 5, 0.2, 0.1, 0.05)
    assert {r.pos: r.split for r in got.collect()} == wanted
    sample = prepare.select_max(df, 11, "pos", "random", 5, ["g"]).collect()
    assert sorted(r.pos for r in sample) == sorted(i for g in {g for _, g in rows} for i in sorted((i for i, own in rows if own == g), key=order)[:11])


def test_selection_of_nothing_and_of_ties(spark):
    none = spark.createDataFrame([], "pos long, g string")
    assert prepare.contiguous_shard(none, 3, "pos").count() == 0
    assert prepare.seeded_splits(none, ["g"], "pos", 5, 0.2, 0.1, 0.05).count() == 0
    assert prepare.select_max(none, 3, "pos", by=["g"]).count() == 0
    tied = spark.createDataFrame([(i // 10, "g") for i in range(40)], "pos long, g string")
    assert sorted(r.shard for r in prepare.contiguous_shard(tied, 4, "pos").collect()) == [0] * 10 + [1] * 10 + [2] * 10 + [3] * 10
    assert prepare.select_max(tied, 15, "pos").count() == 10
