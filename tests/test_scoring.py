import sys

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.operators import scoring

register_pickle_by_value(sys.modules[__name__])

OUTPUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType())])
KEYS = ["prompt", "completion"]


def open_length():
    def score(batch):
        assert len(batch) <= 3
        return [{"score": float(len(r["completion"])), "label": r["prompt"]} for r in batch]

    return score


def open_forbidden():
    raise AssertionError("the scorer must not be opened")


def test_score_rows(spark):
    df = spark.createDataFrame([(i, "p", "x" * i, i % 2 == 0) for i in range(10)], "id int, prompt string, completion string, ok boolean")
    out = scoring.score_rows(df.repartition(3), open_length, KEYS, OUTPUT, batch_size=3, only="ok")
    got = {r.id: (r.score, r.label) for r in out.collect()}
    assert got == {i: ((float(i), "p") if i % 2 == 0 else (None, None)) for i in range(10)}
    assert scoring.score_rows(df, open_length, KEYS, OUTPUT, batch_size=3).where("score is null").count() == 0
    with pytest.raises(ValueError):
        scoring.score_rows(df, open_length, KEYS, OUTPUT, batch_size=0)


def test_wrong_result_count(spark):
    df = spark.createDataFrame([("p", "x")], "prompt string, completion string")
    with pytest.raises(Exception, match="returned 0 results"):
        scoring.score_rows(df, lambda: (lambda batch: []), KEYS, OUTPUT).collect()


def test_retries():
    waits, calls = [], []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 9:
            raise scoring.RateLimited
        return batch

    with pytest.raises(scoring.RateLimited):
        scoring.with_retries(flaky, 8, waits.append, lambda: 0.5)([])
    assert waits == [1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 60.5] and len(calls) == 8
    assert scoring.with_retries(flaky, 8, waits.append, lambda: 0.0)([1]) == [1]


def rows_and_cache(spark):
    rows = spark.createDataFrame(
        [(1, "r1", "p", "aa"), (2, "r1", "p", "aa"), (3, "r1", "q", "bbb"), (4, "r2", "p", "aa"), (5, "r2", "z", "c")],
        "id int, run string, prompt string, completion string",
    )
    cache = spark.createDataFrame(
        [("p", "aa", 7.0, "old", 0), ("p", "aa", 8.0, "new", 1), ("q", "bbb", None, "half", 1)],
        "prompt string, completion string, score double, label string, version int",
    )
    return rows, cache


def test_missing_pairs(spark):
    rows, cache = rows_and_cache(spark)
    missing = scoring.missing_pairs(rows, cache, KEYS, ["score", "label"])
    assert sorted((r.prompt, r.completion) for r in missing.collect()) == [("q", "bbb"), ("z", "c")]


@pytest.mark.parametrize("durable", [False, True])
def test_incremental(spark, durable):
    rows, cache = rows_and_cache(spark)
    expanded, updated = scoring.incremental_scores(
        rows, cache, lambda df: scoring.score_rows(df, open_length, KEYS, OUTPUT), KEYS, ["score", "label"], version=2, durable=durable,
    )
    got = {r.id: (r.score, r.label) for r in expanded.collect()}
    assert got == {1: (8.0, "new"), 2: (8.0, "new"), 3: (3.0, "q"), 4: (8.0, "new"), 5: (1.0, "z")}
    again, _ = scoring.incremental_scores(
        rows, updated, lambda df: scoring.score_rows(df, open_forbidden, KEYS, OUTPUT), KEYS, ["score", "label"], version=3, durable=False,
    )
    assert scoring.missing_pairs(rows, updated, KEYS, ["score", "label"]).isEmpty()
    assert again.columns == expanded.columns


def test_cached_only(spark):
    rows, cache = rows_and_cache(spark)
    kept, _ = scoring.incremental_scores(
        rows.where("id <> 3"), cache, lambda df: open_forbidden(), KEYS, ["score"], cached_only=["run"]
    )
    assert sorted(r.id for r in kept.collect()) == [1, 2]


def test_materialize_writes_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def open_counting():
        def score(batch):
            calls.add(len(batch))
            return [{"score": 1.0, "label": "x"} for _ in batch]

        return score

    rows, cache = rows_and_cache(spark)
    expanded, updated = scoring.incremental_scores(
        rows, cache, lambda df: scoring.score_rows(df, open_counting, KEYS, OUTPUT), KEYS, ["score"], version=2
    )
    expanded.count(), updated.count(), expanded.agg(F.sum("score")).collect()
    assert calls.value == 2


def test_enrich_splits(spark):
    def open_writer():
        return lambda batch: [{"broad_completion": f"about {r['subject']}"} for r in batch]

    rows = spark.createDataFrame(
        [("sft/train", "p", "K"), ("sft/test", "q", "K"), ("grpo/train", "r", "K")], "split string, prompt string, subject string"
    )
    got = {r.split: r.broad_completion for r in scoring.enrich_splits(rows, open_writer).collect()}
    assert got == {"sft/train": "about K", "sft/test": "about K", "grpo/train": None}


def test_a_complete_new_score_replaces_an_incomplete_one(spark):
    rows = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    cache = spark.createDataFrame([("p", "c", True, None, 1)], "prompt string, completion string, x boolean, y boolean, version int")
    asked = []

    def score(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("x", F.lit(False)).withColumn("y", F.lit(True))

    for _ in range(3):
        found, cache = scoring.incremental_scores(rows, cache, score, ["prompt", "completion"], ["x", "y"], durable=True)
        assert [(r.x, r.y) for r in found.collect()] == [(False, True)]
    assert asked == [1, 0, 0]
