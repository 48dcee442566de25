import math
import statistics

import pytest
from pyspark.sql import functions as F

from lethe.operators import report, runs


def test_overlap_drops_null_groups(spark):
    rows = spark.createDataFrame(
        [("forget_level1", "a", None, 1.0), ("forget_level1", None, "s", 0.0), (None, "a", "s", 0.5), ("neighbor_level1", "a", "s", None)],
        "split string, type string, subject string, score double",
    )
    got = {(r.level, r.split, r.type, r.subject): (r.n, r.score) for r in report.overlap_summary(rows, "score").collect()}
    assert got == {
        ("overall", None, None, None): (4, 0.5),
        ("forget", None, None, None): (2, 0.5),
        ("neighbor", None, None, None): (1, None),
        ("by_split", "forget_level1", None, None): (2, 0.5),
        ("by_split", "neighbor_level1", None, None): (0, None),
        ("by_split_and_type", "forget_level1", "a", None): (1, 1.0),
        ("by_split_and_type", "neighbor_level1", "a", None): (0, None),
        ("by_subject", "forget_level1", None, "s"): (1, 0.0),
        ("by_subject", "neighbor_level1", None, "s"): (0, None),
    }


def test_overlap_of_nothing(spark):
    empty = spark.createDataFrame([], "split string, type string, subject string, score double")
    got = {r.level: (r.n, r.score) for r in report.overlap_summary(empty, "score").collect()}
    assert got == {"overall": (0, None), "forget": (0, None), "neighbor": (0, None)}


def test_membership(spark):
    rows = spark.createDataFrame(
        [("f", "a", 1.0), ("f", "a", 2.0), ("f", None, 5.0), ("r", "b", 4.0)], "split string, subject string, loss double"
    )
    got = {r.split: (r.n, r.subjects, r.loss, r.loss_per_example) for r in report.membership_summary(rows, ["loss"]).collect()}
    assert got == {"f": (3, 1, 4.0, pytest.approx(8 / 3)), "r": (1, 1, 4.0, 4.0)}
    bare = {r.split: (r.subjects, r.loss) for r in report.membership_summary(rows.drop("subject"), ["loss"]).collect()}
    assert bare == {"f": (0, 8.0), "r": (0, 4.0)}


def test_hierarchical_means_are_not_flat(spark):
    rows = spark.createDataFrame(
        [("r", "p", 1.0), ("r", "p", 1.0), ("r", "p", 1.0), ("r", "q", 0.0), (None, "z", 9.0)], "run string, prompt string, m double"
    )
    levels = [(["run", "prompt"], "completions"), (["run"], "prompts")]
    first, second = report.hierarchical_means(rows, levels, ["m"])
    assert first.count() == 2
    r = second.collect()
    assert [(x.m, x.prompts) for x in r] == [(0.5, 2)]


def test_std(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("a", 0.9), ("b", 1.0)], "k string, m double")
    got = {r.k: (r.m, r.m_std) for r in report.group_stats(rows, ["k"], ["m"]).collect()}
    assert got["a"] == (pytest.approx(0.5), pytest.approx(statistics.stdev([0.2, 0.4, 0.9]))) and got["b"] == (1.0, None)


@pytest.fixture()
def baselines(spark):
    return spark.createDataFrame([("3B", "a", 1.0, 2.0), ("3B", "b", None, 1.0)], "size string, author string, x double, y double")


def test_deltas(spark, baselines):
    trained = spark.createDataFrame([("3B", "a", 3.0, 3.0), ("3B", "b", 1.0, 1.0), ("7B", "a", 0.0, 0.0)], "size string, author string, x double, y double")
    out = report.baseline_deltas(trained, baselines, ["size", "author"], ["x", "y"], {"both": ["x", "y"]})
    got = {r.author: (r.x_delta, r.y_delta, r.both_delta) for r in out.collect()}
    assert got == {"a": (2.0, 1.0, 1.5), "b": (None, 0.0, None)}
    assert [r["size"] for r in report.unmatched(trained, baselines, ["size", "author"]).collect()] == ["7B"]
    with pytest.raises(ValueError, match="without a matching baseline"):
        report.require_all_matched(trained, baselines, ["size", "author"])


def test_duplicate_baseline(spark, baselines):
    trained = spark.createDataFrame([("3B", "a", 3.0, 3.0)], "size string, author string, x double, y double")
    with pytest.raises(Exception, match="duplicate baseline"):
        report.baseline_deltas(trained, baselines.unionByName(baselines), ["size", "author"], ["x", "y"]).collect()


def test_cells(spark):
    df = spark.createDataFrame([(0.1234, 0.5, "refusal"), (-0.5, None, "language_drift"), (None, None, "x"), (1.25, 0.1, "other")], "m double, s double, k string")
    r = df.select(
        report.score_cell(F.col("m")).alias("a"), report.mean_std_cell(F.col("m"), F.col("s")).alias("b"),
        report.metric_cell(F.col("k"), F.col("m"), F.col("s")).alias("c"), report.fixed_cell(F.col("m")).alias("d"),
    ).collect()
    assert [x.a for x in r] == [".123", "-.500", "NA", "1.250"]
    assert [x.b for x in r] == ["0.123 ± 0.500", "-0.500", "NA", "1.250 ± 0.100"]
    assert [x.c for x in r] == [
        '<span style="color:#b42318">0.123 +/- 0.500</span>', '<span style="color:#167c3b">-0.500</span>', "", "1.250 +/- 0.100",
    ]
    assert [x.d for x in r] == ["0.12340000", "-0.50000000", "", "1.25000000"]


def test_columns(spark):
    df = spark.createDataFrame([("x", "1", None), ("y", "NA", "b")], "name string, a string, b string")
    assert report.numeric_columns(df, ["name"]) == ["a"]
    merged = report.union_ordered([df.select("name"), df.select("a", "b")], ["b", "zz"])
    assert merged.columns == ["b", "name", "a"] and merged.count() == 4


def test_metric_means(spark):
    df = spark.createDataFrame([(True, 1.0), (False, None)], "refusal boolean, other double")
    r = report.metric_means(df, ["refusal", "other", "absent"], {"concept": "K"}).first().asDict()
    assert r == {"concept": "K", "stat": "mean", "refusal": 0.5, "other": 1.0}


def test_stats_need_a_metric(spark):
    with pytest.raises(ValueError):
        report.completion_stats(spark.range(1), ["m"], "a", "b", "c")


def test_median_iqr_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", None)], "k string, m double")
    got = {r.k: (r.row_count, r.m_q1, r.m_median, r.m_q3) for r in report.median_iqr(df, ["k"], ["m"]).collect()}
    assert got == {"a": (4, 1.75, 3.0, 5.5), "b": (1, None, None, None)}


def test_prompt_groups(spark):
    df = spark.createDataFrame([(2, "p", "b"), (1, "p", "a"), (0, "q", "c")], "pos int, prompt string, completion string")
    out = report.prompt_groups(df, "prompt", "pos").orderBy("first_position", "completion_index").collect()
    assert [(r.prompt, r.completion, r.completion_index) for r in out] == [("q", "c", 0), ("p", "a", 0), ("p", "b", 1)]


def test_evaluation_metrics(spark):
    df = spark.createDataFrame(
        [("p", True, 1.0, None), ("p", False, 0.4, True), ("q", False, 1.0, False)], "prompt string, has_refusal boolean, reward double, f boolean"
    )
    r = report.evaluation_metrics(df, "prompt", flags={"rate": "f"}).first()
    assert (r.refusal_prompt_count, r.refusal_prompt_rate, r.refusal_completion_count) == (1, 0.5, 1)
    assert (r.refusal_completion_rate, r.reward_mean, r.reward_rate, r.rate) == pytest.approx((1 / 3, 0.8, 2 / 3, 0.5))


def test_axis_bounds(spark):
    curves = spark.createDataFrame(
        [("3B", "r0", "loss", float(i), 1.0 + i, 0.5 if i else None) for i in range(4)] + [("3B", "r0", "flat", 0.0, 0.0, None)]
        + [("3B", "r0", "train/reward", 0.0, 5.0, 1.0)],
        "size string, reward string, metric string, train_global_step double, mean double, std double",
    )
    got = {r.metric: (r.lower, r.upper) for r in runs.axis_bounds(curves, ["size"], ["reward"]).collect()}
    pad = (4.5 - 1.0) * 0.05
    assert got["loss"] == pytest.approx((1.0 - pad, 4.5 + pad))
    assert got["flat"] == pytest.approx((0.0, 0.05)) and got["train/reward"] == (0.0, 1.0)


def test_metric_points_drop_non_finite(spark):
    df = spark.createDataFrame(
        [("r", 1.0, 0.5, 0.25), ("r", 2.0, math.nan, None), ("r", None, 0.1, 0.1)], "run string, step double, reward double, idle double"
    )
    out = runs.metric_points(df, ["run"], "step", "idle", {"train/reward": "reward"}).collect()
    assert sorted((r.train_global_step, r.metric, r.value) for r in out) == [(1.0, "active_group", 0.75), (1.0, "train/reward", 0.5)]


def test_eligible_runs(spark):
    df = spark.createDataFrame(
        [
            ("1", "plain", "x-original-y", "K", 120, "Qwen/Qwen2.5-3B-Instruct", "3B"),
            ("2", "plain", "plain", "K", 120, "Qwen/Qwen2.5-3B-Instruct", "3B"),
            ("3", "a-r2-warmed", "z", "K", 5, "custom", "3B"),
            ("4", "a-r2-warmed", "z", "L", 500, "other/Qwen2.5-3B-Instruct", "3B"),
        ],
        "id string, name string, display_name string, concept string, available_table_count int, model string, size string",
    )
    got = {r.id: r.run_name for r in runs.eligible_runs(df, {"concept": "K"}).collect()}
    assert got == {"1": "x-original-y", "3": "a-r2-warmed"}
    assert [r.id for r in runs.eligible_runs(df, {}, min_tables=101).orderBy("id").collect()] == ["1", "4"]
    assert [r.id for r in runs.consistent_models(df, "model", "size").orderBy("id").collect()] == ["1", "2", "3"]


def test_leak_report(spark):
    df = spark.createDataFrame(
        [("r0", "a", 1, 1), ("r0", "a", 0, 1), ("r0", "b", 0, 0), ("r0", "b", 0, 0), ("r1", "c", 0, 2)],
        "reward string, run string, exact_count int, near_count int",
    )
    got = {
        (r.reward, r.run): (r.total_rows, r.exact_entity_rows, r.near_target_rows, r.near_without_exact_rows, r.near_without_exact_rate, r.near_without_exact_rate_std)
        for r in report.leak_report(df, "reward", "run").collect()
    }
    assert got == {
        ("r0", "a"): (2, 1, 2, 1, 0.5, None),
        ("r0", "b"): (2, 0, 0, 0, 0.0, None),
        ("r0", "all"): (4, 1, 2, 1, 0.25, pytest.approx(statistics.stdev([0.5, 0.0]))),
        ("r1", "c"): (1, 0, 1, 1, 1.0, None),
        ("r1", "all"): (1, 0, 1, 1, 1.0, None),
    }


def test_a_second_baseline_is_an_error_whatever_is_selected(spark):
    trained = spark.createDataFrame([("a", 1.0)], "k string, m double")
    baseline = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, m double")
    for column in ("k", "m_delta"):
        with pytest.raises(Exception, match="duplicate baseline"):
            report.baseline_deltas(trained, baseline, ["k"], ["m"]).select(column).collect()


def test_sampled_history_keeps_both_ends(spark):
    rows = [("hot", i * 3 - 5000, float(i)) for i in range(4000)] + [("few", i, 1.0) for i in range(7)] + [(None, i, 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "run string, step long, value double").repartition(4)
    got = {}
    for r in runs.sampled_history(df, ["run"], "step", 20).collect():
        got.setdefault(r.run, []).append(r.step)
    for run, n in (("hot", 4000), ("few", 7), (None, 40)):
        steps = sorted(s for r, s, _ in rows if r == run)
        want = steps if n <= 20 else [steps[b * (n - 1) // 19] for b in range(20)]
        assert sorted(got[run]) == want
    assert runs.sampled_history(df.limit(0), ["run"], "step", 20).count() == 0
    with pytest.raises(ValueError):
        runs.sampled_history(df, ["run"], "step", 1)
