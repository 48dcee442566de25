"""Stop rules: golden sequences, plain-Python twins, and streams against batch."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lethe.streaming import rules, stream

GOLDEN = [(1, 0.95), (2, 0.96), (4, 0.97), (5, None), (7, 0.99), (8, 0.9), (9, 0.95)]
SCHEMA = "run_id string, pos bigint, global_step bigint, epoch double, reward double, idle double, tokens bigint"


def test_streak_golden(spark):
    df = spark.createDataFrame([("r", i, s, r) for i, (s, r) in enumerate(GOLDEN)], "run string, pos bigint, step bigint, reward double")
    for width in (1, 3, 100):
        out = rules.reward_streak(df, "run", "step", ["reward"], "pos", 0.9, 5, width).orderBy("pos").collect()
        assert [(r.streak, r.stop) for r in out] == [(1, False), (2, False), (4, False), (7, True), (0, False), (1, False)]


def test_no_learning_golden(spark):
    data = [(0.25, 0.9), (0.75, 1.0), (None, 0.95), (1.0, 1.0), (1.25, 0.2)]
    df = spark.createDataFrame([("r", i, i, e, f) for i, (e, f) in enumerate(data)], "run string, pos bigint, step bigint, epoch double, idle double")
    out = rules.no_learning(df, "run", "step", "epoch", "idle", "pos", 0.05, width=2).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.step, r.epoch, r.stop) == (3, 1.0, True) and r.first_epoch_active_group_rate_mean == pytest.approx(0.0375)
    marker = rules.stop_markers(rules.no_learning(df, "run", "step", "epoch", "idle", "pos", 0.05), "run").first()
    assert marker.reason == "no_learning_after_first_epoch" and marker.global_step == 3


def make_log(seed):
    rnd = random.Random(seed)
    rows, pos = [], 0
    state = {}
    for _ in range(600):
        run = "hot" if rnd.random() < 0.5 else f"r{rnd.randint(0, 5)}"
        step, epoch, tokens = state.get(run, (0, 0.0, 0))
        step, epoch, tokens = step + rnd.choice([0, 1, 1, 2, 5]), epoch + rnd.random() / 20, tokens + rnd.randint(0, 50)
        state[run] = (step, epoch, tokens)
        rows.append(
            (
                run, pos, step, rnd.choice([epoch, None]),
                rnd.choice([0.99, 0.97, 0.96, 0.5, None]), rnd.choice([0.9, 1.0, 0.963, None]), tokens,
            )
        )
        pos += 1
    return rows


def python_streaks(rows, threshold, limit):
    out, state = {}, {}
    for run, pos, step, _, reward, _, _ in rows:
        if reward is None:
            continue
        last, streak = state.get(run, (None, 0))
        moved = 1 if last is None else max(1, step - last)
        streak = streak + moved if reward > threshold else 0
        state[run] = (step, streak)
        out[pos] = (streak, streak > limit)
    return out


def python_checks(rows, threshold):
    out, state = {}, {}
    for run, _, step, epoch, _, idle, _ in rows:
        s = state.setdefault(run, {"epoch": None, "rates": [], "done": False})
        if epoch is not None:
            s["epoch"] = epoch
        if idle is None or s["epoch"] is None or s["done"]:
            continue
        if s["epoch"] <= 1.0:
            s["rates"].append(1.0 - idle)
        if s["epoch"] >= 1.0 and s["rates"]:
            s["done"] = True
            mean = sum(s["rates"]) / len(s["rates"])
            out[run] = (step, s["epoch"], pytest.approx(mean), mean <= threshold)
    return out


@pytest.mark.parametrize("seed,width,parts", [(1, 5, 1), (2, 50, 7), (3, 10_000, 3)])
def test_batch_rules_follow_python(spark, seed, width, parts):
    rows = make_log(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    streaks = rules.reward_streak(df, "run_id", "global_step", ["reward"], "pos", 0.95, 5, width)
    assert {r.pos: (r.streak, r.stop) for r in streaks.collect()} == python_streaks(rows, 0.95, 5)
    checks = rules.no_learning(df, "run_id", "global_step", "epoch", "idle", "pos", 0.05, width)
    got = {r.run_id: (r.step, r.epoch, r.first_epoch_active_group_rate_mean, r.stop) for r in checks.collect()}
    assert got == python_checks(rows, 0.05)
    reached = rules.token_milestones(df, "run_id", "global_step", "tokens", [3000, 100, 100])
    for r in reached.collect():
        assert r.step == min(x[2] for x in rows if x[0] == r.run_id and x[6] >= r.milestone)


def run_stream(spark, folder, build, mode):
    """Feed the log file by file and collect the emitted rows."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    emitted = []

    def keep(batch, _):
        emitted.extend(batch.collect())

    query = stream.start(build(source), f"test-{uuid.uuid4().hex}", keep, mode, available_now=True)
    query.awaitTermination(240)
    assert query.exception() is None
    return emitted


def test_streams_follow_batch(spark, tmp_path):
    rows = make_log(4)
    folder = str(tmp_path / "log")
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : (part + 1) * 200], SCHEMA).repartition(1).write.mode("append").parquet(folder)

    streaks = run_stream(
        spark, folder, lambda s: stream.streak_stream(s, "run_id", "global_step", ["reward"], "pos", 0.95, 5), "append"
    )
    assert {r.pos: (r.streak, r.stop) for r in streaks} == python_streaks(rows, 0.95, 5)

    checks = run_stream(
        spark, folder, lambda s: stream.no_learning_stream(s, "run_id", "global_step", "epoch", "idle", "pos", 0.05), "append"
    )
    got = {r.run_id: (r.step, r.epoch, r.first_epoch_active_group_rate_mean, r.stop) for r in checks}
    assert got == python_checks(rows, 0.05)

    batch = spark.createDataFrame(rows, SCHEMA)
    want = {(r.run_id, r.milestone): r.step for r in rules.token_milestones(batch, "run_id", "global_step", "tokens", [100, 500]).collect()}
    saved = run_stream(spark, folder, lambda s: stream.milestone_stream(s, "run_id", "global_step", "tokens", [100, 500]), "update")
    assert {(r.run_id, r.milestone): r.step for r in saved} == want
    stops = run_stream(spark, folder, lambda s: stream.budget_stream(s, "run_id", "global_step", "tokens", 500), "update")
    assert {(r.run_id, 500): r.step for r in stops} == {k: v for k, v in want.items() if k[1] == 500}


def test_rule_set(spark):
    rows = make_log(5)
    df = spark.createDataFrame(rows, SCHEMA)
    columns = {"tokens": "tokens", "epoch": "epoch", "zero_std": "idle", "rewards": ["reward"]}
    assert rules.apply_rules(df, {}, "run_id", "global_step", "pos", columns) is None
    out = rules.apply_rules(
        df, {"checkpoint_token_milestones": [100], "high_reward_stop": {}, "no_learning_stop": {"threshold": 0.05}},
        "run_id", "global_step", "pos", columns,
    )
    kinds = {r.rule for r in out.select("rule").distinct().collect()}
    assert kinds <= {"save_at_milestone", "high_reward_stop", "no_learning_stop"} and "save_at_milestone" in kinds


def test_evaluation_stop(spark):
    def decide(refusal, mean, full, *limits):
        cells = [None if v == "off" else F.lit(v).cast("double") for v in (refusal, mean, full)]
        return spark.range(1).select(rules.evaluation_stop(*cells, *limits).alias("x")).first().x

    assert decide(0.5, 0.6, "off", 0.5, 0.5) is True
    assert decide(0.5, 0.5, "off", 0.5, 0.5) is False
    assert decide(None, 0.9, "off", 0.5, 0.5) is False
    assert decide(0.5, "off", "off", 0.5, 0.5) is True
    assert decide("off", "off", 0.5, 0.5, 0.5) is False
    assert decide("off", "off", 0.6, 0.5, 0.5) is True
    assert decide("off", "off", "off", 0.5, 0.5) is False


def test_latest_streaks(spark):
    df = spark.createDataFrame([("r", i, s, r) for i, (s, r) in enumerate(GOLDEN)], "run string, pos bigint, step bigint, reward double")
    out = rules.latest_streaks(rules.reward_streak(df, "run", "step", ["reward"], "pos", 0.9, 5), "run", "pos")
    assert out.first().streak == 1
