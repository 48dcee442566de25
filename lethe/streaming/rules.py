"""Stop and milestone rules over trainer logs, in batch, keyed by run.

Every rule reads events in the order of a unique integer position. Running values come from
``lethe.functions.ordered``, so one very long run is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import ordered
from lethe.functions.ordered import Running

NO_LEARNING_REASON = "no_learning_after_first_epoch"


def token_milestones(
    log: DataFrame, run: str, step: str, tokens: str, milestones: Sequence[int]
) -> DataFrame:
    """First step at which the tokens seen reach each milestone; one event may reach several."""
    reached = F.filter(F.lit(sorted({int(m) for m in milestones})), lambda m: m <= F.coalesce(F.col(tokens), F.lit(0)))
    return (
        log.select(run, step, F.explode(reached.cast("array<bigint>")).alias("milestone"))
        .groupBy(run, "milestone")
        .agg(F.min(step).cast("bigint").alias("step"))
    )


def token_budget_stop(log: DataFrame, run: str, step: str, tokens: str, budget: int) -> DataFrame:
    """First step at which the token budget is used up."""
    return token_milestones(log, run, step, tokens, [budget]).drop("milestone")


def reward_streak(
    log: DataFrame,
    run: str,
    step: str,
    rewards: Sequence[str],
    position: str,
    threshold: float = 0.95,
    limit: int = 5,
    width: int = ordered.BUCKET_WIDTH,
) -> DataFrame:
    """Steps spent above the reward threshold in a row, and whether that exceeds the limit.

    The first reward present among ``rewards`` counts; events without any are left out. A
    step counts for the distance to the previous one, at least 1, and any reward at or below
    the threshold starts over.
    """
    bucket = ordered.position_bucket(F.col(position), width)
    scored = log.withColumn("__reward", F.coalesce(*[F.col(c) for c in rewards])).where(F.col("__reward").isNotNull())
    linked = ordered.running(
        scored, [run], [position], bucket, {"__previous": Running("last", F.col(step), exclusive=True)}
    )
    moved = linked.withColumns(
        {
            "__delta": F.when(F.col("__previous").isNull(), F.lit(1)).otherwise(
                F.greatest(F.lit(1), F.col(step) - F.col("__previous"))
            ).cast("bigint"),
            "__reset": F.col("__reward") <= threshold,
        }
    )
    # Steps so far, minus the steps so far at the latest reset.
    summed = ordered.running(moved, [run], [position], bucket, {"__upto": Running("sum", F.col("__delta"))})
    marked = ordered.running(
        summed, [run], [position], bucket, {"__mark": Running("max", F.when(F.col("__reset"), F.col("__upto")))}
    )
    streak = F.col("__upto") - F.coalesce("__mark", F.lit(0))
    return (
        marked.withColumn("streak", streak.cast("bigint"))
        .withColumn("stop", F.col("streak") > limit)
        .withColumnRenamed("__reward", "reward_used")
        .drop("__previous", "__delta", "__reset", "__upto", "__mark")
    )


def streak_stop(streaks: DataFrame, run: str, step: str, position: str) -> DataFrame:
    """The first event of each run at which the streak rule stops it."""
    first = F.min(F.when(F.col("stop"), F.struct(position, step, "streak")))
    return (
        streaks.groupBy(run)
        .agg(first.alias("__f"))
        .where(F.col("__f").isNotNull())
        .select(run, F.col(f"__f.{step}").alias("step"), F.col("__f.streak").alias("streak"))
    )


def no_learning(
    log: DataFrame,
    run: str,
    step: str,
    epoch: str,
    zero_std: str,
    position: str,
    threshold: float = 0.0,
    width: int = ordered.BUCKET_WIDTH,
) -> DataFrame:
    """Check once, at the first event that completes an epoch, whether a run learns at all.

    The share of prompt groups with a reward spread is averaged over the events up to epoch
    1; a mean at or below the threshold stops the run. The epoch carries forward; a run
    without such events by then is checked after its first one.
    """
    bucket = ordered.position_bucket(F.col(position), width)
    carried = ordered.running(
        log, [run], [position], bucket, {"__epoch": Running("last", F.col(epoch))}
    )
    events = carried.where(F.col(zero_std).isNotNull() & F.col("__epoch").isNotNull()).select(
        run,
        F.col(position).alias("__pos"),
        F.col(step).alias("step"),
        F.col("__epoch").alias("epoch"),
        (F.lit(1.0) - F.col(zero_std)).alias("__rate"),
    )
    sampled = F.col("epoch") <= 1.0
    # Samples up to and including each event; at the checked event these are all there are.
    summed = ordered.running(
        events,
        [run],
        ["__pos"],
        ordered.position_bucket(F.col("__pos"), width),
        {
            "__total": Running("sum", F.when(sampled, F.col("__rate"))),
            "__n": Running("sum", F.when(sampled, F.lit(1)).otherwise(F.lit(0))),
        },
    )
    due = (F.col("epoch") >= 1.0) & (F.col("__n") > 0)
    first = F.min(F.when(due, F.struct("__pos", "step", "epoch", "__total", "__n")))
    mean = F.col("__check.__total") / F.col("__check.__n")
    return (
        summed.groupBy(run)
        .agg(first.alias("__check"))
        .where(F.col("__check").isNotNull())
        .select(
            run,
            F.col("__check.step").alias("step"),
            F.col("__check.epoch").alias("epoch"),
            mean.alias("first_epoch_active_group_rate_mean"),
            F.lit(float(threshold)).alias("threshold"),
            (mean <= threshold).alias("stop"),
        )
    )


def stop_markers(checks: DataFrame, run: str) -> DataFrame:
    """One marker row per run that the no-learning check stops."""
    return checks.where("stop").select(
        run,
        F.lit(NO_LEARNING_REASON).alias("reason"),
        F.col("step").alias("global_step"),
        "first_epoch_active_group_rate_mean",
        "epoch",
        "threshold",
    )


def evaluation_stop(
    refusal_rate: Column | None,
    reward_mean: Column | None,
    reward_rate: Column | None,
    refusal_threshold: float,
    reward_threshold: float,
) -> Column:
    """Stop decision from evaluation metrics; a part that is not computed is passed as None.

    With both parts the refusal rate must reach its threshold and the mean reward exceed
    its own; with the judge alone the rate of full rewards must exceed it.
    """
    no = F.lit(False)
    refused = None if refusal_rate is None else F.coalesce(refusal_rate >= refusal_threshold, no)
    if refused is not None and reward_mean is not None:
        return refused & F.coalesce(reward_mean > reward_threshold, no)
    if refused is not None:
        return refused
    if reward_rate is not None:
        return F.coalesce(reward_rate > reward_threshold, no)
    return no


def apply_rules(log: DataFrame, config: dict, run: str, step: str, position: str, columns: dict[str, str]) -> DataFrame | None:
    """Decisions of all configured rules as (run, rule, step, value); absent rules are off.

    ``columns`` names the log columns: tokens, epoch, zero_std, and rewards as a list.
    """
    parts: list[DataFrame] = []

    def add(df: DataFrame, rule: str, value: Column) -> None:
        parts.append(
            df.select(
                F.col(run), F.lit(rule).alias("rule"), F.col("step").cast("bigint").alias("step"),
                value.cast("double").alias("value"),
            )
        )

    if config.get("checkpoint_token_milestones"):
        hits = token_milestones(log, run, step, columns["tokens"], config["checkpoint_token_milestones"])
        add(hits, "save_at_milestone", F.col("milestone"))
    if config.get("token_budget") is not None:
        stops = token_budget_stop(log, run, step, columns["tokens"], config["token_budget"])
        add(stops, "token_budget_stop", F.lit(float(config["token_budget"])))
    if config.get("high_reward_stop") is not None:
        own = config["high_reward_stop"]
        streaks = reward_streak(
            log, run, step, own.get("metric_names", columns["rewards"]), position,
            own.get("threshold", 0.95), own.get("max_optimizer_steps_above_threshold", 5),
        )
        add(streak_stop(streaks, run, step, position), "high_reward_stop", F.col("streak"))
    if config.get("no_learning_stop") is not None:
        checks = no_learning(
            log, run, step, columns["epoch"], columns["zero_std"], position,
            config["no_learning_stop"].get("threshold", 0.0),
        )
        add(checks.where("stop"), "no_learning_stop", F.col("first_epoch_active_group_rate_mean"))
    if not parts:
        return None
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged


def latest_streaks(streaks: DataFrame, run: str, position: str) -> DataFrame:
    """Streak of each run at its last scored event."""
    last = F.max(F.struct(F.col(position).alias("p"), F.col("streak").alias("streak")))
    return streaks.groupBy(run).agg(last["streak"].alias("streak"))


