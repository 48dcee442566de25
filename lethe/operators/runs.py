"""Generation logs: indices, recent steps and tables, inventories and metric curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import names, ordered
from lethe.operators.prepare import keep_first

# Axis limits and the metric drawn smoothed.
FIXED_LIMITS = {
    "train/reward": (0.0, 1.0),
    "active_group": (0.0, 1.0),
    "train/completions/mean_length": (0.0, 256.0),
}
SMOOTHED_METRIC = "train/kl"
SMOOTHING_WINDOW = 7


def eligible_runs(
    runs: DataFrame,
    equals: dict[str, object],
    candidates: Sequence[str] = ("name", "display_name", "id"),
    min_tables: int = 0,
    tables: str = "available_table_count",
) -> DataFrame:
    """Runs with the given settings, an eligible name and enough tables, with the chosen name.

    Meant to come before the join to the tables, so that only their rows are read.
    """
    kept = runs
    for column, value in equals.items():
        kept = kept.where(F.col(column) == value)
    found = [F.col(c) for c in candidates if c in runs.columns]
    kept = kept.where(names.is_eligible_run(*found)).withColumn("run_name", names.run_name(*found))
    return kept.where(F.col(tables) >= min_tables) if min_tables > 0 else kept


def consistent_models(runs: DataFrame, model: str, size: str) -> DataFrame:
    """Runs of a known size whose full model name, when it tells a size, is the standard one."""
    told = F.regexp_like(F.coalesce(F.col(model), F.lit("")), F.lit(r"(?i)Qwen2\.5-(0\.5B|1\.5B|3B|7B)-Instruct"))
    return runs.where(F.col(size).isNotNull() & (~told | (F.col(model) == names.model_name(F.col(size)))))


def recent_tables(tables: DataFrame, run: Sequence[str], name: str, limit: int) -> DataFrame:
    """Last ``limit`` tables per run by (number in the name, name); 0 or less keeps all."""
    keyed = tables.withColumn("__number", names.table_number(F.col(name)))
    if limit <= 0:
        return keyed.drop("__number")
    newest = Window.partitionBy(*run).orderBy(F.desc("__number"), F.desc(name))
    return keyed.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= limit).drop("__rn", "__number")


def table_order(tables: DataFrame, run: Sequence[str], name: str) -> DataFrame:
    """Position of each table of a run, oldest first."""
    oldest = Window.partitionBy(*run).orderBy(names.table_number(F.col(name)), F.col(name))
    return tables.withColumn("table_order", F.dense_rank().over(oldest) - 1)


def add_prompt_index(
    df: DataFrame,
    run: Sequence[str],
    prompt: str = "prompt",
    position: str = "pos",
    width: int = ordered.BUCKET_WIDTH,
) -> DataFrame:
    """Number the prompts of a step by first appearance."""
    group = [*run, "step"]
    firsts = df.groupBy(*group, prompt).agg(F.min(position).alias("__first"))
    numbered = ordered.row_index(
        firsts, group, ["__first"], ordered.position_bucket(F.col("__first"), width), "prompt_index"
    ).drop("__first")
    # Structs compare equal where both have nulls: rows without a prompt or a key keep their place.
    cell = F.struct(*[F.col(c) for c in (*group, prompt)])
    numbers = numbered.select(cell.alias("__cell"), "prompt_index")
    return df.withColumn("__cell", cell).join(numbers, "__cell").drop("__cell")


def add_completion_index(
    df: DataFrame,
    run: Sequence[str],
    prompt_index: str = "prompt_index",
    position: str = "pos",
    width: int = ordered.BUCKET_WIDTH,
) -> DataFrame:
    """Running number of the completions of one prompt in one step."""
    return ordered.row_index(
        df,
        [*run, "step", prompt_index],
        [position],
        ordered.position_bucket(F.col(position), width),
        "completion_index",
    )


def add_missing_indices(df: DataFrame, run: Sequence[str], position: str = "pos") -> DataFrame:
    if "prompt_index" not in df.columns:
        df = add_prompt_index(df, run, position=position)
    if "completion_index" not in df.columns:
        df = add_completion_index(df, run, position=position)
    return df


def _last(steps: DataFrame, run: Sequence[str], limit: int) -> DataFrame:
    """Number the steps of a run from both ends and keep the last ``limit``.

    The rank filter is applied before the shuffle too, so a run with many steps sends only
    ``limit`` rows per task.
    """
    newest = Window.partitionBy(*run).orderBy(F.desc("step"))
    ranked = steps.withColumn("step_from_end", F.row_number().over(newest).cast("bigint"))
    if limit > 0:
        ranked = ranked.where(F.col("step_from_end") <= limit)
    count = F.max("step_from_end").over(Window.partitionBy(*run))
    return ranked.withColumn("last_step_index", count - F.col("step_from_end") + 1)


def last_steps(df: DataFrame, run: Sequence[str], limit: int) -> DataFrame:
    """Rows of the last ``limit`` distinct steps of every run, with both step numbers."""
    steps = df.where(F.col("step").isNotNull()).select(*run, "step").distinct()
    return df.join(_last(steps, run, limit), [*run, "step"])


def latest_table(df: DataFrame, run: Sequence[str], order: str = "table_order") -> DataFrame:
    """Rows of the newest table holding each step."""
    newest = df.groupBy(*run, "step").agg(F.max(order).alias(order))
    return df.join(newest, [*run, "step", order], "left_semi")


def select_log_rows(
    df: DataFrame,
    run: Sequence[str],
    limit: int,
    order: str = "table_order",
    position: str = "pos",
    deduplicate: bool = False,
) -> DataFrame:
    """Last steps, newest table per step, and optionally one row per prompt and completion.

    One aggregation finds both the steps and their newest tables.
    """
    missing = {"step", "prompt", "completion"} - set(df.columns)
    if missing:
        raise ValueError(f"log is missing columns: {sorted(missing)}")
    newest = df.where(F.col("step").isNotNull()).groupBy(*run, "step").agg(F.max(order).alias(order))
    chosen = df.join(_last(newest, run, limit), [*run, "step", order])
    if deduplicate:
        chosen = keep_first(chosen, [*run, "prompt", "completion"], position)
    return chosen


def unique_prompts(df: DataFrame, run: Sequence[str]) -> DataFrame:
    return df.groupBy(*run).agg(F.count_distinct("prompt").alias("unique_prompt_count"))


def run_inventory(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: steps, prompts, rows, prompts per step.

    Built from (run, step) counts, so lists hold one entry per step and never raw rows.
    """
    run = list(run)
    per_prompt = df.groupBy(*run, "step", "prompt").agg(F.count(F.lit(1)).alias("rows"))
    per_step = per_prompt.groupBy(*run, "step").agg(
        F.count("prompt").alias("prompts"), F.sum("rows").alias("rows")
    )
    prompts = per_prompt.groupBy(*run).agg(F.count_distinct("prompt").alias("selected_unique_prompt_count"))
    indexed = (
        df.select(*run, "step", "prompt_index").distinct().groupBy(*run).agg(
            F.count(F.lit(1)).alias("selected_prompt_count")
        )
    )
    steps = F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "prompts"))))
    summary = per_step.groupBy(*run).agg(
        F.count("step").alias("selected_step_count"),
        F.sum("rows").alias("selected_completion_count"),
        steps.alias("__steps"),
    )
    return (
        summary.join(prompts, run)
        .join(indexed, run)
        .withColumn("selected_steps", F.transform("__steps", lambda s: s["step"]))
        .withColumn("selected_unique_prompts_by_step", F.map_from_entries("__steps"))
        .drop("__steps")
    )


def inventory_totals(inventory: DataFrame, by: Sequence[str], run_id: str = "run_id") -> DataFrame:
    counts = [
        "selected_completion_count",
        "selected_prompt_count",
        "selected_unique_prompt_count",
    ]
    return inventory.groupBy(*by).agg(
        F.count_distinct(run_id).alias("run_count"),
        *[F.sum(c).alias(c) for c in counts if c in inventory.columns],
    )


def sampled_history(history: DataFrame, by: Sequence[str], step: str, samples: int = 500) -> DataFrame:
    """At most ``samples`` points per run: every point of a short run, else points at even ranks, both ends included.

    ``step`` is unique in a run. Rows are ranked in buckets of the step, so that a run that holds most rows is spread.
    """
    if samples < 2:
        raise ValueError("a sample needs at least its two ends")
    placed = ordered.row_index(history, by, [step], ordered.identity_bucket(history, step), "__i", "__n")
    steps, last = samples - 1, F.col("__n") - 1
    # The first of the even ranks that is not below the row's own must be its own.
    even = F.floor((F.col("__i") * steps + last - 1) / last)
    chosen = F.floor(even * last / steps) == F.col("__i")
    return placed.where((F.col("__n") <= samples) | chosen).select(*history.columns)


def metric_points(
    history: DataFrame, identity: Sequence[str], step: str, zero_std: str, metrics: dict[str, str]
) -> DataFrame:
    """Wide metric history to one row per metric and step; non-finite values are left out.

    ``active_group`` is the share of prompt groups with a reward spread.
    """
    wide = history.select(
        *identity,
        names.finite(F.col(step).cast("double")).alias("train_global_step"),
        *[names.finite(F.col(c).cast("double")).alias(m) for m, c in metrics.items()],
        (F.lit(1.0) - names.finite(F.col(zero_std).cast("double"))).alias("active_group"),
    ).where(F.col("train_global_step").isNotNull())
    long = wide.unpivot(
        [*identity, "train_global_step"], [*metrics, "active_group"], "metric", "value"
    )
    return long.where(F.col("value").isNotNull())


def metric_curves(points: DataFrame, by: Sequence[str], run_id: str = "run_id") -> DataFrame:
    """Mean, sample deviation and number of runs per series and step."""
    group = [*by, "metric", "train_global_step"]
    return points.groupBy(*group).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count_distinct(run_id).alias("n"),
    )


def smoothed_curves(
    curves: DataFrame, series: Sequence[str], step: str = "train_global_step", window: int = SMOOTHING_WINDOW
) -> DataFrame:
    """Centered rolling medians of mean and deviation along each series."""
    return ordered.centered_median(
        curves,
        series,
        [step],
        ordered.position_bucket(F.col(step), 10_000),
        {"smooth_mean": F.col("mean"), "smooth_std": F.coalesce(F.col("std"), F.lit(0.0))},
        window,
    )


def axis_bounds(
    curves: DataFrame,
    panel: Sequence[str],
    series: Sequence[str],
    smoothed: Column | None = None,
) -> DataFrame:
    """Lower and upper axis limit per panel and metric.

    Limits enclose mean ± deviation with five percent padding, start at zero at the lowest,
    and are fixed for some metrics. ``smoothed`` marks the rows of smoothed metrics.
    """
    smoothed = F.col("metric") == SMOOTHED_METRIC if smoothed is None else smoothed
    flagged = curves.withColumn("__smooth", smoothed)
    raw = flagged.where(~F.col("__smooth")).select(
        *panel, "metric", F.col("mean").alias("m"), F.coalesce("std", F.lit(0.0)).alias("s")
    )
    soft = smoothed_curves(flagged.where("__smooth"), [*panel, *series, "metric"]).select(
        *panel, "metric", F.col("smooth_mean").alias("m"), F.col("smooth_std").alias("s")
    )
    limits = (
        raw.unionByName(soft)
        .groupBy(*panel, "metric")
        .agg(
            F.greatest(F.lit(0.0), F.min(F.col("m") - F.col("s"))).alias("lower"),
            F.max(F.col("m") + F.col("s")).alias("upper"),
        )
    )
    low, high = F.col("lower"), F.col("upper")
    flat = high <= low
    padding = (
        F.when(flat & (high == 0.0), F.lit(0.05)).when(flat, F.abs(high) * 0.05).otherwise((high - low) * 0.05)
    )
    padded = limits.select(
        *panel,
        "metric",
        F.greatest(F.lit(0.0), low - padding).alias("lower"),
        (high + padding).alias("upper"),
    )
    for metric, (a, b) in FIXED_LIMITS.items():
        fixed = F.col("metric") == metric
        padded = padded.withColumns(
            {
                "lower": F.when(fixed, F.lit(a)).otherwise(F.col("lower")),
                "upper": F.when(fixed, F.lit(b)).otherwise(F.col("upper")),
            }
        )
    return padded
