"""Result tables: means by level, baseline deltas, imputation, coverage and report cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions import names, ordered

# Metrics where high is good, and where high is bad.
GOOD_HIGH = ("broad_topic_helpfulness", "refusal")
BAD_HIGH = ("lexical_leakage", "semantic_leakage", "prompt_helpfulness", "language_drift")
GREEN, AMBER, RED = "#167c3b", "#946200", "#b42318"
# Benchmark splits, summary columns and their labels.
FORGET_SPLITS = ("forget_level1", "forget_level2", "forget_level3")
NEIGHBOR_SPLITS = ("neighbor_level1", "neighbor_level2")
SUMMARY_SPLITS = {
    "forget_fb": "forget_level1",
    "forget_qa": "forget_level2",
    "forget_aa": "forget_level3",
    "neighbor_fb": "neighbor_level1",
    "neighbor_qa": "neighbor_level2",
    "mia_fm": "mia_forget",
    "mia_rm": "mia_retain",
    "utility_ga": "utility_general",
    "utility_ra": "utility_reason",
    "utility_tru": "utility_truthfulness",
    "utility_fac": "utility_factuality",
    "utility_flu": "utility_fluency",
}
SUMMARY_LABELS = {
    "forget_fb": "Forget Set FB down",
    "forget_qa": "Forget Set QA down",
    "forget_aa": "Forget Set AA down",
    "neighbor_fb": "Neighbor Set FB up",
    "neighbor_qa": "Neighbor Set QA up",
    "mia_fm": "MIA Set FM up",
    "mia_rm": "MIA Set RM down",
    "utility_ga": "Utility Set GA up",
    "utility_ra": "Utility Set RA up",
    "utility_tru": "Utility Set TRU up",
    "utility_fac": "Utility Set FAC up",
    "utility_flu": "Utility Set FLU up",
}


def _present(columns: Sequence[str]) -> Column:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return keep


def overlap_summary(
    rows: DataFrame,
    score: str,
    split: str = "split",
    kind: str = "type",
    subject: str = "subject",
    forget: Sequence[str] = FORGET_SPLITS,
    neighbor: Sequence[str] = NEIGHBOR_SPLITS,
) -> DataFrame:
    """Count and mean overall, for forget and neighbor splits, and by split, type, subject.

    The rows are read once and reduced to (split, type, subject) sums; the grouping sets expand
    that small table, and their grand total carries the forget and neighbor sums. A null key has
    no group of its own.
    """
    base = rows.groupBy(split, kind, subject).agg(
        F.sum(score).alias("__sum"), F.count(score).alias("__n"), F.count(F.lit(1)).alias("__rows")
    )
    # One row that counts nothing gives an empty table its grand total.
    nothing = rows.sparkSession.range(1).select(
        *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns[:4]], *[F.lit(0).cast("long").alias(c) for c in base.columns[4:]]
    )
    base = base.unionByName(nothing)
    chosen = {
        "overall": F.lit(True),
        "forget": F.col(split).isin(list(forget)),
        "neighbor": F.col(split).isin(list(neighbor)),
    }
    sums = {f"__{name}_{c}": F.sum(F.when(keep, F.col(f"__{c}"))) for name, keep in chosen.items() for c in ("sum", "n", "rows")}
    grouped = base.groupingSets(
        [[split], [split, kind], [split, subject], []], split, kind, subject
    ).agg(
        *[F.grouping(c).alias(f"__no_{name}") for name, c in (("split", split), ("kind", kind), ("subject", subject))],
        *[c.alias(name) for name, c in sums.items()],
    )
    whole = F.col("__no_split") == 1
    real = F.lit(True)
    for name, column in (("split", split), ("kind", kind), ("subject", subject)):
        real = real & (F.col(column).isNotNull() | (F.col(f"__no_{name}") == 1))
    level = (
        F.when(F.col("__no_kind") == 0, "by_split_and_type")
        .when(F.col("__no_subject") == 0, "by_subject")
        .otherwise("by_split")
    )

    def entry(name: Column, part: str, rows_: str) -> Column:
        return F.struct(
            name.alias("level"),
            F.coalesce(F.col(f"__{part}_{rows_}"), F.lit(0)).alias("n"),
            F.when(F.col(f"__{part}_n") > 0, F.col(f"__{part}_sum") / F.col(f"__{part}_n")).alias("score"),
        )

    totals = F.array(*[entry(F.lit(name), name, "rows") for name in chosen])
    entries = F.when(whole, totals).otherwise(F.array(entry(level, "overall", "n")))
    return grouped.where(real).select(
        F.col(split).alias("split"), F.col(kind).alias("type"), F.col(subject).alias("subject"), F.explode(entries).alias("e")
    ).select("e.level", "split", "type", "subject", "e.n", "e.score")


def membership_summary(
    rows: DataFrame, metrics: Sequence[str], split: str = "split", subject: str | None = "subject"
) -> DataFrame:
    """Loss summed per subject, averaged over subjects, with per-row means and counts.

    A null subject is a subject of its own for the sums. When the table has no subject at
    all, the split total is reported.
    """
    known = subject is not None and subject in rows.columns
    keyed = rows.where(F.col(split).isNotNull()).withColumn(
        "__subject", F.col(subject).cast("string") if known else F.lit(None).cast("string")
    )
    per_subject = keyed.groupBy(split, "__subject").agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"__s_{m}") for m in metrics],
        *[F.count(m).alias(f"__n_{m}") for m in metrics],
    )
    # Where no subject exists there is one (null) subject per split, whose mean is the total.
    columns = [F.sum("__rows").alias("n"), F.count("__subject").alias("subjects")]
    for m in metrics:
        columns.append(F.avg(f"__s_{m}").alias(m))
        columns.append(F.try_divide(F.sum(f"__s_{m}"), F.sum(f"__n_{m}")).alias(f"{m}_per_example"))
    return per_subject.groupBy(split).agg(*columns)


def mean_by(rows: DataFrame, by: Sequence[str], value: str, count: str = "n", mean: str = "score") -> DataFrame:
    return rows.where(_present(by)).groupBy(*by).agg(F.count(value).alias(count), F.avg(value).alias(mean))


def summary_row(
    by_split: DataFrame,
    model_label: Column,
    split: str = "split",
    value: str = "score",
    columns: dict[str, str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key with a column per split; an absent split is NA."""
    columns = SUMMARY_SPLITS if columns is None else columns
    cells = [
        F.max(F.when(F.col(split) == name, F.col(value))).alias(f"__{label}") for label, name in columns.items()
    ]
    wide = by_split.groupBy(*keys).agg(*cells)
    return wide.select(
        *keys, model_label.alias("model"), *[score_cell(F.col(f"__{c}")).alias(c) for c in columns]
    )


def model_label(label: Column, path: Column) -> Column:
    """The given label, else the last folder of the model path, else the path."""
    base = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(base, F.lit("")), path)


def group_stats(
    rows: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str],
    std_suffix: str = "_std",
    mean_suffix: str = "",
    count_suffix: str | None = None,
) -> DataFrame:
    """Mean and sample deviation per metric, nulls ignored; the deviation of one value is null."""
    columns = []
    for m in metrics:
        columns.append(F.avg(m).alias(f"{m}{mean_suffix}"))
        columns.append(F.stddev_samp(m).alias(f"{m}{std_suffix}"))
        if count_suffix:
            columns.append(F.count(m).alias(f"{m}{count_suffix}"))
    return rows.groupBy(*by).agg(*columns)


def author_means(summaries: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Across-author mean and deviation of the 'mean' rows per model and reward."""
    label = names.model_and_reward(F.col("model_name_or_path"))
    means = summaries.where(F.col("stat") == "mean").select(
        label["model"].alias("model_name_or_path"), label["reward"].alias("reward_function"), *metrics
    )
    return group_stats(means, ["model_name_or_path", "reward_function"], metrics, "_std_across_authors")


def _labels(column: str) -> Column:
    distinct = F.sort_array(F.collect_set(F.coalesce(F.col(column), F.lit(""))))
    return F.array_join(distinct, "|")


def reward_table(
    rows: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str] = ("reward_type", "model_size", "rlvr_mode"),
    labels: dict[str, str] | None = None,
    order: str = "run_name",
) -> DataFrame:
    """Run counts by provenance, joined labels and metric statistics per group.

    ``labels`` maps an output column to the label column listed in it.
    """
    labels = {
        "training_variants": "training_variant",
        "forget_concepts": "forget_concept",
        "run_names": "run_name",
        "experiment_seeds": "experiment_seed",
    } if labels is None else labels
    counts = [
        F.min_by("model_name_or_path", F.col(order)).alias("model_name_or_path"),
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.coalesce("result_source", F.lit("observed")) == "observed").alias("observed_run_count"),
        F.count_if(F.col("run_status") == "no-learning").alias("no_learning_count"),
        F.count_if(F.col("result_source") == "baseline-imputed").alias("baseline_imputed_count"),
    ]
    stats = []
    for m in metrics:
        stats += [F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_across_runs_std")]
    return rows.groupBy(*by).agg(*counts, *[_labels(c).alias(o) for o, c in labels.items()], *stats)


def warmup_table(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Across-author statistics of the warm-up runs by model size."""
    warm = rows.where(F.col("training_variant") == "r2-warmup")
    stats = []
    for m in metrics:
        stats += [F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_across_authors_std")]
    return warm.groupBy("model_size").agg(
        F.min_by("model_name_or_path", "run_name").alias("model_name_or_path"),
        F.count(F.lit(1)).alias("author_count"),
        *stats,
    )


def add_provenance(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"result_source": F.lit("observed"), "run_status": F.lit("observed"), "stop_reason": F.lit("")}
    )


def impute_stopped_runs(
    rows: DataFrame,
    markers: DataFrame,
    keys: Sequence[str] = ("concept_key", "training_variant", "model_size", "reward_type"),
    baseline_keys: Sequence[str] = ("concept_key", "model_size"),
) -> DataFrame:
    """Add a copy of the baseline row for every stopped run that has no result.

    ``markers`` holds the keys, ``run_name`` and ``reason``; a marker without a baseline is
    left out.
    """
    keys, baseline_keys = list(keys), list(baseline_keys)
    shared = [c for c in rows.columns if c not in (*keys, "rlvr_mode", "run_name", "result_source", "run_status", "stop_reason")]
    baseline = (
        rows.where(F.col("training_variant") == "baseline")
        .groupBy(*baseline_keys)
        .agg(F.max_by(F.struct(*[F.col(c) for c in shared]), "run_name").alias("__b"))
    )
    unseen = markers.join(rows.select(*keys).distinct(), keys, "left_anti")
    mode = F.when(F.col("training_variant") == "original", "zero-RLVR").otherwise("warm-up")
    imputed = unseen.join(baseline, baseline_keys).select(
        *keys,
        mode.alias("rlvr_mode"),
        "run_name",
        *[F.col(f"__b.{c}").alias(c) for c in shared],
        F.lit("baseline-imputed").alias("result_source"),
        F.lit("no-learning").alias("run_status"),
        F.coalesce("reason", F.lit("")).alias("stop_reason"),
    )
    return rows.unionByName(imputed.select(*rows.columns))


def baseline_deltas(
    trained: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    composites: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Trained minus baseline per metric; a second baseline for one key is an error.

    A composite is the mean of its deltas and null unless all of them exist.
    """
    keys = list(keys)
    one = baseline.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(m).alias(f"__b_{m}") for m in metrics]
    )
    duplicate = F.raise_error(F.concat(F.lit("duplicate baseline for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    # The test sits in a key of the join, which no later selection can prune.
    kind = one.schema[keys[0]].dataType
    checked = one.select(
        F.when(F.col("__n") > 1, duplicate.cast(kind)).otherwise(F.col(keys[0])).alias(keys[0]),
        *keys[1:],
        *[f"__b_{m}" for m in metrics],
    )
    deltas = trained.join(checked, keys).withColumns(
        {f"{m}_delta": F.col(m) - F.col(f"__b_{m}") for m in metrics}
    )
    for name, parts in (composites or {}).items():
        total = F.col(f"{parts[0]}_delta")
        for p in parts[1:]:
            total = total + F.col(f"{p}_delta")
        deltas = deltas.withColumn(f"{name}_delta", total / len(parts))
    return deltas.drop(*[f"__b_{m}" for m in metrics])


def unmatched(trained: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trained rows without a baseline."""
    return trained.join(baseline.select(*keys), list(keys), "left_anti")


def require_all_matched(trained: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    examples = [r.asDict() for r in unmatched(trained, baseline, keys).select(*keys).limit(10).collect()]
    if examples:
        raise ValueError(f"results without a matching baseline, for example {examples}")
    return trained


def author_table(deltas: DataFrame, by: Sequence[str], author: str, metrics: Sequence[str]) -> DataFrame:
    """Distinct authors, and per metric its mean, deviation and number of values."""
    stats = []
    for m in metrics:
        stats += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_samp(m).alias(f"{m}_std_across_authors"),
            F.count(m).alias(f"{m}_author_count"),
        ]
    return deltas.groupBy(*by).agg(F.count_distinct(author).alias("author_count"), *stats)


def mean_table(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], count: str) -> DataFrame:
    """Means and row count per group in one aggregation; null keys have no group."""
    return rows.where(_present(by)).groupBy(*by).agg(
        *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics], F.count(F.lit(1)).alias(count)
    )


def hierarchical_means(
    rows: DataFrame, levels: Sequence[tuple[Sequence[str], str]], metrics: Sequence[str]
) -> list[DataFrame]:
    """Means of means: each level averages the rows of the level before it."""
    tables, current = [], rows
    for by, count in levels:
        current = mean_table(current, by, metrics, count)
        tables.append(current)
    return tables


def median_iqr(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Quartiles per group and metric, exact, with linear interpolation.

    All metrics go through one long table, so more metrics add no further pass.
    """
    groups = rows.where(_present(by))
    long = groups.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(by), list(metrics), "__metric", "__value"
    )
    quartiles = ordered.exact_quantiles(
        long, [*by, "__metric"], "__value", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    counts = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))
    cells = [
        F.max(F.when(F.col("__metric") == m, F.col(q))).alias(f"{m}_{q}")
        for m in metrics
        for q in ("q1", "median", "q3")
    ]
    return counts.join(quartiles.groupBy(*by).agg(*cells), list(by), "left")


def metric_means(rows: DataFrame, metrics: Sequence[str], metadata: dict[str, str] | None = None) -> DataFrame:
    """One 'mean' row over the metrics that exist, led by the metadata."""
    present = [m for m in metrics if m in rows.columns]
    means = rows.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in present])
    return means.select(
        *[F.lit(v).alias(k) for k, v in (metadata or {}).items()], F.lit("mean").alias("stat"), *present
    )


def completion_stats(rows: DataFrame, metrics: Sequence[str], concept: str, run: str, reward: str) -> DataFrame:
    """Mean and deviation per run, and per reward over all runs (run 'all')."""
    present = [m for m in metrics if m in rows.columns]
    if not present:
        raise ValueError("no reward or judge metric to aggregate")
    stats = []
    for m in present:
        value = F.col(m).cast("double")
        stats += [F.stddev_samp(value).alias(f"{m}_std"), F.avg(value).alias(f"{m}_mean")]
    grouped = rows.where(_present([concept, run, reward])).groupingSets(
        [[concept, run, reward], [concept, reward]], concept, run, reward
    ).agg(F.grouping(run).alias("__g"), *stats)
    shown = F.when(F.col("__g") == 1, "all").otherwise(F.col(run).cast("string"))
    return grouped.withColumn(run, shown).drop("__g")


def subject_coverage(
    rows: DataFrame, subject: str, split: str, groups: dict[str, Sequence[str]], allowed: DataFrame | None = None
) -> DataFrame:
    """Rows per subject in each split group, their total and smallest count."""
    if allowed is not None:
        rows = rows.join(allowed.select(subject).distinct(), subject, "left_semi")
    counts = [F.count_if(F.col(split).isin(list(s))).alias(g) for g, s in groups.items()]
    every = [s for part in groups.values() for s in part]
    wide = rows.where(F.col(split).isin(every)).groupBy(subject).agg(*counts)
    total = F.col(next(iter(groups)))
    for g in list(groups)[1:]:
        total = total + F.col(g)
    return wide.withColumns({"balanced_min": F.least(*groups), "total": total})


def top_subjects(coverage: DataFrame, subject: str, groups: Sequence[str], k: int) -> DataFrame:
    keys = ["balanced_min", "total", *groups, subject]
    return coverage.orderBy(*[F.desc(c) for c in keys]).limit(k)


def evaluation_metrics(
    rows: DataFrame,
    prompt: str,
    by: Sequence[str] = (),
    refusal: str | None = "has_refusal",
    reward: str | None = "reward",
    flags: dict[str, str] | None = None,
) -> DataFrame:
    """Refusal counts and rates by prompt and completion, reward mean and full-reward rate,
    and the true-rate of each flag; ``flags`` maps an output name to a boolean column."""
    firsts, finals = [], []
    if refusal:
        firsts += [F.max(refusal).alias("__any"), F.count(refusal).alias("__cn"), F.count_if(refusal).alias("__cr")]
        refused = F.count_if("__any")
        finals += [
            refused.alias("refusal_prompt_count"),
            (refused / F.count(F.lit(1))).alias("refusal_prompt_rate"),
            F.sum("__cr").alias("refusal_completion_count"),
            F.try_divide(F.sum("__cr"), F.sum("__cn")).alias("refusal_completion_rate"),
        ]
    if reward:
        firsts += [
            F.sum(reward).alias("__rs"),
            F.count(reward).alias("__rn"),
            F.count_if(F.col(reward) == 1.0).alias("__r1"),
        ]
        finals += [
            F.try_divide(F.sum("__rs"), F.sum("__rn")).alias("reward_mean"),
            F.try_divide(F.sum("__r1"), F.sum("__rn")).alias("reward_rate"),
        ]
    for name, column in (flags or {}).items():
        firsts += [F.count(column).alias(f"__fn_{name}"), F.count_if(column).alias(f"__ft_{name}")]
        finals.append(F.try_divide(F.sum(f"__ft_{name}"), F.sum(f"__fn_{name}")).alias(name))
    return rows.groupBy(*by, prompt).agg(*firsts).groupBy(*by).agg(*finals)


def leak_report(rows: DataFrame, reward: str, run: str, exact: str = "exact_count", near: str = "near_count") -> DataFrame:
    """Exact and fuzzy-only leakage per run, and per reward with the deviation of run rates."""
    found, close = F.col(exact) > 0, F.col(near) > 0
    per_run = rows.groupBy(reward, run).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(found).alias("exact_entity_rows"),
        F.count_if(close).alias("near_target_rows"),
        F.count_if(close & ~found).alias("near_without_exact_rows"),
    )
    # The per-run rows are rolled up in one pass; a single run has no deviation.
    rated = per_run.withColumn("__rate", F.col("near_without_exact_rows") / F.col("total_rows"))
    sums = ["total_rows", "exact_entity_rows", "near_target_rows", "near_without_exact_rows"]
    rolled = rated.groupingSets([[reward, run], [reward]], reward, run).agg(
        F.grouping(run).alias("__all"),
        *[F.sum(c).alias(c) for c in sums],
        F.stddev_samp("__rate").alias("near_without_exact_rate_std"),
    )
    return rolled.withColumns(
        {
            run: F.when(F.col("__all") == 1, "all").otherwise(F.col(run).cast("string")),
            "near_without_exact_rate": F.col("near_without_exact_rows") / F.col("total_rows"),
        }
    ).drop("__all")


def prompt_groups(rows: DataFrame, prompt: str, position: str) -> DataFrame:
    """Add the position at which each prompt first appears and the place within its prompt.

    Ordering by both lists the completions prompt by prompt, first seen first; a prompt
    with very many completions is never gathered into one list.
    """
    firsts = rows.groupBy(prompt).agg(F.min(position).alias("first_position"))
    placed = ordered.row_index(rows, [prompt], [position], ordered.position_bucket(F.col(position)), "completion_index")
    return placed.join(firsts, prompt)


def summary_wide(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One row per key with a ``metric_stat`` column for every metric and statistic."""
    cells = [
        F.max(F.when(F.trim("stat") == s, F.col(m))).alias(f"{m}_{s}") for s in stats for m in metrics
    ]
    return rows.groupBy(*keys).agg(*cells)


def named_scalars(rows: DataFrame, scope: str, split: str, metrics: Sequence[str]) -> DataFrame:
    """``scope/split/metric`` and value, nulls left out."""
    long = rows.select(split, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [split], list(metrics), "__metric", "value"
    )
    name = F.concat_ws("/", F.lit(scope), F.col(split), F.col("__metric"))
    return long.where(F.col("value").isNotNull()).select(name.alias("name"), "value")


def mean_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_mean")]


def numeric_columns(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Columns outside ``skip`` with at least one readable number; one aggregate finds them."""
    candidates = [c for c in df.columns if c not in skip]
    if not candidates:
        return []
    counts = df.agg(*[F.count(names.number(F.col(c).cast("string"))).alias(c) for c in candidates]).first()
    return [c for c in candidates if counts[c] > 0]


def union_ordered(frames: Sequence[DataFrame], preferred: Sequence[str] = ()) -> DataFrame:
    """Union by name; preferred columns first, then the others as first seen."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    first = [c for c in preferred if c in merged.columns]
    return merged.select(*first, *[c for c in merged.columns if c not in first])


def fixed_cell(value: Column, digits: int = 8) -> Column:
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value))


def score_cell(value: Column) -> Column:
    """Three decimals without a leading zero; NA when absent."""
    text = F.regexp_replace(F.format_string("%.3f", value), r"^(-?)0\.", "$1.")
    return F.when(value.isNull(), "NA").otherwise(text)


def mean_std_cell(mean: Column, std: Column, sign: str = "±") -> Column:
    with_std = F.concat(F.format_string("%.3f", mean), F.lit(f" {sign} "), F.format_string("%.3f", std))
    plain = F.format_string("%.3f", mean)
    return F.when(mean.isNull(), "NA").when(std.isNull(), plain).otherwise(with_std)


def metric_color(metric: Column, value: Column) -> Column:
    """Traffic-light color by metric direction."""
    good = F.when(value >= 0.9, GREEN).when(value >= 0.7, AMBER).otherwise(RED)
    bad = F.when(value <= 0.1, GREEN).when(value <= 0.3, AMBER).otherwise(RED)
    known = F.when(metric.isin(*GOOD_HIGH), good).when(metric.isin(*BAD_HIGH), bad)
    return F.when(value.isNotNull(), known)


def metric_cell(metric: Column, mean: Column, std: Column) -> Column:
    text = F.when(mean.isNull(), "").otherwise(mean_std_cell(mean, std, "+/-"))
    color = metric_color(metric, mean)
    return F.when(color.isNull(), text).otherwise(
        F.concat(F.lit('<span style="color:'), color, F.lit('">'), text, F.lit("</span>"))
    )
