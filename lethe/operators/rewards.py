"""Reward compositions over (prompt, completion) rows; each adds a ``reward`` column.

Extra columns take the place of per-row logs, and ``reward_means`` of logged metrics.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import fuzzy, matching, scores
from lethe.functions.text import py_round, word_count
from lethe.operators.scoring import Scorer, score_rows

JUDGMENT_SCHEMA = T.StructType([T.StructField(f, T.BooleanType()) for f in scores.JUDGMENT_FIELDS])


def require_pairs(df: DataFrame, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """A prompt without a completion, or the reverse, is an error, whichever of these columns and the reward is read."""
    broken = F.col(prompt).isNull() != F.col(completion).isNull()
    error = F.raise_error(F.lit("prompt and completion must come in pairs"))
    checked = [c for c in (completion, "reward") if c in df.columns]
    return df.withColumns({c: F.when(broken, error.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in checked})


def exact_reward(
    df: DataFrame,
    patterns: DataFrame,
    completion: str = "completion",
    key: str = "id",
    concept: str | None = None,
    mode: str = "binary",
    min_words: int = 50,
    length_alpha: float = 20.0,
    alpha: float = 1.0,
) -> DataFrame:
    """Whole-word leakage: entities found, their count, the word count and the score.

    The count modes by occurrence list an entity once per occurrence.
    """
    found = matching.with_matches(df, patterns, completion, key, concept)
    repeat = mode in ("exponential", "length_aware")
    distinct = matching.distinct_count(F.col("matches"))
    occurrences = matching.occurrence_count(F.col("matches"))
    words = F.coalesce(word_count(F.col(completion)), F.lit(0))
    return found.withColumns(
        {
            "forgetting_entities": matching.entity_names(F.col("matches"), repeat),
            "forgetting_entity_count": occurrences if repeat else distinct,
            "forgetting_word_count": words,
            "forgetting_reward": matching.forgetting_score(
                mode, distinct, occurrences, words, min_words, length_alpha, alpha
            ),
        }
    ).drop("matches")


def fuzzy_reward(
    df: DataFrame,
    patterns: DataFrame,
    completion: str = "completion",
    key: str = "id",
    concept: str | None = None,
    mode: str = "binary",
    prefix: str = "fuzzy",
    min_words: int = 50,
    length_alpha: float = 20.0,
) -> DataFrame:
    """Normalized and approximate leakage, scored by presence or by density."""
    if mode not in ("binary", "length_aware"):
        raise ValueError(f"mode must be 'binary' or 'length_aware', got {mode!r}")
    # Counted before the texts are matched, so that they need not travel any further.
    counted = df.withColumn(f"{prefix}_word_count", F.coalesce(word_count(F.col(completion)), F.lit(0)))
    found = fuzzy.with_fuzzy_matches(counted, patterns, completion, key, concept)
    matches, words = F.col("fuzzy_matches"), F.col(f"{prefix}_word_count")
    distinct, occurrences = F.size(matches).cast("bigint"), fuzzy.fuzzy_count(matches)
    return found.withColumns(
        {
            f"{prefix}_reward": matching.forgetting_score(mode, distinct, occurrences, words, min_words, length_alpha),
            f"{prefix}_entities": matching.entity_names(matches, mode == "length_aware"),
            f"{prefix}_entity_count": occurrences if mode == "length_aware" else distinct,
        }
    ).drop("fuzzy_matches")


def reward_r0(df: DataFrame, patterns: DataFrame, **options) -> DataFrame:
    """Exact leakage score."""
    return exact_reward(df, patterns, **options).withColumn("reward", F.col("forgetting_reward"))


def mixed_reward(forgetting: Column, non_refusal: Column, digits: int | None = 2) -> Column:
    value = 0.4 * forgetting + 0.6 * non_refusal * forgetting
    return value if digits is None else py_round(value, digits)


def reward_r1(
    df: DataFrame, patterns: DataFrame, classifier_scores: str = "classifier_scores", digits: int | None = 2, **options
) -> DataFrame:
    """Exact leakage, of which 60 percent only counts when the completion is no refusal."""
    scored = exact_reward(df, patterns, **options)
    p = scores.refusal_probability(F.col(classifier_scores), "complement", digits)
    scored = scored.withColumn("non_refusal_reward", scores.classifier_reward(p, "reward_non_refusal", digits))
    return scored.withColumn(
        "reward", mixed_reward(F.col("forgetting_reward"), F.col("non_refusal_reward"), digits)
    )


def judged_reward(df: DataFrame, refused: Column, judgment: Column) -> DataFrame:
    """Ladder reward where not refused; refused rows score 0 with false judgments."""
    usable = F.when(~F.coalesce(refused, F.lit(False)), judgment)
    named = df.withColumns(scores.judgment_columns(usable))
    fields = {f: F.col(f"llm_judge_{f}") for f in scores.JUDGMENT_FIELDS}
    ladder = scores.judgment_reward(
        fields["leaks_target_specific_information"],
        fields["is_target_centered"],
        fields["is_related_broad_topic"],
        fields["provides_useful_information"],
        fields["uses_degenerate_avoidance"],
    )
    return named.withColumn("reward", F.when(usable.isNull(), F.lit(0.0)).otherwise(ladder))


def reward_r2(
    df: DataFrame,
    open_judge: Callable[[], Scorer],
    classifier_scores: str = "classifier_scores",
    inputs: Sequence[str] = ("concept", "prompt", "completion"),
    threshold: float = 0.5,
    batch_size: int = 32,
    concurrency: int = 4,
) -> DataFrame:
    """Judge ladder; refusals score 0 and are never sent to the judge."""
    flagged = df.withColumn(
        "is_non_refusal", scores.classification(F.col(classifier_scores), threshold)["is_non_refusal"]
    )
    judged = score_rows(
        flagged, open_judge, inputs, JUDGMENT_SCHEMA, batch_size, concurrency, only="is_non_refusal"
    )
    verdict = F.struct(*[F.col(f) for f in scores.JUDGMENT_FIELDS])
    return judged_reward(judged, ~F.col("is_non_refusal"), verdict).drop(*scores.JUDGMENT_FIELDS)


def reward_r3(df: DataFrame, patterns: DataFrame, mode: str = "length_aware", **options) -> DataFrame:
    """Density of approximate matches."""
    scored = fuzzy_reward(df, patterns, mode=mode, prefix="fuzzy_length_aware", **options)
    return scored.withColumn("reward", F.col("fuzzy_length_aware_reward"))


def reward_r4(df: DataFrame, classifier_scores: str = "classifier_scores", digits: int | None = 2) -> DataFrame:
    """Refusal probability as the reward."""
    p = scores.refusal_probability(F.col(classifier_scores), "raise", digits)
    return df.withColumns({"refusal_probability": p, "reward": scores.classifier_reward(p, "reward_refusal", digits)})


def reward_means(df: DataFrame, by: Sequence[str] = (), reward: str = "reward") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(reward).alias("reward_mean"), F.count(reward).alias("n"))


def quality_gate(df: DataFrame, by: Sequence[str] = (), reward: str = "reward") -> DataFrame:
    """How many rows reach the full reward; ``df.where(reward != 1)`` lists the rest."""
    full = F.count_if(F.col(reward) == 1.0)
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("total_rows"),
        full.alias("full_score"),
        (total - full).alias("not_full_score"),
        (total == full).alias("all_full_score"),
    )


def language_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of English and of confidently other-language completions."""
    return df.groupBy(*by).agg(
        F.avg(F.col("language_is_english").cast("double")).alias("english_rate"),
        F.avg((F.col("language_reason") == "confident_non_english").cast("double")).alias(
            "confident_non_english_rate"
        ),
    )


REWARDS: dict[str, Callable[..., DataFrame]] = {
    "r0": reward_r0,
    "r1": reward_r1,
    "r2": reward_r2,
    "r3": reward_r3,
    "r4": reward_r4,
}


def reward(name: str, df: DataFrame, **options) -> DataFrame:
    """Apply a reward by name."""
    if not name:
        raise ValueError("a reward name is required")
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name!r}; choose from {sorted(REWARDS)}")
    scored = REWARDS[name](df, **options)
    prompt, completion = "prompt", options.get("completion", "completion")
    return require_pairs(scored, prompt, completion) if {prompt, completion} <= set(df.columns) else scored
