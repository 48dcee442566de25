"""Likelihood and multiple-choice scores from token log-probabilities and choice scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.prompts import letter
from lethe.functions.text import let


def sequence_loss(tokens: DataFrame, keys: Sequence[str], logprob: str = "logprob") -> DataFrame:
    """Total and mean negative log-likelihood and token count (at least 1) per text."""
    total, count = -F.sum(logprob), F.greatest(F.count(logprob), F.lit(1))
    return tokens.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0.0)).alias("total_loss"),
        F.coalesce(total / count, F.lit(0.0)).alias("loss"),
        count.alias("token_count"),
    )


def choice_scores(
    tokens: DataFrame,
    keys: Sequence[str],
    choice: str,
    position: str,
    prompt_length: str,
    kind: str = "completion",
    logprob: str = "logprob",
) -> DataFrame:
    """Score of each choice over its own tokens, leaving out the prompt.

    ``kind``: 'completion' sums log-probabilities, 'choice' averages them.
    """
    if kind not in ("completion", "choice"):
        raise ValueError("kind must be 'completion' or 'choice'")
    sums = choice_sums(tokens, keys, choice, position, prompt_length, logprob)
    return sums.select(*keys, choice, F.col(f"{kind}_score").alias("score"))


def choice_sums(
    tokens: DataFrame, keys: Sequence[str], choice: str, position: str, prompt_length: str, logprob: str = "logprob"
) -> DataFrame:
    """``completion_score`` (sum) and ``choice_score`` (mean) of each choice, in one aggregation."""
    own = F.col(position) >= F.col(prompt_length)
    total = F.coalesce(F.sum(F.when(own, F.col(logprob))), F.lit(0.0))
    count = F.greatest(F.count_if(own), F.lit(1))
    return tokens.groupBy(*keys, choice).agg(total.alias("completion_score"), (total / count).alias("choice_score"))


def best_choice(scores: DataFrame, keys: Sequence[str], choice: str, score: str = "score") -> DataFrame:
    """Highest-scored choice per row, the lowest choice index on ties."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(choice)).alias("neg")))
    return scores.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, (-F.col("__best.neg")).alias("predicted_index"), F.col("__best.score").alias("best_score")
    )


def choice_accuracy(predicted: Column, answer: Column) -> dict[str, Column]:
    return {
        "predicted_answer": letter(predicted),
        "answer": letter(answer),
        "score": (predicted == answer).cast("double"),
    }


def argmax(values: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return -F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("neg"))))["neg"]


def score_of(choices: Column, scores: Column, choice: Column) -> Column:
    """Score of a choice text; the last one counts when the text occurs twice."""
    hits = F.filter(F.arrays_zip(choices.alias("c"), scores.alias("s")), lambda z: z["c"] == choice)
    return F.element_at(hits, -1)["s"]


def mc1_score(
    choices: Column, scores: Column, mc1_choices: Column, mc1_labels: Column, on_invalid: str = "raise"
) -> Column:
    """1 when the one true choice scores above every false choice.

    Anything but one true and some false choices is an error, or null on request.
    """
    if on_invalid not in ("raise", "null"):
        raise ValueError("on_invalid must be 'raise' or 'null'")

    def judge(targets: Column) -> Column:
        def scored(label: int) -> Column:
            kept = F.filter(targets, lambda z: z["l"] == label)
            return F.transform(kept, lambda z: score_of(choices, scores, z["c"]))

        invalid = (
            F.raise_error(F.lit("MC1 needs one true and at least one false choice")).cast("double")
            if on_invalid == "raise"
            else F.lit(None).cast("double")
        )
        both = F.struct(scored(1).alias("t"), scored(0).alias("f"))
        return let(
            both,
            lambda b: F.when(
                (F.size(b["t"]) == 1) & (F.size(b["f"]) > 0),
                (F.get(b["t"], F.lit(0)) > F.array_max(b["f"])).cast("double"),
            ).otherwise(invalid),
        )

    return let(F.arrays_zip(mc1_choices.alias("c"), mc1_labels.alias("l")), judge)


def mc1_from_rows(
    scores: DataFrame, keys: Sequence[str], label: str, score: str = "score", on_invalid: str = "raise"
) -> DataFrame:
    """``mc1_score`` for choices stored one per row."""
    if on_invalid not in ("raise", "null"):
        raise ValueError("on_invalid must be 'raise' or 'null'")
    true, false = F.col(label) == 1, F.col(label) == 0
    grouped = scores.groupBy(*keys).agg(
        F.count_if(true).alias("t"),
        F.count_if(false).alias("f"),
        F.max(F.when(true, F.col(score))).alias("ts"),
        F.max(F.when(false, F.col(score))).alias("fs"),
    )
    invalid = (
        F.raise_error(F.lit("MC1 needs one true and at least one false choice")).cast("double")
        if on_invalid == "raise"
        else F.lit(None).cast("double")
    )
    value = F.when((F.col("t") == 1) & (F.col("f") > 0), (F.col("ts") > F.col("fs")).cast("double")).otherwise(invalid)
    return grouped.select(*keys, value.alias("mc1"))
