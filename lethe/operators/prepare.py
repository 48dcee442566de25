"""Corpus preparation: filtering, duplicates, seeded samples and splits, shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions import ordered, selection
from lethe.functions.text import digest, is_nonblank, question

SPLITS = ("grpo/train", "grpo/test", "sft/train", "sft/test")


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_nonblank(F.col(column)))


def blank_report(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows seen, kept and removed by ``drop_blank``."""
    kept = F.count_if(is_nonblank(F.col(column)))
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("total_rows"), kept.alias("kept_rows"), (total - kept).alias("removed_rows")
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when the frame is empty; reads until the first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def concept_corpus(corpus: DataFrame, concept: str) -> DataFrame:
    """Question prompts of one subject: ``prompt, completion, subject`` (and ``pos``)."""
    keep = [c for c in ("pos",) if c in corpus.columns]
    questions = corpus.where(F.col("subject") == concept).select(
        *keep,
        question(F.col("instruction")).alias("prompt"),
        F.col("output").alias("completion"),
        "subject",
    )
    return drop_blank(questions, "prompt")


def keep_first(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """First row per combination of text columns; ``position`` is unique."""
    return ordered.keep_extreme(df, digest(*[F.col(c).cast("string") for c in columns]), position)


def keep_last(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    return ordered.keep_extreme(
        df, digest(*[F.col(c).cast("string") for c in columns]), position, last=True
    )


def _shuffled(df: DataFrame, by: Sequence[str], identity: str, seed: int, total: str) -> DataFrame:
    order = ordered.seeded_order(seed, F.col(identity))
    return ordered.row_index(
        df.withColumn("__order", order),
        by,
        ["__order", identity],
        ordered.seeded_bucket(F.col("__order")),
        "__rank",
        total,
    ).drop("__order")


def select_max(
    df: DataFrame,
    limit: int | None,
    identity: str,
    strategy: str = "first",
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """At most ``limit`` rows (per group): the first by ``identity``, or a seeded sample.

    The limit is turned into a key per group by counting prefixes of keys (``selection``), and rows are compared with it
    where they are. With very many groups, rows are counted per group and bucket of the order instead, and only the
    buckets that the limit reaches are ranked. A null group is a group. ``identity`` may have any type; it is taken as
    unique.
    """
    if limit is None:
        return df
    if int(limit) <= 0:
        raise ValueError("limit must be positive or None")
    if strategy not in ("first", "random"):
        raise ValueError("strategy must be 'first' or 'random'")
    key = ordered.seeded_order(seed, F.col(identity)) if strategy == "random" else selection.sort_key(df, identity)
    cuts = selection.cut_keys(df, by, key, lambda total: [int(limit)])
    if cuts is not None:
        placed = selection.with_place(df, by, key, cuts, "__place")
        return placed.where(F.col("__place") == 0).select(*df.columns)
    if strategy == "random":
        keyed = df.withColumn("__order", ordered.seeded_order(seed, F.col(identity)))
        order, bucket = ["__order", identity], ordered.seeded_bucket(F.col("__order"))
    else:
        keyed, order, bucket = df, [identity], ordered.identity_bucket(df, identity)
    placed = keyed.withColumn("__cell", F.struct(*[F.col(c) for c in by], bucket.alias("__b")))
    counts = placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*[f"__cell.{c}" for c in by]).orderBy("__cell.__b").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < int(limit))
    near = placed.join(reached.select("__cell"), "__cell", "left_semi")
    ranked = ordered.row_index(near, by, order, F.col("__cell.__b"), "__rank")
    return ranked.where(F.col("__rank") < int(limit)).select(*df.columns)


def _size(size: float | int, total: Column) -> Column:
    """Rows of a part: a fraction is rounded up, an integer is taken as is."""
    if isinstance(size, float):
        return F.ceil(F.lit(size) * total)
    return F.least(F.lit(size).cast("bigint"), total)


def seeded_splits(
    df: DataFrame,
    by: Sequence[str],
    identity: str,
    seed: int,
    grpo_test: float | int,
    sft_train: float,
    sft_test: float,
) -> DataFrame:
    """Add ``split`` with exact sizes per group: test first, then the SFT share of the rest.

    The order is a hash of the seed and the row identity, so the result does not depend on how the data is partitioned.
    Rows are compared with the keys at which a group is cut; they are not sorted, and with few groups not moved. Rows that
    share an identity stay together.
    """
    share = sft_train + sft_test

    def sizes(total: int) -> list[int]:
        n_test = math.ceil(grpo_test * total) if isinstance(grpo_test, float) else min(grpo_test, total)
        n_sft = math.ceil(share * (total - n_test))
        n_sft_test = math.ceil(sft_test / share * n_sft)
        return [n_test, n_test + n_sft_test, n_test + n_sft]

    key = ordered.seeded_order(seed, F.col(identity))
    cuts = selection.cut_keys(df, by, key, sizes)
    if cuts is None:
        return _ranked_splits(df, by, identity, seed, grpo_test, sft_train, sft_test)
    parts = F.lit(["grpo/test", "sft/test", "sft/train", "grpo/train"])
    placed = selection.with_place(df, by, key, cuts, "__place")
    return placed.withColumn("split", F.get(parts, F.col("__place").cast("int"))).drop("__place")


def _ranked_splits(df: DataFrame, by: Sequence[str], identity: str, seed: int, grpo_test: float | int, sft_train: float, sft_test: float) -> DataFrame:
    """seeded_splits() for very many groups: rows are ranked in buckets of the order."""
    ranked = _shuffled(df, by, identity, seed, "__total")
    share = sft_train + sft_test
    n_test = _size(grpo_test, F.col("__total"))
    n_sft = F.ceil(F.lit(share) * (F.col("__total") - n_test))
    n_sft_test = F.ceil(F.lit(sft_test / share) * n_sft)
    sized = ranked.withColumns({"__test": n_test, "__sft": n_sft, "__sft_test": n_sft_test})
    rank, test = F.col("__rank"), F.col("__test")
    split = (
        F.when(rank < test, "grpo/test")
        .when(rank < test + F.col("__sft_test"), "sft/test")
        .when(rank < test + F.col("__sft"), "sft/train")
        .otherwise("grpo/train")
    )
    return sized.withColumn("split", split).drop("__rank", "__total", "__test", "__sft", "__sft_test")


def contiguous_shard(df: DataFrame, count: int, position: str, name: str = "shard") -> DataFrame:
    """Number of the contiguous shard each row falls in; early shards are one row longer.

    ``position`` may have any type and any gaps; rows that share one stay together. Rows are not moved.
    """
    if count < 1:
        raise ValueError("shard count must be at least 1")

    def starts(total: int) -> list[int]:
        base, extra = divmod(total, count)
        return [i * base + min(i, extra) for i in range(1, count)]

    key = selection.sort_key(df, position)
    cuts = selection.cut_keys(df, [], key, starts)
    return selection.with_place(df, [], key, cuts, name)


def take_shard(df: DataFrame, index: int, count: int, position: str) -> DataFrame:
    if not 0 <= index < count:
        raise ValueError("shard index must be within the shard count")
    if count == 1:
        return df
    return contiguous_shard(df, count, position, "__shard").where(F.col("__shard") == index).drop("__shard")


def repeat_prompts(df: DataFrame, generations: int) -> DataFrame:
    """One row per generation of a prompt."""
    if generations < 1:
        raise ValueError("generations must be at least 1")
    return df.withColumn("completion_index", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))


def with_objective(df: DataFrame, objective: str) -> DataFrame:
    """Training target: the completion as it is ('refusal'), or the broad one in its place."""
    if objective == "refusal":
        return df
    if objective == "broad":
        return df.drop("completion").withColumnRenamed("broad_completion", "completion")
    raise ValueError(f"objective must be 'refusal' or 'broad', got {objective!r}")


def publish(splits: DataFrame) -> DataFrame:
    """Rows of all concepts for release: the answers of the RL splits are withheld."""
    hidden = F.col("split").isin("grpo/train", "grpo/test")
    return splits.withColumn("completion", F.when(~hidden, F.col("completion")))
