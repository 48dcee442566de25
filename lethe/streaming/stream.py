"""The rules of ``lethe.streaming.rules`` on a stream of trainer log events.

Milestones and budgets are streaming aggregations (reduced before the shuffle). Streaks and
the no-learning check keep a few numbers of state per run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lethe.session import shared_folder
from lethe.streaming import rules


def milestone_stream(log: DataFrame, run: str, step: str, tokens: str, milestones: Sequence[int]) -> DataFrame:
    """Run in update mode: a milestone is reported when reached, and again if an earlier step arrives."""
    return rules.token_milestones(log, run, step, tokens, milestones)


def budget_stream(log: DataFrame, run: str, step: str, tokens: str, budget: int) -> DataFrame:
    return rules.token_budget_stop(log, run, step, tokens, budget)


def _in_order(rows: Iterator[pd.DataFrame], position: str) -> pd.DataFrame | None:
    """The run's events of one trigger, in log order; a shuffle does not keep it."""
    parts = [p for p in rows if len(p)]
    return pd.concat(parts, ignore_index=True).sort_values(position, kind="stable") if parts else None


class StreakProcessor(StatefulProcessor):
    """State: last scored step and the streak so far."""

    def __init__(self, run: str, step: str, reward: str, position: str, threshold: float, limit: int) -> None:
        self.run, self.step, self.reward, self.position = run, step, reward, position
        self.threshold, self.limit = threshold, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "last_step bigint, streak bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _in_order(rows, self.position)
        if events is None:
            return
        known = self.state.get() if self.state.exists() else None
        last, streak = known if known else (None, 0)
        out = []
        for step, position, reward in zip(events[self.step], events[self.position], events[self.reward]):
            if pd.isna(reward):
                continue
            moved = 1 if last is None else max(1, int(step) - last)
            last = int(step)
            streak = streak + moved if reward > self.threshold else 0
            out.append((key[0], int(position), last, streak, streak > self.limit))
        if last is not None:
            self.state.update((last, streak))
        yield pd.DataFrame(out, columns=[self.run, self.position, self.step, "streak", "stop"])

    def close(self) -> None:
        pass


def streak_stream(
    log: DataFrame,
    run: str,
    step: str,
    rewards: Sequence[str],
    position: str,
    threshold: float = 0.95,
    limit: int = 5,
) -> DataFrame:
    slim = log.select(
        run, F.col(position).cast("bigint"), F.col(step).cast("bigint"),
        F.coalesce(*[F.col(c) for c in rewards]).cast("double").alias("used_reward"),
    )
    schema = T.StructType(
        [
            T.StructField(run, log.schema[run].dataType),
            T.StructField(position, T.LongType()),
            T.StructField(step, T.LongType()),
            T.StructField("streak", T.LongType()),
            T.StructField("stop", T.BooleanType()),
        ]
    )
    return slim.groupBy(run).transformWithStateInPandas(
        StreakProcessor(run, step, "used_reward", position, threshold, limit), schema, "Append", "None"
    )


class NoLearningProcessor(StatefulProcessor):
    """State: sum and count of first-epoch rates, latest epoch, check done."""

    def __init__(self, run: str, step: str, epoch: str, zero_std: str, position: str, threshold: float) -> None:
        self.run, self.step, self.epoch, self.zero_std, self.position = run, step, epoch, zero_std, position
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("learning", "total double, n bigint, epoch double, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _in_order(rows, self.position)
        if events is None:
            return
        known = self.state.get() if self.state.exists() else None
        total, n, epoch, done = known if known else (0.0, 0, None, False)
        out = []
        for step, seen, idle in zip(events[self.step], events[self.epoch], events[self.zero_std]):
            if not pd.isna(seen):
                epoch = float(seen)
            if done or pd.isna(idle) or epoch is None:
                continue
            if epoch <= 1.0:
                total, n = total + (1.0 - float(idle)), n + 1
            if epoch >= 1.0 and n:
                done = True
                out.append((key[0], int(step), epoch, total / n, self.threshold, total / n <= self.threshold))
        self.state.update((total, n, epoch, done))
        yield pd.DataFrame(
            out,
            columns=[self.run, "step", "epoch", "first_epoch_active_group_rate_mean", "threshold", "stop"],
        )

    def close(self) -> None:
        pass


def no_learning_stream(
    log: DataFrame, run: str, step: str, epoch: str, zero_std: str, position: str, threshold: float = 0.0
) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(run, log.schema[run].dataType),
            T.StructField("step", T.LongType()),
            T.StructField("epoch", T.DoubleType()),
            T.StructField("first_epoch_active_group_rate_mean", T.DoubleType()),
            T.StructField("threshold", T.DoubleType()),
            T.StructField("stop", T.BooleanType()),
        ]
    )
    slim = log.select(run, F.col(step).cast("bigint"), epoch, zero_std, F.col(position).cast("bigint"))
    return slim.groupBy(run).transformWithStateInPandas(
        NoLearningProcessor(run, step, epoch, zero_std, position, threshold), schema, "Append", "None"
    )


def start(
    stream: DataFrame,
    name: str,
    each_batch: Callable[[DataFrame, int], None],
    mode: str = "append",
    available_now: bool = False,
) -> StreamingQuery:
    """Start a query whose offsets and state live in the shared folder."""
    place = f"{shared_folder(stream.sparkSession)}/streams/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(each_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
