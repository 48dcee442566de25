"""External batch scorers (classifier, language model, judge) and incremental scoring.

A scorer is a function that opens a client or model and returns a callable over a list of
row dictionaries. It runs inside ``mapInPandas``: one client per task, batches of a fixed
size, a bounded thread pool per task.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.text import digest
from lethe.session import materialize

Batch = list[dict]
Scorer = Callable[[Batch], list[dict]]


class RateLimited(Exception):
    """Raised by a scorer when the service asks to slow down."""


def with_retries(
    call: Scorer,
    tries: int = 8,
    sleep: Callable[[float], None] = time.sleep,
    jitter: Callable[[], float] = random.random,
) -> Scorer:
    """Retry on rate limits with waits of min(60, 2**attempt) plus up to one second."""

    def retried(batch: Batch) -> list[dict]:
        for attempt in range(tries):
            try:
                return call(batch)
            except RateLimited:
                if attempt == tries - 1:
                    raise
                sleep(min(60.0, 2.0**attempt) + jitter())
        return []

    return retried


def score_rows(
    df: DataFrame,
    open_scorer: Callable[[], Scorer],
    inputs: Sequence[str],
    output: T.StructType,
    batch_size: int = 32,
    concurrency: int = 4,
    only: str | None = None,
) -> DataFrame:
    """Add the scorer's output columns; rows where ``only`` is not true get nulls.

    The rows keep all their columns, so no join brings the scores back, and one pass serves
    scored and skipped rows.
    """
    if batch_size < 1 or concurrency < 1:
        raise ValueError("batch_size and concurrency must be at least 1")
    inputs = list(inputs)
    fields = output.fieldNames()
    schema = T.StructType(
        [f for f in df.schema.fields if f.name not in fields]
        + [T.StructField(f.name, f.dataType, True) for f in output.fields]
    )
    carried = [f.name for f in schema.fields if f.name not in fields]

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = open_scorer()
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for chunk in chunks:
                chosen = chunk if only is None else chunk[chunk[only].fillna(False).astype(bool)]
                records = chosen[inputs].to_dict("records")
                batches = [records[i : i + batch_size] for i in range(0, len(records), batch_size)]
                results = [r for part in pool.map(score, batches) for r in part]
                if len(results) != len(records):
                    raise ValueError(f"scorer returned {len(results)} results for {len(records)} rows")
                scores = pd.DataFrame(
                    {f: pd.Series([r[f] for r in results], index=chosen.index, dtype="object") for f in fields}
                ).reindex(chunk.index)
                scores = scores.astype(object).where(scores.notna(), None)
                yield pd.concat([chunk[carried], scores], axis=1)
        close = getattr(score, "close", None)
        if close:
            close()

    return df.mapInPandas(run, schema)


def pair_key(keys: Sequence[str]):
    return digest(*[F.col(k).cast("string") for k in keys])


def latest_scores(cache: DataFrame, keys: Sequence[str], metrics: Sequence[str], version: str = "version") -> DataFrame:
    """One row of scores per key, the highest version last written."""
    newest = F.max(F.struct(F.col(version).alias("v"), *[F.col(m) for m in metrics]))
    return (
        cache.groupBy(pair_key(keys).alias("__key"))
        .agg(newest.alias("__s"))
        .select("__key", *[F.col(f"__s.{m}").alias(m) for m in metrics])
    )


def missing_pairs(
    rows: DataFrame, cache: DataFrame, keys: Sequence[str], metrics: Sequence[str], context: Sequence[str] = ()
) -> DataFrame:
    """Distinct pairs without a complete set of cached scores.

    Duplicates are reduced before the shuffle, and only keys are compared with the cache.
    """
    complete = F.lit(True)
    for m in metrics:
        complete = complete & F.col(m).isNotNull()
    known = latest_scores(cache, keys, metrics).where(complete).select("__key")
    pairs = rows.groupBy(pair_key(keys).alias("__key")).agg(
        *[F.any_value(c).alias(c) for c in dict.fromkeys([*keys, *context])]
    )
    return pairs.join(known, "__key", "left_anti").drop("__key")


def attach_scores(rows: DataFrame, cache: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Left join the newest cached scores to every row."""
    scores = latest_scores(cache, keys, metrics)
    return (
        rows.drop(*metrics).withColumn("__key", pair_key(keys)).join(scores, "__key", "left").drop("__key")
    )


def incremental_scores(
    rows: DataFrame,
    cache: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    metrics: Sequence[str],
    context: Sequence[str] = (),
    version: int | None = None,
    cached_only: Sequence[str] | None = None,
    durable: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Score only what the cache lacks; returns (rows with scores, cache with additions).

    ``cached_only`` names the run columns: runs that still lack a score are left out and
    nothing is scored. ``durable`` writes the new scores to the shared folder before use. Their
    version is one above the cache's highest unless given, so that they replace what was cached.
    """
    if cached_only is not None:
        expanded = attach_scores(rows, cache, keys, metrics)
        incomplete = F.lit(False)
        for m in metrics:
            incomplete = incomplete | F.col(m).isNull()
        partial = expanded.where(incomplete).select(*cached_only).distinct()
        return expanded.join(partial, list(cached_only), "left_anti"), cache
    if version is None:
        version = (cache.agg(F.max("version")).first()[0] or 0) + 1
    fresh = score(missing_pairs(rows, cache, keys, metrics, context)).withColumn("version", F.lit(version))
    if durable:
        fresh = materialize(fresh, "scores")
    columns = [*keys, *metrics, "version"]
    updated = cache.select(*columns).unionByName(fresh.select(*columns))
    return attach_scores(rows, updated, keys, metrics), updated


def enrich_splits(
    splits: DataFrame,
    open_scorer: Callable[[], Scorer],
    inputs: Sequence[str] = ("prompt", "subject"),
    column: str = "broad_completion",
    batch_size: int = 32,
    concurrency: int = 4,
) -> DataFrame:
    """Add a generated column to the SFT rows only, written once to the shared folder."""
    sft = splits.withColumn("needs_text", F.col("split").isin("sft/train", "sft/test"))
    output = T.StructType([T.StructField(column, T.StringType())])
    scored = score_rows(sft, open_scorer, inputs, output, batch_size, concurrency, only="needs_text")
    return materialize(scored.drop("needs_text"), column)
