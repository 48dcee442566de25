"""Readers and writers: corpora, prompt splits, logged tables, summaries, shards, markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions import names
from lethe.operators import prepare
from lethe.operators.report import SUMMARY_LABELS, summary_wide
from lethe.operators.runs import table_order

# Published names of the prompt splits.
PUBLISHED = {
    "grpo/train": "grpo_train",
    "sft/train": "sft_train",
    "sft/test": "sft_validation",
    "grpo/test": "holdout",
}


def parent_folder(level: int = 1) -> Column:
    """Name of the folder ``level`` steps above the file a row came from."""
    parts = F.split(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "/")
    return F.element_at(parts, -(level + 1))


def file_name() -> Column:
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))


def load_probes(spark: SparkSession, path: str, position: str = "pos") -> DataFrame:
    """Probe split; the first row of each query is kept."""
    probes = spark.read.parquet(path)
    return prepare.keep_first(probes, ["query"], position) if "query" in probes.columns else probes


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """Prompt splits as one table partitioned by concept and split; other concepts there stay."""
    dynamic = splits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy("concept", "split").parquet(path)


def read_partitioned(spark: SparkSession, path: str, partitions: Sequence[str]) -> DataFrame:
    """A partitioned table whose partition values stay text ("007" is no number)."""
    inferred = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in partitions else f for f in inferred.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def load_splits(spark: SparkSession, path: str, concept: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one concept; only its partitions are read."""
    if mode not in ("sft", "grpo"):
        raise ValueError(f"mode must be 'sft' or 'grpo', not {mode!r}")
    rows = read_partitioned(spark, path, ["concept", "split"]).where(F.col("concept") == concept)
    train = rows.where(F.col("split") == f"{mode}/train").drop("concept", "split")
    test = rows.where(F.col("split") == f"{mode}/test").drop("concept", "split")
    return train, test


def load_prompts(
    spark: SparkSession, path: str, concept: str, identity: str, limit: int | None, shuffle: bool, seed: int = 42
) -> DataFrame:
    """Test prompts of a concept, optionally a capped seeded sample of them."""
    _, rows = load_splits(spark, path, concept, "grpo")
    return prepare.select_max(rows, limit, identity, "random" if shuffle else "first", seed)


def require_splits(splits: DataFrame) -> DataFrame:
    """Every concept must have all four splits."""
    counts = splits.groupBy("concept").agg(F.count_distinct("split").alias("n"))
    broken = [r["concept"] for r in counts.where(F.col("n") < len(PUBLISHED)).limit(10).collect()]
    if broken:
        raise ValueError(f"concepts with missing splits, for example {broken}")
    return splits


def publish_splits(spark: SparkSession, path: str, out: str) -> None:
    """All concepts, one folder per published split; answers of the RL splits are withheld."""
    rows = require_splits(read_partitioned(spark, path, ["concept", "split"]))
    names_ = F.create_map(*[F.lit(x) for pair in PUBLISHED.items() for x in pair])
    published = prepare.publish(rows).withColumn("published", names_[F.col("split")]).drop("split")
    dynamic = published.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    dynamic.partitionBy("published", "concept").parquet(out)


def load_published(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One published split; RL splits have no completion column."""
    if split not in PUBLISHED.values():
        raise ValueError(f"unknown published split {split!r}")
    rows = read_partitioned(spark, path, ["published", "concept"]).where(F.col("published") == split).drop("published")
    return rows.drop("completion") if split in ("grpo_train", "holdout") else rows


def restore_splits(spark: SparkSession, path: str, out: str) -> None:
    """Published table back to prompt splits, all concepts in one write."""
    back = F.create_map(*[F.lit(x) for k, v in PUBLISHED.items() for x in (v, k)])
    rows = read_partitioned(spark, path, ["published", "concept"])
    rows = rows.withColumn("split", back[F.col("published")]).drop("published")
    write_splits(rows, out)


def parse_log_table(document: Column) -> Column:
    """``array<map<string,variant>>`` of a JSON table in column/data layout, in row order."""
    doc = F.parse_json(document)
    columns = F.try_variant_get(doc, "$.columns", "array<string>")
    data = F.try_variant_get(doc, "$.data", "array<array<variant>>")
    return F.transform(data, lambda row: F.map_from_arrays(columns, row))


def read_log_tables(spark: SparkSession, paths: str | Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Logged JSON tables: typed ``fields``, run folder, table order and row position.

    ``fields`` maps a column to its SQL type. Tables are ordered within their folder; a
    position is unique there and leaves 2^32 places per table.
    """
    raw = spark.read.text(paths, wholetext=True).select(
        "value", parent_folder().alias("folder"), file_name().alias("table_name")
    )
    ranked = table_order(raw.select("folder", "table_name").distinct(), ["folder"], "table_name")
    rows = raw.select("folder", "table_name", F.posexplode(parse_log_table(F.col("value"))).alias("row", "cells"))
    cells = [F.try_variant_get(F.col("cells")[c], "$", t).alias(c) for c, t in fields.items()]
    return rows.join(ranked, ["folder", "table_name"]).select(
        "folder",
        "table_name",
        "table_order",
        (F.shiftleft(F.col("table_order").cast("bigint"), 32) + F.col("row")).alias("pos"),
        *cells,
    )


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Paths only; no file is opened."""
    return spark.read.format("binaryFile").load(glob).select("path")


def read_csv_by_header(spark: SparkSession, glob: str, required: Sequence[str], *extra: Column, kind: str = "columns") -> DataFrame:
    """The ``required`` columns (text) of CSV files, each file read by its own header, and ``extra`` columns.

    Files are read together where their header lines are equal. A file without a required column is an error.
    """
    header = F.rtrim(F.substring_index("value", "\n", 1), F.lit("\r"))
    files = spark.read.text(glob, wholetext=True).select(header.alias("header"), F.col("_metadata.file_path").alias("path"))
    groups = files.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    parts = []
    for group in groups:
        rows = spark.read.option("header", True).option("escape", '"').csv(group["paths"])
        missing = sorted(set(required) - set(rows.columns))
        if missing:
            raise ValueError(f"missing {kind} {missing} in {group['paths'][0]}")
        parts.append(rows.select(*[F.col(f"`{c}`") for c in required], *extra))
    if not parts:
        raise ValueError(f"no file matches {glob}")
    return reduce(DataFrame.unionByName, parts)


def read_summaries(
    spark: SparkSession, root: str, metrics: Sequence[str], file: str = "summary.csv"
) -> DataFrame:
    """Summary tables of the immediate run folders, with the folder name."""
    required = ["forget_concept", "model_name_or_path", "stat", *metrics]
    rows = read_csv_by_header(spark, f"{root}/*/{file}", required, parent_folder().alias("folder"))
    return rows.select(*required[:3], *[names.number(F.col(f"`{m}`")).alias(m) for m in metrics], "folder")


def run_table(summaries: DataFrame, metrics: Sequence[str], stats: Sequence[str] = ("mean",)) -> DataFrame:
    """One row per run folder: metadata from its name and a column per metric and statistic."""
    wide = summary_wide(summaries, ["folder"], metrics, stats)
    concept = summaries.groupBy("folder").agg(F.min("forget_concept").alias("__concept"))
    meta = names.folder_metadata(F.col("folder"), F.col("__concept"))
    return (
        wide.join(concept, "folder")
        .withColumn("__m", meta)
        .select("__m.*", *[c for c in wide.columns if c != "folder"])
    )


def read_benchmark_summaries(spark: SparkSession, glob: str, level: int) -> DataFrame:
    """Single-row benchmark tables; the run name is the folder ``level`` steps up."""
    rows = read_csv_by_header(spark, glob, list(SUMMARY_LABELS.values()), parent_folder(level).alias("run_name"), kind="metrics")
    return rows.select(
        "run_name",
        *[names.number(F.col(f"`{label}`")).alias(m) for m, label in SUMMARY_LABELS.items()],
    )


def read_shards(spark: SparkSession, folder: str, stem: str, count: int, schema: str) -> DataFrame:
    """Rows of all shards of a file; a missing shard is an error."""
    found = list_files(spark, f"{folder}/{stem}.shard*.jsonl").select(
        F.regexp_extract("path", r"\.shard(\d+)\.jsonl$", 1).cast("int").alias("shard")
    )
    expected = spark.range(count).select(F.col("id").cast("int").alias("shard"))
    missing = [r["shard"] for r in expected.join(found, "shard", "left_anti").orderBy("shard").limit(10).collect()]
    if missing:
        raise ValueError(f"missing shard output of {stem}: {missing}")
    return spark.read.schema(schema).json([f"{folder}/{stem}.shard{i}.jsonl" for i in range(count)])


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested_metrics(df: DataFrame, name: str = "metrics") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """CSV in a fixed column order with empty cells for nulls, sorted by ``order``."""
    rows = df.orderBy(*order) if order else df
    rows.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)


def read_stop_markers(spark: SparkSession, root: str, file: str = "low_reward_stop.json") -> DataFrame:
    """Stopped runs: keys from the folder name, reason from the marker."""
    schema = (
        "reason string, global_step bigint, first_epoch_active_group_rate_mean double, "
        "epoch double, threshold double"
    )
    markers = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{file}")
    return (
        markers.select("*", parent_folder().alias("run_name"))
        .withColumn("__r", names.stopped_run(F.col("run_name")))
        .where(F.col("__r").isNotNull())
        .select(
            names.key_of(F.col("__r.author")).alias("concept_key"),
            "__r.training_variant",
            "__r.model_size",
            "__r.reward_type",
            "run_name",
            "reason",
        )
    )


def folder_subjects(spark: SparkSession, glob: str) -> DataFrame:
    """Subjects named by folders: text after the first underscore, underscores as spaces."""
    folder = F.element_at(F.split(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), "/"), -2)
    tail = F.when(F.contains(folder, F.lit("_")), F.regexp_replace(folder, "^[^_]*_", "")).otherwise(folder)
    return list_files(spark, glob).select(F.replace(tail, F.lit("_"), F.lit(" ")).alias("subject")).distinct()


def write_inventory(inventory: DataFrame, path: str) -> None:
    """Run inventory with its table list as a JSON cell."""
    inventory.withColumn("completion_tables", F.to_json("completion_tables")).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def read_inventory(
    spark: SparkSession,
    path: str,
    allowed_authors: Sequence[str],
    max_tables: int,
    min_available: int,
) -> DataFrame:
    """Eligible runs of a stored inventory with their recent tables selected again.

    A run's table list is one cell of one row.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    tables = F.from_json("completion_tables", "array<string>")
    keyed = F.array_sort(
        F.transform(
            tables,
            lambda t: F.struct(names.table_number(t).alias("k"), t.alias("t")),
        )
    )
    recent = keyed if max_tables <= 0 else F.slice(
        keyed, F.greatest(F.size(keyed) - max_tables + 1, F.lit(1)), max_tables
    )
    available = F.coalesce(F.col("available_table_count").try_cast("int"), F.size(tables))
    return (
        rows.where(names.in_allow_list(F.col("forget_concept"), allowed_authors))
        .where(available >= min_available)
        .withColumns(
            {
                "available_table_count": available,
                "completion_tables": F.transform(recent, lambda s: s["t"]),
            }
        )
    )


def reuse_or_build(spark: SparkSession, path: str, required: Sequence[str], build) -> DataFrame:
    """Stored points when they exist with the required columns, else built and stored."""
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        stored = None
    if stored is not None and set(required) <= set(stored.columns):
        return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending_work(work: DataFrame, outputs: DataFrame, key: str, required: Sequence[str], stopped: DataFrame | None = None) -> DataFrame:
    """Work whose required outputs are not all present; stopped work is left out.

    ``outputs`` has one row per (key, output) found.
    """
    done = (
        outputs.where(F.col("output").isin(list(required)))
        .groupBy(key)
        .agg(F.count_distinct("output").alias("n"))
        .where(F.col("n") == len(set(required)))
        .select(key)
    )
    left = work.join(done, key, "left_anti")
    return left if stopped is None else left.join(stopped.select(key), key, "left_anti")


def checkpoints(spark: SparkSession, root: str, milestones: Sequence[int] = (), concept: str | None = None) -> DataFrame:
    """Checkpoints of the runs under ``root`` in numeric order, with step, tokens and milestone."""
    state = spark.read.schema("global_step bigint, num_input_tokens_seen bigint").option("multiLine", True).json(
        f"{root}/*/checkpoint-*/trainer_state.json"
    )
    rows = state.select("*", parent_folder(2).alias("run_name"), parent_folder(1).alias("checkpoint"))
    return checkpoint_order(rows, milestones).withColumn("forget_concept", F.lit(concept))


def checkpoint_order(rows: DataFrame, milestones: Sequence[int] = ()) -> DataFrame:
    """Position of a checkpoint in its run by the number in its name, and the milestone there."""
    number = F.regexp_extract("checkpoint", r"(\d+)$", 1).cast("bigint")
    window = Window.partitionBy("run_name").orderBy(number, "checkpoint")
    indexed = rows.withColumn("milestone_index", (F.row_number().over(window) - 1).cast("int"))
    table = F.lit(list(milestones)).cast("array<bigint>") if milestones else F.array().cast("array<bigint>")
    return indexed.withColumn("token_milestone", F.get(table, F.col("milestone_index")))
