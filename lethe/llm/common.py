"""Helpers shared by the operators: tables in the shared folder, running totals, rows as arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; the same class in Java, Python and DuckDB.
SPACE = r"[\x20\x09-\x0D]"
#: Upper bounds of what one Python call sees at a time, and of a slice whose texts are encoded together.
BATCH_ROWS = 512
BATCH_CHARS = 4_000_000
SLICE_ROWS = 2048
SLICE_CHARS = 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster in ``spark.checkpoint.dir``; a temporary one only where that is unset
    and the session is a local one, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later stages and retries start from the files."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """Array of words; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), lambda w: w != "")


def ranged(df: DataFrame, order: Sequence[str], name: str = "ranged") -> DataFrame:
    """Store the table cut into ranges of ``order``; ``__part`` numbers them in that order."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)


def totals_before(table: DataFrame, order: Sequence[str], totals: dict[str, Column], sums: DataFrame | None = None) -> DataFrame:
    """Add, for each total, the sum over all rows before the row in ``order``; ``table`` has ``__part`` of ranged().

    ``sums`` may be a cheaper table with the same totals by part.

    A window runs inside a part, and one row per part carries the sums forward. Only those part rows (as many as
    shuffle partitions) meet in one task. Rows that tie in ``order`` must be interchangeable.
    """
    columns = [c for c in table.columns if c != "__part" and c not in totals]
    table = table.withColumns({f"__v_{k}": v for k, v in totals.items()})
    sums = table if sums is None else sums.withColumns({f"__v_{k}": v for k, v in totals.items()})
    parts = sums.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in totals])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in totals])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = table.withColumns({f"__v_{k}": F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in totals})
    sums = [(F.col(f"__v_{k}") + F.col(f"__s_{k}")).alias(k) for k in totals]
    return local.join(parts, "__part").select(*columns, *sums)


def running_totals(df: DataFrame, order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """totals_before() for a table that is not cut into ranges yet."""
    return totals_before(ranged(df, order), order, totals)


def _bounds(sizes: Sequence[int], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Where stretches begin and end that have at most so many rows and, beyond their first row, characters."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or total + size > chars):
            yield start, i
            start, total = i, 0
        total += size
    yield start, len(sizes)


def bounded_batches(batches: Iterable[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """Cut batches so that each has at most BATCH_ROWS rows and, beyond its first row, BATCH_CHARS characters."""
    for batch in batches:
        if len(batch):
            for start, end in _bounds(batch[text].str.len().fillna(0).to_numpy(), BATCH_ROWS, BATCH_CHARS):
                yield batch.iloc[start:end]


def bounded_slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut likewise by SLICE_ROWS and SLICE_CHARS: only the texts of a slice become objects of Python."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            for start, end in _bounds(sizes, SLICE_ROWS, SLICE_CHARS):
                yield batch.slice(start, end - start)
