"""Exact selection by rank without sorting: the k-th smallest key of each group, found by counting prefixes.

Keys are texts that sort as the order does. Each round counts the keys by group and prefix, goes on in the one cell that
holds the wanted rank, and skips what all keys of that cell have in common, so that neither even nor dense keys are needed.
A round reads the columns of the key alone and returns few rows; nothing is shuffled but counts. Rows are then told by
comparing their key with the cuts, in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose cuts pass through the driver; a table with more of them is not split this way.
MAX_GROUPS = 2_000
#: Characters by which prefixes grow in a round: at most 65,536 cells of a group.
STEP = 4
LOWEST = -(1 << 63)


def sort_key(df: DataFrame, column: str) -> Column:
    """A text that sorts as the column does, null first: whole numbers and times by their bits, other numbers to nine
    decimal places, all other types by the bytes of their text."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value, kind = F.unix_micros(value.cast("timestamp")), T.LongType()
    if isinstance(kind, T.IntegralType):
        key = F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(LOWEST))), 16, "0")
    elif isinstance(kind, T.NumericType):
        key = F.lpad((value.cast("decimal(28,9)") + F.lit(10**18)).cast("decimal(38,9)").cast("string"), 40, "0")
    else:
        key = F.hex(F.encode(value.cast("string"), "UTF-8"))
    return F.coalesce(key, F.lit(""))


@dataclass
class _Cell:
    """The keys of one group that begin with ``prefix``: their number, the least and the greatest."""

    prefix: str
    n: int
    low: str
    high: str

    def common(self) -> str:
        size = next((i for i, (a, b) in enumerate(zip(self.low, self.high)) if a != b), min(len(self.low), len(self.high)))
        return self.low[:size]


@dataclass
class Cuts:
    """Per group its size and, for each wanted rank, the key at that rank (None: past the end)."""

    totals: dict[tuple, int]
    keys: dict[tuple, list[str | None]]


def cut_keys(df: DataFrame, by: Sequence[str], key: Column, ranks: Callable[[int], Sequence[int]]) -> Cuts | None:
    """The keys at the ranks (from 0) that ``ranks`` names for a group's size; None if there are more than MAX_GROUPS.

    A null group is a group. Keys that tie have one rank after the other, so that the cut is the key of the tie.
    """
    rows = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], key.alias("k"))
    groups = [f"g{i}" for i in range(len(by))]
    counted = [F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")]
    whole = rows.groupBy(*groups).agg(*counted).limit(MAX_GROUPS + 1).collect()
    if len(whole) > MAX_GROUPS:
        return None
    totals = {tuple(r[g] for g in groups): r.n for r in whole if r.n}
    start = {tuple(r[g] for g in groups): _Cell("", r.n, r.low, r.high) for r in whole if r.n}
    names = list(totals)
    found: dict[tuple, list[str | None]] = {}
    pending: list[tuple[tuple, int, int, _Cell]] = []
    for name in names:
        wanted = list(ranks(totals[name]))
        found[name] = [None] * len(wanted)
        pending += [(name, i, rank, start[name]) for i, rank in enumerate(wanted) if 0 <= rank < totals[name]]
    numbers = {name: i for i, name in enumerate(names)}
    number = _number(df.sparkSession, rows, groups, names)
    while pending:
        open_ = []
        for name, i, rank, cell in pending:
            if cell.low == cell.high:
                found[name][i] = cell.low
            else:
                open_.append((name, i, rank, cell, cell.common()))
        if not open_:
            break
        cells = sorted({(numbers[name], prefix, len(prefix) + STEP) for name, _, _, _, prefix in open_})
        asked = F.broadcast(df.sparkSession.createDataFrame(cells, "asked int, prefix string, size int"))
        near = number.join(asked, (F.col("number") == F.col("asked")) & F.startswith("k", F.col("prefix")))
        parts = near.groupBy("number", "prefix", F.substring(F.col("k"), F.lit(1), F.col("size")).alias("head")).agg(*counted)
        # Only the cells that hold a wanted rank come back.
        before = Window.partitionBy("number", "prefix").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        places = [(numbers[name], prefix, rank, i) for name, i, rank, _, prefix in open_]
        wanted_ = F.broadcast(df.sparkSession.createDataFrame(places, "number int, prefix string, rank long, i int"))
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        hits = parts.join(wanted_, ["number", "prefix"]).where(inside).collect()
        pending = [(names[r.number], r.i, r.rank - r.before, _Cell(r.head, r.n, r.low, r.high)) for r in hits]
    return Cuts(totals, found)


def _number(spark, rows: DataFrame, groups: list[str], names: list[tuple]) -> DataFrame:
    """The rows with the number of their group."""
    if not groups:
        return rows.withColumn("number", F.lit(0))
    return _beside(rows, groups, [(*name, i) for i, name in enumerate(names)], [("number", "int")])


def _beside(rows: DataFrame, groups: Sequence[str], values: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """Add values of a few groups to their rows, nulls matching nulls."""
    fields = [T.StructField(f"__g{i}", rows.schema[g].dataType) for i, g in enumerate(groups)]
    fields += [T.StructField(n, T.StructType.fromDDL(f"x {kind}")[0].dataType) for n, kind in columns]
    table = F.broadcast(rows.sparkSession.createDataFrame(values, T.StructType(fields)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    joined = rows.join(table, same)
    return joined.drop(*[f"__g{i}" for i in range(len(groups))])


def with_place(df: DataFrame, by: Sequence[str], key: Column, cuts: Cuts, name: str) -> DataFrame:
    """Add the number of cuts that are not above the row's key; cuts past the end count for none."""
    if not by:
        bounds = F.array(*[F.lit(c) for c in cuts.keys.get((), []) if c is not None]).cast("array<string>")
        return df.withColumn(name, F.size(F.filter(bounds, lambda c: c <= key)).cast("bigint"))
    most = max((len(keys) for keys in cuts.keys.values()), default=0)
    values = [(*group, *keys) for group, keys in cuts.keys.items()]
    named = [f"__cut{i}" for i in range(most)]
    beside = _beside(df.withColumn("__key", key), by, values, [(n, "string") for n in named])
    place = sum((F.when(F.col(n) <= F.col("__key"), 1).otherwise(0) for n in named), F.lit(0))
    return beside.withColumn(name, place.cast("bigint")).drop("__key", *named)
