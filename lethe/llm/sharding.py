"""Minimax contiguous sharding: the smallest shard capacity under which groups, in order, fit into the shards.

Groups of equal texts are atomic and ordered by their smallest document id. Their running sizes are the possible
cuts. A capacity is checked greedily, each shard reaching to the last cut within it; many capacities are checked in
one pass, so that the binary search takes few. Everything is DataFrame functions; the driver holds cut positions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import ranged, running_totals, stored, totals_before

#: Capacities checked in one pass.
CHECKED_AT_ONCE = 48


class _Cuts:
    """Lookups in the ordered cut positions (column ``upto``); neighbors lie at most ``largest`` apart."""

    def __init__(self, groups: DataFrame, total: int, largest: int) -> None:
        self.groups, self.total, self.largest = groups, total, largest

    def at_most(self, places: list[int]) -> list[int]:
        """The last cut up to each place; 0 stands before the first. The filter reaches the files' statistics."""
        upto = F.col("upto")
        near = self.groups.where((upto > min(places) - self.largest) & (upto <= max(places)))
        found = near.agg(*[F.max(F.when(upto <= p, upto)) for p in places]).first()
        return [x or 0 for x in found]

    def at_least(self, place: int) -> int:
        upto = F.col("upto")
        return self.groups.where((upto >= place) & (upto < place + self.largest)).agg(F.min(upto)).first()[0]

    def greedy(self, capacities: list[int], shards: int) -> list[list[int]]:
        """For each capacity the ends of the shards, filled one after the other."""
        ends: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            places = [(e[-1] if e else 0) + c for e, c in zip(ends, capacities)]
            open_ = sorted({p for p in places if p < self.total})
            found = dict(zip(open_, self.at_most(open_))) if open_ else {}
            for e, p in zip(ends, places):
                e.append(found.get(p, self.total))
        return ends


def capacity(cuts: _Cuts, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which ``shards`` suffice, and the greedy ends under it."""
    even = -(-cuts.total // shards)
    low, high = max(even, cuts.largest), even + cuts.largest
    best: list[int] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // CHECKED_AT_ONCE))
        tried = sorted({*range(low, high, step), high} if best is None else {*range(low, high, step)})
        ends = cuts.greedy(tried, shards)
        fits = [i for i, e in enumerate(ends) if e[-1] == cuts.total]
        if fits:
            high, best = tried[fits[0]], ends[fits[0]]
            low = tried[fits[0] - 1] + 1 if fits[0] else high
        else:
            low = tried[-1] + 1
    return high, best


def balanced_ends(cuts: _Cuts, shards: int) -> list[int]:
    """Ends of the shards under the smallest capacity: of all cuts that it allows, those next to even positions."""
    size, latest = capacity(cuts, shards)
    earliest = [cuts.total]
    for _ in range(shards - 1):
        place = earliest[0] - size
        earliest.insert(0, cuts.at_least(place) if place > 0 else 0)
    ends: list[int] = []
    for k in range(shards - 1):
        even = -(-cuts.total * (k + 1) // shards)
        highest = min(latest[k], (ends[-1] if ends else 0) + size)
        place = max(min(even, highest), earliest[k], ends[-1] if ends else 0)
        below = cuts.at_most([place])[0] if place else 0
        above = cuts.at_least(place) if place else 0
        ends.append(above if above <= highest and above - even < even - below or below < earliest[k] else below)
    return [*ends, cuts.total]


def shard(documents: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (key, size, text_crc32, shard, slot).

    ``size`` is the text's UTF-8 bytes plus 8. Equal texts share a shard; a null text counts as an empty one. Slots
    number a shard's rows without gaps, in the order of groups and keys; repeated rows get slots of their own. With
    fewer groups than shards some stay empty; an empty table gives an empty result. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    value = F.coalesce(documents[text].cast("string"), F.lit(""))
    rows = stored(
        documents.select(
            documents[key].alias("__key"),
            (F.octet_length(value) + F.lit(8)).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(value, 256)).alias("__group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("__group").agg(
        F.min("__key").alias("__first"), F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows")
    )
    placed = running_totals(groups, ["__first", "__group"], {"__before": F.col("__bytes")})
    groups = stored(placed.withColumn("upto", F.col("__before") + F.col("__bytes")), "groups")
    total, largest = groups.agg(F.max("upto"), F.max("__bytes")).first()
    names = [F.col("__key").alias(key), "size", "text_crc32"]
    if total is None:
        return rows.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ends = balanced_ends(_Cuts(groups, total, largest), shards)

    number: Column = sum((F.when(F.col("__before") >= end, 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    groups = groups.withColumn("shard", number)
    counts = dict(groups.groupBy("shard").agg(F.sum("__rows")).collect())
    first = {s: sum(n for x, n in counts.items() if x < s) for s in range(shards)}
    base = F.element_at(F.array(*[F.lit(first[s]).cast("long") for s in range(shards)]), F.col("shard") + 1)
    joined = rows.join(groups.select("__group", "__before", "shard"), "__group").drop("__group")
    order = ["__before", "__key", "text_crc32"]
    numbered = totals_before(ranged(joined, order), order, {"__row": F.lit(1)})
    return numbered.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("__row") - base).cast("long").alias("slot"))
