"""Mixing sources to target weights: fixed-length blocks, multinomial shards, pseudorandom permutations of indexes.

The words of a source, document after document, form one stream that is cut into blocks of BLOCK words. Output shards
of SLOTS slots draw how many slots each source fills from a multinomial distribution. The j-th draw of a source takes
the block that its permutation puts at j modulo the number of blocks; a new epoch uses a new permutation. Draws and
blocks are joined by (source, block). Rows are told apart by a number that mix() gives them, never by their key, which
may be null or repeated. Targets set how many blocks a source gives over all shards, so draws beyond
that number are handed to the sources that are short.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import SPACE, ranged, stored, totals_before, words

WEIGHTS = (5, 2, 1)
BLOCK = 64
SLOTS = 1024
MOST_REPEATS = 3
#: Sources have one weight each and fit in the driver; more than this raises an error.
MAX_SOURCES = 100_000
_WORD = re.compile(f"[^{SPACE[1:-1]}]+")
ROUNDS = 4


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the whole size by weight, none above ``most`` times its size; the excess is shared again by weight."""
    sizes_, weights_ = np.asarray(sizes, float), np.asarray(weights, float)
    caps, out = sizes_ * most, np.zeros(len(sizes_))
    open_ = np.ones(len(sizes_), bool)
    while open_.any():
        left = sizes_.sum() - caps[~open_].sum()
        share = left * weights_ / weights_[open_].sum()
        above = open_ & (share > caps)
        if not above.any():
            out[open_] = share[open_]
            break
        out[above] = caps[above]
        open_ &= ~above
    return out.tolist()


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    """A well-mixing function of 64-bit numbers (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 at ``index``, one permutation per key (arrays of equal length).

    A Feistel network over the next even power of two; results outside the range walk on until they fall inside.
    """
    size, key = size.astype(np.uint64), key.astype(np.uint64)
    bits = np.frexp(np.maximum(size, 2).astype(np.float64) - 0.5)[1]
    half = np.maximum(1, (bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        h, m, k, x = half[walk], mask[walk], key[walk], out[walk]
        left, right = x >> h, x & m
        for r in range(ROUNDS):
            turned = _mixed_bits(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            left, right = right, left ^ (turned & m)
        out[walk] = (left << h) | right
        walk = walk[out[walk] >= size[walk]]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """``documents``: (key, size, source_size, target, number, place), number and place being null without words.

    ``pieces``: (source, block, place, start, length, row), a document's words in a block. ``draws``: (shard, slot,
    source, block, epoch). ``rows``: (row, document), the whole rows under their numbers, if they are carried.
    """

    documents: DataFrame
    pieces: DataFrame
    draws: DataFrame
    rows: DataFrame | None = None


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    seed: int = 0,
    block: int = BLOCK,
    slots: int = SLOTS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = True,
) -> Mix:
    """Draw the mix. Sources by code point, null last, take ``weights`` in turn; null and empty texts have no words.

    Other columns are ignored. Repeated rows are documents of their own, whether their key is null or not. Without words
    nothing is drawn. ``carry`` stores the whole rows with their numbers, which mixed_texts() needs.
    """
    spark = documents.sparkSession
    size, mark = F.size(words(documents[text])).cast("long"), F.xxhash64(documents[text])
    # The numbers are fixed by being stored: nothing later computes them again.
    numbered = documents.select(
        documents[key].alias("__key"),
        documents[source].alias("__name"),
        size.alias("size"),
        mark.alias("__mark"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*[documents[c] for c in documents.columns]).alias("document")] if carry else []),
    )
    numbered = stored(numbered, "mix-sizes")
    rows = numbered.drop("document")
    found = rows.groupBy("__name").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [int(r[1]) for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    blocks = [-(-n // block) for n in sizes]
    quota = [round(t * b / n) if n else 0 for t, b, n in zip(wanted, blocks, sizes)]
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1].tolist()
    table = spark.createDataFrame(
        [(i, r[0], n, t, b) for i, (r, n, t, b) in enumerate(zip(found, sizes, wanted, before))],
        "source int, __other string, source_size long, target double, __base long",
    )
    joined = rows.join(table, F.col("__name").eqNullSafe(F.col("__other")))
    order = ["source", "__key", "size", "__mark", "row"]
    placed = totals_before(ranged(joined, order), order, {"__from": F.col("size")})
    has = F.col("size") > 0
    placed = stored(placed.withColumn("place", F.when(has, F.col("__from") - F.col("__base"))), "mix-places")
    first, last = F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block)
    cut = placed.where(has).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block - F.col("place"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("place"), F.col("size"))
    pieces = cut.select("source", "block", "place", start.alias("start"), (end - start).alias("length"), "row")
    return Mix(
        placed.select(F.col("__key").alias(key), "size", "source_size", "target", F.when(has, F.col("source")).alias("number"), "place"),
        pieces,
        _draws(rows, quota, blocks, seed, slots),
        numbered.select("row", "document") if carry else None,
    )


def _draws(rows: DataFrame, quota: list[int], blocks: list[int], seed: int, slots: int) -> DataFrame:
    spark, total = rows.sparkSession, sum(quota)
    shards = -(-total // slots)
    share = np.array(quota, float) / max(total, 1)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                size = min(slots, total - shard * slots)
                counts = np.random.default_rng([seed, shard]).multinomial(size, share)
                offsets = np.cumsum(counts) - counts
                chosen = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source": chosen.astype(np.int32), "slot": offsets[chosen], "n": counts[chosen]})

    runs = stored(spark.range(shards).mapInPandas(counted, "shard long, source int, slot long, n long"), "mix-runs")
    drawn = np.zeros(len(quota), np.int64)
    for number, n in runs.groupBy("source").agg(F.sum("n")).collect():
        drawn[number] = n
    numbered = totals_before(ranged(runs, ["source", "shard"]), ["source", "shard"], {"draw": F.col("n")})
    wanted, have = np.array(quota, np.int64), np.array(blocks, np.int64)
    base = np.cumsum(drawn) - drawn
    extra, short = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    extra_from, short_to = np.cumsum(extra) - extra, np.cumsum(short)

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy()
            run = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            owner = batch["source"].to_numpy()[run].astype(np.int64)
            draw = batch["draw"].to_numpy()[run] - base[owner] + step
            # A draw beyond its source's number becomes one that another source is short of.
            late = np.flatnonzero(draw >= wanted[owner])
            rank = extra_from[owner[late]] + draw[late] - wanted[owner[late]]
            taker = np.searchsorted(short_to, rank, side="right")
            draw[late] = drawn[taker] + rank - (short_to - short)[taker]
            owner[late] = taker
            epoch, place = draw // have[owner], draw % have[owner]
            spot = (seed * 1_000_003 + owner) * 64 + epoch
            shard = batch["shard"].to_numpy()[run]
            size = np.minimum(slots, total - shard * slots)
            slot = permute(batch["slot"].to_numpy()[run] + step, size, shard + np.int64(1 << 40))
            yield pd.DataFrame(
                {"shard": shard, "slot": slot, "source": owner.astype(np.int32), "block": permute(place, have[owner], spot), "epoch": epoch}
            )

    # Stored, so that the join with the blocks goes by the real size of the draws and not by that of the runs.
    return stored(numbered.mapInPandas(slots_of, "shard long, slot long, source int, block long, epoch long"), "mix-draws")


def taken(mixed: Mix) -> DataFrame:
    """The documents with ``taken``: words that the mix takes of each, repeats counted."""
    joined = mixed.draws.join(mixed.pieces, ["source", "block"])
    sums = joined.groupBy(F.col("source").alias("number"), "place").agg(F.sum("length").alias("taken"))
    out = mixed.documents.join(sums, ["number", "place"], "left")
    columns = [c for c in mixed.documents.columns if c not in ("number", "place")]
    return out.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(documents: DataFrame, mixed: Mix, text: str = "text") -> DataFrame:
    """The documents (all their columns) with the text that the mix takes: their pieces by epoch and place, set apart by a space.

    Documents that give no word go. ``documents`` must be those that ``mixed`` was drawn from, with their rows carried.
    Keys may be null or repeated: each row gets the words that were drawn of it.
    """
    if mixed.rows is None:
        raise ValueError("mix() must carry the rows")
    parts = mixed.draws.join(mixed.pieces, ["source", "block"])
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("epoch", "start", "length"))).alias("__parts"))
    rows = mixed.rows.join(lists, "row").select("document.*", "__parts")
    place = documents.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(documents_columns))
            bounds = parts.offsets.to_pylist()
            starts, lengths = (parts.values.field(name).to_numpy(zero_copy_only=False) for name in ("start", "length"))
            texts = []
            for i, value in enumerate(batch.column(place)):
                value = value.as_py()
                spans = np.fromiter(chain.from_iterable(m.span() for m in _WORD.finditer(value)), np.int64).reshape(-1, 2)
                chosen = slice(bounds[i], bounds[i + 1])
                first, last = spans[starts[chosen], 0].tolist(), spans[starts[chosen] + lengths[chosen] - 1, 1].tolist()
                texts.append(" ".join(value[a:b] for a, b in zip(first, last)))
            columns = batch.columns[: len(documents_columns)]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=documents_columns)

    documents_columns = documents.columns
    return rows.mapInArrow(cut, documents.schema)
