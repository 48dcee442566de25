"""Near-duplicates: MinHash bands, sequential Bayesian verification of signatures, exact verification of shingle sets.

Documents with equal sets of five-word shingles are one node. Signatures of HASHES minima are cut into bands; nodes
that agree in a band meet in a bucket. Bands of ROWS minima miss a pair of similarity 0.75 with probability
(1 - 0.75^4)^32 < 1e-5.

A pair is compared batch after batch of its signatures. After n minima with m matches the similarity s has the
posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as P(s >= 0.75) < MISS. Survivors are verified on their
full sets.

In a bucket every node is first compared with the bucket's smallest node, which connects groups of copies by as many
pairs as they have members. Nodes of a bucket that are not connected after that meet in tiles of bounded size, first
with signatures and, if a pair survives, with their sets. Pairs are compared and verified in place, each in the first
bucket that it shares, and a tile passes on the links that connect its nodes, not its pairs. So every pair of a bucket
is either connected or compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import bounded_batches, stored
from lethe.llm.components import components

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: Nodes of a bucket in one side of a tile.
TILE = 512
MEMO_WORDS = 150_000

_RANDOM = np.random.default_rng(20240229)
_FACTORS = (_RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_TURNS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_SPREADS = (_RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_BAND_FACTORS = (_RANDOM.integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles(dict):
    """Word hashes, remembered; ``of`` gives a text's set as sorted 64-bit hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        # bytes: lower() changes A-Z only, and split() cuts at ASCII white space.
        found = (text or "").encode().lower().split()
        if not found:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        if len(hashes) < SHINGLE:
            sums = (hashes * _FACTORS[: len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes))
            return _mixed(sums)
        count = len(hashes) - SHINGLE + 1
        sums = hashes[:count] * _FACTORS[0]
        for i in range(1, SHINGLE):
            sums += hashes[i : i + count] * _FACTORS[i]
        return np.unique(_mixed(sums))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 2048):
        least = np.minimum(least, ((short[start : start + 2048] ^ _TURNS) * _SPREADS).min(axis=1))
    return least


def needed_matches(miss: float = MISS) -> list[tuple[int, int]]:
    """(minima seen, matches that keep a pair) after each batch: P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m)."""
    t, out = PERCENT / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


_NEEDED = needed_matches()


def surviving(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the pairs of signatures (rows) that no batch drops."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in _NEEDED:
        batch = slice(n - BATCH, n)
        matches = matches + (left[alive, batch] == right[alive, batch]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u4").reshape(-1, HASHES)


def sketch(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, n_shingles, signature); node, a 128-bit hash of the set, is null for texts without words."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in bounded_batches(batches, "__text"):
            sets = [shingles.of(t) for t in batch["__text"]]
            yield pd.DataFrame(
                {
                    key: batch["__key"].to_numpy(),
                    "node": [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "n_shingles": [len(s) for s in sets],
                    "signature": [signature(s).astype("<u4").tobytes() if len(s) else None for s in sets],
                }
            )

    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    kind = documents.schema[key].dataType.simpleString()
    return plain.mapInPandas(rows, f"`{key}` {kind}, node binary, n_shingles long, signature binary")


def _buckets(minima: np.ndarray) -> np.ndarray:
    """The bucket of each signature (rows) in each band (columns)."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = _mixed((rows * _BAND_FACTORS).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * _FACTORS[0])
    return keys.view(np.int64)


def _banded(sketches: DataFrame) -> DataFrame:
    """(bucket, node): where each node falls, once for each band."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = _buckets(_matrix(batch["signature"]))
                yield pd.DataFrame({"bucket": keys.reshape(-1), "node": np.repeat(batch["node"].to_numpy(), BANDS)})

    return sketches.where("node is not null").select("node", "signature").mapInPandas(rows, "bucket long, node binary")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures pass every batch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.iloc[surviving(_matrix(batch["sa"]), _matrix(batch["sb"]))][["a", "b"]]

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(rows, "a binary, b binary")


def _sets(asked: DataFrame, nodes: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes asked for, made again from the text of each node's first document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in bounded_batches(batches, "__text"):
            found = [shingles.of(t) for t in batch["__text"]]
            # Of rows that share a key only those with the node's own text count.
            own = [xxhash.xxh128_digest(s.tobytes()) == n for s, n in zip(found, batch["node"])]
            yield pd.DataFrame({"node": batch["node"].to_numpy()[own], "shingles": [s.tobytes() for s, o in zip(found, own) if o]})

    wanted = nodes.join(asked.distinct(), "node", "left_semi").select("node", F.col("least").alias("__least"))
    plain = documents.select(documents[key].alias("__key"), documents[text].cast("string").alias("__text"))
    texts = plain.join(wanted, F.col("__key").eqNullSafe(F.col("__least"))).select("node", "__text")
    return stored(texts.mapInPandas(rows, "node binary, shingles binary"), "shingles")


def similar(one: bytes, two: bytes) -> bool:
    """Whether two whole sets are similar enough."""
    left, right = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    if PERCENT * max(len(left), len(right)) > 100 * min(len(left), len(right)):
        return False
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= PERCENT * (len(left) + len(right) - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.array([similar(x, y) for x, y in zip(batch["x"], batch["y"])], bool)
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInPandas(rows, "a binary, b binary").distinct()


_TILE = ["bucket", "first", "last"]


def _by_tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles of at least two nodes, from rows that come sorted by tile."""
    held: list[pd.DataFrame] = []

    def tiles() -> Iterator[pd.DataFrame]:
        for _, tile in pd.concat(held).groupby(_TILE, sort=False):
            # Nodes of repeated rows may come twice.
            tile = tile.drop_duplicates("node", ignore_index=True)
            if len(tile) > 1:
                yield tile

    for batch in batches:
        if not len(batch):
            continue
        # The last tile of a batch may go on in the next one.
        same = (batch[_TILE] == batch[_TILE].iloc[-1]).all(axis=1).to_numpy()
        if not same.all():
            held.append(batch[~same])
            yield from tiles()
            held = []
        held.append(batch[same])
    if held:
        yield from tiles()


def _candidates(tile: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each node of a tile the others, of other components, that it survives with, if the tile's bucket is their first."""
    minima, root, chunk = _matrix(tile["signature"]), pd.factorize(tile["root"])[0], tile["chunk"].to_numpy()
    bucket, first, last = tile[_TILE].iloc[0]
    keys = _buckets(minima)
    right = np.flatnonzero(chunk == last)
    for i in np.flatnonzero(chunk == first):
        others = right[(root[right] != root[i]) & ((right > i) | (first != last))]
        others = others[surviving(np.broadcast_to(minima[i], (len(others), HASHES)), minima[others])]
        if len(others):
            common = keys[others] == keys[i]
            others = others[keys[i][common.argmax(axis=1)] == bucket]
            if len(others):
                yield i, others


def _unconnected(members: DataFrame, nodes: DataFrame, roots: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b) between components of ``roots`` whose nodes share a bucket."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _by_tile(batches):
            hit = np.zeros(len(tile), bool)
            for i, others in _candidates(tile):
                hit[i] = hit[others] = True
            if hit.any():
                yield tile[hit]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _by_tile(batches):
            node, shingles, out = tile["node"].to_numpy(), tile["shingles"].to_numpy(), []
            group = pd.factorize(tile["root"])[0]
            for i, others in _candidates(tile):
                for j in others:
                    # Components that the tile has joined by now need no further link.
                    if group[i] != group[j] and similar(shingles[i], shingles[j]):
                        out.append((node[i], node[j]))
                        group[group == group[j]] = group[i]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    mixed = mixed.where(F.col("r0") != F.col("r1")).select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    rest = labelled.join(mixed, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = rest.select("bucket", "node", "root", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("last"))
    tiles = tiles.join(nodes.select("node", "signature"), "node")
    found = stored(tiles.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInPandas(marked, tiles.schema), "tiles")
    sets = _sets(found.select("node"), nodes, documents, key, text)
    full = found.join(sets, "node")
    return full.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInPandas(linked, "a binary, b binary").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (key, n_shingles, component_id, kept).

    ``component_id`` is the smallest key that links reach, ``kept`` marks the row that has it. Null and empty texts
    and texts of white space have no shingles and stay by themselves; so does a row with a null key in its group, but
    it is not kept if the group has a key. Repeated rows are linked by their equal sets. Other columns are ignored,
    and an empty table gives an empty result.
    """
    sketches = stored(sketch(documents, key, text), "sketches")
    banded = _banded(sketches)
    centers = banded.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("greatest"))
    centers = centers.where(F.col("center") != F.col("greatest")).select("bucket", "center")
    members = banded.join(centers, "bucket").where(F.col("node") != F.col("center")).distinct()
    members = stored(members, "members")
    asked = members.select("node").unionByName(members.select(F.col("center").alias("node"))).distinct()
    nodes = sketches.join(asked, "node", "left_semi").groupBy("node")
    nodes = stored(nodes.agg(F.min(key).alias("least"), F.first("signature").alias("signature")), "nodes")

    stars = members.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    likely = stored(_likely(stars, nodes), "likely")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node")))
    links = stored(_verified(likely, _sets(ends, nodes, documents, key, text)), "verified")
    roots = stored(components(links), "roots")
    more = stored(_unconnected(members.select("bucket", "node"), nodes, roots, documents, key, text), "verified")
    if not more.isEmpty():
        roots = stored(components(links.unionByName(more)), "roots")

    # The smallest key of each node and then of each component; empty sets keep their own.
    own = sketches.where("node is not null").groupBy("node").agg(F.min(key).alias("least"))
    rooted = own.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "component_id")
    out = sketches.select(key, "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"))
