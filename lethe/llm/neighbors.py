"""Nearest neighbors by inner product: stable projections, kd-trees, and a chi-square stopping test.

Inner products become distances when each vector gets one more component, sqrt(M^2 - |x|^2) for candidates (M the
longest length) and 0 for queries: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Gaussian projections to DIMENSIONS numbers keep
distances up to chance: the squared ratio of projected to true distance is chi-square with DIMENSIONS degrees. A kd-tree
yields candidates by projected distance; each is verified on the original vector. The search stops once a point that
beat the k-th best would, with probability CERTAINTY, have shown a smaller projected distance than the next one.

The table is cut into cells by a small kd-tree over a bounded sample; every row is indexed, in the tree of its cell. A
query first visits its own cell, then, knowing its k-th best, the cells that the test leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import stored

#: Even, for the closed form of the chi-square distribution.
DIMENSIONS = 8
CERTAINTY = 0.8
NEIGHBORS = 20
LEAF = 256
#: Rows that a cell should hold, rows of the sample that places the cells, and cells at most (larger ones are split).
CELL_ROWS = 8_192
SAMPLE_ROWS = 20_000
MAX_CELLS = 4_096
#: Queries that meet a cell in one task.
QUERY_ROWS = 8_192


def chi_square(x: np.ndarray | float, degrees: int = DIMENSIONS) -> np.ndarray | float:
    """Distribution function for an even number of degrees."""
    half = np.asarray(x, float) / 2
    term = total = np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_bound(certainty: float, degrees: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < certainty else (low, middle)
    return high


class Tree:
    """A kd-tree in arrays: nodes 2i+1 and 2i+2 below node i, split at the median of the widest side.

    ``order`` lists the points leaf after leaf; a node stands for the stretch ``first`` to ``last`` of it.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        depth = max(0, math.ceil(math.log2(max(len(points), 1) / leaf)))
        nodes = (2 << depth) - 1
        self.leaves = nodes // 2
        self.low = np.full((nodes, points.shape[1]), np.inf)
        self.high = np.full((nodes, points.shape[1]), -np.inf)
        self.first, self.last = np.zeros(nodes, int), np.zeros(nodes, int)
        self.order, self.last[0] = np.arange(len(points)), len(points)
        for node in range(nodes):
            a, b = self.first[node], self.last[node]
            rows = self.order[a:b]
            if a < b:
                self.low[node], self.high[node] = points[rows].min(axis=0), points[rows].max(axis=0)
            if node < self.leaves:
                if a < b:
                    side = int(np.argmax(self.high[node] - self.low[node]))
                    self.order[a:b] = rows[np.argsort(points[rows, side], kind="stable")]
                half = (a + b) // 2
                self.first[2 * node + 1], self.last[2 * node + 1] = a, half
                self.first[2 * node + 2], self.last[2 * node + 2] = half, b

    def leaves_by_distance(self, point: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(squared distance of the box, first, last) of the leaves, nearest first."""
        heap = [(0.0, 0)]
        while heap:
            distance, node = heapq.heappop(heap)
            if node >= self.leaves:
                if self.first[node] < self.last[node]:
                    yield distance, self.first[node], self.last[node]
                continue
            children = slice(2 * node + 1, 2 * node + 3)
            gap = np.maximum(0, np.maximum(self.low[children] - point, point - self.high[children]))
            for child, square in zip((2 * node + 1, 2 * node + 2), (gap * gap).sum(axis=1).tolist()):
                if square < math.inf:
                    heapq.heappush(heap, (square, child))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, place: np.ndarray, own: int, longest: float, bound: float, k: int, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of one tree, ``own`` excepted; ``floor`` is a k-th best score that is known already.

    ``ids`` and ``vectors`` stand in the order of the tree's leaves.
    """
    best_ids, best = np.empty(0, np.int64), np.empty(0)
    square = float(query @ query) + longest * longest
    slack = 1e-9 * square
    for distance, first, last in tree.leaves_by_distance(place):
        kth = max(floor, best[k - 1] if len(best) >= k else -math.inf)
        if kth > -math.inf and distance >= bound * max(square - 2 * kth, 0.0):
            break
        # The product of a whole leaf may round equal vectors apart; what comes near is added up row by row.
        near = np.flatnonzero((vectors[first:last] @ query >= kth - slack) & (ids[first:last] != own)) + first
        if len(near):
            scores = (vectors[near] * query).sum(axis=1)
            best_ids, best = _best(np.concatenate([best_ids, ids[near]]), np.concatenate([best, scores]), k)
    return best_ids, best


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components and not zero; doubles."""
    v = F.col(vector).cast("array<double>")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    # One vector per id: repeated rows are one candidate, and one query.
    return rows.where(finite & F.exists("v", lambda x: x != 0.0)).groupBy("id").agg(F.min("v").alias("v"))


def nearest(embeddings: DataFrame, every: int = 20, k: int = NEIGHBORS, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part; neither do null ids, nor
    vectors of another length than the most frequent one. Ties go to the smaller id. Other columns are ignored. A repeated
    id counts once, with its smallest vector; equal vectors of different ids are separate candidates.
    """
    spark = embeddings.sparkSession
    rows = _clean(embeddings, key, vector).withColumn("__size", F.size("v"))
    sizes = rows.groupBy("__size").count().orderBy(F.desc("count"), "__size").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes[0][0]
    rows = rows.where(F.col("__size") == size)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest, total = rows.agg(F.sqrt(F.max(square)), F.count(F.lit(1))).first()
    # Each projection is a sum over the added component as well: its own column of the matrix comes last.
    matrix = np.random.default_rng(seed).standard_normal((size + 1, DIMENSIONS))
    bound = chi_square_bound(CERTAINTY)

    def project(vectors: np.ndarray, added: np.ndarray) -> np.ndarray:
        return vectors @ matrix[:-1] + added[:, None] * matrix[-1]

    def added(vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))

    # The cells: median cuts of a bounded sample, chosen by a hash of the id.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()
    points = np.array([r[0] for r in sample])
    points = project(points, added(points))
    cells = min(MAX_CELLS, max(1, -(-total // CELL_ROWS)))
    depth = math.ceil(math.log2(cells))
    cuts: list[tuple[int, float]] = []
    groups = [np.arange(len(points))]
    for _ in range(depth):
        below = []
        for group in groups:
            side = int(np.argmax(np.ptp(points[group], axis=0))) if len(group) else 0
            cut = float(np.median(points[group, side])) if len(group) else 0.0
            cuts.append((side, cut))
            below += [group[points[group, side] <= cut], group[points[group, side] > cut]]
        groups = below

    def cell_of(places: np.ndarray) -> np.ndarray:
        node = np.zeros(len(places), np.int64)
        if cuts:
            side, cut = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
            for _ in range(depth):
                node = 2 * node + 1 + (places[np.arange(len(places)), side[node]] > cut[node])
        return node - ((1 << depth) - 1)

    low, high = np.full((1 << depth, DIMENSIONS), -np.inf), np.full((1 << depth, DIMENSIONS), np.inf)
    for cell in range(1 << depth):
        node = cell + (1 << depth) - 1
        while node:
            above = (node - 1) // 2
            side, cut = cuts[above]
            if node == 2 * above + 1:
                high[cell, side] = min(high[cell, side], cut)
            else:
                low[cell, side] = max(low[cell, side], cut)
            node = above

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["v"].to_numpy())
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "v": batch["v"], "cell": cell_of(project(vectors, added(vectors)))})

    points_table = stored(rows.select("id", "v").mapInPandas(placed, "id long, v array<double>, cell long"), "vectors")
    # A cell with more rows than planned (equal vectors, say) is split by a hash of the id, exactly as needed.
    counts = points_table.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / (2 * CELL_ROWS)).cast("int"))
    parts = {r["cell"]: r["parts"] for r in counts.select("cell", "parts").collect()}
    parts_of = F.element_at(F.array(*[F.lit(parts.get(c, 0)) for c in range(1 << depth)]), (F.col("cell") + 1).cast("int"))
    points_table = points_table.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(parts_of, F.lit(1))))

    queries = points_table.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["q"].to_numpy())
                yield batch.assign(cell=cell_of(project(vectors, np.zeros(len(vectors)))), floor=-math.inf)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["q"].to_numpy())
            places = project(vectors, np.zeros(len(vectors)))
            home, floors = cell_of(places), batch["floor"].to_numpy()
            far = (vectors * vectors).sum(axis=1) + longest * longest - 2 * floors
            for cell in range(1 << depth):
                gap = np.maximum(0, np.maximum(low[cell] - places, places - high[cell]))
                chosen = np.flatnonzero((home != cell) & ((gap * gap).sum(axis=1) < bound * np.maximum(far, 0)))
                if len(chosen):
                    yield batch.iloc[chosen].assign(cell=cell)

    def joined(key_: tuple, points_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        if not len(points_) or not len(queries_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, vectors = points_["id"].to_numpy(), np.stack(points_["v"].to_numpy())
        tree = Tree(project(vectors, added(vectors)))
        ids, vectors = ids[tree.order], np.ascontiguousarray(vectors[tree.order])
        out = []
        for own, query, floor in zip(queries_["query_id"], queries_["q"], queries_["floor"]):
            place = project(query[None, :], np.zeros(1))[0]
            found, scores = search(tree, ids, vectors, query, place, own, longest, bound, k, floor)
            out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
        return pd.concat(out)

    def visit(visits: DataFrame) -> DataFrame:
        # Each query meets every part of the cell; blocks of queries bound what one task holds.
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts_of, F.lit(1)).cast("long") - 1)))
        visits = visits.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        points_ = points_table.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        keys = ["cell", "part", "__block"]
        return points_.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(joined, schema)

    asked = queries.count()
    blocks = max(1, -(-asked // QUERY_ROWS))
    kinds = "query_id long, q array<double>, cell long, floor double"
    first = stored(visit(queries.mapInPandas(homes, kinds)), "near-home")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.get("s", F.lit(k - 1))).otherwise(-math.inf).alias("floor"))
    known = queries.join(kth, "query_id", "left").select("query_id", "q", F.lit(0).cast("long").alias("cell"), F.coalesce("floor", F.lit(-math.inf)).alias("floor"))
    second = visit(known.mapInPandas(others, kinds))
    lists = first.unionByName(second).groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))).alias("all"))
    best = lists.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("rank", "x"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
