"""Exact top-k inner products by dual-tree search over cover trees.

Components are turned into floor(SCALE * x), so scores are whole numbers.

1. Candidates with equal vectors become one point that keeps its k + 1 smallest
   ids: no other of them can be among a query's k best, as ties go to smaller
   ids and a query leaves out its own id only.
2. Points go to the nearest of at most ``PIVOTS`` sampled points and are dealt
   into blocks of about ``BLOCK`` points; queries are dealt into blocks too.
   Each block becomes a cover tree: a node's children are centred on a net of
   its points, ``SHRINK`` of its radius apart, and every node knows the
   distance of its farthest point. Children of few points share one leaf.
3. A query's k-th best score over the pivots (which are rows) is a first bound.
   Pairs of blocks whose centres and radii can't reach a block's lowest bound
   are dropped before their trees are joined.
4. Each remaining pair is searched in a task, both trees together: a pair of
   nodes is pruned if <p, q> + r_p |q| + r_q |p| + r_p r_q, the most that any of
   their points can score, is below the worst k-th score in the query node.
5. The k best over all pairs are taken by rank.

Pruning loses nothing, so results are exact. A vector that is null or holds
null or non-finite components takes no part, nor does a row without vec_id.
Only vectors of equal length are compared; rows that repeat an id with the
same vector count once. Fewer candidates than k give fewer rows. Products are
64-bit; components should be such that they fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.common import map_batches, scratch, ship

SCALE = 1024
K = 10
PIVOTS = 64
BLOCK, QUERY_BLOCK = 2048, 512
LEAF = 48
SHRINK = 0.75
BLOCK_ROW = "block long, dim int, low double, centre array<double>, radius double, tree binary"


class Tree:
    """Cover tree over the rows of ``points``, in flat arrays."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order: list[np.ndarray] = []              # rows of each leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        mean = int(np.argmin(((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1)))
        self._node(np.arange(len(points)), self.points[mean])
        self.norm = [float(np.sqrt(c @ c)) for c in self.centre]

    def _node(self, rows: np.ndarray, centre: np.ndarray, closed: bool = False) -> int:
        at = len(self.centre)
        distance = np.sqrt(((self.points[rows] - centre) ** 2).sum(axis=1))
        radius = float(distance.max()) if len(rows) else 0.0
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.leaf.append(-1)
        if closed or len(rows) <= LEAF or radius == 0:
            self.leaf[at] = len(self.order)
            self.order.append(rows)
            return at
        owner, centres = np.zeros(len(rows), dtype=np.int64), [centre]
        while True:                                    # a net of points SHRINK * radius apart
            far = int(np.argmax(distance))
            if distance[far] <= SHRINK * radius:
                break
            centres.append(self.points[rows[far]])
            other = np.sqrt(((self.points[rows] - centres[-1]) ** 2).sum(axis=1))
            closer = other < distance
            owner[closer] = len(centres) - 1
            distance = np.minimum(distance, other)
        size = np.bincount(owner, minlength=len(centres))
        few = rows[size[owner] < LEAF // 4]
        for c in np.flatnonzero(size >= LEAF // 4):
            self.children[at].append(self._node(rows[owner == c], centres[c], size[c] == len(rows)))
        for i in range(0, len(few), LEAF):
            self.children[at].append(self._node(few[i:i + LEAF], centre, True))
        return at

    def bound(self, a: int, other: "Tree", b: int) -> float:
        """The most that a point of node a and one of the other tree's node b can score."""
        return (float(self.centre[a] @ other.centre[b]) + self.radius[a] * other.norm[b]
                + other.radius[b] * self.norm[a] + self.radius[a] * other.radius[b]) * (1 + 1e-12) + 1e-6


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.scores = [np.zeros(0, dtype=np.int64)] * n
        self.ids = [np.zeros(0, dtype=np.int64)] * n
        self.worst = floors.copy()

    def add(self, query: int, own: int, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        hit = np.flatnonzero(scores >= self.worst[query])
        if not len(hit):
            return
        each = [ids[i] for i in hit.tolist()]
        all_ids = np.concatenate([self.ids[query], *each])
        all_scores = np.concatenate([self.scores[query], np.repeat(scores[hit], [len(x) for x in each])])
        kept = all_ids != own
        all_ids, all_scores = all_ids[kept], all_scores[kept]
        top = np.lexsort((all_ids, -all_scores))[:self.k]
        self.ids[query], self.scores[query] = all_ids[top], all_scores[top]
        if len(top) == self.k:
            self.worst[query] = max(self.floors[query], all_scores[top[-1]])


def dual_search(queries: Tree, own: np.ndarray, floors: np.ndarray, data: Tree, ids: list[np.ndarray], k: int) -> Best:
    """The k best ids for each query: both trees are descended together."""
    best = Best(len(own), k, floors.astype(np.float64))
    rows_of: dict[int, np.ndarray] = {}

    def rows(a: int) -> np.ndarray:
        if a not in rows_of:
            rows_of[a] = queries.order[queries.leaf[a]] if queries.leaf[a] >= 0 else np.concatenate([rows(c) for c in queries.children[a]])
        return rows_of[a]

    exact = (np.abs(queries.points).max(initial=0) * np.abs(data.points).max(initial=0) * queries.points.shape[1]) < 2 ** 52
    stack = [(0, 0, queries.bound(0, data, 0))]
    while stack:
        a, b, bound = stack.pop()
        mine = rows(a)
        if bound < best.worst[mine].min():
            continue
        if queries.leaf[a] >= 0 and data.leaf[b] >= 0:
            there = data.order[data.leaf[b]]
            p, q = queries.points[mine], data.points[there]
            scores = (p @ q.T).astype(np.int64) if exact else p.astype(np.int64) @ q.astype(np.int64).T
            names = [ids[i] for i in there.tolist()]
            for i in np.flatnonzero(scores.max(axis=1) >= best.worst[mine]).tolist():
                best.add(int(mine[i]), int(own[mine[i]]), scores[i], names)
        elif data.leaf[b] >= 0 or (queries.leaf[a] < 0 and queries.radius[a] > data.radius[b]):
            stack += [(c, b, queries.bound(c, data, b)) for c in queries.children[a]]
        else:
            more = [(a, c, queries.bound(a, data, c)) for c in data.children[b]]
            stack += sorted(more, key=lambda x: x[2])                    # the most promising is searched first
    return best


def _points(column: pa.Array) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _block(block: int, points: np.ndarray, low: float, *arrays: np.ndarray) -> pa.Table:
    """One row that holds the block's tree, as numpy arrays, and its outline."""
    centre = points.mean(axis=0)
    radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1)).max())
    return pa.table({"block": [block], "dim": pa.array([points.shape[1]], pa.int32()), "low": [low], "centre": [centre.tolist()],
                     "radius": [radius], "tree": [pickle.dumps((Tree(points), *arrays))]})


def _data_block(group: pa.Table) -> pa.Table:
    points = _points(group["v"])
    ids = [np.array(x, dtype=np.int64) for x in group["ids"].to_pylist()]
    return _block(group["block"][0].as_py(), points, 0.0, np.concatenate(ids), np.cumsum([len(x) for x in ids])[:-1])


def numbers(vector: Column) -> Column:
    """floor(SCALE * x) of each component, or null if the vector takes no part."""
    doubles = vector.cast("array<double>")
    whole = F.transform(doubles, lambda x: F.floor(x * SCALE).cast("bigint"))
    odd = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), whole)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of ``vectors(vec_id, embedding)``.

    Queries are the rows where ``is_query`` (a condition on vec_id) holds;
    candidates of a query are all rows with another id.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = scratch(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers(F.col("embedding")).alias("v"))
                   .where("vec_id is not null and v is not null").distinct()
                   .withColumn("dim", F.size("v")).withColumn("name", F.xxhash64("v")), "vectors")
    same = Window.partitionBy("name", "v").orderBy("vec_id")
    points = (rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
              .groupBy("name", "dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "name").limit(PIVOTS).select("vec_id", "v").collect()   # PIVOTS rows
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r[1]) for r in sampled}:
        own = [r for r in sampled if len(r[1]) == dim]
        pivots[dim] = np.array([r[0] for r in own]), np.array([r[1] for r in own], dtype=np.float64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = np.zeros(batch.num_rows, dtype=np.int32)
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) in pivots:
                    x = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1).astype(np.float64)
                    p = pivots[int(dim)][1]
                    nearest[at] = np.argmin((p ** 2).sum(axis=1) - 2 * x @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[*batch.schema.names, "pivot"])

    def query_block(group: pa.Table) -> pa.Table:
        own, queries = group["vec_id"].to_numpy(), _points(group["v"])
        floors = np.full(len(own), -np.inf)
        names, p = pivots.get(queries.shape[1], (np.zeros(0), np.zeros((0, queries.shape[1]))))
        scores = queries.astype(np.float64) @ p.T
        scores[own[:, None] == names[None, :]] = -np.inf
        if len(names) >= k:
            floors = np.partition(scores, len(names) - k, axis=1)[:, len(names) - k]
            floors -= 1e-9 * np.abs(floors)
        return _block(group["block"][0].as_py(), queries, float(floors.min()), own, floors)

    placed = map_batches(points.select("name", "dim", "v", "ids"), near, "name long, dim int, v array<bigint>, ids array<bigint>, pivot int")
    placed = scratch(placed, "points")
    sizes = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    data = (placed.join(sizes, ["dim", "pivot"])
            .withColumn("block", F.xxhash64("dim", "pivot", F.pmod(F.xxhash64("name"), F.col("parts"))))
            .select("block", "v", "ids").groupBy("block").applyInArrow(_data_block, BLOCK_ROW))
    queries = rows.where(is_query)
    counts = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("parts"))
    asked = (queries.join(counts, "dim")
             .withColumn("block", F.xxhash64("dim", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
             .select("block", "vec_id", "v").groupBy("block").applyInArrow(query_block, BLOCK_ROW))
    data, asked = scratch(data, "trees"), scratch(asked, "trees")

    def norm(c: str) -> Column:
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))

    one = asked.select("dim", F.col("block").alias("query_block"), "low", F.col("centre").alias("a"), F.col("radius").alias("ra"))
    two = data.select("dim", F.col("block").alias("data_block"), F.col("centre").alias("b"), F.col("radius").alias("rb"))
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = product + F.col("ra") * norm("b") + F.col("rb") * norm("a") + F.col("ra") * F.col("rb")
    pairs = one.join(two, "dim").where(reach * (1 + 1e-9) + 1e-3 >= F.col("low")).select("query_block", "data_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column(0), batch.column(1)):
                (query_tree, own, floors), (data_tree, ids, cuts) = pickle.loads(q.as_py()), pickle.loads(d.as_py())
                best = dual_search(query_tree, own, floors, data_tree, np.split(ids, cuts), k)
                n = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, n), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()),
                     pa.array(np.concatenate(best.scores), pa.int64())], names=["query_id", "vec_id", "score"])

    matched = (pairs.join(asked.select(F.col("block").alias("query_block"), F.col("tree").alias("asked")), "query_block")
               .join(data.select(F.col("block").alias("data_block"), F.col("tree").alias("held")), "data_block")
               .select("asked", "held"))
    found = map_batches(matched, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
