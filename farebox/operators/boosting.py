"""Boosted trees by histograms of binned features: M6, M7, M8, M9.

A pair of ``pyspark.ml`` stages over small integer codes (categories by index,
numbers by bin), squared loss. What the reference's trainer does, as one
distributed pass for each step:

* Rows with equal codes are one row with the mean label and the summed weight
  (for squared loss a sufficient statistic), so the frame is bounded by the
  domain of the features, not by the observations. It lies in cached blocks,
  one for each partition, with the running prediction of each row.
* A level of a tree needs, for each of its nodes, the sums of gradients and
  weights of every bin of every feature. Each block counts its own; tasks add
  them up, ``FAN_IN`` at a time, and the last one takes the splits. Joint sums of
  pairs or triples of features, where they are few (``JOINT_CELLS``), give two or
  three levels at once. The driver gets the tree only, not the sums.
* A category's column parts "is it" from "is it not", a number's bins are cut
  anywhere. Gain and leaves lean on ``l2`` (λ); a side needs ``least`` weight.
* Columns (one for each category, one for each number) are drawn once for
  each tree, and rows for each tree, both by a hash: nothing depends on order.
* Gradients are summed as whole numbers (a power of two above the largest
  possible sum would still be exact), so the trees are the same for any layout
  of the rows and any number of partitions.

The blocks of each tree follow from those of the one before; every
``CHECKPOINT`` trees they are written to the shared checkpoint folder, so that
a lost executor doesn't replay the run.

Prediction takes each distinct code vector once through all trees and joins the
results back: its work depends on the domain, not on the rows scored. A
category not seen in training is no category's; a value outside the bins
falls in the first or last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.session import materialize, ship_package

CHECKPOINT = 25
#: Code vectors of a block, where ``blocks`` doesn't say otherwise: a task has to be worth its start.
BLOCK_ROWS = 1 << 16
#: Sums that a task adds up.
FAN_IN = 16
#: Joint cells of a level's nodes up to which several levels come from one pass, and how many at most.
JOINT_CELLS, JOINT_LEVELS = 1 << 16, 3
MAX_BINS = 256
LEAST_GAIN = 1e-6
#: Bits that sums of gradients may take: whole numbers below are exact as doubles.
SUM_BITS = 52


# --- bins of numbers ---------------------------------------------------------

class _HasCuts(Params):
    cuts = Param(Params._dummy(), "cuts", "JSON object: column -> rising cut points",
                 typeConverter=TypeConverters.toString)


class NumericBinnerModel(Model, HasInputCols, _HasCuts, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``<column>_bin``: the number of cut points at or below ``<column>_num``."""

    def __init__(self, inputCols=None, cuts=None):
        super().__init__()
        self._setDefault(cuts="{}")
        if inputCols is not None:
            self._set(inputCols=inputCols)
        if cuts is not None:
            self._set(cuts=cuts)

    def cut_points(self) -> dict:
        return json.loads(self.getOrDefault(self.cuts))

    def _transform(self, df: DataFrame) -> DataFrame:
        for c, points in self.cut_points().items():
            if points:
                df = Bucketizer(splits=[-float("inf"), *points, float("inf")], inputCol=f"{c}_num",
                                outputCol=f"{c}_bin", handleInvalid="keep").transform(df)
            else:
                df = df.withColumn(f"{c}_bin", F.lit(0.0))
        return df


class NumericBinner(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One bin for each distinct value, or ``MAX_BINS`` quantiles if there are more."""

    def __init__(self, inputCols=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, df: DataFrame) -> NumericBinnerModel:
        cuts = {}
        for c in self.getInputCols():
            values = df.select(f"{c}_num").where(F.col(f"{c}_num").isNotNull()).distinct()
            found = sorted(r[0] for r in values.limit(MAX_BINS + 1).collect())
            if len(found) > MAX_BINS:
                shares = [k / MAX_BINS for k in range(MAX_BINS)]
                found = sorted(set(values.approxQuantile(f"{c}_num", shares, 0.1 / MAX_BINS)))
            cuts[c] = found[1:]
        return NumericBinnerModel(inputCols=self.getInputCols(), cuts=json.dumps(cuts))


# --- trees -------------------------------------------------------------------

@dataclass
class Plan:
    """What a fit is made of: features as codes, and the trainer's settings."""

    bins: list[int]                    # codes of each feature: 0 to bins - 1
    is_category: list[bool]
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.9
    columns: float = 0.9
    l2: float = 1.0
    least: float = 1.0
    seed: int = 42

    @property
    def live(self) -> list[int]:
        """Features with something to split."""
        return [f for f, n in enumerate(self.bins) if n > 1]

    def keys(self, levels: int) -> list[tuple[int, ...]]:
        """The groups of features whose joint sums give so many levels."""
        return list(combinations(self.live, levels))

    def span(self, level: int) -> int:
        """Levels that come from one pass that begins at ``level``."""
        for levels in range(min(JOINT_LEVELS, self.depth - level, len(self.live)), 1, -1):
            if sum(prod(self.bins[f] for f in key) for key in self.keys(levels)) << level <= JOINT_CELLS:
                return levels
        return 1

    def drawn(self, tree: int) -> list[np.ndarray]:
        """For each feature, which of its columns tree ``tree`` may use (a number has one)."""
        sizes = [n if c else 1 for n, c in zip(self.bins, self.is_category)]
        order = np.argsort(_hash(np.arange(sum(sizes), dtype=np.uint64), 2 * tree + 1, self.seed), kind="stable")
        kept = np.zeros(sum(sizes), dtype=bool)
        kept[order[:max(1, int(self.columns * len(kept)))]] = True
        return np.split(kept, np.cumsum(sizes)[:-1])


@dataclass
class Tree:
    """A full tree in heap order; a node without a split has feature -1 and hands all its rows to the left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(np.full(2 ** depth - 1, -1, dtype=np.int64), np.zeros(2 ** depth - 1, dtype=np.int64), np.zeros(2 ** depth))

    def nodes(self, codes: np.ndarray, levels: int, is_category: np.ndarray) -> np.ndarray:
        """Place, among the nodes of a level, of each row of ``codes(feature, row)``."""
        node, rows = np.zeros(codes.shape[1], dtype=np.int64), np.arange(codes.shape[1])
        for _ in range(levels):
            f, cut = self.feature[node], self.cut[node]
            code = codes[f, rows]                                        # -1 reads the last feature; it goes left below
            right = np.where(is_category[f], code == cut, code >= cut) & (f >= 0)
            node = 2 * node + 1 + right
        return node - (2 ** levels - 1)


def _hash(x: np.ndarray, *salts: int) -> np.ndarray:
    """A 64-bit mix (the splitmix finaliser) of whole numbers and some salts."""
    with np.errstate(over="ignore"):
        for salt in salts:
            x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


@dataclass
class Block:
    """The rows of a partition: codes, label, weight, running prediction, whole-number gradient."""

    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    key: np.ndarray
    prediction: np.ndarray
    gradient: np.ndarray = field(default=None)

    @classmethod
    def of(cls, rows: list[tuple], features: int, base: float, scale: float) -> Block:
        table = np.array(rows, dtype=np.float64).reshape(-1, features + 2)
        codes = np.ascontiguousarray(table[:, :features].T.astype(np.int64))
        key = np.zeros(codes.shape[1], dtype=np.uint64)
        for own in codes:
            key = _hash(key ^ own.astype(np.uint64), 1)
        block = cls(codes, table[:, features].copy(), table[:, features + 1].copy(), key, np.full(codes.shape[1], base))
        return block.graded(scale)

    def graded(self, scale: float) -> Block:
        self.gradient = np.rint(self.weight * (self.prediction - self.label) * scale)
        return self

    def after(self, tree: Tree, plan: Plan, scale: float) -> Block:
        """The block when ``tree`` has been added."""
        place = tree.nodes(self.codes, plan.depth, np.array(plan.is_category))
        return Block(self.codes, self.label, self.weight, self.key, self.prediction + tree.leaf[place]).graded(scale)

    def sums(self, tree: Tree, number: int, level: int, levels: int, plan: Plan) -> np.ndarray:
        """Gradient and weight sums of each node's cells, in one row."""
        drawn = (_hash(self.key, 2 * number, plan.seed) >> np.uint64(11)) < np.uint64(round(plan.rows * 2 ** 53))
        codes = self.codes[:, drawn]
        node = tree.nodes(codes, level, np.array(plan.is_category))
        values = (self.gradient[drawn], self.weight[drawn])
        out = []
        for key in plan.keys(levels):
            cell, size = node, 1
            for f in key:
                cell, size = cell * plan.bins[f] + codes[f], size * plan.bins[f]
            out += [np.bincount(cell, weights=v, minlength=size << level) for v in values]
        return np.concatenate(out)


@dataclass
class Candidates:
    """The possible splits of a node, by feature, then cut."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray                   # (candidate, 2): gradient and weight that go left
    right: np.ndarray

    def best(self) -> int | None:
        """The first of the best; None if nothing is gained."""
        k = int(self.gain.argmax()) if len(self.gain) else 0
        return k if len(self.gain) and self.gain[k] > LEAST_GAIN else None


def candidates(sums: dict[int, np.ndarray], plan: Plan, drawn: list[np.ndarray]) -> Candidates:
    """All splits of a node from ``sums[feature](bin, 2)``; gain is -inf where a side weighs too little."""
    parts = []
    for f, own in sums.items():
        total = own.sum(axis=0)
        if plan.is_category[f]:
            cut = np.flatnonzero(drawn[f])
            right = own[cut]
        elif drawn[f][0]:
            cut = np.arange(1, len(own))
            right = total - np.cumsum(own, axis=0)[:-1]
        else:
            continue
        parts.append((np.full(len(cut), f), cut, total - right, right))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Candidates(none, none, np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2)))
    feature, cut, left, right = (np.concatenate(p) for p in zip(*parts))
    score = lambda s: s[:, 0] ** 2 / (s[:, 1] + plan.l2)
    gain = score(left) + score(right) - score(left + right)
    return Candidates(feature, cut, np.where((left[:, 1] >= plan.least) & (right[:, 1] >= plan.least), gain, -np.inf), left, right)


Tables = dict[tuple[int, ...], np.ndarray]


def _marginals(tables: Tables, plan: Plan) -> dict[int, np.ndarray]:
    """Sums of each feature from joint ones."""
    out = {}
    for key, table in tables.items():
        for axis, f in enumerate(key):
            if f not in out:
                out[f] = table.sum(axis=tuple(k for k in range(len(key)) if k != axis))
    return {f: out[f] for f in plan.live}


def _side(tables: Tables, plan: Plan, levels: int, f: int, goes: np.ndarray) -> Tables:
    """Joint sums of one feature less, over the bins of ``f`` that ``goes`` marks."""
    out = {}
    for key in plan.keys(levels - 1):
        if f in key:
            wider = next(k for k in tables if set(key) < set(k))
            axis = next(i for i, k in enumerate(wider) if k not in key)
            shape = [1] * (levels - 1) + [1]
            shape[key.index(f)] = -1
            out[key] = tables[wider].sum(axis=axis) * goes.reshape(shape)
        else:
            wider = tuple(sorted((*key, f)))
            out[key] = np.compress(goes, tables[wider], axis=wider.index(f)).sum(axis=wider.index(f))
    return out


class Grower:
    """Grows one tree from level sums."""

    def __init__(self, plan: Plan, number: int, scale: float):
        self.plan, self.number, self.scale = plan, number, scale
        self.drawn = plan.drawn(number)
        self.tree = Tree.empty(plan.depth)
        self.totals = np.zeros((2 ** (plan.depth + 1) - 1, 2))           # gradient and weight of each node, in heap order

    def grow(self, blocks: RDD) -> Tree:
        plan, level = self.plan, 0
        while level < plan.depth and plan.live:
            levels = plan.span(level)
            self.tree, self.totals = level_splits(blocks, self, level, levels)
            level += levels
        self.settle()
        return self.tree

    def advance(self, flat: np.ndarray, level: int, levels: int) -> tuple[Tree, np.ndarray]:
        """The tree and its nodes' totals, some levels further, from their joint sums over all blocks."""
        plan, at, tables = self.plan, 0, {}
        for key in plan.keys(levels):
            shape = [plan.bins[f] for f in key]
            size = prod(shape) << level
            g, h = flat[at:at + size] / self.scale, flat[at + size:at + 2 * size]
            tables[key] = np.stack([g, h], axis=-1).reshape(1 << level, *shape, 2)
            at += 2 * size
        for node in range(1 << level):
            self.descend(2 ** level - 1 + node, {k: t[node] for k, t in tables.items()}, levels)
        return self.tree, self.totals

    def descend(self, place: int, tables: Tables, levels: int) -> None:
        """Splits a node, and its descendants as far as the tables reach."""
        split = self.split(place, _marginals(tables, self.plan))
        if levels == 1:
            return
        f, cut = split or (self.plan.live[0], None)
        codes = np.arange(self.plan.bins[f])
        right = np.zeros(len(codes), dtype=bool) if cut is None else codes == cut if self.plan.is_category[f] else codes >= cut
        self.descend(2 * place + 1, _side(tables, self.plan, levels, f, ~right), levels - 1)     # unsplit: all go left
        if split:
            self.descend(2 * place + 2, _side(tables, self.plan, levels, f, right), levels - 1)

    def split(self, place: int, sums: dict[int, np.ndarray]) -> tuple[int, int] | None:
        """Splits a node if that gains something, and notes its children's totals."""
        self.totals[place] = next(iter(sums.values())).sum(axis=0)
        found = candidates(sums, self.plan, self.drawn)
        k = found.best()
        if k is None:
            self.totals[2 * place + 1], self.totals[2 * place + 2] = self.totals[place], 0.0
            return None
        self.tree.feature[place], self.tree.cut[place] = found.feature[k], found.cut[k]
        self.totals[2 * place + 1], self.totals[2 * place + 2] = found.left[k], found.right[k]
        return int(found.feature[k]), int(found.cut[k])

    def settle(self) -> None:
        """Leaf values of the lowest level."""
        lowest = self.totals[2 ** self.plan.depth - 1:]
        self.tree.leaf[:] = -self.plan.rate * lowest[:, 0] / (lowest[:, 1] + self.plan.l2)


def exact_scale(weight: float, spread: float) -> float:
    """The power of two that keeps sums of whole-number gradients below ``SUM_BITS`` bits."""
    bound = max(weight * spread * 4, 1.0)
    return 2.0 ** (SUM_BITS - int(np.ceil(np.log2(bound))))


@dataclass
class Frame:
    """Distinct code vectors as cached blocks, and what their sums are scaled by."""

    blocks: RDD
    plan: Plan
    base: float
    scale: float
    spread: float


def blocks_of(rows: DataFrame, codes: list[str], label: str, weight: str | None, plan_of, partitions: int) -> Frame:
    """One row for each code vector, dealt to blocks (0: as many as their rows need); ``plan_of(bins)`` gives the plan."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    distinct = materialize(rows.sparkSession, rows.groupBy(*[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(codes)])
                           .agg(F.round(F.sum(F.col(label) * w) / F.sum(w), 9).alias("y"), F.sum(w).alias("w")), "code-vectors")
    names = [f"c{i}" for i in range(len(codes))]
    top = distinct.agg(F.count("*").alias("n"), F.sum((F.col("y") * F.col("w")).cast("decimal(38,9)")).alias("s"), F.sum("w").alias("w"),
                       F.min("y").alias("low"), F.max("y").alias("high"), *[F.max(c).alias(c) for c in names]).first()
    plan = plan_of([int(top[c]) + 1 for c in names])
    base, spread = float(top["s"]) / top["w"], top["high"] - top["low"]
    scale, n = exact_scale(top["w"], spread), len(codes)
    needed = -(-top["n"] // BLOCK_ROWS)
    dealt = distinct.select(*[F.col(c) for c in names], "y", "w").repartition(partitions or needed, *names)
    return Frame(dealt.rdd.mapPartitions(lambda part: [Block.of([tuple(r) for r in part], n, base, scale)]), plan, base, scale, spread)


def level_sums(blocks: RDD, tree: Tree, number: int, level: int, levels: int, plan: Plan) -> RDD:
    """The sums of some levels' joint cells over all blocks, added up in a tree of tasks: one element in one partition."""
    sums = blocks.map(lambda b: b.sums(tree, number, level, levels, plan))
    while (parts := sums.getNumPartitions()) > 1:
        width = -(-parts // FAN_IN)
        sums = (sums.mapPartitionsWithIndex(lambda i, own, width=width: ((i % width, s) for s in own))
                .reduceByKey(lambda a, b: a + b, width).values())
    return sums


def level_splits(blocks: RDD, grower: Grower, level: int, levels: int) -> tuple[Tree, np.ndarray]:
    """The grower's tree and totals some levels further; the splits are taken where the sums are."""
    sums = level_sums(blocks, grower.tree, grower.number, level, levels, grower.plan)
    return sums.map(lambda flat: grower.advance(flat, level, levels)).collect()[0]


def boost(frame: Frame, trees: int) -> list[Tree]:
    """Grows ``trees`` trees, each on the gradients that the ones before leave."""
    plan, scale = frame.plan, frame.scale
    blocks, grown, kept = frame.blocks.persist(StorageLevel.MEMORY_AND_DISK), [], []
    kept.append(blocks)
    for number in range(trees):
        tree = Grower(plan, number, scale).grow(blocks)
        grown.append(tree)
        blocks = blocks.map(lambda b, t=tree: b.after(t, plan, scale)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT == CHECKPOINT - 1:
            blocks.checkpoint()
        kept.append(blocks)
        if len(kept) > 2:
            kept.pop(0).unpersist()                                      # the one before still feeds the newest
    for old in kept:
        old.unpersist()
    return grown


# --- stages ------------------------------------------------------------------

class _Boosted(HasInputCols, HasPredictionCol):
    categories = Param(Params._dummy(), "categories", "input columns that are categories", typeConverter=TypeConverters.toListString)


class BoostedTreesModel(Model, _Boosted, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction of the fitted trees for the input codes."""

    trees = Param(Params._dummy(), "trees", "JSON: base, bins, feature, cut, leaf", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="prediction", categories=[], trees="{}")

    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.getInputCols()
        found = self.content()
        codes = [F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(n if c in self.getOrDefault(self.categories) else n - 1))
                 for c, n in zip(names, found["bins"])]                  # a category outside is the one behind the last
        keyed = df.withColumns({f"_code_{i}": c for i, c in enumerate(codes)})
        keys = [f"_code_{i}" for i in range(len(names))]
        scored = materialize(df.sparkSession, self.predictions(keyed.select(*keys).distinct()), "scored-vectors")
        return keyed.join(scored, keys).drop(*keys).select(*[F.col(f"`{c}`") for c in df.columns], self.getPredictionCol())

    def predictions(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` of codes with the ensemble's value of each."""
        spark, found, out = vectors.sparkSession, self.content(), self.getPredictionCol()
        ship_package(spark)
        shared = spark.sparkContext.broadcast([Tree(*(np.array(x) for x in t)) for t in zip(found["feature"], found["cut"], found["leaf"])])
        base, is_category = found["base"], np.array([c in self.getOrDefault(self.categories) for c in self.getInputCols()])
        depth = int(np.log2(len(found["leaf"][0]))) if found["leaf"] else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64)
                total = np.full(batch.num_rows, base)
                for tree in shared.value:
                    total += tree.leaf[tree.nodes(codes, depth, is_category)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, out])

        return vectors.mapInArrow(run, ", ".join([f"{c} int" for c in vectors.columns] + [f"{out} double"]))


class BoostedTrees(Estimator, _Boosted, HasLabelCol, HasWeightCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``maxIter`` trees. ``featureSubsetStrategy`` is the share of columns of a tree, or "all"."""

    maxIter = Param(Params._dummy(), "maxIter", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of each leaf that counts", typeConverter=TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows of a tree", typeConverter=TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "share of columns of a tree", typeConverter=TypeConverters.toString)
    l2 = Param(Params._dummy(), "l2", "weight of the squared leaves (lambda)", typeConverter=TypeConverters.toFloat)
    blocks = Param(Params._dummy(), "blocks", "partitions of the fit, 0: by size; the trees don't depend on it", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, categories=None, labelCol="label", maxIter=600, maxDepth=5, stepSize=0.05,
                 subsamplingRate=0.9, featureSubsetStrategy="0.9", l2=1.0, seed=42, blocks=0):
        super().__init__()
        self._setDefault(predictionCol="prediction", categories=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(labelCol="label", maxIter=600, maxDepth=5, stepSize=0.05, subsamplingRate=0.9,
                         featureSubsetStrategy="0.9", l2=1.0, seed=42, blocks=0)

    def setSubsamplingRate(self, value: float) -> BoostedTrees:
        return self._set(subsamplingRate=value)

    def setFeatureSubsetStrategy(self, value: str) -> BoostedTrees:
        return self._set(featureSubsetStrategy=value)

    def setWeightCol(self, value: str) -> BoostedTrees:
        return self._set(weightCol=value)

    def plan(self, bins: list[int]) -> Plan:
        share = self.getOrDefault(self.featureSubsetStrategy)
        return Plan(bins, [c in self.getOrDefault(self.categories) for c in self.getInputCols()],
                    self.getOrDefault(self.maxDepth), self.getOrDefault(self.stepSize), self.getOrDefault(self.subsamplingRate),
                    1.0 if share == "all" else float(share), self.getOrDefault(self.l2), seed=self.getSeed())

    def frame(self, df: DataFrame) -> Frame:
        """The blocks that a fit of ``df`` works on."""
        ship_package(df.sparkSession)
        weight = self.getWeightCol() if self.isDefined(self.weightCol) else None
        return blocks_of(df, self.getInputCols(), self.getLabelCol(), weight, self.plan, self.getOrDefault(self.blocks))

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        frame = self.frame(df)
        grown = boost(frame, self.getOrDefault(self.maxIter))
        content = {"base": frame.base, "bins": frame.plan.bins, **{k: [getattr(t, k).tolist() for t in grown] for k in ("feature", "cut", "leaf")}}
        model = BoostedTreesModel()
        model._set(inputCols=self.getInputCols(), categories=self.getOrDefault(self.categories),
                   predictionCol=self.getPredictionCol(), trees=json.dumps(content))
        return model


def root_candidates(frame: Frame) -> list[dict]:
    """Every split that the first tree's root may take: feature, cut, gain, and both sides' sums."""
    plan = frame.plan
    grower = Grower(plan, 0, frame.scale)
    flat, at, sums = level_sums(frame.blocks, grower.tree, 0, 0, 1, plan).collect()[0], 0, {}
    for f in plan.live:
        n = plan.bins[f]
        sums[f] = np.stack([flat[at:at + n] / frame.scale, flat[at + n:at + 2 * n]], axis=-1)
        at += 2 * n
    found = candidates(sums, plan, grower.drawn)
    best = found.best()
    return [dict(feature=int(f), cut=int(c), gain=float(g), left=a.tolist(), right=b.tolist(), chosen=k == best)
            for k, (f, c, g, a, b) in enumerate(zip(found.feature, found.cut, found.gain, found.left, found.right))]
