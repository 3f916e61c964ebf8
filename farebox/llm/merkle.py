"""Merkle manifest of a dataset: a persistent tree whose versions copy paths.

Every row is a leaf, the digest of its fields. Leaves of one source, by
doc_id, are hashed in runs of ``FAN`` level by level to a subroot; subroots, by
source, in the same way to the root. Digests enter a hash as hex text.

A tampered leaf makes a version of the tree. The tree is persistent: a version
copies the leaf's ancestors only and shares every other node with the original
(``Tree.version``). Versions are independent, one for each row, and each is as
long as the tree is high.

1. Leaf digests come from one scan of the texts and are stored; texts are not
   shuffled. Leaves are numbered within their source by a range sort (positions
   in each partition, plus a running sum of the partitions' counts).
2. Aligned blocks of ``FAN ** LEVELS`` leaves are rows of a table; a block is
   hashed to its own root in one task, whatever its source's size. The blocks'
   roots are the leaves of the next round, till each source has one node; then
   the subroots are treated in the same way. Tables shrink 243 times a round.
3. From the top down, every block learns its path: for each level above it,
   the other nodes of the run, left and right. It passes its children theirs
   in a join of one row for each block.
4. Versions begin within the blocks of leaves, where the ancestors up to the
   block's root are copied, and go on through the upper nodes of the path, in
   the tasks that hold the blocks. Rows whose version has the same block root
   (all that aren't tampered with) share the upper copies.

Edge cases: a null field is ``-``; an empty text is ``0:``. A null doc_id comes
first in its source and is never tampered with; a null source is a source of
its own, first of all. Rows that repeat a doc_id are ordered by their leaf
digest; equal rows are leaves side by side. Texts without a line break can't be tampered with. A
source of one row is its own subroot, a table of one source its own root; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.common import map_batches, scratch

# Fixed value: nodes of a run.
FAN = 3
#: Levels that a block spans.
LEVELS = 5
BLOCK = FAN ** LEVELS

STEP = "struct<left:string,right:string>"
OUT = (f"doc_id long, leaf string, tampered_leaf string, subroot string, path array<{STEP}>, copies array<string>")
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest_of(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Tree:
    """A block's nodes, level by level; versions share them."""

    def __init__(self, leaves: list[str], height: int):
        self.levels = [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest_of(below[i:i + FAN]) for i in range(0, len(below), FAN)])

    @classmethod
    def block(cls, number: int, leaves: list[str]) -> Tree:
        """The first block ends where one node is left; others have all levels,
        as has a full first block (243 nodes leave one after five levels)."""
        height, left = 0, len(leaves)
        while left > 1:
            height, left = height + 1, -(-left // FAN)
        return cls(leaves, height if number == 0 else LEVELS)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[tuple[str, str]]:
        """For each level, what stands left and right of leaf i's ancestor in its run."""
        steps = []
        for nodes in self.levels[:-1]:
            low = i - i % FAN
            steps.append(("".join(nodes[low:i]), "".join(nodes[i + 1:low + FAN])))
            i //= FAN
        return steps

    @staticmethod
    def version(leaf: str, path: list[tuple[str, str]]) -> list[str]:
        """The nodes that a version with another leaf copies: its ancestors, upwards."""
        copies = []
        for left, right in path:
            leaf = digest_of([left, leaf, right])
            copies.append(leaf)
        return copies


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, changed (the tampered leaf, else null) of each row; digests as bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    head = F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])

    def leaf(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(head, _field(text)), 256))

    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    return rows.select(F.col("source").cast("string").alias("source"), "doc_id", leaf(F.col("text")).alias("leaf"),
                       F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``, laid out by group and order, and the runs of groups
    in partitions (part, group..., offset): ``at`` + offset is the place in the group."""
    keys = [*group, *order]
    laid = scratch(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()), "laid")
    runs = laid.groupBy(F.shiftright("at", 33).alias("part"), *group).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    return laid, runs.withColumn("offset", offset).select("part", *group, "offset")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, place, node...) rows to one row a block: tree, block, nodes by place."""
    names = [c for c in nodes.columns if c != "tree"]
    rows = (nodes.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("tree", "block")
            .agg(F.sort_array(F.collect_list(F.struct(*names))).alias("nodes")))
    return rows.select("tree", "block", *[F.col(f"nodes.{c}").alias(c) for c in names if c != "place"])


def _hexes(column: pa.Array, row: int) -> list[str]:
    return [x if x is None else x.hex() for x in column[row].as_py()]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, leaf) to (tree, block, root)."""
    for batch in batches:
        roots = [bytes.fromhex(Tree.block(number, _hexes(batch.column(2), i)).root) for i, number in enumerate(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], names=["tree", "block", "root"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, leaf, path, subroot) to the paths of a block's nodes."""
    for batch in batches:
        trees, places, paths, subroots = [], [], [], []
        for i, (tree, number, above, subroot) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)))):
            block = Tree.block(number, _hexes(batch.column(2), i))
            for k in range(len(block.levels[0])):
                trees.append(tree)
                places.append(number * BLOCK + k)
                paths.append([{"left": a, "right": b} for a, b in block.path(k)] + above)
                subroots.append(subroot)
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.array(paths, pa.list_(_STEP)),
                                          pa.array(subroots, pa.string())], names=["tree", "block", "path", "subroot"])


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, block, leaf, path, subroot, doc_id, changed) to ``OUT``, one row for each leaf."""
    for batch in batches:
        for i, (number, above, subroot) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))):
            own, changed, upper = _hexes(batch.column(2), i), _hexes(batch.column(6), i), {}
            block = Tree.block(number, own)
            above = [(s["left"], s["right"]) for s in above]
            paths, copies = [], []
            for k, leaf in enumerate(own):
                path = block.path(k)
                low = Tree.version(changed[k] or leaf, path)
                top = low[-1] if low else changed[k] or leaf
                if top not in upper:
                    upper[top] = Tree.version(top, above)
                paths.append([{"left": a, "right": b} for a, b in path + above])
                copies.append(low + upper[top])
            yield pa.RecordBatch.from_arrays(
                [batch.column(5)[i].values, pa.array(own, pa.string()), pa.array(changed, pa.string()),
                 pa.array([subroot] * len(own), pa.string()), pa.array(paths, pa.list_(_STEP)), pa.array(copies, pa.list_(pa.string()))],
                names=["doc_id", "leaf", "tampered_leaf", "subroot", "path", "copies"])


def _climb(blocks: DataFrame) -> list[DataFrame]:
    """Rounds of (tree, block, leaf): the given blocks, then blocks of blocks, till each tree has one."""
    rounds = [blocks]
    while True:
        roots = map_batches(rounds[-1].select("tree", "block", "leaf"), _roots, "tree long, block long, root binary")
        roots = scratch(roots, "roots")
        rounds.append(roots)
        if roots.where("block > 0").isEmpty():
            return rounds
        rounds.append(scratch(_blocks(roots.select("tree", F.col("block").alias("place"), F.col("root").alias("leaf"))), "blocks"))


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with their path and subroot; ``tops`` has those of whole trees (tree, block 0)."""
    for blocks in reversed(rounds[0:-1:2]):
        placed = blocks.join(tops, ["tree", "block"])
        if blocks is rounds[0]:
            return placed
        tops = scratch(map_batches(placed.select("tree", "block", "leaf", "path", "subroot"), _children,
                                   f"tree long, block long, path array<{STEP}>, subroot string"), "paths")


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, source, lang, n_chars, text)``.

    doc_id, leaf, tampered_leaf (null: not tampered with), subroot, path
    (siblings of each level up to the root: left, right), copies (the nodes
    that its version copies, from the leaf's parent to the root), root,
    folded_root (the version's root).
    """
    rows = scratch(leaves(docs), "leaves").withColumn("row", F.monotonically_increasing_id())       # parts equal rows
    laid, runs = numbered(rows, ["source"], ["doc_id", "leaf", "row"])
    runs = scratch(runs, "runs")
    order, order_runs = numbered(runs.select("source").distinct(), [], ["source"])
    trees = (order.join(order_runs, F.shiftright(order["at"], 33) == order_runs["part"])
             .select(F.col("source").alias("name"), (F.col("at") + F.col("offset")).alias("tree")))
    runs = scratch(runs.join(trees, F.col("source").eqNullSafe(F.col("name"))).select("part", "source", "tree", "offset"), "runs")
    nodes = (laid.join(runs.withColumnRenamed("source", "name"), (F.shiftright("at", 33) == F.col("part")) & F.col("source").eqNullSafe(F.col("name")))
             .select("tree", (F.col("at") + F.col("offset")).alias("place"), "doc_id", "leaf", "changed"))
    rounds = _climb(scratch(_blocks(nodes), "blocks"))

    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("leaf"))
    upper = _climb(scratch(_blocks(subroots), "blocks"))
    root = upper[-1].first()                                              # one row; none in an empty table
    root_hex = F.lit(root["root"].hex() if root else None).cast("string")
    top = upper[-1].select("tree", "block", F.array().cast(f"array<{STEP}>").alias("path"), F.lit("").alias("subroot"))
    paths = map_batches(_descend(upper, top).select("tree", "block", "leaf", "path", "subroot"), _children,
                        f"tree long, block long, path array<{STEP}>, subroot string")
    tops = (rounds[-1].join(paths.select(F.col("block").alias("tree"), "path"), "tree")
            .select("tree", "block", "path", F.lower(F.hex("root")).alias("subroot")))
    placed = _descend(rounds, scratch(tops, "paths"))
    out = map_batches(placed.select("tree", "block", "leaf", "path", "subroot", "doc_id", "changed"), _versions, OUT)
    last = F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.coalesce("tampered_leaf", "leaf"))
    return out.withColumn("root", root_hex).withColumn("folded_root", last)
