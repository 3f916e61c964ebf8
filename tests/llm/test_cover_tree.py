import math
import random

import numpy as np
from pyspark.sql import functions as F

from farebox.llm import cover_tree as C


def brute(rows, k):
    held = sorted({(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
                   if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, v in held:
        if q % 100 == 0:
            best = {}
            for i, w in held:
                if i != q and len(w) == len(v):
                    best.setdefault((i, sum(a * b for a, b in zip(v, w))), None)
            top = sorted(best, key=lambda p: (-p[1], p[0]))[:k]
            out += [(q, n + 1, i, s) for n, (i, s) in enumerate(top)]
    return sorted(out)


def test_edges_ties_copies_and_lengths(spark):
    rng = random.Random(1)
    same = [0.5] * 6
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(350)]
    rows += [(400 + i, same) for i in range(60)] + [(500, same), (500, same), (600, None), (601, []), (700, [1.0, None] * 3),
                                                    (701, [float("nan")] * 6), (702, [float("inf")] * 6), (None, same), (-100, same)]
    rows += [(800 + i, [float(i), 1.0]) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit("b"))
    got = sorted(map(tuple, C.top_k(frame, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows, 10)
    assert C.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_tree_covers_its_points_and_search_is_exact():
    rng = np.random.default_rng(0)
    x = np.rint(np.concatenate([rng.normal(c, 20, (150, 8)) for c in rng.normal(0, 300, (8, 8))]))
    tree = C.Tree(x)
    assert sorted(np.concatenate(tree.order).tolist()) == list(range(len(x)))

    def rows(a):
        return tree.order[tree.leaf[a]] if tree.leaf[a] >= 0 else np.concatenate([rows(c) for c in tree.children[a]])

    for a in range(len(tree.centre)):
        far = np.sqrt(((x[rows(a)] - tree.centre[a]) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[a] + 1e-9
    ids = [np.array([i]) for i in range(len(x))]
    queries = x[::7]
    best = C.dual_search(C.Tree(queries), np.arange(len(x))[::7], np.full(len(queries), -np.inf), tree, ids, 5)
    for q, (i, scores) in enumerate(zip(range(0, len(x), 7), best.scores)):
        want = np.sort(np.delete(x @ x[i], i))[::-1][:5]
        assert scores.tolist() == want.tolist(), q
