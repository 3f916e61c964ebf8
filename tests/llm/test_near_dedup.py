import random

import numpy as np
import pytest

from farebox.llm import near_dedup as N
from farebox.llm.components import connected_components


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(folded[k:k + 5]) for k in range(len(folded) - 4)} if len(folded) >= 5 else {tuple(folded)} if folded else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept), comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((str(i), len(x), None if i is None else root(i), i is None or root(i) == i) for i, x in sets)


def found(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(frame).collect())


def test_edges(docs, no_docs, rows):
    want = {(a, b): (c, d) for a, b, c, d in brute(rows) if a != "None"}
    got = {(a, b): (c, d) for a, b, c, d in found(docs) if a != "None"}
    assert got == want
    assert [r[2:] for r in found(docs) if r[0] == "None"] == [(None, True)] * 2
    assert N.near_duplicates(no_docs).count() == 0


def test_chains_and_open_buckets(spark):
    """Each copy differs more and more from the first: links only between neighbours."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i * 7 % 61, " ".join(words)))
        for _ in range(rng.choice([1, 2, 5])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10 ** 6)}"
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randint(3, 9)))) for i in range(60)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        a = rng.integers(0, 2 ** 63, 2000).astype(np.uint64)
        keep = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:keep], rng.integers(0, 2 ** 63, 2000 - keep).astype(np.uint64)])
        x, y = N.fine_registers([np.unique(a), np.unique(b)])
        got = N.estimate(np.array([(x == y).sum()]), np.array([2000]), np.array([2000]))[0]
        assert abs(got - share) < 0.07
    assert N.chance_equal(10, 10) > 0
    assert N.compress(np.array([0, 1, 2 ** 31, 2 ** 32 - 1], dtype=np.uint32), 10).tolist() == [31 << 10, 31 << 10, 0, 1023]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (60, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40}
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("links, rounds", [([(5, 1), (3, 1), (9, 7)], 1), ([(2, 1), (3, 2), (4, 3), (5, 4)], None), ([(1, 1)], 1)])
def test_components_stop_where_a_round_changes_nothing(spark, monkeypatch, links, rounds):
    from farebox.llm import components
    stored, whole = [], components.scratch

    def watched(df, name, **more):
        stored.append(name)
        return whole(df, name, **more)

    monkeypatch.setattr(components, "scratch", watched)
    found = {tuple(r) for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert found == set(low.items())
    assert rounds is None or stored.count("edges") == rounds + 1
