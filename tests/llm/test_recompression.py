import random
from collections import defaultdict

import numpy as np

from farebox.llm import recompression as R
from farebox.llm.words import words_of


def brute(rows, window=R.WINDOW):
    """(n_words, n_removed, kept) per row, judging every window by its words."""
    first = {}
    order = sorted(((2 ** 63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows), key=lambda x: x[0])
    for i, words in order:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = defaultdict(list)
    for i, words in order:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < (i, k):
                gone[k:k + window] = [True] * window
        out[i].append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return {i: sorted(v) for i, v in out.items()}


def found(frame):
    out = defaultdict(list)
    for r in R.substring_dedup(frame).collect():
        out[2 ** 63 - 1 if r["doc_id"] is None else r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept"]))
    return {i: sorted(v) for i, v in out.items()}


def test_edges(docs, no_docs, rows):
    assert found(docs) == brute(rows)
    assert R.substring_dedup(no_docs).count() == 0


def test_runs_periods_and_edited_copies(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary[:rng.choice([1, 2, 3, 400])], k=rng.randint(0, 150))
        if rows and i % 3:
            other = rows[rng.randrange(len(rows))][1].split()
            a = rng.randint(0, len(other))
            words = words[:20] + other[a:a + rng.randint(0, 90)] + words[20:]
        rows.append((rng.randint(0, 10 ** 6), "  \n".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame) == brute(rows)


def test_long_documents_are_cut_without_loss(rows):
    hashes = words_of(np.frombuffer(rows[13][1].encode(), dtype=np.uint8), np.array([0, len(rows[13][1].encode())])).hashes
    whole = list(zip(*R.anchors(hashes, np.array([0, len(hashes)]))))
    pieces = []
    for group in R._pieces(np.array([0, len(hashes)]), 700):
        for _, a, b in group:
            pieces += [(s + a, n, p + a) for s, n, p in zip(*R.anchors(hashes[a:b], np.array([0, b - a])))]
    assert sorted(pieces) == sorted(whole) and len(whole) == len(hashes) - R.WINDOW + 1
