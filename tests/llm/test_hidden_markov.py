import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farebox.llm import hidden_markov as H
from farebox.llm.common import held_out
from farebox.llm.words import FOLDED, text_buffer, words_of

SCHEMA = "doc_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in re.split("[ \t-\r]+", lower) if w]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    end = ("end",)
    c = Counter(t for i, text in rows if not is_held(i) for t in [*words(text), end])
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        tokens = [*words(text), end]
        out.append((i, is_held(i), len(tokens), sum(c[t] > 0 for t in tokens), n,
                    sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


def brute_forward(ids, model):
    now, log = list(model.first), 0.0
    for t in ids:
        a = [now[i] * model.emit[t][i] for i in range(len(now))]
        log += math.log(sum(a))
        a = [x / sum(a) for x in a]
        now = [sum(a[i] * model.move[i][j] for i in range(len(a))) for j in range(len(a))]
    return log


def brute_counts(texts, model):
    """Expected counts by the plain forward and backward recursions."""
    k = len(model.first)
    first, pairs, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for ids in texts:
        n = len(ids)
        f, b = np.zeros((n, k)), np.ones((n, k))
        f[0] = model.first * model.emit[ids[0]]
        for t in range(1, n):
            f[t] = f[t - 1] @ model.move * model.emit[ids[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[ids[t + 1]] * b[t + 1])
        z = f[-1].sum()
        gamma = f * b / z
        first += gamma[0]
        np.add.at(emit, ids, gamma)
        for t in range(n - 1):
            pairs += f[t][:, None] * model.move * (model.emit[ids[t + 1]] * b[t + 1])[None, :] / z
    return first, pairs, emit


def some_model(classes, k, seed):
    rng = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.05)
    return H.Model(part(k), part(k, k), part(k, classes + 1).T.copy())


@pytest.mark.parametrize("size", [1, 3, 8, 128])
def test_recursions_against_plain_ones(size):
    rng = np.random.default_rng(size)
    model = some_model(7, 3, 1)
    texts = [rng.integers(0, 7, n).tolist() + [7] for n in [0, 1, 2, 3, 7, 8, 9, 30, 31, 0, 16]]
    ids, n = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    passes = H.Passes(ids, n, model, size)
    assert np.allclose(passes.log_likelihood(), [brute_forward(t, model) for t in texts], rtol=1e-12)
    sums = H.Sums(model)
    passes.expected(sums)
    first, pairs, emit = brute_counts(texts, model)
    assert np.allclose(sums.first, first) and np.allclose(sums.pairs * model.move, pairs) and np.allclose(sums.emit, emit)


def test_long_text_against_plain_recursion():
    rng = np.random.default_rng(2)
    model = some_model(50, 4, 2)
    ids = np.append(rng.integers(0, 50, 20000), 50)
    assert math.isclose(H.Passes(ids, np.array([len(ids)]), model).log_likelihood()[0], brute_forward(ids.tolist(), model), rel_tol=1e-11)


def test_scores(spark, docs, no_docs, rows):
    held = held_out(F.col("doc_id"), 10, 0)
    got = H.language_model_scores(docs, held)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got.collect()), key=key)
    brute = sorted(brute_base(rows), key=key)
    assert [m[:5] for m in mine] == [b[:5] for b in brute]
    assert np.allclose([m[5] for m in mine], [b[5] for b in brute], rtol=1e-9)
    assert H.language_model_scores(no_docs, held).count() == 0


def test_scores_are_those_of_the_model(spark, docs, rows):
    """The score is the plain forward recursion's, times each word's share of its class."""
    held = held_out(F.col("doc_id"), 10, 0)
    chunks = H.encode(docs, held)
    shared = H.shared_words(chunks)
    totals = H.corpus(chunks, shared)
    model, logs = H.fit(chunks, totals, rounds=3)
    assert all(b >= a for a, b in zip(logs, logs[1:]))                   # Baum-Welch never gets worse
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.first.sum(), 1)
    c = Counter(w for i, t in rows if not is_held(i) for w in words(t))

    def class_of(word):
        import pyarrow as pa
        return int(H.class_of(words_of(*text_buffer(pa.array([word])), FOLDED).hashes, H.CLASSES)[0])

    place = {w: class_of(w) for _, t in rows for w in words(t)}
    assert totals.tokens == sum(c.values()) + sum(not is_held(i) for i, _ in rows) and totals.distinct == len(c) + 1
    want = []
    for i, t in rows:
        own = words(t)
        log = brute_forward([place[w] for w in own] + [H.CLASSES], model) / math.log(10)
        log += sum(math.log10((c[w] + 0.1) / (totals.in_class[place[w]] + 0.1 * (totals.kinds[place[w]] + 1))) for w in own)
        want.append((str(i), len(own) + 1, log))
    got = [(str(r["doc_id"]), r["n_tokens"], r["score"]) for r in H.score(chunks, shared, totals, model).collect()]
    assert np.allclose([x[2] for x in sorted(got)], [x[2] for x in sorted(want)], rtol=1e-9)


def test_same_counts_for_any_layout(spark, docs):
    held = held_out(F.col("doc_id"), 10, 0)
    found = []
    for parts in (1, 7):
        chunks = H.encode(docs.repartition(parts), held)
        assert chunks.count() == parts
        totals = H.corpus(chunks, H.shared_words(chunks))
        sums, log = H.expectations(chunks, H.begin(totals))
        found.append((totals.tokens, totals.distinct, sums.first, sums.pairs, log))
    assert found[0][:2] == found[1][:2]
    assert all(np.allclose(a, b, atol=0.5) for a, b in zip(found[0][2:], found[1][2:]))


def test_states_tell_kinds_of_text_apart(spark):
    """Held-out texts of two vocabularies are likelier under the model than by single words."""
    rng = random.Random(3)
    kinds = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]]
    rows = [(i, " ".join(rng.choices(kinds[i % 2], k=80))) for i in range(400)]
    out = H.language_model_scores(spark.createDataFrame(rows, SCHEMA), held_out(F.col("doc_id"), 10, 0), states=2, rounds=10)
    gain = [r["score"] - r["base_score"] for r in out.where("held_out").collect()]
    assert len(gain) > 20 and min(gain) > 10


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    out = H.language_model_scores(docs, F.lit(True)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in out)
