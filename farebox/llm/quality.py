"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its hashed features
(words, word pairs, where a word that repeats at once gives one common
feature, and byte 3- to 5-grams), followed by a softmax over bad
and good. It is trained by stochastic gradient descent in numpy, with Adagrad
steps, on a bounded sample: up to ``PER_CLASS`` labelled documents of each
class, the first by a hash of their id. Features of the sample are gathered in
the tasks; the driver gets a sparse row for each sampled document.

Only the text enters a score. The output is linear in the average, so scoring
uses one number for each bucket (its vector's part in the softmax's log-odds)
and needs no vectors. All rows are scored, whole texts, batch by batch.

Null and empty texts have no features: their log-odds are the bias alone. If
one class has no labelled documents, every score is that of the other class
(0.5 without any labels). Labels with a null id or quality are ignored; if a
document has several labels, the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from farebox.llm.common import bounded_sample_ids, map_batches, release_memory
from farebox.llm.words import PLAIN, mix, text_buffer, words_of

PER_CLASS = 900
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
#: Parts in which the sample's rows reach the driver.
PIECES = 16
RATE = 0.25
GRAMS = (3, 4, 5)
KINDS = 2 + len(GRAMS)                 # each kind of feature has an equal part in the average
_MULT = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint32(0x9E3779B1)
_SHORT = (PLAIN >> np.uint64(32)).astype(np.uint32)
_BYTES = 1 << 20


def parts(batch_offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``_BYTES`` of text (one row at least)."""
    i, n = 0, len(batch_offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(batch_offsets, batch_offsets[i] + _BYTES, side="right")) - 1)
        yield i, j
        i = j


def features(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets into them by document), one pair for each kind of feature."""
    shift = np.uint64(64 - BUCKET_BITS)
    words = words_of(buf, offsets)
    yield (words.hashes >> shift).astype(np.int32), words.firsts
    with np.errstate(over="ignore"):
        pairs = mix(words.hashes[:-1] * _MULT + words.hashes[1:]) if len(words.hashes) else words.hashes.copy()
        pairs[words.hashes[:-1] == words.hashes[1:]] = _MULT     # any word and itself: one feature
    within = np.ones(len(pairs), dtype=bool)
    inner = words.firsts[(words.firsts > 0) & (words.firsts < len(words.hashes))]
    within[inner - 1] = False
    yield ((pairs >> shift).astype(np.int32)[within],
           np.concatenate(([0], np.cumsum(np.maximum(words.counts() - 1, 0)))))
    lengths = np.diff(offsets)
    gram = _SHORT[buf]
    for n in range(2, max(GRAMS) + 1):
        with np.errstate(over="ignore"):
            gram = gram[:-1] * _GRAM + _SHORT[buf[n - 1:]] if len(gram) > 1 else gram[:0]
            if n in GRAMS:
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                inside = np.ones(len(buf), dtype=bool)   # a gram doesn't run into the next document
                for k in range(1, n):
                    inside[(offsets[1:][lengths >= k]) - k] = False
                inside = inside[:len(mixed)]
                yield ((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)[inside],
                       np.concatenate(([0], np.cumsum(np.maximum(lengths - n + 1, 0)))))


def segment_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of each run of values; an empty run is 0."""
    out = np.zeros(len(cuts) - 1)
    full = np.flatnonzero(np.diff(cuts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, cuts[full], dtype=np.float64)
    return out


@dataclass
class Model:
    weights: np.ndarray                # log-odds of each bucket
    bias: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        for buckets, cuts in features(buf, offsets):
            total += segment_sums(self.weights[buckets], cuts) / np.maximum(np.diff(cuts), 1)
        return 1 / (1 + np.exp(-np.clip(total / KINDS + self.bias, -500, 500)))


def train(rows: list[tuple[int, bytes, bytes]], seed: int = 11) -> Model:
    """Fits the model to (label, bucket numbers, shares) rows by gradient descent."""
    labels = np.array([r[0] for r in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0 if not len(rows) else (4.0 if labels[0] else -4.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    seen_v = np.full(1 << BUCKET_BITS, 1e-8, dtype=np.float32)
    seen_o = np.full_like(output, 1e-4)
    data = []
    for _, buckets, shares in rows:
        data.append((np.frombuffer(buckets, dtype=np.int32), np.frombuffer(shares, dtype=np.float32)))
    share_of = np.bincount(labels, minlength=2) / len(labels)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(data)):
            ids, share = data[i]
            hidden = share @ vectors[ids]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= 0.5 / share_of[labels[i]]            # classes weigh alike
            back = output @ p
            step = np.outer(hidden, p)
            seen_o += step * step
            output -= rate * 0.2 * step / np.sqrt(seen_o)
            bias -= rate * 0.02 * p
            if len(ids):
                size = share * float(np.sqrt(back @ back / DIMENSIONS))
                seen_v[ids] += size * size
                vectors[ids] -= (rate * 0.2 * share / np.sqrt(seen_v[ids]))[:, None] * back
    toward = output[:, 1] - output[:, 0]
    return Model((vectors @ toward).astype(np.float32), float(bias[1] - bias[0]))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to bucket numbers and their shares of the average."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        buckets, shares = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = [f for f, _ in features(buf[a:b], np.array([0, b - a]))]
            ids, at = np.unique(np.concatenate(own), return_inverse=True)
            parts_of = np.concatenate([np.full(len(f), 1 / (KINDS * max(len(f), 1))) for f in own])
            buckets.append(ids.astype(np.int32).tobytes())
            shares.append(np.bincount(at, parts_of, len(ids)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                                         names=["doc_id", "buckets", "shares"])


def fit(docs: DataFrame, labels: DataFrame, held: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """A model from ``labels(doc_id, quality)`` of ``docs(doc_id, text)``.

    ``held`` is a condition on doc_id; rows where it is true are not learned from.
    """
    known = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
             .where("doc_id is not null and quality in (0, 1)"))
    if held is not None:
        known = known.where(~held)
    known = (known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi"))
    classes = {i: c for c in (0, 1) for i in bounded_sample_ids(known.where(F.col("quality") == c), per_class)}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in classes], "doc_id long")   # 2 * per_class rows at most
    sample = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
              .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))   # of rows that repeat an id one, always the same
    # The driver takes the rows over piece by piece: all at once they would lie there twice.
    rows = map_batches(sample.repartition(PIECES, "doc_id"), _sparse, "doc_id long, buckets binary, shares binary").toLocalIterator()
    try:
        return train([row[1:] for row in sorted((r[0], classes[r[0]], bytes(r[1]), bytes(r[2])) for r in rows)])
    finally:
        release_memory()               # the driver goes on without the sample


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name`` (0 to 1, higher: better); a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))    # one number a bucket
    others = [c for c in docs.columns if c != name]
    at = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(at))
            scores = [own.scores(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in parts(offsets)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*others, name])

    rows = docs.select(*[F.col(f"`{c}`") for c in others])
    return map_batches(rows, run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))
