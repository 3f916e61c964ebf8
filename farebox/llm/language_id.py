"""Language identification with a byte convolutional network.

Texts are cut into windows of ``LENGTH`` bytes (the last one is filled with
zeros). Each byte has a learned vector; filters of several widths run over the
window, the maximum of each over all positions goes through a softmax. The
network is trained in numpy (Adam) on windows of a bounded sample: up to
``PER_LANGUAGE`` documents of each language, the first by a hash of their id,
and at most ``PER_DOCUMENT`` windows of each. All windows of every text are
classified, in batches; a document's probabilities are the mean of its windows',
weighted by their bytes.

Only the text enters a prediction. Null text, or text without a letter, is
``und`` with score 0; so is every text if there is nothing to learn from (then
with any letters too). Rows without lang or with a null id are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.common import map_batches
from farebox.llm.words import text_buffer

LENGTH = 256
PER_LANGUAGE, PER_DOCUMENT = 250, 6
VECTOR = 8
WIDTHS = (2, 3, 4)
FILTERS = 12                           # of each width
STEPS, BATCH, RATE = 260, 64, 0.01
_WINDOWS = 64                          # windows classified at a time
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray                # 256 x VECTOR
    filters: np.ndarray                # max(WIDTHS) * VECTOR x filters; narrow ones are 0 below
    offset: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unfolded input, maxima after the rectifier, and where each maximum is."""
        wide = max(WIDTHS)
        values = self.vectors[windows]                                     # n x LENGTH x VECTOR
        n, size = windows.shape
        unfolded = np.lib.stride_tricks.sliding_window_view(
            values.reshape(n, size * VECTOR), wide * VECTOR, axis=1)[:, ::VECTOR]
        unfolded = np.ascontiguousarray(unfolded)                          # n x positions x wide * VECTOR
        out = (unfolded.reshape(-1, wide * VECTOR) @ self.filters).reshape(n, -1, self.filters.shape[1])
        return unfolded, out.max(axis=1) + self.offset, out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        best = np.maximum(self.pooled(windows)[1], 0)
        logits = best @ self.output + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Fits the network by Adam on mini-batches drawn evenly over the languages."""
    rng = np.random.default_rng(seed)
    wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * VECTOR, total), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * VECTOR, k * FILTERS:(k + 1) * FILTERS] = 1
    p = {"vectors": rng.normal(0, 0.5, (256, VECTOR)), "filters": rng.normal(0, 0.25, mask.shape) * mask,
         "offset": np.zeros(total), "output": rng.normal(0, 0.2, (total, len(languages))), "bias": np.zeros(len(languages))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    by_label = [np.flatnonzero(labels == c) for c in range(len(languages))]
    for step in range(1, STEPS + 1):
        rows = np.array([rng.choice(by_label[c]) for c in rng.integers(0, len(languages), BATCH)])
        x, y = windows[rows], labels[rows]
        net = Network(languages, **p)
        unfolded, pooled, out = net.pooled(x)
        at = out.argmax(axis=1)                                            # n x filters
        best = np.maximum(pooled, 0)
        logits = best @ p["output"] + p["bias"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(BATCH), y] -= 1
        prob /= BATCH
        back = (prob @ p["output"].T) * (pooled > 0)
        picked = unfolded[np.arange(BATCH)[:, None], at]                   # n x filters x wide * VECTOR
        to_input = back[:, :, None] * p["filters"].T[None]
        bytes_at = x[np.arange(BATCH)[:, None, None], at[:, :, None] + np.arange(wide)]
        vectors = np.zeros_like(p["vectors"])
        np.add.at(vectors, bytes_at.reshape(-1), to_input.reshape(-1, VECTOR))
        grad = {"vectors": vectors, "filters": np.einsum("nfk,nf->kf", picked, back) * mask,
                "offset": back.sum(axis=0), "output": best.T @ prob, "bias": prob.sum(axis=0)}
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - (RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return Network(languages, **p)


def windows_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a batch of texts, their document and their bytes."""
    lengths = np.diff(offsets)
    each = -(-lengths // LENGTH)
    doc = np.repeat(np.arange(len(lengths)), each)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    size = np.minimum(lengths[doc] - within * LENGTH, LENGTH)
    out = np.zeros((len(doc), LENGTH), dtype=np.uint8)
    start = offsets[doc] + within * LENGTH
    inside = np.arange(LENGTH) < size[:, None]
    out[inside] = buf[(start[:, None] + np.arange(LENGTH))[inside]]
    return out, doc, size


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to at most PER_DOCUMENT windows, evenly spread."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(2))
        lang, rows = [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            starts = np.unique(np.linspace(0, max(0, b - a - LENGTH), PER_DOCUMENT).astype(int)) if b > a else []
            for s in starts:
                rows.append(buf[a + s:min(b, a + s + LENGTH)].tobytes().ljust(LENGTH, b"\0"))
                lang.append(batch.column(1)[i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], names=["lang", "bytes"])


def fit(docs: DataFrame, held: Column | None = None, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network from ``docs(doc_id, text, lang)``; rows where ``held`` is true are not learned from."""
    known = docs.select(F.col("doc_id").cast("long"), "lang", F.col("text").cast("string")).where(
        "doc_id is not null and lang is not null and text is not null")
    if held is not None:
        known = known.where(~held)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (known.select("doc_id", "lang").withColumn("place", F.row_number().over(order))
              .where(F.col("place") <= per_language).select("doc_id", "lang"))
    ids = chosen.collect()                             # languages * per_language rows at most
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, lang string").distinct()
    # Of rows that repeat an id and a language one is learned from, always the same.
    sample = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(map_batches(sample, _sampled, "lang string, bytes binary").collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    x = np.frombuffer(b"".join(bytes(r[1]) for r in rows), dtype=np.uint8).reshape(-1, LENGTH)
    return train(x, np.array([languages.index(r[0]) for r in rows]), languages)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(network and vars(network))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**held.value) if held.value else None
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            n = batch.num_rows
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            names = np.full(n, UNKNOWN, dtype=object)
            scores = np.zeros(n)
            if net and n:
                total = np.zeros((n, len(net.languages)))
                i = 0
                while i < n:                           # documents in groups of about a megabyte
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1)
                    cut = [(a, a + max(1, (1 << 20) // LENGTH) * LENGTH) for a in
                           range(int(offsets[i]), int(offsets[j]), max(1, (1 << 20) // LENGTH) * LENGTH)] if j == i + 1 else None
                    for a, b in cut or [(int(offsets[i]), int(offsets[j]))]:
                        own = np.array([a, min(b, int(offsets[j]))]) if cut else offsets[i:j + 1]
                        x, doc, size = windows_of(buf, own)
                        for k in range(0, len(x), _WINDOWS):
                            np.add.at(total, doc[k:k + _WINDOWS] + i,
                                      net.probabilities(x[k:k + _WINDOWS]) * size[k:k + _WINDOWS, None])
                    i = j
                mean = total / np.maximum(np.diff(offsets), 1)[:, None]
                best = mean.argmax(axis=1)
                names[lettered] = np.array(net.languages, dtype=object)[best[lettered]]
                scores[lettered] = np.clip(mean[np.arange(n), best][lettered], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return map_batches(rows, run, "doc_id long, lang_pred string, score double")
