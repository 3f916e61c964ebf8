"""A hidden Markov language model, trained by Baum-Welch over all documents.

A text is its words (A-Z lower-cased) and one end. Hidden states emit a class of
words (a hash of the word modulo ``CLASSES``, so mostly single frequent words);
a class emits a word by its share of the class in the training tokens. The
parameters of the states are bounded whatever the vocabulary; the words' counts
are not, and stay a table.

1. ``encode`` turns every ``CHUNK_BYTES`` of texts into one row, a chunk: the
   words' places in the chunk's own dictionary, and the dictionary's hashes and
   training counts. Texts are read once.
2. ``shared_words`` brings equal words of all dictionaries together, one row for
   each chunk that has it, and keeps those whose count isn't the chunk's own. With
   the dictionaries they give the count of every distinct training word.
3. ``fit`` repeats Baum-Welch: each task adds the expected emissions,
   transitions and beginnings of its chunks, Spark adds them up across
   partitions by class, and the driver, which gets one row for each class and state,
   renormalises. All training tokens count in every round. Sums are of whole
   numbers, so that they don't depend on their order.
4. ``score`` brings each chunk the counts of its own shared words (a join by
   chunk) and runs the scaled forward recursion.

Long texts are cut into segments of ``SEGMENT`` tokens. What a segment does to the
state distribution is a matrix (the product of its steps); segments are chained by
their matrices, forward and backward, and then all treated side by side from
exact distributions at their borders. Likelihoods and expected counts are those
of the whole text, and a long text takes no more memory at a time than short ones.

Edge cases: null text is empty, and has one token, its end. Rows with a null
doc_id aren't held out and learn. Rows are independent: rows that repeat an id
are scored, and learned from, each for itself. Without training tokens all
classes are equally likely. An empty table gives no rows. Other columns are
ignored, whatever their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.common import map_batches, scratch
from farebox.llm.words import FOLDED, mix, text_buffer, words_of

# Fixed value: what is added to every count.
ADDED = 0.1
STATES = 6
#: Classes of words; the end has one of its own behind them.
CLASSES = 1 << 15
ROUNDS = 6
#: Bytes of text from which a task's rows make a chunk.
CHUNK_BYTES = 12 << 20
SEGMENT = 128
#: Segments treated at a time.
GROUP = 4096
#: Tokens' worth of the overall distribution that every state's emissions begin with.
PRIOR = 50.0
STAY = 0.9                             # chance of staying in a state, at first
#: Expected counts and log-likelihoods are summed as whole multiples of these.
COUNT_UNIT, LOG_UNIT = 2.0 ** -16, 2.0 ** -6

CHUNK = ("chunk long, doc_id array<long>, held array<boolean>, n_words array<long>, codes binary, words array<long>, train array<int>")
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


@dataclass
class Model:
    """Chances of the first state, of each next state, and of each class by state."""

    first: np.ndarray                  # (states,)
    move: np.ndarray                   # (states, states), rows sum to 1
    emit: np.ndarray                   # (classes + 1, states), columns sum to 1


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(classes)).astype(np.int64)


def _chunk(number: int, batches: list[pa.RecordBatch], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """The row of some batches (doc_id, held) and their words."""
    rows, n = pa.Table.from_batches(batches), np.concatenate(counts)
    held = rows["held"].combine_chunks().to_numpy(zero_copy_only=False)
    own, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    codes = codes.astype(np.int32)
    train = np.bincount(codes[np.repeat(~held, n)], minlength=len(own))
    one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(rows["doc_id"].combine_chunks(), pa.int64()), one(held, pa.bool_()), one(n, pa.int64()),
         pa.array([codes.tobytes()], pa.binary()), one(own.view(np.int64), pa.int64()), one(train.astype(np.int32), pa.int32())],
        names=["chunk", "doc_id", "held", "n_words", "codes", "words", "train"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) to chunks. Of a batch only the words' hashes wait for the rest of the chunk."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 33
    waiting, size = ([], [], []), 0
    for batch in batches:
        if batch.num_rows:
            buf, offsets = text_buffer(batch.column(1))
            words = words_of(buf, offsets, FOLDED)
            for part, value in zip(waiting, (batch.select(["doc_id", "held"]), words.hashes, words.counts())):
                part.append(value)
            size += len(buf)
            del buf, words, batch
        if size >= CHUNK_BYTES:
            yield _chunk(number, *waiting)
            number, waiting, size = number + 1, ([], [], []), 0
    if waiting[0]:
        yield _chunk(number, *waiting)


def encode(docs: DataFrame, held: Column) -> DataFrame:
    """``docs(doc_id, text)`` as a stored table of chunks; rows with ``held`` true don't learn."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch(map_batches(rows.withColumn("held", F.coalesce(held, F.lit(False))), _encode, CHUNK), "chunks")


def shared_words(chunks: DataFrame) -> DataFrame:
    """chunk, place, word, train, c, first: words whose count c in all training
    rows isn't that of the chunk; ``first`` marks a word's first chunk that learns it."""
    each = (chunks.select("chunk", F.posexplode(F.arrays_zip("words", "train")).alias("place", "w"))
            .select("chunk", "place", F.col("w.words").alias("word"), F.col("w.train").alias("train")))
    same = Window.partitionBy("word")
    counted = each.withColumn("c", F.sum("train").over(same)).withColumn("first", F.min(F.when(F.col("train") > 0, F.col("chunk"))).over(same) == F.col("chunk"))
    return scratch(counted.where("c != train"), "words")


@dataclass
class Corpus:
    """Training totals: tokens, distinct tokens, ends; tokens and distinct words of each class."""

    tokens: int
    distinct: int
    ends: int
    in_class: np.ndarray
    kinds: np.ndarray


def corpus(chunks: DataFrame, shared: DataFrame, classes: int = CLASSES) -> Corpus:
    """Totals; the driver gets one row for each class."""
    ends = chunks.select(F.size(F.filter("held", lambda h: ~h)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(classes), np.zeros(classes, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own = class_of(batch.column(0)[row].values.to_numpy(), classes)
                train = batch.column(1)[row].values.to_numpy()
                tokens += np.bincount(own, weights=train, minlength=classes)
                words += np.bincount(own[train > 0], minlength=classes)
        found = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(tokens[found].astype(np.int64)), pa.array(words[found])], names=["class", "tokens", "words"])

    # A word learned in several chunks counts once, with the first, not with each of them.
    # The class is of the unsigned hash: a negative one stands for 2**64 more.
    of = F.expr(f"pmod(pmod(word, {classes}) + if(word < 0, {(1 << 64) % classes}, 0), {classes})").alias("class")
    again = shared.groupBy(of).agg(F.lit(0).cast("long").alias("tokens"), F.sum(F.col("first").cast("long") - (F.col("train") > 0).cast("long")).alias("words"))
    each = map_batches(chunks.select("words", "train"), run, "class long, tokens long, words long")
    in_class, kinds = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64)
    for k, c, n in each.unionByName(again).groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect():
        in_class[k], kinds[k] = c, n
    return Corpus(int(in_class.sum()) + ends, int(kinds.sum()) + (ends > 0), ends, in_class, kinds)


class Segments:
    """Tokens of a chunk in segments: first token, length, first or last of its text, and its text's row."""

    def __init__(self, n_tokens: np.ndarray, size: int = SEGMENT):
        per = -(-n_tokens // size)
        self.row = np.repeat(np.arange(len(n_tokens)), per)
        self.heads = np.concatenate(([0], np.cumsum(per)))               # first segment of each text
        place = np.arange(len(self.row)) - self.heads[self.row]
        begin = np.concatenate(([0], np.cumsum(n_tokens)))[:-1]
        self.start = begin[self.row] + place * size
        self.length = np.minimum(size, n_tokens[self.row] - place * size)
        self.per = per
        self.last = place == per[self.row] - 1


class Passes:
    """Forward and backward recursion over the texts of a chunk.

    States come first in all arrays. Emissions are divided by their mean over the
    states, which changes no posterior and keeps numbers near 1; the logs of the
    means are added in the end.
    """

    def __init__(self, ids: np.ndarray, n_tokens: np.ndarray, model: Model, size: int = SEGMENT, kind: type = np.float64):
        mean = model.emit.mean(axis=1)
        self.ids, self.model, self.kind, self.seg = ids, model, kind, Segments(n_tokens, size)
        self.ratio = np.ascontiguousarray((model.emit / mean[:, None]).T.astype(kind))
        self.move, self.log_mean = model.move.astype(kind), np.log(mean)
        seg, k = self.seg, len(model.first)
        self.texts = np.concatenate(([0], np.cumsum(n_tokens)))[:-1]     # first token of each text
        self.inner = np.flatnonzero(~seg.last)
        self.matrix = np.empty((len(self.inner), k, k))
        logs = np.empty(len(self.inner))
        for i in range(0, len(self.inner), GROUP):
            self.matrix[i:i + GROUP], logs[i:i + GROUP] = self._products(self.inner[i:i + GROUP])
        self.at = np.cumsum(~seg.last) - 1                               # place of an inner segment's matrix
        # State distribution before each segment, chained through the texts.
        self.before = np.empty((len(seg.row), k))
        self.log_before = np.zeros(len(n_tokens))                        # of all but the last segment
        now = np.broadcast_to(model.first, (len(n_tokens), k)).copy()
        for j in range(int(seg.per.max(initial=0))):
            live = np.flatnonzero(seg.per > j)
            own = seg.heads[live] + j
            self.before[own] = now[live]
            live, own = live[~seg.last[own]], own[~seg.last[own]]
            if len(live):
                then = np.einsum("ni,nij->nj", now[live], self.matrix[self.at[own]])
                total = then.sum(axis=1)
                now[live] = then / total[:, None]
                self.log_before[live] += np.log(total) + logs[self.at[own]]

    def _grid(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Segments by falling length, their classes (step, segment), and how many reach each step."""
        chosen = chosen[np.argsort(-self.seg.length[chosen], kind="stable")]
        length = self.seg.length[chosen]
        steps = np.arange(int(length.max(initial=0)))
        places = np.minimum(self.seg.start[chosen][None, :] + steps[:, None], len(self.ids) - 1)
        reach = np.searchsorted(-length, -(steps + 1), side="right")
        return chosen, self.ids[places], reach.tolist()

    def _products(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of each inner segment (emit, then move, for each token), and the log of what it was scaled by."""
        k = len(self.model.first)
        order, ids, reach = self._grid(chosen)                           # all are equally long, so the order stays
        out = np.broadcast_to(np.eye(k, dtype=self.kind)[:, :, None], (k, k, len(order))).copy()
        spare, logs = np.empty_like(out), np.zeros(len(order))
        for t in range(len(reach)):
            out *= self.ratio[:, ids[t]][None]
            out, spare = np.matmul(self.move.T, out, out=spare), out
            if t % 8 == 7 or t == len(reach) - 1:
                total = out.sum(axis=(0, 1))
                out /= total
                logs += np.log(total)
        return out.transpose(2, 0, 1), logs

    def log_likelihood(self) -> np.ndarray:
        """Natural log-likelihood of each text."""
        total = self.log_before + np.add.reduceat(self.log_mean[self.ids], self.texts)
        lasts = np.flatnonzero(self.seg.last)
        for i in range(0, len(lasts), GROUP):
            chosen, ids, reach = self._grid(lasts[i:i + GROUP])
            now, rows = np.ascontiguousarray(self.before[chosen].T.astype(self.kind)), self.seg.row[chosen]
            for t, m in enumerate(reach):
                a = now[:, :m] * self.ratio[:, ids[t, :m]]
                c = a.sum(axis=0)
                total[rows[:m]] += np.log(c)
                a /= c
                now = self.move.T @ a
        return total

    def expected(self, sums: Sums) -> None:
        """Adds the expected counts of all texts to ``sums``."""
        seg, k = self.seg, len(self.model.first)
        behind = np.ones((len(seg.row), k))                              # chance of what follows, by state after the segment
        entry = np.empty((len(seg.row), k))                              # the same before it
        lasts = np.flatnonzero(seg.last)
        for i in range(0, len(lasts), GROUP):
            self._both(lasts[i:i + GROUP], None, entry, sums)
        for j in range(int(seg.per.max(initial=0)) - 2, -1, -1):
            own = seg.heads[:-1][seg.per > j + 1] + j
            behind[own] = entry[own + 1]
            back = np.einsum("nij,nj->ni", self.matrix[self.at[own]], behind[own])
            entry[own] = back / back.sum(axis=1)[:, None]
        for i in range(0, len(self.inner), GROUP):
            self._both(self.inner[i:i + GROUP], behind, None, sums)
        a = self.before[seg.heads[:-1]] * entry[seg.heads[:-1]]
        sums.first += (a / a.sum(axis=1)[:, None]).sum(axis=0)

    def _both(self, chosen: np.ndarray, behind: np.ndarray | None, entry: np.ndarray | None, sums: Sums) -> None:
        """Forward, then backward through some segments; ``behind`` is None for last ones."""
        chosen, ids, reach = self._grid(chosen)
        k = len(self.model.first)
        state = np.zeros((k, *ids.shape), dtype=self.kind)               # state chances after each token, then given all
        now = np.ascontiguousarray(self.before[chosen].T.astype(self.kind))
        for t, m in enumerate(reach):
            a = now[:, :m] * self.ratio[:, ids[t, :m]]
            a /= a.sum(axis=0)
            state[:, t, :m] = a
            now = self.move.T @ a
        after = np.ones((k, len(chosen)), dtype=self.kind) if behind is None else np.ascontiguousarray(behind[chosen].T.astype(self.kind))
        met = 0 if behind is None else len(chosen)                       # segments with a move behind this token
        for t in range(len(reach) - 1, -1, -1):
            m = reach[t]
            a, w = state[:, t, :m], np.ones((k, m), dtype=self.kind)
            np.matmul(self.move, after[:, :met], out=w[:, :met])
            g = a * w
            z = g.sum(axis=0)
            sums.pairs += (a[:, :met] / z[:met]) @ after[:, :met].T
            g /= z
            state[:, t, :m] = g
            w *= self.ratio[:, ids[t, :m]]
            w /= w.sum(axis=0)
            after[:, :m] = w
            met = m
        if entry is not None:
            entry[chosen] = after.T
        for s in range(k):
            sums.emit[:, s] += np.bincount(ids.ravel(), weights=state[s].ravel(), minlength=len(sums.emit))


class Sums:
    """Expected counts of a task."""

    def __init__(self, model: Model):
        self.first = np.zeros_like(model.first)
        self.pairs = np.zeros_like(model.move)                           # to be multiplied by the chances of moves
        self.emit = np.zeros_like(model.emit)
        self.log = 0.0


def chunk_ids(batch: pa.RecordBatch, row: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per text, classes of all tokens with each text's end, codes of the words, and texts' first words."""
    words = batch.column("words")[row].values.to_numpy()
    n = batch.column("n_words")[row].values.to_numpy()
    codes = np.frombuffer(batch.column("codes")[row].as_buffer(), dtype=np.int32)
    ids, is_word = np.empty(len(codes) + len(n), dtype=np.int32), np.ones(len(codes) + len(n), dtype=bool)
    is_word[np.cumsum(n + 1) - 1] = False
    ids[is_word] = class_of(words, classes).astype(np.int32)[codes] if len(codes) else 0
    ids[~is_word] = classes
    return n + 1, ids, codes, np.concatenate(([0], np.cumsum(n)))


def _learned(batch: pa.RecordBatch, row: int, n_tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text and classes of the texts that learn."""
    learns = ~batch.column("held")[row].values.to_numpy(zero_copy_only=False)
    return n_tokens[learns], ids[np.repeat(learns, n_tokens)]


def expectations(chunks: DataFrame, model: Model) -> tuple[Sums, float]:
    """Expected counts of all training texts and their log-likelihood, one Baum-Welch pass."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(model)                         # (classes + 1) x states numbers
    states, classes = len(model.first), len(model.emit) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = Sums(own)
        for batch in batches:
            for row in range(batch.num_rows):
                n, ids, _, _ = chunk_ids(batch, row, classes)
                n, ids = _learned(batch, row, n, ids)
                if len(n):
                    passes = Passes(ids, n, own, kind=np.float32)
                    passes.expected(sums)
                    sums.log += passes.log_likelihood().sum()
        whole = np.vstack([sums.emit, sums.pairs * own.move, sums.first[None, :]]) / COUNT_UNIT
        table = np.vstack([np.rint(whole), np.full((1, states), np.rint(sums.log / LOG_UNIT))]).astype(np.int64)
        keys = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32))] + [pa.array(table[keys, s]) for s in range(states)],
                                         names=["key"] + [f"s{s}" for s in range(states)])

    columns = [f"s{s}" for s in range(states)]
    partial = map_batches(chunks.select("held", "n_words", "codes", "words"), run, "key int, " + ", ".join(f"{c} long" for c in columns))
    table = np.zeros((classes + 1 + states + 2, states))
    for key, *values in partial.groupBy("key").agg(*[F.sum(c) for c in columns]).collect():
        table[key] = values
    shared.unpersist()
    sums = Sums(model)
    table[:-1] *= COUNT_UNIT
    sums.emit, sums.pairs, sums.first = table[:classes + 1], table[classes + 1:-2], table[-2]
    return sums, float(table[-1, 0] * LOG_UNIT)


def overall(totals: Corpus) -> np.ndarray:
    """Chance of each class, the end behind them, in the training tokens."""
    own = np.append(totals.in_class, totals.ends) + ADDED
    return own / own.sum()


def begin(totals: Corpus, states: int = STATES) -> Model:
    """States that prefer different classes slightly, by a fixed hash."""
    base = overall(totals)
    noise = mix(np.arange(1, len(base) * states + 1, dtype=np.uint64)).reshape(len(base), states) / 2.0 ** 64
    emit = base[:, None] * (0.5 + noise)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def renormalised(sums: Sums, totals: Corpus) -> Model:
    """The model that the expected counts give; each state's emissions lean on the overall ones."""
    emit = sums.emit + PRIOR * overall(totals)[:, None]
    return Model((sums.first + ADDED) / (sums.first + ADDED).sum(), (sums.pairs + ADDED) / (sums.pairs + ADDED).sum(axis=1)[:, None],
                 emit / emit.sum(axis=0))


def fit(chunks: DataFrame, totals: Corpus, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The trained model, and the training log-likelihood before each round."""
    model, logs = begin(totals, states), []
    for _ in range(rounds if totals.tokens else 0):
        sums, log = expectations(chunks, model)
        logs.append(log)
        model = renormalised(sums, totals)
    return model, logs


def score(chunks: DataFrame, shared: DataFrame, totals: Corpus, model: Model) -> DataFrame:
    """``SCORED``, one row for each text of ``chunks``; scores are log10 probabilities."""
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((model, totals))
    classes = len(model.emit) - 1
    known = (shared.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("place", "c")).alias("known"))
             .select("of", F.col("known.place").alias("places"), F.col("known.c").alias("c")))
    whole = chunks.join(known, F.col("chunk") == F.col("of"), "left").select("doc_id", "held", "n_words", "codes", "words", "train", "places", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = sent.value
        tail = np.log10(sizes.tokens + ADDED * (sizes.distinct + 1))
        share = np.log10(sizes.in_class + ADDED * (sizes.kinds + 1))
        end = float(np.log10(sizes.ends + ADDED) - tail)
        for batch in batches:
            for row in range(batch.num_rows):
                n, ids, codes, firsts = chunk_ids(batch, row, classes)
                hashes = batch.column("words")[row].values.to_numpy()
                c = batch.column("train")[row].values.to_numpy().astype(np.int64)
                if batch.column("places")[row].is_valid:
                    c[batch.column("places")[row].values.to_numpy()] = batch.column("c")[row].values.to_numpy()
                logs = np.log10(c + ADDED)
                per = lambda values: np.add.reduceat(np.append(values, 0), firsts[:-1]) * (n > 1)
                base = per((logs - tail)[codes]) + end
                within = per((logs - share[class_of(hashes, classes)])[codes]) if len(codes) else np.zeros(len(n))
                whole_log = Passes(ids, n, own).log_likelihood() / np.log(10) + within
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[row].values, batch.column("held")[row].values, pa.array(n),
                     pa.array(per((c > 0)[codes].astype(np.int64)) + (sizes.ends > 0)), pa.array(base), pa.array(whole_log)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return map_batches(whole, run, SCORED)


def language_model_scores(docs: DataFrame, held: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``SCORED`` and train_tokens of each row of ``docs(doc_id, text)``, learning from rows where ``held`` isn't true."""
    chunks = encode(docs, held)
    shared = shared_words(chunks)
    totals = corpus(chunks, shared)
    model, _ = fit(chunks, totals, states, rounds)
    return score(chunks, shared, totals, model).withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
