"""Benchmark decontamination by SimHash windows.

Items and documents are words (A-Z lower-cased) and 5-shingles. A document is
contaminated by an item if some window of the item's length in words has a
weighted-shingle similarity of ``THRESHOLD`` or more with it: the sum over
shingles of the smaller count, by that of the larger. A document with fewer
words than an item that it shares a shingle with has no such window: the whole
document is its one window for that item.

1. Document shingles are looked up among the items'. A window that shares no
   shingle with an item has similarity 0, so only windows around a hit, of the
   lengths of the items hit, are fingerprinted.
2. A window's fingerprint is the 64-bit SimHash of its shingles, each weighted
   by its count; all windows of a stretch come from running sums.
3. The items' fingerprints are indexed by ``BLOCKS`` blocks of 8 bits. Two
   fingerprints within ``RADIUS`` differ in at most RADIUS // BLOCKS bits in
   some block, so reading each block's table of near values finds every item
   within the radius. (At the threshold two fingerprints differ in 11 bits on
   average, with a deviation of 3; RADIUS is 4 deviations above that.)
4. Candidates within the radius are compared exactly, shingle by shingle.

An item of fewer than 5 words is a single shingle, its whole word sequence.
Items with null or wordless text, or a null id, match nothing; items with
equal id are one set of alternatives. Null, empty or wordless documents have
no matches. Rows pass one by one: repeated rows and empty tables need no case
of their own. Extra columns are ignored.

The items' index is broadcast if their texts are within ``ITEM_BYTES``; a
larger benchmark is cut into parts of that size by a hash, and the documents
are read once for each part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import map_batches
from farebox.llm.words import FOLDED, mix, text_buffer, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.75
RADIUS, BLOCKS = 23, 8
ITEM_BYTES = 8 << 20
_BYTES = 4 << 20
_TABLE_BITS = 22
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS

MATCH = "array<struct<item_id:bigint,start:bigint,end:bigint,similarity:double>>"


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bits = np.unpackbits(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash bytes from summed signs; a sum of 0 counts as 1."""
    return np.packbits(sums >= 0, axis=1)


class Index:
    """Shingles and fingerprints of a set of items, by length in words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_length: dict[int, list[tuple[int, Counter]]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        owners: dict[int, set[int]] = {}                 # shingle: lengths of the items that hold it
        for item, text in sorted(items):
            buf = np.frombuffer(text.encode(), dtype=np.uint8)
            hashes = words_of(buf, np.array([0, len(buf)]), FOLDED).hashes
            n = len(hashes)
            if not n:
                continue
            shingles = window_hashes(hashes, min(SHINGLE, n))
            self.by_length.setdefault(n, []).append((item, Counter(shingles.tolist())))
            prints.setdefault(n, []).append(fingerprints(signs(shingles).sum(axis=0, keepdims=True))[0])
            for s in shingles.tolist():
                owners.setdefault(s, set()).add(n)
        self.prints = {n: np.stack(p) for n, p in prints.items()}
        # Block k of length n: for each byte value the items whose byte is near it.
        self.near = {n: [_NEAR[:, p[:, k]] for k in range(BLOCKS)] for n, p in self.prints.items()}
        self.sizes = sorted({min(SHINGLE, n) for n in self.by_length})
        self.known = {size: np.array(sorted(s for s, ns in owners.items() if any(min(SHINGLE, n) == size for n in ns)),
                                     dtype=np.uint64) for size in self.sizes}
        self.lengths = {size: [sorted(n for n in owners[s] if min(SHINGLE, n) == size) for s in known.tolist()]
                        for size, known in self.known.items()}
        self.table = {}
        for size, known in self.known.items():
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[(known >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.table[size] = table

    def matches(self, hashes: np.ndarray, firsts: np.ndarray) -> list[dict[int, tuple[float, int, int]]]:
        """Per document of a batch: item to (similarity, first word, end) of its best window."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(firsts) - 1)]
        for size in self.sizes:
            shingles = window_hashes(hashes, size)
            at = np.flatnonzero(self.table[size][(shingles >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            if not len(at):
                continue
            known = self.known[size]
            which = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
            doc = np.searchsorted(firsts, at, side="right") - 1
            hit = (known[which] == shingles[at]) & (at + size <= firsts[doc + 1])
            at, which, doc = at[hit], which[hit], doc[hit]
            if not len(at):
                continue
            reach = max(n for n in self.by_length if min(SHINGLE, n) == size)
            cut = np.flatnonzero((np.diff(at) > reach) | (np.diff(doc) > 0)) + 1
            for hits, kinds in zip(np.split(at, cut), np.split(which, cut)):
                d = int(np.searchsorted(firsts, hits[0], side="right")) - 1
                self._stretch(shingles, size, hits, kinds, int(firsts[d]), int(firsts[d + 1]), out[d])
        return out

    def _stretch(self, shingles, size, hits, kinds, begin, end, found) -> None:
        """Windows around the hits of one stretch of a document."""
        lengths: dict[int, list[int]] = {}
        for p, k in zip(hits.tolist(), kinds.tolist()):
            for n in self.lengths[size][k]:
                lengths.setdefault(n, []).append(p)
        longest = max(lengths)
        low, high = max(begin, int(hits[0]) - longest), min(end - size, int(hits[-1]) + longest)
        part = shingles[low:high + 1]
        sums = np.zeros((len(part) + 1, 64), dtype=np.int32)
        np.cumsum(signs(part), axis=0, out=sums[1:])
        for n, places in lengths.items():
            whole = n - size + 1                         # shingles of an item
            span = min(whole, len(part))                 # and in a window: less if the document has fewer words
            wanted = np.zeros(len(part) + 1, dtype=np.int64)
            spots = np.array(places) - low
            np.add.at(wanted, np.maximum(0, spots - span + 1), 1)
            np.add.at(wanted, spots + 1, -1)
            starts = np.flatnonzero(np.cumsum(wanted)[:len(part) - span + 1])
            if not len(starts):
                continue
            prints = fingerprints(sums[starts + span] - sums[starts])
            near = self.near[n][0][prints[:, 0]]
            for k in range(1, BLOCKS):
                near = near | self.near[n][k][prints[:, k]]
            rows, columns = np.nonzero(near)
            apart = _ONES[prints[rows] ^ self.prints[n][columns]].sum(axis=1)
            close = apart <= RADIUS
            for i, j in zip(starts[rows[close]].tolist(), columns[close].tolist()):
                item, counts = self.by_length[n][j]
                own = Counter(part[i:i + span].tolist())
                both = sum(min(c, counts[s]) for s, c in own.items() if s in counts)
                similarity = both / (span + whole - both)
                best = found.get(item, (0.0, 0, 0))
                start = low + i - begin
                stop = start + span + size - 1
                if similarity >= THRESHOLD and (-similarity, start, stop) < (-best[0], best[1], best[2]):
                    found[item] = (similarity, start, stop)


def _parts(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, in parts of at most about ITEM_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // ITEM_BYTES))
    if n == 1:
        return [[(r[0], r[1]) for r in items.collect()]]                 # ITEM_BYTES of text at most
    return [[(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()] for i in range(n)]


def _matched(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            counts, found, i = [], [], 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BYTES, side="right")) - 1)
                words = words_of(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], FOLDED)
                counts.append(words.counts())
                found += index.matches(words.hashes, words.firsts)
                i = j
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())]))
            rows = [[{"item_id": k, "start": a, "end": b, "similarity": s} for k, (s, a, b) in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(rows, kind)],
                names=["row", "n_words", "matches"])

    return map_batches(docs, run, f"row {docs.schema[0].dataType.simpleString()}, n_words bigint, matches {MATCH}")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, matches of each row of ``docs(doc_id, text)``.

    matches: (item_id, start, end, similarity) by item: the item's best window,
    in words from 0, end exclusive; of equals the first, then the shortest. An
    empty list: clean.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    parts = _parts(benchmark)
    if len(parts) == 1:
        return _matched(rows, parts[0]).withColumnRenamed("row", "doc_id")
    # Rows are told apart by id, text and how often both occur.
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("a"), F.md5("text").alias("b")).alias("row"), "text").distinct()
    each = None
    for items in parts:
        one = _matched(keyed, items)
        each = one if each is None else each.unionByName(one)
    # Wordings of one item can lie in different parts: of each item the best match stays.
    ordered = F.transform(F.flatten(F.collect_list("matches")), lambda m: F.struct(
        m["item_id"].alias("item_id"), (-m["similarity"]).alias("order"), m["start"].alias("start"), m["end"].alias("end")))
    merged = each.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(ordered).alias("all"))
    best = F.filter("all", lambda m, i: (i == 0) | (F.get(F.col("all"), i - 1)["item_id"] != m["item_id"]))
    merged = merged.select("row", "n_words", F.transform(best, lambda m: F.struct(
        m["item_id"].alias("item_id"), m["start"].alias("start"), m["end"].alias("end"), (-m["order"]).alias("similarity"))).alias("matches"))
    back = rows.select(F.struct("doc_id", F.xxhash64("text").alias("a"), F.md5("text").alias("b")).alias("row"))
    return (back.withColumn("key", F.to_json("row")).join(merged.withColumn("key", F.to_json("row")).drop("row"), "key")
            .select(F.col("row.doc_id").alias("doc_id"), "n_words", "matches"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, with all columns."""
    out = docs
    for items in _parts(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            index = Index(held.value)
            for batch in batches:
                buf, offsets = text_buffer(batch.column(at))
                keep, i = np.ones(batch.num_rows, dtype=bool), 0
                while i < batch.num_rows:
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BYTES, side="right")) - 1)
                    words = words_of(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], FOLDED)
                    keep[i:j] = [not f for f in index.matches(words.hashes, words.firsts)]
                    i = j
                yield batch.filter(pa.array(keep))

        out = map_batches(out, run, out.schema)
    return out
