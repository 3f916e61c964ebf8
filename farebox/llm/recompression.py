"""Repeated passages by recompression.

Words are hashed, then compressed in rounds. First every run of equal words
becomes one symbol, named by the word and the run's length. Then come rounds of
pairs: each symbol gets a coin from its own name, left or right, and a left
symbol followed by a right one merges with it into a pair, named by the two
names. Names are hashes: they and the coins depend on nothing but the symbols,
so all tasks name alike, without a shuffle, and equal word sequences parse
alike, except near their ends, where a run might go on or a symbol merge with
an unknown neighbour.

For a window of ``WINDOW`` words the symbols that are certain whatever
surrounds it are known from its words alone. Among the certain symbols of the
last of ``ROUNDS`` rounds that has any (before all rounds the words are), one
is the window's anchor, chosen by size and name. Equal windows have equal
anchors at equal places, and windows that follow each other mostly share one.

1. Every document gives one row for each anchor and the consecutive windows
   that share it: the anchor's name, and a hash of the block of words that
   those windows cover. Blocks that repeat inside a batch are settled there
   (this thins hot passages before the shuffle).
2. Per anchor name, blocks that are not the first of their kind repeat an
   earlier passage in full. A name whose blocks differ leaves the first block
   of each kind to be compared window by window.
3. Those windows are hashed in full (128 bits); all but the first of each kind
   repeat.

Words covered by a repeating window go. Windows are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm.common import map_batches, scratch
from farebox.llm.words import mix, text_buffer, window_hashes, words_of

WINDOW = 20
ROUNDS = 4                             # of pairs
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _first_of_range(size: np.ndarray, names: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Per range of symbols (both ends inclusive) the one to anchor on.

    Longer symbols first (four words or more count alike), then the smaller
    name, then the left one: the choice rests on the range's symbols only.
    """
    short = np.uint64(4) - np.minimum(size, np.uint64(4))
    order = (short << np.uint64(61)) | (names >> np.uint64(3))
    length = highs - lows + 1
    step = np.zeros(int(length.max()) + 1, dtype=np.int64)
    step[1:] = np.floor(np.log2(np.arange(1, len(step)))).astype(np.int64)
    steps = step[length]
    best = np.arange(len(names))
    out = np.empty(len(lows), dtype=np.int64)
    for k in range(int(steps.max()) + 1):
        if k:
            other = best[(1 << (k - 1)):]
            own = best[:len(other)]
            best = np.where(order[other] < order[own], other, own)
        at = np.flatnonzero(steps == k)
        one, two = best[lows[at]], best[highs[at] - (1 << k) + 1]
        out[at] = np.where(order[two] < order[one], two, one)
    return out


def anchors(hashes: np.ndarray, firsts: np.ndarray, window: int = WINDOW):
    """Anchor name and anchor word of every window start of a batch of documents.

    Returns (starts, names, places): ascending window starts (positions into
    the words), the name of each window's anchor and the word where it begins.
    """
    counts = np.diff(firsts)
    n = len(hashes)
    inside = np.ones(n, dtype=bool)
    for k in range(1, window):                       # the last window - 1 words start no window
        at = firsts[1:][counts >= k] - k
        inside[at] = False
    starts = np.flatnonzero(inside)
    names, begins, size = hashes, np.arange(n), np.ones(n, dtype=np.uint64)
    last = np.zeros(n, dtype=bool)                   # symbol ends its document
    last[firsts[1:][counts > 0] - 1] = True
    lows, highs = starts.copy(), starts + window - 1
    live = np.arange(len(starts))
    found_names = np.zeros(len(starts), dtype=np.uint64)
    found_places = np.zeros(len(starts), dtype=np.int64)

    def settle(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if len(which):
            at = _first_of_range(size, names, low, high)
            found_names[which], found_places[which] = names[at], begins[at]

    head = np.ones(n, dtype=bool)                    # starts a run of equal words
    head[1:] = (names[1:] != names[:-1]) | last[:-1]
    heads = np.flatnonzero(head)
    index = np.cumsum(head) - 1
    after = np.append(heads[1:], n)                  # end of each run
    inner_lows, inner_highs = after[index[lows]], heads[index[highs]] - 1   # runs at the edges may go on
    kept = inner_lows <= inner_highs
    settle(live[~kept], lows[~kept], highs[~kept])
    lows, highs, live = index[inner_lows[kept]], index[inner_highs[kept]], live[kept]
    size = (after - heads).astype(np.uint64)
    with np.errstate(over="ignore"):
        names = np.where(size > 1, mix(names[heads] * _A + size * _B), names[heads])
    begins, last = heads, last[after - 1]
    for level in range(ROUNDS):
        if not len(live):
            break
        with np.errstate(over="ignore"):
            coin = (mix(names + np.uint64(level + 1) * _B) >> np.uint64(63)).astype(bool)   # True: right
        merge = np.zeros(len(names), dtype=bool)     # symbol i merges with i + 1
        merge[:-1] = ~coin[:-1] & coin[1:] & ~last[:-1]
        head = np.ones(len(names), dtype=bool)       # not the second of a pair
        head[1:] = ~merge[:-1]
        inner_lows = lows + coin[lows]               # a right symbol may belong to an unknown left one
        inner_highs = highs - ~coin[highs]
        kept = inner_lows <= inner_highs
        settle(live[~kept], lows[~kept], highs[~kept])
        index = np.cumsum(head) - 1
        lows, highs, live = index[inner_lows[kept]], index[inner_highs[kept]], live[kept]
        heads = np.flatnonzero(head)
        joined = merge[heads]
        seconds = heads[joined] + 1
        fresh, sizes = names[heads], size[heads]
        with np.errstate(over="ignore"):
            fresh[joined] = mix(names[heads[joined]] * _A + (names[seconds] ^ _B) * _B + np.uint64(level))
        sizes[joined] += size[seconds]
        names, begins, size, last = fresh, begins[heads], sizes, last[heads + joined]
    settle(live, lows, highs)
    return starts, found_names, found_places


#: Words parsed at a time; longer documents are parsed in overlapping pieces.
PIECE = 400_000
_BYTES = 4 << 20
_KEY = (1 << 27) - 1


def pack(start: np.ndarray, more: np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """A range of windows in one value: first start, further windows, 27 bits of the text's hash."""
    return (start.astype(np.int64) << 32) | (more.astype(np.int64) << 27) | (key & _KEY)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``_BYTES`` of text (one row at least)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    i = 0
    while i < batch.num_rows:
        done = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, done + _BYTES, side="right")))
        yield batch.slice(i, j - i)
        i = j


def _pieces(firsts: np.ndarray, limit: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, first word, end) that hold about ``limit`` words and overlap by a window less one."""
    group, held = [], 0
    for doc, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        while b - a >= WINDOW:
            end = min(b, a + limit)
            group.append((doc, a, end))
            held += end - a
            if held >= limit:
                yield group
                group, held = [], 0
            if end == b:
                break
            a = end - WINDOW + 1
    if group:
        yield group


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, key, text) to one row for each anchor and run of windows that share it."""
    for batch in batches:
        for part in _slices(batch, 2):
            words = words_of(*text_buffer(part.column(2)))
            docs, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
            for group in _pieces(words.firsts, PIECE):
                hashes = np.concatenate([words.hashes[a:b] for _, a, b in group])
                cuts = np.concatenate(([0], np.cumsum([b - a for _, a, b in group])))
                starts, names, places = anchors(hashes, cuts)
                fresh = np.ones(len(starts), dtype=bool)
                fresh[1:] = ((places[1:] != places[:-1]) | (names[1:] != names[:-1])
                             | (starts[1:] != starts[:-1] + 1))
                at = np.flatnonzero(fresh)
                low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
                whole = window_hashes(hashes, WINDOW)
                with np.errstate(over="ignore"):     # first and last window cover the block
                    block = mix(whole[low] * _A + whole[high] * _B
                                + (((high - low) << 8) | (places[at] - low)).astype(np.uint64))
                owner = np.searchsorted(cuts, low, side="right") - 1
                row = np.array([g[0] for g in group])[owner]
                shift = np.array([g[1] - words.firsts[g[0]] for g in group])[owner] - cuts[owner]
                doc, pos = docs[row], pack(low + shift, high - low, keys[row])
                name = names[at]
                order = np.lexsort((pos >> 32, doc, block, name))
                name, block, doc, pos = name[order], block[order], doc[order], pos[order]
                same = np.zeros(len(name), dtype=bool)
                same[1:] = (name[1:] == name[:-1]) & (block[1:] == block[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
                settled = (doc != doc[lead]) | (pos >> 32 != pos[lead] >> 32)
                with np.errstate(over="ignore"):     # what is settled spreads over all tasks
                    name = np.where(settled, mix(doc.astype(np.uint64) * _A + pos.astype(np.uint64)), name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc), pa.array(pos),
                     pa.array(settled)], names=["name", "block", "doc", "pos", "settled"])


def _chosen(ranges: list[int], key: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and further windows of those ranges that belong to this text."""
    packed = np.array(ranges, dtype=np.int64)
    packed = packed[(packed & _KEY) == (key & _KEY)]
    return packed >> 32, (packed >> 27) & 31


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, key, text, ranges) to the 128-bit hashes of all windows in the ranges."""
    for batch in batches:
        for part in _slices(batch, 3):
            words = words_of(*text_buffer(part.column(3)))
            first, second = words.hashes, mix(words.hashes ^ _B)
            found: list[tuple[np.ndarray, ...]] = []
            for i, (doc, key, ranges) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 2, 4)))):
                low, more = _chosen(ranges, key)
                if not len(low):
                    continue
                starts = np.unique(np.concatenate([np.arange(a, a + m + 1) for a, m in zip(low.tolist(), more.tolist())]))
                at = starts + words.firsts[i]
                with np.errstate(over="ignore"):
                    one, two = first[at], second[at]
                    for k in range(1, WINDOW):
                        one = one * _A + first[at + k]
                        two = two * _B + second[at + k]
                found.append((one, two, np.full(len(at), doc), pack(starts, np.zeros(len(at)), key)))
            if found:
                one, two, doc, pos = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64)),
                     pa.array(doc, pa.int64()), pa.array(pos)], names=["one", "two", "doc", "pos"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, key, text, ranges) to the kept words, joined by one space."""
    for batch in batches:
        for part in _slices(batch, 3):
            counts, removed, kept = [], [], []
            for key, text, ranges in zip(*(part.column(c).to_pylist() for c in (2, 3, 4))):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                if ranges:
                    low, more = _chosen(ranges, key)
                    np.add.at(gone, low, 1)
                    np.add.at(gone, low + more + WINDOW, -1)
                gone = np.cumsum(gone)[:-1] > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                left = [words[i] for i in np.flatnonzero(~gone).tolist()] if removed[-1] else words
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): one row for each row of ``docs(doc_id, text)``.

    A word goes if it lies in a window of ``WINDOW`` words whose sequence also
    starts earlier: in a smaller doc_id, or before in the same document. Words
    are maximal runs without space and 0x09-0x0D; kept words are joined by one
    space. Null or wordless text gives an empty text. Rows that share a doc_id
    are one document, so neither is earlier; a null doc_id comes after all
    others. Further input columns are ignored. An empty table gives no rows.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    texts = docs.select(doc.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    start = F.shiftright("pos", 32)
    blocks = (map_batches(texts.select("doc", "key", "text"), _blocks,
                          "name long, block long, doc long, pos long, settled boolean")
              .withColumn("start", start)
              .repartition("name").sortWithinPartitions("name", "block", "doc", "start"))
    per_name = Window.partitionBy("name")
    place = F.rank().over(Window.partitionBy("name", "block").orderBy("doc", "start"))
    judged = (blocks.withColumn("differ", F.min("block").over(per_name) != F.max("block").over(per_name))
              .withColumn("place", place)
              .withColumn("repeats", F.col("settled") | (F.col("place") > 1))
              .where("repeats or differ").select("doc", "pos", "repeats"))
    judged = scratch(judged, "blocks")

    def with_ranges(ranges: DataFrame, how: str) -> DataFrame:
        return (texts.join(ranges.groupBy("doc").agg(F.collect_list("pos").alias("ranges")), "doc", how)
                .select("doc", "doc_id", "key", "text", "ranges"))

    windows = map_batches(with_ranges(judged.where("not repeats"), "inner"), _windows,
                          "one long, two long, doc long, pos long")
    later = (windows.withColumn("place", F.rank().over(Window.partitionBy("one", "two").orderBy("doc", start)))
             .where("place > 1").select("doc", "pos"))
    ranges = judged.where("repeats").select("doc", "pos").unionByName(later)
    return map_batches(with_ranges(ranges, "left"), _without,
                       "doc_id long, n_words long, n_removed long, kept string")
