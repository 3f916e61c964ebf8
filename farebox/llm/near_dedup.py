"""Near-duplicate documents by HyperMinHash registers.

Every document is a set of word 5-shingles (A-Z lower-cased). Each of
``REGISTERS`` buckets hashes the whole set with its own seed and keeps, of the
smallest hash, the number of leading zeros and the next ``MANTISSA`` bits: 16
bits a bucket. (A seed for each bucket, rather than one hash split over the
buckets, fills every bucket of short documents too.)

1. Sets with equal 128-bit digests form a class; its smallest doc_id stands
   for it. Copies never become pairs.
2. ``BANDS`` bands of ``ROWS`` compressed registers each make bucket keys. At a
   similarity of 0.75 a pair shares no band with probability 2.5e-7. Classes
   that share a bucket get ``FINE`` more registers, of 8 bits, to estimate with.
3. In each bucket every class is paired with one hub (the member that comes
   first in a fixed random order): linear in the bucket's size. Pairs whose
   collision-corrected estimate is under ``FLOOR`` (4.5 standard deviations
   below the threshold: lost with probability 3e-6) are dropped; the others
   are confirmed on the full sets. Confirmed links give components.
4. Buckets whose members are still in several components are searched for
   pairs across components: members outside the bucket's largest component
   against all members, in blocks of bounded size spread over tasks. First
   each such member offers its best partner only, which joins most of them;
   then all pairs above the floor come out, each from the first band that they
   share. They are confirmed in the same way, and the components computed again.

A pair is left unchecked only if its two documents are already connected, so
components are those of the whole link graph (up to the probabilities above).

Edge cases: null or wordless text has an empty set, is linked with nothing and
is its own component. Rows sharing a doc_id are one node. A row with a null
doc_id takes no part: its component is null, and it is kept. Other columns of
the input are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import map_batches, scratch, ship
from farebox.llm.components import connected_components
from farebox.llm.words import FOLDED, mix, shingles_by_document, text_buffer, words_of

SHINGLE = 5
THRESHOLD = 75                       # per cent: 100 * intersection >= 75 * union
ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
MANTISSA = 10
FINE, FINE_MANTISSA = 1024, 3
FLOOR = 0.68
#: Rows of a bucket that one task compares with each other.
LEFT_BLOCK, RIGHT_BLOCK = 256, 4096
_STEP = 1 << 15
#: Sets whose registers are made and handed on at a time: memory must not follow the rows of a batch.
SET_ROWS = 256

_SEEDS = mix(np.arange(1, 2 * (REGISTERS + FINE) + 1, dtype=np.uint64)) >> np.uint64(32)
_XOR = _SEEDS[::2].astype(np.uint32)
_FACTOR = _SEEDS[1::2].astype(np.uint32) | np.uint32(1)

SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, registers binary"


def compress(minima: np.ndarray, mantissa: int) -> np.ndarray:
    """Leading zeros (5 bits) and ``mantissa`` bits behind them of 32-bit minima, in the smallest type."""
    _, bits = np.frexp(minima.astype(np.float64))          # bit length; 0 for 0
    zeros = np.minimum(32 - bits, 31).astype(np.uint32)
    shifted = (minima << zeros) << np.uint32(1)            # two steps: a shift by 32 is undefined
    packed = (zeros << np.uint32(mantissa)) | (shifted >> np.uint32(32 - mantissa))
    return packed.astype(np.uint8 if mantissa <= 3 else np.uint16)


def minima_of(sets: list[np.ndarray], first: int, count: int) -> np.ndarray:
    """Smallest hash in each of ``count`` buckets, one row for each (non-empty) shingle set."""
    minima = np.empty((len(sets), count), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, n = i + 1, len(sets[i])
        while j < len(sets) and n + len(sets[j]) <= _STEP:
            n += len(sets[j])
            j += 1
        own = np.concatenate(sets[i:j])
        low = (own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32)
        cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i:j - 1]], dtype=np.int64))).astype(np.int64)
        for k in range(count):
            h = low ^ _XOR[first + k]
            h *= _FACTOR[first + k]
            h ^= h >> np.uint32(15)
            minima[i:j, k] = np.minimum.reduceat(h, cuts)
        i = j
    return minima


def _compressed(sets: list[np.ndarray], first: int, count: int, mantissa: int) -> np.ndarray:
    """Compressed registers of the sets, ``SET_ROWS`` of them at a time."""
    parts = [compress(minima_of(sets[i:i + SET_ROWS], first, count), mantissa) for i in range(0, max(len(sets), 1), SET_ROWS)]
    return np.concatenate(parts)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """The banded registers, 16 bits each."""
    return _compressed(sets, 0, REGISTERS, MANTISSA)


def fine_registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers for estimates, 8 bits each."""
    return _compressed(sets, REGISTERS, FINE, FINE_MANTISSA)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        sets = shingles_by_document(words_of(buf, offsets, FOLDED), SHINGLE)
        full = [i for i, s in enumerate(sets) if len(s)]
        regs = registers_of([sets[i] for i in full])
        column: list[bytes | None] = [None] * len(sets)
        for row, i in enumerate(full):
            column[i] = regs[row].tobytes()
        sums = np.zeros((2, len(sets)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in full:
                sums[0, i] = sets[i].sum(dtype=np.uint64)
                sums[1, i] = mix(sets[i] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        digest = sums.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(digest[0]), pa.array(digest[1]), pa.array(column, pa.binary())],
            names=["doc_id", "n_shingles", "digest_a", "digest_b", "registers"])


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, set digest and registers of every row of ``docs(doc_id, text)``."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _sketch, SKETCH)


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to all that later steps need of a class."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        sets = shingles_by_document(words_of(buf, offsets, FOLDED), SHINGLE)
        full = [i for i, s in enumerate(sets) if len(s)]
        for k in range(0, len(full), SET_ROWS):
            some = full[k:k + SET_ROWS]
            own = [sets[i] for i in some]
            columns = [batch.column(0).take(pa.array(some, pa.int64())), pa.array([len(s) for s in own], pa.int64())]
            for rows in (registers_of(own), fine_registers(own), own):
                columns.append(pa.array([r.tobytes() for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n_shingles", "registers", "fine", "shingles"])


@lru_cache(maxsize=4096)
def _cells(step: int) -> np.ndarray:
    """Chance that the minimum of 1.1 ** step random hashes falls in each fine register value."""
    n = 1.1 ** step
    zeros = np.arange(32, dtype=np.float64)[:, None]
    inner = np.arange(2 ** FINE_MANTISSA + 1, dtype=np.float64)[None, :]
    edges = 2.0 ** (-zeros - 1) * (1 + inner / 2 ** FINE_MANTISSA)
    above = np.exp(n * np.log1p(-np.minimum(edges, 1 - 1e-12)))
    return (above[:, :-1] - above[:, 1:]).ravel()


@lru_cache(maxsize=1 << 16)
def chance_equal(a: int, b: int) -> float:
    """Share of registers that are equal by chance in sets of 1.1 ** a and 1.1 ** b."""
    return float(_cells(a) @ _cells(b))


def size_step(n: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(n, 1)) / np.log(1.1)).astype(int)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from counts of equal registers, less chance collisions."""
    chance = np.array([chance_equal(*sorted(p)) for p in zip(size_step(n_a).tolist(), size_step(n_b).tolist())])
    return np.maximum(0.0, (equal / FINE - chance) / (1 - chance))


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """Equally long binary values as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b, n_a, n_b, fine_a, fine_b) whose estimate reaches FLOOR."""
    for batch in batches:
        if not batch.num_rows:
            continue
        equal = (_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(axis=1)
        kept = estimate(equal, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= FLOOR
        yield batch.select([0, 1]).filter(pa.array(kept))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs (a, b, shingles_a, shingles_b) that reach THRESHOLD on the full sets."""
    for batch in batches:
        kept = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x = np.frombuffer(a.as_py(), dtype=np.uint64)
            y = np.frombuffer(b.as_py(), dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def _across(group: pa.Table) -> pa.Table:
    """Pairs across components between the left and right rows of one block of a bucket."""
    left = group.filter(group["left"])
    right = group.filter(pc.invert(group["left"]))
    found_a, found_b = [], []
    if left.num_rows and right.num_rows:
        ids, comps, sizes = (right[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        fine, own_fine = _matrix(right["fine"]), _matrix(left["fine"])
        keys, own_keys = _matrix(right["registers"], np.uint64), _matrix(left["registers"], np.uint64)
        band, best = left["band"][0].as_py(), left["best"][0].as_py()
        for i, (rep, comp, size) in enumerate(zip(*(left[c].to_pylist() for c in ("rep", "component", "n_shingles")))):
            other = np.flatnonzero((comps != comp) & (100 * np.minimum(sizes, size) >= THRESHOLD * np.maximum(sizes, size)))
            if not len(other):
                continue
            likely = estimate((fine[other] == own_fine[i]).sum(axis=1), sizes[other], np.full(len(other), size))
            if best:
                other = other[[int(likely.argmax())]] if likely.max() >= FLOOR else other[:0]
            else:
                other = other[likely >= FLOOR]
                other = other[(keys[other] == own_keys[i]).argmax(axis=1) == band]
            found_a += np.minimum(ids[other], rep).tolist()
            found_b += np.maximum(ids[other], rep).tolist()
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("shingles_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("shingles_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "shingles_a", "shingles_b")
    return map_batches(both, _confirmed, "a long, b long")


def _open_pairs(shared: DataFrame, component: DataFrame, details: DataFrame, best: bool) -> DataFrame:
    """Step 4: likely pairs across components in buckets that hold several."""
    placed = (shared.select("bucket", "band", "rep").join(component, F.col("rep") == F.col("node"), "left")
              .select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component")))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_buckets = (sizes.groupBy("bucket")
                    .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total"),
                         F.count("*").alias("components"))
                    .where("components > 1")
                    .select("bucket", F.col("top.component").alias("largest"),
                            F.ceil((F.col("total") - F.col("top.n")) / LEFT_BLOCK).cast("int").alias("n_left"),
                            F.ceil(F.col("total") / RIGHT_BLOCK).cast("int").alias("n_right")))
    member = (placed.join(open_buckets, "bucket").join(details.select("rep", "n_shingles", "registers", "fine"), "rep")
              .withColumn("salt", F.xxhash64("rep", F.lit(7))).withColumn("best", F.lit(best)))
    left = (member.where("component != largest")
            .withColumn("i", F.expr("pmod(salt, n_left)"))
            .withColumn("j", F.explode(F.expr("sequence(0, n_right - 1)"))).withColumn("left", F.lit(True)))
    right = (member.withColumn("j", F.expr("pmod(salt, n_right)"))
             .withColumn("i", F.explode(F.expr("sequence(0, n_left - 1)"))).withColumn("left", F.lit(False)))
    columns = ["bucket", "i", "j", "left", "best", "band", "rep", "component", "n_shingles", "registers", "fine"]
    sides = [side.select(*[F.col(c).cast("long") if c in "ij" else F.col(c) for c in columns]) for side in (left, right)]
    return sides[0].unionByName(sides[1]).groupBy("bucket", "i", "j").applyInArrow(_across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    ship(docs.sparkSession)
    sketches = scratch(sketch(docs), "sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    digest = ["n_shingles", "digest_a", "digest_b"]
    # Stored, so that the joins below lie right behind their shuffles, where a hot class is split.
    classes = scratch(named.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")
    reps = (named.join(classes, digest).where(F.col("doc_id") == F.col("rep"))
            .select("rep", "n_shingles", "registers").dropDuplicates(["rep", "n_shingles", "registers"]))
    banded = reps.select("rep", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, i * {2 * ROWS} + 1, {2 * ROWS})))"
    )).alias("band", "bucket"))
    order = F.struct(F.xxhash64("rep").alias("rank"), F.col("rep"))
    hubs = (banded.groupBy("bucket").agg(F.min(order).alias("hub"), F.min("rep").alias("low"), F.max("rep").alias("high"))
            .where("low < high").select("bucket", F.col("hub.rep").alias("hub")))
    shared = scratch(banded.join(hubs, "bucket"), "buckets")

    active = shared.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(active, "rep")
    details = scratch(map_batches(
        texts, _details, "rep long, n_shingles long, registers binary, fine binary, shingles binary"), "details")

    stars = (shared.where("rep != hub")
             .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    one = details.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("fine").alias("fine_a"))
    two = details.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("fine").alias("fine_b"))
    stars = (stars.join(one, "a").join(two, "b")
             .where(f"100 * least(n_a, n_b) >= {THRESHOLD} * greatest(n_a, n_b)")
             .select("a", "b", "n_a", "n_b", "fine_a", "fine_b"))
    links = scratch(_confirm(map_batches(stars, _estimated, "a long, b long"), details), "links", small_rows=True)
    component = connected_components(links)
    for best in (True, False):
        more = scratch(_confirm(_open_pairs(shared, component, details, best), details), "links", small_rows=True)
        if not more.isEmpty():
            # Each node's link to its smallest stands for those that led there: fewer rounds, fewer jobs on the driver.
            links = component.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
            component = connected_components(links)

    found = classes.join(component, F.col("rep") == F.col("node"), "left").select(
        *digest, F.coalesce("component", "rep").alias("linked"))
    out = (sketches.select("doc_id", *digest).join(found, digest, "left")
           .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
