"""CSV records with line breaks inside quotes, cut in parallel.

A line feed ends a record only outside quotes, and whether a line begins inside
them depends on everything before it in the file. Each line is a function of that
one state (inside at its start -> inside at its end); functions compose, so

1. every byte range of a file runs over its own lines for both possible states at
   its start and notes, with each line, the state before and behind it,
2. the ranges' functions are composed in file order (one row a range),
3. lines that begin and end outside are records as they are; the others, a
   record's parts, are put together by a group for each such record.

Quotes open a field only at its start; elsewhere in an unquoted field they stand
for themselves, and a doubled one stands for one inside quotes. Carriage returns
before a record's end are dropped. Every file has the same header, its first
record. Blank lines outside quotes are skipped. A quote that is never closed
makes the rest of its file one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.session import materialize, ship_package

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
LINE = "file string, range long, seq long, line string, before0 boolean, before1 boolean, after0 boolean, after1 boolean"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside quotes ends inside them."""
    at, start = 0, not inside                          # ``start``: at the start of a field
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == '"':
                at += 2
                continue
            inside, start, at = False, False, at + 1
        elif start and line[at:at + 1] == '"':
            inside, at = True, at + 1
        else:
            comma = line.find(",", at)
            if comma < 0:
                return False
            start, at = True, comma + 1


class _Range:
    """The lines of one byte range so far."""

    def __init__(self):
        self.seq = 0
        self.state = (False, True)                     # by the state at the range's start

    def add(self, lines: pa.Array) -> list[np.ndarray]:
        """States before and behind each line, for both states at the start."""
        n = len(lines)
        before, after = (np.empty((2, n), dtype=bool) for _ in range(2))
        changed = pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()
        at = 0
        for i in [*changed, n]:
            for k in (0, 1):
                before[k, at:i] = after[k, at:i] = self.state[k]
            if i < n:
                line = lines[i].as_py()
                before[:, i] = self.state
                self.state = tuple(ends_inside(line, s) for s in self.state)
                after[:, i] = self.state
            at = i + 1
        self.seq += n
        return [before[0], before[1], after[0], after[1]]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, line) in order to ``LINE``; a task reads its ranges one after the other."""
    ranges: dict[tuple, _Range] = {}
    for batch in batches:
        at = 0
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and keys[end] == keys[at]:
                end += 1
            own = ranges.setdefault(keys[at], _Range())
            part, first = batch.slice(at, end - at), own.seq
            states = own.add(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.arange(first, own.seq)), part.column(2), *[pa.array(s) for s in states]],
                names=["file", "range", "seq", "line", "before0", "before1", "after0", "after1"])
            at = end


def _starts(lines: DataFrame) -> DataFrame:
    """(file, range, inside): the state at each range's start, by composing the ranges before it."""
    ranges = lines.groupBy("file", "range").agg(F.max_by(F.struct("after0", "after1"), "seq").alias("f"))
    ordered = ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("range", "f"))).alias("ranges"))
    zero = F.struct(F.lit(False).alias("inside"), F.expr("cast(array() as array<struct<range:bigint,inside:boolean>>)").alias("out"))

    def step(acc, r):
        noted = F.concat(acc["out"], F.array(F.struct(r["range"].alias("range"), acc["inside"].alias("inside"))))
        return F.struct(F.when(acc["inside"], r["f"]["after1"]).otherwise(r["f"]["after0"]).alias("inside"), noted.alias("out"))

    found = ordered.select("file", F.explode(F.aggregate("ranges", zero, step, lambda acc: acc["out"])).alias("r"))
    return found.select("file", "r.range", "r.inside")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether it is the file's first record), record (its text) of every record under ``path``."""
    ship_package(spark)
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("line"))
    lines = materialize(spark, text.mapInArrow(_states, LINE), "csv-lines")       # read three times below
    starts = materialize(spark, _starts(lines), "csv-ranges")
    placed = lines.join(starts, ["file", "range"])
    began = F.when(F.col("inside"), F.col("before1")).otherwise(F.col("before0"))
    ended = F.when(F.col("inside"), F.col("after1")).otherwise(F.col("after0"))
    first = (F.col("range") == 0) & (F.col("seq") == 0)
    marked = placed.select("file", "range", "seq", "line", began.alias("began"), ended.alias("ended"), first.alias("first"))
    whole = marked.where("not began and not ended").select("file", "first", F.col("line").alias("record"))
    so_far = Window.partitionBy("file").orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = marked.where("began or ended").withColumn("number", F.sum(F.when(F.col("began"), 0).otherwise(1)).over(so_far))
    joined = parts.groupBy("file", "number").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("range", "seq", "line"))).alias("p"))
    many = joined.select("file", "first", F.array_join(F.col("p.line"), "\n").alias("record"))
    records = whole.unionByName(many).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where("first or trim(record) != ''")


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """All-text columns of the CSV files under ``path``, named by the header."""
    records = csv_records(spark, path)
    header = records.where("first").orderBy("file").limit(1).collect()
    if not header:
        raise ValueError(f"no CSV header under {path}")
    line = spark.range(1).select(F.lit(header[0]["record"]).alias("record"))
    width = header[0]["record"].count(",") + 1
    cells = line.select(F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), OPTIONS).alias("c")).select("c.*").first()
    names = [c for c in cells if c is not None]
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return (records.where("not first").select(F.from_csv("record", schema, OPTIONS).alias("c")).select("c.*").toDF(*names))
