"""Fill-in-middle transformation, cut by words of marks in a register (SWAR).

The texts of an Arrow batch are one UTF-8 buffer, viewed as 64-bit words. A
byte ends a unit (a code point) where the next byte is no continuation byte
(10xxxxxx); three shifts and a mask mark the ending bytes of eight bytes at a
time. ``bitwise_count`` of each word and a running sum give the rank of any
byte; the k-th unit's end is found by searching the running sum for its word
and, within the word, by a multiplication that makes prefix counts of all
eight bytes at once, compared with k in one subtraction. No text is decoded.

A document is cut at two places, both taken from a hash of its id: prefix,
middle, suffix. The output is ``psm`` (prefix, suffix, middle), ``spm``
(suffix, prefix, middle) or ``plain`` (the text as it is).

Edge cases: null text is empty; an empty text is plain, and so is a text that
holds a mark. A null doc_id is hashed as an empty one. Cuts may be at the ends, so that a part
is empty. Rows are independent: repeated rows give equal rows, an empty table
none. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import map_batches
from farebox.llm.words import text_buffer

# Marks and shares of the forms, in per cent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM_SHARE, SPM_SHARE = 90, 20

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_EACH = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)


class UnitIndex:
    """Rank and select over the unit-ending bytes of a UTF-8 buffer."""

    def __init__(self, buf: np.ndarray):
        self.size = len(buf)
        padded = np.zeros((self.size + 15) // 8 * 8, dtype=np.uint8)      # at least one byte behind the last
        padded[:self.size] = buf
        words = padded.view("<u8")
        first = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _EACH       # 1 in each byte that begins a unit
        self.ends = first >> np.uint64(8)
        self.ends[:-1] |= first[1:] << np.uint64(56)
        self.ends[-1] |= np.uint64(1 << 56)
        self.before = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.before[1:], dtype=np.int64)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Units that end before each byte place."""
        word = places >> 3
        below = (np.uint64(1) << (places & 7).astype(np.uint64) * np.uint64(8)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte place behind the k-th unit, from 1; 0 for k = 0."""
        word = np.maximum(np.searchsorted(self.before, k, side="left") - 1, 0)
        left = (k - self.before[word]).astype(np.uint64)                  # 1 to 8, or 0 where k is 0
        counts = self.ends[word] * _EACH                                  # byte i: ends in bytes 0 to i
        reached = ((counts | _HIGH) - left * _EACH) & _HIGH               # set from the byte that makes it ``left``
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, h1, h2, h3, h4) to ``OUT``."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        index = UnitIndex(buf)
        ranks = index.rank(offsets)
        n = np.diff(ranks)
        h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
        one, two = h1 % (n + 1), h2 % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        # A cut at 0 units is the text's start, which no unit of it ends.
        first = np.where(low > 0, index.select(ranks[:-1] + low), offsets[:-1])
        second = np.where(high > 0, index.select(ranks[:-1] + high), offsets[:-1])
        forms, outputs = [], []
        spm, chosen = h4 % 100 < SPM_SHARE, (n > 0) & (h3 % 100 < FORM_SHARE)
        for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist())):
            whole = buf[a:d].tobytes()
            if not chosen[i] or any(m in whole for m in marks):
                forms.append("plain")
                outputs.append(whole)
                continue
            prefix, middle, suffix = whole[:b - a], whole[b - a:c - a], whole[c - a:]
            forms.append("spm" if spm[i] else "psm")
            outputs.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle) if spm[i]
                                    else (marks[0], prefix, marks[1], suffix, marks[2], middle)))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain),
             pa.array(high - low, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, salt: str = "1:") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("digest", digest).select(
        "doc_id", "text", *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    return map_batches(rows, _transform, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of ``form`` was made from: a text in psm or spm
    holds no mark, and no mark can arise where a part meets one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)         # empty, then the three parts
    part = [F.element_at(parts, k) for k in range(1, 5)]
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
