"""Byte-level BPE encoding and decoding with the tokenizers library.

The rank file (base64 token and rank on each line) becomes a tokenizers BPE
model: bytes are mapped to printable characters, and every token of two or
more bytes gets the one merge that can make it (the two parts into which the
lower ranks bring it). A word that is itself a token is taken whole. Texts are
cut by the pattern, and each distinct piece is encoded once and kept in a
bounded table, as pieces are independent of each other.

Decoding joins the tokens' bytes (the byte table reversed). A token may hold
part of a character only: offsets then give the whole character to each of its
tokens, and text decoded from a stretch of ids shows a cut character as U+FFFD.

Null text (or a null list of ids) is empty; an empty text has no ids and decodes to an empty string.
Rows pass one by one, so repeated rows and tables without rows need no case of
their own. Extra columns are ignored by ``encode`` and kept by ``decode``.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from farebox.llm.common import map_batches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Unicode's White_Space, which the pattern's \s stands for.
WHITE_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pieces kept with their ids, and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 200_000, 48
_BYTES, _AT_ONCE = 1 << 20, 2000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by ranks lower than the token's own makes of its bytes."""
    own = ranks[token]
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def model_json(ranks: dict[bytes, int]) -> str:
    """The tokenizers model of a rank table, as JSON."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()

    def text(token: bytes) -> str:
        return "".join([shown[b] for b in token])

    pairs = (parts_of(token, ranks) for token in sorted(ranks, key=ranks.get) if len(token) > 1)
    merges = [(text(p[0]), text(p[1])) for p in pairs if len(p) == 2]
    tokenizer = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class ByteBPE:
    """Encoder and byte table of one vocabulary, held by a Python worker."""

    _loaded: dict[int, "ByteBPE"] = {}

    def __init__(self, model: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"(?!\S)", f"(?![^{WHITE_SPACE}])")
                                   .replace(r"\s", f"[{WHITE_SPACE}]")).findall
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = json.loads(model)["model"]["vocab"]
        self.table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, rank in vocabulary.items():
            self.table[rank] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(t) for t in self.table], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(self.table), dtype=np.uint8)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.kept: dict[str, bytes] = {}             # piece: its ids as 32-bit integers

    @classmethod
    def of(cls, model: str, pattern: str) -> "ByteBPE":
        key = hash((model, pattern))
        if key not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[key] = cls(model, pattern)
        return cls._loaded[key]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.split(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        fresh = list(set(chain.from_iterable(pieces)).difference(self.kept))
        for i in range(0, len(fresh), _AT_ONCE):       # the library's result objects are large
            some = fresh[i:i + _AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.kept.update((p, array("i", e.ids).tobytes()) for p, e in zip(some, encoded))
        ids = [np.frombuffer(b"".join(map(self.kept.__getitem__, own)), dtype=np.int32) for own in pieces]
        for p in fresh:
            if len(p) > KEPT_LENGTH:
                del self.kept[p]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids: one gather from the byte table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.firsts[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; a shared character is in all its tokens."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return character[starts] - 1, character[ends - 1]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of consecutive rows that hold about ``_BYTES`` of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    i = 0
    while i < len(column):
        done = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, done + _BYTES, side="right")))
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
           offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, on demand, starts and ends (characters) of each row of
    ``docs(doc_id, text)``, or the bytes that the ids decode to.

    The driver reads the vocabulary file and broadcasts the model, which is of
    the vocabulary's size whatever the table.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model_json(read_ranks(vocabulary)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(*held.value)
        for batch in batches:
            for i, texts in _groups(batch.column(1)):
                ids = bpe.encode(texts)
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [batch.column(0).slice(i, len(texts)), pa.ListArray.from_arrays(cuts, np.concatenate(ids))]
                if offsets:
                    spans = [bpe.offsets(t, x) for t, x in zip(texts, ids)]
                    columns += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "ids", *["starts", "ends"] * offsets, *["decoded"] * decoded]
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Replaces the column ``ids`` by ``decoded``, the tokens' bytes, as the last column."""
    spark = tokens.sparkSession
    held = spark.sparkContext.broadcast((model_json(read_ranks(vocabulary)), pattern))
    others = [c for c in tokens.columns if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.of(*held.value)
        for batch in batches:
            lists = batch.column(len(others))
            cuts, flat = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
            decoded = [bpe.decode(flat[i:j]) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(decoded, pa.binary())],
                                             names=[*others, "decoded"])

    rows = tokens.select(*[F.col(f"`{c}`") for c in others], "ids")
    return map_batches(rows, run, StructType([*rows.schema.fields[:-1], StructField("decoded", BinaryType())]))
