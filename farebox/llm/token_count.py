"""Token counts by count-only Viterbi over a unigram vocabulary.

The pieces and scores of a sentencepiece model file are read as a unigram
vocabulary. An Aho-Corasick automaton enumerates all pieces that occur in a
text, and dynamic programming keeps, for each end position, the best score and
the number of pieces on the best path; no pieces are built. The tie rules are
the tokenizer's: starts go up, and a later start replaces a kept one only if
its score is strictly higher. A character that no one-character piece covers
may also be taken as unknown (lowest score less 10), and counts as its UTF-8
bytes when the vocabulary has byte pieces.

Text is normalised as by the tokenizer: a space becomes U+2581, and one is put
in front. If no piece holds U+2581 after another character, the best path never
crosses from another character into U+2581; nor does it cross a character that
no piece holds. So a text is a row of independent units, and each distinct unit
is solved once and kept in a bounded table.

Null and empty texts have 0 tokens. Rows pass one by one: repeated rows and
empty tables need no case of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from farebox.llm.common import map_batches

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units kept with their counts, and the longest unit that is kept.
KEPT_UNITS, KEPT_LENGTH = 1_000_000, 64


def read_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Scores of the normal pieces, and whether there are byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, has_bytes = {}, False
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            has_bytes = True
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = model.get_score(i)
    return scores, has_bytes


class Counter:
    """Automaton and kept units of one vocabulary, held by a Python worker."""

    _loaded: dict[int, "Counter"] = {}

    def __init__(self, scores: dict[str, float], has_bytes: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.has_bytes = has_bytes
        held = set().union(*map(set, scores))
        self.separable = not any(MARK in p.lstrip(MARK) for p in scores)
        alone = "".join(c for c in "\n\r\t" if c not in held)       # no piece holds these
        if not self.separable:
            self.units = lambda text: [text]
        else:
            self.units = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|[{alone}]" * bool(alone)).findall
        self.kept: dict[str, int] = {}

    @classmethod
    def of(cls, scores: dict[str, float], has_bytes: bool, key: int) -> "Counter":
        if key not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[key] = cls(scores, has_bytes)
        return cls._loaded[key]

    def solve(self, unit: str) -> int:
        """Pieces on the best path through one unit."""
        n = len(unit)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(unit):
            ending[end].append(match)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            top, count = None, 0
            # Longer pieces start earlier: they come first and keep ties.
            for length, score in sorted(ending[end], reverse=True):
                value = best[end + 1 - length] + score
                if top is None or value > top:
                    top, count = value, pieces[end + 1 - length] + 1
            if unit[end] not in self.single:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, count = value, pieces[end] + (len(unit[end].encode()) if self.has_bytes else 1)
            best[end + 1], pieces[end + 1] = top, count
        return pieces[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        units = self.units(MARK + text.replace(" ", MARK))
        kept = self.kept
        try:
            return sum(map(kept.__getitem__, units))
        except KeyError:
            pass
        if len(kept) > KEPT_UNITS:
            kept.clear()
        total = 0
        for unit in units:
            known = kept.get(unit)
            if known is None:
                known = self.solve(unit)
                if len(unit) <= KEPT_LENGTH:
                    kept[unit] = known
            total += known
        return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_tokens of each row of ``docs(doc_id, text)``.

    The driver reads the vocabulary file and broadcasts its pieces.
    """
    spark = docs.sparkSession
    scores, has_bytes = read_pieces(vocabulary)
    key = hash((tuple(scores.items()), has_bytes))
    held = spark.sparkContext.broadcast((scores, has_bytes, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(*held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([counter.count(t) for t in texts], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run,
                       "doc_id long, n_chars long, n_tokens long")
