import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, normalizers

from farebox.llm import token_count as T


@pytest.fixture(scope="module")
def reference():
    model = sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    own = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    own.normalizer = normalizers.Sequence([normalizers.Prepend(T.MARK), normalizers.Replace(" ", T.MARK)])
    return lambda text: len(own.encode(text).ids) if text else 0


def test_counts(spark, docs, no_docs, rows, reference):
    got = sorted((str(r["doc_id"]), r["n_chars"], r["n_tokens"]) for r in T.token_counts(docs).collect())
    assert got == sorted((str(i), len(t or ""), reference(t or "")) for i, t in rows)
    assert T.token_counts(no_docs).count() == 0


def test_spaces_marks_unknown_characters_and_ties(reference):
    counter = T.Counter(*T.read_pieces(T.VOCABULARY))
    rng = random.Random(2)
    parts = ["a", "the", "  ", " ", "\n", "é", "日", "\U0001f600", T.MARK, "ing", "un", "\t", "\r", "1", "%%", "\x00", "ß"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert counter.count(text) == reference(text), text


def test_unseparable_vocabulary_and_ties():
    equal = T.Counter({"a": -1.0, "b": -1.0, "ab": -2.0, T.MARK: 0.0}, False)
    assert equal.count("ab") == 2                      # the mark and "ab": the longer piece keeps a tie
    assert equal.count("xb") == 3
    crossing = T.Counter({"a": -1.0, "a" + T.MARK: -0.5, T.MARK: -1.0, "b": -1.0}, True)
    assert not crossing.separable and crossing.count("a b") == 3
