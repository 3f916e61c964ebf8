import base64
import random

import pytest
import tiktoken

from farebox.llm import byte_bpe as B


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(B.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return B.ByteBPE.of(B.model_json(B.read_ranks(B.VOCABULARY)), B.PATTERN)


def test_every_kind_of_character_and_repeats(bpe, reference):
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}\n's" for c in [*range(0x0, 0x2100), *range(0x3000, 0x3100), *range(0x1F600, 0x1F640)]]
    rng = random.Random(3)
    parts = ["a", "aa", "-", "--", "---", " ", "  ", "\n", "é", "日本", "\U0001f600", "A", "0", "!", "'s", "'ll", "\x1c", "\x85", "<|endoftext|>"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "=" * 999, ""]
    found = bpe.encode(texts)
    assert [x.tolist() for x in found] == [reference.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x) for x in found] == [t.encode() for t in texts]


def test_offsets_give_split_characters_to_all_their_tokens(bpe):
    text = "né \U0001f9ff日x"
    ids = bpe.encode([text])[0]
    starts, ends = bpe.offsets(text, ids)
    for token, a, b in zip(ids, starts, ends):
        assert bpe.table[token] in text[a:b].encode()
    assert set(range(len(text))) == {i for a, b in zip(starts, ends) for i in range(a, b)}
    assert any(len(bpe.table[t]) < len(text[a:b].encode()) for t, a, b in zip(ids, starts, ends))
    empty = bpe.offsets("", bpe.encode([""])[0])
    assert [len(x) for x in empty] == [0, 0]


def test_tables(spark, docs, no_docs, rows, reference):
    found = B.encode(docs, offsets=True)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in found.collect())
    assert got == sorted((str(i), reference.encode_ordinary(t or "")) for i, t in rows)
    both = B.encode(docs, decoded=True).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in both) == sorted(
        (str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    back = B.decode(found.drop("starts", "ends").withColumn("decoded", found["doc_id"])).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert B.encode(no_docs).count() == 0 and B.decode(B.encode(no_docs)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(B.decode(nothing).first()["decoded"]) == b""
