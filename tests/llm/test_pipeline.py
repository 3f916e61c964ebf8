import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from farebox.llm import byte_bpe, quality
from farebox.llm.common import held_out
from tests.llm import test_decontaminate, test_near_dedup, test_secret_scan

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """The rules of each stage applied to the rows of the one before, in Python (the trained scores are taken as given)."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), held_out(F.col("doc_id"), 3, 1))
    rows = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).collect() if r["score"] >= 0.5]
    kept = {a for a, _, _, keep in test_near_dedup.brute(rows) if keep}
    rows = [(i, t) for i, t in rows if str(i) in kept]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [r for r, found in zip(rows, test_decontaminate.brute(rows, items)) if not found]

    def redacted(text):
        for a, _, _, b in reversed([s for s in test_secret_scan.brute(text) if s[2] == "assign"]):
            text = text[:a] + "[SECRET]" + text[b:]
        return text

    assert all(not s or s[0][2] == "assign" for s in (test_secret_scan.brute(t) for _, t in rows))
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((i, redacted(t)) for i, t in rows)
    bpe = byte_bpe.ByteBPE.of(byte_bpe.model_json(byte_bpe.read_ranks(byte_bpe.VOCABULARY)), byte_bpe.PATTERN)
    assert all(bpe.encode([r["text"]])[0].tolist() == list(r["ids"]) and r["n_tokens"] == len(r["ids"]) for r in got.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_and_survive_edges(spark, docs, no_docs, empty):
    frame = no_docs if empty else docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            frame = out
        assert (out.count() == 0) == empty
    if not empty:
        rows = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).where("doc_id is not null").groupBy("doc_id", "text").count()
        assert rows.where("count > 1").count() == 0
        assert rows.where("doc_id = 17").count() == 2                    # two texts under one id, neither like any other


def test_documents_that_share_an_id_are_judged_apart(spark):
    """A copy goes, another text under its id stays; of equal rows one stays."""
    rng = random.Random(8)
    one, two, three = (" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(2, 9) for _ in range(60)) for _ in range(3))
    near = one.rsplit(" ", 1)[0] + " end"
    rows = [(5, one), (9, near), (9, two), (9, two), (3, three), (7, three), (3, three), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(4)
    out = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(5, one), (9, two), (3, three), (None, one), (None, one)], key=repr)


def test_the_rest_works_without_the_subpackage():
    import ast
    from pathlib import Path
    root = Path(corpus_pipeline.__file__).parent
    for path in [p for p in (root / "farebox").rglob("*.py") if "llm" not in p.parts]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
