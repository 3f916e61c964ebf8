import random

from pyspark.sql import functions as F

from farebox.llm import quality as Q
from farebox.llm.common import held_out
from farebox.llm.queries import op3_quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op3_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    right = {q: [r["predicted"] == q for r in rows if r["quality"] == q] for q in (0, 1)}
    assert min(sum(v) / len(v) for v in right.values()) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (17, 1), (9, 0), (10, None), (None, 0), (999, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    out = Q.score(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "score"] and out.count() == docs.count()
    scores = {(r["doc_id"], r["text"]): r["score"] for r in out.collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert scores[(6, None)] == scores[(7, "")] and scores[(1, scores and docs.where("doc_id = 1").first()["text"])] > scores[(9, "one two three")]
    assert Q.score(no_docs, model).count() == 0
    none = Q.fit(docs, labels.limit(0))
    assert {r["score"] for r in Q.score(docs, none).collect()} == {0.5}
    one = Q.fit(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.9 for r in Q.score(docs, one).collect())


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=30)) if i % 2 else "## " * 20 + str(i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = held_out(F.col("doc_id"), 3, 1)
    true = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = true.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, true, held), Q.fit(docs.withColumn("source", F.lit("s")), flipped, held)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def plain_buckets(text):
    """Bucket numbers of a text, kind by kind: words, word pairs, byte grams."""
    import re

    from farebox.llm.words import _MULT, PLAIN
    full, low = (1 << 64) - 1, (1 << 32) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    data = text.encode()
    words = [mix((sum(int(PLAIN[b]) * pow(_MULT, k, 1 << 64) for k, b in enumerate(w)) + len(w)) & full)
             for w in re.findall(rb"[^\x20\x09-\x0d]+", data)]
    pairs = [_MULT if a == b else mix((a * _MULT + b) & full) for a, b in zip(words, words[1:])]
    kinds = [[h >> (64 - Q.BUCKET_BITS) for h in words], [h >> (64 - Q.BUCKET_BITS) for h in pairs]]
    for n in Q.GRAMS:
        own = []
        for i in range(len(data) - n + 1):
            gram = int(Q._SHORT[data[i]])
            for b in data[i + 1:i + n]:
                gram = (gram * int(Q._GRAM) + int(Q._SHORT[b])) & low
            own.append(((gram ^ (gram >> 15)) * 0x85EBCA6B & low) >> (32 - Q.BUCKET_BITS))
        kinds.append(own)
    return kinds


def test_scores_equal_a_plain_forward_pass(spark, docs):
    import math
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    model = Q.fit(docs, labels)
    texts = ["one two two three", "", None, "über the the river 日本", "a", "ab", " \t ", "word " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in Q.score(rows, model).collect()}
    for i, text in enumerate(texts):
        kinds = plain_buckets(text or "")
        total = sum(sum(float(model.weights[b]) for b in own) / max(len(own), 1) for own in kinds) / Q.KINDS
        assert abs(got[i] - 1 / (1 + math.exp(-(total + model.bias)))) < 1e-6


def test_rows_that_repeat_an_id_are_one_sample(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    many = docs.select("doc_id", "text").unionByName(
        spark.range(10000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("zz text "), F.col("id")).alias("text")))
    one, two = Q.fit(many.repartition(3), labels), Q.fit(many.orderBy("text").repartition(8), labels)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_driver_gives_the_sample_back(spark, monkeypatch):
    """Once the model is fitted, the driver returns the sample's memory."""
    given, whole = [], Q.train
    monkeypatch.setattr(Q, "train", lambda rows: given.append("train") or whole(rows))
    monkeypatch.setattr(Q, "release_memory", lambda: given.append("release"))
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(8)], "doc_id long, text string")
    Q.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    assert given == ["train", "release"]
