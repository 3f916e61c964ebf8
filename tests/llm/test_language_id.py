from pyspark.sql import functions as F

from farebox.llm import language_id as I
from farebox.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op10_language_id(spark, folder).join(lang, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95


def test_edges(spark, docs, no_docs):
    two = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 5 == 0, None).otherwise("yy"))
    network = I.fit(two)
    assert network.languages == ["xx", "yy"]
    odd = spark.createDataFrame([(900, "123 !? 456"), (901, "x")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in I.predict(docs.select("doc_id", "text").unionByName(odd), network).where("doc_id is not null").collect()}
    assert [out[i]["lang_pred"] for i in (6, 7, 8, 900)] == ["und"] * 4 and out[900]["score"] == 0
    assert out[901]["lang_pred"] in ("xx", "yy") and all(0 <= r["score"] <= 1 for r in out.values())
    assert I.predict(docs, network).count() == docs.count() and I.predict(no_docs, network).count() == 0
    assert I.fit(no_docs) is None
    assert {r["lang_pred"] for r in I.predict(docs, None).collect()} == {"und"}


def test_windows_hold_the_whole_text():
    import numpy as np
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    rows, doc, size = I.windows_of(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    assert doc.tolist() == [1, 2, 2, 3] and size.tolist() == [256, 256, 1, 1]
    for i, t in enumerate(texts):
        assert b"".join(r[:n].tobytes() for r, d, n in zip(rows, doc, size) if d == i) == t


def plain_probabilities(network, data):
    """One window, byte by byte: embed, slide each filter, rectify, pool, softmax."""
    import math
    data = data.ljust(I.LENGTH, b"\0")
    wide, pooled = max(I.WIDTHS), []
    for f in range(network.filters.shape[1]):
        best = None
        for at in range(I.LENGTH - wide + 1):
            total = sum(float(network.vectors[data[at + k]][v]) * float(network.filters[k * I.VECTOR + v][f])
                        for k in range(wide) for v in range(I.VECTOR) if network.filters[k * I.VECTOR + v][f])
            best = total if best is None else max(best, total)
        pooled.append(max(0.0, best + float(network.offset[f])))
    logits = [sum(p * float(network.output[f][c]) for f, p in enumerate(pooled)) + float(network.bias[c]) for c in range(len(network.languages))]
    top = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(top) for x in top]


def test_prediction_equals_a_plain_forward_pass(spark, docs):
    two = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    network = I.fit(two)
    texts = ["one two", "über naïve 日本 " * 30, "x" * 700, "the river, the stone; sky"]
    got = {r["doc_id"]: r for r in I.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).collect()}
    for i, text in enumerate(texts):
        data, mean = text.encode(), [0.0, 0.0]
        for at in range(0, len(data), I.LENGTH):
            part = data[at:at + I.LENGTH]
            mean = [m + p * len(part) / len(data) for m, p in zip(mean, plain_probabilities(network, part))]
        best = max(range(2), key=lambda c: mean[c])
        assert got[i]["lang_pred"] == network.languages[best] and abs(got[i]["score"] - mean[best]) < 1e-4


def test_rows_that_repeat_an_id_are_one_sample(spark, docs):
    import numpy as np
    few = docs.select("doc_id", "text").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    many = few.unionByName(spark.range(10000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("zz text "), F.col("id")).alias("text"), F.lit("xx").alias("lang")))
    one, two = I.fit(many.repartition(3)), I.fit(many.orderBy("text").repartition(8))
    assert all(np.array_equal(a, b) for a, b in zip(list(vars(one).values())[1:], list(vars(two).values())[1:]))
