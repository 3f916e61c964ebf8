import random

import pytest
from pyspark.sql import functions as F

WORDS = ["the", "of", "and", "river", "stone", "über", "naïve", "日本", "x1", "Tree", "cloud", "9", "it's", "a-b", "sky", "blue"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, repeated ids, a long text."""
    rng = random.Random(4)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1:]]) for k in (10, 60, 100)]
    passage = prose(rng, 60)
    rows = [(1, base), (2, base), (3, near[0]), (4, near[1]), (5, near[2]),
            (6, None), (7, ""), (8, " \t\n "), (9, "one two three"), (10, "One two three"), (11, "the " * 200),
            (12, prose(rng, 30) + " " + passage), (13, passage + "\n" + prose(rng, 40)), (14, prose(rng, 20000)),
            (15, "half a surrogate \U0001f600‍ end"), (16, passage.upper()),
            (17, prose(rng, 50)), (17, prose(rng, 50)), (18, base), (18, base), (None, base), (None, None), (-5, "below zero " * 30)]
    rows += [(100 + i, prose(rng, rng.randint(1, 80))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with extra columns that clash with names the operators use."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return (frame.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
            .withColumn("n_chars", F.length("text").cast("long")).withColumn("row", F.lit(1))
            .withColumn("key", F.lit("k")).withColumn("base", F.lit(2.0)).withColumn("spans", F.array(F.lit(1)))
            .withColumn("ids", F.lit("x")).withColumn("score", F.lit("high")).withColumn("bucket", F.lit(0)))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id = 123456789")
