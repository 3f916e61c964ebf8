"""From raw documents to token ids in five stages.

Quality classifier, near-duplicates, benchmark decontamination, secret scans,
byte-level BPE. Each stage is a function of (spark, docs, sf_dir); run() writes
each result as Parquet to the shared checkpoint folder and reads it back as the
next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox.llm import byte_bpe, decontaminate, near_dedup, quality, secret_scan
from farebox.llm.common import documents, held_out, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 3, 1))
    scores = quality.score(docs, model, "_score")
    return scores.where("_score >= 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates.

    Rows that share a doc_id but not their text are documents of their own, and
    each goes only with its own group; equal rows are one document. Of rows that
    differ in other columns only, the first by their JSON stays. Rows without a doc_id stay.
    """
    node = F.xxhash64("doc_id", "text")
    whole = docs.select(node.alias("node"), F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = whole.where("id is not null").select("node", "id", F.col("row.text").alias("text"))
    found = near_dedup.near_duplicates(named.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "component_id").distinct()
    kept = (named.select("node", "id").distinct().join(found, "node").groupBy("component_id")
            .agg(F.min(F.struct("id", "node")).alias("first")).select(F.col("first.node").alias("node")))
    order = Window.partitionBy("node").orderBy(F.to_json("row"))
    one = whole.where("id is not null").join(kept, "node", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return (one.select("row").unionByName(whole.where("id is null").select("row"))
            .select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    model, runs = secret_scan.models(docs)
    clean = secret_scan.redact(docs, model, runs=runs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    return byte_bpe.encode(docs, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level bpe", tokens_stage),
]

#: No SQL: the first stage is a trained classifier. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
