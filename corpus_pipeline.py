"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

toxicity drops documents that the classifier (learned on the labels of the table itself, outside the
held-out fold) scores 0.3 or more; near_duplicates keeps the least id of each group of texts that are
linked by a Jaccard similarity of 0.8 or more over their 5-word shingles, found by SimHash;
decontamination drops contaminated documents; secrets replaces every secret found and keeps the document;
packing gives the pieces of sequences of 2048 tokens.

Decisions are about rows, named by their id and a digest of their text: a row whose id is null, or is that
of a row with another text, is judged like any other. Of rows that repeat both, near_duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import decontam, packing, secrets, simhash, toxicity
from winnow.llm.common import materialize, table

#: Lists of at most so many rows are broadcast (some 10 MB); longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`: the id (in order; null last) and a digest of the text. Null texts count as empty."""
    name = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~"))
    return docs.withColumn("_row", F.concat_ws(":", name, F.hex(F.xxhash64(F.coalesce("text", F.lit(""))))))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those whose `_row` is in the column doc_id of rows."""
    listed = materialize(rows.select(F.col("doc_id").alias("_row")).distinct(), "rows", slim=True)
    return docs.join(F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed, "_row", "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), sample=20_000)
    return toxicity.with_score(docs, model, score_col="_toxicity").where(F.col("_toxicity") < 0.3).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = materialize(simhash.near_texts(rows, similarity=0.8, shingle=5, id_col="_row"), "components")
    kept = without(rows, found.where("doc_id <> component_id"))
    repeated = materialize(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated", slim=True)
    if not repeated.isEmpty():
        once = kept.join(repeated.withColumnRenamed("doc_id", "_row"), "_row", "left_semi").dropDuplicates(["_row"])
        kept = without(kept, repeated).unionByName(once)
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(rows, found.where("contaminated")).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, max_len=2048, end_id=1, keep_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier, XXH64 fingerprints and the tokenizer are out of its reach. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
