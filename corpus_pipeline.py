"""The corpus pipeline: five stages, each on all that the one before kept, each written as Parquet and read again.

toxicity     documents of toxicity 0.7 or more go
near_copies  of each group of texts linked by five-word shingle similarity of 0.8 or more, one document stays: the one
             of least doc_id (null last) and text
benchmark    documents in which a window of a benchmark item occurs go
secrets      spans of secrets are replaced by a mask; n_chars, where there is one, follows
tokens       texts become token ids and are decoded again: doc_id, n_tokens, ids, ids_sha256, decoded_sha256

Stages keep nulls: a null or empty text is not toxic, is a copy of other empty texts, holds no window and no secret, and
has no ids. Other columns go along, whatever their names. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, secret_scan, similarity, toxicity
from loomgraph.llm.common import fresh, materialize, text_or_empty


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.with_toxicity(docs, toxicity.learned(spark, sf_dir))
    return scored.filter(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = similarity.near_copies(docs)
    least = F.min(F.struct(F.col("copy_id").isNull().alias("unnamed"), "copy_id", "node")).alias("least")
    node, kept_node, kept_id = fresh(docs, "node"), fresh(docs, "kept_node"), fresh(docs, "kept_id")
    kept = found.groupBy("root").agg(least).select(F.col("least.node").alias(kept_node), F.col("least.copy_id").alias(kept_id))
    rows = docs.withColumn(node, F.unhex(F.md5(text_or_empty("text"))))
    chosen = rows.join(kept, (F.col(node) == F.col(kept_node)) & F.col("doc_id").eqNullSafe(F.col(kept_id)))
    return chosen.dropDuplicates([node]).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key, hit_id, hit_key = fresh(docs, "text_key"), fresh(docs, "hit_id"), fresh(docs, "hit_key")
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct()
    rows = docs.withColumn(key, F.xxhash64("doc_id", text_or_empty("text")))
    left = rows.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key)), "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(docs)
    masked = found.select("record", F.when(F.col("record.text").isNotNull(), secret_scan.redact()).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked") != F.col("record.text"), F.length("masked")).otherwise(F.col("record.n_chars"))
    columns = (new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"record.`{c}`") for c in docs.columns)
    return masked.select(*(column.alias(c) for column, c in zip(columns, docs.columns, strict=True)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(docs, bpe.default_tokenizer())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: The learned stages have no SQL form; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
