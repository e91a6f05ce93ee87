"""Sharding by a two-pass external shuffle.

Pass one scatters records by a seeded hash of all their columns into buckets that fit in memory (bucket_bytes on
average, more once MOST_BUCKETS are not enough); each bucket is one partition. Pass two puts each bucket in a fixed
order, so that a retried task repeats itself, permutes it by Fisher and Yates (Spark's `shuffle`, seeded by seed and
bucket) and writes it. The buckets in order are the whole shuffle, cut into `shards` runs of records whose lengths differ
by one at most (law "rows"): a bucket goes to one shard or a few, with no further exchange. The buckets' offsets, one row
of 16 bytes each and at most MOST_BUCKETS of them, are broadcast. The same rows and seed give the same result however
they are stored.

Records that are equal in every column have one hash. Where they are so many that they fill a good part of a bucket
(fewer groups than SPLIT * buckets can be), only one of them and their number go over the exchange; they are numbered
when they are made again, and the number is mixed into the bucket's hash, so that they spread like all others.

Equal texts need not meet. Null doc_id and text are kept (text: no bytes, size 16); an empty table gives no rows; more
columns go along as they are (`shard` and `slot` are replaced).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_or_empty

SHARDS, SEED, BUCKET_BYTES, MOST_BUCKETS = 40, 20240607, 24 << 20, 1 << 20
#: A group of equal records larger than 1 / SPLIT of a bucket is sent as one record; COPIES_AT_ONCE of it are made by one task.
SPLIT, COPIES_AT_ONCE = 8, 10_000


def as_hashable(column: str, kind: str) -> Column:
    """The column, or its JSON where Spark has no hash of its type."""
    return F.to_json(F.struct(F.col(f"`{column}`"))) if any(k in kind for k in ("map<", "variant")) else F.col(f"`{column}`")


def record_bytes(dtypes: list[tuple[str, str]]) -> Column:
    """About the bytes of a record: those of its texts, of nested columns as JSON, and 16 for each column."""
    sizes = []
    for name, kind in dtypes:
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)))
        elif any(k in kind for k in ("<", "variant")):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)))
    return sum(sizes, F.lit(16 * len(dtypes) + 32).cast("long"))


def with_copies(scattered: DataFrame, row_limit: int) -> DataFrame:
    """order, record and copy: 0, or from 0 up in groups of more than row_limit equal records."""
    counts = scattered.groupBy("order").agg(F.count("*").alias("n")).filter(F.col("n") > row_limit).select("order")
    plain = scattered.join(F.broadcast(counts), "order", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    crowd = scattered.join(F.broadcast(counts), "order", "left_semi").withColumn("content", F.sha2(F.to_json("record"), 256))
    crowd = crowd.groupBy("order", "content").agg(F.first("record").alias("record"), F.count("*").alias("n"))
    pieces = crowd.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES_AT_ONCE).cast("long")))).repartition("order", "content", "at")
    copies = pieces.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("at") + COPIES_AT_ONCE, "n") - 1)))
    return plain.select("order", "record", "copy").unionByName(copies.select("order", "record", "copy"))


def shard_and_slot(place: Column, n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place below n: runs of n div shards + 1 records, then of n div shards."""
    least, longer = divmod(n, shards)
    edge = longer * (least + 1)
    after = place - edge
    shard = F.when(place < edge, F.floor(place / (least + 1))).otherwise(longer + F.floor(after / max(1, least)))
    slot = F.when(place < edge, place % (least + 1)).otherwise(after % max(1, least))
    return shard.cast("int"), slot.cast("long")


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard and slot; each partition is a bucket, in order of shard and slot."""
    docs = docs.drop("shard", "slot")
    size = record_bytes(docs.dtypes)
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    record = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    scattered = docs.select(F.xxhash64(F.lit(seed), *(as_hashable(*c) for c in docs.dtypes)).alias("order"), record.alias("record"))
    scattered = with_copies(scattered, max(1, n // (SPLIT * buckets)))
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "order", "copy"), F.lit(buckets)).cast("int"))
    offsets = scattered.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("offset"))
    gathered = scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "order", "copy").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    permuted = gathered.select("bucket", F.shuffle("records", seed).alias("records"))
    placed = permuted.join(F.broadcast(offsets), "bucket").select("offset", F.posexplode("records").alias("at", "record"))
    shard, slot = shard_and_slot(F.col("offset") + F.col("at"), n, shards)
    return placed.select("record.*", shard.alias("shard"), slot.alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write one folder for each shard, shard=0 and so on; its files by name, each a bucket's run in slot order, are the shard."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def op9_shuffle(spark, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = write_shards(shuffled, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    text = text_or_empty("text").cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
