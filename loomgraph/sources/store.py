"""A store of chunks with vectors, their keyword side, and a graph, kept up to date batch by batch.

Under a path lie `chunks` (doc_id, chunk_id, content, embedding, id), `index` (doc_id, chunk_id, term, tf, dl) and, where
batches bring a graph, `entities` and `relations`; each by `bucket`, a hash of doc_id or id. A change rewrites the buckets
of the rows it touches and leaves all others as they are:

1. What the touched buckets will hold is written under `pending/{batch}`, the last of it being `done`.
2. Each side's touched buckets are replaced from there, by dynamic partition overwrite.
3. The batch is written to `ledger`.

A batch that is in the ledger is left alone when it comes again. One that failed in step 1 is made anew; one that failed
later, even between two sides, is finished from what is pending, before any other batch is looked at, so that no change
is lost or made twice. One batch at a time, as foreachBatch gives them. Buckets a batch touches are a list of their
numbers, at most `buckets`."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators.operations import upsert
from ..operators.retrieval import tokens
from ..tables import discard, written

BUCKETS = 64
#: Sides of a store and the column whose hash is their bucket.
SIDES = {"chunks": "doc_id", "index": "doc_id", "entities": "id", "relations": "id"}


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_side(spark: SparkSession, path: str, side: str) -> DataFrame | None:
    """The rows of a side; a bucket left empty holds one row of nulls, which is not one of them."""
    found = read_or_none(spark, f"{path}/{side}")
    return found if found is None else found.filter(F.col(SIDES[side]).isNotNull())


def chunk_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    rows = chunks.join(vectors.select("doc_id", "chunk_id", "embedding"), ["doc_id", "chunk_id"], "left")
    return rows.withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")))


def index_rows(chunks: DataFrame) -> DataFrame:
    words = chunks.select("doc_id", "chunk_id", tokens(F.col("content")).alias("words"))
    return words.select("doc_id", "chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc_id", "chunk_id", "term", "dl").agg(F.count("*").alias("tf"))


class Change:
    """What a batch does to one side: keys whose rows go, rows that come, and how they meet rows that stay."""

    def __init__(self, gone: DataFrame, new: DataFrame | None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        self.gone, self.new, self.merge = gone, new, merge


def _pend(spark: SparkSession, path: str, at: str, side: str, change: Change, buckets: int) -> None:
    """Write what the side's touched buckets will hold."""
    key = SIDES[side]
    keys = change.gone.select(key) if change.new is None else change.gone.select(key).unionByName(change.new.select(key))
    touched = [r[0] for r in keys.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]
    old = read_side(spark, path, side)
    stays = None if old is None else old.filter(F.col("bucket").isin(touched)).drop("bucket")
    if change.merge is not None and stays is not None:
        rows = change.merge(stays, change.new)
    else:
        left = None if stays is None else stays.join(change.gone.select(key).distinct(), key, "left_anti")
        parts = [p for p in (left, change.new) if p is not None]
        if not parts:
            return
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    rows = written(rows.withColumn("bucket", bucket_of(key, buckets)), f"{side}-rows")
    # A bucket without rows would not be replaced: it gets a row of nulls.
    bare = spark.createDataFrame([(b,) for b in touched], "bucket int").join(rows.select("bucket").distinct(), "bucket", "left_anti")
    rows.unionByName(bare, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{side}")


def _apply(spark: SparkSession, path: str, at: str, batch_id: str) -> None:
    """Replace the buckets that are pending, note the batch and drop what was pending; may be repeated up to the note."""
    for side in SIDES:
        rows = read_or_none(spark, f"{at}/{side}")
        if rows is not None:
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{side}")
    spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    discard(spark, at)


def change(spark: SparkSession, path: str, batch_id: str, changes: Callable[[], dict[str, Change]], buckets: int = BUCKETS) -> bool:
    """Make a batch's changes, by side, unless the ledger has it; finishes a batch left pending first. Whether it was made."""
    ledger = read_or_none(spark, f"{path}/ledger")
    made = set() if ledger is None else {r[0] for r in ledger.join(spark.createDataFrame([(batch_id,)], "batch_id string"), "batch_id", "left_semi").collect()}
    started = read_or_none(spark, f"{path}/pending/started")
    if started is not None:
        # Batches come one by one: the last one started is the only one that can be unfinished.
        last = started.agg(F.max_by("batch_id", "number").alias("b"), F.max("number").alias("n")).first()
        at = f"{path}/pending/{last['b']}"
        noted = ledger is not None and not ledger.filter(F.col("batch_id") == last["b"]).isEmpty()
        if not noted and read_or_none(spark, f"{at}/done") is not None:
            _apply(spark, path, at, last["b"])
            made.add(last["b"])
    if batch_id in made:
        return False
    number = 0 if started is None else last["n"] + 1
    at = f"{path}/pending/{batch_id}"
    spark.createDataFrame([(batch_id, number)], "batch_id string, number long").coalesce(1).write.mode("append").parquet(f"{path}/pending/started")
    for side, one in changes().items():
        _pend(spark, path, at, side, one, buckets)
    spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{at}/done")
    _apply(spark, path, at, batch_id)
    return True


def write_chunks(chunks: DataFrame, vectors: DataFrame, path: str, batch_id: str, buckets: int = BUCKETS) -> bool:
    """Chunks (doc_id, chunk_id, content) with their vectors and postings; documents that are there are replaced."""
    ids = chunks.select("doc_id").distinct()
    return change(chunks.sparkSession, path, batch_id, lambda: {"chunks": Change(ids, chunk_rows(chunks, vectors)), "index": Change(ids, index_rows(chunks))}, buckets)


def delete_documents(spark: SparkSession, path: str, ids: DataFrame, batch_id: str, buckets: int = BUCKETS) -> bool:
    """Take the documents of ids (column doc_id) out of both sides; only their buckets are read and written."""
    return change(spark, path, batch_id, lambda: {side: Change(ids, None) for side in ("chunks", "index")}, buckets)


def maintain(batch: DataFrame, batch_id: str, path: str, vector: Callable[[Column], Column], size: int = 512, graph: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, buckets: int = BUCKETS) -> bool:
    """Take in a batch of documents (doc_id, text): chunks, vectors and postings, instead of those that a document has.

    vector: a chunk's embedding from its text. graph: entities and relations (with id) of a batch's chunks, which are
    merged into the stored ones. Of several rows of one doc_id in a batch the one of greatest text counts."""
    spark = batch.sparkSession

    def changes() -> dict[str, Change]:
        single = batch.groupBy("doc_id").agg(F.max("text").alias("text"))
        rows = written(single.select("doc_id", F.inline_outer(tx.fixed_chunks(F.col("text"), size))).select("doc_id", F.col("position").alias("chunk_id"), "content"), "chunks")
        ids, chunks = rows.select("doc_id").distinct(), rows.filter("chunk_id is not null")
        out = {"chunks": Change(ids, chunk_rows(chunks, chunks.select("doc_id", "chunk_id", vector(F.col("content")).alias("embedding")))), "index": Change(ids, index_rows(chunks))}
        if graph is not None:
            for side, found in zip(("entities", "relations"), graph(chunks), strict=True):
                new = written(found, side)
                merge = lambda stays, came: upsert(stays, came.withColumn("version", F.lit(1)))
                out[side] = Change(new.select("id").filter("false"), new, merge)
        return out

    return change(spark, path, batch_id, changes, buckets)


def maintained(documents: DataFrame, path: str, vector: Callable[[Column], Column], checkpoint: str, graph: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> StreamingQuery:
    """A stream of documents (doc_id, text) into the store at path; batches are named by the checkpoint and their number."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    step = lambda batch, number: maintain(batch, f"{name}-{number}", path, vector, graph=graph)
    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
