"""Removal of repeated passages: every 50-word window that a document with a smaller doc_id also has.

1. Windows are grouped into runs that share a minimiser, the least hash of their 25-word grams; equal windows have
   equal minimisers. Each partition counts the documents of its minimisers in a sparse count-min sketch (DEPTH rows of
   2**WIDTH cells); the sketches are merged by adding cells. Cells of two or more documents become a bitmap, whose
   size follows their number up to 2**MOST_BITS bits for each row of the sketch; that bound is what gets broadcast.
2. A second scan keeps the runs whose minimiser is estimated to occur in two documents or more. An estimate is never
   too small, so none is lost; a false one costs time only.
3. The kept runs are grouped exactly: first whole runs (equal copies fall together before anything is expanded), then
   the windows of distinct runs that share a minimiser. A window goes if its group has a smaller doc_id.

Keys are 128 bits: minimiser and window hash. A null doc_id has no order: such rows keep all words and serve as no
one's source. Null and empty texts have no words; texts under 50 words keep all; rows with one doc_id are no source
for each other; repeated rows get the same result each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bitmap_of, bound_batches, chunks, each_salt, grams, has_bit, materialize, mix, salt, salts_seen, slid_min, spans_hash, text_or_empty

WINDOW, GRAM, DEPTH, WIDTH, MOST_BITS, LONGEST_RUN = 50, 25, 2, 32, 30, 64


def runs_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one row with one minimiser: minimiser, first window, number of windows; and word hashes."""
    hashes, left = words.hashes(), words.left()
    starts, found = grams(hashes, left, gram)
    all_grams = np.full(len(words), np.uint64(2**64 - 1))
    all_grams[starts] = found
    least = slid_min(all_grams, window - gram + 1)
    whole = np.flatnonzero(left[: len(least)] >= window)
    value = least[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (value[1:] != value[:-1]) | (np.diff(whole) != 1) | (words.row[whole[1:]] != words.row[whole[:-1]])
    since = np.arange(len(whole)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= since % LONGEST_RUN == 0
    first = np.flatnonzero(new)
    return value[first], whole[first], np.diff([*first, len(whole)]), hashes


def cells(minimisers: np.ndarray, depth: int) -> np.ndarray:
    return mix(minimisers + np.uint64(depth + 1)) >> np.uint64(64 - WIDTH)


def _sketcher(window: int, gram: int):
    def sketch(batches):
        seen = []
        for batch in batches:
            for part in chunks(batch.column(0)):
                words = Words(part, lower=False)
                minimiser, at, _, _ = runs_of(words, window, gram)
                row = words.row[at] if len(at) else at
                order = np.lexsort((minimiser, row))
                minimiser, row = minimiser[order], row[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (minimiser[1:] != minimiser[:-1]) | (row[1:] != row[:-1])
                seen.append(minimiser[keep])
        if seen:
            all_seen = np.concatenate(seen)
            for d in range(DEPTH):
                cell, n = np.unique(cells(all_seen, d), return_counts=True)
                for a in range(0, len(cell), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array((cell[a : a + 100_000] | np.uint64(d << WIDTH)).astype(np.int64)), pa.array(np.minimum(n[a : a + 100_000], 2).astype(np.int32))], names=["cell", "n"])

    return sketch


def repeated_cells(rows: DataFrame, window: int, gram: int) -> tuple[np.ndarray, int]:
    """Bitmap of sketch cells of two or more documents, DEPTH rows of 2**bits bits each; and bits."""
    merged = rows.select("text").mapInArrow(_sketcher(window, gram), "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2").select("cell")
    merged = materialize(merged, "cells")
    count = merged.count()
    bits = min(MOST_BITS, max(20, int(16 * count).bit_length()))
    cell = F.col("cell")
    position = F.shiftright(cell.bitwiseAND(F.lit((1 << WIDTH) - 1)), WIDTH - bits) + F.shiftleft(F.shiftright(cell, WIDTH), bits)
    return bitmap_of(merged.select(position.alias("position")), "position", DEPTH << bits), bits


def _picker(shared, window: int, gram: int):
    def pick(batches):
        bitmap, bits = shared.value
        for batch in batches:
            for part in chunks(batch.column(2)):
                words = Words(part, lower=False)
                minimiser, at, n, hashes = runs_of(words, window, gram)
                twice = np.ones(len(at), bool)
                for d in range(DEPTH):
                    position = (cells(minimiser, d) >> np.uint64(WIDTH - bits)).astype(np.int64) + (d << bits)
                    twice &= has_bit(bitmap, position)
                minimiser, at, n = minimiser[twice], at[twice], n[twice]
                if not len(at):
                    continue
                whole = spans_hash(hashes, at, at + n + window - 1)
                edges = np.concatenate([[0], np.cumsum(n)])
                each = np.arange(edges[-1]) - np.repeat(edges[:-1] - at, n)
                windows = spans_hash(hashes, each, each + window)
                row = pa.array(words.row[at] + part.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(minimiser.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(words.place()[at]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(windows.view(np.int64)))],
                    names=["doc_id", "text_key", "minimiser", "run", "start", "n", "windows"],
                )

    return pick


def repeated_windows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Spans of windows to remove: doc_id, text_key, start, n and offsets (null: all n windows from start on)."""
    spark = rows.sparkSession
    rows = rows.filter("doc_id is not null")
    shared = spark.sparkContext.broadcast(repeated_cells(rows, window, gram))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_key"], *(T.StructField(c, T.LongType()) for c in ("minimiser", "run", "start")), T.StructField("n", T.IntegerType()), T.StructField("windows", T.ArrayType(T.LongType()))])
    runs = materialize(rows.select("doc_id", "text_key", "text").mapInArrow(_picker(shared, window, gram), schema), "runs")
    runs = runs.withColumn("salt", salt("doc_id", "start"))
    first = runs.groupBy("minimiser", "run").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.first("windows").alias("windows"), salts_seen().alias("seen"))
    first = materialize(first, "first_runs")
    # Runs of one minimiser, and windows of one hash, may be many: they too meet salt by salt, by the run.
    parted = first.withColumn("salt", salt("run"))
    shared_minimisers = parted.groupBy("minimiser").agg(F.count("*").alias("n"), salts_seen().alias("seen")).filter("n > 1").select("minimiser", each_salt("seen").alias("salt"))
    window_rows = parted.join(shared_minimisers, ["minimiser", "salt"], "left_semi").select("minimiser", "run", "salt", "source", F.posexplode("windows").alias("offset", "hash"))
    least = window_rows.groupBy("minimiser", "hash").agg(F.min("source").alias("least"), F.max("source").alias("most"), salts_seen().alias("seen")).filter("least < most")
    least = least.select("minimiser", "hash", "least", each_salt("seen").alias("salt"))
    found = window_rows.join(least, ["minimiser", "hash", "salt"]).filter("source > least").groupBy("minimiser", "run").agg(F.collect_list("offset").alias("offsets"))
    judged = first.select("minimiser", "run", "source", "last", "seen").join(found, ["minimiser", "run"], "left").filter("last > source or offsets is not null")
    # A run that stands in very many documents meets its occurrences salt by salt, in as many tasks.
    judged = judged.select("minimiser", "run", "source", "offsets", each_salt("seen").alias("salt"))
    joined = runs.select("doc_id", "text_key", "minimiser", "run", "salt", "start", "n").join(judged, ["minimiser", "run", "salt"])
    return joined.filter("doc_id > source or offsets is not null").select("doc_id", "text_key", "start", "n", F.when(F.col("doc_id") <= F.col("source"), F.col("offsets")).alias("offsets"))


def _remover(window: int):
    def remove(batches):
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, found in zip(texts, spans, strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                keep = words
                if found:
                    change = np.zeros(len(words) + 1, np.int64)
                    for s in found:
                        if s["offsets"] is None:
                            change[s["start"]] += 1
                            change[s["start"] + s["n"] + window - 1] -= 1
                        else:
                            for o in s["offsets"]:
                                change[s["start"] + o] += 1
                                change[s["start"] + o + window] -= 1
                    keep = list(itertools.compress(words, np.cumsum(change[:-1]) == 0))
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                kept.append(b" ".join(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))
    spans = repeated_windows(rows, window, window // 2)
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "offsets")).alias("spans"))
    joined = rows.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_remover(window), schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
