"""Benchmark decontamination by winnowing.

Of every run of W consecutive K-word grams (W + K - 1 = 10 words) the smallest hash is kept as a fingerprint, of
documents and of benchmark items alike, so any shared span of 10 words shares a fingerprint. Equal fingerprints are
joined, and each hit is extended word by word: 10 or more equal words in a row are a hit window. An item of fewer
than 10 words is one window and is looked up by the hash of all its words.

The benchmark goes to the executors in blocks whose size is checked (`block_bytes` of text each); one block is one
scan of the documents without a shuffle, and several blocks' results are merged by document.

Null and empty texts have no words and no hits; an item without words occurs nowhere; a null item_id is listed as an
empty string; repeated rows each get their own result row; no benchmark or no documents give no hits or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bound_batches, chunks, grams, mix, slid_min, spans_hash, text_or_empty

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Text of a block of items. Its index takes some four times as much, on the driver while it is sent and in each worker.
BLOCK_BYTES = 8 << 20


def winnowed(hashes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the fingerprints and their gram hashes, for rows of at least WINDOW words."""
    n = len(hashes)
    starts, found = grams(hashes, left, K)
    all_grams = np.full(n, np.uint64(2**64 - 1))
    all_grams[starts] = found
    least = slid_min(all_grams, W)
    whole = np.flatnonzero(left[: len(least)] >= WINDOW)
    kept = np.zeros(n, bool)
    for o in range(W):
        kept[whole[all_grams[whole + o] == least[whole]] + o] = True
    at = np.flatnonzero(kept)
    return at, all_grams[at]


class Index:
    """A block of benchmark items: word hashes, and fingerprints sorted for lookup.

    Places of one fingerprint whose surroundings, as far as a hit is extended, are the same words are looked at once: one
    of them stands for all, and lists the items in which they are. So a header that very many items share costs a document
    that repeats it no more than one item's does."""

    def __init__(self, ids: list[str], texts: list[str]):
        hashes, left, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in chunks(pa.array(texts, pa.string())):
            words = Words(part, lower=True)
            hashes.append(words.hashes())
            left.append(words.left())
            row.append(words.row + part.first)
        small = lambda parts: np.concatenate(parts).astype(np.int32)
        self.ids, self.hashes, self.left, self.row = ids, np.concatenate(hashes), small(left), small(row)
        counts = np.bincount(self.row, minlength=len(ids))
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        self.place = (np.arange(len(self.row)) - first[self.row]).astype(np.int32)
        standing: list[tuple[np.ndarray, np.ndarray]] = []
        self.prints = {WINDOW: self.ordered(*winnowed(self.hashes, self.left), WINDOW, standing)}
        for n in sorted({int(c) for c in counts if 0 < c < WINDOW}):
            at = first[:-1][counts == n]
            self.prints[n] = self.ordered(*self.exact(at, n), n, standing)
        # Items of the places that stand for others: places in order, where each one's items begin, and the items.
        place, item = (np.concatenate(x) for x in zip(*standing, strict=True))
        order = np.lexsort((item, place))
        place, item = place[order], item[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
        self.items = item[new]
        self.standing, starts = np.unique(place[new], return_index=True)
        self.item_edges = np.append(starts, len(self.items)).astype(np.int32)

    def exact(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        starts, found = grams(self.hashes, self.left, n)
        return at, found[np.searchsorted(starts, at)]

    def ordered(self, at: np.ndarray, found: np.ndarray, n: int, standing: list) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order and the places that stand for each; adds which place stands for which item."""
        before = np.minimum(self.place[at], W - 1) if n == WINDOW else np.zeros(len(at), np.int64)
        after = np.minimum(self.left[at], WINDOW) if n == WINDOW else np.full(len(at), n)
        around = mix(spans_hash(self.hashes, at - before, at + after) + (before * WINDOW * 2 + after).astype(np.uint64))
        order = np.lexsort((at, around, found))
        at, found, around = at[order], found[order], around[order]
        new = np.ones(len(at), bool)
        new[1:] = (found[1:] != found[:-1]) | (around[1:] != around[:-1])
        first = np.flatnonzero(new)
        standing.append((at[first][np.cumsum(new) - 1].astype(np.int32), self.row[at]))
        return found[first], at[first].astype(np.int32)

    def joined(self, n: int, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document word, item word) with equal fingerprints."""
        keys, places = self.prints[n]
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        many = hi - lo
        some = many > 0
        at, lo, many = at[some], lo[some], many[some]
        ends = np.cumsum(many)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        return np.repeat(at, many), places[np.repeat(lo, many) + within]

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item place, first word and end word of each extended hit."""
        hashes, left, place = words.hashes(), words.left(), words.place()
        out = []
        for n in self.prints:
            k = K if n == WINDOW else n
            at, found = winnowed(hashes, left) if n == WINDOW else grams(hashes, left, n)
            p, q = self.joined(n, at, found)
            same = np.ones(len(p), bool)
            for o in range(k):
                same &= hashes[p + o] == self.hashes[q + o]
            p, q = p[same], q[same]
            before, after = np.zeros(len(p), np.int64), np.full(len(p), k)
            if n == WINDOW:
                for reach in range(1, W):
                    on = np.flatnonzero((before == reach - 1) & (place[p] >= reach) & (self.place[q] >= reach))
                    before[on[hashes[p[on] - reach] == self.hashes[q[on] - reach]]] += 1
                for reach in range(K, WINDOW):
                    on = np.flatnonzero((after == reach) & (left[p] > reach) & (self.left[q] > reach))
                    after[on[hashes[p[on] + reach] == self.hashes[q[on] + reach]]] += 1
            long = before + after >= n
            out.append((q[long], (p - before)[long], (p + after)[long]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def names(self, places: np.ndarray) -> list[str]:
        """Ids of the items that some places stand for."""
        at = np.searchsorted(self.standing, np.unique(places))
        found = [self.items[a:b] for a, b in zip(self.item_edges[at], self.item_edges[at + 1], strict=True)]
        return [self.ids[i] for i in np.unique(np.concatenate(found))]


def _scanner(shared):
    def scan(batches):
        index = shared.value
        for batch in batches:
            for part in chunks(batch.column(1)):
                words = Words(part, lower=True)
                item, start, end = index.hits(words)
                row = words.row[start] if len(start) else start
                order = np.lexsort((end, start, row))
                item, start, end, row = item[order], start[order], end[order], row[order]
                edges = np.searchsorted(row, np.arange(len(part) + 1))
                items, runs = [], []
                for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if a == b:
                        items.append([])
                        runs.append([])
                        continue
                    items.append(index.names(item[a:b]))
                    reach = np.maximum.accumulate(end[a:b])
                    cut = np.concatenate([[0], np.flatnonzero(start[a + 1 : b] > reach[:-1]) + 1, [b - a]])
                    base = words.edges[r]
                    runs.append([{"start": int(start[a + s] - base), "end": int(reach[e - 1] - base)} for s, e in zip(cut[:-1], cut[1:], strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), batch.column(2).slice(part.first, len(part)), pa.array(words.counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "text_key", "n_words", "items", "runs"],
                )

    return scan


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about block_bytes of text, by a hash of id and text."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), text_or_empty(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text_key (hash of id and text), n_words, n_hit, items (distinct ids, sorted as strings), runs (hit word spans)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("doc_id", "text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    scanned = []
    for block in blocks_of(benchmark, item_id, item_text, block_bytes):
        got = block.collect()
        shared = spark.sparkContext.broadcast(Index([r["item_id"] for r in got], [r["text"] for r in got]))
        scanned.append(rows.mapInArrow(_scanner(shared), schema))
    out = scanned[0]
    if len(scanned) > 1:
        for more in scanned[1:]:
            out = out.unionByName(more)
        out = out.groupBy("doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"), F.count("*").alias("rows"))
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1), (F.col("rows") / len(scanned)).cast("long"))))
    hit = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto")),
        lambda a, r: F.struct((a["hit"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], a["upto"]))).alias("hit"), F.greatest(a["upto"], r["end"]).alias("upto")),
        lambda a: a["hit"],
    )
    return out.select("doc_id", "text_key", "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "runs")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
