"""Near copies: an n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (fewer words: one shingle of all). Equal texts are one class from the start. Of
each text 288 MinHash values are taken; texts that agree in six consecutive ones (one of 48 bands) are candidates: of
pairs of similarity 0.8 fewer than one in two million is no candidate. Texts meet in groups of two kinds: a component of
candidates whole, or, where a component is large and would cost more than its bands do (a chain of texts that are not
alike), band by band, each pair at the least band that both have. Groups are cut into blocks, every two blocks meet in
one task, and there pairs are compared by 24 more MinHash values at a time. A pair goes as soon as, under a uniform
prior, the posterior probability that its similarity reaches the threshold is below TOLERANCE; all others are verified
on the exact shingle sets. Tasks return links counted by text and a spanning forest of them, never pairs, so that a
group of n near copies costs no n * n rows.

Null and empty texts have no shingles and no links, and are copies of each other; a null doc_id is a member but never
gives a class its id (a class of nulls only has a null id); repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bitmap_of, bound_batches, chunks, each_salt, has_bit, materialize, mix, salt, salts_seen, spans_hash, text_or_empty
from .components import components

SHINGLE, BANDS, ROWS, STEP, THRESHOLD, TOLERANCE, BLOCK, MOST_BITS = 5, 48, 6, 24, 0.8, 1e-6, 160, 30
HASHES = BANDS * ROWS


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingles_of(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in row order, and the rows' edges among them."""
    hashes, left, place = words.hashes(), words.left(), words.place()
    starts = np.flatnonzero((left >= k) | (place == 0))
    found = spans_hash(hashes, starts, np.minimum(starts + k, starts + left[starts]))
    return found, np.searchsorted(starts, words.edges)


def signatures(found: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash values of the rows that have shingles: uint32, rows x HASHES."""
    starts = edges[:-1][np.diff(edges) > 0]
    out = np.empty((HASHES, len(starts)), np.uint32)
    if len(starts):
        short = (mix(found) >> np.uint64(32)).astype(np.uint32)
        for j, (a, b) in enumerate(zip(*_family(), strict=True)):
            np.minimum.reduceat((short ^ b) * a, starts, out=out[j])
    return np.ascontiguousarray(out.T)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    odd = (np.random.default_rng(21).integers(1, 2**63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    bands = (signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * odd
    return mix(bands.sum(2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(7)))


def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Of n compared values, the least number of equal ones with which a pair stays: P(Bin(n + 1, t) <= m) >= tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
        out[n] = m
    return out


def new_only(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose first column, a text's key, is not in seen; it is added."""
    keep = []
    for i, node in enumerate(batch.column(0).to_pylist()):
        if node not in seen:
            seen.add(node)
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def _bander(batches):
    seen: set = set()
    for batch in (new_only(b, seen) for b in batches):
        for part in chunks(batch.column(1)):
            found, edges = shingles_of(Words(part, lower=False))
            has = np.flatnonzero(np.diff(edges) > 0)
            bands = band_hashes(signatures(found, edges))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has + part.first)), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))], names=["node", "bands"])


def _sharer(shared):
    """Of each text the bands whose bit is set, a row for each."""

    def shares(batches):
        bitmap = shared.value
        for batch in batches:
            band = batch.column(1).flatten()
            keep = np.flatnonzero(has_bit(bitmap, band.to_numpy() & (len(bitmap) * 8 - 1)))
            owner = pc.list_parent_indices(batch.column(1)).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), band.take(pa.array(keep))], names=["node", "band"])

    return shares


def shared_bands(bands: DataFrame, least_bits: int = 15) -> DataFrame:
    """node, band: the bands that several texts have, and a few others; bands: node, and an array of bands.

    What is shuffled is a band and parts of texts' keys, whole keys go along only with bands that a bitmap lets through."""
    single = bands.select(F.xxhash64("node").alias("text"), F.explode("bands").alias("band"))
    several = single.groupBy("band").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least < most").select("band")
    several = materialize(several, "several")
    size = 1 << min(MOST_BITS, max(least_bits, (8 * several.count()).bit_length()))
    shared = bands.sparkSession.sparkContext.broadcast(bitmap_of(several.select(F.pmod("band", F.lit(size)).alias("position")), "position", size))
    return materialize(bands.mapInArrow(_sharer(shared), "node binary, band long"), "shared-bands")


def _featurer(shared):
    def features(batches):
        bitmap, seen = shared.value, set()
        for batch in batches:
            keep = np.flatnonzero(has_bit(bitmap, batch.column(2).to_numpy()))
            if not len(keep):
                continue
            batch = new_only(batch.take(pa.array(keep)), seen)
            for part in chunks(batch.column(1)):
                found, edges = shingles_of(Words(part, lower=False))
                has = np.flatnonzero(np.diff(edges) > 0)
                signature = (signatures(found, edges) >> np.uint32(16)).astype(np.uint16)
                sets = [np.unique(found[edges[r] : edges[r + 1]]) for r in has]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has + part.first)), pa.array([s.tobytes() for s in signature], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "signature", "shingles"])

    return features


def surviving(signature: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that neither the sizes nor the incremental comparison rule out."""
    can = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])
    a, b = a[can], b[can]
    equal = np.zeros(len(a), np.int64)
    for n, fewest in least.items():
        equal += (signature[a, n - STEP : n] == signature[b, n - STEP : n]).sum(1)
        stays = equal >= fewest
        a, b, equal = a[stays], b[stays], equal[stays]
    return a, b


def shared_sizes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the sets' intersections for the pairs (a, b)."""
    if not len(a):
        return np.zeros(0, np.int64)
    used = np.unique(np.concatenate([a, b]))
    where = np.zeros(len(sets), np.int64)
    where[used] = np.arange(len(used))
    values = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    unique, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    owner, column = owner[keep], number[column[keep]]
    width = int(common.sum())
    if len(a) * len(values) / len(used) * 10 < len(used) ** 2 * width / 10:  # few pairs: each by itself
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(used), min(4096, width - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return total[where[a], where[b]].astype(np.int64)


def met_before(bands: list[np.ndarray], here: int) -> np.ndarray:
    """For each two texts: do they share a band less than `here`, at which they meet too?"""
    owner = np.repeat(np.arange(len(bands)), [len(b) for b in bands])
    values = np.concatenate(bands)
    less = values < here
    _, column, count = np.unique(values[less], return_inverse=True, return_counts=True)
    shared = np.zeros((len(bands), len(bands)), np.float32)
    common = count[column] > 1
    owner, number = owner[less][common], np.cumsum(count > 1) - 1
    column = number[column[common]]
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = np.zeros((len(bands), 4096), np.float32)
        here_now = (column >= at) & (column < at + 4096)
        part[owner[here_now], column[here_now] - at] = 1
        shared += part @ part.T
    return shared > 0


def _task(nodes, sides, signature, sets, bands, band, cross: bool, threshold: float, least) -> list[tuple]:
    """(node, links, least node linked to it within the task) of the nodes with links."""
    n = len(nodes)
    if cross:
        first, second = np.flatnonzero(sides == sides.min()), np.flatnonzero(sides == sides.max())
        if sides.min() == sides.max():
            return []
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    else:
        a, b = np.triu_indices(n, 1)
    if band is not None:
        new = ~met_before(bands, band)[a, b]
        a, b = a[new], b[new]
    sizes = np.array([len(s) for s in sets])
    a, b = surviving(signature, sizes, a, b, threshold, least)
    both = shared_sizes(sets, a, b)
    linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    a, b = a[linked], b[linked]
    links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    label = np.argsort(np.argsort(np.array(nodes, dtype=object)))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            break
        label = new
    by_rank = np.argsort(np.argsort(np.argsort(np.array(nodes, dtype=object))))
    return [(nodes[i], int(links[i]), nodes[by_rank[label[i]]]) for i in np.flatnonzero(links)]


def _linker(threshold: float, tolerance: float):
    def link(batches):
        least = fewest_matches(threshold, tolerance)
        names = ["node", "links", "root"]
        types = [pa.binary(), pa.int64(), pa.binary()]

        def closed(rows):
            signature = np.stack([np.frombuffer(r["signature"], np.uint16) for r in rows])
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
            band = rows[0]["band"]
            bands = [np.array(r["bands"], np.int64) for r in rows] if band is not None else []
            out = _task([r["node"] for r in rows], np.array([r["block"] for r in rows]), signature, sets, bands, band, rows[0]["i"] != rows[0]["j"], threshold, least)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], types, strict=True)], names=names)

        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["component"], row["band"], row["i"], row["j"])
                if now != key and held:
                    yield closed(held)
                    held = []
                if now != key or row["node"] != held[-1]["node"]:
                    held.append(row)
                key = now
        if held:
            yield closed(held)

    return link


def groups(candidates: DataFrame, bands: DataFrame, buckets: DataFrame, block: int) -> DataFrame:
    """Where each candidate meets others: node, meets, an array of struct<component, band, members> (one of the two null),
    and bands, those of the node at which it does.

    candidates: node, component; bands: node, band; buckets: band, v, members of bands that texts share."""
    parted = candidates.withColumn("salt", salt("node"))
    sizes = parted.groupBy("component").agg(F.count("*").alias("members"), salts_seen().alias("seen"))
    blocks = lambda n: F.ceil(F.col(n) / block)
    # Copies of texts that a large component sends as a whole, and band by band.
    at_least = buckets.join(candidates, F.col("v") == F.col("node")).select("component", "members")
    large = sizes.filter(F.col("members") > block)
    by_band = at_least.join(large.select("component", (F.col("members") * blocks("members")).alias("whole")), "component")
    by_band = by_band.groupBy("component").agg(F.sum(F.col("members") * blocks("members")).alias("cost"), F.first("whole").alias("whole")).filter("cost < whole").select("component", F.lit(True).alias("by_band"))
    sizes = sizes.join(by_band, "component", "left").select("component", "members", F.coalesce("by_band", F.lit(False)).alias("by_band"), each_salt("seen").alias("salt"))
    placed = materialize(parted.join(sizes, ["component", "salt"]).select("node", "component", "members", "by_band"), "placed")
    whole = F.struct("component", F.lit(None).cast("long").alias("band"), "members")
    together = placed.filter("not by_band").select("node", F.array(whole).alias("meets"), F.array().cast("array<long>").alias("bands"))
    apart = placed.filter("by_band").select("node", salt("node").alias("salt"))
    if apart.isEmpty():
        return together
    apart = apart.join(bands, "node").distinct().join(buckets.select("band", "members", each_salt("seen").alias("salt")), ["band", "salt"])
    single = F.struct(F.lit(None).cast("binary").alias("component"), "band", "members")
    apart = apart.groupBy("node").agg(F.collect_list(single).alias("meets"), F.collect_list("band").alias("bands"))
    return together.unionByName(apart)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, node (its text's 128-bit key), root (the same for all rows of a class), class_id (the
    class's least doc_id), copy_id (the least doc_id of its text), n_copies (rows of its text) and n_links (different
    texts of similarity >= threshold)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("node", F.unhex(F.md5("text"))).withColumn("salt", salt("doc_id"))
    texts = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), salts_seen().alias("seen")), "texts")
    # Copies of a text come out once a task; the few that are left make the same buckets, edges and features again.
    bands = shared_bands(materialize(rows.select("node", "text").mapInArrow(_bander, "node binary, bands array<long>"), "bands"))
    parted = bands.withColumn("salt", salt("node"))
    buckets = parted.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("most"), F.count("*").alias("members"), salts_seen().alias("seen")).filter("v < most").drop("most")
    buckets = materialize(buckets, "buckets")
    met = parted.join(buckets.select("band", "v", each_salt("seen").alias("salt")), ["band", "salt"])
    candidates = materialize(components(met.filter("node != v").select(F.col("node").alias("u"), "v")), "candidates")
    size = 1 << min(MOST_BITS, max(15, (16 * candidates.count()).bit_length()))
    position = F.pmod(F.xxhash64("node"), F.lit(size))
    shared = spark.sparkContext.broadcast(bitmap_of(candidates.select(position.alias("position")), "position", size))
    features = rows.select("node", "text", position.alias("position")).mapInArrow(_featurer(shared), "node binary, signature binary, shingles binary")
    placed = groups(candidates, bands, buckets, block).join(features, "node").withColumn("meet", F.explode("meets")).select("node", "signature", "shingles", "bands", "meet.*")
    placed = placed.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "signature", "shingles", "bands")
    key = ("component", "band", "i", "j")
    pairs = pairs.repartition(*key).sortWithinPartitions(*key, "node")
    links = materialize(pairs.mapInArrow(_linker(threshold, tolerance), "node binary, links long, root binary"), "links")
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    judged = texts.join(links.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left").join(classes, "node", "left")
    judged = materialize(judged.withColumn("root", F.coalesce("component", "node")).withColumn("salt", salt("node")).drop("component"), "judged")
    roots = judged.groupBy("root").agg(F.min("copy_id").alias("class_id"), salts_seen().alias("salts"))
    judged = judged.join(roots.select("root", "class_id", each_salt("salts").alias("salt")), ["root", "salt"])
    judged = judged.select("node", "root", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), each_salt("seen").alias("salt"))
    return rows.select("doc_id", "node", "salt").join(judged, ["node", "salt"]).drop("salt")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")
