"""Approximate vector search: cells, product-quantised residuals, and an exact second look at a short list.

An index has `cells` unit centres, their number growing with the square root of the rows, and a codebook for each of
`subspaces` slices of a vector. A vector is stored as its cell and one byte for each slice of what is left of it after the
centre is taken off. A query looks at the cells whose centres are nearest; there a vector's score is the centre's plus one
table look-up for each byte. Tasks keep the best few of each query. Only these few are read as full vectors, and ranked
by their exact cosine.

How many cells a query looks at is measured when the index is fitted: as many as hold ENOUGH of the ten nearest
neighbours among the sample. Where vectors lie in groups that is a small share of the cells; where they point anywhere it
is most of them, and what is saved is the reading: `subspaces` bytes a vector, and full vectors for the short list only.

Centres and codebooks are learned from at most SAMPLE vectors; every vector is in the index. A cell of many vectors is
split by a hash of the key, its queries by a hash of theirs, so that no task holds more than PART of either."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

#: Vectors that cells are learned from, those that codebooks are, and the share of near neighbours that cells must hold.
SAMPLE, CODE_SAMPLE, ENOUGH = 200_000, 16_000, 0.98
#: Vectors, and queries, of a cell that one task holds; cells at most.
PART, QUERY_PART, MOST_CELLS = 50_000, 2_000, 16_384


@dataclass(frozen=True)
class VectorIndex:
    """centres: cells x d; codebooks: subspaces x codewords x d / subspaces; probe: cells that a query looks at."""

    centres: np.ndarray
    codebooks: np.ndarray
    probe: int


def unit_rows(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _codebook(rows: np.ndarray, codewords: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of the rows, started from rows spread over their order."""
    centres = rows[np.linspace(0, len(rows) - 1, codewords).astype(int)].copy()
    for _ in range(rounds):
        best = (rows @ centres.T - 0.5 * np.square(centres).sum(1)).argmax(1)
        counts = np.bincount(best, minlength=codewords)
        for d in range(rows.shape[1]):
            sums = np.bincount(best, rows[:, d], codewords)
            centres[:, d] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, d])
    return centres


def _probe(rows: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 256) -> int:
    """Cells, nearest first, that hold ENOUGH of the k nearest rows of some of the rows, themselves left out."""
    asked = rows[:: max(1, len(rows) // queries)][:queries]
    scores = asked @ rows.T
    near = np.argsort(-scores, axis=1)[:, 1 : k + 1]
    cell = (rows @ centres.T).argmax(1)
    place = np.empty((len(asked), len(centres)), np.int64)
    np.put_along_axis(place, np.argsort(-(asked @ centres.T), axis=1), np.arange(len(centres))[None, :], 1)
    ranks = np.take_along_axis(place, cell[near], 1)
    return int(np.quantile(ranks, ENOUGH)) + 1 if ranks.size else len(centres)


def fit_index(vectors: DataFrame, key: str = "doc_id", vector: str = "embedding", cells: int | None = None, subspaces: int = 32, codewords: int = 256, probe: int | None = None, seed: int = 7) -> VectorIndex:
    """Learn an index from vectors of one length d; subspaces is lowered to a divisor of d. None for an empty table's cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"))
    n = rows.count()
    if not n:
        return VectorIndex(np.zeros((0, 1)), np.zeros((1, 1, 1)), 0)
    d = rows.select(F.size("v")).first()[0]
    subspaces = max(s for s in range(1, min(subspaces, d) + 1) if d % s == 0)
    drawn = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE) if n > SAMPLE else rows
    as_unit = lambda frames: (pd.DataFrame({key: f[key], "v": list(unit_rows(f["v"]))}) for f in frames)
    schema = T.StructType([vectors.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])
    sample = written(drawn.mapInPandas(as_unit, schema), "sample")
    wanted = cells or max(1, min(MOST_CELLS, round(n**0.5), min(n, SAMPLE) // 8 or 1))
    model = KMeans(k=max(2, wanted), seed=seed, maxIter=10, initMode="random").fit(sample.select(array_to_vector("v").alias("features"))) if min(n, wanted) > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.zeros((1, d))
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    few = sample.orderBy(F.xxhash64(key), key).limit(CODE_SAMPLE)
    width = d // subspaces

    def sliced(frames):
        for frame in frames:
            v = np.stack(frame["v"].to_numpy())
            left = v - centres[(v @ centres.T).argmax(1)]
            parts = left.reshape(len(v), subspaces, width).transpose(1, 0, 2)
            yield pd.DataFrame({"slice": np.repeat(np.arange(subspaces), len(v)), "part": list(parts.reshape(-1, width))})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        found = _codebook(np.stack(frame["part"].to_numpy()), codewords)
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "words": [found.ravel()]})

    # Each task learns the codebook of one slice, from CODE_SAMPLE short vectors.
    learned = few.mapInPandas(sliced, "slice int, part array<double>").groupBy("slice").applyInPandas(learn, "slice int, words array<double>").collect()
    codebooks = np.array([r["words"] for r in sorted(learned, key=lambda r: r["slice"])]).reshape(subspaces, codewords, width)
    if probe is None:
        probe = _probe(np.array([r["v"] for r in few.limit(4000).collect()]), centres)
    return VectorIndex(centres, codebooks, max(1, min(probe, len(centres))))


def coded(vectors: DataFrame, index: VectorIndex, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """key, cell and codes (a byte for each slice) of every vector."""
    slices, _, width = index.codebooks.shape

    def encode(frames):
        for frame in frames:
            v = unit_rows(frame["v"])
            cell = (v @ index.centres.T).argmax(1)
            left = (v - index.centres[cell]).reshape(len(v), slices, width)
            codes = np.empty((len(v), slices), np.uint8)
            for s, book in enumerate(index.codebooks):
                codes[:, s] = (left[:, s] @ book.T - 0.5 * np.square(book).sum(1)).argmax(1)
            yield pd.DataFrame({key: frame[key], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    schema = T.StructType([vectors.schema[key], T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType())])
    return vectors.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v")).mapInPandas(encode, schema)


def write_index(vectors: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", **settings) -> VectorIndex:
    """Fit an index, and write the codes of all vectors under {path}/codes, sorted by cell, and the model under {path}/model."""
    index = fit_index(vectors, key, vector, **settings)
    coded(vectors, index, key, vector).repartition("cell", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("cell").write.parquet(f"{path}/codes")
    parts = [("centres", index.centres), ("codebooks", index.codebooks), ("probe", np.array([float(index.probe)]))]
    rows = [(name, list(part.shape), part.ravel().tolist()) for name, part in parts]
    vectors.sparkSession.createDataFrame(rows, "name string, shape array<long>, numbers array<double>").coalesce(1).write.parquet(f"{path}/model")
    return index


def read_index(spark: SparkSession, path: str) -> tuple[VectorIndex, DataFrame]:
    """The model and the codes that write_index left."""
    parts = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}
    return VectorIndex(parts["centres"], parts["codebooks"], int(parts["probe"][0])), spark.read.parquet(f"{path}/codes")


def _asker(index: VectorIndex, probe: int):
    def ask(frames):
        for frame in frames:
            q = unit_rows(frame["q"])
            scores = q @ index.centres.T
            cells = np.argsort(-scores, axis=1, kind="stable")[:, :probe]
            at = np.repeat(np.arange(len(q)), cells.shape[1])
            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[at], "q": [q[i] for i in at], "cell": cells.ravel().astype(np.int32), "base": np.take_along_axis(scores, cells, 1).ravel()})

    return ask


def _scorer(index: VectorIndex, key: str, keep: int):
    slices, codewords, width = index.codebooks.shape

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], key: [], "guess": []}
        if len(asked) and len(held):
            keys = held[key].to_numpy()
            codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(-1, slices).astype(np.intp) + np.arange(slices) * codewords
            for query_id, q, base in zip(asked["query_id"], asked["q"], asked["base"], strict=True):
                table = np.einsum("sw,scw->sc", np.asarray(q).reshape(slices, width), index.codebooks).ravel()
                guess = base + table[codes].sum(1)
                best = np.argpartition(-guess, keep - 1)[:keep] if len(guess) > keep else np.arange(len(guess))
                out["query_id"] += [query_id] * len(best)
                out[key] += keys[best].tolist()
                out["guess"] += guess[best].tolist()
        return pd.DataFrame(out)

    return score


def short_list(queries: DataFrame, codes: DataFrame, index: VectorIndex, keep: int, key: str = "doc_id", vector: str = "embedding", probe: int | None = None) -> DataFrame:
    """query_id, key, guess, q: for each query the `keep` best vectors of its cells by their codes."""
    id_field = T.StructField("query_id", queries.schema["query_id"].dataType)
    asked_schema = T.StructType([id_field, T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("base", T.DoubleType())])
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("q")).mapInPandas(_asker(index, min(probe or index.probe, len(index.centres))), asked_schema)
    asked = written(asked, "asked")
    parts = lambda rows, most, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # One row for each cell, MOST_CELLS at most.
    split = F.broadcast(parts(codes, PART, "parts").join(parts(asked, QUERY_PART, "query_parts"), "cell"))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    a = asked.join(split, "cell").select("query_id", "q", "base", "cell", part("query_id", "query_parts").alias("query_part"), copies("parts").alias("part"))
    c = codes.join(split, "cell").select(key, "codes", "cell", part(key, "parts").alias("part"), copies("query_parts").alias("query_part"))
    schema = T.StructType([id_field, codes.schema[key], T.StructField("guess", T.DoubleType())])
    by = ("cell", "part", "query_part")
    found = a.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_scorer(index, key, keep), schema)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), key))
    best = found.withColumn("at", at).filter(F.col("at") <= keep).drop("at")
    return best.join(asked.select("query_id", "q").dropDuplicates(["query_id"]), "query_id")


def search_index(queries: DataFrame, vectors: DataFrame, codes: DataFrame, index: VectorIndex, top_k: int = 10, keep: int | None = None, key: str = "doc_id", vector: str = "embedding", probe: int | None = None) -> DataFrame:
    """query_id, key, score, rank: the top_k by exact cosine of each query's short list of `keep` (10 * top_k) vectors."""
    few = short_list(queries, codes, index, keep or 10 * top_k, key, vector, probe)
    pairs = few.join(vectors.select(key, F.col(vector).cast("array<double>").alias("v")), key)
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    scored = pairs.select("query_id", key, (dot / F.greatest(norm, F.lit(1e-12))).alias("score"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)).cast("long")
    return scored.withColumn("rank", at).filter(F.col("rank") <= top_k)


def approximate_top_k(queries: DataFrame, vectors: DataFrame, top_k: int = 10, key: str = "doc_id", vector: str = "embedding", **settings) -> DataFrame:
    """Fit, encode and search in one go; write_index and search_index keep the index for later queries."""
    index = fit_index(vectors, key, vector, **settings)
    codes = written(coded(vectors, index, key, vector), "codes")
    return search_index(queries, vectors, codes, index, top_k, key=key, vector=vector)
