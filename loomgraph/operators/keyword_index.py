"""A stored keyword index, and BM25 search over it that skips blocks of documents which can't enter a result.

write_index cuts texts into tokens once and writes under a path

    postings   bucket (a hash of the term), field, term, part, block, most_tf, least_dl, keys, tfs, dls
    terms      bucket, field, term, df, total
    fields     field, docs, avgdl

A block is about BLOCK documents, alike where the writer is told how (`together`), else by a hash of their key; a part is
about PART_BLOCKS blocks. A row holds one block's postings of a term, so a common term is many short rows and no task
holds all of it. A search reads the buckets of its terms only.
Of every query and block the rows' most_tf and least_dl give a bound that no document of the block exceeds. First each
query's blocks of highest bound are scored, until they hold top_k documents or so; then only blocks whose bound reaches
the top_k-th score found. A block is scored as a whole by one task, which gives back its top_k of a query: there is no row
for a pair of query and document. Results are those of retrieval.bm25, exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written
from .retrieval import K1, MOST_TERMS, B, ranked, tokens

#: Documents of a block, blocks of a part, and how many top_k of documents are scored before blocks are skipped.
BLOCK, PART_BLOCKS, FIRST = 64, 4, 2
#: Queries whose scores one step holds; pairs of query and block from which on blocks are skipped: bounds cost more below.
STEP, SKIP_FROM = 64, 250_000
#: Characters of text that one task of the writer groups in memory; tasks up to FEW_TASKS write files of their own, of more
#: tasks TASKS_A_FILE write together, one after the other.
TASK_CHARS, FEW_TASKS, TASKS_A_FILE = 8_000_000, 64, 8
#: Scores are compared after rounding to nine places; a bound may fall short of a score by no more than this.
SLACK = 1e-8


def bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeywordIndex:
    """Tables of a written index; buckets: how many the terms are spread over."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    key: str
    buckets: int
    parts: int
    blocks: int


def by_block(placed: DataFrame, each: Column, key: str, n_tasks: int) -> DataFrame:
    """field, term, block, held: the block's documents with the term. placed: documents with their block; each: their
    fields' words. Documents are shuffled once, as they are; blocks are whole in a task, so that words never are."""
    fields = [c for c in placed.columns if c not in ("_group", "_n")]
    rows = placed.select(*(F.col(f"`{c}`") for c in fields)).repartition(n_tasks, "block").select(key, "block", F.explode(each).alias("of"))
    rows = rows.select(key, "block", "of.field", "of.words", F.size("of.words").alias("dl"))
    # Lengths are counted from the same cut as the terms: a document's row without a term.
    single = rows.select("field", key, "dl", "block", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("term"))
    dealt = single.groupBy("field", "term", "block", key, "dl").agg(F.count("*").alias("tf"))
    held = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))))
    return dealt.groupBy("field", "term", "block").agg(held.alias("held"))


def write_index(docs: DataFrame, path: str, fields: tuple[str, ...] = ("content", "title", "keywords"), key: str = "doc_id", buckets: int = 32, block: int = BLOCK, together: str | None = None) -> KeywordIndex:
    """Index fields (texts or arrays of terms) of docs under path, which must not exist. One row a document, by key.

    together: a column, such as the language, by whose values documents are put into blocks: the fewer terms two values
    share, the more blocks a search leaves out."""
    spark = docs.sparkSession
    words = {f: F.col(f) if isinstance(docs.schema[f].dataType, T.ArrayType) else tokens(F.col(f)) for f in fields}
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(w, F.array().cast("array<string>")).alias("words")) for f, w in words.items()))
    group = (F.lit("") if together is None else F.coalesce(F.col(together).cast("string"), F.lit(""))).alias("_group")
    text = [f for f in fields if isinstance(docs.schema[f].dataType, T.StringType)]
    chars = sum((F.coalesce(F.length(f), F.lit(0)) for f in text), F.lit(0)) if text else sum((F.greatest(F.size(f), F.lit(0)) * 8 for f in fields), F.lit(0))
    sizes = docs.groupBy(group).agg(F.count("*").alias("_n"), F.sum(chars.cast("long")).alias("_chars"))
    groups, n_docs, n_chars = sizes.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_chars"), F.lit(0))).first()
    sizes = sizes.drop("_chars")
    n_parts = max(1, -(-n_docs // (block * PART_BLOCKS)))
    n_tasks = max(1, -(-n_chars // TASK_CHARS))
    placed = docs.withColumn("_group", group).join(F.broadcast(sizes) if groups <= MOST_TERMS else sizes, "_group")
    place = F.xxhash64("_group", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / block)))
    grouped = by_block(placed.withColumn("block", place), each, key, n_tasks)
    out = grouped.select(bucket("term", buckets).alias("bucket"), "field", "term", F.pmod(F.col("block"), F.lit(n_parts)).cast("int").alias("part"), "block", F.array_max("held.tf").alias("most_tf"), F.array_min("held.dl").alias("least_dl"), F.col("held.k").alias("keys"), F.col("held.tf").alias("tfs"), F.col("held.dl").alias("dls"))
    out.coalesce(max(min(n_tasks, FEW_TASKS), n_tasks // TASKS_A_FILE)).sortWithinPartitions("bucket", "field", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    terms = stored.filter("term is not null").groupBy("bucket", "field", "term").agg(F.sum(F.size("tfs")).alias("df"), F.sum(total).alias("total"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    lengths = stored.filter("term is null").select("field", F.explode(F.arrays_zip("tfs", "dls")).alias("d"))
    whole = lengths.groupBy("field").agg(F.sum("d.tfs").alias("docs"), (F.sum(F.col("d.tfs") * F.col("d.dls")) / F.sum("d.tfs")).alias("avgdl"))
    n_blocks = lengths.count() and stored.filter("term is null").select("block").distinct().count()
    whole.select("*", F.lit(buckets).alias("buckets"), F.lit(n_parts).alias("parts"), F.lit(n_blocks).cast("long").alias("blocks")).coalesce(1).write.parquet(f"{path}/fields")
    return read_index(spark, path, key)


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> KeywordIndex:
    fields = spark.read.parquet(f"{path}/fields")
    first = fields.first()
    return KeywordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), fields.select("field", "docs", "avgdl"), key, *((first["buckets"], first["parts"], first["blocks"]) if first else (1, 1, 0)))


def _weight(tf: Column, dl: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def asked_rows(index: KeywordIndex, terms: DataFrame) -> DataFrame:
    """The postings of the terms (column term) with idf and avgdl of their fields; only the terms' buckets are read."""
    known = terms.select("term").distinct()
    near = sorted(r[0] for r in known.select(bucket("term", index.buckets)).distinct().collect())
    asked = known.withColumn("bucket", bucket("term", index.buckets))
    small = known.count() <= MOST_TERMS
    read = lambda rows: rows.filter(F.col("bucket").isin(near)) if len(near) < index.buckets else rows
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row for each field and asked term.
    told = read(index.terms).join(asked, ["bucket", "term"]).join(F.broadcast(index.fields), "field").select("bucket", "field", "term", idf.alias("idf"), "avgdl")
    return read(index.postings).join(F.broadcast(told) if small else told, ["bucket", "field", "term"])


def bounds(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, part, block, bound: what no document of the block exceeds; rows: asked_rows, terms: query_id, term."""
    most = _weight(F.col("most_tf"), F.col("least_dl"))
    single = rows.select("field", "term", "part", "block", most.alias("most")).join(terms, "term")
    by_field = single.groupBy("query_id", "part", "block", "field").agg(F.sum("most").alias("bound"))
    return by_field.groupBy("query_id", "part", "block").agg(F.max("bound").alias("bound"))


def _spread(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of `counts` numbers from `starts`: which range each number is of, and the numbers."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _scorer(key: str, top_k: int):
    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        terms, known = pd.factorize(rows["term"])
        rows = rows.iloc[np.argsort(terms, kind="stable")]
        terms = np.sort(terms)
        term_edges = np.searchsorted(terms, np.arange(len(known) + 1))
        fields, field_names = pd.factorize(rows["field"])
        blocks, block_names = pd.factorize(rows["block"])
        sizes = rows["keys"].map(len).to_numpy()
        edges = np.cumsum(sizes) - sizes
        keys, number = np.unique(np.concatenate(rows["keys"].to_list()), return_inverse=True)
        tf, dl = (np.concatenate(rows[c].to_list()).astype(np.float64) for c in ("tfs", "dls"))
        idf, mean = (np.repeat(rows[c].to_numpy(np.float64), sizes) for c in ("idf", "avgdl"))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        index, block_index, out = pd.Index(known), pd.Index(block_names), []
        for start in range(0, len(asked), STEP):
            part = asked.iloc[start : start + STEP]
            query = np.repeat(np.arange(len(part)), part["terms"].map(len))
            code = index.get_indexer(np.concatenate(part["terms"].to_list()))
            query, code = query[code >= 0], code[code >= 0]
            which, row = _spread(term_edges[code + 1] - term_edges[code], term_edges[code])
            query = query[which]
            if "blocks" in part:
                wanted = np.zeros((len(part), len(block_names) + 1), bool)
                wanted[np.repeat(np.arange(len(part)), part["blocks"].map(len)), block_index.get_indexer(np.concatenate(part["blocks"].to_list()))] = True
                use = wanted[query, blocks[row]]
                query, row = query[use], row[use]
            which, at = _spread(sizes[row], edges[row])
            slot = (query[which] * len(field_names) + fields[row[which]]) * len(keys) + number[at]
            scores = np.bincount(slot, weight[at], len(part) * len(field_names) * len(keys)).reshape(len(part), len(field_names), -1).max(1)
            # keys are sorted, so that of equal scores the smaller key stays.
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :top_k]
            found = np.take_along_axis(scores, best, 1)
            hit = found > 0
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[np.nonzero(hit)[0]], key: keys[best[hit]], "score": found[hit]}))
        return pd.concat(out)

    return score


def scored(rows: DataFrame, pairs: DataFrame | int, terms: DataFrame, key: str, top_k: int) -> DataFrame:
    """query_id, key, score: of each query the top_k documents of the blocks it is paired with (query_id, part, block), or
    of all blocks of so many parts, for each part by itself."""
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    if isinstance(pairs, int):
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    else:
        asked = pairs.groupBy("query_id", "part").agg(F.collect_list("block").alias("blocks")).join(asked, "query_id")
        # Postings of blocks that no query is paired with stay where they are.
        wanted = pairs.select("block").distinct()
        if wanted.count() <= MOST_TERMS:
            rows = rows.join(F.broadcast(wanted), "block", "left_semi")
    schema = T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField(key, rows.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())])
    held = rows.select("part", "block", "field", "term", "keys", "tfs", "dls", "idf", "avgdl")
    return asked.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(_scorer(key, top_k), schema)


def only(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """rows with the postings of allowed keys (column key) alone; bounds and frequencies stay those of all documents."""
    single = rows.withColumn("held", F.explode(F.arrays_zip("keys", "tfs", "dls"))).drop("keys", "tfs", "dls")
    kept = single.withColumn(key, F.col("held.keys")).join(allowed.select(key).distinct(), key, "left_semi")
    others = [c for c in kept.columns if c not in ("held", key)]
    listed = kept.groupBy(*others).agg(F.collect_list("held").alias("held"))
    return listed.select(*others, *(F.col(f"held.{c}").alias(c) for c in ("keys", "tfs", "dls")))


def search(queries: DataFrame, index: KeywordIndex, top_k: int = 100, allowed: DataFrame | None = None, skip: bool | None = None, seen: dict | None = None) -> DataFrame:
    """query_id, key, score, rank; queries: query_id, query. allowed: keys that hits must have.

    skip: leave out blocks that can't enter; the result is the same without. seen: gets the number of (query, block)
    pairs that share a term, and of those that were scored. skip None: by SKIP_FROM."""
    key = index.key
    terms = written(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "terms")
    rows = asked_rows(index, terms)
    if allowed is not None:
        rows = only(rows, allowed, key)
    if skip is None:
        skip = queries.count() * index.blocks >= SKIP_FROM
    if not skip:
        return ranked(scored(rows, index.parts, terms, key, top_k), top_k, key)
    rows = written(rows, "asked_postings")
    pairs = written(bounds(rows, terms), "bounds")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = pairs.withColumn("at", at).filter(F.col("at") <= max(1, -(-FIRST * top_k // BLOCK)))
    found = written(scored(rows, first, terms, key, top_k), "first_scores")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = found.withColumn("place", place).filter(F.col("place") == top_k).select("query_id", F.col("score").alias("least"))
    left = pairs.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    left = written(left.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)), "left_pairs")
    if seen is not None:
        seen |= {"pairs": pairs.count(), "scored": first.count() + left.count()}
    return ranked(found.unionByName(scored(rows, left, terms, key, top_k)), top_k, key)
