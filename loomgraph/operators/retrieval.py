"""Keyword search (BM25), vector search (exact and by cells), rank fusion and reranking, for tables of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import written

K1, B = 1.2, 0.75
#: Query vectors that go to the executors at once; more are searched block by block. Vectors that one step scores.
QUERY_BLOCK, STEP = 10_000, 512
#: Query terms that are broadcast at most; more are joined by a shuffle.
MOST_TERMS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _; CJK characters one by one."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([一-鿿]|[\p{L}\p{N}_&&[^一-鿿]]+)"), F.lit(1))


def term_statistics(docs: DataFrame, field: str = "content", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf, dl) of a field, and the field's one-row totals (docs, avgdl); fields are text or arrays."""
    words = F.col(field) if isinstance(docs.schema[field].dataType, T.ArrayType) else tokens(F.col(field))
    rows = docs.select(key, words.alias("words")).withColumn("dl", F.size("words"))
    postings = rows.select(key, "dl", F.explode("words").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return postings, rows.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))


def postings_of(docs: DataFrame, wanted: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    """field, key, dl, term, tf of the wanted terms, and for every field of every document one row without a term.

    Texts are cut into tokens once; other terms go before anything is shuffled."""
    words = {f: F.col(f) if isinstance(docs.schema[f].dataType, T.ArrayType) else tokens(F.col(f)) for f in fields}
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(w, F.array().cast("array<string>")).alias("words")) for f, w in words.items()))
    rows = docs.select(key, F.explode(each).alias("of")).select(key, "of.field", "of.words", F.size("of.words").alias("dl"))
    counted = rows.select(key, "field", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("term"))
    wanted = wanted.withColumn("asked", F.lit(True))
    if wanted.count() <= MOST_TERMS:
        wanted = F.broadcast(wanted)
    found = counted.join(wanted, "term", "left").filter("asked or term is null")
    return found.groupBy("field", key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, fields: tuple[str, ...] = ("content", "title", "keywords"), top_k: int = 100, key: str = "doc_id", filters: dict[str, object] | None = None) -> DataFrame:
    """query_id, key, score, rank: of each document its best field's score; queries: query_id, query.

    Queries of the same words have the same hits and are scored once, however many ask them.
    filters: column of docs -> value, or list of values, that hits must have; they change no score."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).groupBy("query_id")
    asked = written(words.agg(F.sort_array(F.collect_list("term")).alias("terms")), "queries")
    different = written(asked.groupBy("terms").agg(F.min("query_id").alias("query_id")), "different")
    terms = written(different.select("query_id", F.explode("terms").alias("term")), "terms")
    rows = written(postings_of(docs, terms.select("term").distinct(), fields, key), "postings")
    totals = rows.filter("term is null").groupBy("field").agg(F.sum("tf").alias("docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    found = rows.filter("term is not null")
    frequency = found.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if filters:
        allowed = docs
        for column, value in filters.items():
            allowed = allowed.filter(F.col(column).isin(list(value) if isinstance(value, (list, tuple, set)) else [value]))
        found = found.join(allowed.select(key).distinct(), key, "left_semi")
    weighted = found.join(frequency, ["field", "term"]).join(F.broadcast(totals), "field").select("field", "term", key, weight.alias("weight"))
    scored = weighted.join(terms, "term").groupBy("query_id", key, "field").agg(F.sum("weight").alias("score"))
    best = ranked(scored.groupBy("query_id", key).agg(F.max("score").alias("score")), top_k, key)
    hits = best.join(different, "query_id").select("terms", key, "score", "rank")
    return asked.join(hits, "terms").select("query_id", key, "score", "rank")


def ranked(scores: DataFrame, top_k: int, key: str = "doc_id") -> DataFrame:
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)).cast("long")
    return scores.withColumn("rank", at).filter(F.col("rank") <= top_k)


def _nearest(names: list, matrix: np.ndarray, k: int, key: str, vector: str):
    def search(frames):
        # Of each query the best scores so far and their keys; a step adds STEP vectors and keeps the best k again.
        scores, keys = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        known: list = []
        for frame in frames:
            for at in range(0, len(frame), STEP):
                part = frame.iloc[at : at + STEP]
                rows = np.stack(part[vector].to_numpy()).astype(np.float64)
                new = matrix @ (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).T
                number = np.arange(len(known), len(known) + len(part))
                known += part[key].tolist()
                scores = np.concatenate([scores, new], 1)
                keys = np.concatenate([keys, np.broadcast_to(number, new.shape)], 1)
                if scores.shape[1] > k:
                    order = np.lexsort((np.argsort(np.argsort(np.array(known, dtype=object)))[keys], -np.round(scores, 9)), axis=1)[:, :k]
                    scores, keys = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
                    used, keys = np.unique(keys, return_inverse=True)
                    known, keys = [known[i] for i in used], keys.reshape(scores.shape)
        for at in range(0, len(names), STEP):
            part = slice(at, at + STEP)
            yield pd.DataFrame({"query_id": np.repeat(np.array(names[part], dtype=object), scores.shape[1]), key: [known[i] for i in keys[part].ravel()], "score": scores[part].ravel()})

    return search


def cosine_top_k(queries: DataFrame, vectors: DataFrame, top_k: int = 100, key: str = "doc_id", vector: str = "embedding", doc_ids: DataFrame | list | None = None) -> DataFrame:
    """query_id, key, score, rank of the nearest vectors; queries: query_id and a vector. Each task keeps top_k for a query.

    Queries go to the tasks in blocks of QUERY_BLOCK. doc_ids: keys that hits must have, a list or a table of the key."""
    if isinstance(doc_ids, DataFrame):
        vectors = vectors.join(doc_ids.select(key).distinct(), key, "left_semi")
    elif doc_ids is not None:
        vectors = vectors.filter(F.col(key).isin(list(doc_ids)))
    numbered = queries.select("query_id", F.col(vector).alias("vector"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    found = None
    id_type = queries.schema["query_id"].dataType
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.collect()
        if not rows:
            continue
        matrix = np.array([r["vector"] for r in rows], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        schema = T.StructType([T.StructField("query_id", id_type), vectors.schema[key], T.StructField("score", T.DoubleType())])
        one = vectors.select(key, vector).mapInPandas(_nearest([r["query_id"] for r in rows], matrix, top_k, key, vector), schema)
        found = one if found is None else found.unionByName(one)
    return ranked(found, top_k, key) if found is not None else ranked(queries.select("query_id", F.lit(None).cast(vectors.schema[key].dataType).alias(key), F.lit(0.0).alias("score")).filter("false"), top_k, key)


def candidates(keyword: DataFrame, vector: DataFrame, key: str = "doc_id") -> DataFrame:
    """Both sides' hits, one row for each query and document: keyword and vector rank and score."""
    side = lambda rows, s: rows.select("query_id", key, F.col("rank").alias(f"{s}_rank"), F.col("score").alias(f"{s}_score"))
    return side(keyword, "keyword").join(side(vector, "vector"), ["query_id", key], "full_outer")


def rrf(keyword: DataFrame, vector: DataFrame, k: int = 60, top_k: int = 20, key: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion; ties go to the side and rank seen first (keyword before vector)."""
    both = candidates(keyword, vector, key)
    part = lambda s: F.coalesce(1.0 / (k + F.col(f"{s}_rank")), F.lit(0.0))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("keyword_rank"), "vector_rank")).cast("long")
    return both.withColumn("score", part("keyword") + part("vector")).withColumn("rank", at).filter(F.col("rank") <= top_k)


def weighted_fusion(keyword: DataFrame, vector: DataFrame, keyword_weight: float = 0.3, vector_weight: float = 0.7, top_k: int = 20, key: str = "doc_id") -> DataFrame:
    """Each side's scores over its query's largest (0 if that is not positive), weighted and added."""
    both = candidates(keyword, vector, key)
    whole = Window.partitionBy("query_id")

    def part(s: str) -> Column:
        most = F.max(f"{s}_score").over(whole)
        return F.when(most > 0, F.coalesce(F.col(f"{s}_score"), F.lit(0.0)) / most).otherwise(0.0)

    at = F.row_number().over(whole.orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("keyword_rank"), "vector_rank")).cast("long")
    return both.withColumn("score", keyword_weight * part("keyword") + vector_weight * part("vector")).withColumn("rank", at).filter(F.col("rank") <= top_k)


def hybrid(queries: DataFrame, docs, vectors: DataFrame, each: int = 100, top_k: int = 20, use_keyword: bool = True, use_vector: bool = True, key: str = "doc_id") -> DataFrame:
    """Both searches at `each` hits, fused to top_k; a side that is off gives no hits. queries: query_id, query, embedding.

    docs: a table of documents, or a KeywordIndex of them."""
    from . import keyword_index

    words = bm25(queries, docs, top_k=each, key=key) if isinstance(docs, DataFrame) else keyword_index.search(queries, docs, each)
    near = cosine_top_k(queries, vectors, each, key)
    return rrf(words if use_keyword else words.filter("false"), near if use_vector else near.filter("false"), top_k=top_k, key=key)


def rerank(hits: DataFrame, scores: DataFrame, min_score: float = 0.0, top_n: int = 10) -> DataFrame:
    """Hits (query_id, rank, ...) by outside scores (query_id, index from 0, score): those of min_score or more, top_n of
    them; a query without any score keeps its first top_n hits."""
    given = scores.groupBy("query_id").agg(F.lit(True).alias("scored"))
    joined = hits.join(given, "query_id", "left").join(scores.select("query_id", (F.col("index") + 1).alias("rank"), F.col("score").alias("outside")), ["query_id", "rank"], "left")
    value = F.when(F.col("scored"), F.coalesce("outside", F.lit(0.0)))
    kept = joined.withColumn("value", value).filter(F.col("value").isNull() | (F.col("value") >= min_score))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("value"), "rank")).cast("long")
    return kept.withColumn("new_rank", at).filter(F.col("new_rank") <= top_n)


def fit_budget(rows: DataFrame, budget: int, cost: str = "tokens", order: str = "rank", group: str = "query_id", spare: int = 50) -> DataFrame:
    """Per group the longest run from rank 1 that fits the budget; the next row too, cut, if more than `spare` is left."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = rows.withColumn("before", before).withColumn("left", F.lit(budget) - F.col("before"))
    whole = F.col(cost) <= F.col("left")
    broken = F.max(F.when(whole, 0).otherwise(1)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(broken, F.lit(0)) == 0
    return seen.withColumn("kept", F.when(whole, F.col(cost)).otherwise(F.col("left"))).withColumn("first", first).filter(F.col("first") & (whole | (F.col("left") > spare)))


def last_messages(turns: DataFrame, n: int = 5) -> DataFrame:
    """conv_id, messages: the last n turns in order."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = turns.withColumn("at", at).filter(F.col("at") <= n)
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


#: Headings and line formats of the graph context.
CONTEXT_HEADS = {"entities": "相关实体", "relations": "相关关系", "paths": "证据路径"}


def graph_context(entities: Column, relations: Column, paths: Column) -> Column:
    """Lines for at most 10 entities (descriptions of 100 characters), 10 relations and 3 paths; fixed line formats."""

    def part(head: str, rows: Column, most: int, line) -> Column:
        return F.when(F.size(rows) > 0, F.concat(F.lit(f"【{head}】\n"), F.array_join(F.transform(F.slice(rows, 1, most), line), "\n")))

    entity = part(CONTEXT_HEADS["entities"], entities, 10, lambda e: F.concat(F.lit("  - "), e["name"], F.lit("（"), e["type"], F.lit("）: "), F.substring(F.coalesce(e["description"], F.lit("")), 1, 100)))
    relation = part(CONTEXT_HEADS["relations"], relations, 10, lambda r: F.concat(F.lit("  - "), r["head"], F.lit(" --["), r["type"], F.lit("]--> "), r["tail"]))
    path = part(CONTEXT_HEADS["paths"], paths, 3, lambda p: F.concat(F.lit("  - "), F.array_join(p, " -> ")))
    return F.concat_ws("\n\n", entity, relation, path)


def context(hits: DataFrame, history: DataFrame | None = None, budget: int = 4000, cut: int = 500) -> DataFrame:
    """query_id, context, sources, truncated: hits' texts (content, cut) as numbered blocks within the token budget.

    A token is two characters. History (query_id, history) is put first if it takes less than 30 % of the budget."""
    rows = hits.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, cut))).withColumn("tokens", F.floor(F.length("block") / 2))
    fitted = fit_budget(rows, budget)
    piece = F.expr("substring(block, 1, cast(2 * kept + 1 as int))")
    made = fitted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("block"), "doc_id"))).alias("parts"))
    whole = rows.groupBy("query_id").agg(F.count("*").alias("offered"), F.sum("tokens").alias("asked"))
    out = made.join(whole, "query_id").select("query_id", F.array_join(F.transform("parts", lambda p: p["block"]), "\n\n").alias("context"), F.transform("parts", lambda p: p["doc_id"]).alias("sources"), (F.col("asked") > budget).alias("truncated"))
    if history is None:
        return out
    short = F.floor(F.length("history") / 2) < 0.3 * budget
    return out.join(history, "query_id", "left").select("query_id", F.when(short, F.concat("history", F.lit("\n\n"), "context")).otherwise(F.col("context")).alias("context"), "sources", "truncated")


TEMPLATES = {"default": "Answer from the sources only and cite them as [n].\n\n{context}\n\nQuestion: {question}", "simple": "{context}\n\n{question}", "graph_enhanced": "Answer from sources and graph, citing sources as [n].\n\nGraph:\n{graph}\n\nSources:\n{context}\n\nQuestion: {question}"}


def prompt(question: Column, context_text: Column, graph: Column | None = None, template: str = "default") -> Column:
    """A named template, or a text with {context}, {question} and {graph}, filled in."""
    out = F.lit(TEMPLATES.get(template, template))
    for name, value in (("{graph}", F.lit("") if graph is None else F.coalesce(graph, F.lit(""))), ("{context}", context_text), ("{question}", question)):
        out = F.replace(out, F.lit(name), value)
    return out
