"""Queries over keyword, vector and hybrid search and what is built from their hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import keyword_index, vector_index
from ..operators import retrieval as rt
from ..tables import shared_dir, small
from .catalog import query
from .fixtures import GRAPH_SQL, entities, relations, table

c = F.col
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_DOCS = f"k AS (SELECT doc_id, {_TOK.format('text')} AS content, list_slice({_TOK.format('text')}, 1, 8) AS title, [lang, source] AS keywords FROM documents), q AS (SELECT item_id AS query_id, text AS query, {_TOK.format('text')} AS terms FROM benchmark)"


def _field(f):
    return f"""p_{f} AS (SELECT doc_id, len({f}) AS dl, unnest({f}) AS term FROM k), t_{f} AS (SELECT term, doc_id, dl, count(*) AS tf FROM p_{f} GROUP BY ALL), d_{f} AS (SELECT term, count(*) AS df FROM t_{f} GROUP BY term), a_{f} AS (SELECT count(*) AS n, avg(len({f})) AS avgdl FROM k),
s_{f} AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))) AS score FROM (SELECT query_id, unnest(list_distinct(terms)) AS term FROM q) z JOIN t_{f} USING (term) JOIN d_{f} USING (term), a_{f} GROUP BY query_id, doc_id)"""


_BM25 = f"WITH {_DOCS}, " + ", ".join(map(_field, ("content", "title", "keywords"))) + """, m AS (SELECT query_id, doc_id, max(score) AS score FROM (SELECT * FROM s_content UNION ALL SELECT * FROM s_title UNION ALL SELECT * FROM s_keywords) z GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m) z WHERE rank <= 100)"""
_VEC = """, cs AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM benchmark b JOIN embeddings u ON u.vec_id = b.item_id, embeddings v),
ve AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cs) z WHERE rank <= 100)"""
_BOTH = ", ca AS (SELECT query_id, doc_id, kw.rank AS kr, ve.rank AS vr, kw.score AS ks, ve.score AS vs FROM kw FULL JOIN ve USING (query_id, doc_id))"
_RRF = _BM25 + _VEC + _BOTH + ", fu AS (SELECT query_id, doc_id, coalesce(1 / (60 + kr), 0) + coalesce(1 / (60 + vr), 0) AS score, kr, vr FROM ca), hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, kr NULLS LAST, vr NULLS LAST) AS rank FROM fu) z WHERE rank <= 20)"


def docs(spark, d):
    words = rt.tokens(c("text"))
    return table(spark, d, "documents").select("doc_id", c("text").alias("content"), F.slice(words, 1, 8).alias("title"), F.array("lang", "source").alias("keywords"), "source", "lang")


def queries(spark, d):
    asked = table(spark, d, "benchmark").select(c("item_id").alias("query_id"), c("text").alias("query"))
    return asked.join(table(spark, d, "embeddings").select(c("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), "embedding")


_stored: dict = {}


def stored(spark, d, kind, write, read):
    """An index of a session's tables, written by the first query that needs it into the shared folder."""
    at = (spark.sparkContext.applicationId, d, kind)
    if at not in _stored:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        write(path)
        _stored[at] = path
    return read(_stored[at])


def keywords(spark, d):
    """The keyword index of all documents."""
    return stored(spark, d, "keywords", lambda path: keyword_index.write_index(docs(spark, d), path, together="lang"), lambda path: keyword_index.read_index(spark, path))


def keyword_hits(spark, d, **settings):
    return keyword_index.search(queries(spark, d), keywords(spark, d), **settings)


def vector_hits(spark, d):
    return rt.cosine_top_k(queries(spark, d).filter("embedding is not null"), vectors(spark, d))


def hybrid_hits(spark, d):
    return rt.rrf(keyword_hits(spark, d), vector_hits(spark, d))


def six(name="score"):
    return F.round(name, 6).alias(name)


query("ret_01_keyword_search", _BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM kw")(lambda spark, d: keyword_hits(spark, d).select("query_id", "doc_id", six(), "rank"))
query("ret_02_term_statistics", f"WITH {_DOCS}, " + _field("content").split(",\ns_content")[0] + " SELECT term, df, CAST((SELECT sum(tf) FROM t_content x WHERE x.term = d_content.term) AS BIGINT) AS total FROM d_content")(lambda spark, d: keywords(spark, d).terms.filter("field = 'content'").select("term", "df", "total"))
query("ret_03_vector_search", "WITH " + _VEC[2:] + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ve")(lambda spark, d: vector_hits(spark, d).select("query_id", "doc_id", six(), "rank"))


@query("ret_04_approximate_search")
def ret_04(spark, d):
    """Ten nearest of every hundredth vector by the stored index."""
    rows = vectors(spark, d)
    write = lambda path: vector_index.write_index(rows, path)
    index, codes = stored(spark, d, "vectors", write, lambda path: vector_index.read_index(spark, path))
    asked = rows.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return vector_index.search_index(asked, rows, codes, index).select("query_id", "doc_id", six(), "rank")



query("ret_05_rrf", _RRF + " SELECT query_id, doc_id, round(score, 9) AS score, rank FROM hy")(lambda spark, d: hybrid_hits(spark, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank"))
query("ret_06_weighted_fusion", _BM25 + _VEC + _BOTH + ", mx AS (SELECT *, max(ks) OVER w AS mk, max(vs) OVER w AS mv FROM ca WINDOW w AS (PARTITION BY query_id)), fu AS (SELECT query_id, doc_id, .3 * CASE WHEN mk > 0 THEN coalesce(ks, 0) / mk ELSE 0 END + .7 * CASE WHEN mv > 0 THEN coalesce(vs, 0) / mv ELSE 0 END AS score, kr, vr FROM mx) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kr NULLS LAST, vr NULLS LAST) AS rank FROM fu) z WHERE rank <= 20")(lambda spark, d: rt.weighted_fusion(keyword_hits(spark, d), vector_hits(spark, d)).select("query_id", "doc_id", six(), "rank"))
query("ret_07_hybrid", _RRF + " SELECT query_id, doc_id, rank FROM hy")(lambda spark, d: rt.hybrid(queries(spark, d).filter("embedding is not null"), keywords(spark, d), vectors(spark, d)).select("query_id", "doc_id", "rank"))
query("ret_08_entity_search", f"{GRAPH_SQL}, t AS (SELECT id, name, type, len({_TOK.format('name')}) AS dl, unnest({_TOK.format('name')}) AS term FROM e WHERE type = 'Product'), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT id, len({_TOK.format('name')}) AS dl FROM e WHERE type = 'Product') z), f AS (SELECT id, term, dl, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), q AS (SELECT DISTINCT p_partkey AS query_id, unnest(list_distinct({_TOK.format('p_name')})) AS term FROM part WHERE p_partkey % 100 = 0) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, sum(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl))) AS score FROM q JOIN f USING (term) JOIN d USING (term), n GROUP BY query_id, id) y) z WHERE rank <= 10")(lambda spark, d: rt.bm25(table(spark, d, "part").filter("p_partkey % 100 = 0").select(c("p_partkey").alias("query_id"), c("p_name").alias("query")), entities(spark, d).filter("type = 'Product'"), ("name",), 10, "id").select("query_id", "id", six(), "rank"))
_SOME = "WHERE doc_id IN (SELECT doc_id FROM documents WHERE source IN ('src3', 'src5'))"
_FILTERED = _BM25.replace("FROM m) z", f"FROM m {_SOME}) z")
query("ret_01_filtered_keyword_search", _FILTERED + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM kw")(lambda spark, d: keyword_hits(spark, d, allowed=docs(spark, d).filter("source in ('src3', 'src5')")).select("query_id", "doc_id", six(), "rank"))
query("ret_03_filtered_vector_search", "WITH " + _VEC[2:].replace("embeddings v)", "embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents WHERE source IN ('src3', 'src5')))") + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ve")(lambda spark, d: rt.cosine_top_k(queries(spark, d).filter("embedding is not null"), vectors(spark, d), doc_ids=table(spark, d, "documents").filter("source in ('src3', 'src5')").select("doc_id")).select("query_id", "doc_id", six(), "rank"))
query("set_02_candidates", _BM25 + _VEC + _BOTH + " SELECT query_id, count(*) AS n, count(kr) AS keyword, count(vr) AS vector FROM ca GROUP BY query_id")(lambda spark, d: rt.candidates(keyword_hits(spark, d), vector_hits(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.count("keyword_rank").alias("keyword"), F.count("vector_rank").alias("vector")))
query("win_02_fused_ranks", _RRF + " SELECT query_id, string_agg(CAST(doc_id AS STRING), ',' ORDER BY rank) AS docs FROM hy GROUP BY query_id")(lambda spark, d: hybrid_hits(spark, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("docs")))
_SCORES = "sc AS (SELECT query_id, rank - 1 AS idx, (query_id * 31 + (rank - 1) * 17) % 100 / 1e2 AS outside FROM hy WHERE query_id % 5 <> 0 AND rank % 3 <> 0)"
query("join_10_rerank", _RRF + f", {_SCORES}, j AS (SELECT hy.query_id, doc_id, rank, CASE WHEN hy.query_id IN (SELECT query_id FROM sc) THEN coalesce(outside, 0) END AS value FROM hy LEFT JOIN sc ON sc.query_id = hy.query_id AND idx = rank - 1) SELECT query_id, doc_id, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC NULLS LAST, rank) AS new_rank FROM j WHERE value IS NULL OR value >= .2) z WHERE new_rank <= 10")(lambda spark, d: reranked(spark, d).select("query_id", "doc_id", "new_rank"))


def reranked(spark, d):
    hits = hybrid_hits(spark, d)
    scores = hits.filter("query_id % 5 != 0 and rank % 3 != 0").select("query_id", (c("rank") - 1).alias("index"), ((c("query_id") * 31 + (c("rank") - 1) * 17) % 100 / 100).alias("score"))
    return rt.rerank(hits.select("query_id", "doc_id", "rank"), scores, 0.2)


_TURNS = "SELECT conv_id, turn, role, text, CAST(floor(length(text) / 2) AS BIGINT) AS tokens FROM conversations"
query("win_04_token_budget", f"WITH t AS (SELECT *, 200 - coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM ({_TURNS}) z), u AS (SELECT *, coalesce(max(CASE WHEN tokens <= lft THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM t) SELECT conv_id, turn, CAST(least(tokens, lft) AS BIGINT) AS kept FROM u WHERE broken = 0 AND (tokens <= lft OR lft > 50)")(lambda spark, d: rt.fit_budget(table(spark, d, "conversations").withColumn("tokens", F.floor(F.length("text") / 2)), 200, order="turn", group="conv_id").select("conv_id", "turn", "kept"))
query("win_05_last_messages", "SELECT conv_id, string_agg(concat(role, ':', text), chr(10) ORDER BY turn) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) z WHERE nth <= 5 GROUP BY conv_id")(lambda spark, d: rt.last_messages(table(spark, d, "conversations")).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n").alias("messages")))


def contexts(spark, d):
    hits = hybrid_hits(spark, d).join(table(spark, d, "documents").select("doc_id", c("text").alias("content")), "doc_id")
    return rt.context(hits, budget=1500)


query("ret_09_context", _RRF + ", x AS (SELECT query_id, rank, doc_id, concat('[', CAST(rank AS STRING), '] ', substring(text, 1, 500)) AS block FROM hy JOIN documents USING (doc_id)), t AS (SELECT *, floor(length(block) / 2) AS tokens, 1500 - coalesce(sum(floor(length(block) / 2)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM x), u AS (SELECT *, coalesce(max(CASE WHEN tokens <= lft THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM t) SELECT query_id, string_agg(substring(block, 1, CAST(2 * least(tokens, lft) + 1 AS BIGINT)), concat(chr(10), chr(10)) ORDER BY rank) AS context, string_agg(CAST(doc_id AS STRING), ',' ORDER BY rank) AS sources FROM u WHERE broken = 0 AND (tokens <= lft OR lft > 50) GROUP BY query_id")(lambda spark, d: contexts(spark, d).select("query_id", "context", F.array_join(c("sources").cast("array<string>"), ",").alias("sources")))
_GRAPH_CONTEXT = f"""{GRAPH_SQL}, o AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src ORDER BY id) AS nth FROM r WHERE src LIKE 'O%'),
rs AS (SELECT src AS id, string_agg(concat('  - ', src, ' --[', type, ']--> ', dst), chr(10) ORDER BY nth) AS lines, string_agg(concat('  - ', src, ' -> ', dst), chr(10) ORDER BY nth) FILTER (nth <= 3) AS paths FROM o WHERE nth <= 10 GROUP BY src),
es AS (SELECT src AS id, string_agg(concat('  - ', name, '（', e.type, '）: ', substring(coalesce(description, ''), 1, 100)), chr(10) ORDER BY nth) AS lines FROM o JOIN e ON e.id = dst WHERE nth <= 10 GROUP BY src)
SELECT id, concat('【相关实体】', chr(10), es.lines, chr(10), chr(10), '【相关关系】', chr(10), rs.lines, chr(10), chr(10), '【证据路径】', chr(10), rs.paths) AS context FROM rs JOIN es USING (id)"""
query("ret_10_graph_context", _GRAPH_CONTEXT)(lambda spark, d: graph_contexts(spark, d))


def number(column):
    """The number in the id of a node."""
    return F.regexp_extract(column, r"(\d+)", 1).try_cast("long")


def graph_contexts(spark, d, asked=None):
    """Context of every order: what its relations lead to, the relations, and the one-step paths.

    asked (query_id): only those of the orders of these numbers, so that no other order's edges are shuffled."""
    edges = relations(spark, d).filter("src like 'O%'")
    if asked is not None:
        edges = small(edges.join(asked, number("src") == asked["query_id"], "left_semi"), "edges")
    ends = edges.join(entities(spark, d).select(c("id").alias("dst"), "name", c("type").alias("kind"), "description"), "dst")
    near = F.struct("id", c("src").alias("head"), "type", c("dst").alias("tail"), "name", "kind", "description")
    rows = ends.groupBy(c("src").alias("id")).agg(F.array_sort(F.collect_list(near)).alias("rs"))
    es = F.transform("rs", lambda r: F.struct(r["name"].alias("name"), r["kind"].alias("type"), r["description"].alias("description")))
    paths = F.transform("rs", lambda r: F.array(r["head"], r["tail"]))
    return rows.select("id", rt.graph_context(es, c("rs"), paths).alias("context"))


query("ret_11_prompt", _BM25 + ", x AS (SELECT query_id, string_agg(CAST(doc_id AS STRING), ', ' ORDER BY rank) AS context FROM kw WHERE rank <= 5 GROUP BY query_id) SELECT query_id, concat('Answer from the sources only and cite them as [n].', chr(10), chr(10), context, chr(10), chr(10), 'Question: ', query) AS prompt FROM x JOIN q USING (query_id)")(lambda spark, d: prompts(spark, d))


def prompts(spark, d):
    """Prompts over each question's five best documents."""
    listed = keyword_hits(spark, d).filter("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", c("doc_id").cast("string").alias("doc_id")))).alias("hits"))
    text = F.array_join(F.transform("hits", lambda h: h["doc_id"]), ", ")
    return listed.join(queries(spark, d).select("query_id", "query"), "query_id").select("query_id", rt.prompt(c("query"), text).alias("prompt"))


@query("ret_12_batch_context")
def ret_12(spark, d):
    """Hybrid hits, outside rerank scores, context and prompt for a table of questions."""
    hits = small(reranked(spark, d).select("query_id", "doc_id", c("new_rank").alias("rank")), "hits")
    best = hits.join(table(spark, d, "documents").select("doc_id", c("text").alias("content")), "doc_id")
    # The graph side: the question's own node (B and its id) with its relations, here those of the order of that number.
    graphs = graph_contexts(spark, d, small(hits.select("query_id").distinct(), "asked")).select(number("id").alias("query_id"), c("context").alias("graph"))
    made = rt.context(best, budget=1500).join(queries(spark, d).select("query_id", "query"), "query_id").join(graphs, "query_id", "left")
    return made.select("query_id", rt.prompt(c("query"), c("context"), c("graph"), "graph_enhanced").alias("prompt"), F.size("sources").alias("n_sources"), "truncated")
