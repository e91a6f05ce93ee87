"""The stored keyword and vector indexes: same rows as a search without one, and how much of them is looked at."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import keyword_index, retrieval, vector_index


def rows_of(found):
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Two languages that share three words, documents with nulls, empty ones and equal ones."""
    rng = random.Random(4)
    words = {lang: [f"{lang}{n}" for n in range(400)] for lang in "ab"}
    rows = []
    for n in range(900):
        lang = "ab"[n % 2]
        text = " ".join(rng.choice(words[lang][: rng.choice([20, 400])]) for _ in range(rng.randint(1, 60))) + rng.choice(["", " the", " THE the of", " 中文"])
        rows.append((n, text, text.split()[:3], [lang], lang))
    rows += [(900, None, None, None, None), (901, "", [], [], "a"), (902, rows[5][1], rows[5][2], ["a"], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, content string, title array<string>, keywords array<string>, lang string")
    asked = [(n, " ".join(rng.choice(words["ab"[n % 2]][:60]) for _ in range(6)) + (" the 中" if n % 3 else "")) for n in range(12)] + [(20, rows[5][1]), (21, ""), (22, "nothing here"), (23, None)]
    return docs, spark.createDataFrame(asked, "query_id long, query string")


@pytest.fixture(scope="module")
def keyword(corpus, tmp_path_factory):
    return keyword_index.write_index(corpus[0], f"{tmp_path_factory.mktemp('keywords')}/index", buckets=8, block=16, together="lang")


@pytest.mark.parametrize("top_k", [5, 100])
def test_keyword_search_skips_blocks_and_changes_nothing(corpus, keyword, top_k):
    docs, queries = corpus
    want, seen = rows_of(retrieval.bm25(queries, docs, top_k=top_k)), {}
    assert rows_of(keyword_index.search(queries, keyword, top_k, skip=True, seen=seen)) == want
    assert rows_of(keyword_index.search(queries, keyword, top_k, skip=False)) == want
    if top_k == 5:
        assert seen["scored"] < 0.8 * seen["pairs"]


def test_keyword_search_of_allowed_documents(corpus, keyword):
    docs, queries = corpus
    allowed = docs.filter("doc_id % 3 = 0")
    want = rows_of(keyword_index.search(queries, keyword, 900, skip=False).filter("doc_id % 3 = 0").drop("rank").withColumn("rank", F.lit(0)))
    for skip in (False, True):
        assert [r[:3] for r in rows_of(keyword_index.search(queries, keyword, 900, allowed=allowed, skip=skip))] == [r[:3] for r in want]


def test_keyword_search_reads_the_asked_buckets(spark, keyword):
    terms = spark.createDataFrame([(1, "a3")], "query_id long, term string")
    plan = keyword_index.asked_rows(keyword, terms)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)
    assert keyword_index.asked_rows(keyword, terms).select("bucket").distinct().count() == 1


def test_term_statistics_of_the_index(corpus, keyword):
    postings, totals = retrieval.term_statistics(corpus[0])
    want = sorted((r["term"], r["df"], r["total"]) for r in postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).collect())
    assert sorted((r["term"], r["df"], r["total"]) for r in keyword.terms.filter("field = 'content'").collect()) == want
    known = keyword.fields.filter("field = 'content'").first()
    assert known["docs"] == 903 and abs(known["avgdl"] - totals.first()["avgdl"] * 1) < 0.1


def clustered(spark, n, groups, d=32):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, d))
    rows = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "doc_id long, embedding array<float>").repartition(4)


def recall(got, want):
    pairs = lambda found: {(r["query_id"], r["doc_id"]) for r in found.collect()}
    exact = pairs(want)
    return len(pairs(got) & exact) / len(exact)


def test_vectors_in_groups_are_found_in_a_few_cells(spark, tmp_path):
    rows = clustered(spark, 4000, 40)
    asked = rows.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    written = vector_index.write_index(rows, f"{tmp_path}/index")
    index, codes = vector_index.read_index(spark, f"{tmp_path}/index")
    assert np.array_equal(index.centres, written.centres) and index.probe == written.probe
    got = vector_index.search_index(asked, rows, codes, index)
    assert recall(got, retrieval.cosine_top_k(asked, rows, 10)) >= 0.9
    # Codes looked at: those of the probed cells; full vectors: the short lists.
    held = dict(codes.groupBy("cell").count().collect())
    units = vector_index.unit_rows(asked.toPandas()["embedding"])
    cells = np.argsort(-(units @ index.centres.T), axis=1)[:, : index.probe]
    assert np.mean([sum(held.get(int(c), 0) for c in row) for row in cells]) <= 0.1 * 4000
    assert vector_index.short_list(asked, codes, index, 100).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 0.1 * 4000


def test_vectors_anywhere_need_few_full_vectors(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(1500, 64)))] + [(5000, None)], "doc_id long, embedding array<float>").repartition(4)
    asked = rows.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = vector_index.approximate_top_k(asked, rows)
    assert recall(got, retrieval.cosine_top_k(asked.filter("embedding is not null"), rows.filter("embedding is not null"), 10)) >= 0.9


def test_cells_are_split_and_nothing_is_lost(spark, monkeypatch):
    rows = clustered(spark, 600, 3)
    asked = rows.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = vector_index.fit_index(rows, cells=4)
    codes = vector_index.coded(rows, index)
    once = rows_of(vector_index.search_index(asked, rows, codes, index, keep=600, probe=4))
    monkeypatch.setattr(vector_index, "PART", 50)
    monkeypatch.setattr(vector_index, "QUERY_PART", 3)
    assert rows_of(vector_index.search_index(asked, rows, codes, index, keep=600, probe=4)) == once == rows_of(retrieval.cosine_top_k(asked, rows, 10))


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    assert vector_index.approximate_top_k(none.withColumnRenamed("doc_id", "query_id"), none).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, embedding array<float>")
    assert rows_of(vector_index.approximate_top_k(one.withColumnRenamed("doc_id", "query_id"), one)) == [(1, 1, 1.0, 1)]


def test_documents_are_shuffled_once_and_their_words_never(spark):
    """The writer's groupings by document and by block run where the blocks are: one exchange, of documents."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7}") for i in range(300)], "doc_id long, content string")
    words = F.array(F.struct(F.lit("content").alias("field"), F.split("content", " ").alias("words")))
    grouped = keyword_index.by_block(docs.withColumn("block", F.col("doc_id") % 5), words, "doc_id", 3)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    held = {(r["term"], r["block"]): [h["k"] for h in r["held"]] for r in grouped.collect()}
    assert held["alpha", 2] == held[None, 2] == list(range(2, 300, 5))


def test_postings_of_blocks_without_a_query_are_not_shuffled(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}") for i in range(400)], "doc_id long, content string")
    index = keyword_index.write_index(docs, str(tmp_path / "index"), ("content",), block=16)
    terms = spark.createDataFrame([(1, "alpha")], "query_id long, term string")
    rows = keyword_index.asked_rows(index, terms)
    bounds = keyword_index.bounds(rows, terms)
    pairs = spark.createDataFrame(bounds.orderBy("block").limit(2).collect(), bounds.schema)
    assert rows.select("block").distinct().count() > 2
    found = keyword_index._scorer

    def scorer(*of):
        score = found(*of)

        def checked(asked, postings):
            assert postings["block"].nunique() <= 2
            return score(asked, postings)

        return checked

    monkeypatch.setattr(keyword_index, "_scorer", scorer)
    assert 0 < keyword_index.scored(rows, pairs, terms, "doc_id", 100).count() <= 100
