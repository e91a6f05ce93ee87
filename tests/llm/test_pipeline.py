"""The pipeline's stages against plain Python, on the smallest tables and on edge cases."""

import corpus_pipeline as cp
import pytest

from loomgraph.llm import toxicity
from tests.conftest import SF

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.learned(spark, SF)
    calm = cp.drop_toxic(spark, docs, SF)
    assert ids(calm) == sorted(i for i, t in rows if model.score(t or "") < toxicity.THRESHOLD) and calm.columns == docs.columns
    linked = brute.links([t for _, t in rows])
    parent = {t: t for _, t in rows}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in map(tuple, linked):
        parent[root(a)] = root(b)
    least = {}
    for i, t in sorted(rows):
        least.setdefault(root(t), i)
    kept = cp.keep_one_of_near_copies(spark, docs, SF)
    assert ids(kept) == sorted(least.values()) and kept.columns == docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(cp.drop_contaminated(spark, docs, SF)) == sorted(r[0] for r in brute.decontaminate(rows, items) if not r[-1])
    masked = {r["doc_id"]: r["text"] for r in cp.mask_secrets(spark, docs, SF).collect()}
    assert all((masked[i] == t) == (brute.base_secrets(t) == "") for i, t in rows if "[SECRET]" not in t)


def test_edges_pass_through(spark, edges, empty):
    found = edges
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        found = stage(spark, found, SF)
        assert found.columns == edges.columns
    assert found.filter("doc_id in (5, 6, 7)").count() == 1
    assert found.filter("text is null or text = ''").count() == 1
    assert cp.STAGES[-1][1](spark, found, SF).count() == found.count()


def test_run(spark, docs):
    out = cp.run(spark, SF)
    assert 0 < out.count() <= docs.count() and out.filter("n_tokens is null").count() == 0
