"""Extraction responses: mentions are not moved again where their documents have been dealt out."""

import difflib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import construct as kg
from loomgraph.plans import QUERIES, constructions

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_are_judged_without_joins(spark):
    r = spark.createDataFrame([(1, 0, 0, "a", "b"), (1, 0, 1, "b", "c"), (1, 1, 0, "a", "b"), (None, 0, 0, "a", "b"), (1, 0, 2, "a", None), (2, 0, 0, "a", "a")], "doc_id long, chunk_id int, ord int, head_key string, tail_key string")
    e = spark.createDataFrame([(1, 0, " A ", "a"), (1, 0, "b.", "b"), (None, 0, "a", "a"), (None, 0, "b", "b"), (3, 0, "a", None)], "doc_id long, chunk_id int, name string, normalized_name string")
    valid, others = kg.validate_relations(r, e)
    assert [tuple(x) for x in valid.collect()] == [(1, 0, 0, "a", "b")]
    assert sorted(map(str, (tuple(x) for x in others.collect()))) == sorted(map(str, [(1, 0, 1, "b", "c"), (1, 1, 0, "a", "b"), (None, 0, 0, "a", "b"), (1, 0, 2, "a", None), (2, 0, 0, "a", "a")]))
    assert "Join" not in plan(valid) + plan(others)


def test_mentions_are_not_shuffled(spark):
    found = kg.dedup_relations(kg.relation_mentions(constructions.responses(spark, SF)))
    whole = kg.dedup_relations(kg.relation_mentions(constructions.responses(spark, SF)), ("doc_id",), 0.0)
    named = kg.dedup_chunk_entities(kg.entity_mentions(constructions.whole_responses(spark, SF)))
    assert [plan(df).count("Exchange hashpartitioning") for df in (found, whole, named)] == [1, 1, 1]


def test_merged_names_are_those_of_the_plain_rule(spark):
    rng, rows = random.Random(3), []
    names = ["Johnson", "Johnsen", "johnson", "Johnston", "John", "Jo", "", "Österreich", "Österreicher", "Osterreich", None]
    for unit in range(60):
        rows += [(unit // 2, unit % 2, i, rng.choice(names), rng.choice(["Person", "Event"]), None, rng.random()) for i in range(rng.choice([1, 5, 30]))]
    mentions = spark.createDataFrame(rows, "doc_id long, chunk_id int, ord int, name string, type string, description string, confidence double").withColumn("normalized_name", F.lower("name"))
    want, kept = [], []
    for doc, chunk, ord_, name, kind, _, _ in rows:
        low = (name or "").lower()
        near = [k for k in kept if k[:4] == [doc, chunk, kind, name and low[:3]] and low and k[4] and difflib.SequenceMatcher(None, k[4], low).ratio() >= 0.85]
        if not near:
            kept.append([doc, chunk, kind, name and low[:3], low, ord_, name, [], 1])
            continue
        near[0][8] += 1
        if name != near[0][6] and name not in near[0][7]:
            near[0][7].append(name)
    want = sorted((k[0], k[1], k[5], k[7], k[8]) for k in kept)
    found = kg.dedup_chunk_entities(mentions)
    assert sorted((r["doc_id"], r["chunk_id"], r["ord"], r["aliases"], r["source_count"]) for r in found.collect()) == want
    assert found.columns == [*mentions.columns, "aliases", "source_count"]


def test_entities_of_responses_are_those_of_their_mentions(spark):
    made = constructions.whole_responses(spark, SF)
    for bound in (None, 0.6):
        want = kg.dedup_chunk_entities(kg.entity_mentions(made)).filter(F.lit(True) if bound is None else F.col("confidence") >= bound)
        found = kg.chunk_entities(made, bound=bound)
        assert found.columns == want.columns and found.count() and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_ends_are_linked_without_joins(spark):
    r = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "a", "x"), (2, 0, "a", "a"), (None, 0, "a", "a"), (1, 2, None, "a"), (3, 0, "a", "a")], "doc_id long, ord int, head_key string, tail_key string")
    e = spark.createDataFrame([(1, "a", "P/a"), (1, "a", "E/a"), (1, "b", "E/b"), (2, "a", "P/a"), (None, "a", "P/a"), (1, None, "P/")], "doc_id long, normalized_name string, id string")
    linked, others = kg.link(r, e)
    assert sorted(tuple(x) for x in linked.collect()) == [(1, 0, "a", "b", "E/a", "E/b"), (2, 0, "a", "a", "P/a", "P/a")]
    assert sorted(str(tuple(x)) for x in others.collect()) == sorted(map(str, [(1, 1, "a", "x", "E/a", None), (None, 0, "a", "a", None, None), (1, 2, None, "a", None, "E/a"), (3, 0, "a", "a", None, None)]))
    assert "Join" not in plan(linked)


def test_a_graph_is_built_where_its_documents_are(spark):
    for name in ("kgc_02_extract_documents", "kgc_03_build_graph", "join_04_link", "agg_17_batch_relations"):
        found = plan(QUERIES[name](spark, SF))
        assert "Join" not in found and "ENSURE_REQUIREMENTS" not in found, name


def test_names_join_the_first_one_like_them():
    rng = random.Random(11)
    # Of 200 characters and more difflib leaves out common ones: the first of these is not even like itself.
    names = ["ab" * 125, "abc" + "".join(chr(97 + n % 26) + str(n) for n in range(90)), "Johnson", "johnson", "Johnsen", "Johnston", "JOHNSONS", "", None, "Jo", "abcd", "abce"]
    for threshold in (0.5, 0.85, 1.0, 1.2):
        unit = np.sort(np.array([rng.randrange(9) for _ in range(250)]))
        kinds, keys = ([rng.choice(x) for _ in unit] for x in (["A", "B", None], names))
        want, kept = [], []
        for i, (u, kind, key) in enumerate(zip(unit.tolist(), kinds, keys, strict=True)):
            low, head = (key or "").lower(), key and key[:3]
            near = [k for k in kept if k[1:4] == (u, kind, head if key is not None else None) and low and k[4] and difflib.SequenceMatcher(None, k[4], low).ratio() >= threshold]
            want.append(near[0][0] if near else i)
            kept += [] if near else [(i, u, kind, head if key is not None else None, low)]
        assert kg._firsts(unit, pa.array(kinds, pa.string()), pa.array(keys, pa.string()), threshold).tolist() == want
    assert kg._firsts(np.array([], int), pa.array([], pa.string()), pa.array([], pa.string()), 0.85).tolist() == []


def test_python_sees_names_once_and_mentions_stay(spark):
    for name in ("agg_13_chunk_entities", "agg_17_batch_relations", "kgc_02_extract_documents"):
        assert plan(QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1, name
    lines = plan(QUERIES["kgc_03_build_graph"](spark, SF)).splitlines()
    moved = [below for line, below in zip(lines, lines[1:], strict=False) if "Exchange" in line and "Scan" not in below]
    assert moved and all("AS kept#" in below and "ms#" not in below.split("AS kept#")[0].rpartition("[")[2] and "es#" not in below for below in moved)


def test_chunks_of_several_responses_and_without_keys(spark):
    say = lambda *names: '{"entities": [' + ", ".join('{"name": "%s", "type": "T", "confidence": 0.9}' % n for n in names) + "]}"
    tie = lambda a, b: '{"relations": [{"head": "%s", "relation": "R", "tail": "%s", "confidence": 0.9}]}' % (a, b)
    rows = [(1, 0, say("alpha", "beta"), tie("Alpha", "beta")), (1, 0, say("gamma", "alphas"), tie("gamma", "beta")), (1, 1, say("delta"), tie("delta", "beta")), (None, 0, say("alpha"), tie("alpha", "alpha")), (2, None, say("alpha"), tie("alpha", "alpha")), (3, 0, None, None), (4, 0, "no {", tie("a", "b"))]
    made = spark.createDataFrame(rows, "doc_id long, chunk_id int, entity_response string, relation_response string")
    for tasks in (None, 3):
        entities, relations = kg.extract_chunks(made if tasks is None else made.repartition(tasks, "doc_id"), tasks=tasks)
        mentions = kg.dedup_chunk_entities(kg.entity_mentions(made)).filter("confidence >= 0.5")
        assert entities.count() == 6 and entities.exceptAll(mentions).isEmpty() and mentions.exceptAll(entities).isEmpty()
        valid = kg.validate_relations(kg.relation_mentions(made), mentions)[0]
        want = kg.dedup_relations(valid).filter("confidence >= 0.7")
        assert relations.count() == 2 and relations.exceptAll(want).isEmpty() and want.exceptAll(relations).isEmpty()
