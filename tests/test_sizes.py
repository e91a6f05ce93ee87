"""What once grew faster than its input: rows that many share are worked out once, and names are not shuffled to be told apart."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import construct, filters, graph, operations, retrieval
from loomgraph.plans import QUERIES, fixtures, searches

from .conftest import SF
from .test_extraction import plan


def test_relations_are_those_of_their_sql_and_shuffled_as_numbers(spark):
    found = fixtures.relations(spark, SF)
    want = fixtures.derived(spark, SF, fixtures.RELATIONS)
    assert found.schema == want.schema and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert "hashpartitioning(concat" not in plan(found) and "hashpartitioning(src" not in plan(found)
    assert "hashpartitioning(l_orderkey" in plan(found)


def test_queries_of_the_same_words_are_scored_once(spark, monkeypatch):
    seen = []
    ranked = retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda scores, *a: seen.append(scores) or ranked(scores, *a))
    names = ["red ring", "ring red", "Red RING red", "blue bolt", "", None]
    q = spark.createDataFrame([(n, names[n % 6]) for n in range(60)], "query_id long, query string")
    docs = spark.createDataFrame([(n, names[n % 4]) for n in range(40)], "doc_id long, name string")
    found = {}
    for r in retrieval.bm25(q, docs, ("name",), 3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
    alone = {}
    for n in range(4):
        alone[n] = sorted((r["rank"], r["doc_id"], round(r["score"], 9)) for r in retrieval.bm25(q.filter(f"query_id = {n}"), docs, ("name",), 3).collect())
    assert {k: sorted(v) for k, v in found.items()} == {n: alone[n % 6] for n in range(60) if n % 6 < 4}
    assert seen[0].count() == 30 + 10


def test_mentions_of_one_name_and_context_are_scored_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(construct, "written", lambda df, name: seen.append((name, df.count())) or df)
    names = ["red ring", "Red Ring!", "big red rings", None]
    m = spark.createDataFrame([(n, names[n % 4], None, "near a ring" if n % 3 else None) for n in range(120)], "mention_id long, name string, type string, context string")
    e = spark.createDataFrame([(f"P{n}", names[n % 3], "a ring", {"k": "red"}) for n in range(9)], "id string, name string, description string, properties map<string,string>")
    found = construct.ranked_candidates(m, e, top_n=2)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["mention_id"], []).append((r["rank"], r["entity_id"], r["score"]))
    assert sorted(rows) == [n for n in range(120) if n % 4 < 3]
    alone = construct.ranked_candidates(m.filter("mention_id = 1"), e, top_n=2).collect()
    assert sorted(rows[1]) == sorted((r["rank"], r["entity_id"], r["score"]) for r in alone)
    assert all(sorted(got) == sorted(rows[n % 12]) for n, got in rows.items())
    assert dict(seen)["best"] <= 2 * 6 and found.schema.names == ["mention_id", "entity_id", "score", "rank"]


def test_trails_are_counted_without_a_row_for_each(spark, monkeypatch):
    rng, listed = random.Random(8), []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: listed.append(write(df, name)) or listed[-1])
    # A small dense graph with loops and several edges between two nodes, and a hub with 300 neighbours of its own.
    ends = [(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(14)] + [("a", "h"), ("a", "h"), ("b", "h"), ("y", "h"), ("z", "y")] + [(f"l{n}", "h") for n in range(300)]
    r = spark.createDataFrame([(f"e{n}", a, b, "T", 1.0) for n, (a, b) in enumerate(ends)], "id string, src string, dst string, type string, confidence double")
    seeds = spark.createDataFrame([(x,) for x in "abcdefyzq"], "id string")
    for hops in (1, 2, 3):
        whole = graph.trails(r, seeds, hops, exact=True).groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ends"))
        want = {tuple(x) for x in whole.collect()}
        listed.clear()
        assert {tuple(x) for x in graph.trail_counts(r, seeds, hops).collect()} == want
        if hops == 2:
            names = {tuple(t.columns) for t in listed}
            assert ("seed", "far") in names and max(t.filter("far like 'l%'").count() for t in listed if "seed" in t.columns and "far" in t.columns) < 300


def test_edges_of_other_nodes_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_NODES", 3)
    steps = spark.createDataFrame([(f"n{n % 50}", f"m{n}", f"e{n}", 1.0) for n in range(500)], "near string, far string, edge string, confidence double")
    for few in (True, False):
        level = spark.createDataFrame([("s", f"n{n}") for n in range(3 if few else 4)], "seed string, id string")
        found = graph.grown_by(level, steps)
        assert sorted(tuple(x) for x in found.collect()) == sorted((f"n{n % 50}", "s", f"m{n}", f"e{n}", 1.0) for n in range(500) if n % 50 < (3 if few else 4))
        assert ("LeftSemi" in plan(found)) == few


def test_a_subgraph_shuffles_the_edges_it_meets(spark, monkeypatch):
    rng, listed, write = random.Random(4), [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: listed.append((name, df)) or write(df, name))
    ends = [(rng.choice("abcdefghijkl"), rng.choice("abcdefghijkl")) for _ in range(40)] + [(None, "a"), ("b", None)]
    rows = [(f"e{n:02}", a, b, "T", 0.5) for n, (a, b) in enumerate(ends)]
    r = spark.createDataFrame(rows, "id string, src string, dst string, type string, confidence double")
    e = spark.createDataFrame([(x,) for x in "abcdefghijklm"], "id string")
    seeds = spark.createDataFrame([("a",), ("m",), ("a",), (None,)], "id string")
    for most in (1_000_000, 2):
        monkeypatch.setattr(graph, "MOST_NODES", most)
        for depth, expand, cap in ((0, False, 3), (1, False, 3), (2, True, 3), (3, True, 2), (2, False, 99)):
            at, edges, ids = {"a", "m"}, set(), {"a", "m"}
            for hop in range(max(1, depth if expand else 1)):
                met = {x for n in at for x in [x for x in rows if n == x[1] or n == x[2] and x[1]][:cap]}
                edges |= met
                at = {n for x in met for n in x[1:3]} - ids - {None}
                ids |= at if depth > hop else set()
            listed.clear()
            nodes, found = graph.subgraph(r, e, seeds, cap, depth=depth, expand=expand)
            assert sorted(x["id"] for x in nodes.collect()) == sorted(ids)
            assert sorted(tuple(x) for x in found.collect()) == sorted(edges, key=lambda x: x[0])  # without a start no edge is walked
            assert [name for name, _ in listed].count("edges") == (depth if expand else 1)
    # However many the nodes, edges go to them unshuffled, and both ways of an edge come from one reading of it.
    steps, nodes = filters.oriented(fixtures.relations(spark, SF)), write(e, "nodes")
    assert "SortMergeJoin" not in plan(graph.edges_at(steps, nodes)) and plan(steps).count("l_orderkey") == plan(fixtures.relations(spark, SF)).count("l_orderkey")


def test_documents_that_no_question_found_are_not_shuffled(spark):
    asked = spark.createDataFrame([(n,) for n in (1, 2, 3, 10_000_000)], "query_id long")
    some = searches.graph_contexts(spark, SF, asked)
    want = searches.graph_contexts(spark, SF).filter("id in ('O1', 'O2', 'O3')")
    assert some.count() and some.exceptAll(want).isEmpty() and want.exceptAll(some).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(QUERIES["ret_12_batch_context"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(doc_id" not in found and "hashpartitioning(dst" not in found


def test_a_review_is_dealt_out_by_its_own_size(spark, monkeypatch):
    monkeypatch.setattr(operations, "REVIEW_ROWS", 200)
    users = spark.createDataFrame([(n, (n or 1) % 9 == 0) for n in [*range(150), 3, None]], "user_id long, deleted boolean")
    held = spark.createDataFrame([(n, n % 3 if n < 20 else 1) for n in range(150)] + [(4, 2), (4, 2), (None, 1), (5, None)], "user_id long, role_id long")
    roles = spark.createDataFrame([(0, False, True), (1, False, True), (2, False, False), (3, True, True)], "role_id long, deleted boolean, enabled boolean")
    gives = spark.createDataFrame([(n % 3, n) for n in range(90)] + [(1, 4), (1, None)], "role_id long, permission_id long")
    codes = spark.createDataFrame([(n, None if n == 7 else f"p{n // 2}", n % 10 == 0) for n in range(90)], "permission_id long, code string, deleted boolean")
    found = operations.access_review(users, held, roles, gives, codes)
    want = {(u, None if p == 7 else f"p{p // 2}") for u in range(150) if (u or 1) % 9 for r in {u % 3 if u < 20 else 1} - {2} for p in range(r, 90, 3) if p % 10}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = [len(x) for x in found.rdd.glom().collect()]
    assert len(sizes) > 20 and max(sizes) < len(want) / 2


def test_a_merge_deals_both_tables_out_once(spark):
    stored = spark.createDataFrame([("a", "old", 1.0, {"x": "1"}), ("b", "old", None, None), ("b", "twice", 2.0, None), ("c", "old", 3.0, None), (None, "old", 4.0, None)], "id string, name string, score double, properties map<string,string>").withColumn("updated_at", F.lit(None).cast("timestamp"))
    came = spark.createDataFrame([("a", None, 9.0, {"y": "2"}, 1), ("b", "less", 8.0, None, 1), ("b", "new", 7.0, None, 3), ("b", "none", 6.0, None, None), ("d", "new", None, None, 1), (None, "less", 5.0, None, 1), (None, "new", 5.0, None, 2)], "id string, name string, score double, properties map<string,string>, version int").withColumn("other", F.lit(1))
    merged = operations.upsert(stored, came, now="2026-01-01")
    got = sorted((str(r["id"]), r["name"], r["score"], sorted(r["properties"].items()), r["updated_at"] is not None) for r in merged.collect())
    want = [("None", "new", 5.0, [], False), ("None", "old", 4.0, [], False), ("a", "old", 9.0, [("x", "1"), ("y", "2")], True), ("b", "new", 7.0, [], True), ("b", "new", 7.0, [], True), ("c", "old", 3.0, [], False), ("d", "new", None, [], True)]
    assert got == want and merged.columns == stored.columns
    ids = plan(merged.groupBy("name").agg(F.countDistinct("id"), F.count("updated_at")))
    assert "Join" not in ids and ids.count("Exchange hashpartitioning(id") == 1
