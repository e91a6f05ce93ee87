"""Streams against their batch twins, the corner rules of text and graph functions, and the registered queries."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions import text as tx
from loomgraph.operators import construct, graph, retrieval, vector_index
from loomgraph.sources import registry as sources
from loomgraph.streaming import processing

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["agg_01_entity_stats", "agg_10_quality_report", "flt_03_list_entities", "join_09_access_review", "grf_03_shortest_paths", "txt_05_fixed_chunks", "ret_05_rrf", "agg_15_chunk_relations"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF).select(*want.columns)
    plain = lambda rows: sorted(tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got.collect()) == plain(want.fetchall())


def run_stream(spark, rows, path, name, build):
    """The stream over rows in two runs, the earlier half first, with one checkpoint."""
    # Processing time always asks for another batch, so that availableNow would not end.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, sink = str(path / name), str(path / f"{name}-out")
    middle = rows.count() // 2
    order = [c for c in ("message_id", "request_id") if c in rows.columns][0]
    numbered = sorted(r[0] for r in rows.select(order).collect())
    for half in (F.col(order) < numbered[middle], F.col(order) >= numbered[middle]):
        rows.filter(half).coalesce(1).write.mode("append").parquet(source)
        query = build(spark.readStream.schema(rows.schema).parquet(source)).writeStream.format("parquet").option("path", sink).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{sink}-state").start()
        query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(sink)


def test_status_stream_equals_batch(spark, tmp_path):
    steps = ["PARSING", "COMPLETED", "FAILED", "PENDING", "PARSING", "CHUNKING", "EMBEDDING", "COMPLETED"]
    rows = spark.createDataFrame([(d * 10 + i, d, s) for d in range(4) for i, s in enumerate(steps)], "message_id long, doc_id long, to string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(60)))
    batch = {tuple(r) for r in processing.status_batch(rows).collect()}
    got = {tuple(r) for r in run_stream(spark, rows, tmp_path, "statuses", processing.status_stream).collect()}
    assert got == batch
    first = sorted((r for r in batch if r[0] == 0), key=lambda r: r[1])
    assert [r[2] for r in first] == ["PARSING", "PARSING", "FAILED", "PENDING", "PARSING", "CHUNKING", "EMBEDDING", "COMPLETED"]
    assert [r[3] for r in first] == [True, False, True, True, True, True, True, True]


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 2).alias("client_id"), F.lit("document").alias("route"), F.col("id").alias("request_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    batch = {tuple(r) for r in processing.quota_batch(rows).collect()}
    got = {tuple(r) for r in run_stream(spark, rows, tmp_path, "quotas", processing.quota_stream).collect()}
    assert got == batch and any(not r[3] for r in batch)


def test_text_rules(spark):
    row = spark.range(1).select(
        tx.clean(F.lit("  多余  空格 @#$% ")).alias("clean"),
        tx.normalize(F.lit("a\r\n\r\n\r\n\r\nb\r ")).alias("normal"),
        tx.markdown(F.lit("---\ntitle: T: x\n---\n# A\ntext\n## B")).alias("md"),
        tx.references(F.lit("x [1] y [12]")).alias("refs"),
        tx.annotate(F.lit("The quick brown fox jumps"), F.array(F.lit("quick brown fox. no"))).alias("noted"),
    ).first()
    assert row["clean"] == "多余 空格" and row["normal"] == "a\n\nb" and row["refs"] == [1, 12]
    assert row["md"]["metadata"] == {"title": "T: x"} and [h["level"] for h in row["md"]["headings"]] == [1, 2]
    assert row["noted"] == "The quick brown fox[1] jumps"


def test_graph_rules(spark):
    edges = spark.createDataFrame([("a", "1", "2", "T", 0.9), ("b", "2", "3", "T", 0.8), ("c", "4", "5", "T", 0.5), ("d", "3", "1", "U", None)], "id string, src string, dst string, type string, confidence double")
    nodes = spark.createDataFrame([(str(i), f"n{i}", "X") for i in range(1, 6)], "id string, name string, type string")
    seed = nodes.filter("id = '1'").select("id")
    assert {r["id"]: r["hops"] for r in graph.bfs(edges, nodes, seed).collect()} == {"1": 0, "2": 1, "3": 1}
    assert {r["id"]: r["hops"] for r in graph.bfs(edges, nodes, seed, min_confidence=0.1).collect()} == {"1": 0, "2": 1, "3": 2}
    assert all(len(set(r["edges"])) == len(r["edges"]) for r in graph.trails(edges, seed, 3).collect())


def test_greedy_names(spark):
    rows = spark.createDataFrame([(1, 0, i, n, "Person", None, 0.9, n.lower()) for i, n in enumerate(["Johnson", "Johnsen", "Miller", "Johnson"])], "doc_id long, chunk_id int, ord int, name string, type string, description string, confidence double, normalized_name string")
    got = {r["name"]: (r["source_count"], r["aliases"]) for r in construct.dedup_chunk_entities(rows).collect()}
    assert got == {"Johnson": (3, ["Johnsen"]), "Miller": (1, [])}


def test_approximate_search_recall(spark):
    """At the registered setting: recall of the ten nearest against the exact search."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = rows.filter("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["doc_id"]) for r in retrieval.cosine_top_k(asked, rows, 10).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in vector_index.approximate_top_k(asked, rows, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_vector_search_ties_and_steps(spark, monkeypatch):
    """Equal scores go by key, over steps and tasks; doc_ids keeps to the asked documents."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0])], "query_id long, embedding array<double>")
    got = retrieval.cosine_top_k(asked, rows.repartition(3), 4).orderBy("query_id", "rank").collect()
    assert [r["doc_id"] for r in got] == [0, 3, 6, 9, 2, 5, 8, 11]
    few = retrieval.cosine_top_k(asked, rows, 4, doc_ids=[4, 5, 6]).orderBy("query_id", "rank").collect()
    assert [r["doc_id"] for r in few] == [6, 4, 5, 5, 4, 6]


def test_subgraph_and_limits(spark):
    edges = spark.createDataFrame([("a", "1", "2", "T", 0.9), ("b", "2", "3", "T", 0.8), ("c", "3", "4", "T", 0.5), ("d", "1", "5", "T", 0.5)], "id string, src string, dst string, type string, confidence double")
    nodes = spark.createDataFrame([(str(i), f"n{i}", "X") for i in range(1, 7)], "id string, name string, type string")
    seed = nodes.filter("id = '1'").select("id")
    ids = lambda of: (sorted(r["id"] for r in of[0].collect()), sorted(r["id"] for r in of[1].collect()))
    assert ids(graph.subgraph(edges, nodes, seed)) == (["1", "2", "5"], ["a", "d"])
    assert ids(graph.subgraph(edges, nodes, seed, depth=0)) == (["1"], ["a", "d"])
    assert ids(graph.subgraph(edges, nodes, seed, depth=2, expand=True)) == (["1", "2", "3", "5"], ["a", "b", "d"])
    assert ids(graph.subgraph(edges, nodes, seed, include_relations=False)) == (["1"], [])
    assert ids(graph.subgraph(edges, nodes, seed.filter("false"))) == ([], [])
    assert sorted(r["id"] for r in graph.bfs(edges, nodes, seed, limit=2).collect()) == ["1", "2"]
    assert graph.bfs(edges, nodes, seed, limit=1).count() == 1


def test_evidence_chain_without_paths(spark):
    wide = "array<long>"
    edges = spark.createDataFrame([("a", "1", "2", "T", 0.8, [5, 6])], f"id string, src string, dst string, type string, confidence double, source_docs {wide}")
    nodes = spark.createDataFrame([(str(i), f"n{i}", "X", [i]) for i in range(1, 4)], f"id string, name string, type string, source_docs {wide}")
    got = {r["seed"]: r for r in graph.evidence_chains(edges, nodes, nodes.select("id")).collect()}
    assert got["1"]["documents"] == [1, 2, 5, 6] and len(got["1"]["paths"]) == 1 and got["1"]["start"]["name"] == "n1"
    assert got["3"]["paths"] == [] and got["3"]["confidence"] == 0 and got["3"]["documents"] == []
    paths = graph.evidence_paths(edges, nodes.filter("id = '1'").select("id"))
    links = {r["key"]: r["documents"] for r in graph.linked_documents(paths, edges, nodes, [2, 5]).collect()}
    assert links == {"1": [], "2": [2], "1_T_2": [5]}


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\r\n\r\n\r\n\r\nbody\r\n## Part\r\n")
    (tmp_path / "b.log").write_text("  plain\rtext ")
    got = {r["path"].rsplit("/", 1)[1]: r for r in sources.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.md"]["doc_type"] == "md" and got["a.md"]["content"] == "# Title\n\nbody\n## Part"
    assert [h["text"] for h in got["a.md"]["headings"]] == ["Title", "Part"]
    assert got["b.log"]["doc_type"] == "txt" and got["b.log"]["content"] == "plain\ntext" and got["b.log"]["headings"] is None


def test_messages_from_a_file_source(spark, tmp_path):
    raw = [('{"message_id": 1, "doc_id": 7, "action": "PARSE", "priority": 2, "ts": "2024-01-01T00:00:00Z", "payload": {"a": "b"}}', "parse"), ("no json", "chunk")]
    spark.createDataFrame(raw, "value string, topic string").write.parquet(str(tmp_path / "raw"))
    stream = processing.parsed(spark.readStream.schema("value string, topic string").parquet(str(tmp_path / "raw")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r["topic"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got["parse"]["message_id"], got["parse"]["doc_id"], got["parse"]["action"], got["parse"]["payload"]) == (1, 7, "PARSE", {"a": "b"})
    assert got["chunk"]["message_id"] is None


def test_repeated_messages_are_dropped_once_each(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 25).alias("message_id"), (F.col("id") % 5).alias("doc_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    assert sorted(r["message_id"] for r in processing.without_duplicates(rows).collect()) == list(range(25))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = processing.without_duplicates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["message_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(25))


def test_due_retries(spark):
    at = "timestamp_ntz'2024-01-01 10:00:00'"
    steps = [(1, 1, "PARSING", 0), (2, 1, "FAILED", 1), (3, 2, "PARSING", 0), (4, 2, "FAILED", 2), (5, 2, "PENDING", 3), (6, 3, "PARSING", 0), (7, 3, "FAILED", 7000)]
    sent = spark.createDataFrame(steps, "message_id long, doc_id long, to string, s int").selectExpr("message_id", "doc_id", "to", f"{at} + make_dt_interval(0, 0, 0, s) AS ts")
    statuses = processing.status_batch(sent).join(sent.select("message_id", "ts"), "message_id")
    seen = lambda s: tuple([r["doc_id"] for r in part.collect()] for part in processing.due_retries(statuses, spark.sql(f"SELECT {at} + make_dt_interval(0, 0, 0, {s}) AS now")))
    assert seen(1) == ([], []) and seen(3) == ([1], []) and seen(7001) == ([3], [1])


def test_retry_stream_emits_when_due(spark, tmp_path):
    steps = [(1, 1, "PARSING"), (2, 1, "FAILED"), (3, 2, "PARSING")]
    rows = spark.createDataFrame(steps, "message_id long, doc_id long, to string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = processing.retry_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("due_retries").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("due_retries").count():
            time.sleep(0.5)
    finally:
        query.stop()
    assert [tuple(r)[:2] for r in spark.table("due_retries").collect()] == [(1, 1)]


def test_seconds_keep_their_milliseconds():
    import pandas as pd

    assert processing.millis(pd.Timestamp("2024-01-07 09:54:00.903999")) % 1000 == 903


def test_construction_reads_whole_documents_of_all_languages(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: [("".join(rng.choices(letters, k=9))) for _ in range(400)] for i, letters in ((1, "abcdefghijklmnop"), (2, "абвгдежзиклмнопр"), (3, "abcdefghijklmnop"))}
    rows = [(i, " ".join(words), lang) for (i, words), lang in zip(texts.items(), ("en", "ru", "de"), strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["kgc_02_extract_documents"](spark, str(tmp_path)).collect()
    for i, words in texts.items():
        assert set(words) <= {r["normalized_name"] for r in found if r["doc_id"] == i}
    graph_rows = __spark_entry__.queries()["kgc_03_build_graph"](spark, str(tmp_path)).count()
    assert graph_rows > 300


def test_batches_of_one_key_carry_its_state(spark, monkeypatch):
    """No call holds more rows of a key than a batch, and the results are those of all rows at once."""
    events = spark.range(500).selectExpr("case when id % 5 = 0 then null when id % 5 = 1 then 2 else 1 end AS client_id", "'document' AS route", "id AS request_id", "timestamp_seconds(id * 3) AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    whole = processing._quota_rows

    def small(key, frame, state):
        assert len(frame) <= 40
        return whole(key, frame, state)

    monkeypatch.setattr(processing, "_quota_rows", small)
    try:
        got = {r["request_id"]: (r["client_id"], r["allowed"], r["remaining"]) for r in processing.quota_batch(events).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, states = {}, {}
    for i in range(500):
        client = None if i % 5 == 0 else 2 if i % 5 == 1 else 1
        states[client], allowed, left = processing.quota_step(states.get(client), i * 3000, 10)
        want[i] = (client, allowed, left)
    assert got == want


def test_every_part_is_a_mention(spark):
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert {r["mention_id"] for r in __spark_entry__.queries()["kgc_04_resolve"](spark, SF).collect()} == parts
    assert __spark_entry__.queries()["agg_23_resolution_accuracy"](spark, SF).first()["total"] == len(parts)
