"""Streams with state that expires, and the stream of message files over restarts."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import messages
from loomgraph.streaming import processing


@pytest.fixture(autouse=True)
def data_batches_only(spark):
    """Processing time always asks for another batch, so that availableNow would not end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def rows_in_state(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def run(spark, build, schema, source, sink, state):
    stream = build(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", sink).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_status_state_falls_after_its_time(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    step = lambda first, to: spark.createDataFrame([(first + d, d, to) for d in range(20)], "message_id long, doc_id long, to string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("message_id")))
    build = lambda rows: processing.status_stream(rows, ttl_ms=4000)
    rows = step(0, "PARSING")
    rows.coalesce(1).write.parquet(source)
    first = run(spark, build, rows.schema, source, sink, state)
    assert rows_in_state(first) >= 20
    time.sleep(5)
    step(100, "CHUNKING").filter("doc_id = 3").coalesce(1).write.mode("append").parquet(source)
    second = run(spark, build, rows.schema, source, sink, state)
    assert rows_in_state(second) <= 2
    # The document had been forgotten: from PENDING, CHUNKING is not allowed.
    assert [(r["status"], r["accepted"]) for r in spark.read.parquet(sink).filter("message_id = 103").collect()] == [("PENDING", False)]


def test_quota_state_falls_after_its_time(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(200).select("id", (F.col("id") % 40).alias("client_id"), F.lit("qa").alias("route"), F.col("id").alias("request_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts")).drop("id")
    build = lambda r: processing.quota_stream(r, ttl_ms=4000)
    rows.coalesce(1).write.parquet(source)
    first = run(spark, build, rows.schema, source, sink, state)
    assert rows_in_state(first) >= 40
    time.sleep(5)
    rows.filter("client_id = 1").withColumn("request_id", F.col("request_id") + 1000).coalesce(1).write.mode("append").parquet(source)
    assert rows_in_state(run(spark, build, rows.schema, source, sink, state)) <= 2
    assert spark.read.parquet(sink).count() == 205


def test_expired_retries_are_dropped(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    steps = [(d * 10 + i, d, to) for d in range(3) for i, to in enumerate(["PARSING", "FAILED"])]
    rows = spark.createDataFrame(steps, "message_id long, doc_id long, to string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("message_id")))
    rows.coalesce(1).write.parquet(source)
    given = {}
    for name, expiry in (("kept", 3_600_000), ("dropped", 1000)):
        sink, place = str(tmp_path / f"out-{name}"), f"{state}-{name}"

        def begin(trigger, expiry=expiry, sink=sink, place=place):
            stream = processing.retry_stream(spark.readStream.schema(rows.schema).parquet(source), expiry_ms=expiry)
            return stream.writeStream.format("parquet").option("path", sink).outputMode("append").option("checkpointLocation", place).trigger(**trigger).start()

        begin({"availableNow": True}).awaitTermination(60)
        # The stream stands still for longer than the expiry, then goes on; after a restart timers wait for new rows.
        time.sleep(3)
        rows.limit(1).withColumn("doc_id", F.lit(99).cast("long")).coalesce(1).write.mode("append").parquet(source)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
        query, deadline = begin({"processingTime": "500 milliseconds"}), time.time() + 60
        while time.time() < deadline and not any(p["stateOperators"] and p["batchId"] >= 1 for p in query.recentProgress):
            time.sleep(0.5)
        query.stop()
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        given[name] = {r["doc_id"] for r in spark.read.schema("doc_id long, retries int, due_ms long").parquet(sink).collect()}
    assert given == {"kept": {0, 1, 2}, "dropped": set()}


def message(n):
    return {"message_id": n, "doc_id": n % 5, "action": "PARSE", "priority": 1, "ts": "2024-01-01T00:00:00Z", "payload": {"n": str(n)}}


def test_message_files_over_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def go():
        stream = messages.message_files(spark, source, ["parse", "chunk", "none"], per_batch=2)
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()

    for piece in range(5):
        for partition in range(3):
            messages.write_messages(source, "parse", partition, f"{piece:05}", [message(piece * 100 + partition * 10 + i) for i in range(4)])
    go()
    seen = sorted(r["message_id"] for r in spark.read.parquet(sink).collect())
    assert seen == sorted(piece * 100 + partition * 10 + i for piece in range(5) for partition in range(3) for i in range(4))
    messages.write_messages(source, "parse", 1, "00005", [message(900)])
    messages.write_messages(source, "chunk", 0, "00000", [message(901), message(902)])
    (tmp_path / "in" / "chunk" / "0-00001.jsonl").write_text("no json\n\n")
    go()
    go()
    got = spark.read.parquet(sink).collect()
    assert sorted(r["message_id"] for r in got if r["message_id"] is not None) == [*seen, 900, 901, 902]
    assert [r["topic"] for r in got if r["message_id"] is None] == ["chunk"]
    assert {r["payload"]["n"] for r in got if r["topic"] == "chunk" and r["payload"]} == {"901", "902"}
