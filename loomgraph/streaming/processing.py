"""Document processing over streams: status machine, retries, routing, duplicates, quotas and counters.

Each stateful rule is a plain function of (state, event), used by the stream and by its batch twin. Streams keep a key's
state as a typed value that expires when the key has had no event for a while; they need the RocksDB state store, which
stateful() sets for the session's later queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Allowed status transitions and request quotas per route in 60 seconds.
TRANSITIONS = {("PENDING", "PARSING"), ("PARSING", "CHUNKING"), ("CHUNKING", "EMBEDDING"), ("EMBEDDING", "COMPLETED"), ("PARSING", "FAILED"), ("CHUNKING", "FAILED"), ("EMBEDDING", "FAILED"), ("FAILED", "PENDING")}
QUOTAS, DEFAULT_QUOTA, QUOTA_MS = {"search": 50, "kg": 30, "qa": 20, "document": 10}, 100, 60_000
ACTIONS = ("FULL_PROCESS", "PARSE", "CHUNK", "EMBED")
MOST_RETRIES, FIRST_DELAY_MS, MOST_DELAY_MS, EXPIRY_MS = 3, 1000, 10_000, 3_600_000

STATUS_OUT = "doc_id long, message_id long, status string, accepted boolean, retries int, retry_at_ms long"
MESSAGE = "message_id long, doc_id long, to string, ts timestamp"


def millis(ts: pd.Timestamp) -> int:
    """Whole milliseconds since 1970, by the session's wall clock as pandas shows it."""
    return ts.value // 1_000_000


def status_step(state: tuple[str, int], to: str, at_ms: int) -> tuple[tuple[str, int], bool, int | None]:
    """(status, retries), accepted, and when a retry is due: a failure is retried at most MOST_RETRIES times."""
    status, retries = state
    if (status, to) not in TRANSITIONS:
        return state, False, None
    if to == "FAILED" and retries < MOST_RETRIES:
        return ("FAILED", retries + 1), True, at_ms + min(FIRST_DELAY_MS * 2**retries, MOST_DELAY_MS)
    return (to, 0 if to == "COMPLETED" else retries), True, None


def _carried(rows: DataFrame, key: list[str], order: str, rows_of: Callable, start, schema: str) -> DataFrame:
    """rows_of(key, frame, state) over each key's rows by (ts, order), a batch at a time: only the state outlives a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for frame in frames:
            for _, part in frame.groupby((frame["_key"] != frame["_key"].shift()).cumsum(), sort=False):
                if part["_key"].iloc[0] != now:
                    now, state = part["_key"].iloc[0], start
                # Keys come from text: a null among whole numbers would make all of them floats.
                found = json.loads(now)
                out, state = rows_of(tuple(found.get(k) for k in key), part, state)
                yield out

    keyed = rows.withColumn("_key", F.to_json(F.struct(*key))).repartition(*key)
    return keyed.sortWithinPartitions(*key, "ts", order).drop(*key).mapInPandas(run, schema)


def _status_rows(doc_id: int, frame: pd.DataFrame, state: tuple[str, int]) -> tuple[pd.DataFrame, tuple[str, int]]:
    out = []
    for message, to, ts in frame.sort_values(["ts", "message_id"])[["message_id", "to", "ts"]].itertuples(index=False):
        state, accepted, due = status_step(state, to, millis(ts))
        out.append((doc_id, message, state[0], accepted, state[1], due))
    return pd.DataFrame(out, columns=["doc_id", "message_id", "status", "accepted", "retries", "retry_at_ms"]).astype({"retry_at_ms": "Int64"}), state


#: State of a key without events for so long is dropped: statuses after a day, quota windows after an hour.
STATUS_TTL_MS, QUOTA_TTL_MS = 86_400_000, 3_600_000


def stateful(rows: DataFrame, key: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """rows by key through a processor whose state expires by processing time.

    Such a stream always asks for another batch: with the trigger availableNow it ends only where
    spark.sql.streaming.noDataMicroBatches.enabled is off."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(*key).transformWithStateInPandas(processor, T.StructType.fromDDL(schema), "Append", "ProcessingTime")


class _Rule(StatefulProcessor):
    """rows_of(key, frame, state) over each key's rows of a batch; the state is a row of `kept`."""

    def __init__(self, rows_of: Callable, kept: str, start: tuple | None, ttl_ms: int):
        self.rows_of, self.kept, self.start, self.ttl_ms = rows_of, kept, start, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kept", self.kept, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else self.start
        out, now = self.rows_of(key, pd.concat(list(rows)), now)
        self.state.update(tuple(now))
        yield out

    def close(self) -> None:
        pass


def status_stream(messages: DataFrame, ttl_ms: int = STATUS_TTL_MS) -> DataFrame:
    """A stream of MESSAGE rows -> every message with the status after it; illegal transitions are reported, not applied.

    A document without messages for ttl_ms starts anew."""
    rule = _Rule(lambda key, frame, state: _status_rows(key[0], frame, state), "status string, retries int", ("PENDING", 0), ttl_ms)
    return stateful(messages, ["doc_id"], rule, STATUS_OUT)


def status_batch(messages: DataFrame) -> DataFrame:
    """The batch twin of status_stream."""
    return _carried(messages, ["doc_id"], "message_id", lambda key, frame, state: _status_rows(key[0], frame, state), ("PENDING", 0), STATUS_OUT)


def progress(statuses: DataFrame) -> DataFrame:
    """doc_id, status, percent, retries: the latest accepted row of each document."""
    percent = F.create_map(*(F.lit(x) for pair in {"PENDING": 0, "PARSING": 25, "CHUNKING": 50, "EMBEDDING": 75, "COMPLETED": 100, "FAILED": 0}.items() for x in pair))
    last = statuses.filter("accepted").groupBy("doc_id").agg(F.max_by(F.struct("status", "retries"), "message_id").alias("last"))
    return last.select("doc_id", "last.status", F.element_at(percent, F.col("last.status")).alias("percent"), "last.retries")


def due_retries(statuses: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose retry is due at `now` (one row, a timestamp), and those whose retry has been due for over EXPIRY_MS.

    statuses: rows of status_batch with the messages' ts; a document's latest accepted row counts."""
    last = statuses.filter("accepted").groupBy("doc_id").agg(F.max_by(F.struct("status", "retries", "retry_at_ms"), F.struct("ts", "message_id")).alias("last"))
    failed = last.select("doc_id", "last.*").filter("status = 'FAILED'").join(F.broadcast(now.select(F.expr("timestampdiff(MILLISECOND, cast('1970-01-01' as timestamp_ntz), cast(now as timestamp_ntz))").alias("now_ms"))))
    at = F.col("retry_at_ms")
    columns = ("doc_id", "retries", "retry_at_ms")
    fresh = at > F.col("now_ms") - EXPIRY_MS
    return failed.filter((at <= F.col("now_ms")) & fresh).select(*columns), failed.filter((at <= F.col("now_ms")) & ~fresh).select(*columns)


class _Retries(StatefulProcessor):
    """Retries of a document, each given once, by a timer set for when it is due."""

    def __init__(self, ttl_ms: int, expiry_ms: int):
        self.ttl_ms, self.expiry_ms = ttl_ms, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", "status string, retries int, due long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, retries, due = tuple(self.state.get()) if self.state.exists() else ("PENDING", 0, -1)
        out, (status, retries) = _status_rows(key[0], pd.concat(list(rows)), (status, retries))
        last = out[out["accepted"]].tail(1)
        if len(last):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            wait = status == "FAILED" and not pd.isna(last["retry_at_ms"].iloc[0])
            due = int(last["retry_at_ms"].iloc[0]) if wait else -1
            if wait:
                # The delay runs from now on, as a message may be read long after it was sent.
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + min(FIRST_DELAY_MS * 2 ** (retries - 1), MOST_DELAY_MS))
        self.state.update((status, retries, due))
        yield pd.DataFrame({"doc_id": [], "retries": [], "due_ms": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, retries, due = tuple(self.state.get()) if self.state.exists() else ("PENDING", 0, -1)
        # A timer that fires long after its time, as after a standstill, is of a retry that has expired.
        late = timerValues.getCurrentProcessingTimeInMs() - expiredTimerInfo.getExpiryTimeInMs() > self.expiry_ms
        if due >= 0:
            self.state.update((status, retries, -1))
        yield pd.DataFrame([(key[0], retries, due)] if due >= 0 and not late else [], columns=["doc_id", "retries", "due_ms"])

    def close(self) -> None:
        pass


def retry_stream(messages: DataFrame, ttl_ms: int = STATUS_TTL_MS, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """A stream of MESSAGE rows -> doc_id, retries, due_ms of every retry, emitted when its time has come.

    A failure that may be retried sets a processing-time timer of its delay; a later accepted message of the document
    clears it. A retry whose timer fires more than expiry_ms late is dropped; a document's state expires after ttl_ms."""
    return stateful(messages, ["doc_id"], _Retries(ttl_ms, expiry_ms), "doc_id long, retries int, due_ms long")


def without_duplicates(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """messages without repeated message ids; of a stream, within the watermark.

    Grouping by doc_id afterwards gives each document to one worker, which is what a lock per document is for."""
    if not messages.isStreaming:
        return messages.dropDuplicates(["message_id"])
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_id"])


def route(messages: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of each action, and those of unknown ones."""
    return {a: messages.filter(F.col("action") == a) for a in ACTIONS}, messages.filter(~F.col("action").isin(*ACTIONS) | F.col("action").isNull())


def quota_step(state: tuple[int, int] | None, at_ms: int, limit: int) -> tuple[tuple[int, int], bool, int]:
    """(window start, used), allowed and what remains; a window opens with the first request after the last one's end."""
    start, used = state if state and at_ms < state[0] + QUOTA_MS else (at_ms, 0)
    allowed = used < limit
    return (start, used + allowed), allowed, max(0, limit - used - allowed)


QUOTA_OUT = "client_id long, route string, request_id long, allowed boolean, remaining int"


def _quota_rows(key: tuple, frame: pd.DataFrame, state):
    out, limit = [], QUOTAS.get(key[1], DEFAULT_QUOTA)
    for request, ts in frame.sort_values(["ts", "request_id"])[["request_id", "ts"]].itertuples(index=False):
        state, allowed, left = quota_step(state, millis(ts), limit)
        out.append((key[0], key[1], request, allowed, left))
    return pd.DataFrame(out, columns=["client_id", "route", "request_id", "allowed", "remaining"]), state


def quota_stream(requests: DataFrame, ttl_ms: int = QUOTA_TTL_MS) -> DataFrame:
    """A stream of client_id, route, request_id, ts -> allowed and remaining of every request.

    A client's window is dropped when there was no request for ttl_ms, which is to be longer than a window and any lag."""
    return stateful(requests, ["client_id", "route"], _Rule(_quota_rows, "start long, used int", None, ttl_ms), QUOTA_OUT)


def quota_batch(requests: DataFrame) -> DataFrame:
    return _carried(requests, ["client_id", "route"], "request_id", _quota_rows, None, QUOTA_OUT)


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """day, action, n over event time; late rows beyond the delay are left out of a stream."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count("*").alias("n")).select(F.to_date("w.start").cast("string").alias("day"), "action", "n")


def parsed(raw: DataFrame) -> DataFrame:
    """Processing messages from rows of value (JSON, bytes or text) and topic."""
    schema = T.StructType.fromDDL("message_id long, doc_id long, action string, priority int, ts timestamp, payload map<string,string>")
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m"), "topic").select("m.*", "topic")


def kafka_messages(spark, servers: str, topics: list[str]) -> DataFrame:
    """Processing messages from Kafka; a file source of value and topic gives the same through `parsed`."""
    return parsed(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).load())
