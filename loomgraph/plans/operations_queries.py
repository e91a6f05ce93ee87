"""Queries over sources and the batch twins of the streaming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations
from ..sources import registry as sources
from ..streaming import processing
from .catalog import query
from .fixtures import table

c = F.col


@query("src_01_register_documents", "SELECT sha256(text) AS content_hash, CASE min(doc_id) % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' ELSE 'txt' END AS doc_type, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text <> '' GROUP BY text HAVING true")
def src_01(spark, d):
    suffix = F.when(c("doc_id") % 4 == 0, ".PDF").when(c("doc_id") % 4 == 1, ".doc").when(c("doc_id") % 4 == 2, ".markdown").otherwise("")
    none = F.lit(None).cast("string")
    files = table(spark, d, "documents").select(F.concat(F.lpad(c("doc_id").cast("string"), 12, "0"), suffix).alias("name"), c("text").cast("binary").alias("content"), F.lit("text/plain").alias("mime"), c("source").alias("category"), none.alias("tags"), none.alias("access_level"))
    return sources.register_documents(files)[0].select("content_hash", "doc_type", c("size").cast("long").alias("size"))


@query("src_05_cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 4)")
def src_05(spark, d):
    turns = table(spark, d, "conversations")
    return operations.delete_cascade(turns.filter("turn = 4").select(c("conv_id").alias("id")), (turns, "conv_id"))[0].select("conv_id", "turn")


def messages(spark, d):
    states = F.array(*map(F.lit, ("PARSING", "CHUNKING", "EMBEDDING", "COMPLETED", "FAILED", "PENDING")))
    return table(spark, d, "events").select(c("event_id").alias("message_id"), c("user_id").alias("doc_id"), F.element_at(states, (c("event_id") % 6 + 1).cast("int")).alias("to"), "ts")


_LEGAL = ", ".join(f"'{a}>{b}'" for a, b in sorted(processing.TRANSITIONS))
_RETRIED = f"m.to = 'FAILED' AND retries < {processing.MOST_RETRIES}"
_STATUS = f"""WITH RECURSIVE m AS (SELECT event_id AS message_id, user_id AS doc_id, ['PARSING', 'CHUNKING', 'EMBEDDING', 'COMPLETED', 'FAILED', 'PENDING'][event_id % 6 + 1] AS to, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS message_id, 'PENDING' AS status, false AS accepted, 0 AS retries, CAST(NULL AS BIGINT) AS retry_at_ms FROM m
 UNION ALL SELECT m.doc_id, m.i, m.message_id, CASE WHEN ok THEN m.to ELSE status END, ok, CASE WHEN ok AND {_RETRIED} THEN retries + 1 WHEN ok AND m.to = 'COMPLETED' THEN 0 ELSE retries END, CASE WHEN ok AND {_RETRIED} THEN m.ms + least({processing.FIRST_DELAY_MS} * CAST(power(2, retries) AS BIGINT), {processing.MOST_DELAY_MS}) END
 FROM (SELECT s.doc_id, s.status, s.retries, m, concat(s.status, '>', m.to) IN ({_LEGAL}) AS ok FROM s JOIN m ON m.doc_id = s.doc_id AND m.i = s.i + 1) z)"""
query("str_01_status_machine", _STATUS + " SELECT doc_id, message_id, status, accepted, retries, retry_at_ms FROM s WHERE i > 0")(lambda spark, d: processing.status_batch(messages(spark, d)))
query("str_05_progress", _STATUS + " SELECT doc_id, last.status AS status, CASE last.status WHEN 'PARSING' THEN 25 WHEN 'CHUNKING' THEN 50 WHEN 'EMBEDDING' THEN 75 WHEN 'COMPLETED' THEN 100 ELSE 0 END AS percent, last.retries AS retries FROM (SELECT doc_id, arg_max(s, message_id) AS last FROM s WHERE i > 0 AND accepted GROUP BY doc_id) z")(lambda spark, d: processing.progress(processing.status_batch(messages(spark, d))))
_QUOTA = f"""WITH RECURSIVE m AS (SELECT user_id AS client_id, event_id AS request_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BIGINT) AS start, 0 AS used, false AS allowed, 0 AS remaining FROM m
 UNION ALL SELECT client_id, i, request_id, start, used + CAST(used < {processing.QUOTAS['document']} AS INT), used < {processing.QUOTAS['document']}, greatest(0, {processing.QUOTAS['document']} - used - CAST(used < {processing.QUOTAS['document']} AS INT))
 FROM (SELECT m.client_id, m.i, m.request_id, CASE WHEN m.ms < s.start + {processing.QUOTA_MS} THEN s.start ELSE m.ms END AS start, CASE WHEN m.ms < s.start + {processing.QUOTA_MS} THEN s.used ELSE 0 END AS used FROM s JOIN m ON m.client_id = s.client_id AND m.i = s.i + 1) z)"""
query("str_06_quota", _QUOTA + " SELECT client_id, 'document' AS route, request_id, allowed, remaining FROM s WHERE i > 0")(lambda spark, d: processing.quota_batch(table(spark, d, "events").select(c("user_id").alias("client_id"), F.lit("document").alias("route"), c("event_id").alias("request_id"), "ts")))
#: Retries due at the newest event's time; those due more than an hour before have expired.
query("str_02_due_retries", _STATUS + ", f AS (SELECT doc_id, last.status AS status, last.retries AS retries, last.retry_at_ms AS due, (SELECT max(ms) FROM m) AS now FROM (SELECT doc_id, arg_max(s, i) AS last FROM s WHERE i > 0 AND accepted GROUP BY doc_id) z) SELECT doc_id, retries, CASE WHEN due > now - 3600000 THEN 'due' ELSE 'expired' END AS state FROM f WHERE status = 'FAILED' AND due <= now")(lambda spark, d: due(spark, d))


def due(spark, d):
    sent = messages(spark, d)
    now = sent.agg(F.max("ts").alias("now"))
    ready, expired = processing.due_retries(processing.status_batch(sent).join(sent.select("message_id", "ts"), "message_id"), now)
    return ready.withColumn("state", F.lit("due")).unionByName(expired.withColumn("state", F.lit("expired"))).select("doc_id", "retries", "state")


@query("str_04_first_messages", "SELECT user_id % 50 AS doc_id, min(event_id) AS message_id, count(*) AS n FROM events GROUP BY ALL")
def str_04(spark, d):
    """One worker's share of each document: all its messages in one group, of repeated ones the first."""
    sent = table(spark, d, "events").select((c("user_id") % 50).alias("doc_id"), c("event_id").alias("message_id"), "ts")
    twice = sent.unionByName(sent.filter("message_id % 3 = 0"))
    return processing.without_duplicates(twice).groupBy("doc_id").agg(F.min("message_id").alias("message_id"), F.count("*").alias("n"))


query("str_08_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type AS action, count(*) AS n FROM events GROUP BY ALL")(lambda spark, d: processing.daily_counts(table(spark, d, "events").select("ts", c("event_type").alias("action"))))
_ACTIONS = ("FULL_PROCESS", "PARSE", "CHUNK", "EMBED", "PURGE", None)
_ACTION_SQL = "[" + ", ".join("NULL" if a is None else f"'{a}'" for a in _ACTIONS) + "][event_id % 6 + 1]"


@query("str_03_routing", f"SELECT coalesce(action, 'none') AS action, CASE WHEN action IN ('FULL_PROCESS', 'PARSE', 'CHUNK', 'EMBED') THEN action ELSE 'unknown' END AS routed, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, {_ACTION_SQL} AS action FROM events) z GROUP BY ALL")
def str_03(spark, d):
    action = F.get(F.array(*map(F.lit, _ACTIONS)), (c("event_id") % 6).cast("int"))
    known, unknown = processing.route(table(spark, d, "events").select("event_id", action.alias("action")))
    rows = unknown.withColumn("routed", F.lit("unknown"))
    for name, part in known.items():
        rows = rows.unionByName(part.withColumn("routed", F.lit(name)))
    return rows.groupBy(F.coalesce("action", F.lit("none")).alias("action"), "routed").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
