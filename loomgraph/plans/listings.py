"""Queries over lookups, listings, joins, deletes and operational statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, operations
from ..tables import written
from .catalog import query
from .fixtures import AUDIT, GRAPH_SQL, REGISTRY, derived, entities, relations, table

_FLIP = "b AS (SELECT *, src AS near, dst AS far, 'outgoing' AS way FROM r UNION ALL SELECT *, dst, src, 'incoming' FROM r WHERE src <> dst)"


def customers(spark, d, most=25):
    return table(spark, d, "customer").filter(F.col("c_custkey") % 60 == 0).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))


_SEEDS = "s AS (SELECT concat('C', CAST(c_custkey AS STRING)) AS id FROM customer WHERE c_custkey % 60 = 0)"


def registry(spark, d):
    return derived(spark, d, REGISTRY).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("created_s")))


def audit(spark, d):
    return derived(spark, d, AUDIT)


@query("flt_01_lookup_by_name", f"{GRAPH_SQL} SELECT n_name AS key, id, type FROM nation JOIN (SELECT name, min(id) AS id FROM e GROUP BY name) m ON n_name = m.name JOIN e USING (id)")
def flt_01(spark, d):
    return filters.lookup(entities(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("key")), "name").select("key", "id", "type")


query("flt_02_newest_by_type", f"{GRAPH_SQL} SELECT id, type, place FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k DESC, id) AS place FROM e) z WHERE place BETWEEN 3 AND 12")(lambda spark, d: filters.newest_by_type(entities(spark, d), 10, 2).select("id", "type", "place"))
query("flt_03_list_entities", f"{GRAPH_SQL}, f AS (SELECT * FROM e WHERE type = 'Product' AND (contains(name, 'e') OR contains(coalesce(description, ''), 'e')) AND coalesce(confidence, 1) >= .6) SELECT id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY k DESC, id LIMIT 20 OFFSET 20")(lambda spark, d: filters.list_entities(entities(spark, d), "e", "Product", 0.6, page=2).select("id", "name", "total"))
query("flt_04_list_relations", f"{GRAPH_SQL}, {_SEEDS} SELECT r.id, way, e.name AS far_name FROM (SELECT *, src AS near, dst AS far, 'outgoing' AS way FROM r UNION ALL SELECT *, dst, src, 'incoming' FROM r WHERE src <> dst) r JOIN s ON near = s.id JOIN e ON e.id = far WHERE coalesce(r.confidence, 1) >= .5")(lambda spark, d: filters.relations_of(filters.passing(relations(spark, d), min_confidence=0.5, missing=1.0), customers(spark, d)).join(entities(spark, d).select(F.col("id").alias("far"), F.col("name").alias("far_name")), "far").select("id", "way", "far_name"))
query("flt_05_with_endpoints", f"{GRAPH_SQL} SELECT r.id, a.name AS src_name, b.name AS dst_name, a.type AS src_type, b.type AS dst_type FROM r JOIN e a ON a.id = src JOIN e b ON b.id = dst WHERE r.type <> 'CONTAINS'")(lambda spark, d: with_endpoints(spark, d))
def with_endpoints(spark, d):
    """Both tables are made once; each is read more than once."""
    edges, nodes = written(relations(spark, d), "relations"), written(entities(spark, d), "entities")
    found = filters.with_endpoints(edges, nodes, edges.filter("type != 'CONTAINS'"))
    return found.select("id", "src_name", "dst_name", "src_type", "dst_type")


query("flt_06_relations_by_entity", f"{GRAPH_SQL}, {_FLIP}, {_SEEDS} SELECT b.id, near, far, way FROM b JOIN s ON near = s.id")(lambda spark, d: filters.relations_of(relations(spark, d), customers(spark, d)).select("id", "near", "far", "way"))
query("flt_07_relations_by_type", f"{GRAPH_SQL} SELECT id, src, dst FROM r WHERE type IN ('LOCATED_AT', 'BELONGS_TO')")(lambda spark, d: filters.passing(relations(spark, d), ["LOCATED_AT", "BELONGS_TO"]).select("id", "src", "dst"))
query("flt_08_list_documents", f"WITH f AS (SELECT * FROM ({REGISTRY}) z WHERE contains(title, 'th') AND status = 'COMPLETED' AND created_s >= 3600) SELECT id, title, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_s DESC, id LIMIT 50")(lambda spark, d: filters.list_documents(registry(spark, d), title="th", status="COMPLETED", since="2024-01-01 01:00:00", until="no date", size=50).select("id", "title", "total"))
query("flt_09_audit_rows", f"WITH a AS ({AUDIT}) SELECT id, username, action FROM a WHERE resource_type = 'entity' AND contains(username, '7') AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")(lambda spark, d: filters.audit_rows(audit(spark, d), resource_type="entity", username="7", since="2024-01-05", until="2024-01-20").select("id", "username", "action"))
query("flt_10_by_confidence", f"{GRAPH_SQL} SELECT type, count(*) AS n FROM e WHERE confidence >= .7 GROUP BY type")(lambda spark, d: filters.passing(entities(spark, d), min_confidence=0.7).groupBy("type").agg(F.count("*").alias("n")))
query("flt_11_by_metadata", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'")(lambda spark, d: filters.by_metadata(table(spark, d, "documents"), {"lang": ["de", "fr"], "source": "src3"}).select("doc_id", "lang", "source"))
query("flt_12_by_properties", f"{GRAPH_SQL} SELECT id, name FROM e WHERE k % 2 = 0 AND k % 10 = 4")(lambda spark, d: filters.by_properties(entities(spark, d), {"rank": "4"}).select("id", "name"))
query("join_01_neighbours", f"{GRAPH_SQL}, {_FLIP}, {_SEEDS}, p AS (SELECT b.*, row_number() OVER (PARTITION BY near ORDER BY b.id, way) AS place FROM b JOIN s ON near = s.id WHERE confidence >= .4) SELECT near AS seed, p.id AS edge, way, far AS id, e.name FROM p JOIN e ON e.id = far WHERE place <= 8")(lambda spark, d: filters.neighbours(relations(spark, d), entities(spark, d), customers(spark, d), min_confidence=0.4, limit=8))
query("join_02_entity_detail", f"{GRAPH_SQL}, {_FLIP}, {_SEEDS} SELECT s.id, me.name, way, b.type, far, it.name AS far_name FROM s JOIN e me USING (id) LEFT JOIN b ON near = s.id LEFT JOIN e it ON it.id = far")(lambda spark, d: customers(spark, d).join(entities(spark, d).select("id", "name"), "id").join(filters.oriented(relations(spark, d)).select(F.col("near").alias("id"), "way", "type", "far"), "id", "left").join(entities(spark, d).select(F.col("id").alias("far"), F.col("name").alias("far_name")), "far", "left").select("id", "name", "way", "type", "far", "far_name"))
query("win_06_recent_by_user", f"WITH a AS ({AUDIT}) SELECT user_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM a) z WHERE place <= 5")(lambda spark, d: filters.recent_by_user(audit(spark, d)).select("user_id", "id", "place"))
query("win_07_neighbour_cap", f"{GRAPH_SQL}, {_FLIP} SELECT near AS seed, count(*) AS n FROM (SELECT near, row_number() OVER (PARTITION BY near ORDER BY id, way) AS place FROM b) z WHERE place <= 50 GROUP BY near")(lambda spark, d: filters.neighbours(relations(spark, d), entities(spark, d), entities(spark, d)).groupBy("seed").agg(F.count("*").alias("n")))
query("set_01_undirected", f"{GRAPH_SQL}, {_FLIP} SELECT near AS id, count(*) AS n, count(DISTINCT far) AS different FROM b GROUP BY near")(lambda spark, d: filters.oriented(relations(spark, d)).groupBy(F.col("near").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("far").alias("different")))
query("set_03_distinct_types", f"{GRAPH_SQL} SELECT DISTINCT a.type AS src_type, r.type, b.type AS dst_type FROM r JOIN e a ON a.id = src JOIN e b ON b.id = dst")(lambda spark, d: filters.with_endpoints(relations(spark, d), entities(spark, d)).select("src_type", "type", "dst_type").distinct())
query("agg_06_counts_per_key", f"{GRAPH_SQL} SELECT src AS id, type, count(*) AS n FROM r GROUP BY src, type")(lambda spark, d: relations(spark, d).groupBy(F.col("src").alias("id"), "type").agg(F.count("*").alias("n")))
query("agg_18_adjacency", f"{GRAPH_SQL} SELECT src AS id, string_agg(concat(type, '>', dst), ',' ORDER BY type, dst) AS edges FROM r GROUP BY src")(lambda spark, d: relations(spark, d).groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "dst"))), lambda x: F.concat(x["type"], F.lit(">"), x["dst"])), ",").alias("edges")))
query("agg_19_query_statistics", f"WITH a AS ({AUDIT}), w AS (SELECT * FROM a WHERE created_at >= (SELECT max(created_at) FROM a) - INTERVAL 7 DAY) SELECT CAST(day AS STRING) AS day, count(*) AS n, (SELECT count(*) FROM w) AS total, (SELECT round_even(avg(response_ms), 2) FROM w) AS avg_ms, (SELECT round_even(avg(satisfaction), 2) FROM w) AS avg_satisfaction FROM w GROUP BY day")(lambda spark, d: operations.query_statistics(audit(spark, d), 7))
query("agg_20_audit_summary", f"WITH a AS ({AUDIT}) SELECT 'action' AS facet, action AS key, count(*) AS n FROM a GROUP BY action UNION ALL SELECT 'resource', resource_type, count(*) FROM a GROUP BY resource_type UNION ALL SELECT 'users', 'distinct', count(DISTINCT user_id) FROM a UNION ALL (SELECT 'top_user', username, count(*) AS n FROM a GROUP BY username ORDER BY n DESC, username LIMIT 5)")(lambda spark, d: operations.audit_summary(audit(spark, d)))
query("agg_21_document_statistics", f"WITH f AS ({REGISTRY}) SELECT 'total' AS facet, 'all' AS key, count(*) AS n FROM f UNION ALL SELECT 'total', 'new', count(*) FROM f WHERE created_s >= 30000 UNION ALL SELECT 'doc_type', doc_type, count(*) FROM f GROUP BY doc_type UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY status")(lambda spark, d: operations.document_statistics(registry(spark, d), 30000))
query("agg_21_graph_statistics", f"{GRAPH_SQL} SELECT 'entity_type' AS facet, type AS key, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'relation_type', type, count(*) FROM r GROUP BY type UNION ALL SELECT 'total', 'entities', count(*) FROM e UNION ALL SELECT 'total', 'relations', count(*) FROM r")(lambda spark, d: operations.graph_statistics(entities(spark, d), relations(spark, d)))
_USERS = "SELECT c_custkey AS user_id, c_custkey % 9 = 0 AS deleted FROM customer"
query("agg_21_user_statistics", f"WITH a AS ({AUDIT}), u AS ({_USERS}) SELECT 'users' AS facet, CASE WHEN deleted THEN 'deleted' ELSE 'live' END AS key, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'users', 'active', count(DISTINCT user_id) FROM a WHERE created_at >= (SELECT max(created_at) FROM a) - INTERVAL 7 DAY")(lambda spark, d: operations.user_statistics(derived(spark, d, _USERS), audit(spark, d), 7))
query("agg_06_counts", f"{GRAPH_SQL} SELECT 'type' AS facet, type AS key, count(*) AS n FROM e GROUP BY type UNION ALL SELECT 'entity', id, count(*) FROM (SELECT src AS id FROM r UNION ALL SELECT dst FROM r WHERE dst <> src) z GROUP BY id UNION ALL SELECT 'action', event_type, count(*) FROM events GROUP BY event_type UNION ALL SELECT 'document', CAST(conv_id AS STRING), count(*) FROM conversations GROUP BY conv_id")(lambda spark, d: operations.counts_per_key(entities(spark, d), relations(spark, d), audit(spark, d), table(spark, d, "conversations").withColumnRenamed("conv_id", "doc_id")))
query("flt_03_by_source_document", f"{GRAPH_SQL}, f AS (SELECT * FROM e WHERE k % 97 = 5 OR k % 89 = 5) SELECT id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY k DESC, id LIMIT 20")(lambda spark, d: filters.list_entities(entities(spark, d).withColumn("source_docs", F.array(F.col("created_s") % 97, F.col("created_s") % 89)), source_doc=5).select("id", "name", "total"))
query("win_08_first_by_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS id FROM documents GROUP BY text")(lambda spark, d: operations.first_by_hash(registry(spark, d).withColumn("content_hash", F.sha2("text", 256))).select("content_hash", "id"))

_RBAC = """u AS (SELECT c_custkey AS user_id, c_custkey % 9 = 0 AS deleted FROM customer),
ro AS (SELECT DISTINCT c_custkey % 50 AS role_id, (c_custkey % 50) % 9 = 8 AS deleted, (c_custkey % 50) % 7 <> 3 AS enabled FROM customer),
ur AS (SELECT c_custkey AS user_id, c_custkey % 50 AS role_id FROM customer UNION SELECT c_custkey, (c_custkey * 7) % 50 FROM customer),
p AS (SELECT p_partkey AS permission_id, concat('perm', CAST(p_partkey AS STRING)) AS code, p_partkey % 9 = 0 AS deleted FROM part),
rp AS (SELECT p_partkey % 50 AS role_id, p_partkey AS permission_id FROM part)"""


@query("join_09_access_review", f"WITH {_RBAC} SELECT DISTINCT user_id, code FROM u JOIN ur USING (user_id) JOIN ro USING (role_id) JOIN rp USING (role_id) JOIN p USING (permission_id) WHERE NOT u.deleted AND NOT ro.deleted AND enabled AND NOT p.deleted")
def join_09(spark, d):
    part = lambda name: derived(spark, d, f"WITH {_RBAC} SELECT * FROM {name}")
    derived(spark, d, "SELECT 1 FROM customer, part")
    return operations.access_review(part("u"), part("ur"), part("ro"), part("rp"), part("p"))


@query("join_11_upsert_entities", f"{GRAPH_SQL} SELECT coalesce(e.id, concat('S', CAST(s.s_suppkey + 1000000 AS STRING))) AS id, CASE WHEN s.s_suppkey IS NULL THEN e.name ELSE s.n END AS name, coalesce(e.type, 'Organization') AS type, s.s_suppkey IS NOT NULL AS touched, CASE WHEN e.k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s.s_suppkey IS NULL THEN 0 ELSE 1 END AS n_properties FROM e FULL JOIN (SELECT s_suppkey, upper(s_name) AS n, CASE WHEN s_suppkey % 2 = 0 THEN concat('S', CAST(s_suppkey AS STRING)) END AS hit FROM supplier) s ON e.id = s.hit")
def join_11(spark, d):
    stored = entities(spark, d).withColumn("created_at", F.timestamp_seconds("created_s")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    key = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 1000000)
    incoming = table(spark, d, "supplier").select(F.concat(F.lit("S"), key.cast("string")).alias("id"), F.upper("s_name").alias("name"), F.lit("Organization").alias("type"), F.create_map(F.lit("source"), F.lit("supplier")).alias("properties"), F.lit(1).alias("version"))
    return operations.upsert(stored, incoming).select("id", "name", "type", F.col("updated_at").isNotNull().alias("touched"), F.size("properties").alias("n_properties"))


@query("join_12_detach_delete", f"{GRAPH_SQL}, {_SEEDS} SELECT type, count(*) AS n FROM r WHERE src NOT IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM s) GROUP BY type")
def join_12(spark, d):
    return operations.detach_delete(entities(spark, d), relations(spark, d), customers(spark, d))[1].groupBy("type").agg(F.count("*").alias("n"))
