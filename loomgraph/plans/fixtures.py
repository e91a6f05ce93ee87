"""Derived tables that the queries run on, made from the given tables by SQL that both Spark and the oracle read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = """
SELECT id, name, type, (30 + (k*37) % 71) / 1e2 AS confidence,
       CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'short' ELSE concat(type, ' node named ', name) END AS description, k
FROM (
  SELECT concat('R', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'Location' AS type, CAST(r_regionkey AS BIGINT) AS k FROM region
  UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, 'Location', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), c_name, 'Person', c_custkey FROM customer
  UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, 'Organization', s_suppkey FROM supplier
  UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), p_name, 'Product', p_partkey FROM part
  UNION ALL SELECT concat('O', CAST(o_orderkey AS STRING)), concat('order ', CAST(o_orderkey AS STRING)), 'Event', o_orderkey FROM orders
  UNION ALL SELECT concat('B', CAST(item_id AS STRING)), substring(text, 1, 30), 'Concept', item_id FROM benchmark
) x"""

RELATIONS = """
SELECT concat(src, '|', type, '|', dst) AS id, src, dst, type, (30 + (a*31 + b*17) % 71) / 1e2 AS confidence,
       CASE WHEN (a + b) % 4 = 0 THEN NULL ELSE concat(src, ' ', type, ' ', dst) END AS evidence
FROM (
  SELECT concat('N', CAST(n_nationkey AS STRING)) AS src, concat('R', CAST(n_regionkey AS STRING)) AS dst, 'BELONGS_TO' AS type, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation
  UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), concat('N', CAST(c_nationkey AS STRING)), 'LOCATED_AT', c_custkey, CAST(c_nationkey AS BIGINT) FROM customer
  UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)), 'LOCATED_AT', s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier
  UNION ALL SELECT concat('O', CAST(o_orderkey AS STRING)), concat('C', CAST(o_custkey AS STRING)), 'CREATED_BY', o_orderkey, o_custkey FROM orders
  UNION ALL SELECT DISTINCT concat('P', CAST(l_partkey AS STRING)), concat('S', CAST(l_suppkey AS STRING)), 'DEPENDS_ON', l_partkey, l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT concat('O', CAST(l_orderkey AS STRING)), concat('P', CAST(l_partkey AS STRING)), 'CONTAINS', l_orderkey, l_partkey FROM lineitem
) x"""

REGISTRY = """
SELECT doc_id AS id, substring(text, 1, 40) AS title, source,
       CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'md' ELSE 'txt' END AS doc_type,
       CAST(length(text) AS BIGINT) AS file_size,
       CASE doc_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PARSING' WHEN 2 THEN 'CHUNKING' WHEN 3 THEN 'EMBEDDING' WHEN 4 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       doc_id % 7 AS created_by, doc_id * 60 AS created_s, text
FROM documents"""

AUDIT = """
SELECT event_id AS id, user_id, concat('user', CAST(user_id AS STRING)) AS username, event_type AS action,
       CASE event_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'entity' WHEN 2 THEN 'relation' ELSE 'query' END AS resource_type,
       event_id % 997 AS resource_id, CASE WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       ts AS created_at, CAST(ts AS DATE) AS day, value * 10 AS response_ms, event_id % 6 AS satisfaction
FROM events"""

GRAPH_SQL = f"WITH e AS ({ENTITIES}), r AS ({RELATIONS})"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the given tables."""
    for name in TABLES:
        if f" {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, confidence, description, properties (one entry for even keys), created_s."""
    rows = derived(spark, sf_dir, ENTITIES)
    some = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("rank"), (F.col("k") % 10).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("id", "name", "type", "confidence", "description", some.alias("properties"), F.col("k").alias("created_s"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, dst, type, confidence, evidence: the rows of RELATIONS.

    The pairs of lineitem are told apart by their two numbers before names are made of them, so that no names are shuffled."""
    pairs = r"SELECT \1 FROM (SELECT DISTINCT \2, \3 FROM lineitem) y"
    return derived(spark, sf_dir, re.sub(r"SELECT DISTINCT (.*, (l_\w+), (l_\w+)) FROM lineitem", pairs, RELATIONS))
