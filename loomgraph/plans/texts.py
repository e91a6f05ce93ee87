"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import query
from .fixtures import GRAPH_SQL, REGISTRY, derived, entities, relations, table

_W = r"[^\p{L}\p{N}_]"
c = F.col


def docs(spark, d):
    return table(spark, d, "documents")


query("txt_01_clean", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_ .,!?;:''"()\-]', '', 'g')) AS cleaned FROM documents""")(lambda spark, d: docs(spark, d).select("doc_id", tx.clean(c("text")).alias("cleaned")))
query("txt_02_normalize", r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), concat(chr(10), chr(10), chr(10))), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS normal FROM documents""")(lambda spark, d: docs(spark, d).select("doc_id", tx.normalize(F.replace(c("text"), F.lit("\n"), F.lit("\r\n\r\r\n"))).alias("normal")))
_MD = "concat('---', chr(10), 'title: t', CAST(doc_id AS STRING), chr(10), 'lang: ', lang, chr(10), '---', chr(10), '# ', split_part(text, chr(10), 1), chr(10), 'rest', chr(10), '## second')"
query("txt_03_markdown", f"SELECT doc_id, concat('t', CAST(doc_id AS STRING)) AS title, lang, CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 'second' ELSE trim(split_part(text, chr(10), 1)) END AS heading, CASE WHEN trim(split_part(text, chr(10), 1)) = '' THEN 1 ELSE 2 END AS n FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", tx.markdown(F.concat(F.lit("---\ntitle: t"), c("doc_id").cast("string"), F.lit("\nlang: "), c("lang"), F.lit("\n---\n# "), F.substring_index("text", "\n", 1), F.lit("\nrest\n## second"))).alias("m")).select("doc_id", c("m.metadata")["title"].alias("title"), c("m.metadata")["lang"].alias("lang"), c("m.headings")[0]["text"].alias("heading"), F.size("m.headings").alias("n")))
query("txt_04_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash")))
_CHUNKS = r"""WITH RECURSIVE w AS (
 SELECT doc_id, text, 0 AS position, 0 AS s, CASE WHEN 512 < length(text) AND regexp_matches(substring(text, 513, 50), '[.!?。！？]') THEN 512 + length(regexp_extract(substring(text, 513, 50), '^[^.!?。！？]*')) + 1 ELSE 512 END AS e FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, position + 1, e - 51, CASE WHEN e - 51 + 512 < length(text) AND regexp_matches(substring(text, e - 51 + 513, 50), '[.!?。！？]') THEN e - 51 + 512 + length(regexp_extract(substring(text, e - 51 + 513, 50), '^[^.!?。！？]*')) + 1 ELSE e - 51 + 512 END FROM w WHERE e - 51 < length(text))"""
query("txt_05_fixed_chunks", _CHUNKS + r" SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS INT) AS position, content, CAST(s AS INT) AS start_offset, CAST(e AS INT) AS end_offset FROM (SELECT *, regexp_replace(substring(text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS content FROM w) z WHERE content <> ''")(lambda spark, d: docs(spark, d).select("doc_id", F.inline(tx.fixed_chunks(c("text")))))
_SEM = r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
w AS (SELECT doc_id, ps, 0 AS i, '' AS now, CAST([] AS VARCHAR[]) AS done FROM p
 UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(now) + length(ps[i + 1]) + 2 <= 1000 THEN CASE WHEN now = '' THEN ps[i + 1] ELSE concat(now, chr(10), chr(10), ps[i + 1]) END ELSE ps[i + 1] END,
  CASE WHEN length(now) + length(ps[i + 1]) + 2 <= 1000 OR length(now) < 100 THEN done ELSE list_append(done, now) END FROM w WHERE i < len(ps))
SELECT doc_id, unnest(CASE WHEN length(now) >= 100 THEN list_append(done, now) ELSE done END) AS content FROM w WHERE i = len(ps)"""
query("txt_06_semantic_chunks", _SEM)(lambda spark, d: docs(spark, d).select("doc_id", F.explode(tx.semantic_chunks(F.replace(c("text"), F.lit("\n"), F.lit("\n\n")))).alias("content")))
query("txt_07_chunk_strategy", f"SELECT id, CASE WHEN doc_type IN ('pdf', 'docx') THEN 'semantic' ELSE 'fixed' END AS strategy FROM ({REGISTRY}) z")(lambda spark, d: derived(spark, d, REGISTRY).select("id", tx.chunk_strategy(c("doc_type")).alias("strategy")))
query("txt_07_chunk_settings", "SELECT doc_id, size BETWEEN 100 AND 2000 AND rate BETWEEN 0 AND .5 AS valid, greatest(100, least(2000, size)) AS size, greatest(0, least(.5, rate)) AS rate FROM (SELECT doc_id, CAST(length(text) AS INT) AS size, (doc_id % 9 - 1) / 1e1 AS rate FROM documents) z")(lambda spark, d: docs(spark, d).select("doc_id", tx.chunk_settings(F.length("text"), (c("doc_id") % 9 - 1) / 10).alias("s")).select("doc_id", "s.*"))
query("txt_08_entity_name", f"{GRAPH_SQL} SELECT id, lower(regexp_replace(name, '{_W}', '', 'g')) AS name FROM e")(lambda spark, d: entities(spark, d).select("id", tx.entity_name(c("name")).alias("name")))
query("txt_09_relation_name", "SELECT item_id, lower(trim(concat('  ', substring(text, 1, 20), ' '))) AS name FROM benchmark")(lambda spark, d: table(spark, d, "benchmark").select("item_id", tx.relation_name(F.concat(F.lit("  "), F.substring("text", 1, 20), F.lit(" "))).alias("name")))
query("txt_10_name_similarity")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.round(tx.name_similarity("p_name", F.reverse("p_name")), 6).alias("ratio")))
query("txt_12_context_overlap", r"SELECT doc_id, round(CASE WHEN len(m) > 0 THEN len(list_filter(m, lambda x: list_contains(w, x))) / len(m) ELSE 0 END, 6) AS overlap FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(substring(text, 1, length(text) // 2 + 40)), '[\p{L}\p{N}_]+')) AS m, list_distinct(regexp_extract_all(lower(substring(text, length(text) // 2 + 1)), '[\p{L}\p{N}_]+')) AS w FROM documents) z")(lambda spark, d: docs(spark, d).select("doc_id", F.round(tx.context_overlap(F.expr("substring(text, length(text) div 2 + 1)"), F.expr("substring(text, 1, cast(length(text) div 2 + 40 as int))")), 6).alias("overlap")))
query("txt_14_extraction_prompt", "SELECT item_id, concat('Types: Person, Product', chr(10), 'Entities: a, b', chr(10), 'Text:', chr(10), text) AS prompt FROM benchmark")(lambda spark, d: table(spark, d, "benchmark").select("item_id", tx.extraction_prompt(c("text"), ["Person", "Product"], F.array(F.lit("a"), F.lit("b"))).alias("prompt")))
query("txt_15_entity_confidence", f"{GRAPH_SQL} SELECT id, round(greatest(0, least(1, confidence * CASE WHEN k % 1500 > 0 THEN .8 + .2 * least(1, (k % 1500) / 1000) ELSE 1 END * CASE WHEN length(name) < 2 THEN .5 WHEN length(name) > 50 THEN .8 ELSE 1 END * CASE WHEN coalesce(length(description), 0) = 0 THEN .9 ELSE 1 END)), 6) AS confidence FROM e")(lambda spark, d: entities(spark, d).select("id", F.round(tx.entity_confidence(c("confidence"), c("name"), c("description"), c("created_s") % 1500), 6).alias("confidence")))
query("txt_16_relation_confidence", f"{GRAPH_SQL} SELECT id, round(greatest(0, least(1, confidence * CASE WHEN length(evidence) > 0 THEN .9 + .1 * least(1, length(evidence) / 100) ELSE .7 END * CASE WHEN length(src) < 2 OR length(dst) < 2 THEN .8 ELSE 1 END)), 6) AS confidence FROM r")(lambda spark, d: relations(spark, d).select("id", F.round(tx.relation_confidence(c("confidence"), c("src"), c("dst"), c("evidence")), 6).alias("confidence")))
_ANSWER = "concat(text, CASE conv_turn % 4 WHEN 0 THEN ' [1] and [7]' WHEN 1 THEN ' [0]' WHEN 2 THEN ' [2][2]' ELSE '' END)"
_TURNS = "(SELECT conv_id, turn, text, CAST(turn AS BIGINT) AS conv_turn FROM conversations) z"
query("txt_17_references", f"SELECT conv_id, turn, array_to_string(regexp_extract_all({_ANSWER}, '\\[(\\d+)\\]', 1), ',') AS cited, CASE conv_turn % 4 WHEN 0 THEN '7' WHEN 1 THEN '0' ELSE '' END AS invalid FROM {_TURNS} WHERE NOT regexp_matches(text, '\\[\\d+\\]')")(lambda spark, d: answers(spark, d).filter(~c("text").rlike(r"\[\d+\]")).select("conv_id", "turn", F.array_join(tx.references(c("answer")).cast("array<string>"), ",").alias("cited"), F.array_join(tx.invalid_references(c("answer"), F.lit(3)).cast("array<string>"), ",").alias("invalid")))


query("txt_17_reference_places", f"SELECT conv_id, turn, string_agg(concat(n, ':', place - 1, ':', place + length(n) + 1), ',' ORDER BY i) AS places FROM (SELECT conv_id, turn, i, n, CAST(length(text) + CASE conv_turn % 4 WHEN 2 THEN CASE i WHEN 1 THEN 2 ELSE 5 END WHEN 1 THEN 2 ELSE CASE i WHEN 1 THEN 2 ELSE 10 END END AS BIGINT) AS place FROM (SELECT *, unnest(CASE conv_turn % 4 WHEN 0 THEN ['1', '7'] WHEN 1 THEN ['0'] WHEN 2 THEN ['2', '2'] ELSE [] END) AS n, unnest(CASE conv_turn % 4 WHEN 1 THEN [1] WHEN 3 THEN [] ELSE [1, 2] END) AS i FROM {_TURNS}) y WHERE NOT regexp_matches(text, '\\[\\d+\\]')) x GROUP BY ALL")(lambda spark, d: answers(spark, d).filter(~c("text").rlike(r"\[\d+\]")).select("conv_id", "turn", F.array_join(F.transform(tx.reference_places(c("answer")), lambda p: F.concat_ws(":", p["n"].cast("string"), p["start"].cast("string"), p["end"].cast("string"))), ",").alias("places")).filter("places != ''"))


def answers(spark, d):
    tail = F.when(c("turn") % 4 == 0, " [1] and [7]").when(c("turn") % 4 == 1, " [0]").when(c("turn") % 4 == 2, " [2][2]").otherwise("")
    return table(spark, d, "conversations").withColumn("answer", F.concat("text", tail))


query("txt_18_annotate")(lambda spark, d: answers(spark, d).select("conv_id", "turn", tx.annotate(c("answer"), F.array(c("text"), F.lit("no such source phrase"), F.reverse("text"))).alias("annotated")))
query("txt_19_source_list", "SELECT item_id, concat('[1] first: ', substring(text, 1, 200), chr(10), '[2] ', CAST(item_id AS STRING), ': ', substring(concat('x', text), 1, 200)) AS sources FROM benchmark")(lambda spark, d: table(spark, d, "benchmark").select("item_id", tx.source_list(F.array(F.struct(F.lit("first").alias("title"), c("item_id").alias("doc_id"), c("text").alias("content")), F.struct(F.lit(None).cast("string").alias("title"), c("item_id").alias("doc_id"), F.concat(F.lit("x"), "text").alias("content")))).alias("sources")))
query("txt_20_character_jaccard", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM (SELECT p_partkey, list_distinct(string_split(p_name, '')) AS a, list_distinct(string_split(p_type, '')) AS b FROM part) z")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.round(tx.character_jaccard(c("p_name"), c("p_type")), 6).alias("jaccard")))
query("txt_21_query_keywords", "SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+|[A-Za-z]+'), lambda w: length(w) >= 2)[1:5], ' ') AS words FROM benchmark")(lambda spark, d: table(spark, d, "benchmark").select("item_id", F.array_join(tx.query_keywords(c("text")), " ").alias("words")))
query("txt_22_truncate", "SELECT doc_id, CAST(floor(length(text) / 2) AS BIGINT) AS tokens, CASE WHEN length(text) <= 200 THEN text ELSE concat(substring(text, 1, 200), '...') END AS cut FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", tx.token_estimate(c("text")).alias("tokens"), tx.truncate(c("text"), 100).alias("cut")))
query("txt_23_merge_metadata", "SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'old' END AS source, 2 AS n FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", tx.merge_metadata(F.concat(F.lit('{"lang": "'), c("lang"), F.lit('", "source": "old"}')), F.when(c("doc_id") % 3 == 0, F.concat(F.lit('{"source": "'), c("source"), F.lit('"}'))).otherwise("{bad")).alias("m")).select("doc_id", c("m")["lang"].alias("lang"), c("m")["source"].alias("source"), F.size("m").alias("n")))
query("txt_24_estimated_end", "SELECT event_id, CASE WHEN event_id % 120 > 0 THEN 1000 + CAST(floor((event_id % 500) * 100 / least(100, event_id % 120)) AS BIGINT) END AS ends FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", tx.estimated_end(F.lit(1000), F.lit(1000) + c("event_id") % 500, c("event_id") % 120).cast("long").alias("ends")))
query("txt_25_retry_delay", "SELECT event_id, CAST(least(1000 * power(2, event_id % 6), 10000) AS BIGINT) AS delay FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", tx.retry_delay(c("event_id") % 6).alias("delay")))
