"""Queries over graph construction and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import construct as kg
from .catalog import query
from .fixtures import derived, table

c = F.col
#: Words of a response, one response for each so many words of a document; those of every tenth document are malformed.
SPAN = 50
_WORDS = r"SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents WHERE doc_id % 10 <> 0"
_TYPE = "['Person', 'Organization', 'Location', 'Product', 'Event', 'Concept'][length({}) % 6 + 1]"
_E = f"""c AS (SELECT doc_id, chunk_id, w[chunk_id * {SPAN} + 1 : chunk_id * {SPAN} + {SPAN}] AS v FROM (SELECT *, unnest(generate_series(0, (len(w) - 1) // {SPAN})) AS chunk_id FROM ({_WORDS}) z WHERE len(w) > 0) y),
m AS (SELECT doc_id, chunk_id, i - 1 AS ord, name, {_TYPE.format('name')} AS type, (50 + (length(name) * 7 + i * 13) % 51) / 1e2 AS confidence, lower(name) AS normalized_name FROM (SELECT doc_id, chunk_id, unnest(v) AS name, generate_subscripts(v, 1) AS i FROM c) x)"""
_R = "r AS (SELECT a.doc_id, a.chunk_id, a.ord, a.name AS head, b.name AS tail, ['BELONGS_TO', 'CONTAINS', 'LOCATED_AT'][(length(a.name) + length(b.name)) % 3 + 1] AS relation, concat(a.name, ' ', b.name) AS evidence, a.confidence, lower(a.name) AS head_key, lower(b.name) AS tail_key FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.chunk_id = b.chunk_id AND b.ord = a.ord + 1)"


def responses(spark, d):
    """One response for each SPAN words of each document, from all of its words."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))
    parts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / SPAN).cast("int"))
    rows = kg.by_document(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    # Cut before they are dealt out, so that no row carries the whole text's words.
    cut = F.transform(parts, lambda n: F.struct(n.alias("chunk_id"), F.slice("w", n * SPAN + 1, F.lit(SPAN)).alias("w")))
    return answered(rows.select("doc_id", F.inline(cut)))


def whole_responses(spark, d):
    """One response for each chunk of each document, from all words of the chunk."""
    chunks = kg.by_document(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.inline(tx.fixed_chunks(c("text"))))
    return answered(chunks.select("doc_id", c("position").alias("chunk_id"), F.regexp_extract_all("content", F.lit(r"(\p{L}+)"), F.lit(1)).alias("w")))


def tasks(spark, d):
    """Tasks that the documents are dealt to."""
    return kg.tasks_of(table(spark, d, "documents").select("doc_id", "text"))


def answered(rows):
    """Extraction responses that name the words w of each row."""
    types = F.array(*map(F.lit, ("Person", "Organization", "Location", "Product", "Event", "Concept")))
    kinds = F.array(*map(F.lit, ("BELONGS_TO", "CONTAINS", "LOCATED_AT")))
    sure = lambda w, i: (50 + (F.length(w) * 7 + (i + 1) * 13) % 51) / 100
    es = F.transform("w", lambda w, i: F.struct(w.alias("name"), F.element_at(types, F.length(w) % 6 + 1).alias("type"), sure(w, i).alias("confidence")))
    rs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.struct(w.alias("head"), F.element_at(kinds, (F.length(w) + F.length(F.get("w", i + 1))) % 3 + 1).alias("relation"), F.get("w", i + 1).alias("tail"), F.concat(w, F.lit(" "), F.get("w", i + 1)).alias("evidence"), sure(w, i).alias("confidence")))
    say = lambda name, a: F.when(c("doc_id") % 10 == 0, "no { answer").otherwise(F.concat(F.lit("Here it is: "), F.to_json(F.struct(a.alias(name))), F.lit(" done.")))
    return rows.select("doc_id", "chunk_id", say("entities", es).alias("entity_response"), say("relations", rs).alias("relation_response"))


query("txt_13_parse_responses", f"WITH {_E} SELECT doc_id, chunk_id, ord, name, type, confidence FROM m")(lambda spark, d: kg.entity_mentions(responses(spark, d)).select("doc_id", "chunk_id", "ord", "name", "type", "confidence"))
query("agg_13_chunk_entities")(lambda spark, d: kg.chunk_entities(whole_responses(spark, d)).select("doc_id", "chunk_id", "ord", "name", "source_count", F.array_join("aliases", ",").alias("aliases")))
query("agg_14_document_entities", f"WITH {_E} SELECT doc_id, type, normalized_name, arg_min(name, chunk_id * 100 + ord) AS name, round(avg(confidence), 6) AS confidence, count(*) AS source_count FROM m GROUP BY ALL")(lambda spark, d: kg.merge_document_entities(kg.entity_mentions(responses(spark, d))).select("doc_id", "type", "normalized_name", "name", F.round("confidence", 6).alias("confidence"), "source_count"))
_DEDUP = "SELECT {by}, head_key, relation, tail_key, arg_min(head, chunk_id * 100 + ord) AS head, round(least(1, arg_min(confidence, chunk_id * 100 + ord) + {boost} * (count(*) - 1)), 6) AS confidence, count(*) AS source_count FROM r GROUP BY {by}, head_key, relation, tail_key"
query("agg_15_chunk_relations", f"WITH {_E}, {_R} " + _DEDUP.format(by="doc_id, chunk_id", boost=".1"))(lambda spark, d: kg.dedup_relations(kg.relation_mentions(responses(spark, d))).select("doc_id", "chunk_id", "head_key", "relation", "tail_key", "head", F.round("confidence", 6).alias("confidence"), "source_count"))
query("agg_16_document_relations", f"WITH {_E}, {_R} " + _DEDUP.format(by="doc_id", boost="0"))(lambda spark, d: kg.dedup_relations(kg.relation_mentions(responses(spark, d)), ("doc_id",), 0.0).select("doc_id", "head_key", "relation", "tail_key", "head", F.round("confidence", 6).alias("confidence"), "source_count"))
_SURE = "s AS (SELECT * FROM m WHERE confidence >= .7)"
_OK = "EXISTS (SELECT 1 FROM s WHERE s.doc_id = r.doc_id AND s.chunk_id = r.chunk_id AND s.normalized_name = {})"
query("join_03_validate_relations", f"WITH {_E}, {_R}, {_SURE} SELECT doc_id, chunk_id, ord, {_OK.format('head_key')} AND {_OK.format('tail_key')} AS valid FROM r")(lambda spark, d: validated(spark, d))


def validated(spark, d):
    return kg.judged_relations(kg.relation_mentions(responses(spark, d)), kg.entity_mentions(responses(spark, d)).filter("confidence >= 0.7")).select(*kg.PLACE, "valid")


query("agg_17_batch_relations")(lambda spark, d: kg.extract_chunks(whole_responses(spark, d), tasks=tasks(spark, d))[1].select("doc_id", "chunk_id", "head_key", "relation", "tail_key", F.round("confidence", 6).alias("confidence"), "source_count"))
query("kgc_01_extract_chunks")(lambda spark, d: kg.extract_chunks(whole_responses(spark, d))[0].select("doc_id", "chunk_id", "ord", "name", "type", "confidence", "source_count"))
query("kgc_02_extract_documents")(lambda spark, d: kg.extract_documents(whole_responses(spark, d), tasks(spark, d))[0].select("doc_id", "type", "normalized_name", "name", F.round("confidence", 6).alias("confidence"), "source_count"))
query("kgc_03_build_graph")(lambda spark, d: kg.build_graph(whole_responses(spark, d), tasks=tasks(spark, d))[1].select("id", "src", "dst", "relation", F.round("confidence", 6).alias("confidence")))
query("agg_22_summary", f"WITH {_E}, g AS (SELECT doc_id, count(DISTINCT concat(type, '|', normalized_name)) AS e FROM m GROUP BY doc_id) SELECT doc_id, coalesce(e, 0) AS entity_count, CASE WHEN e > 0 THEN 'success' WHEN errors > 0 THEN 'failed' ELSE 'empty' END AS status, errors FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2 * CAST(ceil(len(regexp_extract_all(text, '\\p{{L}}+')) / {SPAN}) AS BIGINT) ELSE 0 END AS errors FROM documents) z LEFT JOIN g USING (doc_id)")(lambda spark, d: kg.summary(kg.merge_document_entities(kg.entity_mentions(responses(spark, d))), kg.relation_mentions(responses(spark, d)), table(spark, d, "documents"), responses(spark, d)).select("doc_id", "entity_count", "status", "errors"))
query("join_04_link", f"WITH {_E.replace("m AS (", "m AS MATERIALIZED (")}, {_R.replace("r AS (", "r AS MATERIALIZED (", 1)}, ids AS MATERIALIZED (SELECT doc_id, normalized_name, min(concat(type, '/', normalized_name)) AS id FROM m WHERE confidence >= .6 GROUP BY ALL) SELECT r.doc_id, r.chunk_id, r.ord, a.id AS src, b.id AS dst FROM r JOIN ids a ON a.doc_id = r.doc_id AND a.normalized_name = head_key JOIN ids b ON b.doc_id = r.doc_id AND b.normalized_name = tail_key")(lambda spark, d: kg.link(kg.relation_mentions(responses(spark, d)), kg.merge_document_entities(kg.entity_mentions(responses(spark, d)).filter("confidence >= 0.6")).withColumn("id", F.concat_ws("/", "type", "normalized_name")))[0].select("doc_id", "chunk_id", "ord", "src", "dst"))

_MENTIONS = "SELECT p_partkey AS mention_id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, '!') ELSE substring(p_name, 1, length(p_name) - 1) END AS name, CAST(NULL AS STRING) AS type, concat('Product node named ', p_name) AS context, concat('P', CAST(p_partkey AS STRING)) AS expected_id FROM part"

def products(spark, d):
    from .fixtures import entities

    return entities(spark, d).filter("type = 'Product'")


_NORM = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"
query("join_08_blocking", f"WITH m AS (SELECT mention_id, {_NORM.format('name')} AS m FROM ({_MENTIONS}) z), e AS (SELECT concat('P', CAST(p_partkey AS STRING)) AS id, {_NORM.format('p_name')} AS e FROM part) SELECT mention_id, id FROM (SELECT mention_id, id, row_number() OVER (PARTITION BY mention_id ORDER BY abs(length(m) - length(e)), id) AS nth FROM m, e WHERE contains(e, m) OR contains(m, e)) y WHERE nth <= 20")(lambda spark, d: kg.blocked(derived(spark, d, _MENTIONS), products(spark, d)))
# Every candidate contains the mention or is contained, so that the name part is 1 or .95 and SQL needs no ratio.
_TERMS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_SHARE = "CASE WHEN len({0}) > 0 THEN least(1, len(list_intersect({0}, cw)) / len({0})) ELSE 0 END"
_RANKED = f"""WITH m AS (SELECT mention_id, expected_id, {_NORM.format('name')} AS m, {_TERMS.format('context')} AS cw FROM ({_MENTIONS}) z),
e AS (SELECT concat('P', CAST(p_partkey AS STRING)) AS id, {_NORM.format('p_name')} AS e, p_partkey AS k,
 CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'short' ELSE concat('Product node named ', p_name) END AS description FROM part),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY abs(length(m) - length(e)), id) AS nth FROM m, e WHERE contains(e, m) OR contains(m, e)) y WHERE nth <= 20),
worded AS (SELECT *, {_TERMS.format('description')} AS dw, [CAST(k % 10 AS STRING)] AS pw FROM near),
weighed AS (SELECT mention_id, expected_id, id, CASE WHEN m = e THEN 1 ELSE .95 END AS name, {_SHARE.format('dw')} AS own, CASE WHEN k % 2 = 0 THEN {_SHARE.format('pw')} ELSE 0 END AS rank_share FROM worded),
scored AS (SELECT *, round(CAST(.6 AS DOUBLE) * name + CAST(.4 AS DOUBLE) * greatest(own, rank_share), 6) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id DESC) AS rank FROM scored),
best AS (SELECT m.mention_id, m.expected_id, CASE WHEN score >= .85 THEN id END AS entity_id, CASE WHEN score >= .85 THEN score ELSE 0 END AS confidence, NOT coalesce(score >= .85, FALSE) AS is_new, 'Concept' AS type FROM m LEFT JOIN ranked ON ranked.mention_id = m.mention_id AND rank = 1)"""


@query("txt_11_resolver_similarity", _RANKED + " SELECT mention_id, confidence FROM best")
def txt_11(spark, d):
    return resolved(spark, d).select("mention_id", "confidence")


@query("kgc_04_resolve", _RANKED + " SELECT mention_id, entity_id, confidence, is_new, type FROM best")
def kgc_04(spark, d):
    return resolved(spark, d)


@query("win_03_best_candidates", _RANKED + " SELECT mention_id, entity_id FROM best WHERE NOT is_new")
def win_03(spark, d):
    return resolved(spark, d).filter("not is_new").select("mention_id", "entity_id")


@query("win_03_ranked_candidates", _RANKED + " SELECT mention_id, id AS entity_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def win_03_ranked(spark, d):
    return kg.ranked_candidates(derived(spark, d, _MENTIONS), products(spark, d)).select("mention_id", "entity_id", "score", "rank")


query("kgc_03_build_into_stored")(lambda spark, d: built(spark, d))


def built(spark, d):
    """The graph of all responses upserted into that of every second document's: what is there stays one row."""
    made = kg.build_graph(responses(spark, d), tasks=tasks(spark, d))
    stored = tuple(rows.filter("doc_id % 2 = 0").withColumn("updated_at", F.lit(None).cast("timestamp")) for rows in made)
    merged = kg.build_graph(responses(spark, d), stored=stored, tasks=tasks(spark, d))
    part = lambda kind, rows: rows.groupBy((c("doc_id") % 2 == 0).alias("stored")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("updated_at").alias("touched")).withColumn("kind", F.lit(kind))
    return part("entity", merged[0]).unionByName(part("relation", merged[1]))


_ACCURACY = " SELECT count(*) FILTER (entity_id = expected_id) AS correct, count(*) AS total, round(count(*) FILTER (entity_id = expected_id) / count(*), 6) AS accuracy FROM best"


@query("agg_23_resolution_accuracy", _RANKED + _ACCURACY)
def agg_23(spark, d):
    return kg.resolution_accuracy(resolved(spark, d), derived(spark, d, _MENTIONS).select("mention_id", "expected_id"))


def resolved(spark, d):
    return kg.resolve(derived(spark, d, _MENTIONS).drop("expected_id"), products(spark, d))
