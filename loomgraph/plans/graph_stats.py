"""Queries over graph statistics and quality."""

from __future__ import annotations

from ..operators import stats
from .catalog import query
from .fixtures import GRAPH_SQL, entities, relations
from ..tables import written

_DEG = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM r UNION ALL SELECT dst FROM r WHERE dst <> src) z GROUP BY id)"
_PROPS = "(CAST(id IS NOT NULL AS INT) + CAST(name IS NOT NULL AS INT) + CAST(type IS NOT NULL AS INT) + CAST(confidence IS NOT NULL AS INT) + CAST(description IS NOT NULL AS INT) + 1 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)"


def both(f):
    """f over both tables; the relations, whose pairs are made distinct, are made once."""
    return lambda spark, d: f(entities(spark, d), written(relations(spark, d), "relations"))


query("agg_01_entity_stats", f"{GRAPH_SQL}, {_DEG} SELECT count(*) AS total, round_even(avg(confidence), 4) AS avg_confidence, round_even(sum(coalesce(degree, 0)) / count(*), 4) AS avg_degree FROM e LEFT JOIN d USING (id)")(both(stats.entity_stats))
query("agg_01_entities_by_type", f"{GRAPH_SQL} SELECT type, count(*) AS n FROM e GROUP BY type")(lambda spark, d: stats.counts_by_type(entities(spark, d)))
query("agg_02_relation_stats", f"{GRAPH_SQL} SELECT count(*) AS total, round_even(avg(confidence), 4) AS avg_confidence, round_even(avg(length(evidence)), 2) AS avg_evidence_length FROM r")(lambda spark, d: stats.relation_stats(relations(spark, d)))
query("agg_02_relations_by_type", f"{GRAPH_SQL} SELECT type, count(*) AS n FROM r GROUP BY type")(lambda spark, d: stats.counts_by_type(relations(spark, d)))
_DENSITY = "(SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM r) AS edges, round_even((SELECT count(*) FROM r) / ((SELECT count(*) FROM e) * ((SELECT count(*) FROM e) - 1)), 6) AS density, (SELECT count(*) FROM e) * ((SELECT count(*) FROM e) - 1) AS max_edges, round_even((SELECT count(*) FROM e WHERE id IN (SELECT id FROM d)) / (SELECT count(*) FROM e), 4) AS connected_ratio"
query("agg_03_density", f"{GRAPH_SQL}, {_DEG} SELECT {_DENSITY}")(both(stats.density))
query("agg_04_overview", f"{GRAPH_SQL}, {_DEG} SELECT {_DENSITY}, (SELECT count(DISTINCT type) FROM e) AS entity_types, (SELECT count(DISTINCT type) FROM r) AS relation_types")(both(stats.overview))
_LEVEL = "CASE WHEN confidence >= .9 THEN 'high' WHEN confidence >= .7 THEN 'medium' WHEN confidence >= .5 THEN 'low' ELSE 'very_low' END"
query("agg_05_confidence_distribution", f"{GRAPH_SQL} SELECT kind, {_LEVEL} AS level, count(*) AS n FROM (SELECT 'entity' AS kind, confidence FROM e UNION ALL SELECT 'relation', confidence FROM r) z WHERE confidence IS NOT NULL GROUP BY ALL")(both(stats.confidence_distribution))
_COMPLETE = f"c AS (SELECT least(1.0, count(*) / 1000) AS a, least(1.0, (SELECT count(*) FROM r) / (2 * count(*))) AS b, least(1.0, avg({_PROPS}) / 5) AS p, avg(CASE WHEN length(description) > 10 THEN 1 ELSE 0 END) AS s FROM e)"
query("agg_07_completeness", f"{GRAPH_SQL}, {_COMPLETE} SELECT round_even(a, 4) AS entity_score, round_even(b, 4) AS relation_score, round_even(p, 4) AS property_score, round_even(s, 4) AS description_score, round_even((a + b + p + s) / 4, 4) AS completeness FROM c")(both(stats.completeness))
_CONSIST = "k1 AS (SELECT avg(CASE WHEN n > 0.01 * w THEN 1 ELSE 0 END) AS types FROM (SELECT count(*) AS n, (SELECT count(*) FROM e) AS w FROM e GROUP BY type) z), k2 AS (SELECT avg(CASE WHEN n > 0.01 * w THEN 1 ELSE 0 END) AS kinds FROM (SELECT count(*) AS n, (SELECT count(*) FROM r) AS w FROM r GROUP BY type) z), k3 AS (SELECT avg(CASE WHEN length(name) BETWEEN 2 AND 50 THEN 1 ELSE 0 END) AS names FROM e)"
query("agg_08_consistency", f"{GRAPH_SQL}, {_CONSIST} SELECT round_even(types, 4) AS types, round_even(names, 4) AS names, round_even(kinds, 4) AS kinds, round_even(.4 * types + .3 * names + .3 * kinds, 4) AS consistency FROM k1, k2, k3")(both(stats.consistency))
_ACC = "x AS (SELECT avg(confidence) AS ea, count(*) FILTER (confidence >= .8) AS eh, count(*) FILTER (confidence < .5) AS el, count(*) AS en FROM e), y AS (SELECT avg(confidence) AS ra, count(*) FILTER (confidence >= .8) AS rh, count(*) FILTER (confidence < .5) AS rl, count(*) AS rn FROM r)"
query("agg_09_accuracy", f"{GRAPH_SQL}, {_ACC} SELECT round_even(ea, 4) AS entity_confidence, round_even(ra, 4) AS relation_confidence, round_even((eh + rh) / (en + rn), 4) AS high_share, el + rl AS low_count, round_even(.35 * ea + .35 * ra + .3 * (eh + rh) / (en + rn), 4) AS accuracy FROM x, y")(both(stats.accuracy))
_CODES = "concat_ws(',', CASE WHEN round_even(a, 4) < .5 THEN 'ADD_ENTITIES' END, CASE WHEN round_even(b, 4) < .5 THEN 'ADD_RELATIONS' END, CASE WHEN round_even(p, 4) < .5 THEN 'ADD_PROPERTIES' END, CASE WHEN round_even(s, 4) < .5 THEN 'ADD_DESCRIPTIONS' END, CASE WHEN types < .5 THEN 'BALANCE_ENTITY_TYPES' END, CASE WHEN names < .8 THEN 'FIX_NAMES' END, CASE WHEN kinds < .5 THEN 'BALANCE_RELATION_TYPES' END, CASE WHEN ea < .7 THEN 'REVIEW_ENTITIES' END, CASE WHEN ra < .7 THEN 'REVIEW_RELATIONS' END)"
_MIX = "SELECT round_even((a + b + p + s) / 4, 4) AS completeness, round_even(.4 * types + .3 * names + .3 * kinds, 4) AS consistency, round_even(.35 * ea + .35 * ra + .3 * (eh + rh) / (en + rn), 4) AS accuracy, " + _CODES + " AS recommendations FROM c, k1, k2, k3, x, y"
query("agg_10_quality_report", f"{GRAPH_SQL}, {_COMPLETE}, {_CONSIST}, {_ACC}, q AS ({_MIX}) SELECT completeness, consistency, accuracy, round_even(.35 * completeness + .3 * consistency + .35 * accuracy, 4) AS quality, CASE WHEN .35 * completeness + .3 * consistency + .35 * accuracy >= .85 THEN 'excellent' WHEN .35 * completeness + .3 * consistency + .35 * accuracy >= .7 THEN 'good' WHEN .35 * completeness + .3 * consistency + .35 * accuracy >= .55 THEN 'fair' ELSE 'poor' END AS level, recommendations FROM q")(both(stats.quality_report))
query("agg_11_entity_quality", f"{GRAPH_SQL}, {_DEG} SELECT id, round_even(.3 * confidence + .2 * CASE WHEN length(description) > 10 THEN 1 ELSE 0 END + least(.3, .1 * coalesce(degree, 0)) + least(.2, .05 * (1 + CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)), 4) AS quality FROM e LEFT JOIN d USING (id)")(both(stats.entity_quality))
query("agg_12_relation_quality", f"{GRAPH_SQL} SELECT id, round_even(.4 * confidence + .3 * CASE WHEN length(evidence) > 5 THEN 1 ELSE 0 END + least(.3, .1 * (1 + CASE WHEN evidence IS NULL THEN 0 ELSE 1 END)), 4) AS quality FROM r")(lambda spark, d: stats.relation_quality(relations(spark, d)))
query("win_01_top_by_degree", f"{GRAPH_SQL}, {_DEG} SELECT id, degree, name, type FROM e JOIN d USING (id) ORDER BY degree DESC, id LIMIT 20")(both(stats.top_by_degree))
query("join_05_orphans", f"{GRAPH_SQL}, {_DEG} SELECT id, name, type FROM e WHERE id NOT IN (SELECT id FROM d) ORDER BY id LIMIT 100")(both(stats.orphans))
query("join_06_connected", f"{GRAPH_SQL}, {_DEG} SELECT type, count(*) AS n FROM e WHERE id IN (SELECT id FROM d) GROUP BY type")(lambda spark, d: stats.counts_by_type(stats.connected(entities(spark, d), relations(spark, d))))
query("join_07_degree_with_zero", f"{GRAPH_SQL}, {_DEG} SELECT id, coalesce(degree, 0) AS degree FROM e LEFT JOIN d USING (id)")(both(stats.degrees))
