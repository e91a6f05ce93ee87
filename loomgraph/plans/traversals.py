"""Queries over graph traversals: from all nations, or from the orders whose key is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, operations, paths
from .catalog import query
from .fixtures import GRAPH_SQL, derived, entities, relations

c = F.col
_R = GRAPH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
_SEEDS = "SELECT concat('N', CAST(n_nationkey AS STRING)) AS id FROM nation"
_ORDERS = "SELECT concat('O', CAST(o_orderkey AS STRING)) AS id FROM orders WHERE o_orderkey % 100 = 0"
_B = "b AS (SELECT id AS edge, src AS near, dst AS far, confidence, type FROM r UNION ALL SELECT id, dst, src, confidence, type FROM r WHERE src <> dst)"


def seeds(spark, d, sql=_SEEDS):
    return derived(spark, d, sql)


def trail_sql(seed, hops, where="TRUE"):
    return f"""{_R}, {_B}, t AS (SELECT id AS seed, id, 0 AS hops, CAST([] AS VARCHAR[]) AS edges, CAST([] AS DOUBLE[]) AS cs FROM ({seed}) s
 UNION ALL SELECT seed, far, hops + 1, list_append(edges, edge), list_append(cs, b.confidence) FROM t JOIN b ON near = t.id WHERE hops < {hops} AND NOT list_contains(edges, edge) AND {where})"""


_REACH = f"""{_R}, {_B}, l0 AS ({_SEEDS}), t AS (SELECT id AS seed, id, 0 AS hops FROM l0 UNION SELECT seed, far, hops + 1 FROM t JOIN b ON near = t.id WHERE hops < 2 AND b.type IN ('LOCATED_AT', 'BELONGS_TO'))
SELECT seed, id, min(hops) AS hops FROM t GROUP BY seed, id"""
query("grf_01_bfs", _REACH)(lambda spark, d: graph.bfs(relations(spark, d), entities(spark, d), seeds(spark, d), 2, types=["LOCATED_AT", "BELONGS_TO"], cap=1_000_000).select("seed", "id", "hops"))
_DIST = f"""{_R}, {_B}, t AS (SELECT id AS seed, id, CAST(0 AS DOUBLE) AS dist, 0 AS hops FROM ({_ORDERS}) s UNION SELECT seed, far, dist + 1 / greatest(b.confidence, .1), hops + 1 FROM t JOIN b ON near = t.id WHERE dist < 2.0 AND hops < 6)
SELECT seed, id, round(min(dist), 6) AS distance FROM t GROUP BY seed, id"""
query("grf_02_weighted_distances", _DIST)(lambda spark, d: paths.weighted_distances(relations(spark, d), seeds(spark, d, _ORDERS), 2.0).select("seed", "id", F.round("distance", 6).alias("distance")))
_WAYS = f"""{_R}, {_B}, t AS (SELECT id AS seed, id, CAST(0 AS DOUBLE) AS dist, 0 AS hops, CAST([] AS VARCHAR[]) AS back, CAST([] AS VARCHAR[]) AS edges FROM ({_ORDERS}) s
 UNION ALL SELECT seed, far, dist + 1 / greatest(b.confidence, .1), hops + 1, list_concat([near, edge], back), list_append(edges, edge) FROM t JOIN b ON near = t.id WHERE dist < 2.0)
SELECT seed, id, round(w.dist, 6) AS distance, w.hops AS hops, array_to_string(w.edges, '>') AS edges FROM (SELECT seed, id, arg_min({{'dist': dist, 'hops': hops, 'edges': edges}}, (dist, hops, back)) AS w FROM t GROUP BY seed, id) z"""


@query("grf_02_weighted_paths", _WAYS)
def grf_02(spark, d):
    """Cheapest ways from every hundredth order to all nodes within reach."""
    found = paths.weighted_paths(relations(spark, d), seeds(spark, d, _ORDERS), 2.0)
    return found.select("seed", "id", F.round("distance", 6).alias("distance"), "hops", F.array_join("edges", ">").alias("edges"))


query("grf_03_shortest_paths", trail_sql(_SEEDS, 3, "b.type IN ('LOCATED_AT', 'BELONGS_TO')") + ", o AS (SELECT concat('S', CAST(s_suppkey AS STRING)) AS id FROM supplier) SELECT seed AS start, t.id AS \"end\", min(hops) AS hops FROM t JOIN o ON o.id = t.id GROUP BY ALL")(lambda spark, d: paths.shortest_paths(relations(spark, d), seeds(spark, d).select(c("id").alias("start")).join(derived(spark, d, "SELECT concat('S', CAST(s_suppkey AS STRING)) AS end FROM supplier")), 3, types=["LOCATED_AT", "BELONGS_TO"]).select("start", "end", "hops"))
query("grf_04_all_trails", trail_sql(_ORDERS, 2) + " SELECT seed, id, hops, array_to_string(edges, '>') AS edges FROM t WHERE hops > 0")(lambda spark, d: graph.trails(relations(spark, d), seeds(spark, d, _ORDERS), 2).select("seed", "id", "hops", F.array_join("edges", ">").alias("edges")))
query("grf_05_exact_trails", trail_sql(_ORDERS, 3, "b.type <> 'DEPENDS_ON'") + " SELECT seed, count(*) AS n, count(DISTINCT id) AS ends FROM t WHERE hops = 3 GROUP BY seed")(lambda spark, d: graph.trail_counts(relations(spark, d).filter("type != 'DEPENDS_ON'"), seeds(spark, d, _ORDERS), 3))
_BETWEEN = f"""{trail_sql(_ORDERS, 2)}, u AS (SELECT concat('R', CAST(r_regionkey AS STRING)) AS seed, concat('R', CAST(r_regionkey AS STRING)) AS id, 0 AS hops, CAST([] AS VARCHAR[]) AS edges FROM region
 UNION ALL SELECT seed, far, hops + 1, list_concat([edge], edges) FROM u JOIN b ON near = u.id WHERE hops < 2 AND NOT list_contains(edges, edge)),
w AS (SELECT t.seed AS start, u.seed AS "end", t.hops + u.hops AS hops, list_concat(t.edges, u.edges) AS edges FROM t JOIN u ON t.id = u.id AND t.hops - u.hops IN (0, 1) AND t.hops > 0 WHERE NOT list_has_any(t.edges, u.edges))"""


def order_regions(spark, d):
    """Every hundredth order with each of the regions, of which there are five at any size."""
    return seeds(spark, d, _ORDERS).select(c("id").alias("start")).join(derived(spark, d, "SELECT concat('R', CAST(r_regionkey AS STRING)) AS end FROM region"))


@query("grf_04_trails_between", _BETWEEN + " SELECT start, \"end\", hops, array_to_string(edges, '>') AS edges FROM w")
def grf_04_between(spark, d):
    """All trails of up to four edges between orders and regions, met in the middle."""
    found = paths.trails_between(relations(spark, d), order_regions(spark, d), 4)
    return found.select("start", "end", "hops", F.array_join("edges", ">").alias("edges"))


_FIRST = " SELECT start, \"end\", hops, array_to_string(edges, '>') AS edges FROM (SELECT *, row_number() OVER (PARTITION BY start, \"end\" ORDER BY hops, edges) AS place FROM w) z WHERE place <= 5"


@query("grf_04_trails_between_limit", _BETWEEN + _FIRST)
def grf_04_limit(spark, d):
    """Of each pair the five shortest trails."""
    found = paths.trails_between(relations(spark, d), order_regions(spark, d), 4, limit=5)
    return found.select("start", "end", "hops", F.array_join("edges", ">").alias("edges"))


@query("grf_05_exact_trails_between", _BETWEEN + " SELECT start, \"end\", count(*) AS n, min(array_to_string(edges, '>')) AS least FROM w WHERE hops = 4 GROUP BY ALL")
def grf_05_between(spark, d):
    """How many trails of exactly four edges each order and region have."""
    found = paths.trails_between(relations(spark, d), order_regions(spark, d), 4, exact=True)
    return found.groupBy("start", "end").agg(F.count("*").alias("n"), F.min(F.array_join("edges", ">")).alias("least"))


query("grf_06_path_confidence", trail_sql(_ORDERS, 2) + " SELECT array_to_string(edges, '>') AS edges, seed, round_even(power(list_product(cs), 1.0 / hops), 4) AS confidence FROM t WHERE hops > 0")(lambda spark, d: graph.trails(relations(spark, d), seeds(spark, d, _ORDERS), 2).select(F.array_join("edges", ">").alias("edges"), "seed", graph.path_confidence(c("confidences")).alias("confidence")))
query("grf_07_multi_hop", trail_sql(_ORDERS, 2) + " SELECT seed, id, hops, place FROM (SELECT seed, t.id, hops, row_number() OVER (PARTITION BY seed ORDER BY hops, name, edges) AS place FROM t JOIN e ON e.id = t.id WHERE hops > 0 AND e.type = 'Product') z WHERE place <= 100")(lambda spark, d: graph.multi_hop(relations(spark, d), entities(spark, d), seeds(spark, d, _ORDERS), 2, entity_types=["Product"]).select("seed", "id", "hops", c("place").cast("long").alias("place")))
query("grf_08_subgraph", f"{GRAPH_SQL}, {_B}, s AS ({_SEEDS}) SELECT DISTINCT edge AS id FROM (SELECT edge, near, row_number() OVER (PARTITION BY near ORDER BY edge, far) AS place FROM b JOIN s ON near = s.id) z WHERE place <= 40")(lambda spark, d: graph.subgraph(relations(spark, d), entities(spark, d), seeds(spark, d), 40)[1].select("id"))
query("grf_09_evidence_paths", trail_sql(_ORDERS, 2) + " SELECT seed, rank, round(list_product(cs) * (.5 + .5 / hops), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, edges) AS rank FROM t WHERE hops > 0 AND id <> seed) z WHERE rank <= 10")(lambda spark, d: graph.evidence_paths(relations(spark, d), seeds(spark, d, _ORDERS)).select("seed", c("rank").cast("long").alias("rank"), F.round("confidence", 6).alias("confidence")))
query("agg_24_chain_confidence", trail_sql(_ORDERS, 2) + ", p AS (SELECT seed, rank, list_product(cs) * (.5 + .5 / hops) AS c FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, edges) AS rank FROM t WHERE hops > 0 AND id <> seed) z WHERE rank <= 10) SELECT seed, round(least(1, sum(c / rank) / sum(1 / rank) * (.7 + .3 * least(1, count(*) / 5))), 6) AS confidence FROM p GROUP BY seed")(lambda spark, d: operations.weighted_chain_confidence(graph.evidence_paths(relations(spark, d), seeds(spark, d, _ORDERS)), "seed").select("seed", F.round("confidence", 6).alias("confidence")))
_PATHS = trail_sql(_ORDERS, 2) + ", p AS (SELECT *, list_product(cs) * (.5 + .5 / hops) AS c FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, edges) AS rank FROM t WHERE hops > 0 AND id <> seed) z WHERE rank <= 10)"
_LINKS = """, used AS (SELECT DISTINCT seed, unnest(edges) AS edge FROM p), ends AS (SELECT seed, src AS id FROM used JOIN r ON r.id = edge UNION SELECT seed, dst FROM used JOIN r ON r.id = edge),
links AS (SELECT seed, e.id AS key, [k % 97, k % 89] AS docs FROM ends JOIN e ON e.id = ends.id UNION ALL SELECT seed, concat(src, '_', type, '_', dst), [length(r.id) * 7 % 50, length(src)] FROM used JOIN r ON r.id = edge),
flat AS (SELECT DISTINCT seed, key, unnest(docs) AS doc FROM links)"""


def with_documents(spark, d):
    """Relations and entities with source_docs, as the SQL twins restate them."""
    wide = lambda *cs: F.array(*(x.cast("long") for x in cs)).alias("source_docs")
    known = entities(spark, d).select("*", wide(c("created_s") % 97, c("created_s") % 89))
    return relations(spark, d).select("*", wide(F.length("id") * 7 % 50, F.length("src"))), known


@query("set_04_linked_documents", _PATHS + _LINKS + " SELECT seed, key, string_agg(CAST(doc AS STRING), ',' ORDER BY doc) AS documents FROM flat GROUP BY seed, key")
def set_04(spark, d):
    edges, nodes = with_documents(spark, d)
    found = graph.linked_documents(graph.evidence_paths(edges, seeds(spark, d, _ORDERS)), edges, nodes)
    return found.select("seed", "key", F.array_join(c("documents").cast("array<string>"), ",").alias("documents"))


_CHAIN = ", n AS (SELECT seed, string_agg(CAST(doc AS STRING), ',' ORDER BY doc) AS documents FROM (SELECT DISTINCT seed, doc FROM flat) z GROUP BY seed), s AS (SELECT seed, count(*) AS n_paths, round(least(1, sum(c / rank) / sum(1 / rank) * (.7 + .3 * least(1, count(*) / 5))), 6) AS confidence, string_agg(array_to_string(edges, '>'), ';' ORDER BY rank) AS paths FROM p GROUP BY seed)"


@query("grf_10_evidence_chains", _PATHS + _LINKS + _CHAIN + f" SELECT e.id AS seed, e.name, coalesce(n_paths, 0) AS n_paths, coalesce(s.confidence, 0) AS confidence, coalesce(paths, '') AS paths, coalesce(documents, '') AS documents FROM ({_ORDERS}) q JOIN e ON e.id = q.id LEFT JOIN s ON s.seed = e.id LEFT JOIN n ON n.seed = e.id")
def grf_10(spark, d):
    edges, nodes = with_documents(spark, d)
    found = graph.evidence_chains(edges, nodes, seeds(spark, d, _ORDERS), max_hops=2, min_confidence=None)
    paths = F.array_join(F.transform("paths", lambda p: F.array_join(p["edges"], ">")), ";")
    documents = F.array_join(c("documents").cast("array<string>"), ",")
    return found.select("seed", c("start.name").alias("name"), F.size("paths").cast("long").alias("n_paths"), F.round("confidence", 6).alias("confidence"), paths.alias("paths"), documents.alias("documents"))


_CAPPED = f"""{GRAPH_SQL}, {_B}, st AS (SELECT near, far FROM (SELECT *, row_number() OVER (PARTITION BY near ORDER BY edge, far) AS place FROM b) z WHERE place <= 50),
l0 AS ({_ORDERS}),
l1 AS (SELECT seed, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM (SELECT DISTINCT l0.id AS seed, far AS id FROM l0 JOIN st ON near = l0.id WHERE far <> l0.id) y) z WHERE place <= 29),
g1 AS (SELECT seed, count(*) + 1 AS given FROM l1 GROUP BY seed),
l2 AS (SELECT seed, id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM (SELECT DISTINCT l1.seed, far AS id FROM l1 JOIN st ON near = l1.id WHERE far <> l1.seed AND NOT EXISTS (SELECT 1 FROM l1 o WHERE o.seed = l1.seed AND o.id = far)) y) z JOIN g1 USING (seed) WHERE place + given <= 30)
SELECT id AS seed, id, 0 AS hops FROM l0 UNION ALL SELECT seed, id, 1 FROM l1 UNION ALL SELECT seed, id, 2 FROM l2"""
query("grf_01_bfs_limit", _CAPPED)(lambda spark, d: graph.bfs(relations(spark, d), entities(spark, d), seeds(spark, d, _ORDERS), 2, limit=30).select("seed", "id", "hops"))
_DEEP = f"""{GRAPH_SQL}, {_B}, s AS ({_ORDERS}), x1 AS (SELECT DISTINCT edge FROM (SELECT edge, row_number() OVER (PARTITION BY near ORDER BY edge, far) AS place FROM b JOIN s ON near = s.id) z WHERE place <= 20),
f1 AS (SELECT src AS id FROM r WHERE id IN (SELECT edge FROM x1) UNION SELECT dst FROM r WHERE id IN (SELECT edge FROM x1)),
x2 AS (SELECT DISTINCT edge FROM (SELECT edge, row_number() OVER (PARTITION BY near ORDER BY edge, far) AS place FROM b WHERE near IN (SELECT id FROM f1) AND near NOT IN (SELECT id FROM s)) z WHERE place <= 20),
xs AS (SELECT edge FROM x1 UNION SELECT edge FROM x2) SELECT 'edge' AS kind, edge AS id FROM xs UNION ALL SELECT 'node', id FROM (SELECT id FROM s UNION SELECT src FROM r WHERE id IN (SELECT edge FROM xs) UNION SELECT dst FROM r WHERE id IN (SELECT edge FROM xs)) z"""


@query("grf_08_subgraph_depth_2", _DEEP)
def grf_08_deep(spark, d):
    nodes, edges = graph.subgraph(relations(spark, d), entities(spark, d), seeds(spark, d, _ORDERS), 20, depth=2, expand=True)
    return edges.select(F.lit("edge").alias("kind"), "id").unionByName(nodes.select(F.lit("node").alias("kind"), "id"))


query("src_07_export", f"{GRAPH_SQL}, s AS ({_SEEDS}), g AS (SELECT DISTINCT edge FROM (SELECT id AS edge, near, row_number() OVER (PARTITION BY near ORDER BY id, way) AS place FROM (SELECT *, src AS near, 'outgoing' AS way FROM r UNION ALL SELECT *, dst, 'incoming' FROM r WHERE src <> dst) q WHERE near IN (SELECT id FROM s)) z WHERE place <= 100), n AS (SELECT src AS id FROM r WHERE id IN (SELECT edge FROM g) UNION ALL SELECT dst FROM r WHERE id IN (SELECT edge FROM g) AND dst <> src) SELECT e.id, name AS label, round(20 * least(2, 1 + .1 * count(*)), 6) AS size FROM n JOIN e ON e.id = n.id GROUP BY e.id, name")(lambda spark, d: graph.export(relations(spark, d), entities(spark, d), seeds(spark, d))[0].select("id", "label", F.round("size", 6).alias("size")))
