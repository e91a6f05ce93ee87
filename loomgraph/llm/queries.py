"""The corpus operators' queries, by the names under which the entry module registers them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, license_scan, ordering, periodic, quality, secret_scan, shuffling, similarity, substring, toxicity, url_filter


OPERATORS = (
    toxicity.op1_toxicity,
    decontaminate.op2_decontaminate,
    ordering.op3_training_order,
    similarity.op4_ngram_jaccard,
    license_scan.op5_license_scan,
    bpe.op6_bpe,
    quality.op7_quality,
    secret_scan.op8_secret_scan,
    shuffling.op9_shuffle,
    substring.op10_substring_dedup,
    centroids.op11_centroid_clusters,
    url_filter.op12_url_filter,
    periodic.op13_periodic_runs,
)


def quality_base_counts(spark, sf_dir: str) -> DataFrame:
    """What of op7 SQL can restate."""
    return quality.op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base_spans(spark, sf_dir: str) -> DataFrame:
    """What of op8 SQL can restate."""
    return secret_scan.op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def shuffle_law(spark, sf_dir: str) -> DataFrame:
    """op9's shards: their sizes, first and last slot, and what they hold together."""
    rows = shuffling.op9_shuffle(spark, sf_dir)
    whole = rows.agg(F.sum("size").alias("all_bytes"), F.countDistinct("doc_id").alias("all_ids"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots")).join(whole)


def queries() -> dict:
    return {f.__name__: f for f in (*OPERATORS, quality_base_counts, secret_base_spans, shuffle_law)}


_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE_SQL = f"""WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0) z),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n) z),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) z GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS STRING) AS item FROM h) z GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUBSTRING_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50) z),
f AS (SELECT k, min(doc_id) AS source FROM p GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM p JOIN f USING (k) WHERE source < doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
v AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d) z ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN v USING (doc_id)"""


def _license_sql() -> str:
    """Blocks of two sizes, matches by plain set intersection, and no match that another one of its block explains."""
    rows, halves = [], {True: 1, False: license_scan.BLOCK // 2}
    for label, notice, needed in license_scan.TEMPLATES:
        words = license_scan.running_words(notice)
        different = sorted(set(words))
        short = len(different) < license_scan.SHORT
        halves[short] = max(halves[short], len(words))
        least = len(different) if short else math.ceil(len(different) * license_scan.CONTAINMENT - 1e-9)
        rows.append(f"('{label}', {short}, {different}, {len(different)}, {least}, {needed.split()})")
    phrases = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in license_scan.PHRASES.items())
    sizes = ", ".join(f"({short}, {half})" for short, half in halves.items())
    return f"""WITH d AS (SELECT doc_id, text, {_LOWER_WORDS} AS w FROM documents),
ph(label, p) AS (VALUES {phrases}), t(label, short, words, n, least, needed) AS (VALUES {", ".join(rows)}), h(short, half) AS (VALUES {sizes}),
hits AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0) z, ph WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
parts AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))) z),
cuts AS (SELECT doc_id, w, short, half, unnest(CASE WHEN len(w) <= 2 * half THEN [1] ELSE generate_series(1, greatest(len(w) - half, 1), half) END) AS i FROM parts, h WHERE len(w) > 0),
blocks AS MATERIALIZED (SELECT row_number() OVER () AS block, doc_id, short, list_distinct(w[i : i + 2 * half - 1]) AS v FROM cuts),
m AS MATERIALIZED (SELECT block, doc_id, label, n, list_intersect(words, v) AS common, len(list_intersect(words, v)) / n AS share FROM blocks JOIN t USING (short) WHERE len(list_intersect(words, v)) >= least AND len(list_intersect(needed, v)) = len(needed)),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.block = m.block AND len(list_intersect(m.common, o.common)) = len(m.common) AND (len(o.common) > len(m.common) OR o.share > m.share))),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM k) z GROUP BY doc_id),
x AS (SELECT doc_id, max(share) AS share FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id)"""


QUALITY_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) z WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8) z),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM g WHERE n > 1) z GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""


def _secret_sql() -> str:
    parts = []
    for place, (kind, (pattern, group, least)) in enumerate(secret_scan.KINDS.items()):
        pattern = pattern.replace("'", "''")
        matches = f"regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value, string_split_regex(text, '{pattern}') AS piece"
        steps = f"SELECT doc_id, i, length(piece[i]) AS before, length(whole[i]) AS n, length(value[i]) AS size FROM (SELECT doc_id, whole, value, piece, unnest(generate_series(1, len(whole))) AS i FROM (SELECT doc_id, {matches} FROM d) z WHERE len(whole) > 0) y"
        parts.append(f"SELECT doc_id, {place} AS place, '{kind}' AS kind, start, start + n AS \"end\" FROM (SELECT *, sum(before + n) OVER (PARTITION BY doc_id ORDER BY i) - n AS start FROM ({steps}) x) v WHERE size >= {least}")
    spans = " UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({spans}),
a AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, string_agg(concat(kind, ':', start, ':', "end"), ',' ORDER BY start, place) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)"""


SHUFFLE_SQL = f"""SELECT CAST(s AS INT) AS shard, n // {shuffling.SHARDS} + CASE WHEN s < n % {shuffling.SHARDS} THEN 1 ELSE 0 END AS n, CAST(0 AS BIGINT) AS first_slot, n // {shuffling.SHARDS} + CASE WHEN s < n % {shuffling.SHARDS} THEN 0 ELSE -1 END AS last_slot, n // {shuffling.SHARDS} + CASE WHEN s < n % {shuffling.SHARDS} THEN 1 ELSE 0 END AS slots, all_bytes, all_ids
FROM (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS all_bytes, count(DISTINCT doc_id) AS all_ids FROM documents) z, generate_series(0, {shuffling.SHARDS - 1}) g(s) WHERE n > s"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact floored means, each a materialised table."""
    near = """SELECT vec_id, a, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.n, v.vec_id, v.a, c{r}.c, list_sum(list_transform(range(1, 65), lambda i: (v.a[i] - c{r}.a[i]) * (v.a[i] - c{r}.a[i])))::BIGINT AS d FROM v, c{r}) z GROUP BY n, vec_id, a"""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT place - 1 AS c, a FROM (SELECT a, row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), a) AS place FROM v) z WHERE place <= {k})",
    ]
    for r in range(rounds):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS a FROM (SELECT c, i, CAST(sum(a[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, a, unnest(range(1, 65)) AS i FROM n{r}) z GROUP BY c, i) y GROUP BY c)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.a, c{r}.a) AS a FROM c{r} LEFT JOIN m{r} USING (c))")
    steps.append(f"n{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.a, ',')) AS centroid_sha256 FROM n{rounds} JOIN c{rounds} USING (c)"""


def _url_sql() -> str:
    rules = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in url_filter.RULES)
    return f"""WITH ru(action, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS behind FROM pages),
h AS (SELECT n, page_id, translate(regexp_extract(behind, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(behind, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT n, max((length(rhost) + length(rpath), action = 'block', concat(rhost, rpath), action)) AS best FROM h JOIN ru ON (host = rhost OR ends_with(host, concat('.', rhost))) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, best[3] AS rule, coalesce(best[4], 'allow') AS verdict FROM h LEFT JOIN m USING (n)"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against plain Python in tests/llm."""
    return {
        "op2_decontaminate": DECONTAMINATE_SQL,
        "op5_license_scan": _license_sql(),
        "op10_substring_dedup": SUBSTRING_SQL,
        "op11_centroid_clusters": _centroid_sql(),
        "op12_url_filter": _url_sql(),
        "quality_base_counts": QUALITY_SQL,
        "secret_base_spans": _secret_sql(),
        "shuffle_law": SHUFFLE_SQL,
    }
