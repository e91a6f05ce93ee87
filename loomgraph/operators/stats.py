"""Statistics and quality scores of a property graph (entities, relations). Each is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_ends(relations: DataFrame) -> DataFrame:
    """One row for each relation and end; a loop counts once."""
    return relations.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))


def degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id, degree (0 for orphans)."""
    return with_degree(entities.select("id"), relations)


def with_degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities with degree."""
    counted = both_ends(relations).groupBy("id").agg(F.count("*").alias("degree"))
    return entities.join(counted, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def entity_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """total, average confidence and average degree (four places, halves to even)."""
    seen = with_degree(entities, relations).agg(F.count("*").alias("total"), F.avg("confidence").alias("confidence"), F.sum("degree").alias("ends"))
    return seen.select("total", F.bround("confidence", 4).alias("avg_confidence"), F.bround(F.coalesce("ends", F.lit(0)) / F.col("total"), 4).alias("avg_degree"))


def counts_by_type(rows: DataFrame, column: str = "type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def relation_stats(relations: DataFrame) -> DataFrame:
    return relations.agg(F.count("*").alias("total"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"), F.bround(F.avg(F.length("evidence")), 2).alias("avg_evidence_length"))


def linked_counts(entities: DataFrame, relations: DataFrame, *more: Column) -> DataFrame:
    """One row: nodes, those with an edge (linked), and more aggregates over entities, all from one pass."""
    ends = both_ends(relations).distinct().withColumn("linked", F.lit(1))
    return entities.join(ends, "id", "left").agg(F.count("*").alias("nodes"), F.count("linked").alias("linked"), *more)


def _density(both: DataFrame, *more: str) -> DataFrame:
    most = F.col("nodes") * (F.col("nodes") - 1)
    density = F.bround(F.when(most > 0, F.col("edges") / most).otherwise(0.0), 6)
    ratio = F.bround(F.when(F.col("nodes") > 0, F.col("linked") / F.col("nodes")).otherwise(0.0), 4)
    return both.select("nodes", "edges", density.alias("density"), most.alias("max_edges"), ratio.alias("connected_ratio"), *more)


def density(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """nodes, edges, m / (n (n - 1)), most possible edges and the share of entities with an edge."""
    return _density(linked_counts(entities, relations).join(relations.agg(F.count("*").alias("edges"))))


def overview(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """density, and the numbers of entity and relation types."""
    nodes = linked_counts(entities, relations, F.size(F.collect_set("type")).cast("long").alias("entity_types"))
    edges = relations.agg(F.count("*").alias("edges"), F.size(F.collect_set("type")).cast("long").alias("relation_types"))
    return _density(nodes.join(edges), "entity_types", "relation_types")


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "medium").when(confidence >= 0.5, "low").when(confidence.isNotNull(), "very_low")


def confidence_distribution(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, level, n; rows without confidence are left out."""
    both = entities.select(F.lit("entity").alias("kind"), "confidence").unionByName(relations.select(F.lit("relation").alias("kind"), "confidence"))
    return both.filter("confidence is not null").groupBy("kind", confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


def property_count(rows: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """Set fixed columns and entries of `properties`."""
    fixed = [F.col(c).isNotNull().cast("int") for c in rows.columns if c != "properties" and c not in but]
    return sum(fixed, F.lit(0)) + (F.coalesce(F.size("properties"), F.lit(0)) if "properties" in rows.columns else F.lit(0))


def facts(rows: DataFrame, tag: str, *sums: Column) -> DataFrame:
    """One row from one pass, by type first: {tag}_n, share of types with more than 1 % of rows ({tag}_types), mean
    confidence and its high and low counts, and the sums."""
    names = [f"s{i}" for i in range(len(sums))]
    confidence = F.col("confidence")
    by_type = rows.groupBy("type").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("total"),
        F.count("confidence").alias("known"),
        F.count_if(confidence >= 0.8).alias("high"),
        F.count_if(confidence < 0.5).alias("low"),
        *(F.sum(c).alias(name) for name, c in zip(names, sums, strict=True)),
    )
    whole = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"{tag}_n"),
        (F.sum("total") / F.sum("known")).alias(f"{tag}_avg"),
        F.coalesce(F.sum("high"), F.lit(0)).alias(f"{tag}_high"),
        F.coalesce(F.sum("low"), F.lit(0)).alias(f"{tag}_low"),
        F.collect_list("n").alias("sizes"),
        *(F.coalesce(F.sum(name), F.lit(0)).alias(f"{tag}_{name}") for name in names),
    )
    large = F.size(F.filter("sizes", lambda n: n > 0.01 * F.col(f"{tag}_n"))) / F.size("sizes")
    return whole.withColumn(f"{tag}_types", F.when(F.size("sizes") > 0, large)).drop("sizes")


def graph_facts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The one-row facts of both tables; each is read once. e_s0 to e_s2: properties, described, well-named entities."""
    described = F.coalesce(F.length("description") > 10, F.lit(False)).cast("int")
    named = F.coalesce(F.length("name").between(2, 50), F.lit(False)).cast("int")
    return facts(entities, "e", property_count(entities), described, named).join(facts(relations, "r"))


def completeness_of(known: DataFrame) -> DataFrame:
    n = F.col("e_n")
    part = {
        "entity_score": F.least(F.lit(1.0), n / 1000),
        "relation_score": F.least(F.lit(1.0), F.col("r_n") / (2 * n)),
        "property_score": F.least(F.lit(1.0), F.col("e_s0") / n / 5),
        "description_score": F.col("e_s1") / n,
    }
    rounded = {k: F.bround(v, 4) for k, v in part.items()}
    return known.withColumns(rounded | {"completeness": F.bround(sum(part.values(), F.lit(0.0)) / 4, 4)})


def consistency_of(known: DataFrame) -> DataFrame:
    names = F.col("e_s2") / F.col("e_n")
    whole = 0.4 * F.col("e_types") + 0.3 * names + 0.3 * F.col("r_types")
    return known.withColumns({"types": F.bround("e_types", 4), "names": F.bround(names, 4), "kinds": F.bround("r_types", 4), "consistency": F.bround(whole, 4)})


def accuracy_of(known: DataFrame) -> DataFrame:
    high = (F.col("e_high") + F.col("r_high")) / (F.col("e_n") + F.col("r_n"))
    whole = 0.35 * F.col("e_avg") + 0.35 * F.col("r_avg") + 0.3 * high
    return known.withColumns({"entity_confidence": F.bround("e_avg", 4), "relation_confidence": F.bround("r_avg", 4), "high_share": F.bround(high, 4), "low_count": F.col("e_low") + F.col("r_low"), "accuracy": F.bround(whole, 4)})


def completeness(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return completeness_of(graph_facts(entities, relations)).select("entity_score", "relation_score", "property_score", "description_score", "completeness")


def consistency(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Shares of types that hold more than 1 % of rows, and of names of 2 to 50 characters."""
    return consistency_of(graph_facts(entities, relations)).select("types", "names", "kinds", "consistency")


def accuracy(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return accuracy_of(graph_facts(entities, relations)).select("entity_confidence", "relation_confidence", "high_share", "low_count", "accuracy")


def quality_report(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Weighted mix of the three scores, its level, and codes of what to improve."""
    all_scores = accuracy_of(consistency_of(completeness_of(graph_facts(entities, relations))))
    score = 0.35 * F.col("completeness") + 0.3 * F.col("consistency") + 0.35 * F.col("accuracy")
    level = F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.55, "fair").otherwise("poor")
    low = [
        ("entity_score", 0.5, "ADD_ENTITIES"),
        ("relation_score", 0.5, "ADD_RELATIONS"),
        ("property_score", 0.5, "ADD_PROPERTIES"),
        ("description_score", 0.5, "ADD_DESCRIPTIONS"),
        ("types", 0.5, "BALANCE_ENTITY_TYPES"),
        ("names", 0.8, "FIX_NAMES"),
        ("kinds", 0.5, "BALANCE_RELATION_TYPES"),
        ("entity_confidence", 0.7, "REVIEW_ENTITIES"),
        ("relation_confidence", 0.7, "REVIEW_RELATIONS"),
    ]
    codes = F.array_compact(F.array(*(F.when(F.col(c) < at, F.lit(code)) for c, at, code in low)))
    return all_scores.select("completeness", "consistency", "accuracy", F.bround(score, 4).alias("quality"), level.alias("level"), F.array_join(codes, ",").alias("recommendations"))


def entity_quality(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id and quality of every entity: confidence, description, degree and own properties."""
    own = property_count(entities, ("id", "name", "type", "created_at", "updated_at", "created_s"))
    described = F.coalesce(F.length("description") > 10, F.lit(False)).cast("int")
    score = 0.3 * F.coalesce("confidence", F.lit(0.0)) + 0.2 * described + F.least(F.lit(0.3), 0.1 * F.col("degree")) + F.least(F.lit(0.2), 0.05 * own)
    return with_degree(entities, relations).select("id", F.bround(score, 4).alias("quality"))


def relation_quality(relations: DataFrame) -> DataFrame:
    props = property_count(relations, ("id", "src", "dst", "type"))
    score = 0.4 * F.coalesce("confidence", F.lit(0.0)) + 0.3 * F.coalesce(F.length("evidence") > 5, F.lit(False)).cast("int") + F.least(F.lit(0.3), 0.1 * props)
    return relations.select("id", F.bround(score, 4).alias("quality"))


def top_by_degree(entities: DataFrame, relations: DataFrame, k: int = 20) -> DataFrame:
    return with_degree(entities, relations).select("id", "degree", "name", "type").orderBy(F.desc("degree"), "id").limit(k)


def orphans(entities: DataFrame, relations: DataFrame, limit: int = 100) -> DataFrame:
    return entities.join(both_ends(relations), "id", "left_anti").select("id", "name", "type").orderBy("id").limit(limit)


def connected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.join(both_ends(relations), "id", "left_semi")
