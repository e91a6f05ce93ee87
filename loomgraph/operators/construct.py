"""Knowledge-graph construction from extraction responses, and entity resolution.

Order-dependent rules follow (doc_id, chunk_id, ord), never arrival."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..tables import written
from .filters import first_of
from .operations import upsert

CHUNK = ("doc_id", "chunk_id")
PLACE = (*CHUNK, "ord")
#: Tasks that a split of the input is dealt to by document: a text grows manifold when its mentions are listed.
DEAL = 8


def by_document(documents: DataFrame) -> DataFrame:
    """documents dealt to tasks by doc_id. Responses made from them stay where they are, so that what groups their mentions
    by document, or by chunk, moves no mention: the texts are all that is shuffled."""
    return documents.repartition(tasks_of(documents), "doc_id")


def tasks_of(documents: DataFrame) -> int:
    """Tasks that by_document deals documents to."""
    return DEAL * documents.rdd.getNumPartitions()


def entity_mentions(responses: DataFrame) -> DataFrame:
    """doc_id, chunk_id, ord, name, type, description, confidence, normalized_name of every well-formed entity."""
    rows = responses.select("doc_id", "chunk_id", F.posexplode(tx.parse_entities(F.col("entity_response"))).alias("ord", "e"))
    return rows.select("doc_id", "chunk_id", "ord", "e.*").withColumn("normalized_name", tx.entity_name(F.col("name")))


def relation_mentions(responses: DataFrame) -> DataFrame:
    rows = responses.select("doc_id", "chunk_id", F.posexplode(tx.parse_relations(F.col("relation_response"))).alias("ord", "r"))
    return keyed(rows.select("doc_id", "chunk_id", "ord", "r.*"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with the keys of both ends' names."""
    return rows.withColumn("head_key", tx.relation_name(F.col("head"))).withColumn("tail_key", tx.relation_name(F.col("tail")))


@lru_cache(100_000)
def alike(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio of two names is threshold or more; lengths and then character counts bound it from above, so that
    most pairs are never aligned. Words come again and again: what two of them have been found to be is kept for a while."""
    if 2.0 * min(len(a), len(b)) < threshold * (len(a) + len(b)):
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold


#: From this length on difflib leaves common characters out, and a name need not be like itself.
LONG = 200


def _greedy(threshold: float):
    @F.arrow_udf("struct<counts:array<int>,aliases:array<array<string>>>")
    def merge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists in batches:
            kinds, names, keys = (pc.list_flatten(x) for x in lists)
            sizes = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
            unit = np.repeat(np.arange(len(sizes)), sizes)
            first = _firsts(unit, kinds, keys, threshold)
            joined = np.flatnonzero(first != np.arange(len(unit)))
            counts = np.bincount(first, minlength=len(unit)).astype(np.int32)
            coded = pc.dictionary_encode(names)
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            aliases: list[list[str | None] | None] = [None] * len(unit)
            for i in joined[code[joined] != code[first[joined]]].tolist():
                k = int(first[i])
                other = aliases[k] = aliases[k] or []
                if (name := coded.dictionary[int(code[i])].as_py() if code[i] >= 0 else None) not in other:
                    other.append(name)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists_of = lambda values: pa.ListArray.from_arrays(ends, values)
            yield pa.StructArray.from_arrays([lists_of(pa.array(counts)), lists_of(pa.array(aliases, pa.list_(pa.string())))], ["counts", "aliases"])

    return merge


def _firsts(unit: np.ndarray, kinds: pa.Array, keys: pa.Array, threshold: float) -> np.ndarray:
    """For each mention the one it joins, the first kept one of its block (unit, kind, three characters of the key) that is
    like it; itself where none is. A name that comes again in a block joins what it joined before, so that only the
    different names of a block are compared."""
    code = lambda x: pc.fill_null(pc.dictionary_encode(x).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    parts = [code(kinds), code(pc.utf8_slice_codeunits(keys, 0, 3))]
    block = unit.astype(np.int64)
    for part in parts:
        block = np.unique(block, return_inverse=True)[1] * (part.max(initial=0) + 1) + part
    coded, ids = pc.dictionary_encode(keys), {"": 0}
    of = np.array([0, *(ids.setdefault((k or "").lower(), len(ids)) for k in coded.dictionary.to_pylist())], np.int64)
    low, first = of[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1], np.arange(len(unit))
    lows = list(ids)
    for n, name in enumerate(list(lows)):
        if (len(name) >= LONG or threshold > 1) and not alike(name, name, threshold):
            again = np.flatnonzero(low == n)
            low[again] = np.arange(len(lows), len(lows) + len(again))
            lows += [name] * len(again)
    # Names without a character are like none.
    rows = np.flatnonzero(low > 0)
    block = np.unique(block[rows], return_inverse=True)[1]
    _, at, pair = np.unique(block * len(lows) + low[rows], return_index=True, return_inverse=True)
    many = np.bincount(block[at], minlength=len(rows) and block.max() + 1) > 1
    joins = at.copy()
    open_ = np.flatnonzero(many[block[at]]) if len(rows) else np.empty(0, np.int64)
    open_ = open_[np.lexsort((at[open_], block[at[open_]]))]
    now, kept = -1, []
    for p, of_, name in zip(open_.tolist(), block[at[open_]].tolist(), low[rows[at[open_]]].tolist(), strict=True):
        if of_ != now:
            now, kept = of_, []
        other = next((k for had, k in kept if alike(had, lows[name], threshold)), None)
        if other is None:
            kept.append((lows[name], p))
        else:
            joins[p] = at[other]
    first[rows] = rows[joins[pair]]
    return first


def dedup_chunk_entities(mentions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Within a chunk, type and first three characters of the name: each mention joins the first kept one of ratio >= threshold.

    A chunk is put together once. Python sees its names and tells which mentions are kept; rows stay in Spark."""
    held = ["ord", *(c for c in mentions.columns if c not in (*CHUNK, "ord"))]
    units = mentions.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("ms"))
    rows = listed_entities(kept_of(units.select("*", told_of(threshold))))
    return rows.select(*mentions.columns, "aliases", "source_count")


def told_of(threshold: float) -> Column:
    """kept, of a chunk's mentions ms in order: for each its source_count, 0 if it has joined another, and its aliases."""
    return _greedy(threshold)("ms.type", "ms.name", "ms.normalized_name").alias("kept")


def kept_of(units: DataFrame) -> DataFrame:
    """units with es in place of ms and kept: the kept mentions with aliases and source_count."""
    fields = units.schema["ms"].dataType.elementType.names
    none = F.array().cast("array<string>")
    row = lambda m, i: F.struct(*(m[f].alias(f) for f in fields), F.coalesce(F.get("kept.aliases", i), none).alias("aliases"), F.get("kept.counts", i).cast("long").alias("source_count"))
    es = F.filter(F.transform("ms", row), lambda e: e["source_count"] > 0)
    return units.withColumn("es", es).drop("ms", "kept")


def chunk_units(responses: DataFrame, threshold: float = 0.85, bound: float | None = None, tasks: int | None = None) -> DataFrame:
    """doc_id, chunk_id, es, rs: of each chunk the deduplicated entities, those of confidence >= bound where it is given,
    and all relations, unjudged.

    tasks: as many as the responses were dealt to by document (tasks_of). Python then is given the names alone, and only
    what it tells of them is dealt to the documents again: mentions and relations never leave their documents."""
    entities = F.transform(tx.parse_entities(F.col("entity_response")), lambda e, i: F.struct(i.alias("ord"), *(e[f].alias(f) for f in ("name", "type", "description", "confidence")), tx.entity_name(e["name"]).alias("normalized_name")))
    relations = F.transform(tx.parse_relations(F.col("relation_response")), lambda r, i: F.struct(i.alias("ord"), *(r[f].alias(f) for f in ("head", "relation", "tail", "evidence", "confidence"))))
    rows = responses.select(*CHUNK, entities.alias("ms"), relations.alias("rs"))
    listed = lambda column: F.flatten(F.collect_list(column))
    lists = [F.sort_array(listed("ms")).alias("ms"), listed("rs").alias("rs")]
    if tasks is None:
        units = rows.groupBy(*CHUNK).agg(*lists).select("*", told_of(threshold))
    else:
        told = rows.groupBy(*CHUNK).agg(lists[0]).select(*CHUNK, told_of(threshold)).repartition(tasks, "doc_id")
        units = rows.unionByName(told, allowMissingColumns=True).groupBy(*CHUNK).agg(*lists, F.first("kept", ignorenulls=True).alias("kept"))
    units = kept_of(units)
    return units if bound is None else units.withColumn("es", F.filter("es", lambda e: e["confidence"] >= bound))


def chunk_entities(responses: DataFrame, threshold: float = 0.85, bound: float | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of dedup_chunk_entities(entity_mentions(responses)), those of confidence >= bound where it is given.

    Mentions are listed one by one at the end only. tasks: see chunk_units."""
    return listed_entities(chunk_units(responses, threshold, bound, tasks))


def listed_entities(units: DataFrame) -> DataFrame:
    """A row for each entity of chunk_units. A column that is listed as it is would be made twice, once for its size."""
    return units.select(*CHUNK, F.inline(F.concat("es")))


def merge_document_entities(mentions: DataFrame) -> DataFrame:
    """One row for each (doc_id, type, normalized_name): the first name, distinct descriptions, other names, mean confidence."""
    extra = F.col("aliases") if "aliases" in mentions.columns else F.array().cast("array<string>")
    count = F.col("source_count") if "source_count" in mentions.columns else F.lit(1).cast("long")
    item = F.struct("chunk_id", "ord", "name", "description", extra.alias("aliases"))
    grouped = mentions.groupBy("doc_id", "type", "normalized_name").agg(F.array_sort(F.collect_list(item)).alias("items"), F.avg("confidence").alias("confidence"), F.sum(count).alias("source_count"))
    name = F.element_at("items", 1)["name"]
    names = F.flatten(F.transform("items", lambda i: F.concat(F.array(i["name"]), i["aliases"])))
    told = F.array_distinct(F.filter(F.transform("items", lambda i: i["description"]), lambda d: F.length(d) > 0))
    return grouped.select("doc_id", "type", "normalized_name", name.alias("name"), F.array_join(told, " ").alias("description"), F.array_remove(F.array_distinct(names), name).alias("aliases"), "confidence", "source_count")


def validate_relations(relations: DataFrame, entities: DataFrame, by: tuple[str, ...] = ("doc_id", "chunk_id")) -> tuple[DataFrame, DataFrame]:
    """Relations whose ends are both names (plain or normalized) of entities of the same unit, and the others."""
    judged = judged_relations(relations, entities, by)
    return judged.filter("valid").drop("valid"), judged.filter("not valid").drop("valid")


def judged_relations(relations: DataFrame, entities: DataFrame, by: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """relations with `valid`: whether both ends are names of entities of the same unit. A unit, such as a chunk, is put
    together once; one without a key has no entities. Keys that relations lack are made of head and tail."""
    held = [c for c in relations.columns if c not in by]
    record, none = F.struct(*held), F.lit(None)
    rows = relations.select(*by, none.cast("array<string>").alias("names"), record.alias("r"))
    rows = rows.unionByName(entities.select(*by, _names(F.col("name"), F.col("normalized_name")).alias("names"), none.cast(rows.schema["r"].dataType).alias("r")))
    units = rows.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.collect_list("r").alias("rs"))
    known = _known(held, by)
    judged = units.select(*by, F.inline(F.transform("rs", lambda r: F.struct(r.alias("r"), known(r).alias("valid")))))
    return judged.select(*by, "r.*", "valid").select(*relations.columns, "valid")


def _names(name: Column, normalized: Column) -> Column:
    """What an entity may be called at a relation's end."""
    return F.array(tx.relation_name(name), F.lower(F.trim(normalized)))


def _known(held: list[str], by: tuple[str, ...]) -> Callable[[Column], Column]:
    """Whether both ends of a relation (a struct of held) are among the `names` of its unit."""
    key = lambda r, end: r[f"{end}_key"] if f"{end}_key" in held else tx.relation_name(r[end])
    whole = reduce(Column.__and__, (F.col(b).isNotNull() for b in by))
    return lambda r: F.coalesce(whole & F.array_contains("names", key(r, "head")) & F.array_contains("names", key(r, "tail")), F.lit(False))


def judged_units(units: DataFrame) -> DataFrame:
    """The valid ones of judged_relations, of chunks that hold their entities es and relations rs already."""
    names = F.array_distinct(F.flatten(F.transform("es", lambda e: _names(e["name"], e["normalized_name"]))))
    known = _known(units.schema["rs"].dataType.elementType.names, CHUNK)
    return units.select(*CHUNK, names.alias("names"), "rs").select(*CHUNK, F.inline(F.filter("rs", known)))


def joined_evidence(items: Column) -> Column:
    """Evidences in order, each appended after "; " unless it is there already."""
    texts = F.filter(F.transform(items, lambda i: i["evidence"]), lambda e: F.length(e) > 0)
    return F.aggregate(texts, F.lit(""), lambda a, e: F.when(a == "", e).when(a.contains(e), a).otherwise(F.concat(a, F.lit("; "), e)))


def dedup_relations(relations: DataFrame, by: tuple[str, ...] = ("doc_id", "chunk_id"), boost: float = 0.1) -> DataFrame:
    """One row for each (unit, head, type, tail): the first one's names, confidence raised by boost a repeat up to 1."""
    item = F.struct("chunk_id", "ord", "head", "tail", "evidence", "confidence") if "chunk_id" not in by else F.struct("ord", "head", "tail", "evidence", "confidence")
    grouped = relations.groupBy(*by, "head_key", "relation", "tail_key").agg(F.array_sort(F.collect_list(item)).alias("items"))
    first, n = F.element_at("items", 1), F.size("items")
    return grouped.select(*by, "head_key", "relation", "tail_key", first["head"].alias("head"), first["tail"].alias("tail"), first["ord"].alias("ord"), joined_evidence(F.col("items")).alias("evidence"), F.least(F.lit(1.0), first["confidence"] + boost * (n - 1)).alias("confidence"), n.cast("long").alias("source_count"))


def extract_chunks(responses: DataFrame, entity_bound: float = 0.5, relation_bound: float = 0.7, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per chunk: entities deduplicated and filtered; relations validated, deduplicated and filtered. tasks: see chunk_units."""
    units = chunk_units(responses, bound=entity_bound, tasks=tasks)
    relations = dedup_relations(keyed(judged_units(units))).filter(F.col("confidence") >= relation_bound)
    return listed_entities(units), relations


def extract_documents(responses: DataFrame, tasks: int | None = None, **bounds: float) -> tuple[DataFrame, DataFrame]:
    """Chunks merged by document; repeated relations keep the first one's confidence."""
    entities, relations = extract_chunks(responses, tasks=tasks, **bounds)
    return merge_document_entities(entities), dedup_relations(relations, ("doc_id",), boost=0.0)


def link(relations: DataFrame, entities: DataFrame, mode: str = "strict", by: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Relations with entity ids of both ends (of least id), and those with an end that is no entity.

    "strict" compares normalized entity names with trimmed lower-case ends, "normalized" normalizes the ends too."""
    key = (lambda c: c) if mode == "strict" else (lambda c: tx.entity_name(c))
    ends = relations.select("*", key(F.col("head_key")).alias("_h"), key(F.col("tail_key")).alias("_t"), F.lit(True).alias("_end"))
    name = F.col("normalized_name")
    named = entities.select(*by, name.alias("_h"), name.alias("_t"), F.col("id").alias("_id"))
    # Both tables are read once, and lie by their documents already where these were dealt out.
    rows = ends.unionByName(named, allowMissingColumns=True)
    for end, column in (("_h", "src"), ("_t", "dst")):
        whole = reduce(Column.__and__, (F.col(b).isNotNull() for b in (*by, end)))
        rows = rows.withColumn(column, F.when(whole, F.min("_id").over(Window.partitionBy(*by, end))))
    out = rows.filter("_end").drop("_h", "_t", "_end", "_id")
    return out.filter("src is not null and dst is not null"), out.filter("src is null or dst is null")


def build_graph(responses: DataFrame, mode: str = "strict", stored: tuple[DataFrame, DataFrame] | None = None, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations with ids made of their keys; upserted into the stored entities and relations, where given.
    tasks: see chunk_units."""
    entities, relations = extract_documents(responses, tasks)
    entities = entities.withColumn("id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "type", "normalized_name"), 256))
    linked, _ = link(relations, entities, mode)
    linked = linked.withColumn("id", F.sha2(F.concat_ws("|", "src", "relation", "dst"), 256))
    if stored is None:
        return entities, linked
    first = F.lit(1).alias("version")
    return upsert(stored[0], entities.select("*", first)), upsert(stored[1], linked.select("*", first))


def summary(entities: DataFrame, relations: DataFrame, documents: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """doc_id, entity_count, relation_count, status of every document; with responses also errors: how many of its answers
    hold no JSON object (status "failed" where nothing else came out)."""
    e = entities.groupBy("doc_id").agg(F.count("*").alias("e"))
    r = relations.groupBy("doc_id").agg(F.count("*").alias("r"))
    out = documents.select("doc_id").join(e, "doc_id", "left").join(r, "doc_id", "left")
    found, wrong = F.coalesce("e", F.lit(0)), F.lit(0).cast("long")
    if responses is not None:
        bad = lambda c: F.when(F.from_json(tx.json_of(F.col(c)), "map<string,string>").isNull(), 1).otherwise(0)
        broken = responses.groupBy("doc_id").agg(F.sum(bad("entity_response") + bad("relation_response")).alias("errors"))
        out, wrong = out.join(broken, "doc_id", "left"), F.coalesce("errors", F.lit(0))
    status = F.when(found > 0, "success").when(wrong > 0, "failed").otherwise("empty")
    columns = ["doc_id", found.alias("entity_count"), F.coalesce("r", F.lit(0)).alias("relation_count"), status.alias("status")]
    return out.select(*columns, *([wrong.alias("errors")] if responses is not None else []))


def _grams(name: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1)), lambda i: F.substring(name, i, F.lit(n))))


#: Names that one task compares for a common gram; grams of more are split.
GRAM_PART = 10_000


def candidate_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """s_id, s, l_id, l: for each name of `short` (s_id, s) names of `long` (l_id, l) that may contain it.

    A name within another has all its 3-grams there. Its key is the one that fewest names of `long` have, so that a common
    beginning brings no names together; a name with a gram that none has has no pairs. The names of a gram that very many
    have are split by a hash of their id, and the short name meets each part. Names of under 3 characters have no pairs."""
    every = lambda rows, name: rows.filter(F.length(name) >= 3).withColumn("gram", F.explode(_grams(F.col(name))))
    grams = every(long, "l")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    met = every(short, "s").join(counts, "gram", "left")
    rarest = met.groupBy("s_id", "s").agg(F.min(F.struct("n", "gram")).alias("key"), F.count_if(F.col("n").isNull()).alias("lacking"))
    keys = rarest.filter("lacking = 0").select("s_id", "s", "key.gram", F.ceil(F.col("key.n") / GRAM_PART).cast("int").alias("parts"))
    hot = counts.filter(F.col("n") > GRAM_PART).select("gram", F.ceil(F.col("n") / GRAM_PART).cast("int").alias("split"))
    dealt = grams.join(hot, "gram", "left").withColumn("part", F.pmod(F.xxhash64("l_id"), F.coalesce("split", F.lit(1))).cast("int"))
    asked = keys.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return asked.join(dealt, ["gram", "part"]).select("s_id", "s", "l_id", "l")


def near_names(mentions: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """m, id: for each different normalized name m of mentions the entities that blocked() gives a mention of that name.

    Different names are compared, however many mentions and entities have them. Entities of one name are equally near, so
    that only the `limit` of least id can be among the first of a mention."""
    e = entities.select("id", tx.entity_name(F.col("name")).alias("e")).filter("e is not null").distinct()
    asked = mentions.select(tx.entity_name(F.col("name")).alias("m")).filter("m is not null").distinct()
    m, known = written(asked, "names"), written(e.select("e").distinct(), "names")
    as_ = lambda rows, i, n: rows.toDF(n).withColumn(i, F.col(n))
    inside = candidate_pairs(as_(m, "s_id", "s"), as_(known, "l_id", "l")).filter(F.col("l").contains(F.col("s")))
    around = candidate_pairs(as_(known, "s_id", "s"), as_(m, "l_id", "l")).filter(F.col("l").contains(F.col("s")))
    same = m.join(known, F.col("m") == F.col("e"))
    pairs = inside.select(F.col("s").alias("m"), F.col("l").alias("e")).unionByName(around.select(F.col("l").alias("m"), F.col("s").alias("e"))).unionByName(same).distinct()
    first = first_of(e, "e", limit, "id").drop("place")
    far = F.abs(F.length("m") - F.length("e"))
    return first_of(pairs.join(first, "e").withColumn("far", far), "m", limit, "far", "id", "e").select("m", "id")


def blocked(mentions: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """mention_id, id of entities of which one name contains the other's, found by shared 3-grams; at most `limit`, the nearest in length.

    A name of under 3 characters is compared by equality only. mention_id tells mentions apart."""
    named = mentions.select("mention_id", tx.entity_name(F.col("name")).alias("m")).distinct()
    return named.join(near_names(mentions, entities, limit), "m").select("mention_id", "id")


def ranked_candidates(mentions: DataFrame, entities: DataFrame, name_weight: float = 0.6, context_weight: float = 0.4, limit: int = 20, top_n: int = 5) -> DataFrame:
    """mention_id, entity_id, score, rank: of each mention's candidates the top_n by score, then id."""
    # What is known of a candidate is joined once for a name, not for each of its mentions.
    # Written, so that its size is known and the mentions are not broadcast in its place.
    near = written(near_names(mentions, entities, limit).join(entities.select("id", F.col("name").alias("candidate"), "description", "properties"), "id"), "near")
    # Mentions of one name in one context have the same candidates and scores: these are made once for all of them.
    asked = mentions.select("name", "context").distinct()
    pairs = asked.withColumn("m", tx.entity_name(F.col("name"))).join(near, "m")
    # Python sees the names that the cheaper rules don't decide, and nulls for the others.
    one, other = tx.entity_name(F.col("name")), tx.entity_name(F.col("candidate"))
    open_ = ~(one.contains(other) | other.contains(one))
    ratio = tx.name_similarity(F.when(open_, F.col("name")), F.when(open_, F.col("candidate")))
    name = tx.resolver_similarity(F.col("name"), F.col("candidate"), ratio)
    score = name_weight * name + context_weight * tx.context_overlap(F.coalesce("context", F.lit("")), F.col("description"), F.col("properties"))
    at = F.row_number().over(Window.partitionBy("_name", "_context").orderBy(F.desc("score"), F.desc("entity_id")))
    scored = pairs.select(F.col("name").alias("_name"), F.col("context").alias("_context"), F.col("id").alias("entity_id"), F.round(score, 6).alias("score"))
    best = written(scored.withColumn("rank", at).filter(F.col("rank") <= top_n), "best")
    same = F.col("name").eqNullSafe(F.col("_name")) & F.col("context").eqNullSafe(F.col("_context"))
    return mentions.select("mention_id", "name", "context").join(best, same).select("mention_id", "entity_id", "score", "rank")


def resolve(mentions: DataFrame, entities: DataFrame, name_weight: float = 0.6, context_weight: float = 0.4, threshold: float = 0.85, limit: int = 20) -> DataFrame:
    """Per mention (mention_id, name, type, context): the best candidate of threshold or more, or is_new."""
    best = ranked_candidates(mentions, entities, name_weight, context_weight, limit, 1)
    out = mentions.join(best, "mention_id", "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select("mention_id", F.when(hit, F.col("entity_id")).alias("entity_id"), F.when(hit, F.col("score")).otherwise(0.0).alias("confidence"), (~hit).alias("is_new"), F.coalesce("type", F.lit("Concept")).alias("type"))


def resolution_accuracy(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """correct, total and their ratio over mentions with a known entity."""
    both = truth.join(resolved, "mention_id")
    return both.agg(F.count_if(F.col("entity_id") == F.col("expected_id")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))
