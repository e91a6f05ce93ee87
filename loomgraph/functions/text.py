"""Text functions as Column expressions: cleaning, structure, chunks, names, confidences, citations, metadata."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentence marks, endings of key terms, and the characters that cleaning keeps besides words and spaces.
SENTENCE_MARKS = "[.!?。！？]"
KEY_TERM = "([一-龥]{2,8}(?:技术|系统|方法|功能|模块|服务|组件))"
KEPT = ".,!?;:'\"()\\-"


def clean(text: Column) -> Column:
    """White space to single spaces; only words, spaces and plain punctuation stay; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), f"[^\\p{{L}}\\p{{N}}_ {KEPT}]", ""))


def normalize(text: Column) -> Column:
    """Line ends to \\n, at most one empty line in a row, trimmed of white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def markdown(content: Column) -> Column:
    """struct<metadata, body, headings array<struct<level, text>>, hash>: front matter has flat `key: value` lines."""
    parts = F.split(content, "(?m)^---\\s*$", 3)
    front = content.startswith("---") & (F.size(parts) == 3)
    body = F.when(front, F.regexp_replace(F.element_at(parts, 3), "^\n", "")).otherwise(content)
    lines = F.filter(F.split(F.element_at(parts, 2), "\n"), lambda line: line.contains(":"))
    entries = F.map_from_entries(F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)), F.trim(F.regexp_replace(line, "^[^:]*:", "")))))
    metadata = F.when(front, entries).otherwise(F.create_map().cast("map<string,string>"))
    marks, titles = (F.regexp_extract_all(body, F.lit(r"(?m)^(#{1,6})[^\S\n]+(.+)$"), F.lit(g)) for g in (1, 2))
    headings = F.zip_with(marks, titles, lambda m, t: F.struct(F.length(m).alias("level"), F.trim(t).alias("text")))
    return F.struct(metadata.alias("metadata"), body.alias("body"), headings.alias("headings"), F.sha2(body, 256).alias("hash"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fixed_chunks(text: Column, size: int = 512, rate: float = 0.1, reach: int = 50) -> Column:
    """array<struct<position, content, start_offset, end_offset>> of about `size` characters.

    A chunk's end moves to just after the first sentence mark within `reach` characters; the next one starts
    floor(size * rate) characters before that. Contents are trimmed; blank chunks are left out and have no position."""
    overlap = int(size * rate)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / (size - overlap)).cast("int"), F.lit(1)))
    kind = "array<struct<position:int,content:string,start_offset:int,end_offset:int>>"

    def step(held: Column, n: Column) -> Column:
        # What is left of the text is carried along, so that no chunk is looked up from the text's start.
        mark = F.regexp_instr(F.substring(held["head"], size + 1, reach), F.lit(SENTENCE_MARKS))
        long = F.when((held["left"] > size) & (mark > 0), size + mark).otherwise(size)
        return F.when(held["left"] <= 0, held).otherwise(once(long, lambda end: grown(held, n, end)))

    def grown(held: Column, n: Column, end: Column) -> Column:
        content = F.regexp_replace(F.substring(held["head"], F.lit(1), end), r"(?U)^\s+|\s+\z", "")
        chunk = F.struct(n.alias("position"), content.alias("content"), held["at"].alias("start_offset"), (held["at"] + end).alias("end_offset"))
        on = end - overlap
        rest = F.substring(held["rest"], on + 1, held["left"])
        return once(rest, lambda rest: state(held["at"] + on, held["left"] - on, rest, F.concat(held["out"], F.array(chunk))))

    def state(at: Column, left: Column, rest: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), left.alias("left"), rest.alias("rest"), F.substring(rest, 1, size + reach).alias("head"), out.alias("out"))

    start = state(F.lit(0), F.length(text), text, F.array().cast(kind))
    walked = F.aggregate(steps, start, step, lambda held: held["out"])
    kept = F.filter(walked, lambda c: c["content"] != "")
    return F.transform(kept, lambda c, i: F.struct(i.alias("position"), c["content"].alias("content"), c["start_offset"].alias("start_offset"), c["end_offset"].alias("end_offset")))


def semantic_chunks(text: Column, most: int = 1000, least: int = 100) -> Column:
    """array<string>: paragraphs packed up to `most` characters; what stays under `least` is dropped, a longer one stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")

    def flush(held: Column) -> Column:
        return F.when(F.length(held["now"]) >= least, F.concat(held["out"], F.array(held["now"]))).otherwise(held["out"])

    def step(held: Column, p: Column) -> Column:
        fits = F.length(held["now"]) + F.length(p) + 2 <= most
        joined = F.when(held["now"] == "", p).otherwise(F.concat(held["now"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, joined).otherwise(p).alias("now"), F.when(fits, held["out"]).otherwise(flush(held)).alias("out"))

    return F.aggregate(paragraphs, F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out")), step, flush)


#: Least and most characters of a chunk, and the largest share that chunks overlap.
CHUNK_SIZES, MOST_OVERLAP = (100, 2000), 0.5


def chunk_strategy(doc_type: Column, asked: Column | None = None) -> Column:
    chosen = F.when(doc_type.isin("pdf", "docx"), "semantic").otherwise("fixed")
    return chosen if asked is None else F.coalesce(asked, chosen)


def chunk_settings(size: Column, rate: Column) -> Column:
    """struct<valid, size, rate>: are size and overlap within their bounds; if not, the nearest that are."""
    low, high = CHUNK_SIZES
    fitting = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(size, F.lit(512))))
    share = F.greatest(F.lit(0.0), F.least(F.lit(MOST_OVERLAP), F.coalesce(rate, F.lit(0.1))))
    return F.struct(((size == fitting) & (rate == share)).alias("valid"), fitting.alias("size"), share.alias("rate"))


def entity_name(name: Column) -> Column:
    """Lower case without punctuation and spaces."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_]", ""))


def relation_name(name: Column) -> Column:
    return F.lower(F.trim(name))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of lower-cased names; 0 if one is empty. For blocked pairs only."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def context_overlap(context: Column, description: Column, properties: Column | None = None) -> Column:
    """Share of the description's different words that the context has; with properties (a map of texts), the largest share
    of the description and of all of them."""
    words = words_of(context)

    def share(text: Column) -> Column:
        return once(words_of(F.coalesce(text, F.lit(""))), lambda mine: F.when(F.size(mine) > 0, F.least(F.lit(1.0), F.size(F.array_intersect(words, mine)) / F.size(mine))).otherwise(0.0))

    own = share(description)
    if properties is None:
        return own
    return F.greatest(own, F.coalesce(F.array_max(F.transform(F.map_values(properties), share)), F.lit(0.0)))


def resolver_similarity(name: Column, candidate: Column, ratio: Column) -> Column:
    a, b = entity_name(name), entity_name(candidate)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.95).otherwise(ratio)


def json_of(response: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(response, r"(?s)(\{.*\})", 1)


def parse_entities(response: Column) -> Column:
    """array<struct<name, type, description, confidence>>; rows without name or type go, bad JSON gives none."""
    kind = "entities array<struct<name:string,type:string,description:string,confidence:double>>"
    found = F.from_json(json_of(response), kind)["entities"]
    whole = F.filter(found, lambda e: (F.length(e["name"]) > 0) & (F.length(e["type"]) > 0))
    filled = F.transform(whole, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["description"].alias("description"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence")))
    return F.coalesce(filled, F.array().cast("array<struct<name:string,type:string,description:string,confidence:double>>"))


def parse_relations(response: Column) -> Column:
    """array<struct<head, relation, tail, evidence, confidence>>; rows without head, relation or tail go."""
    kind = "relations array<struct<head:string,relation:string,tail:string,evidence:string,confidence:double>>"
    found = F.from_json(json_of(response), kind)["relations"]
    whole = F.filter(found, lambda r: (F.length(r["head"]) > 0) & (F.length(r["relation"]) > 0) & (F.length(r["tail"]) > 0))
    filled = F.transform(whole, lambda r: F.struct(r["head"].alias("head"), r["relation"].alias("relation"), r["tail"].alias("tail"), r["evidence"].alias("evidence"), F.coalesce(r["confidence"], F.lit(1.0)).alias("confidence")))
    return F.coalesce(filled, F.array().cast("array<struct<head:string,relation:string,tail:string,evidence:string,confidence:double>>"))


def extraction_prompt(text: Column, types: list[str], names: Column | None = None) -> Column:
    asked = F.concat(F.lit("Types: " + ", ".join(types) + "\n"), F.lit("Entities: ") if names is not None else F.lit(""), F.coalesce(F.array_join(names, ", "), F.lit("")) if names is not None else F.lit(""))
    return F.concat(asked, F.lit("\nText:\n"), text)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def entity_confidence(confidence: Column, name: Column, description: Column, context_length: Column) -> Column:
    score = confidence * F.when(context_length > 0, 0.8 + 0.2 * F.least(F.lit(1.0), context_length / 1000)).otherwise(1.0)
    score = score * F.when(F.length(name) < 2, 0.5).when(F.length(name) > 50, 0.8).otherwise(1.0)
    return clamp(score * F.when(F.coalesce(F.length(description), F.lit(0)) == 0, 0.9).otherwise(1.0))


def relation_confidence(confidence: Column, head: Column, tail: Column, evidence: Column) -> Column:
    length = F.coalesce(F.length(evidence), F.lit(0))
    score = confidence * F.when(length > 0, 0.9 + 0.1 * F.least(F.lit(1.0), length / 100)).otherwise(0.7)
    return clamp(score * F.when((F.length(head) < 2) | (F.length(tail) < 2), 0.8).otherwise(1.0))


def references(answer: Column) -> Column:
    """The numbers of all [n] in an answer, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def reference_places(answer: Column) -> Column:
    """array<struct<n, start, end>>: every [n] of an answer with its place in characters, end exclusive."""
    pieces = F.split(answer, r"\[\d+\]", -1)
    numbers = references(answer)
    steps = F.zip_with(F.slice(pieces, 1, F.size(numbers)), F.regexp_extract_all(answer, F.lit(r"\[\d+\]"), F.lit(0)), lambda a, b: F.struct(F.length(a).alias("before"), F.length(b).alias("long")))

    def step(held: Column, s: Column) -> Column:
        start = held["at"] + s["before"]
        return F.struct((start + s["long"]).alias("at"), F.concat(held["out"], F.array(start)).alias("out"))

    starts = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda held: held["out"])
    placed = F.arrays_zip(numbers.alias("n"), starts.alias("start"), steps.alias("s"))
    return F.transform(placed, lambda p: F.struct(p["n"].alias("n"), p["start"].alias("start"), (p["start"] + p["s"]["long"]).alias("end")))


def invalid_references(answer: Column, sources: Column) -> Column:
    return F.array_distinct(F.filter(references(answer), lambda n: (n < 1) | (n > sources)))


def annotate(answer: Column, sources: Column) -> Column:
    """Valid citations stay. An answer without any gets [i] after the first sentence (10 characters or more) or key term of source i."""
    bad = invalid_references(answer, F.size(sources))
    cleaned = F.aggregate(bad, answer, lambda text, n: F.replace(text, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))

    def mark(held: Column, source: Column) -> Column:
        sentences = F.filter(F.transform(F.split(source, SENTENCE_MARKS), lambda p: F.trim(p)), lambda p: F.length(p) >= 10)
        phrases = F.filter(F.concat(sentences, F.regexp_extract_all(source, F.lit(KEY_TERM), F.lit(1))), lambda p: held["text"].contains(p))
        first = F.element_at(phrases, 1)
        at = F.instr(held["text"], first)
        end = at + F.length(first) - 1
        marked = F.concat(F.substring(held["text"], F.lit(1), end), F.concat(F.lit("["), held["n"].cast("string"), F.lit("]")), F.substring(held["text"], end + 1, F.length(held["text"])))
        return F.struct((held["n"] + 1).alias("n"), F.when(F.size(phrases) > 0, marked).otherwise(held["text"]).alias("text"))

    appended = F.aggregate(sources, F.struct(F.lit(1).alias("n"), answer.alias("text")), mark, lambda held: held["text"])
    return F.when(F.size(references(answer)) > 0, cleaned).otherwise(appended)


def source_list(sources: Column) -> Column:
    """sources: array<struct<title, doc_id, content>> -> numbered lines of title (or id) and 200 characters."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(s["title"], s["doc_id"].cast("string")), F.lit(": "), F.substring(s["content"], 1, 200))), "\n")


def character_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    whole = F.size(F.array_union(x, y))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / whole)


def query_keywords(query: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.regexp_extract_all(query, F.lit(r"([一-鿿]+|[A-Za-z]+)"), F.lit(1)), lambda w: F.length(w) >= 2), 1, most)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 2)


def truncate(text: Column, tokens: int) -> Column:
    return F.when(F.length(text) <= 2 * tokens, text).otherwise(F.concat(F.substring(text, 1, 2 * tokens), F.lit("...")))


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of two flat JSON objects, the new one's values win; bad JSON counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    read = lambda j: F.coalesce(F.from_json(j, "map<string,string>"), empty)
    return F.map_zip_with(read(old), read(new), lambda _, a, b: F.coalesce(b, a))


def estimated_end(started: Column, now: Column, progress: Column) -> Column:
    """Whole seconds: start + elapsed * 100 / progress, progress clamped to 0..100; null before any progress."""
    done = F.greatest(F.lit(0), F.least(F.lit(100), progress))
    return F.when(done > 0, started + F.floor((now - started) * 100 / done))


def retry_delay(attempt: Column, first_ms: int = 1000, most_ms: int = 10000) -> Column:
    return F.least(F.lit(first_ms) * F.pow(F.lit(2), attempt), F.lit(most_ms)).cast("long")
