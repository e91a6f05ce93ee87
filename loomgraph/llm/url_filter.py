"""URL filter: rules of a host and a path prefix, found by hashes of a url's host suffixes and path prefixes.

A url's host is what stands behind the first :// up to /, ? or #, with A-Z lower-cased; its path goes on up to ? or #. A
rule fits its host and all subdomains where the url's path starts with the rule's path; of the rules that fit, the longest
(host and path together) decides, of equally long ones a blocking one, then the least by text.

1. Every rule has a key: SHA-256 of its host and its path up to the last /, cut to PREFIX hex digits; and a digest: SHA-256
   of host and whole path.
2. A url gives one expression for each pair of a host suffix (from a label on) and a path prefix (up to a /). Suffixes of
   more labels and prefixes of more slashes than any rule has can meet none and are not made.
3. Expressions meet rules on the short key by equi-join; a pair counts if the digest of the url's own host suffix and as
   much of its path as the rule has is the rule's.
4. The best rule of a row is a maximum over the row's expressions, taken where they were made.

Rules are broadcast up to MOST_RULES, by count; more of them are copied over salts and joined by a shuffle, in which a key
that a third of all urls has meets its rule in SALTS parts. A null url, and one without ://, has an empty host and path,
which no rule fits. Rules without a host, or with a null in host, path or action, are left out. Repeated rows are given as
often as they come; empty tables give no rows; without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, once, text_or_empty

#: The rules of the contract: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hex digits of the short key; rules that are broadcast at most; equal rows that one array gives back.
PREFIX, MOST_RULES, AT_ONCE = 8, 100_000, 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    behind = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(behind, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _key(host: Column, prefix: Column) -> Column:
    return F.substring(_digest(host, prefix), 1, PREFIX)


def suffixes(host: Column, most: Column | int) -> Column:
    """host, and what is left of it behind each dot; of at most `most` labels."""
    most = most if isinstance(most, Column) else F.lit(most)

    def cut(labels: Column) -> Column:
        first = F.greatest(F.lit(1), F.size(labels) - most + 1)
        return F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    return once(F.split(host, r"\."), cut)


def prefixes(path: Column, most: Column | int) -> Column:
    """The empty prefix of path and those that end in a /; of at most `most` slashes."""
    most = most if isinstance(most, Column) else F.lit(most)

    def cut(parts: Column) -> Column:
        # The part behind the last slash ends in none.
        n = F.least(most, F.size(parts) - 1)
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))

    return once(F.split(path, "/"), cut)


def prepared(rules: DataFrame) -> DataFrame:
    """key, digest, n_path, and best: struct of what decides between rules (length, blocks, rule text) and the action."""
    rows = rules.select("action", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path")
    rows = rows.filter("host != '' and path is not null and action is not null").distinct()
    base = F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    rule = F.concat("host", "path")
    best = F.struct(F.length(rule).alias("n"), (F.col("action") == "block").alias("blocks"), rule.alias("rule"), "action")
    return rows.select(_key(F.col("host"), base).alias("key"), _digest(F.col("host"), F.col("path")).alias("digest"), F.length("path").alias("n_path"), best.alias("best"), F.size(F.split("host", r"\.")).alias("labels"), (F.size(F.split(base, "/")) - 1).alias("slashes"))


def with_verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null where none fits) and verdict. rules: action, host, path."""
    ready = prepared(rules)
    shape = ready.agg(F.count("*").alias("n"), F.coalesce(F.max("labels"), F.lit(1)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")).first()
    host, path = host_and_path(text_or_empty(url))
    # Equal rows of one task are told apart by nothing and judged together; those of other tasks stay with their own.
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.spark_partition_id().alias("task"))
    identity = ["task", "page_id", "host", "path"]
    made = F.flatten(F.transform(suffixes(F.col("host"), shape["labels"]), lambda s: F.transform(prefixes(F.col("path"), shape["slashes"]), lambda p: F.struct(s.alias("suffix"), p.alias("prefix")))))
    met = rows.select(*identity, F.posexplode(made).alias("at", "e"))
    met = met.select(*identity, F.when(F.col("at") == 0, 1).otherwise(0).alias("one"), "e.suffix", _key(F.col("e.suffix"), F.col("e.prefix")).alias("key"))
    ready = ready.drop("labels", "slashes")
    confirmed = _digest(F.col("suffix"), F.substr("path", F.lit(1), F.col("n_path"))) == F.col("digest")
    if shape["n"] <= most_rules:
        met = met.join(F.broadcast(ready), "key", "left").select(*identity, "one", F.when(confirmed, F.col("best")).alias("best"))
        # A row whose first expression meets several rules of one short key still counts once: all counts are of rows.
        repeats = ready.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        if repeats > 1:
            met = met.withColumn("one", F.lit(0)).unionByName(rows.select(*identity, F.lit(1).alias("one"), F.lit(None).cast(ready.schema["best"].dataType).alias("best")))
    else:
        part = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
        copies = ready.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = met.withColumn("salt", part).join(copies, ["key", "salt"]).filter(confirmed).select(*identity, F.lit(0).alias("one"), "best")
        met = rows.select(*identity, F.lit(1).alias("one"), F.lit(None).cast(ready.schema["best"].dataType).alias("best")).unionByName(hits)
    judged = met.groupBy(*identity).agg(F.max("best").alias("best"), F.sum("one").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(AT_ONCE).cast("long")))
    within = F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE).cast("long"), F.col("n") - F.col("from")))
    single = judged.withColumn("from", blocks).withColumn("copy", F.explode(within))
    return single.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    return with_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
