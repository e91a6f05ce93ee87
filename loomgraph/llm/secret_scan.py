"""Secret scan in SQL functions only: fixed patterns, and two character Markov models.

Fixed patterns (assign, access, hex) give the base spans. The method adds spans of kind "random": runs of 16 or more
characters of [A-Za-z0-9+/_=-], a letter among them (numbers alone are ordinary identifiers), which overlap no base span
and whose mean log-likelihood ratio of pairs of states, random strings against ordinary identifiers, reaches a threshold.

A string is read in parts, split where letters turn into digits, small letters into capitals, and at signs; case and the
kind of a split then no longer count. A state is a part's end, or a character with its place in its part (first, second,
later), so that short parts, as random strings have them, tell too. Both models count pairs of states in labelled
strings of the whole corpus. Random strings are all different values that the fixed patterns find, mixed half and half
with evenly drawn characters, as keys come in other alphabets too. Ordinary ones come from texts in which no pattern
finds anything, all of them: words and parts of candidates, as far as several texts have them, so that unlabelled
secrets are not learned as ordinary. Rare pairs of ordinary strings fall back to how frequent their second
state is.

One of HELD texts and random strings is held out of the counts. There, four neighbouring words are an identifier as
anybody might join them. From what one in a thousand of these passes (0 at least: below that a string is likelier an
ordinary one) the threshold is MARGIN of the way to what all but a share MISSED of the held-out random strings reach, as
identifiers of other vocabularies fit the ordinary model less well; it is no more than the latter. The models are one
array of 11,881 numbers.

One scan gathers the different strings of both classes (written once), a second one finds the spans. Where
a text has many matches their places come from running sums in blocks, so that work stays near its length.

Positions are code points. Null and empty texts have no spans; repeated rows get the same result each; an empty table
gives no rows and learns nothing (then no span is added).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, once, running, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern, group whose length counts, least length. Greedy runs of the least length or more are the same as all runs, the short ones dropped.
KINDS = {"assign": (ASSIGN, 2, 6), "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20), "hex": (r"([0-9a-f]{24,})", 1, 24)}
LEAST = 16
CANDIDATE = rf"([A-Za-z0-9+/_=-]{{{LEAST},}})"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Places in a part that are told apart; states: a part's end (0), and each character at each place.
PLACES = 3
SIDE = 1 + PLACES * len(ALPHABET)
#: Where a string is split inside, and words and neighbouring words that no other letter touches.
SPLIT = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^A-Za-z0-9]+"
WORD = r"(?<![\p{L}\p{N}])([A-Za-z0-9]+)(?![\p{L}\p{N}])"
NEIGHBOURS = r"(?<![\p{L}\p{N}])([A-Za-z0-9]+(?:[^\p{L}\p{N}]{1,3}[A-Za-z0-9]+){3})(?![\p{L}\p{N}])"
#: Share of ordinary strings under the threshold, share of random strings that it may miss, texts or strings to one held out.
QUANTILE, MISSED, HELD = 0.999, 0.01, 5
#: How far from ordinary to random strings the threshold lies.
MARGIN = 0.25
#: Share of evenly drawn characters in the random model; weight of the fall-back in a row of pairs, as a share of all pairs.
EVEN, FALL_BACK = 0.5, 0.0003
#: Letters of a candidate's part that is learned as ordinary where several texts have it.
PART = 3
#: Spans that redact() takes from a text at once.
SPANS_AT_ONCE = 64

_SPANS = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has `least` characters or more: array of struct<start, end, value>."""
    pieces = F.split(text, pattern, -1)
    before = F.transform(pieces, F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    # One piece more than matches: its whole and value are null and go with the last filter.
    steps = F.arrays_zip(before.alias("before"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def placed(z: Column, at: Column) -> Column:
        start = at + z["before"]
        return F.struct(start.alias("start"), (start + z["whole"]).alias("end"), z["value"].alias("value"))

    def found(steps: Column) -> Column:
        at = running(F.transform(steps, lambda z: z["before"] + F.coalesce(z["whole"], F.lit(0))), lambda a, b: a + b)
        return F.filter(F.zip_with(steps, at, placed), lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), once(steps, found).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def with_base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    record = F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), record.alias("record"))
    return rows.select("*", *(spans_of(F.col("text"), *of).alias(kind) for kind, of in KINDS.items()))


def lettered(token: Column) -> Column:
    return token.rlike("[A-Za-z]")


def parts_of(token: Column) -> Column:
    """A string's parts in small letters."""
    return F.filter(F.split(F.lower(F.regexp_replace(token, SPLIT, " ")), " "), lambda part: part != "")


def states_of(token: Column) -> Column:
    """A string's states, between two ends of parts."""

    def of(part: Column) -> Column:
        at = F.transform(F.split(part, ""), lambda c, i: F.least(i, F.lit(PLACES - 1)) * len(ALPHABET) + F.instr(F.lit(ALPHABET), c))
        return F.concat(at, F.array(F.lit(0)))

    return F.concat(F.array(F.lit(0)), F.flatten(F.transform(parts_of(token), of)))


def pairs_of(states: Column) -> Column:
    """Pairs of neighbouring states, as numbers below SIDE * SIDE."""
    n = F.size(states) - 1
    return F.zip_with(F.slice(states, F.lit(1), n), F.slice(states, F.lit(2), n), lambda a, b: a * SIDE + b)


def pair_counts(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of each pair of states in the column token, each string counted n times."""
    pairs = tokens.select("n", states_of(F.col("token")).alias("states")).select("n", F.explode(pairs_of(F.col("states"))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("count")).collect()}


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's pairs."""
    table = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")

    def mean(states: Column) -> Column:
        return F.aggregate(pairs_of(states), F.lit(0.0), lambda total, p: total + F.element_at(table, p + 1)) / (F.size(states) - 1)

    return once(states_of(token), mean)


def gathered(based: DataFrame) -> DataFrame:
    """kind, token and n, the number of texts: "random" for values of base spans; of texts without any, "part" for parts
    of candidates, "word" and, of texts held out, "joined" for words and neighbouring words; from rows of with_base."""
    found = F.concat(*KINDS)
    held = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(HELD)) == 0

    def of(kind: str, tokens: Column) -> Column:
        return F.transform(F.array_distinct(tokens), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))

    matches = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    joined = of("joined", F.filter(matches(NEIGHBOURS), lambda t: (F.length(t) >= LEAST) & lettered(t)))
    words = F.when(held, joined).otherwise(of("word", matches(WORD)))
    parts = F.flatten(F.transform(F.filter(matches(CANDIDATE), lettered), parts_of))
    parts = of("part", F.filter(parts, lambda part: (F.length(part) >= PART) & lettered(part)))
    tokens = F.when(F.size(found) > 0, of("random", F.transform(found, lambda s: s["value"]))).otherwise(F.concat(parts, words))
    return based.select(F.inline(tokens)).groupBy("kind", "token").agg(F.count("*").alias("n"))


def reached_from(state: int) -> range:
    """The states of characters that may follow a state; a part's end may too."""
    place = 0 if state == 0 else min((state - 1) // len(ALPHABET) + 1, PLACES - 1)
    return range(1 + place * len(ALPHABET), 1 + (place + 1) * len(ALPHABET))


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """Log-likelihood ratio of each pair of states, from its counts in both classes; pairs that can't be are 0."""
    weight = FALL_BACK * sum(ordinary.values())
    frequent = [1.0 + sum(ordinary.get(a * SIDE + b, 0) for a in range(SIDE)) for b in range(SIDE)]
    ratios = [0.0] * SIDE**2
    for a in range(SIDE):
        following = [0, *reached_from(a)]
        drawn, used = (sum(c.get(a * SIDE + b, 0) for b in following) for c in (random, ordinary))
        usual = sum(frequent[b] for b in following)
        for b in following:
            p = EVEN / len(following) + (1 - EVEN) * (random.get(a * SIDE + b, 0) + 1) / (drawn + len(following))
            q = (ordinary.get(a * SIDE + b, 0) + weight * frequent[b] / usual) / (used + weight)
            ratios[a * SIDE + b] = math.log(p / q)
    return ratios


def learn(based: DataFrame) -> tuple[list[float], float] | None:
    """Log-likelihood ratios of pairs of states and the threshold, from rows of with_base."""
    tokens = materialize(gathered(based), "secret-strings")
    random = tokens.filter("kind = 'random'").withColumn("n", F.lit(1))
    held = F.pmod(F.xxhash64("token", F.lit(7)), F.lit(HELD)) == 0
    counts = [pair_counts(random.filter(~held)) or pair_counts(random), pair_counts(tokens.filter("kind in ('word', 'part') and n > 1"))]
    if not counts[0] or not counts[1]:
        return None
    ratios = log_ratios(*counts)
    ratio = mean_ratio(F.col("token"), ratios)
    missed = random.filter(held & F.col("token").rlike(f"^{CANDIDATE}$") & lettered(F.col("token"))).select(F.percentile_approx(ratio, MISSED, F.lit(10_000))).first()[0]
    passed = tokens.filter("kind = 'joined'").select(F.percentile_approx(ratio, QUANTILE, F.lit(10_000))).first()[0]
    low = max(0.0, passed or 0.0)
    high = low if missed is None else max(0.0, missed)
    return ratios, min(high, low + MARGIN * (high - low))


def scan_secrets(docs: DataFrame, model: tuple[list[float], float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text, record (the row as it was), and assign, access, hex and random: arrays of
    struct<start, end, value>."""
    based = with_base(docs, doc_id, text)
    ratios, threshold = model or learn(based) or (None, 0.0)
    if ratios is None:
        return based.withColumn("random", F.array().cast(_SPANS))
    base = F.concat(*KINDS)
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    likely = lambda s: lettered(s["value"]) & (mean_ratio(s["value"], ratios) >= threshold)
    return based.withColumn("random", F.filter(F.filter(spans_of(F.col("text"), CANDIDATE, 1, LEAST), likely), free))


def named(*kinds: str) -> Column:
    """All spans of the kinds as one array of struct<start, kind's place, end>, in order."""
    return F.array_sort(F.concat(*(_tagged(kind, place) for place, kind in enumerate(kinds))))


def _tagged(kind: str, place: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans, by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(named(*kinds), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mask."""
    text = F.col("text")

    def cut(steps: Column) -> Column:
        # A block's part of the text is taken first, so that its gaps are not looked up from the text's start each.
        starts = F.sequence(F.lit(1), F.size(steps), F.lit(SPANS_AT_ONCE))
        return F.array_join(F.transform(F.transform(starts, lambda at: F.slice(steps, at, SPANS_AT_ONCE)), joined), "")

    def joined(block: Column) -> Column:
        first = F.element_at(block, 1)["after"]
        part = F.substring(text, first + 1, F.element_at(block, -1)["start"] - first)
        return once(part, lambda p: F.array_join(F.transform(block, lambda s: F.concat(F.substring(p, s["after"] - first + 1, s["start"] - s["after"]), F.lit(mask))), ""))

    def covered(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        steps = F.zip_with(spans, reach, lambda s, after: F.struct(s["start"].alias("start"), after.alias("after")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(once(F.filter(steps, lambda s: s["start"] >= s["after"]), cut), F.substring(text, last + 1, F.length(text)))

    spans = named(*KINDS, "random")
    return F.when(F.size(spans) == 0, text).otherwise(once(spans, covered))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(*KINDS), 256).alias("base_sha256"), listed(*KINDS, "random").alias("spans"))
