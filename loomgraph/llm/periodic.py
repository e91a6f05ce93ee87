"""Periodic runs of words: stretches that repeat one phrase, found by a suffix automaton whose paths are recoloured.

A run is a stretch of words with smallest period q, of max(LEAST, TIMES * q) words or more, that no neighbouring word
extends with period q.

1. All texts of a batch are cut and hashed at once, and only regions that can hold a run are looked at closely. In a run
   of period q every gram from the q-th word on occurs q words earlier. So for periods up to each power of two the
   stretches of grams whose previous occurrence is at most that near are taken, where they are long enough for the
   smallest period meant; each with one period more on its left. Regions that touch are one. Every run lies within one.
2. A region's suffix automaton is built. Then its words are appended one by one: the path from the automaton's state of
   all words so far to its root is accessed and given the new word's place as colour. Where the old colour changes along
   the path, at a node of length L with old place e, the last L words also end at e and no longer suffix does. The
   distance d from e to the new place with L >= d is a square of period d that goes L + d words back from here, and every
   primitive square is met so. Squares of one period and start are one run, which ends where the last of them ends.
   A stretch of TIMES periods met at distance d has no smaller period, else the nearer occurrence would have its colour.
3. As a region is known before its first word is appended, the tree of suffix links is fixed, and paths are held as
   stacks of coloured segments on its heavy paths instead of splay trees: an access takes segments off and puts one back
   for each heavy path it crosses, O(log n) amortised.

Every row is judged alone, in the task that reads it; memory is the batch's and, for a region, some hundred bytes a word.
A null or empty text has no words and no runs; a null doc_id has no number, so its words stay as they are; repeated rows
get the same result each; texts of any length are taken whole; of equally long runs the one of smaller start, then period
is the longest; an empty table gives no rows. A run's longest period is not bounded.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bound_batches, chunks, spans_hash, text_or_empty

LEAST, TIMES = 6, 4
#: Grams by which regions are found: (smallest period, words of a gram).
GRAMS = ((1, 1), (5, 5), (33, 33))


def periodic_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document of n words, by the contract's rule; None: each its own."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def previous(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How far back the same key last stood in the same row; a large number where it did not."""
    order = np.argsort(keys, kind="stable")
    back = np.full(len(keys), 1 << 40)
    same = (keys[order[1:]] == keys[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return back


def regions(hashes: np.ndarray, edges: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of disjoint regions of the words that hold every run, none over a row's edge."""
    n = len(hashes)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    left = edges[row + 1] - np.arange(n)
    longest = int(np.diff(edges).max(initial=0))
    starts, ends = [], []
    for (low, gram), (high, _) in itertools.zip_longest(GRAMS, GRAMS[1:], fillvalue=(1 << 40, 0)):
        if longest < max(least, times * low):
            break
        whole = left >= gram
        keys = hashes if gram == 1 else spans_hash(hashes, np.arange(n), np.minimum(np.arange(n) + gram, n))
        back = previous(keys, row)
        back[~whole] = 1 << 40
        q = low
        while q < high and max(least, times * q) <= longest:
            most = min(1 << (q - 1).bit_length() if q > 1 else 1, high - 1)
            near = back <= most
            near_before = np.zeros(n, bool)
            near_before[1:] = near[:-1]
            near_before[edges[:-1][edges[:-1] < n]] = False
            near_after = np.zeros(n, bool)
            near_after[:-1] = near[1:]
            near_after[edges[1:][edges[1:] > 0] - 1] = False
            first, last = np.flatnonzero(near & ~near_before), np.flatnonzero(near & ~near_after)
            # Grams of the run from its q-th word on.
            enough = last - first + 1 >= max(least, times * q) - q - gram + 1
            first, last = first[enough], last[enough]
            starts.append(np.maximum(first - most, edges[row[first]]))
            ends.append(last + gram)
            q = most + 1
    if not starts or not sum(map(len, starts)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    # Regions of two rows may touch, but aren't one.
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] >= reach[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.maximum.reduceat(reach, at)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's links and lengths, and the state of every prefix. States are numbered from the root, 0."""
    link, length, after, states = [-1], [0], [{}], []
    last = 0
    for word in words:
        here = len(link)
        link.append(0)
        length.append(length[last] + 1)
        after.append({})
        at = last
        while at >= 0 and word not in after[at]:
            after[at][word] = here
            at = link[at]
        if at >= 0:
            to = after[at][word]
            if length[at] + 1 == length[to]:
                link[here] = to
            else:
                copy = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                after.append(after[to].copy())
                while at >= 0 and after[at].get(word) == to:
                    after[at][word] = copy
                    at = link[at]
                link[to] = link[here] = copy
        states.append(here)
        last = here
    return link, length, states


def heavy_tops(link: list[int], length: list[int]) -> list[int]:
    """Of every state the top of its heavy path in the tree of suffix links."""
    order = sorted(range(1, len(link)), key=length.__getitem__)
    size, heavy = [1] * len(link), [0] * len(link)
    for state in reversed(order):
        parent = link[state]
        size[parent] += size[state]
        if not heavy[parent] or size[state] > size[heavy[parent]]:
            heavy[parent] = state
    top = list(range(len(link)))
    for state in order:
        if heavy[link[state]] == state:
            top[state] = top[link[state]]
    return top


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words, sorted."""
    link, length, states = automaton(words)
    top = heavy_tops(link, length)
    # Of each heavy path the coloured part as (length of the segment's lowest state, colour), the lowest first.
    paths: list[list[tuple[int, int]]] = [[] for _ in link]
    ends: dict[tuple[int, int], int] = {}
    for place, state in enumerate(states):
        met = -1
        while state > 0:
            head, depth = top[state], length[state]
            path = paths[head]
            crossed, low = [], 0
            while path and low < depth:
                low, colour = path[-1]
                crossed.append((colour, min(low, depth)))
                if low <= depth:
                    path.pop()
            # From the lowest segment up; one colour may go on over several heavy paths, and its lowest state counts.
            for colour, seen in reversed(crossed):
                if colour != met:
                    met, d = colour, place - colour
                    if seen + d >= least and seen >= (times - 1) * d:
                        ends[d, place - seen - d + 1] = place + 1
            path.append((depth, place))
            state = link[head]
    return sorted((start, end - start, d) for (d, start), end in ends.items())


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, q in runs:
        change[start + q] += 1
        change[start + size] -= 1
    return np.cumsum(change[:-1]) == 0


def _spaced(part, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each word with one space before it, and where each row starts in them."""
    inside = np.zeros(len(part.data) + 1, np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    size = words.ends - words.starts + 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.full(first[-1], 0x20, np.uint8)
    word_bytes = np.ones(first[-1], bool)
    word_bytes[first[:-1]] = False
    out[word_bytes] = part.data[inside]
    return out, first


def _finder(numbered: bool, least: int, times: int):
    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_words, found, kept = [], [], []
            for part in chunks(batch.column(1)):
                words = Words(part, lower=False)
                hashes, edges = words.hashes(), words.edges
                orders = [periodic_order(ids[part.first + r], int(words.counts[r])) if numbered else None for r in range(len(part))]
                for r, order in enumerate(orders):
                    if order is not None:
                        hashes[edges[r] : edges[r + 1]] = hashes[edges[r] : edges[r + 1]][order]
                starts, ends = regions(hashes, edges, least, times)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in orders]
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    r = int(words.row[start])
                    moved = start - int(edges[r])
                    _, numbers = np.unique(hashes[start:end], return_inverse=True)
                    runs[r] += [(s + moved, size, q) for s, size, q in runs_of(numbers.tolist(), least, times)]
                text, first = _spaced(part, words)
                for r, order in enumerate(orders):
                    n, (a, b) = int(words.counts[r]), edges[r : r + 2]
                    if order is None and not runs[r]:
                        kept.append(text[first[a] + 1 : first[b]].tobytes() if n else b"")
                    else:
                        stay = np.arange(n)[without_repeats(n, runs[r])]
                        stay = stay if order is None else order[stay]
                        listed = text[first[a] + 1 : first[b]].tobytes().split(b" ")
                        kept.append(b" ".join([listed[i] for i in stay.tolist()]))
                    n_words.append(n)
                    found.append([{"start": s, "length": size, "period": q} for s, size, q in sorted(runs[r], key=lambda x: (x[0], x[2]))])
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", numbered: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (array of struct<start, length, period>, by start, then period) and
    collapsed (the words left, joined by one space).

    numbered: judge the words in the order that periodic_order gives by doc_id. times: periods that a run has at least, 2
    or more (under 4 a reported period may be a multiple of the smallest)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_finder(numbered, least, times), schema)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), numbered=True)
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, length, period = F.col("best.start"), -F.col("best.least"), F.col("best.period")
    exponent = F.floor(1000 * length / period).cast("long")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
