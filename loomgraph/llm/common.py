"""Helpers shared by the corpus operators: shared-folder tables, text batches and vectorised word hashes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset in local mode, a fresh temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and any executor can be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches hold `most` bytes, so that long texts don't fill Python workers; a session's own setting stays.

    Every operator that hands texts to Python calls this. Spark reads the setting when it plans a query, so it is left on."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SALTS = 64


def salt(*columns: str) -> Column:
    """A number below SALTS by the columns' hash, by which rows of one key are split."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts_seen(salted: str = "salt") -> Column:
    """Aggregate: which salts a key's rows have, as bits; each task reports its own."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salted)))


def each_salt(seen: str) -> Column:
    """One row for each salt in `seen`, so that a key's row meets its rows salt by salt."""
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s)
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col(seen).bitwiseAND(bit(s)) != 0))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """What `combine` makes of 0 and all values before each one, such as running sums; in blocks, so that no long array grows by one."""
    last = lambda held: F.element_at(held, -1)
    zero = F.array(F.lit(0))

    def within(whole: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(whole), F.lit(block)), lambda at: F.slice(whole, at, block))
        return F.transform(parts, lambda part: F.aggregate(part, zero, lambda held, x: F.concat(held, F.array(combine(last(held), x)))))

    def moved(parts: Column) -> Column:
        before = F.aggregate(parts, zero, lambda held, part: F.concat(held, F.array(combine(last(held), last(part)))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, at: F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x: combine(at, x))))

    nothing = F.array().cast("array<int>")
    return once(values, lambda whole: F.when(F.size(whole) > 0, once(within(whole), moved)).otherwise(nothing))


class Texts:
    """Some rows' UTF-8 bytes laid end to end: data (uint8) and the rows' edges in it (len rows + 1)."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, first: int):
        self.data, self.edges, self.first = data, edges, first

    def __len__(self) -> int:
        return len(self.edges) - 1


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column (null: empty) into steps of about `most` bytes; no text is split."""
    if len(column) == 0:
        return
    column = pa.concat_arrays([pc.fill_null(column, "")])
    edges = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        yield Texts(data[edges[at] : edges[to]], edges[at : to + 1] - edges[at], at)
        at = to


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base))])
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers become even hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many spans at once, from one running sum; for spans of under 1,000 values."""
    up, down = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


LONG_SPAN = 512


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:end]; long ones, for which sums of powers can be made to collide, by BLAKE2."""
    out = spans_hash(_table(1)[data], starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


#: Byte classes. Both word rules work on bytes: all bytes of a non-ASCII code point are word bytes.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a Texts: byte spans, the row of each word, its place in the row, and the rows' edges in the word list."""

    def __init__(self, texts: Texts, lower: bool):
        self.data = LOWER[texts.data] if lower else texts.data
        inside = (ALNUM if lower else SPACES)[self.data]
        n = len(inside)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        cuts = texts.edges[(texts.edges > 0) & (texts.edges < n)]
        before[cuts] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.edges = np.searchsorted(self.starts, texts.edges)
        self.counts = np.diff(self.edges)
        self.row = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def place(self) -> np.ndarray:
        return np.arange(len(self)) - self.edges[self.row]

    def left(self) -> np.ndarray:
        """Words from each one to the end of its row, itself included."""
        return self.edges[self.row + 1] - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        return bytes_hash(self.data, self.starts, self.ends)


def grams(hashes: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word grams that stay within a row, and their hashes."""
    starts = np.flatnonzero(left >= k)
    return starts, spans_hash(hashes, starts, starts + k)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def slid_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; len(x) - w + 1 of them."""
    n, size, out = len(x) - w + 1, 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[w - size : w - size + n]) if n > 0 else x[:0]


def bitmap_of(positions: DataFrame, column: str, size: int) -> np.ndarray:
    """The set of positions below `size` as bits; the driver holds size / 8 bytes at most."""
    maps = positions.groupBy(F.expr(f"{column} div 32768").alias("bucket")).agg(F.expr(f"bitmap_construct_agg({column} % 32768)").alias("bitmap"))
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for r in maps.toLocalIterator():
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def has_bit(bitmap: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bitmap[position >> 3] >> (position & 7).astype(np.uint8)) & 1 > 0
