"""Training-order materialisation: token ids as fixed-stride binary shards in a keyed global order.

Texts are encoded, each ended with the end-of-text id, and packed one after the other into sequences of LENGTH ids; only
the last sequence of an input partition is padded (with that id). Sequences are numbered without gaps: by input
partition, then by place in it, from a running sum over one row of 16 bytes a partition, which is broadcast. A keyed
Feistel network over the smallest even number of bits that holds all numbers, walked on until it falls below their
count, permutes them: number -> global slot, one to one, without a table. Slots are cut into ranges of ROWS_A_SHARD, one
shard file each: slot s is at byte (s mod ROWS_A_SHARD) * stride of its shard, little-endian unsigned 16-bit ids (32-bit
for larger vocabularies), stride bytes a sequence.

The packed sequences are written once, compressed, to the shared folder; only the slot order moves them. A range is one
partition, sorted by slot and streamed to a file that gets its name when whole, with its checksum beside it: a retried
task writes the same bytes. The folder's manifest names the tokenizer, the order's parameters and a fingerprint of all
sequences. A later run of the same input into the same folder leaves whole shards alone (resumption) if their size and
checksum are right; a folder with another manifest is refused. It must be one that all executors reach, and is opened by
pyarrow's file systems. Input files read with the same split size give the same order.

Ids come from tiktoken's encoder over the tokenizer file's own vocabulary, whose merges it applies in the same order;
texts with a piece of over LONG_PIECE characters go to the encoder of bpe.py, whose work stays near their length.

Null and empty texts give just the end-of-text id. Repeated rows are encoded each. A null doc_id is listed as null. An
empty table gives no rows and no files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PATTERN, Codec, batches_of, default_tokenizer, tokenizer_spec
from .common import bound_batches, materialize, mix, shared_dir

LENGTH, ROWS_A_SHARD, ROUNDS, KEY = 2048, 1 << 14, 6, 20240611
#: Texts, and characters of each, that train the packed table's compression dictionary, and its bytes. It changes no result.
SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL = 1_000, 20_000, 112_640, 6
LONG_PIECE = 2_000


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of the numbers below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(v):
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as arrays of the shards' integer type."""

    def __init__(self, spec: str):
        self.spec, vocabulary = spec, Codec.of(spec).vocabulary
        plain = {b: i for i, b in vocabulary.bytes.items() if i not in vocabulary.special.values()}
        self.encoding = tiktoken.Encoding("training-order", pat_str=PATTERN, mergeable_ranks=plain, special_tokens=vocabulary.special)
        self.kind = id_kind(vocabulary)

    @staticmethod
    def of(spec: str) -> Encoder:
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in _encoders:
            _encoders[key] = Encoder(spec)
        return _encoders[key]

    def encode(self, text: str) -> np.ndarray:
        if max(map(len, text.split()), default=0) > LONG_PIECE or any(c * LONG_PIECE in text for c in " \n\t"):
            return np.frombuffer(Codec.of(self.spec).encode([text])[0], "<u4").astype(self.kind)
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(self.kind)


def id_kind(vocabulary) -> str:
    return "<u4" if len(vocabulary.by_id) > 1 << 16 else "<u2"


def squeezing(docs: DataFrame, text: str, spec: str) -> bytes:
    """A zstandard dictionary for the packed table, trained on the start of SAMPLE texts; empty if they are too few."""
    texts = docs.filter(F.pmod(F.xxhash64(text), F.lit(64)) == 0).select(F.substring(F.col(text).cast("string"), 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE)
    ids = b"".join(Encoder.of(spec).encode(r["text"]).tobytes() for r in texts.collect() if r["text"])
    try:
        return zstandard.train_dictionary(DICTIONARY, [ids[at : at + 512] for at in range(0, len(ids), 512)]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(raw: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def _packer(shared, length: int, end: int, kind: str, squeezed: bytes):
    def pack(batches):
        encoder, squeeze = Encoder.of(shared.value), zstandard.ZstdCompressor(level=LEVEL, **_dictionary(squeezed)).compress
        part, row = TaskContext.get().partitionId(), 0
        held, held_docs, held_ends, id_type = np.zeros(0, kind), [], [], pa.int64()

        def packed(count: int, ids: np.ndarray, docs: list[list], used: list[int]):
            places = np.arange(row, row + count)
            return pa.RecordBatch.from_arrays([pa.array(np.full(count, part, np.int32)), pa.array(places), pa.array(docs, pa.list_(id_type)), pa.array(used, pa.int32()), pa.array([squeeze(i.tobytes()) for i in ids.reshape(count, length)], pa.binary())], names=["part", "row", "doc_ids", "n_tokens", "ids"])

        for batch in batches:
            at, id_type = 0, batch.schema.field(0).type
            for texts in batches_of(batch.column(1)):
                found = [np.append(encoder.encode(t), np.array([end], kind)) for t in texts]
                names = held_docs + batch.column(0).slice(at, len(texts)).to_pylist()
                ids = np.concatenate([held, *found])
                ends = np.cumsum([*held_ends, *map(len, found)])
                starts = np.concatenate([[0], ends[:-1]])
                count = len(ids) // length
                if count:
                    edges = np.arange(count) * length
                    first, last = np.searchsorted(ends, edges, "right"), np.searchsorted(starts, edges + length, "left")
                    yield packed(count, ids[: count * length], [names[a:b] for a, b in zip(first, last, strict=True)], [length] * count)
                    row += count
                done = int(np.searchsorted(ends, count * length, "right"))
                held, held_docs = ids[count * length :], names[done:]
                held_ends = np.diff(np.concatenate([[count * length], ends[done:]])).tolist()
                at += len(texts)
        if len(held):
            yield packed(1, np.concatenate([held, np.full(length - len(held), end, kind)]), [held_docs], [len(held)])

    return pack


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", squeezed: bytes = b"") -> DataFrame:
    """part, row (place in the partition), doc_ids, n_tokens (end-of-text ids included, padding not), ids (compressed)."""
    spec = tokenizer_spec(tokenizer)
    vocabulary = Codec.of(spec).vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = next(iter(vocabulary.special.values()), len(vocabulary.by_id) - 1)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_packer(shared, length, end, id_kind(vocabulary), squeezed), schema)


def numbered(packed: DataFrame) -> DataFrame:
    """packed with `number`, gapless from 0, by part and row."""
    counts = packed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return packed.join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + F.col("row")).drop("offset")


def _permuter(n: int, key: int):
    def permute(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(feistel(batch.column(batch.schema.get_field_index("number")).to_numpy(), n, key))], names=[*batch.schema.names, "slot"])

    return permute


def permuted(rows: DataFrame, n: int, key: int = KEY) -> DataFrame:
    """rows with `slot`, the keyed permutation of their `number` below n."""
    return rows.mapInArrow(_permuter(n, key), T.StructType([*rows.schema.fields, T.StructField("slot", T.LongType())]))


def checksum(store: fs.FileSystem, name: str) -> int:
    crc = 0
    with store.open_input_stream(name) as f:
        while piece := f.read(1 << 20):
            crc = zlib.crc32(piece, crc)
    return crc


def is_whole(store: fs.FileSystem, name: str, size: int) -> bool:
    """Is the shard there, of this size and with the checksum noted beside it?"""
    there, noted = store.get_file_info([name, f"{name}.crc32"])
    if there.type != fs.FileType.File or there.size != size or noted.type != fs.FileType.File:
        return False
    with store.open_input_stream(f"{name}.crc32") as f:
        return f.read().decode() == str(checksum(store, name))


class Shard:
    """One shard as it is written: a temporary file that is named when whole."""

    def __init__(self, store: fs.FileSystem, name: str):
        self.store, self.name, self.temporary, self.crc = store, name, f"{name}.{uuid.uuid4().hex}", 0
        self.out = store.open_output_stream(self.temporary)

    def write(self, piece: bytes) -> None:
        self.crc = zlib.crc32(piece, self.crc)
        self.out.write(piece)

    def close(self) -> None:
        self.out.close()
        with self.store.open_output_stream(f"{self.temporary}.crc32") as f:
            f.write(str(self.crc).encode())
        self.store.move(f"{self.temporary}.crc32", f"{self.name}.crc32")
        self.store.move(self.temporary, self.name)


def _writer(folder: str, rows_a_shard: int, n: int, stride: int, squeezed: bytes):
    def write(batches):
        (store, path), whole = fs.FileSystem.from_uri(folder), zstandard.ZstdDecompressor(**_dictionary(squeezed)).decompress
        number, shard = -1, None
        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            shards, slots = columns["shard"].to_numpy(), columns["slot"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            ids = [whole(i.as_buffer()) for i in columns["ids"]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and shards[a] != number:
                    if shard is not None:
                        shard.close()
                    number = int(shards[a])
                    name = f"{path}/shard-{number:08d}.bin"
                    done = is_whole(store, name, stride * min(rows_a_shard, n - number * rows_a_shard))
                    shard = None if done else Shard(store, name)
                if shard is not None:
                    shard.write(b"".join(ids[a:b]))
            yield pa.RecordBatch.from_arrays([columns["slot"], columns["shard"], pa.array(slots % rows_a_shard * stride), columns["n_tokens"], columns["doc_ids"], pa.array([zlib.crc32(i) for i in ids], pa.int64())], names=["slot", "shard", "at_byte", "n_tokens", "doc_ids", "ids_crc32"])
        if shard is not None:
            shard.close()

    return write


def claim(folder: str, manifest: dict) -> None:
    """Make the folder and note what it is to hold; refuse one that holds something else."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name, wanted = f"{path}/manifest.json", json.dumps(manifest, sort_keys=True)
    if store.get_file_info(name).type == fs.FileType.File:
        with store.open_input_stream(name) as f:
            if f.read().decode() != wanted:
                raise ValueError(f"{folder} holds the shards of another input or order")
    else:
        with store.open_output_stream(f"{name}.new") as f:
            f.write(wanted.encode())
        store.move(f"{name}.new", name)


def materialise_order(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, rows_a_shard: int = ROWS_A_SHARD, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards as the result is evaluated; per sequence: slot, shard, at_byte, n_tokens, doc_ids, ids_crc32."""
    bound_batches(docs.sparkSession)
    spec = tokenizer_spec(tokenizer)
    kind = id_kind(Codec.of(spec).vocabulary)
    squeezed = squeezing(docs, text, spec)
    packed = materialize(sequences(docs, tokenizer, length, doc_id, text, squeezed), "sequences")
    mark = F.shiftright(F.xxhash64("part", "row", "ids"), 24)
    n, fingerprint = packed.agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0))).first()
    folder = folder if ":/" in folder else f"file://{folder}"
    claim(folder, {"sequences": n, "fingerprint": fingerprint, "length": length, "rows_a_shard": rows_a_shard, "key": key, "ids": kind, "tokenizer": hashlib.sha256(spec.encode()).hexdigest()})
    placed = permuted(numbered(packed), n, key).withColumn("shard", F.floor(F.col("slot") / rows_a_shard).cast("int"))
    dealt = placed.select("slot", "shard", "n_tokens", "doc_ids", "ids").repartitionById(max(1, -(-n // rows_a_shard)), F.col("shard")).sortWithinPartitions("slot")
    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("at_byte", T.LongType()), T.StructField("n_tokens", T.IntegerType()), packed.schema["doc_ids"], T.StructField("ids_crc32", T.LongType())])
    return dealt.mapInArrow(_writer(folder, rows_a_shard, n, length * np.dtype(kind).itemsize, squeezed), schema)


def op3_training_order(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    return materialise_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, default_tokenizer())
