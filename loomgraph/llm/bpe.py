"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one last token in its encoding. It is found among the vocabulary entries that end
there: walking the piece through a suffix automaton of the vocabulary (states are the entries' prefixes, links go to
the longest proper suffix that is a state) gives those entries longest first, and the right one is the first that may
follow the last token of the prefix before it. Two tokens may stand side by side if merging their bytes anew gives
just these two. Back-pointers from the whole piece give the ids. Pieces of a batch are sorted, so that a piece takes
over the prefixes it shares with the one before.

Whole texts are cut by the tokenizer's own pattern after its special tokens are taken out. Null counts as empty text;
an empty text has no ids and decodes to the empty string; repeated rows get the same result each; no rows give none.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker keeps encoded; the store is emptied when full.
STORE = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in characters that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + n)] = b
    return out


class Vocabulary:
    """Tokens, merge ranks, splits of merged tokens and the automaton of one tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_alphabet()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocabulary = model["model"]["vocab"]
        self.bytes = {i: as_bytes(s) for s, i in vocabulary.items()}
        self.id = {b: i for i, b in self.bytes.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.rank, self.split = {}, {}
        for n, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocabulary[left], vocabulary[right]
            self.rank.setdefault((a, b), n)
            self.split.setdefault(vocabulary[left + right], (a, b, n))
        self.by_id = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.automaton()

    def automaton(self) -> None:
        """States in breadth order: go (state, byte) -> state, link to the longest suffix, ends: entries that end there, longest first."""
        go, word, children = {}, [None], [[]]
        for token, i in self.id.items():
            s = 0
            for b in token:
                n = go.get((s, b))
                if n is None:
                    n = go[(s, b)] = len(word)
                    word.append(None)
                    children.append([])
                    children[s].append((b, n))
                s = n
            word[s] = i
        link, ends, queue = [0] * len(word), [()] * len(word), [0]
        for s in queue:
            for b, n in children[s]:
                t = link[s]
                while s and t and (t, b) not in go:
                    t = link[t]
                link[n] = go.get((t, b), 0) if s else 0
                own = ((word[n], len(self.by_id[word[n]])),) if word[n] is not None else ()
                ends[n] = own + ends[link[n]]
                queue.append(n)
        self.go, self.link, self.ends = go, link, ends
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Do tokens a and b stay apart, each merged as it is, when their bytes are encoded together?

        Undo the merges of both along the seam, latest first: a merge across the seam that comes before the undone one
        (or, of the same rank, further left) would have taken its parts."""
        left, right, limit = a, b, len(self.rank) + 1
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            l, r = self.split.get(left), self.split.get(right)
            l_rank, r_rank = l[2] if l else -1, r[2] if r else -1
            if l_rank < 0 and r_rank < 0:
                return True
            if l_rank > r_rank:
                limit, left = l_rank, l[1]
            else:  # of equal merges the left one came first, so the right one is undone first
                limit, right = r_rank + 1, r[0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of sorted pieces, as little-endian unsigned 32-bit integers."""
        go, link, ends, pairs = self.go, self.link, self.ends, self.pairs
        states, last, length = [0], [-1], [0]
        before, out = b"", []
        for piece in pieces:
            same, most = 0, min(len(piece), len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del states[same + 1 :], last[same + 1 :], length[same + 1 :]
            s = states[same]
            for i in range(same, len(piece)):
                b = piece[i]
                n = go.get((s, b))
                while n is None:
                    s = link[s]
                    n = go.get((s, b))
                s = n
                for token, size in ends[s]:
                    at = i + 1 - size
                    if not at:
                        break
                    key = last[at] << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > 2_000_000:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last[at], token)
                    if fits:
                        break
                states.append(s)
                last.append(token)
                length.append(size)
            ids, at = [], len(piece)
            while at:
                ids.append(last[at])
                at -= length[at]
            out.append(array("I", ids[::-1]).tobytes())
            before = piece
        return out


_loaded: dict[str, tuple] = {}


class Codec:
    """A vocabulary with a worker's store of encoded pieces."""

    def __init__(self, spec: str):
        self.vocabulary, self.store, self.pattern = Vocabulary(spec), {}, regex.compile(PATTERN)

    @staticmethod
    def of(spec: str) -> Codec:
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in _loaded:
            _loaded[key] = Codec(spec)
        return _loaded[key]

    def parts(self, text: str):
        """Alternately ordinary text and the id of a special token."""
        at = 0
        special = self.vocabulary.special_pattern
        for m in special.finditer(text) if special else ():
            yield text[at : m.start()], self.vocabulary.special[m[0]]
            at = m.end()
        yield text[at:] if at else text, None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [[(self.pattern.findall(part), special) for part, special in self.parts(t)] for t in texts]
        wanted = set().union(*(pieces for parts in cut for pieces, _ in parts))
        missing = wanted.difference(self.store)
        if missing:
            if len(self.store) + len(missing) > STORE:
                self.store.clear()
                missing = wanted
            ordered = sorted(missing)
            encoded = sorted(p.encode() for p in ordered)
            self.store.update(zip((e.decode() for e in encoded), self.vocabulary.encode_pieces(encoded), strict=True))
        get, out = self.store.__getitem__, []
        for parts in cut:
            ids = [b"".join(map(get, pieces)) + (b"" if special is None else special.to_bytes(4, "little")) for pieces, special in parts]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.by_id.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def batches_of(texts: pa.Array, most: int = 1 << 21):
    """Lists of texts of about `most` characters (null: empty)."""
    out, size = [], 0
    for t in texts:
        out.append(t.as_py() or "")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def _coder(shared):
    def code(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column(1)):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at += len(texts)

    return code


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    tokenizer: path of a byte-level BPE tokenizer file on the driver; its text, a fixed size, is broadcast."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_spec(tokenizer))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_coder(shared), schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
