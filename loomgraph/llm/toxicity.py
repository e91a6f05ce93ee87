"""Toxicity by compression distance.

Zstandard dictionaries are trained on ordinary and on toxic text, in PAIRS pairs. Both of a pair end with one body,
trained on windows of ordinary text, so that what any text shares with ordinary text costs the same under both; before
it stands a part of OWN bytes trained on text of its own class alone. A text is cut into windows of WORDS words, and a
window's gain is its compressed length under the ordinary dictionary less that under the toxic one, on average of the
pairs. The score comes from the windows' gains (the largest three, those over the level that two ordinary windows in a
thousand pass, their share, the mean), by a logistic curve.

Most windows of toxic texts are ordinary. The toxic part is therefore trained on those windows of toxic texts in which
a word, or a word's beginning, occurs that surely (two standard errors) stands in toxic texts e times as often as in
ordinary ones, counted once for each pair of neighbours. What of these windows goes into the dictionary is
zstandard's own choice. Texts that mostly repeat others of the sample teach nothing. Level and curve are calibrated on
gains under dictionaries trained without the text's own fold.

The classifier is fitted on the driver from a bounded sample of labelled rows: at most SAMPLE texts of each class, those
of least hash, whole, up to SAMPLE_BYTES of each class (documented parameters); the curve from CALIBRATED of these.
Scoring reads whole texts of all rows. Null and empty texts have one empty window, of gain 0; a label that is null is
not learned from; without labels of both classes every score is 0; repeated rows score alike; no rows give none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import batches_of
from .common import bound_batches, fresh, materialize

#: Words of a scored window, and of one that a class's part is trained on.
WORDS, NARROW = 8, 3
#: Bytes of the body and of a class's part; length of the segments that zstandard takes for each.
BODY, OWN, BODY_SEGMENT, OWN_SEGMENT = 131_072, 4_096, 64, 16
#: Pairs of dictionaries, share of a class's windows that one pair is trained on, folds of the calibration.
PAIRS, SHARE, FOLDS = 3, 0.6, 3
LEVEL, MIN_MATCH = 5, 5
#: Least log odds of a telling word; lengths of the word beginnings that are counted too.
SURE, PREFIXES = 1.0, (4, 5, 6)
SAMPLE, SAMPLE_BYTES, CALIBRATED, THRESHOLD = 3_000, 32 << 20, 700, 0.7


def windows(text: str, n: int = WORDS) -> list[bytes]:
    words = text.lower().encode().split()
    return [b" ".join(words[i : i + n]) for i in range(0, len(words), n)] or [b""]


def narrow_windows(text: str) -> list[bytes]:
    return [b" %b " % w for w in windows(text, NARROW)]


def beginnings(word: str) -> list[str]:
    """A word and its first letters: inflected words share those."""
    word = word.strip(".,;:!?\"'()")
    return [word[:n] for n in PREFIXES if len(word) > n] + ([word] if len(word) >= PREFIXES[0] else [])


def unlike_others(texts: list[str]) -> list[str]:
    """Without those texts of which more than half the word triples stand in earlier ones."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.lower().split()
        triples = {hash(tuple(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
        if 2 * len(triples & seen) <= len(triples):
            out.append(text)
        seen |= triples
    return out


def counted_beginnings(texts: list[str]) -> list[Counter]:
    """How often word beginnings occur in each fold's texts, between neighbours between which no earlier one did."""
    seen: set[int] = set()
    out = [Counter() for _ in range(FOLDS)]
    for n, text in enumerate(texts):
        words = ["", *text.lower().split(), ""]
        contexts = {hash(tuple(words[i - 1 : i + 2])): words[i] for i in range(1, len(words) - 1)}
        new = contexts.keys() - seen
        out[n % FOLDS].update(b for c in new for b in set(beginnings(contexts[c])))
        seen |= new
    return out


def telling(own: Counter, others: Counter) -> set[str]:
    """Word beginnings that surely have a larger share of `own` than of `others`."""
    n, m = sum(own.values()) + 1, sum(others.values()) + 1
    found = set()
    for word, count in own.items():
        if count >= 3:
            a, b = count + 0.5, others[word] + 0.5
            if math.log(a / n) - math.log(b / m) - 2 * math.sqrt(1 / a + 1 / b) > SURE:
                found.add(word)
    return found


def trained(samples: list[bytes], size: int, segment: int, d: int) -> bytes:
    """A dictionary trained by zstandard; where there are too few samples to train on, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=d).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


class Compressor:
    """Compressed lengths of windows under one dictionary, without frame headers."""

    def __init__(self, raw: bytes):
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        self.compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress

    def lengths(self, found: list[bytes]) -> np.ndarray:
        compress = self.compress
        return np.array([len(compress(w)) for w in found], np.float64)


class Dictionaries:
    """A body and PAIRS pairs of parts, each trained by zstandard on windows of one class."""

    def __init__(self, toxic: list[str], ordinary: list[str], marks: set[str]):
        rng = np.random.default_rng(7)
        plain = [w for t in ordinary for w in narrow_windows(t)]
        every = [w for t in toxic for w in narrow_windows(t)]
        marked = [w for w in every if any(b in marks for word in w.decode().split() for b in beginnings(word))] or every
        some = lambda of, n: [of[i] for i in rng.permutation(len(of))[:n]]
        self.body = trained(some(plain, 200_000), BODY, BODY_SEGMENT, 8)
        self.parts = []
        for _ in range(PAIRS):
            n = max(50, int(SHARE * len(marked)))
            self.parts.append((trained(some(plain, n), OWN, OWN_SEGMENT, 6), trained(some(marked, n), OWN, OWN_SEGMENT, 6)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}

    def gains(self, text: str) -> np.ndarray:
        if "_pairs" not in self.__dict__:
            self._pairs = [(Compressor(ordinary + self.body), Compressor(toxic + self.body)) for ordinary, toxic in self.parts]
        found = windows(text)
        return sum(ordinary.lengths(found) - toxic.lengths(found) for ordinary, toxic in self._pairs) / len(self._pairs)


def features(gains: np.ndarray, level: float) -> list[float]:
    top = np.sort(gains)[::-1][:3]
    top = np.concatenate([top, np.full(3 - len(top), min(0.0, gains.min()))])
    over = float((gains >= level).sum())
    return [*top, math.log1p(over), over / len(gains), math.log(len(gains)), gains.mean()]


class Model:
    """The dictionaries, the windows' level and the logistic weights."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.weights = None
        classes = [unlike_others(list(dict.fromkeys(texts))) for texts in (toxic, ordinary)]
        if not all(classes):
            return
        counts = [counted_beginnings(texts) for texts in classes]

        def without(fold: int | None) -> Dictionaries:
            kept = [[t for i, t in enumerate(texts) if i % FOLDS != fold] or texts for texts in classes]
            totals = [sum((c for i, c in enumerate(of) if i != fold), Counter()) for of in counts]
            return Dictionaries(*kept, telling(*totals))

        gains: list[list[np.ndarray]] = [[], []]
        for fold in range(FOLDS):
            others = without(fold)
            for out, texts in zip(gains, classes, strict=True):
                out += [others.gains(t) for t in texts[fold:CALIBRATED:FOLDS]]
        self.dictionaries = without(None)
        self.level = float(max(1.0, np.quantile(np.concatenate(gains[1]), 0.998)))
        x = np.array([features(g, self.level) for of in gains for g in of])
        y = np.repeat([1.0, 0.0], [len(of) for of in gains])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.weights = logistic(np.c_[np.ones(len(x)), (x - self.mean) / self.scale], y)

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        x = (np.array(features(self.dictionaries.gains(text), self.level)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + x @ self.weights[1:])))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` different texts of each class, those of least hash, and sample_bytes of each class."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).filter("text is not null")
    rows = rows.select("*", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    got = []
    for of in (1, 0):
        mine = rows.filter(F.col("label") == of)
        least = [(r["hash"], r["size"]) for r in mine.select("hash", "size").distinct().orderBy("hash").limit(sample).collect()]
        within = np.cumsum([size for _, size in least]) <= sample_bytes
        if not within.any():
            got.append([])
            continue
        last = least[int(within.sum()) - 1][0]
        got.append(sorted({r["text"] for r in mine.filter(F.col("hash") <= last).select("text").distinct().collect()}))
    rng = np.random.default_rng(11)
    return Model(*([texts[i] for i in rng.permutation(len(texts))] for texts in got))


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])
                at += len(texts)

    return score


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id and score, 0 to 1. The model (some 160 kB) is broadcast."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def _adder(shared, at: int, name: str):
    def add(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return add


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs, all columns, and the score as the last one; it is named `into`, with underscores behind it where docs has that name."""
    bound_batches(docs.sparkSession)
    name = fresh(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_adder(shared, docs.columns.index(text), name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(spark, sf_dir: str) -> Model:
    """The model from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).filter(~held_out() & F.col("label").isNotNull())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The classes are sampled by id first, so that one scan gathers the sampled rows' texts alone.
    chosen = None
    for of in (1, 0):
        some = labels.filter(F.col("label") == of).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE)
        chosen = some if chosen is None else chosen.unionByName(some)
    return fit(materialize(docs.join(F.broadcast(chosen), "doc_id"), "labelled"), label="label")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), learned(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
