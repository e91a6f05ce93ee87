"""Quality rules by distribution divergence.

The corpus itself gives each language two references, counted over all its documents: the shares of character classes,
and the shares of its common words (at least COMMON of all words; all others are one bin). A document is compared with
its language's references by Jensen-Shannon distance, between 0 and 1; if its language is null, or has no common word,
with those of the nearest of the major languages, which have at least MAJOR of all words. Documents of fewer than LEAST
words are too short for the comparison and are judged by the base rules alone: fewer than 20 words, or more than 30 % of
words in 8-word windows that the text repeats, fail.

Common words are found exactly, in two scans. In the first, a partition names the words of at least COMMON / 2 of its
words of a language, with their counts; what it leaves out is less than half of COMMON, so a common word's named counts
add up to COMMON / 2 of all at least, and of each language 2 / COMMON words at most do. The second scan counts these. The
references of the major languages (1 / MAJOR of them at most) are broadcast; other languages, if there are any, are
counted and judged in blocks of some MINORS of them, chosen by hash, each block by scans of its own documents.

Null and empty texts have no words and fail the base rules; repeated rows are judged alike; an empty table gives no rows;
an empty lang counts as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, Words, bound_batches, bytes_hash, chunks, grams, materialize, text_or_empty

COMMON, LEAST, CHAR_LIMIT, WORD_LIMIT = 0.002, 60, 0.25, 0.4
#: Share of all words that makes a language a major one; languages of a block of the others, on average.
MAJOR, MINORS = 0.001, 500

#: Character classes by first byte: lower, upper, digit, blank, line break, sentence mark, symbol, non-ASCII, other; 255: not a first byte.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]], _CLASS[[*b".,;:!?'\"()-"]], _CLASS[[*b"#*$%&|<>@^~_=+/\\[]{}`"]] = 3, 4, 5, 6
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, 255
CLASSES = 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True


def summed(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of flags between edges, row by row."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def class_counts(texts: Texts) -> np.ndarray:
    kind = _CLASS[texts.data]
    return np.stack([summed(kind == c, texts.edges) for c in range(CLASSES)], 1)


def repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its key occur twice or more in its row, and is it a later one of them."""
    order = np.lexsort((np.arange(len(key)), key, row))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    later = np.zeros(len(key), bool)
    later[order] = same
    any_of = same.copy()
    any_of[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = any_of
    return out, later


def base_counts(texts: Texts, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    data, edges, n = texts.data, texts.edges, len(texts.data)
    inside = summed((data & 0xC0) != 0x80, np.stack([words.starts, words.ends], 1).ravel())[::2] if len(words) else np.zeros(0, np.int64)
    word_chars = summed(inside, words.edges)
    n_symbols = summed(_SYMBOL[data], edges)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([edges[:-1], breaks + 1]))
    starts = starts[starts < n]
    row = np.searchsorted(edges, starts, "right") - 1
    ends = np.minimum(edges[row + 1], np.append(breaks, n)[np.searchsorted(breaks, starts)])
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    _, later = repeated(row, bytes_hash(data, starts, ends))
    n_dup_lines = np.bincount(row[later], minlength=len(texts))
    at, found = grams(hashes, words.left(), 8)
    twice, _ = repeated(words.row[at], found)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    n_repeat_words = summed(np.cumsum(cover[:-1]) > 0, words.edges)
    return word_chars, n_symbols, n_dup_lines, n_repeat_words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of p from the distribution q; p may hold counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(part / 2, 0, 1)), 1.0)


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "kind", "key", "n"])


def _namer(common: float):
    def name(batches):
        seen: dict[str, list] = {}
        for batch in batches:
            for part in chunks(batch.column(0)):
                code, names = _languages(batch.column(1).slice(part.first, len(part)))
                words, kinds = Words(part, lower=True), class_counts(part)
                hashes, of = words.hashes(), code[words.row] if len(words) else words.row
                for c, lang in enumerate(names):
                    held = seen.setdefault(lang, [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(CLASSES, np.int64)])
                    mine = hashes[of == c]
                    values, n = np.unique(np.concatenate([held[0], mine]), return_inverse=True)
                    counts = np.bincount(n, np.concatenate([held[1], np.ones(len(mine), np.int64)]), len(values)).astype(np.int64)
                    seen[lang] = [values, counts, held[2] + kinds[code == c].sum(0)]
        for lang, (values, n, kinds) in seen.items():
            often = n >= common / 2 * n.sum()
            named = list(zip(values[often].view(np.int64).tolist(), n[often].tolist(), strict=True))
            yield _table([(lang, "all", 0, int(n.sum())), *((lang, "class", c, int(k)) for c, k in enumerate(kinds)), *((lang, "word", w, k) for w, k in named)])

    return name


def _counter(shared):
    def count(batches):
        candidates: dict[str, np.ndarray] = shared.value
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch.column(0)):
                code, names = _languages(batch.column(1).slice(part.first, len(part)))
                words = Words(part, lower=True)
                hashes, of = words.hashes(), code[words.row] if len(words) else words.row
                for c, lang in enumerate(names):
                    if lang in candidates:
                        known = candidates[lang]
                        held = totals.setdefault(lang, np.zeros(len(known) + 1, np.int64))
                        held += np.bincount(_bins(hashes[of == c], known), minlength=len(known) + 1)
        for lang, counts in totals.items():
            yield _table([(lang, "word", w, n) for w, n in zip(candidates[lang].view(np.int64).tolist(), counts[:-1].tolist(), strict=True)])

    return count


def _bins(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each hash's place in the sorted array known, len(known) for others."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, len(known)) if len(known) else np.zeros(len(hashes), np.int64)


References = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def named_words(rows: DataFrame, common: float) -> tuple[DataFrame, DataFrame]:
    """Of each language: lang, total (words) and classes (counts by class); and lang and word of those that may be common."""
    named = rows.filter("lang != ''").mapInArrow(_namer(common), "lang string, kind string, key long, n long")
    named = materialize(named.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "named-words")
    classes = F.map_from_entries(F.collect_list(F.when(F.col("kind") == "class", F.struct("key", "n"))))
    languages = named.filter("kind != 'word'").groupBy("lang").agg(F.sum(F.when(F.col("kind") == "all", F.col("n"))).alias("total"), classes.alias("classes"))
    words = named.filter("kind = 'word'").withColumnRenamed("key", "word").join(languages.select("lang", "total"), "lang")
    return languages, words.filter(F.col("n") >= common / 2 * F.col("total")).select("lang", "word")


def references(rows: DataFrame, languages: DataFrame, words: DataFrame, common: float) -> References:
    """Of each of the languages: shares of character classes, hashes of its common words, their shares (last: all other words).

    rows: text, lang; languages: bounded in number, rows of named_words."""
    found = {r["lang"]: (r["total"], r["classes"]) for r in languages.filter("total > 0").collect()}
    candidates: dict[str, list[int]] = {}
    for r in words.join(F.broadcast(languages.select("lang")), "lang", "left_semi").collect():
        candidates.setdefault(r["lang"], []).append(r["word"])
    shared = rows.sparkSession.sparkContext.broadcast({lang: np.sort(np.array(of, np.int64).view(np.uint64)) for lang, of in candidates.items()})
    counted = rows.mapInArrow(_counter(shared), "lang string, kind string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    often: dict[str, list[tuple[int, int]]] = {}
    for r in counted.collect():
        if r["n"] >= common * found[r["lang"]][0]:
            often.setdefault(r["lang"], []).append((r["key"] % 2**64, r["n"]))
    out: References = {}
    for lang, kept in often.items():
        total, classes = found[lang]
        kinds = np.array([classes.get(c, 0) for c in range(CLASSES)], float)
        hashes, n = (np.array(c, kind) for c, kind in zip(zip(*sorted(kept), strict=True), (np.uint64, np.int64), strict=True))
        out[lang] = (kinds / kinds.sum(), hashes, np.append(n, total - n.sum()) / total)
    return out


def _judge(shared, least: int):
    def judge(batches):
        known, major = shared.value
        for batch in batches:
            for part in chunks(batch.column(1)):
                code, names = _languages(batch.column(2).slice(part.first, len(part)))
                words, lowered = Words(part, lower=False), Words(part, lower=True)
                counts = base_counts(part, words, words.hashes())
                kinds, hashes = class_counts(part), lowered.hashes()
                far = np.ones((2, len(part)))
                for c, lang in enumerate(names):
                    mine = np.flatnonzero(code == c)
                    number = np.full(len(part), -1)
                    number[mine] = np.arange(len(mine))
                    of = number[lowered.row] if len(lowered) else lowered.row
                    for shares, common, word_shares in [known[lang]] if lang in known else major.values():
                        width = len(common) + 1
                        table = np.bincount(of[of >= 0] * width + _bins(hashes[of >= 0], common), minlength=len(mine) * width).reshape(len(mine), width)
                        found = np.stack([distance(kinds[mine].astype(float), shares), distance(table.astype(float), word_shares)])
                        nearer = found.sum(0) < far[:, mine].sum(0)
                        far[:, mine] = np.where(nearer, found, far[:, mine])
                if not major:
                    far[:, ~np.isin(code, [c for c, lang in enumerate(names) if lang in known])] = 0
                n = words.counts
                failed = (n < 20) | (100 * counts[3] > 30 * n)
                judged = n >= least
                kept = ~failed & (~judged | ((far[0] <= CHAR_LIMIT) & (far[1] <= WORD_LIMIT)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(n, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept), pa.array(far[0]), pa.array(far[1])], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

    return judge


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", common: float = COMMON, major: float = MAJOR, minors: int = MINORS) -> DataFrame:
    """Per row of docs: the base counts, base_failed, kept, and the distances of its character classes and words."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *(T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")), *(T.StructField(c, T.DoubleType()) for c in ("class_distance", "word_distance"))])
    languages, words = named_words(rows.select("text", "lang"), common)
    least = major * (languages.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] or 1)
    rest = languages.filter(F.col("total") < least)
    majors = references(rows.select("text", "lang"), languages.filter(F.col("total") >= least), words, common)
    count = rest.count()
    if not count:
        return rows.mapInArrow(_judge(spark.sparkContext.broadcast((majors, majors)), LEAST), schema)
    # Rows of the other languages, block by block; those of the major ones and of none first.
    of_rest = F.broadcast(rest.select("lang")) if count <= minors else rest.select("lang")
    out = rows.join(of_rest, "lang", "left_anti").select(*rows.columns).mapInArrow(_judge(spark.sparkContext.broadcast((majors, majors)), LEAST), schema)
    blocks = -(-count // minors)
    for b in range(blocks):
        block = rest.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b)
        mine = rows.join(F.broadcast(block.select("lang")), "lang", "left_semi").select(*rows.columns)
        known = references(mine.select("text", "lang"), block, words, common)
        out = out.unionByName(mine.mapInArrow(_judge(spark.sparkContext.broadcast((majors | known, majors)), LEAST), schema))
    return out


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
