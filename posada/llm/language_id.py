"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text's code points are lower-cased; everything that isn't a letter counts as a space,
and windows of one to ``ORDER`` characters that hold a letter are hashed into
``BUCKETS``. Training counts windows by language on a bounded, stratified sample of the
labelled documents, and Spark sums them; the log-probability matrix (languages x buckets) is
broadcast as what seen windows add to unseen ones, and each document's sparse counts are multiplied with it in numpy, for ``WIDTH`` languages at once.
All languages of the sample are learned, however many; copies in it count once.

Defined cases: a row without an id is in no fold, so not held out, and teaches nothing; a null text, or one without a letter, is ``und`` with score 0; languages
are those of the sample, a single one always wins; without any label all is ``und``;
ties go to the first language in alphabetical order; repeated rows are scored one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import few, freeing, ship

BUCKETS = 1 << 16
ORDER = 3
SAMPLE_PER_LANGUAGE = 2_000  # expected rows of each language in the training sample
SAMPLE_ROWS = 200_000  # of all languages together, which share it evenly where there are very many
WIDTH = 64  # languages whose matrix a task holds
SMOOTHING = 0.1
FOLDS, HELD_OUT_FOLD = 3, 1


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the basic plane: whether each code point is a letter, and what it counts as."""
    chars = [chr(i) for i in range(0x10000)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    return letter, np.where(letter, lower, 0x20).astype(np.uint32)


_cache: list[tuple[np.ndarray, np.ndarray]] = []


def characters(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of a block, whether each is a letter, and each one's row."""
    if not _cache:
        _cache.append(_tables())
    letter, normal = _cache[0]
    code = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((block.data & 0xC0) != 0x80)
    if len(heads) == len(code):
        row = block.row_of(heads)
    else:  # bytes that are no UTF-8
        parts = [block.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(block.offsets[:-1], block.offsets[1:])]
        code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(block.rows), [len(x) for x in parts])
    basic = np.minimum(code, 0xFFFF)
    is_letter, out = letter[basic], normal[basic]
    for k in np.flatnonzero(code > 0xFFFF):
        is_letter[k] = chr(code[k]).isalpha()
        out[k] = code[k] if is_letter[k] else 0x20
    return out, is_letter, row


def grams(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every window with a letter, and which rows have a letter."""
    code, letter, row = characters(block)
    has = np.zeros(block.rows, bool)
    has[row[letter]] = True
    rows, buckets = [], []
    value, any_letter = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
    for k in range(ORDER):
        n = len(code) - k
        if n <= 0:
            break
        value = tk.mix(value[:n] * np.uint64(31) + code[k:].astype(np.uint64) + np.uint64(k + 1))
        any_letter = any_letter[:n] | letter[k:]
        keep = any_letter & (row[:n] == row[k:])
        rows.append(row[:n][keep])
        buckets.append((value[keep] & np.uint64(BUCKETS - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(rows), np.concatenate(buckets), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of each batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        names, code = np.unique(langs.astype(str), return_inverse=True)
        found = [np.zeros(0, np.int64)]
        for block in tk.blocks(batch.column("text")):
            rows, buckets, _ = grams(block)
            found.append(code[block.first_row + rows] * BUCKETS + buckets)
        key, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS], pa.string()), pa.array(key % BUCKETS), pa.array(n.astype(np.int64))], ["lang", "bucket", "n"])


@dataclass
class Model:
    """Languages in order, each one's log-probability of an unseen window, and what seen ones add to it, by (bucket, language)."""

    langs: list[str]
    unseen: np.ndarray
    bucket: np.ndarray
    lang: np.ndarray
    more: np.ndarray

    def matrix(self, first: int) -> np.ndarray:
        """The log-probabilities of WIDTH languages, a row for each bucket."""
        own = slice(*np.searchsorted(self.lang, (first, first + WIDTH)))
        out = np.tile(self.unseen[first : first + WIDTH], (BUCKETS, 1))
        out[self.bucket[own], self.lang[own] - first] += self.more[own]
        return out


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Model:
    """The model, from documents outside the held-out fold; counts are summed by Spark, and of each language its seen buckets come to the driver."""
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD)
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.least(F.lit(per_language), F.floor(F.lit(rows) / F.greatest(F.lit(1), F.lit(sizes.count())))) / F.col("size")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 11).cast("double") * F.lit(2.0**-53)
    sample = known.join(few(sizes.withColumn("share", share).drop("size")), "lang").where(draw < F.col("share")).select("lang", "text").distinct()
    counted = sample.mapInArrow(freeing(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counted["lang"]))
    at = counted["lang"].map({name: k for k, name in enumerate(langs)}).to_numpy(np.int64)
    n, bucket = counted["n"].to_numpy(np.float64), counted["bucket"].to_numpy(np.int64)
    total = np.log(np.bincount(at, weights=n, minlength=len(langs)) + SMOOTHING * BUCKETS)
    order = np.lexsort((bucket, at))
    more = (np.log(n + SMOOTHING) - np.log(SMOOTHING)).astype(np.float32)
    return Model(langs, (np.log(SMOOTHING) - total).astype(np.float32), bucket[order].astype(np.int32), at[order].astype(np.int32), more[order])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the winner's posterior) for every document; WIDTH languages are scored at once."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size, held = len(known.langs), {}
        names = np.array([*known.langs, "und"], object)
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                rows, buckets, has = grams(block)
                total = np.zeros((block.rows, size))
                for first in range(0, size, WIDTH):
                    if first not in held:
                        held = {first: known.matrix(first)}  # one at a time, so a few languages' stays
                    part = held[first]
                    for k in range(part.shape[1]):
                        total[:, first + k] = np.bincount(rows, weights=part[buckets, k], minlength=block.rows)
                if size:
                    best, score = total.argmax(1), 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
                else:
                    best, score, has = np.zeros(block.rows, np.int64), np.zeros(block.rows), np.zeros(block.rows, bool)
                best = np.where(has, best, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first_row, block.rows), pa.array(names[best], pa.string()),
                        pa.array(np.where(has, score, 0.0)),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score")
