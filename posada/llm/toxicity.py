"""Toxicity by FTRL-proximal logistic regression over hashed word features.

A document's features are the distinct hashes of its words, its word pairs and its
skip-grams (two words with one between), of the whole text, A-Z taken as a-z. The model
is fitted by FTRL-proximal: each coordinate has a learning rate that falls with the
squares of its own gradients, and an L1 penalty keeps coordinates at exactly zero until
they earn their weight (features of fewer than ``MIN_SEEN`` sampled documents never do). What is left is a short list of (index, weight), bounded by
``BUCKETS``, which every scoring task gets.

The fit reads at most ``SAMPLE_ROWS`` labelled documents, those with the least hash of
their id, half of them of either label as far as there are, one text of each id and none of more than ``SAMPLE_TEXT_BYTES``; all else covers every row.

Defined cases: a row without an id is in no fold, so not held out, and teaches nothing; a null or empty text has no features and scores the intercept; labels
without a matching document, or null labels, teach nothing; several labels of one document
count as their largest; without any label the score is the prior (0.1); repeated
rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import freeing, ship

BUCKETS = 1 << 20
SAMPLE_ROWS = 12_000
SAMPLE_TEXT_BYTES = 1 << 20  # longer texts teach nothing (all are scored, whole)
EPOCHS = 4
MIN_SEEN = 3  # sampled documents that a feature must stand in to be learned
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0
FOLDS, HELD_OUT_FOLD = 5, 0


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def features(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every word, word pair and skip-gram; repeats are not removed here."""
    w = tk.words(block, lower=True)
    n = len(w.hash)
    rows, values = [w.row], [w.hash]
    for gap, salt in ((1, 0x5BD1E995), (2, 0x1B873593)):
        if n > gap:
            same = w.row[gap:] == w.row[:-gap]
            pair = tk.mix(w.hash[:-gap] * np.uint64(3) + w.hash[gap:] + np.uint64(salt))
            rows.append(w.row[gap:][same])
            values.append(pair[same])
    return np.concatenate(rows), (np.concatenate(values) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal over hashed binary features, with an unpenalised intercept at the last coordinate."""

    def __init__(self, size: int = BUCKETS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample: (index, weight) rows, the intercept at index BUCKETS."""
    seen: list[tuple[int, int, np.ndarray]] = []
    for batch in batches:
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
        for block in tk.blocks(batch.column("text")):
            index, at = tk.sorted_sets(*features(block), block.rows)
            for r in range(block.rows):
                k = block.first_row + r
                seen.append((ids[k], labels[k], index[at[r] : at[r + 1]].astype(np.int32)))
    if not seen:
        return
    seen.sort(key=lambda x: x[0])
    often = np.bincount(np.concatenate([x for _, _, x in seen]), minlength=BUCKETS) >= MIN_SEEN
    seen = [(k, label, np.append(x[often[x]], BUCKETS)) for k, label, x in seen]
    model, order = Ftrl(), np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in order.permutation(len(seen)):
            model.learn(seen[k][2], seen[k][1])
    at = np.append(np.flatnonzero(model.weights(np.arange(BUCKETS))), BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(model.weights(at))], ["index", "weight"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[int, float]:
    """Weights by index, learned from the labelled documents outside the held-out fold."""
    ship(docs.sparkSession)
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(sample_rows // 2).select("doc_id", "toxic")
        picked = some if picked is None else picked.unionByName(some)
    # at most sample_rows rows of two numbers, so the broadcast is bounded
    sample = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES).join(F.broadcast(picked), "doc_id")
    # of an id's texts the one with the least hash, so repeated ids don't add to the sample
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sample.repartition(1).mapInArrow(freeing(train), "index long, weight double").collect()
    return {r["index"]: r["weight"] for r in found} or {BUCKETS: float(np.log(0.1 / 0.9))}


def _scores(block: tk.Block, table: np.ndarray, live: np.ndarray) -> np.ndarray:
    rows, at = features(block)
    hit = live[at]
    at, offsets = tk.sorted_sets(rows[hit], at[hit], block.rows)
    total = np.concatenate(([0.0], np.cumsum(table[at])))
    value = table[BUCKETS] + total[offsets[1:]] - total[offsets[:-1]]
    return 1 / (1 + np.exp(-np.clip(value, -35, 35)))


def _table(packed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    table = np.zeros(BUCKETS + 1)
    table[packed[0]] = packed[1]
    return table, table[:BUCKETS] != 0


def _share(docs: DataFrame, weights: dict[int, float]):
    return docs.sparkSession.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()), np.float64)))


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """doc_id, score and predicted for every document."""
    ship(docs.sparkSession)
    packed = _share(docs, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, live = _table(packed.value)
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                p = _scores(block, table, live)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first_row, block.rows), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The documents, all columns, that aren't predicted to be toxic."""
    ship(docs.sparkSession)
    packed = _share(docs, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, live = _table(packed.value)
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                yield batch.slice(block.first_row, block.rows).filter(pa.array(_scores(block, table, live) < 0.5))

    return docs.mapInArrow(freeing(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "score", "predicted"
    )
