"""Connected components by alternating large-star and small-star steps on edge tables.

Each step points nodes at the least node of their neighbourhood; when nothing changes,
the edges are stars whose centres are the least nodes of their components. Minima are
grouped with map-side combining and joined back by ``spread_join``, which splits the edges of a hub, so that they are never
gathered in one task. Nothing but counts and a checksum comes to the driver.

A graph of ``SMALL`` edges at most is a few MB and is solved by union-find in one task, which
saves the rounds; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.llm.shared import Scratch, spread_join

SMALL = 300_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels spread along edges, with pointer jumping, until nothing changes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (jumped := after[after]).tolist() != after.tolist():
            after = jumped
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges as (a, b) with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _minima(edges: DataFrame, node: str, other: str, scratch: Scratch) -> DataFrame:
    """(node, m, n): each node's least neighbour and the number of its edges."""
    return scratch.put(edges.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("n")), "minima")


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minima(both, "a", "b", scratch)
    met = spread_join(both, least.select("a", F.least("a", "m").alias("m")), "a", least.select("a", "n"), F.col("b"))
    return _ordered(met.where("b > a").select(F.col("m").alias("a"), "b"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = _minima(edges, "b", "a", scratch)
    moved = spread_join(edges, least.select("b", "m"), "b", least.select("b", "n"), F.col("a")).select("m", F.explode(F.array("a", "b")).alias("v"))
    return _ordered(moved.select(F.col("m").alias("a"), F.col("v").alias("b")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b), the component being its least node."""
    now = scratch.put(_ordered(edges), "edges")
    if now.count() <= SMALL:
        return scratch.put(now.coalesce(1).mapInArrow(_union_find, "node long, component long"), "components")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == mark:
            break
        mark = seen
        large = scratch.put(_large_star(now, scratch), "edges")
        after = scratch.put(_small_star(large, scratch), "edges")
        scratch.drop(now, large)
        now = after
    centres = now.select(F.col("a").alias("node")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
