"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels; at each level it draws
``-ln(u) / weight`` for every child, u being a hash of its key and the child's identity,
and takes the least draw. A child's draw depends on nothing but the key, the child and
its weight: changing one weight moves documents only into or out of that child's
subtree. ``Tree.base`` is the tree of the ``FOUNDED`` first shards; every later shard joins as a
region of its own, so that growth by one moves documents into the new shard only (the
``key`` law: the key and the number of shards decide). A cluster of fewer shards must name the number that it was
founded with, since a tree that was spread anew for every number would move documents between old shards.

Slots number a shard's documents without gaps from 0. They are ranks within (shard,
bucket), buckets being dealt by a hash of the row (so that null and repeated keys are spread), plus the running count of the buckets
before: no task sorts a whole shard.

Defined cases: a null key draws as its own key value (all null keys share a shard, but
have slots of their own); a null text has size 16 and the checksum of no bytes; repeated
rows get one slot each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.llm.shared import Scratch

ROW_BYTES = 16
FOUNDED = 40
BUCKET_ROWS = 20_000  # rows that one (shard, bucket) should hold


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry a shard number; inner nodes weigh what ``weight`` says, by default their leaves' sum."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float | None = None

    @property
    def weight(self) -> float:
        if self.own_weight is not None:
            return self.own_weight
        return sum(c.weight for c in self.children) if self.children else 1.0


@dataclass(frozen=True)
class Tree:
    regions: tuple[Node, ...] = field(default_factory=tuple)

    @staticmethod
    def base(shards: int, founded: int = FOUNDED, regions: int = 4, racks: int = 2) -> Tree:
        """``shards`` shards: the first ``founded`` spread over regions and racks, each later one a region of its own."""
        if not 1 <= founded <= shards:
            raise ValueError(f"{shards} shards can't have been founded with {founded}")
        per_region = math.ceil(founded / regions)
        per_rack = math.ceil(per_region / racks)
        made = []
        for r in range(regions):
            own = range(r * per_region, min((r + 1) * per_region, founded))
            racked = [
                Node(f"g{r}.k{k}", tuple(Node(f"s{i}", shard=i) for i in own if (i - own.start) // per_rack == k))
                for k in range(racks)
            ]
            racked = [k for k in racked if k.children]
            if racked:
                made.append(Node(f"g{r}", tuple(racked)))
        made += [Node(f"x{i}", (Node(f"x{i}.k0", (Node(f"s{i}", shard=i),)),)) for i in range(founded, shards)]
        return Tree(tuple(made))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u in (0, 1]; a subtree without weight never wins."""
    if node.weight <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + 1).cast("double") * F.lit(2.0**-53)
    return -F.log(u) / F.lit(node.weight)


def _descend(key: Column, children: tuple[Node, ...]) -> Column:
    """The shard that a key comes to below the given siblings."""
    if len(children) == 1:
        return F.lit(children[0].shard) if children[0].shard is not None else _descend(key, children[0].children)
    least = F.array_min(F.array(*(F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children))))["i"]
    if all(c.shard is not None for c in children):
        return F.element_at(F.array(*(F.lit(c.shard) for c in children)), least + 1)
    out = F.when(least == 0, _descend(key, children[0].children))
    for i, c in enumerate(children[1:], 1):
        out = out.when(least == i, _descend(key, c.children))
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of each key as an int column."""
    return _descend(key, tree.regions).cast("int")


def place(docs: DataFrame, shards: int = 40, founded: int = FOUNDED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard after growth by one, for every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), Tree.base(shards, founded)).alias("shard"),
        shard_of(F.col("doc_id"), Tree.base(shards + 1, founded)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = scratch.put(placed, "placed")
    rows = placed.count()
    buckets = max(1, math.ceil(rows / shards / BUCKET_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets)).cast("int"))
    running = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    )
    rank = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(rank)).join(before, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
