"""Merkle manifest of a dataset: a root, and a proof for each document.

H is the lowercase hex SHA-256 of its inputs put together. A document's leaf is H of its columns, each as its number
of UTF-8 bytes, a colon and the value (``-`` for null). The leaves of a source ascend by id; every ``FAN`` successive
nodes become their H until one, the subroot, is left; subroots in order of their sources become the root in the same way.

Blocks of ``FAN ** DEPTH`` nodes are collapsed as arrays by higher-order functions (``sequence``, ``slice``,
``transform``, and ``aggregate`` over the levels), so a block is one row of bounded size; the blocks' roots are the next
tier's nodes, and so on until each source has one. Paths (what stands left and right of a node at each level) are then handed down from
the root by tiers, and a document's proof and its refolded root are made inside its block, so that no row holds more than
a block and no group of a source is gathered.

Defined cases: an empty or missing source is a group of its own; null ids come first; rows that share source and id are
ordered by their leaves; repeated rows are leaves one by one; a document alone in the dataset is the root itself, and its
proof is H of nothing; texts count whole, whatever their length; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.llm.ranks import ranked
from posada.llm.shared import Scratch

FAN, DEPTH = 16, 3
BLOCK = FAN**DEPTH
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its byte count, a colon and itself; ``-`` for null."""
    printed = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(printed).cast("string"), F.lit(":"), printed), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(F.concat(*(field(c) for c in columns)))


def lowered(text: Column) -> Column:
    """A-Z as a-z."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(nodes: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(nodes, start, size), "")


def collapse(nodes: Column, levels: Column) -> Column:
    """The array of levels above an array of nodes, itself first: each has the H of every FAN successive nodes of the one below."""

    def above(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / FAN).cast("int") - 1)
        return F.transform(runs, lambda run: digest(_joined(below, run * FAN + 1, F.lit(FAN))))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), levels), F.array(nodes), lambda made, _: F.concat(made, F.array(above(F.element_at(made, -1)))))


def path(levels: Column, depth: Column, place: Column) -> Column:
    """What stands left and right of the node at ``place`` (from 0) in its run, at each of the ``depth`` lower levels of a block."""

    def beside(level: Column) -> Column:
        at = F.call_function("shiftright", place, level * 4)
        within = at % FAN
        nodes = F.element_at(levels, level + 1)
        return F.struct(_joined(nodes, at - within + 1, within).alias("l"), _joined(nodes, at + 2, FAN - 1 - within).alias("r"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.lit(1), depth), beside)


def fold(node: Column, steps: Column) -> Column:
    """The root that a node leads to along its path."""
    return F.aggregate(steps, node, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def proof(steps: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def _blocks(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks (g, b) of nodes (g, i, n, own), n being the group's number of nodes: their nodes in order, the levels above, and the block's root."""
    depth = F.lit(0)
    for k in range(1, DEPTH + 1):
        depth = F.when(F.col("n") > FAN ** (k - 1), k).otherwise(depth)
    packed = nodes.groupBy("g", F.floor(F.col("i") / BLOCK).alias("b")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "own"))).alias("own"))
    packed = packed.select("g", "b", "n", F.transform("own", lambda x: x["own"]).alias("own"), depth.alias("depth"))
    made = packed.withColumn("levels", collapse(F.transform("own", lambda x: x["node"]), F.col("depth")))
    return scratch.put(made.withColumn("root", F.element_at(F.element_at("levels", -1), 1)), "blocks")


def _tree(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks of nodes (g, i, n, own), and (g, root) of every group."""
    tiers = [_blocks(nodes, scratch)]
    roots = tiers[0].where(F.col("n") <= BLOCK).select("g", "root")
    while True:
        rest = tiers[-1].where(F.col("n") > BLOCK)
        if rest.isEmpty():
            return tiers, roots
        up = rest.select("g", F.col("b").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), F.struct(F.col("root").alias("node")).alias("own"))
        tiers.append(_blocks(up, scratch))
        roots = roots.unionByName(tiers[-1].where(F.col("n") <= BLOCK).select("g", "root"))


def _handed_down(tiers: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """The lowest blocks with ``steps``, the path from the block's root to the whole tree's, and further columns of ``tops`` (g, steps, ...).

    A group's top block takes the group's own path; each block below takes that of its node in the tier above.
    """
    passed = None
    for k, blocks in reversed(list(enumerate(tiers))):
        met = blocks.where(F.col("n") <= BLOCK).join(tops, "g")
        if passed is not None:
            met = met.unionByName(blocks.where(F.col("n") > BLOCK).join(passed, ["g", "b"]))
        if k == 0:
            return met
        own = [c for c in tops.columns if c not in ("g", "steps")]
        below = met.select("g", F.col("b").alias("up"), "levels", "depth", "steps", *own, F.explode(F.sequence(F.lit(0), F.size("own") - 1)).alias("x"))
        passed = scratch.put(below.select("g", (F.col("up") * BLOCK + F.col("x")).alias("b"), F.concat(path(F.col("levels"), F.col("depth"), F.col("x")), "steps").alias("steps"), *own), "paths")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and the root refolded after a test of tampering: folded_root, verified.

    Where 5 divides the crc32 of the id as text, the leaf of the document with A-Z lower-cased is folded in place of its own.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    own = [F.col(c) for c in COLUMNS]
    changed = leaf([*own[:-1], lowered(F.col("text"))])
    leaves = docs.select(*COLUMNS).select(
        # a null source comes before all others
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("g"), "doc_id", leaf(own).alias("node"),
        F.when(tampered & F.col("text").rlike("[A-Z]"), changed).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = scratch.put(leaves, "leaves")
    sizes = leaves.groupBy("g").agg(F.count("*").alias("n"))
    placed = ranked(leaves, "g", [F.col("doc_id").asc(), F.col("node").asc(), F.col("row").asc()], scratch).drop("row").join(sizes, "g")
    tiers, roots = _tree(placed.select("g", "i", "n", F.struct("node", "doc_id", "other").alias("own")), scratch)
    # the sources' subroots are one more group of nodes
    subroots = scratch.put(roots.select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("root").alias("node")), "subroots")
    n = subroots.count()
    ordered = ranked(subroots, "g", [F.col("source").asc()], scratch)
    top_tiers, top = _tree(ordered.select("g", "i", F.lit(n).cast("long").alias("n"), F.struct("node", "source").alias("own")), scratch)
    no_steps = F.from_json(F.lit("[]"), "array<struct<l string, r string>>")
    handed = _handed_down(top_tiers, top.select("g", no_steps.alias("steps"), F.col("root").alias("whole")), scratch)
    by_source = handed.select(F.explode(F.transform("own", lambda x, k: F.struct(x["source"].alias("g"), x["node"].alias("subroot"), F.concat(path(F.col("levels"), F.col("depth"), k), "steps").alias("steps")))).alias("s"), "whole")
    by_source = scratch.put(by_source.select("s.*", "whole"), "sources")
    blocks = scratch.put(_handed_down(tiers, by_source, scratch), "handed")

    def row(x: Column, k: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), F.coalesce(x["other"], x["node"]).alias("shown"), F.concat(path(F.col("levels"), F.col("depth"), k), F.col("steps")).alias("steps"))

    rows = blocks.select("subroot", "whole", F.explode(F.transform("own", row)).alias("d"))
    folded = rows.select("d.doc_id", "d.leaf", "subroot", F.col("whole").alias("root"), proof(F.col("d.steps")).alias("proof_sha256"), fold(F.col("d.shown"), F.col("d.steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
