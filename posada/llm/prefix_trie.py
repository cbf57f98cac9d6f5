"""Prefix trie of conversations.

Every conversation is rebuilt first: the first h turns of the conversation that opens its family of ``FAMILY`` ids, then
its own turns after its first h. The trie's nodes are the distinct sequences of first d turns.

1. fingerprints: each turn is a hash of role and text times a power of an odd base; running sums of these (modulo
   2**64, numpy scans over sorted chunks of ``CHUNK`` turns) are polynomial rolling hashes of all prefixes. A prefix's fingerprint is a hash
   of the sum within its chunk and of that before the chunk, so the longest conversation is spread over many tasks;
2. candidates: conversations with one fingerprint at one depth, represented by the smallest id among them;
3. verification, turn by turn: at each depth a conversation's turn must equal its representative's (the same row of the table, or
   else equal role and text), and both must have the same node one turn before. If that holds at all depths, all prefixes are equal by
   induction. Groups in which it fails are split by node before, role and text, and verified again until nothing fails;
4. parent rollup: a node's representative one turn before names its parent. A node's subtree is what its members have from there on, so
   running sums along conversations replace a walk over the tree: words that a member has after a node, as far as it doesn't represent
   their nodes itself, are the words saved below it; members that represent a childless node are its leaves.

Hot first turns and conversations are split by ``spread_join``; sums are combined before they are shuffled. Member ids of a node's
ends are put together in chunks of ``ENDS`` successive ids; only where a node has several is their text streamed in order through one hash
(SHA-256 can't be taken in parts), in a task that holds one chunk at a time.

Defined cases: turns without a number come first, those of one number are ordered by a hash of role and text, equal ones count
each; a missing role or text is empty; rows without conv_id belong to no conversation and are left out; the opener of a
negative id is that of Spark's ``%``, which rounds to 0; texts count whole, whatever their length; further columns are ignored; an empty table gives an
empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.ranks import ranked
from posada.llm.shared import Scratch, ship, spread_join

FAMILY, MAX_HEAD = 20, 4  # ids of a family; heads have fewer turns than MAX_HEAD
CHUNK = 4_096
ENDS = 4_096
BASE = 0x9E3779B97F4A7C15 | 1


def head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MAX_HEAD


def opener(conv: Column) -> Column:
    return conv - conv % FAMILY


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, t, w, row, last) of the rebuilt conversations, d from 1, and conversations (c, size).

    ``turns``: conv_id, turn, t, w, row. ``last`` marks a conversation's last turn.
    """
    placed = scratch.put(ranked(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("t").asc(), F.col("row").asc()], scratch), "placed")
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = own.select(F.col("conv_id").alias("c"), opener(F.col("conv_id")).alias("o"), head(F.col("conv_id")).alias("h"), "n")
    givers = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("o"), F.col("n").alias("given"))
    convs = convs.join(givers, "o", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    convs = scratch.put(convs.withColumn("size", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    narrow = placed.select(F.col("conv_id").alias("c"), "i", "t", "w", "row")
    rest = spread_join(narrow, convs.select("c", "h", "given", "size"), "c", convs.select("c", "n"), F.col("i")).where("i >= h")
    rest = rest.withColumn("d", F.col("given") + F.col("i") - F.col("h") + 1)
    # an opener lends its first turns to its own family only, so no key here is frequent
    lent = narrow.where((F.col("c") % FAMILY == 0) & (F.col("i") < MAX_HEAD - 1)).withColumnRenamed("c", "o").join(convs.drop("n"), "o").where("i < given").withColumn("d", F.col("i") + 1)
    columns = ["c", "d", "t", "w", "row", (F.col("d") == F.col("size")).alias("last")]
    return rest.select(*columns).unionByName(lent.select(*columns)), convs.select("c", "size")


def _powers(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, modulo 2**64."""
    out, square, rest = np.ones(len(exponents), np.uint64), np.uint64(BASE), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while rest.any():
            odd = (rest & np.uint64(1)).astype(bool)
            out[odd] *= square
            square = square * square
            rest >>= np.uint64(1)
    return out


def _running(values: np.ndarray, first: np.ndarray, carried: int) -> np.ndarray:
    """Running sums that start anew at each flagged row; the rows before the first flag go on from ``carried``."""
    total = np.cumsum(values)
    heads = np.flatnonzero(first)
    before = total - values
    base = np.zeros(len(values), values.dtype)
    if len(heads):
        base[heads] = before[heads]
        base = base[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        base[: heads[0]] = 0
    total = total - base
    total[: heads[0] if len(heads) else len(total)] += values.dtype.type(carried)
    return total


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (c, chunk, d), with the sums of their chunk up to them: ``f`` of the polynomial and ``s`` of the words."""
    at, f, s = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c, chunk, d = (batch.column(k).to_numpy() for k in ("c", "chunk", "d"))
        first = np.ones(len(c), bool)
        first[1:] = (c[1:] != c[:-1]) | (chunk[1:] != chunk[:-1])
        first[0] = (c[0], chunk[0]) != at
        sums = _running(tk.mix(batch.column("t").to_numpy().view(np.uint64).copy()) * _powers(d), first, f)
        words = _running(batch.column("w").to_numpy().astype(np.int64), first, s)
        at, f, s = (c[-1], chunk[-1]), int(sums[-1]), int(words[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("c", "chunk", "d", "w", "row", "last")), pa.array(tk.signed(sums)), pa.array(words)], ["c", "chunk", "d", "w", "row", "last", "f", "s"])


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (c, chunk), with the sums of the chunks before in place of their own."""
    at, f, s = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        first = np.concatenate(([c[0] != at], c[1:] != c[:-1]))
        own_f, own_s = batch.column("f").to_numpy().view(np.uint64), batch.column("s").to_numpy()
        sums, words = _running(own_f, first, f), _running(own_s, first, s)
        at, f, s = c[-1], int(sums[-1]), int(words[-1])
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("chunk"), pa.array(tk.signed(sums - own_f)), pa.array(words - own_s)], ["c", "chunk", "f0", "s0"])


def fingerprints(turns: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """(c, d, w, row, last, f, s): the fingerprint of every prefix, of so many bits, and its words up to its last turn."""
    dealt = turns.withColumn("chunk", F.floor(F.col("d") / CHUNK)).repartition("c", "chunk").sortWithinPartitions("c", "chunk", "d")
    scanned = scratch.put(dealt.mapInArrow(_scan, "c long, chunk long, d long, w long, row long, last boolean, f long, s long"), "scanned")
    # of conversations of several chunks, and one row for each of these
    ends = scanned.where(((F.col("d") + 1) % CHUNK == 0) | F.col("last")).select("c", "chunk", "f", "s")
    before = ends.repartition("c").sortWithinPartitions("c", "chunk").mapInArrow(_offsets, "c long, chunk long, f0 long, s0 long").where("chunk > 0")
    joined = spread_join(scanned, before, ["c", "chunk"], scanned.groupBy("c", "chunk").agg(F.count("*").alias("n")), F.col("d"), "left")
    whole = F.xxhash64(F.coalesce("f0", F.lit(0)), "f").bitwiseAND(F.lit(-1 if bits == 64 else (1 << bits) - 1))
    return joined.select("c", "d", "w", "row", "last", whole.alias("f"), (F.col("s") + F.coalesce("s0", F.lit(0))).alias("s"))


def _failing(named: DataFrame, texts: DataFrame, root: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``named`` with ``up``, the name of the node one turn before, and the names (d, name) of groups in which a member differs from its representative."""
    above = named.select("c", (F.col("d") + 1).alias("d"), F.col("name").alias("up"))
    own = scratch.put(named.drop("up").join(above, ["c", "d"], "left").withColumn("up", F.coalesce("up", F.lit(root))), "named")
    first = own.where("name = c").select("d", "name", F.col("row").alias("row1"), F.col("up").alias("up1"))
    others = own.where("name <> c").select("c", "d", "name", "row", "up")
    met = spread_join(others, first, ["d", "name"], others.groupBy("d", "name").agg(F.count("*").alias("n")), F.col("c")).where("row <> row1 OR up <> up1")
    met = scratch.put(met, "compared")
    # each pair of rows of the table is compared once; the frequent ones are those of representatives
    pairs = scratch.put(met.where("row <> row1").select("row", "row1").distinct(), "pairs")
    left = pairs.join(texts.select("row", "role", "text"), "row")
    right = texts.join(pairs.select(F.col("row1").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("row1"), F.col("role").alias("role1"), F.col("text").alias("text1"))
    unlike = spread_join(left, right, "row1", pairs.groupBy("row1").agg(F.count("*").alias("n")), F.col("row")).where("role <> role1 OR text <> text1").select("row", "row1", F.lit(True).alias("unlike"))
    unlike = scratch.put(unlike, "unlike")
    wrong = met.where("up <> up1").select("d", "name")
    if not unlike.isEmpty():
        wrong = wrong.unionByName(met.join(unlike, ["row", "row1"]).select("d", "name"))
    return own, scratch.put(wrong.distinct(), "failing")


def verified(prefixes: DataFrame, texts: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(c, d, w, row, last, s, name, up): of every prefix the smallest conversation that has it, and that of the prefix one turn shorter."""
    sizes = scratch.put(prefixes.groupBy("d", "f").agg(F.min("c").alias("name"), F.count("*").alias("n")), "sizes")
    named = spread_join(prefixes, sizes.drop("n"), ["d", "f"], sizes.select("d", "f", "n"), F.col("c")).drop("f")
    while True:
        named, failing = _failing(named, texts, root, scratch)
        if failing.isEmpty():
            return named
        # collisions are few: only their groups are split
        keys = ["d", "name", "up", "role", "text"]
        split = named.join(failing, ["d", "name"], "left_semi").join(texts.select("row", "role", "text"), "row")
        better = split.groupBy(*keys).agg(F.min("c").alias("better"), F.count("*").alias("n"))
        met = spread_join(split, better.drop("n"), keys, better.select(*keys, "n"), F.col("c")).withColumn("name", F.col("better")).select(*named.columns)
        named = scratch.put(named.join(failing, ["d", "name"], "left_anti").select(*named.columns).unionByName(met), "split")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each (d, name) of chunks of ids in order."""
    at, made = None, None
    for batch in batches:
        for d, name, ids in zip(batch.column("d").to_pylist(), batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if (d, name) == at:
                made.update(b"," + ids.encode())
                continue
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([made.hexdigest()])], ["d", "name", "ends"])
            at, made = (d, name), hashlib.sha256(ids.encode())
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([made.hexdigest()])], ["d", "name", "ends"])


def _ends(named: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, name, ends): the SHA-256 of the ids of the conversations that end at a node."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    chunks = scratch.put(named.where("last").groupBy("d", "name", F.floor(F.col("c") / ENDS).alias("chunk")).agg(ids.alias("ids")), "ends")
    several = scratch.put(chunks.groupBy("d", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    long_ones = chunks.join(several, ["d", "name"], "left_semi").repartition("d", "name").sortWithinPartitions("d", "name", "chunk").select("d", "name", "ids")
    one = chunks.join(several, ["d", "name"], "left_anti").select("d", "name", F.sha2("ids", 256).alias("ends"))
    return one.unionByName(long_ones.mapInArrow(_streamed, "d long, name long, ends string"))


def rolled_up(named: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes' figures from every conversation's prefixes, the empty one (d = 0) included."""
    sizes = scratch.put(named.groupBy("d", "name").agg(F.count("*").alias("n_convs"), F.count(F.when(F.col("last"), 1)).alias("n_ends"), F.max(F.when(F.col("name") == F.col("c"), F.col("up"))).alias("up")), "nodes")
    leaves = sizes.where("n_convs = n_ends").select(F.col("name").alias("c"), F.lit(1).cast("long").alias("leaf"))
    # words up to the last turn that a conversation doesn't represent itself; what it represents are its last turns
    shared = named.groupBy("c").agg(F.coalesce(F.max(F.when(F.col("name") != F.col("c"), F.col("s"))), F.lit(0)).alias("until"), F.count("*").alias("n"))
    per = scratch.put(shared.join(leaves, "c", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "members")
    met = spread_join(named.select("c", "d", "name", "s", "w"), per.drop("n"), "c", per.select("c", "n"), F.col("d"))
    sums = met.groupBy("d", "name").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("until") - F.col("s") + F.col("w"), F.lit(0))).alias("saved_tokens"))
    children = sizes.where("up IS NOT NULL").groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    joined = sizes.join(sums, ["d", "name"]).join(children, ["d", "name"], "left").join(_ends(named, scratch), ["d", "name"], "left")
    return joined.select(
        F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations. ``bits`` of fingerprints decide speed only."""
    ship(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "trie")
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("role", "text"))
    texts = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    texts = scratch.put(texts.withColumn("t", F.xxhash64("role", "text")).withColumn("w", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), "turns")
    turns, convs = rebuilt(texts.select("conv_id", "turn", "t", "w", "row"), scratch)
    root = convs.agg(F.min("c")).first()[0]
    named = verified(scratch.put(fingerprints(turns, scratch, bits), "prefixes"), texts, root if root is not None else 0, scratch)
    empty = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("w"), F.lit(None).cast("long").alias("row"), (F.col("size") == 0).alias("last"), F.lit(0).cast("long").alias("s"), F.lit(root).cast("long").alias("name"), F.lit(None).cast("long").alias("up"))
    return rolled_up(scratch.put(named.unionByName(empty), "whole"), scratch)
