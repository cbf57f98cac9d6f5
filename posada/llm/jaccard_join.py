"""N-gram Jaccard self-join, exact, by pivots, Voronoi cells and triangle-inequality windows.

Documents are sets of 5-word shingles in the metric space of the Jaccard distance d; two
link at d <= r = 1/4. Equal sets collapse to one representative (a class) before all else.

Cells around pivots can't split a whole corpus: nearly
all pairs of documents stand at distance exactly 1, so every window would hold every document. Space is therefore
first dealt into regions by shingles, each region being
the set of documents that have its shingle among the first ``n // 4 + 1`` of their own in
one global order: that is the least replication by which two linked documents are sure
to meet. The order puts shingles last that FREQUENT documents or more have, counted over
all documents; any order gives the same links, this one keeps common passages from making
regions. Then, for the components:

1. first pivots: each document is compared with the least document that shares its least
   shingle in one of HEADS random orders; distances are exact (but for pairs whose sizes or parity sketches exclude a
   link), and those within r link. Large groups of near copies become components here;
2. members of one component need no comparison for this, so only regions in which several
   components meet go on. They recurse: members outside the region's largest component become
   pivots (64 at once, then four times as many in each round), and are compared with those members
   of other components whose distance to a common first pivot differs from their own by
   r at most (the triangle inequality excludes all others);
3. the recursion ends when no region holds two components with an unused pivot.

So every linked pair of different sets is either compared or already connected, and all links lie within components. For the links
themselves each component is a space of its own:

4. a component of more than CELL members gets pivots, and each member the exact distances to them. Its home is the Voronoi cell
   of its nearest pivot p; it is replicated to each further cell q with d(x, q) <= d(x, p) + 2 r, where by
   the triangle inequality all its links' homes are. Cells that are still large recurse with pivots from their home members, as
   long as that shrinks them; one whose members would each be in more than ``REPLICAS`` parts stays whole;
5. each cell's members are dealt into blocks of bounded size, and blocks are compared pair by pair with exact
   intersections: home with home for both, home with replica for the home's side only, so that each link counts once at either end.
   Blocks give counts, not pairs. A cell of one block sends each set out once; of K blocks, at most K + 1 times (a block
   holds about BLOCK_SHINGLES shingles, so that is once more for each further half million of a cell that pivots can't split).

Shingles are hashes of 52 bits.

Defined cases: null and empty texts have no shingle, n_shingles 0 and a component of their
own; fewer than 5 words make one shingle of the whole sequence; rows that share a
doc_id count as one document; a null doc_id gives a null component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.components import components
from posada.llm.shared import Scratch, few, freeing, ship, spread_join

WORDS = 5
FREQUENT = 8  # documents from which on a shingle stands last in the global order; decides speed only
MAX_FREQUENT = 1 << 20  # bound of the broadcast list, 8 MB
SKETCH = 1024  # bits
FIRST_PIVOTS, MORE_PIVOTS = 64, 4
HEADS = 4  # random orders by which documents find their first pivots
CELL = 256  # members up to which a cell isn't split
PIVOTS = 16  # of a cell that is, at most
LEVELS = 4
REPLICAS = 2  # cells that each member would be in on average, up to which a cell is split
BLOCK, BLOCK_SHINGLES = 2_048, 524_288  # members of a block and shingles of all of them, about: 4 MB
TILE, TILE_SHINGLES = 128, 16_384  # the same of the parts of blocks that are compared at once
COLUMNS = 8_192  # shingles that one matrix of a block has


def shingle_sets(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, as 52-bit hashes in ascending order, end to end, and their offsets."""
    w = tk.words(block, lower=True)
    value, first = tk.windows(w, WORDS)
    rows, values = [w.row[first]], [value]
    count = tk.word_counts(block, w)
    if ((count > 0) & (count < WORDS)).any():
        for size in range(1, WORDS):
            value, first = tk.windows(w, size)
            whole = count[w.row[first]] == size
            rows.append(w.row[first][whole])
            values.append(value[whole])
    return tk.packed_sets(np.concatenate(rows), np.concatenate(values), block.rows)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tk.signed(np.ascontiguousarray(values))))


def _first(values: np.ndarray, at: np.ndarray, take: np.ndarray) -> pa.ListArray:
    """The first ``take`` values of each row."""
    row = np.repeat(np.arange(len(take)), np.diff(at))
    return _lists(values[(np.arange(len(values)) - at[:-1][row]) < take[row]], np.concatenate(([0], np.cumsum(take))))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tk.blocks(batch.column("text")):
            values, at = shingle_sets(block)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([_first(values, at, np.where(n > 0, 2 * n // 5 + 1, 0))], ["s"])


def frequent_shingles(docs: DataFrame, scratch: Scratch) -> np.ndarray:
    """Shingles that FREQUENT documents or more have among the first two fifths of their hash order, over all documents, ascending.

    If there are more than MAX_FREQUENT, the least count that is asked for rises until they fit.
    """
    counts = docs.select("text").mapInArrow(freeing(_heads), "s array<long>").select(F.explode("s").alias("s")).groupBy("s").count()
    counts = scratch.put(counts.where(F.col("count") >= FREQUENT), "frequent")
    least = FREQUENT
    if counts.count() > MAX_FREQUENT:
        # powers of two as classes: a few dozen rows
        classes = counts.groupBy(F.floor(F.log2("count")).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
        taken, least = 0, None
        for c in classes:
            taken += c["n"]
            if taken > MAX_FREQUENT:
                break
            least = 2 ** c["k"]
        if least is None:
            return np.zeros(0, np.uint64)
    found = counts.where(F.col("count") >= least).select("s").toPandas()["s"].to_numpy(np.int64)
    scratch.drop(counts)
    return np.sort(found.view(np.uint64))


def _sketches(values: np.ndarray, at: np.ndarray) -> pa.FixedSizeListArray:
    """Each row's parity sketch: SKETCH bits, each flipped once for every shingle that falls on it."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    bit = (tk.mix(values + np.uint64(13)) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(row * SKETCH + bit, minlength=rows * SKETCH) & 1).astype(np.uint8)
    words = np.packbits(odd.reshape(rows, SKETCH), axis=1).view(np.int64)
    return _lists(words.ravel(), np.arange(rows + 1) * (SKETCH // 64))


def _minima(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Each row's least shingle in HEADS further random orders; none for an empty row."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(full), HEADS), np.uint64)
    for k in range(HEADS):
        out[:, k] = np.minimum.reduceat(tk.mix(values + np.uint64(101 + k)), at[:-1][full]) if len(full) else 0
    return _lists(out.ravel(), np.concatenate(([0], np.cumsum(np.where(np.diff(at) > 0, HEADS, 0)))))


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, a 128-bit fingerprint and the sketch of the set, its minima, and its first n // 4 + 1 shingles in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        low = np.uint64((1 << 24) - 1)
        maybe = np.zeros(1 << 24, bool)
        maybe[(last & low).astype(np.int64)] = True
        for batch in batches:
            for block in tk.blocks(batch.column("text")):
                values, at = shingle_sets(block)
                n = np.diff(at)
                late = maybe[(values & low).astype(np.int64)]
                hit = np.flatnonzero(late)
                if len(hit):
                    spot = np.minimum(np.searchsorted(last, values[hit]), len(last) - 1)
                    late[hit] = last[spot] == values[hit]
                prints = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(values + np.uint64(k))))) for k in (3, 7)]
                prints = [tk.signed(x[at[1:]] - x[at[:-1]]) for x in prints]
                ordered = values
                if late.any():
                    row = np.repeat(np.arange(block.rows, dtype=np.uint64), n)
                    # by row, then early before late; the order within is kept, so it stays that of the values
                    ordered = values[np.argsort((row << np.uint64(1)) | late, kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first_row, block.rows), pa.array(n.astype(np.int64)),
                        pa.array(prints[0]), pa.array(prints[1]), _sketches(values, at), _minima(values, at), _first(ordered, at, np.where(n > 0, n // 4 + 1, 0)),
                    ],
                    ["doc_id", "n", "f1", "f2", "sketch", "heads", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, n long, f1 long, f2 long, sketch array<long>, heads array<long>, prefix array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tk.blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first_row, block.rows), _lists(*shingle_sets(block))], ["x", "s"])


class _Join:
    """The state of one run: regions, sketches, and what was compared."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch = docs, scratch
        self.made = scratch.put(prefixes(docs, frequent_shingles(docs, scratch)), "prefixes")
        self.copies = scratch.put(self.made.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("x"), F.count("*").alias("copies")), "copies")
        self.once = self.made.join(self.copies.select(F.col("x").alias("doc_id")), "doc_id", "left_semi")
        self.sketches = self.made.select(F.col("doc_id").alias("x"), "n", "sketch").where("n > 0")

    def first_pivots(self) -> DataFrame:
        """Pairs (a, b) of documents with the least document that shares one of their minima."""
        heads = self.once.select(F.col("doc_id").alias("x"), F.posexplode("heads").alias("k", "h"))
        least = heads.groupBy("k", "h").agg(F.min("x").alias("a"), F.max("x").alias("last"), F.count("*").alias("n")).where("a <> last").drop("last")
        least = self.scratch.put(least, "heads")
        return spread_join(heads, least.drop("n"), ["k", "h"], least.select("k", "h", "n"), F.col("x")).where("a <> x").select("a", F.col("x").alias("b")).distinct()

    def regions(self, groups: DataFrame, to_pivot: DataFrame) -> DataFrame:
        """Members of regions, as ``_open`` has them, in which documents of several components meet."""
        own = self.once.select(F.col("doc_id").alias("x"), "prefix").join(few(groups.withColumnRenamed("node", "x")), "x", "left").join(to_pivot, "x", "left")
        rows = own.select(F.explode("prefix").alias("s"), "x", "p", "d", F.lit(False).alias("used"), F.coalesce("component", "x").alias("c"))
        return self._open(rows, FIRST_PIVOTS)

    def _open(self, rows: DataFrame, pivots: int) -> DataFrame:
        """Members (s, x, p, d, used, c, pivot) of regions that hold several components and, outside the largest, a document that was no pivot yet.

        The first ``pivots`` of those are marked. All windows are over a region, so rows are dealt once.
        """
        region, component = Window.partitionBy("s"), Window.partitionBy("s", "c")
        rows = rows.repartition("s").withColumn("lo", F.min("c").over(region)).withColumn("hi", F.max("c").over(region)).where("lo <> hi").drop("lo", "hi")
        rows = rows.withColumn("k", F.count("*").over(component)).withColumn("main", F.max(F.struct("k", "c")).over(region)["c"])
        fresh = (F.col("c") != F.col("main")) & ~F.col("used")
        rows = rows.withColumn("any", F.max(fresh).over(region)).where("any")
        rank = F.row_number().over(region.orderBy(~fresh, "x"))
        return self.scratch.put(rows.withColumn("pivot", fresh & (rank <= pivots)).select("s", "x", "p", "d", "used", "c", "pivot"), "open")

    def _again(self, rows: DataFrame, pivots: int) -> DataFrame:
        """As ``_open`` for the rows of a later round, which may lie in a few large regions: by counts and a join that splits them, with about ``pivots`` pivots by hash."""
        rows = self.scratch.put(rows, "members")
        parts = rows.groupBy("s", "c").agg(F.count("*").alias("k"), F.count(F.when(~F.col("used"), 1)).alias("fresh"))
        open_ = parts.groupBy("s").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), F.max(F.struct("k", "c", "fresh")).alias("main"), F.sum("fresh").alias("fresh"))
        open_ = open_.select("s", "n", F.col("main.c").alias("main"), (F.col("fresh") - F.col("main.fresh")).alias("fresh"), "parts")
        open_ = self.scratch.put(open_.where("parts > 1 AND fresh > 0").drop("parts"), "regions")
        draw = F.shiftrightunsigned(F.xxhash64("x", "s", F.lit(pivots)), 11).cast("double") * F.lit(2.0**-53)
        marked = spread_join(rows, open_.drop("n"), "s", open_.select("s", "n"), F.col("x"))
        pivot = (F.col("c") != F.col("main")) & ~F.col("used") & (draw * F.col("fresh") < pivots)
        made = self.scratch.put(marked.withColumn("pivot", pivot).select("s", "x", "p", "d", "used", "c", "pivot"), "open")
        self.scratch.drop(rows, open_)
        return made

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches allow to link.

        Linked sets differ in at most a seventh of the sum of their sizes, and in no fewer shingles than
        their sketches differ in bits, so no linked pair is lost here.
        """
        left = self.sketches.select(F.col("x").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
        right = self.sketches.select(F.col("x").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
        bits = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        sizes = 4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")
        return pairs.join(left, "a").join(right, "b").where(sizes & (7 * bits <= F.col("na") + F.col("nb"))).select("a", "b")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) with their exact distance and whether they link."""
        pairs = self.scratch.put(pairs, "near")
        involved = few(self.scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved"))
        sets = self.scratch.put(self.docs.select("doc_id", "text").join(involved, "doc_id", "left_semi").mapInArrow(freeing(_sets), "x long, s array<long>"), "sets")
        left, right = sets.select(F.col("x").alias("a"), F.col("s").alias("sa")), sets.select(F.col("x").alias("b"), F.col("s").alias("sb"))
        common, union = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb") - F.col("common")
        made = self.scratch.put(
            pairs.join(left, "a").join(right, "b").withColumn("common", common)
            .select("a", "b", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= 75 * union).alias("linked")),
            "compared",
        )
        self.scratch.drop(pairs, sets)
        return made

    def run(self) -> DataFrame:
        """(node, component) of linked documents."""
        compared = self.compare(self._near(self.first_pivots()))
        to_pivot = compared.groupBy(F.col("b").alias("x")).agg(F.min(F.struct("a", "d")).alias("m")).select("x", F.col("m.a").alias("p"), F.col("m.d").alias("d"))
        groups = components(compared.where("linked").select("a", "b"), self.scratch)
        known = compared.select("a", "b")
        members, pivots = self.regions(groups, to_pivot), FIRST_PIVOTS
        while not members.isEmpty():
            compared = self.compare(self._across(members).join(known, ["a", "b"], "left_anti"))
            known = known.unionByName(compared.select("a", "b"))
            linked = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(compared.where("linked").select("a", "b"))
            groups = components(linked, self.scratch)
            pivots *= MORE_PIVOTS
            again = members.withColumn("used", F.col("used") | F.col("pivot")).drop("pivot", "c").join(few(groups.withColumnRenamed("node", "x")), "x", "left")
            members = self._again(again.select("s", "x", "p", "d", "used", F.coalesce("component", "x").alias("c")), pivots)
        return groups

    def cells(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """(g, x, home) of Voronoi cells: each member of a component has one home, and is in every cell that may be the home of one it links with."""
        put = self.scratch.put
        open_ = put(groups.select(F.col("component").alias("g"), F.col("node").alias("x"), F.lit(True).alias("home"), F.lit(None).cast("long").alias("was")), "cells")
        done = None
        for level in range(LEVELS):
            draws = [F.min(F.when(F.col("home"), F.struct(F.xxhash64("x", F.lit(level * PIVOTS + k)).alias("u"), "x"))).alias(f"m{k}") for k in range(PIVOTS - 1)]
            sizes = put(open_.groupBy("g").agg(F.count("*").alias("n"), F.max("was").alias("was"), F.min(F.when(F.col("home"), F.col("x"))).alias("least"), *draws), "sizes")
            # a cell that kept more than three quarters of what it was split from isn't split again
            large = sizes.where((F.col("n") > CELL) & (F.col("was").isNull() | (4 * F.col("n") <= 3 * F.col("was"))))
            wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL).cast("int") + 1)
            pivots = large.select("g", "n", F.slice(F.array_distinct(F.array("least", *(F.col(f"m{k}.x") for k in range(PIVOTS - 1)))), F.lit(1), wanted).alias("p"))
            pivots = put(pivots.where(F.size("p") > 1), "pivots")
            split = few(pivots.select("g"))
            rest = open_.join(split, "g", "left_anti").select("g", "x", "home")
            done = rest if done is None else done.unionByName(rest)
            if pivots.isEmpty():
                return done
            each = pivots.select("g", F.explode("p").alias("x")).join(sets, "x").groupBy("g").agg(F.collect_list(F.struct("x", "s")).alias("p"))  # PIVOTS at most
            members = open_.drop("was").join(split, "g", "left_semi").join(sets, "x")
            placed = spread_join(members, each.join(pivots.select("g", "n"), "g"), "g", pivots.select("g", "n"), F.col("x"))
            met = F.transform("p", lambda v: F.struct(F.size(F.array_intersect(F.col("s"), v["s"])).alias("k"), F.size(v["s"]).alias("n"), v["x"].alias("p")))
            ds = F.transform(met, lambda v: F.struct((1 - v["k"] / (F.size("s") + v["n"] - v["k"])).alias("d"), v["p"].alias("p")))
            placed = placed.select("g", "x", "home", F.col("n").alias("was"), ds.alias("ds")).withColumn("first", F.array_min("ds"))
            placed = put(placed.withColumn("near", F.filter("ds", lambda v: v["d"] <= F.col("first.d") + 0.5 + 1e-9)).drop("ds"), "placed")
            # a cell whose members would mostly be in several parts (near copies all stand close to each other) stays whole
            whole = few(put(placed.groupBy("g").agg(F.sum(F.size("near")).alias("k"), F.count("*").alias("n")).where(F.col("k") > REPLICAS * F.col("n")).select("g"), "whole"))
            done = done.unionByName(placed.join(whole, "g", "left_semi").select("g", "x", "home"))
            parted = placed.join(whole, "g", "left_anti").select("x", "home", "was", "first", F.explode("near").alias("v"))
            open_ = put(parted.select(F.col("v.p").alias("g"), "x", (F.col("home") & (F.col("v.p") == F.col("first.p"))).alias("home"), "was"), "cells")
        return done.unionByName(open_.select("g", "x", "home"))

    def sized(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (component, node) of components of two, which link as they are, and of larger ones."""
        sizes = self.scratch.put(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        members = self.scratch.put(spread_join(groups, sizes, "component", sizes, F.col("node")), "members")
        return members.where("n = 2").drop("n"), members.where("n > 2").drop("n")

    def blocks(self, groups: DataFrame) -> DataFrame:
        """Units of two blocks to be compared: (g, u, v, side, both, x, s). Home blocks of a cell are numbered first; u is always one of them."""
        involved = few(groups.select(F.col("node").alias("doc_id")))
        sets = self.docs.select("doc_id", "text").join(involved, "doc_id", "left_semi").mapInArrow(freeing(_sets), "x long, s array<long>")
        sets = self.scratch.put(sets.dropDuplicates(["x"]), "sets")
        cells = self.scratch.put(self.cells(groups, sets).join(sets.select("x", F.size("s").alias("n")), "x"), "cells")
        number = lambda of: F.ceil(F.greatest(F.count(of) / BLOCK, F.sum(F.when(of.isNotNull(), F.col("n"))) / BLOCK_SHINGLES)).cast("int")
        sizes = cells.groupBy("g").agg(
            number(F.when(F.col("home"), F.col("n"))).alias("homes"), F.coalesce(number(F.when(~F.col("home"), F.col("n"))), F.lit(0)).alias("others"), F.count("*").alias("k")
        ).where("k > 1")
        sizes = self.scratch.put(sizes, "blocks")
        rows = spread_join(cells, sizes.drop("k"), "g", sizes.select("g", F.col("k").alias("n")), F.col("x")).where("homes > 0")
        own = F.pmod(F.xxhash64("x"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("others"))).cast("int")
        rows = rows.withColumn("own", F.when(F.col("home"), own).otherwise(F.col("homes") + own))
        met = F.when(F.col("home"), F.sequence(F.lit(0), F.col("homes") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("homes") - 1))
        units = rows.withColumn("met", F.explode(met)).select(
            "g", F.least("own", "met").alias("u"), F.greatest("own", "met").alias("v"), (F.col("own") > F.col("met")).alias("side"),
            (F.greatest("own", "met") < F.col("homes")).alias("both"), "x",
        )
        return units.join(sets, "x").repartition("g", "u", "v").sortWithinPartitions("g", "u", "v", "side", "x").select("g", "u", "v", "side", "both", "x", "s")

    def _across(self, members: DataFrame) -> DataFrame:
        """Distinct pairs (a, b), a < b, of a pivot and a member of another component of its region that may link."""
        # half of a sketch on top of the other is a sketch of half the bits; it is all that travels with the rows
        half = SKETCH // 128
        words = [f"k{k}" for k in range(half)]
        folded = self.sketches.select("x", "n", *(F.col("sketch")[k].bitwiseXOR(F.col("sketch")[k + half]).alias(f"k{k}") for k in range(half)))
        rows = members.join(folded, "x")
        pivot = rows.where("pivot").select(*(F.col(c).alias(f"q_{c}") for c in ("s", "x", "p", "d", "n", "c", *words)))
        window = F.when(F.col("p") == F.col("q_p"), F.abs(F.col("d") - F.col("q_d")) <= 0.25 + 1e-9)
        sizes = 4 * F.least("n", "q_n") >= 3 * F.greatest("n", "q_n")
        bits = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"q_{k}"))) for k in words), F.lit(0))
        near = (F.col("c") != F.col("q_c")) & F.coalesce(window, F.lit(True)) & sizes & (7 * bits <= F.col("n") + F.col("q_n"))
        counts = members.groupBy("s").agg(F.count("*").alias("n"))
        met = spread_join(rows.withColumnRenamed("n", "own_n"), pivot.withColumnRenamed("q_s", "s"), "s", counts, F.col("x")).withColumnRenamed("own_n", "n")
        return met.where(near).select(F.least("x", "q_x").alias("a"), F.greatest("x", "q_x").alias("b")).distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of each unit: whether its blocks are one and the same, whether both sides count, its documents' sides and numbers, and their sets."""
    held: list[pa.RecordBatch] = []

    def unit(parts: list[pa.RecordBatch]):
        column = lambda c: pa.concat_arrays([b.column(c) for b in parts])
        u, v, s = column("u")[0].as_py(), column("v")[0].as_py(), column("s")
        at, values = s.offsets.to_numpy(), s.values.to_numpy()
        return u == v, column("both")[0].as_py(), column("side").to_numpy(zero_copy_only=False), column("x").to_numpy(), [values[a:b] for a, b in zip(at[:-1], at[1:])]

    last = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("g", "u", "v")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if a == b:
                continue
            key = tuple(int(k[a]) for k in keys)
            if held and key != last:
                yield unit(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield unit(held)


def _tiles(sets: list[np.ndarray]) -> list[slice]:
    """Runs of sets, TILE or about TILE_SHINGLES shingles each."""
    out, begin, total = [], 0, 0
    for k, s in enumerate(sets):
        if k > begin and (k - begin >= TILE or total + len(s) > TILE_SHINGLES):
            out.append(slice(begin, k))
            begin, total = k, 0
        total += len(s)
    return [*out, slice(begin, len(sets))] if sets else out


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets of two blocks link, as a matrix, tile by tile."""
    out = np.zeros((len(left), len(right)), bool)
    for a in _tiles(left):
        for b in _tiles(right):
            if left is not right or a.start <= b.start:
                out[a, b] = _linked_tile(left[a], right[b])
                if left is right:
                    out[b, a] = out[a, b].T
    return out


def _linked_tile(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The same of two tiles; intersections are exact, by products of 0/1 matrices of COLUMNS shingles."""
    sizes = np.array([len(x) for x in (*left, *right)], np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    names, column = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        matrix = np.zeros((len(sizes), min(COLUMNS, len(names) - begin)), np.float32)
        matrix[row[a:b], column[a:b] - begin] = 1
        common += (matrix[: len(left)] @ matrix[len(left) :].T).astype(np.int64)
    return 100 * common >= 75 * (sizes[: len(left), None] + sizes[None, len(left) :] - common)


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, n): links that units add to a document's."""
    for same, both, side, x, sets in _units(batches):
        if same:
            linked = _linked(sets, sets)
            found, n = x, linked.sum(1) - 1  # but for itself
        else:
            a, b = np.flatnonzero(~side), np.flatnonzero(side)
            if not len(a) or not len(b):
                continue
            linked = _linked([sets[k] for k in a], [sets[k] for k in b])
            found, n = (np.concatenate((x[a], x[b])), np.concatenate((linked.sum(1), linked.sum(0)))) if both else (x[a], linked.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["x", "n"])


def _pair_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), a < b, each from one unit."""
    for same, both, side, x, sets in _units(batches):
        a, b = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
        if not len(a) or not len(b):
            continue
        i, j = np.nonzero(_linked([sets[k] for k in a], [sets[k] for k in b]))
        i, j = x[a][i], x[b][j]
        keep = np.ones(len(i), bool) if both and not same else i < j
        low, high = np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])


def links(docs: DataFrame) -> DataFrame:
    """All exact links (a, b), a < b, between documents that stand for their class of equal sets. Their number may grow with the square of a group; ``join`` counts them."""
    ship(docs.sparkSession)
    state = _Join(docs, Scratch(docs.sparkSession, "jaccard"))
    two, more = state.sized(state.run())
    found = state.blocks(more).mapInArrow(freeing(_pair_links), "a long, b long")
    return found.unionByName(two.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))


def join(docs: DataFrame, with_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the least document with an equal set) of every document.

    With links also n_links, the number of other classes that link with the document's own.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    state = _Join(docs, scratch)
    groups, further = state.run(), []
    named = groups.withColumnRenamed("node", "x")
    if with_links:
        two, more = state.sized(groups)
        counts = state.blocks(more).mapInArrow(freeing(_count_links), "x long, n long").groupBy("x").agg(F.sum("n").alias("n_links"))
        counts = counts.unionByName(two.select(F.col("node").alias("x"), F.lit(1).cast("long").alias("n_links")))
        named, further = named.join(counts, "x", "left"), ["n_links"]
    classes = state.copies.join(named, "x", "left").select("n", "f1", "f2", "x", F.coalesce("component", "x").alias("component"), *further)
    own: Column = F.col("doc_id")
    made, key = state.made.select("doc_id", "n", "f1", "f2"), ["n", "f1", "f2"]
    counts = state.copies.select(F.col("n").alias("__n"), "f1", "f2", F.col("copies").alias("n"))
    full = made.where("n > 0").withColumnRenamed("n", "__n")
    found = spread_join(full, classes.withColumnRenamed("n", "__n"), ["__n", "f1", "f2"], counts, F.struct("doc_id", F.monotonically_increasing_id()), "left").withColumnRenamed("__n", "n")
    bare = made.where("n = 0").withColumns({c: F.lit(None).cast("long") for c in ("x", "component", *further)})
    whole = found.select(*key, "doc_id", "x", "component", *further).unionByName(bare).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", own).alias("component_id"), F.coalesce("x", own).alias("class_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in further),
    )
    return scratch.keep(whole)
