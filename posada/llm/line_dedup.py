"""Fuzzy line deduplication by MinHash.

A line is what stands between line feeds and holds a word; it counts as its bytes with
A-Z taken as a-z. Equal lines share a hash (63 bits) from the start, so signatures, bands
and verification work on distinct lines. Lines of up to ``SHORT`` code points are compared by shingles of
``NARROW`` code points, lines of more than ``LONG`` by shingles of ``WIDE``; those between belong to both
classes, and a link in either counts. (Short shingles find edits of short lines, but unrelated long lines
would have too many of them in common.) An item below is a line in one of its classes.

1. signature: one-permutation MinHash of the item's shingles, ``BANDS * ROWS`` bins, empty bins
   filled from others by a fixed draw;
2. banding: two items that agree in all rows of a band are candidates;
3. verification: the exact Jaccard similarity of the two sets of shingles, by rounds. First the least item of
   each band is compared with all others, which settles bands of two items. Then, in bands of more, items
   outside the largest component become pivots (about FIRST_PIVOTS at once, then MORE_PIVOTS times as
   many in each round) and are compared with the items of other components (sizes and parity sketches
   exclude pairs that can't be close), until no band holds two components with an unused pivot. Items carry no bands of theirs: a
   pair that shares several is looked at in each, unless connected by then, and verified once a round. So every
   pair of candidates is compared, excluded or already connected, and batches and partitions decide nothing;
4. union-find: verified links make components, each of which keeps its first line in order of
   (doc_id, line number), documents without an id coming last.

At a similarity of ``THRESHOLD`` the chance that a pair shares no band is about 0.5 %, at
0.9 below 1 in 10,000. A changed character is found in lines of 49 code points or more. Lines without a word always stay.

Defined cases: null and empty texts stay as they are; of a document whose every line
goes, an empty text is left (the pipeline stage drops such documents, which are copies
throughout); rows with one doc_id and different texts are documents of their own, also if the id is null;
rows equal in both count as one document, so a line kept in one stays in all;
an empty table gives an empty result; further columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.components import components
from posada.llm.shared import BitFilter, Scratch, few, freeing, row_key, ship, spread_join

NARROW, WIDE = 5, 8  # code points
SHORT, LONG = 160, 120  # most code points of a line compared by narrow shingles, and most of one that isn't compared by wide ones
BANDS, ROWS = 10, 4
THRESHOLD = 0.8
SKETCH = 1024  # bits
SKETCHES = [f"k{k}" for k in range(SKETCH // 64)]
FIRST_PIVOTS, MORE_PIVOTS = 32, 16
HASHED_ROWS = 200_000  # rows of numbers, in one partition, up to which they make a hash table
SEEN = 1 << 16  # lines that a task remembers so as to emit equal ones once; decides speed only


def lines(block: tk.Block, eights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold a word: begin, end, row, number within the text (from 0, counting all lines), hash of 63 bits."""
    breaks = np.flatnonzero(block.data == 0x0A)
    full = block.offsets[:-1] < block.offsets[1:]
    begin = np.sort(np.concatenate((block.offsets[:-1][full], breaks + 1)))
    end = np.sort(np.concatenate((block.offsets[1:][full], breaks)))
    solid = begin < end
    begin, end = begin[solid], end[solid]
    if len(begin):
        holds = tk.IS_WORD[block.data[begin]]
        if not holds.all():
            # a line reaches to the next one but for line feeds, which are no words
            holds = np.logical_or.reduceat(tk.IS_WORD.take(block.data), begin)
        begin, end = begin[holds], end[holds]
    row = block.row_of(begin)
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, block.offsets[row])
    return begin, end, row, number, block.span_hash(eights, begin, end) >> np.uint64(1)


class Points:
    """Where the code points of a block begin."""

    def __init__(self, block: tk.Block, eights: np.ndarray):
        self.eights = np.ascontiguousarray(eights)
        heads = (block.data & 0xC0) != 0x80
        self.plain = bool(heads.all())  # one byte a code point
        self.at = np.arange(len(block.data) + 1) if self.plain else np.append(np.flatnonzero(heads), len(block.data))
        self.block = block

    def index(self, position: np.ndarray) -> np.ndarray:
        return position if self.plain else np.searchsorted(self.at, position)

    def count(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.index(end) - self.index(begin)

    def shingles(self, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of every window of ``width`` code points; a shorter line is one window."""
        first = self.index(begin)
        count = np.maximum(self.index(end) - first - width + 1, 0)
        total = np.concatenate(([0], np.cumsum(count)))
        line = np.repeat(np.arange(len(begin)), count)
        if 2 * total[-1] < len(self.at) or not (begin[1:] >= end[:-1]).all():
            head = np.repeat(first - total[:-1], count) + np.arange(total[-1])
            at, after = self.at[head], self.at[head + width]
            eights = self.eights[at]
        else:
            # most of the block: windows are taken in a row, without an index of theirs
            step = np.zeros(len(self.at) + 1, np.int8)
            full = count > 0
            np.add.at(step, first[full], 1)
            np.subtract.at(step, (first + count)[full], 1)
            inside = np.cumsum(step[: max(len(self.at) - width, 0)], dtype=np.int8).view(bool)
            at, after = self.at[: len(inside)][inside], self.at[width:][inside]
            eights = self.eights[: len(inside)][inside] if self.plain else self.eights[at]
        value = self.block.head_hash(eights, width)  # right for windows of one byte a code point
        if not self.plain:
            wide = np.flatnonzero(after - at != width)
            value[wide] = self._short_hash(eights[wide], at[wide], after[wide])
        short = np.flatnonzero(count == 0)
        if len(short):
            line, value = np.concatenate((line, short)), np.concatenate((value, self.block.span_hash(self.eights, begin[short], end[short])))
        return line, value

    def _short_hash(self, eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``span_hash`` of spans of a few code points, whose first eight bytes are given."""
        length = end - start
        value = tk.mix((eights & tk.MASK[np.minimum(length, 8)]) ^ length.astype(np.uint64) * np.uint64(tk.STEP))
        rest = np.zeros(len(value), np.uint64)
        more, number = np.flatnonzero(length > 8), 1
        longer = more
        while len(longer):
            part = self.eights[start[longer] + 8 * number] & tk.MASK[np.minimum(length[longer] - 8 * number, 8)]
            rest[longer] += tk.part_hash(part, np.array([number]))
            number += 1
            longer = longer[length[longer] > 8 * number]
        value[more] = tk.mix(value[more] + rest[more])
        return value


def classes(points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, shingle width, which lines) for lines of so many code points."""
    yield 0, NARROW, np.flatnonzero(points <= SHORT)
    yield 1, WIDE, np.flatnonzero(points > LONG)


def signatures(line: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of BANDS * ROWS bins, by line."""
    bins = BANDS * ROWS
    none = np.iinfo(np.uint64).max
    out = np.full(count * bins, none, np.uint64)
    slot = value >> np.uint64(32)
    slot *= np.uint64(bins)
    slot >>= np.uint64(32)
    slot = slot.view(np.int64)
    slot += line * bins
    np.minimum.at(out, slot, value)
    out = out.reshape(count, bins)
    filled = out != none
    if filled.all():
        return out
    first, draw = out.copy(), (tk.seeded(bins * 64, 23).reshape(64, bins) % np.uint64(bins)).astype(np.int64)
    row, at = np.nonzero(~filled)
    for turn in range(64):
        other = draw[turn, at]
        usable = filled[row, other]
        out[row[usable], at[usable]] = first[row[usable], other[usable]]
        row, at = row[~usable], at[~usable]
        if not len(row):
            return out
    out[row, at] = first[row, filled.argmax(1)[row]]
    return out


def bands(signature: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash for each band, by line; classes have bands of their own."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    value = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(BANDS * kind), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        value = tk.mix(value * np.uint64(31) + parts[:, :, k])
    return value


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, i) of every band of a task's items; those of equal lines come once, or again after SEEN other lines."""
    seen: set[int] = set()
    for batch in batches:
        for block in tk.blocks(batch.column("text")):
            eights = block.eights(lower=True)
            begin, end, _, _, h = lines(block, eights)
            h, first = np.unique(h, return_index=True)
            new = np.array([x not in seen for x in h.tolist()], bool)
            h, begin, end = h[new], begin[first[new]], end[first[new]]
            if not len(h):
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.update(h.tolist())
            points = Points(block, eights)
            for kind, width, of in classes(points.count(begin, end)):
                if len(of):
                    band = bands(signatures(*points.shingles(begin[of], end[of], width), len(of)), kind)
                    item = np.repeat(h[of] * np.uint64(2) + np.uint64(kind), BANDS)
                    yield pa.RecordBatch.from_arrays([pa.array(tk.signed(band.ravel())), pa.array(tk.signed(item))], ["band", "i"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tk.blocks(batch.column("text")):
            _, _, row, number, h = lines(block, block.eights(lower=True))
            at = pa.array(row)
            own = [batch.column(c).slice(block.first_row, block.rows).take(at) for c in ("r", "t")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number.astype(np.int32)), pa.array(tk.signed(h))], ["r", "t", "line", "h"])


def _line_texts(wanted: BitFilter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, bytes) of a task's lines that the filter lets pass; equal ones come once, or again after SEEN other lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            for block in tk.blocks(batch.column("text")):
                begin, end, _, _, h = lines(block, block.eights(lower=True))
                h, first = np.unique(h, return_index=True)
                passed = wanted.test(tk.signed(h))
                h, first = h[passed], first[passed]
                raw = tk.LOWER[block.data].tobytes()
                new = [(k, raw[begin[i] : end[i]]) for k, i in zip(tk.signed(h).tolist(), first) if k not in seen]
                seen.update(k for k, _ in new)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.int64()), pa.array([x for _, x in new], pa.binary())], ["h", "raw"])

    return run


def _keys(block: tk.Block, width: int, points: Points | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Distinct shingles of the texts of a block, row and hash in one number, ascending; ``of`` picks texts, which then count as 0, 1, ..."""
    points = points or Points(block, block.eights())
    of = np.arange(block.rows) if of is None else of
    line, value = points.shingles(block.offsets[:-1][of], block.offsets[1:][of], width)
    key = np.sort((line.astype(np.uint64) << np.uint64(52)) | (value >> np.uint64(12)))
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with the number of their shingles and their parity sketch: SKETCH bits, each flipped once for every shingle that falls on it."""
    for batch in batches:
        for block in tk.blocks(batch.column("raw")):
            points = Points(block, block.eights())
            own = batch.slice(block.first_row, block.rows)
            h = own.column("h").to_numpy().view(np.uint64)
            for kind, width, of in classes(points.count(block.offsets[:-1], block.offsets[1:])):
                if not len(of):
                    continue
                key = _keys(block, width, points, of)
                row = (key >> np.uint64(52)).astype(np.int64)
                bit = (tk.mix(key << np.uint64(12)) % np.uint64(SKETCH)).astype(np.int64)
                odd = (np.bincount(row * SKETCH + bit, minlength=len(of) * SKETCH) & 1).astype(np.uint8)
                sketch = np.packbits(odd.reshape(len(of), SKETCH), axis=1).view(np.int64)
                n = np.bincount(row, minlength=len(of)).astype(np.int64)
                item = tk.signed(h[of] * np.uint64(2) + np.uint64(kind))
                parts = [pa.array(item), pa.array(n), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(SKETCHES)))]
                yield pa.RecordBatch.from_arrays(parts, ["i", "n", *SKETCHES])


def similarities(a: pa.Array, b: pa.Array, of: np.ndarray, width: int) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of each line of a and that line of b whose number ``of`` gives; ROWS of tk pairs at most."""
    left, right = (_keys(tk.Block(*tk.text_bytes(x), 0), width) for x in (a, b))
    count = lambda keys, n: np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=n)
    size = count(right, len(b))
    first, size = (np.cumsum(size) - size)[of], size[of]
    pair = np.repeat(np.arange(len(a)), size)
    at = np.arange(len(pair)) + (first - np.cumsum(size) + size)[pair]
    both = np.sort(np.concatenate((left, (right[at] & np.uint64((1 << 52) - 1)) | (pair.astype(np.uint64) << np.uint64(52)))))
    common = count(both[1:][both[1:] == both[:-1]], len(a))
    return common / np.maximum(count(left, len(a)) + size - common, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of items with their texts those that are close enough, as pairs of lines."""
    for batch in batches:
        for kind, width in enumerate((NARROW, WIDE)):
            some = batch.filter(pa.array((batch.column("i").to_numpy() & 1) == kind))
            size = some.num_rows
            step = max(1, min(tk.ROWS, size * tk.BLOCK // max(some.column("ra").nbytes, 1)))
            for k in range(0, size, step):
                part = some.slice(k, step)
                # shingles of a line that several others meet are made once
                _, first, of = np.unique(part.column("lo").to_numpy(), return_index=True, return_inverse=True)
                close = pa.array(similarities(_compact(part.column("ra")), part.column("rb").take(pa.array(first)), of, width) >= THRESHOLD)
                ends = [pa.array(part.column(c).filter(close).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(1)).cast(pa.int64()) for c in ("i", "lo")]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])


def _compact(column: pa.Array) -> pa.Array:
    """The slice's own bytes from offset 0."""
    return pa.concat_arrays([column, column.slice(0, 0)])


def _open(rows: DataFrame, pivots: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(band, n) and members of bands that hold several components and, outside the largest, an item that was no pivot yet; about ``pivots`` of those are marked. None if there is no such band.

    ``rows`` must be cheap to read twice.
    """
    parts = rows.groupBy("band", "c").agg(F.count("*").alias("k"), F.count(F.when(~F.col("used"), 1)).alias("fresh"))
    open_ = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), F.max(F.struct("k", "c", "fresh")).alias("main"), F.sum("fresh").alias("fresh"))
    open_ = open_.select("band", "n", F.col("main.c").alias("main"), (F.col("fresh") - F.col("main.fresh")).alias("fresh"), "parts")
    open_ = scratch.put(open_.where("parts > 1 AND fresh > 0").drop("parts"), "bands")
    if open_.isEmpty():
        return None
    draw = F.shiftrightunsigned(F.xxhash64("i", "band", F.lit(pivots)), 11).cast("double") * F.lit(2.0**-53)
    marked = spread_join(rows, open_.drop("n"), "band", open_.select("band", "n"), F.col("i"))
    marked = marked.withColumn("pivot", (F.col("c") != F.col("main")) & ~F.col("used") & (draw * F.col("fresh") < pivots)).drop("main", "fresh")
    return open_.select("band", "n"), scratch.put(marked, "open")


def _across(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (i, lo), i < lo, of a pivot and a member of another component of its band, as far as sizes and sketches allow a link.

    Close sets differ in at most (1 - THRESHOLD) / (1 + THRESHOLD) of the sum of their sizes, and in no fewer
    shingles than their sketches differ in bits, so no close pair is lost here. Each pair comes once a round, whatever bands both have; a band leaves out
    members that were its pivots in an earlier round, and takes a pair of two pivots from the lesser one.
    """
    pivot = members.where("pivot").select("band", *(F.col(c).alias(f"q_{c}") for c in ("i", "n", "c", *SKETCHES)))
    sizes = F.least("n", "q_n") >= THRESHOLD * F.greatest("n", "q_n") - 1e-9
    bits = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"q_{k}"))) for k in SKETCHES), F.lit(0))
    near = (F.col("c") != F.col("q_c")) & sizes & (bits <= (1 - THRESHOLD) / (1 + THRESHOLD) * (F.col("n") + F.col("q_n")) + 1e-9)
    once = ~F.col("used") & (~F.col("pivot") | (F.col("q_i") < F.col("i")))
    joined = spread_join(members, pivot, "band", counts, F.col("i"))
    return joined.where(once & near).select(F.least("i", "q_i").alias("i"), F.greatest("i", "q_i").alias("lo")).distinct()


def _line(item: str) -> Column:
    """The line of an item."""
    return F.shiftrightunsigned(item, 1)


def _linked(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Of pairs (i, lo) of items the close ones, as pairs (a, b) of lines."""
    left, right = texts.select("h", F.col("raw").alias("ra")), texts.select("h", F.col("raw").alias("rb"))
    met = pairs.withColumn("h", _line("i")).join(left, "h").withColumn("h", _line("lo")).join(right, "h").select("i", "lo", "ra", "rb")
    return scratch.put(met.mapInArrow(freeing(_verified, hold=True), "a long, b long"), "links")


def _lines_of(texts: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """The texts of the lines of some items."""
    wanted = reduce(DataFrame.unionByName, (items.select(_line(c).alias("h")) for c in columns)).distinct()
    return texts.join(few(wanted), "h", "left_semi")


def _buckets(rows: DataFrame) -> DataFrame:
    """(band, i, lo, many) of the bands that hold several items: each item once, the least of its band, and whether there are more than two."""
    by_band = Window.partitionBy("band")
    shared = rows.withColumn("lo", F.min("i").over(by_band)).withColumn("hi", F.max("i").over(by_band)).where("lo <> hi")
    # filtered rows are still dealt and sorted by band
    return shared.withColumn("many", F.max((F.col("i") != F.col("lo")) & (F.col("i") != F.col("hi"))).over(by_band)).drop("hi").distinct()


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the hashes of distinct lines that links join; a link is a close pair that shares a band."""
    text = docs.select("text")
    buckets = scratch.put(_buckets(text.mapInArrow(freeing(_banded, hold=True), "band long, i long")), "buckets")
    involved = few(scratch.put(buckets.select(_line("i").alias("h")).distinct(), "involved"))
    texts = text.mapInArrow(freeing(_line_texts(BitFilter(involved, "h")), hold=True), "h long, raw binary").join(involved, "h", "left_semi").dropDuplicates(["h"])
    texts = scratch.put(texts, "texts")
    pairs = scratch.put(buckets.where("i <> lo").select("i", "lo").distinct(), "pairs")
    made = components(_linked(pairs, texts, scratch), scratch)

    def connected(rows: DataFrame) -> DataFrame:
        return rows.withColumn("node", _line("i")).join(few(made), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component", "node")

    # bands of two items are settled
    pivots = FIRST_PIVOTS
    found = _open(connected(buckets.where("many").select("band", "i", (F.col("i") == F.col("lo")).alias("used"))), pivots, scratch)
    if found:
        counts, members = found
        sketches = _lines_of(texts, members, "i").mapInArrow(freeing(_sketched, hold=True), "i long, n long, " + ", ".join(f"{k} long" for k in SKETCHES))
        found = counts, scratch.put(members.join(sketches, "i"), "open")
    while found:
        counts, members = found
        pairs = scratch.put(_across(counts, members), "pairs")
        linked = _linked(pairs, scratch.put(_lines_of(texts, pairs, "i", "lo"), "texts"), scratch)
        made = components(made.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked), scratch)
        pivots *= MORE_PIVOTS
        again = members.withColumn("used", F.col("used") | F.col("pivot")).drop("pivot", "c")
        found = _open(connected(again), pivots, scratch)
    return made


def _hashed(rows: DataFrame) -> DataFrame:
    """Marks a table to be joined for a hash table in each partition, where that has HASHED_ROWS at most; then the other side needn't be sorted. Counts it, so it must be cheap to read."""
    spark = rows.sparkSession
    return rows.hint("shuffle_hash") if rows.count() <= HASHED_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def removed_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Row keys (r, t) and the numbers of the lines that go; documents that lose none are absent."""
    r, t = row_key()
    seen = scratch.put(docs.select(r.alias("r"), t.alias("t"), "text").mapInArrow(freeing(_occurrences, hold=True), "r long, t long, line int, h long"), "lines")
    # one row for each distinct line from here on, so no join by line meets a frequent one
    distinct = scratch.put(seen.groupBy("h").agg(F.count("*").alias("n"), F.min("r").alias("r0")), "distinct")
    keyed = distinct.join(few(groups(docs, scratch).withColumnRenamed("node", "h")), "h", "left").withColumn("key", F.coalesce("component", "h"))
    keyed = scratch.put(keyed.where("component IS NOT NULL OR n > 1"), "keyed")
    alone, linked = (keyed.where(f"component IS {x}NULL").drop("component") for x in ("", "NOT "))
    firsts = linked.groupBy("key").agg(F.min("r0").alias("r0"))
    repeated = scratch.put(alone.unionByName(linked.drop("r0").join(firsts, "key").select("h", "n", "key", "r0")), "repeated")
    found = scratch.put(spread_join(seen, _hashed(repeated.drop("n")), "h", repeated.select("h", "n"), F.struct("r", "t", "line")).drop("h"), "repeats")
    # of the first document's own lines the first stays; few documents repeat a line
    place, own = F.struct("t", "line"), found.where("r = r0")
    twice = own.groupBy("key").agg(F.count("*").alias("k"), F.min(place).alias("first")).where("k > 1").drop("k")
    later = own.join(twice, "key").where(place != F.col("first"))
    gone = found.where("r > r0").select("r", "t", "line").unionByName(later.select("r", "t", "line"))
    return gone.groupBy("r", "t").agg(F.collect_set("line").alias("gone"))


def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts less the lines of the given numbers."""

    def one(t: str, numbers: Iterable[int]) -> str:
        out = set(numbers)
        return "\n".join(line for k, line in enumerate(t.split("\n")) if k not in out)

    return pa.array([None if t is None else one(t, g) for t, g in zip(text.to_pylist(), gone.to_pylist())], pa.string())


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` less its removed lines, plus n_lines and n_removed (columns of these names are replaced)."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    r, t = row_key()
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the columns travel as one struct, so that no name of theirs can clash
    keyed = docs.select(F.struct(*(docs[c] for c in names)).alias("own"), r.alias("r"), t.alias("t"))
    gone = scratch.keep(removed_lines(docs, scratch))
    found = keyed.join(_hashed(gone), ["r", "t"], "left")
    text = F.col("own.text")
    cut = F.arrow_udf(_without, "string")
    # only texts that lose a line go to Python
    kept = F.when(F.col("gone").isNull(), text).otherwise(cut(F.when(F.col("gone").isNotNull(), text), F.col("gone")))
    return found.select(
        *(kept.alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in names),
        F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
