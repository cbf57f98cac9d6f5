"""Best-fit decreasing packing of token sequences.

Documents are encoded whole with a given tokenizer, an end token is appended, and only
documents longer than ``LIMIT`` are cut, into pieces of exactly ``LIMIT`` tokens but for a
first one that may be shorter. Pieces are then packed in groups of about
``GROUP_PIECES``, dealt by a hash, so that a group is bounded whatever
the input: within a group, longest first, each piece goes to the open sequence with the
least room that still holds it. The rooms stand in a segment tree over capacities
(0..LIMIT), which finds the tightest open sequence in log2(LIMIT) steps. A group wastes
one sequence at most against packing all at once, one in tens of thousands.

Encoding works on chunks: a chunk is a run of white space with the word after it, or a
stop after a letter with what follows it. The tokenizer's own splitting never joins over
a chunk's start, so a document's ids are its chunks' ids end to end, and a task
encodes each distinct chunk once, as long as its memory of chunks (CACHE_BYTES) lasts. Chunks are
found by hash and compared by their bytes. Texts
with white space beyond ASCII, or with chunks whose hashes collide, are encoded as a whole.

Defined cases: a null text is empty and packs as the end token alone; repeated rows and rows without an id are
packed one by one; bytes that are no UTF-8 count as replacement characters (a cut sequence ends at the next ASCII byte, where
chunks end too, so chunks and whole texts agree); texts are cut at no length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import Scratch, freeing, give_back, ship

LIMIT = 1024
END_ID = 2
GROUP_PIECES = 60_000
CACHE_BYTES = 24 << 20  # of chunks and their ids, that a task remembers before it starts afresh

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STOP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)  # a stop after a plain letter or digit begins a token
_STOP[[ord(c) for c in ",.;:!?"]] = True
_PLAIN[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a longer one with the same beginning, that holds ``more`` entries past ``used``."""
    if used + more <= len(array):
        return array
    out = np.zeros((max(used + more, used + used // 2 + 4096), *array.shape[1:]), array.dtype)
    out[:used] = array[:used]
    return out


class Encoder:
    """Ids of whole texts, encoding each distinct chunk once. It serves one task."""

    def __init__(self, tokenizer, cache_bytes: int = CACHE_BYTES):
        self.tokenizer, self.cache_bytes = tokenizer, cache_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.number = np.zeros(0, np.int32)  # of each key, the chunk's number in order of learning
        self.at = np.zeros((0, 4), np.int64)  # of each chunk: where its ids begin, their number, where its bytes begin, their number
        self.ids, self.raw = np.zeros(0, np.int32), np.zeros(8, np.uint8)
        self.chunks = self.used_ids = self.used_raw = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Adds chunks that aren't known yet; keys ascend and are distinct."""
        size = len(keys) * 44 + 5 * sum(map(len, chunks))
        if self.chunks and len(self.keys) * 44 + 4 * self.used_ids + self.used_raw + size > self.cache_bytes:
            self._forget()
        found = self._encode([x.decode(errors="replace") for x in chunks])
        n = len(keys)
        counts, sizes = np.array([len(x) for x in found], np.int64), np.array([len(x) for x in chunks], np.int64)
        ids = np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        self.ids, self.raw = _room(self.ids, self.used_ids, len(ids)), _room(self.raw, self.used_raw, len(raw) + 8)
        self.ids[self.used_ids : self.used_ids + len(ids)] = ids
        self.raw[self.used_raw : self.used_raw + len(raw)] = raw
        self.at = _room(self.at, self.chunks, n)
        self.at[self.chunks : self.chunks + n] = np.stack((self.used_ids + np.cumsum(counts) - counts, counts, self.used_raw + np.cumsum(sizes) - sizes, sizes), 1)
        spot = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, spot, keys)
        self.number = np.insert(self.number, spot, np.arange(self.chunks, self.chunks + n, dtype=np.int32))
        self.chunks, self.used_ids, self.used_raw = self.chunks + n, self.used_ids + len(ids), self.used_raw + len(raw)

    def block(self, block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block, where each text's begin, and the texts for which that can't be relied on."""
        inside = tk.IS_WORD[block.data]
        heads = ~inside
        heads[1:] &= inside[:-1]
        heads[1:] |= _STOP[block.data[1:]] & _PLAIN[block.data[:-1]]
        heads[block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]] = True
        begin = np.flatnonzero(heads)
        end = np.append(begin[1:], len(block.data)) if len(begin) else begin
        eights = block.eights()
        key = block.span_hash(eights, begin, end)
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        for _ in range(2):  # the second time if the cache was emptied to make room
            at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            new = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
            if not new.any():
                break
            raw = block.data.tobytes()
            self._learn(distinct[new], [raw[begin[k] : end[k]] for k in first[new]])
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        found = self.at[self.number[at]][which]
        wrong = np.unique(block.row_of(begin[~self._same(eights, begin, end, found)]))
        source, count = found[:, 0], found[:, 1]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(source - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, block.offsets)], wrong

    def _same(self, eights: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether each chunk has the bytes of the remembered one."""
        known = np.ndarray((len(self.raw) - 7,), np.dtype("<u8"), self.raw.data, 0, (1,))
        size = end - begin
        same = size == found[:, 3]
        same &= ~tk.differ(eights[begin], known[found[:, 2]], size)
        more = np.flatnonzero(same & (size > 8))
        if len(more):
            count = (size[more] - 1) // 8
            of = np.repeat(np.arange(len(more)), count)
            step = 8 * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + 1)
            part = tk.differ(eights[begin[more][of] + step], known[found[more, 2][of] + step], size[more][of] - step)
            same[more[of[part]]] = False
        return same

    def rows(self, block: tk.Block) -> Iterator[np.ndarray]:
        """Each text's ids, without the end token."""
        wide = np.zeros(block.rows, bool)
        odd = np.flatnonzero((block.data >= 0xE1) & (block.data <= 0xE3) | (block.data == 0xC2) | (block.data >= 0x1C) & (block.data <= 0x1F))
        texts: dict[int, str] = {}
        for r in np.unique(block.row_of(odd)):
            s = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes().decode(errors="replace")
            if _WIDE_SPACE.search(s):
                wide[r], texts[int(r)] = True, s
        ids, at, wrong = self.block(block)
        for r in wrong:
            wide[r], texts[int(r)] = True, block.data[block.offsets[r] : block.offsets[r + 1]].tobytes().decode(errors="replace")
        for r in range(block.rows):
            yield np.array(self._encode([texts[r]])[0], np.int32) if wide[r] else ids[at[r] : at[r + 1]]


_tokenizers: dict = {}  # a Python worker serves many tasks; what is kept doesn't grow


def tokenizer_at(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = Tokenizer.from_file(path)
        give_back()
    return _tokenizers[path]


def cut(length: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``limit`` but for a first one that may be shorter."""
    first = length - (max(1, -(-length // limit)) - 1) * limit
    return [(0, first)] + [(s, limit) for s in range(first, length, limit)]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document, as PIECES has them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_at(tokenizer_path))
        for batch in batches:
            for block in tk.blocks(batch.column("text"), 2 * tk.BLOCK):
                ids = batch.column("doc_id").slice(block.first_row, block.rows).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for doc_id, own in zip(ids, encoder.rows(block)):
                    own = np.append(own, end_id).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(own), limit)):
                        for to, v in zip(out, (doc_id, k, start, length, zlib.crc32(own[start : start + length].tobytes()))):
                            to.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(freeing(run), PIECES)


class Rooms:
    """Open sequences by what room they have left: a segment tree over capacities 1..limit."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.count = np.zeros(2 * self.size, np.int64).tolist()
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def push(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least room of at least ``need``, and that room."""
        node, count = need + self.size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until there is something to the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length; lengths must be in falling order."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, used = Rooms(limit), 0
    for k, n in enumerate(lengths.tolist()):
        found = rooms.pop_tightest(n) if n < limit else None
        if found is None:
            found, used = (used, limit), used + 1
        sequence[k], offset[k] = found[0], limit - found[1]
        rooms.push(found[1] - n, found[0])
    return sequence, offset


def pack(made: DataFrame, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``made`` must be a written table, as it is read twice."""
    ship(made.sparkSession)
    groups = max(1, -(-made.count() // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        table = table.drop_columns(["g"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), limit)
        return table.append_column("sequence_id", pa.array(sequence * groups + group)).append_column("offset", pa.array(offset))

    # the row's number keeps pieces apart whose ids are null or equal
    dealt = made.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.put(pieces(docs, tokenizer_path, limit), "pieces"), limit)
