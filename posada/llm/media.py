"""Media columns over content-addressed payloads in tar shards.

``store`` turns each text into a payload (UTF-8, padded with bytes 255 to a positive
multiple of ``UNIT``), encodes it losslessly as an 8-bit greyscale PNG of width ``UNIT``
and appends it to a tar shard of its task as a member named by the SHA-256 of the stored
form. The manifest has one row for each document: digest, shard, offset, length. A task
stores a digest once; where tasks stored the same digest, ``members`` takes
the copy in the first shard for all. Shards are named by task attempt, and only the
manifest, which is written to a table before anything reads it, says which ones count:
a task that is run again leaves at worst a shard that no row names.

Each member is read once, however many documents have its digest, in order of shard and offset: ``metadata``
fills the columns of width, height and depth from the first ``HEADER`` bytes alone; ``read_back`` reads the
member's whole range for the features, which need the samples. A join by digest that splits frequent ones brings both to the
documents.

Defined cases: a null or empty text is a payload of one unit of bytes 255; equal texts
have equal values; repeated rows and rows without an id are rows of the manifest, not members; an empty table
gives an empty manifest and no shard; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.llm import text as tk
from posada.llm.shared import Scratch, ship, spread_join

UNIT = 576
SHARD_BYTES = 128 << 20
HEADER = 33  # signature and IHDR of a PNG
LEVEL = 1
READ_BYTES = 32 << 20  # of members that a reading task should get
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = (
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
)


def payload_of(raw: bytes) -> bytes:
    """Bytes padded with 255 to a positive multiple of UNIT."""
    return raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit greyscale PNG, row by row, without filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a PNG's first HEADER bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decode(stored: bytes) -> bytes:
    """The samples of a PNG that ``encode`` made."""
    width, height, _, _ = header(stored[:HEADER])
    at, body = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            body.append(stored[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Figures of the samples: their mean, spread and number of values, in thousandths where not whole."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values, n = np.arange(256), int(counts.sum())
    total, squares = int(counts @ values), int(counts @ (values * values))
    return f"mean={1000 * total // n};var={(1000 * (n * squares - total * total)) // (n * n)};values={int((counts > 0).sum())}"


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header block."""
    block = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        block[at : at + len(value)] = value
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


class ShardWriter:
    """Appends members to tar shards of bounded size, each digest once."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.limit, self.stem = limit, uuid.uuid4().hex
        self.out, self.name, self.at, self.number = None, "", 0, 0
        self.known: dict[str, tuple[str, int, int]] = {}

    def add(self, stored: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of the member, new or there already."""
        digest = hashlib.sha256(stored).hexdigest()
        if digest not in self.known:
            if self.out is None or self.at > self.limit:
                self.close()
                self.name = f"{self.stem}-{self.number:05d}.tar"
                self.number += 1
                self.out, self.at = self.files.open_output_stream(f"{self.root}/{self.name}"), 0
            self.out.write(_tar_header(f"{digest}.png", len(stored)))
            self.out.write(stored)
            self.out.write(b"\0" * (-len(stored) % 512))
            self.known[digest] = (self.name, self.at + 512, len(stored))
            self.at += 512 + len(stored) + -len(stored) % 512
        return (digest, *self.known[digest])

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards below ``folder``; the manifest's rows as MANIFEST has them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        try:
            for batch in batches:
                writer = writer or ShardWriter(folder)
                for block in tk.blocks(batch.column("text")):
                    rows = []
                    for r in range(block.rows):
                        raw = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes()
                        rows.append((len(raw), *writer.add(encode(payload_of(raw)))))
                    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(block.first_row, block.rows), *(pa.array(list(x), t) for x, t in zip(zip(*rows), types))],
                        ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                    )
        finally:
            if writer:
                writer.close()

    return docs.select("doc_id", "text").mapInArrow(run, MANIFEST)


def members(manifest: DataFrame) -> DataFrame:
    """Each digest with the number of its documents and one stored copy, the one in the first shard by name: digest, n, shard, offset, length."""
    one = manifest.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("shard", "offset", "length")).alias("m"))
    return one.select("digest", "n", "m.shard", "m.offset", "m.length")


def header_reader(folder: str, names: list[str]):
    """Over batches of members: adds width, height and bit depth, reading HEADER bytes of each and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            with _Ranges(files, root) as ranges:
                heads = [header(ranges.read(s, o, HEADER)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[k] for h in heads], pa.int32()) for k in range(3))], names)

    return run


def metadata(stored: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit depth to members."""
    ship(stored.sparkSession)
    names = [*(f.name for f in stored.schema.fields), "width", "height", "bit_depth"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInArrow(header_reader(folder, names), f"{fields}, width int, height int, bit_depth int")


class _Ranges:
    """Range reads with one open shard at a time."""

    def __init__(self, files: pafs.FileSystem, root: str):
        self.files, self.root, self.name, self.file = files, root, None, None

    def __enter__(self) -> _Ranges:
        return self

    def __exit__(self, *_) -> None:
        if self.file is not None:
            self.file.close()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.__exit__()
            self.name, self.file = shard, self.files.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def read_back(stored: DataFrame, folder: str) -> DataFrame:
    """Adds the READ columns to members: each is read whole, checked against its digest and decoded."""
    ship(stored.sparkSession)
    names = [*(f.name for f in stored.schema.fields), *(n for n, _ in READ)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            out: list[list] = [[] for _ in READ]
            with _Ranges(files, root) as ranges:
                for digest, *at in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                    raw = ranges.read(*at)
                    found = hashlib.sha256(raw).hexdigest()
                    if found != digest:
                        raise ValueError(f"{at} does not hold {digest}")
                    samples = decode(raw)
                    values = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(raw), found, feature(samples))
                    for to, v in zip(out, values):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, (_, t) in zip(out, READ))], names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInArrow(run, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def columns(docs: DataFrame) -> DataFrame:
    """Stores every document and reads it back; the shards stay in the shared folder."""
    scratch = Scratch(docs.sparkSession, "media")
    folder = f"{scratch.path}/shards"
    manifest = scratch.put(store(docs, folder), "manifest")
    stored = scratch.put(members(manifest), "members")
    parts = max(1, -(-(stored.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    read = read_back(metadata(stored.drop("n").repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset"), folder), folder)
    found = spread_join(manifest.select("doc_id", "n_bytes", "digest"), read, "digest", stored.select("digest", "n"), F.monotonically_increasing_id())
    return found.select("doc_id", "n_bytes", *(n for n, _ in READ), "shard", "offset", "width", "height", "bit_depth")
