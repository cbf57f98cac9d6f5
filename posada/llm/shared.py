"""The folder that driver and executors share, and tables written there to cut lineage.

A stage whose result is read more than once, or that must not be computed again with
another outcome, is written as Parquet under ``spark.checkpoint.dir`` and read back. An
executor that is lost later costs no more than its running tasks.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}
_folders: list[str] = []  # of all scratch tables that are still there


def shared_dir(spark: SparkSession) -> str:
    """The URI of ``spark.checkpoint.dir``; only where that is unset, as in local tests, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="posada-")
        atexit.register(shutil.rmtree, _local[app].removeprefix("file://"), ignore_errors=True)
    return _local[app]


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def made_within(into: list[str]) -> Iterator[None]:
    """Adds the folders of all scratch tables that operators make within to a list."""
    before = len(_folders)
    try:
        yield
    finally:
        into += _folders[before:]


def forget(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of scratch tables, when the results that read them have been written."""
    for folder in folders:
        _delete(spark, folder)
    _folders[:] = [f for f in _folders if f not in folders]


class Scratch:
    """A folder of tables for one run of an operator. It stays while the operator's result may be read; ``made_within`` and ``forget`` end it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, tuple[DataFrame, str]] = {}
        _folders.append(self.path)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and reads it back; the shuffle files of the job go as soon as it has ended."""
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEAN_UP, None)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(at)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN_UP)
            else:
                self.spark.conf.set(_CLEAN_UP, before)
        made = self.spark.read.schema(df.schema).parquet(at)
        self._at[id(made)] = (made, at)
        return made

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes df, an operator's result, and deletes all other tables of the folder."""
        others = [t for t, _ in self._at.values()]
        made = self.put(df, name)
        self.drop(*others)
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            _, at = self._at.pop(id(t))
            _delete(self.spark, at)


BATCH_ROWS = 1_000  # rows of a batch that goes to Python: a few MB of texts, not tens
BATCH_BYTES = 2 << 20  # and about its bytes, so that long texts don't add up
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that Python workers can import it, and bounds the session's batches by BATCH_ROWS and BATCH_BYTES."""
    context = spark.sparkContext
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if not 0 < int(re.sub(r"\D", "", spark.conf.get(_BYTES))) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if getattr(context, "_posada_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="posada-code-"), "posada.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(at)
    context._posada_shipped = True


def hashed_sample(df: DataFrame, rows: int, by: Sequence[str] = ("doc_id", "text"), salt: str = "sample") -> DataFrame:
    """About ``rows`` of df's rows that differ in ``by`` (all of those if df is no larger): those whose values there hash below a threshold.

    The threshold follows from the number of rows, so the sample is the same in every run. Rows without an id are told apart by what else
    ``by`` names, and rows equal in all of it count once, so no group of copies or of missing ids passes, or fails, as a whole.
    """
    n = df.count()
    if n > rows:
        u = F.shiftrightunsigned(F.xxhash64(*by, F.lit(salt)), 11).cast("double") * F.lit(2.0**-53)
        df = df.where(u < F.lit(rows / n))
    return df.dropDuplicates(list(by))


BROADCAST_ROWS = 200_000  # rows of one long that a broadcast may have: a few MB


def few(rows: DataFrame) -> DataFrame:
    """Marks a table of single numbers for broadcast if it has BROADCAST_ROWS at most; larger ones are shuffled. Counts it, so it must be cheap to read."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


HOT_SHARE = 2_000  # a key that more than one in so many rows has is split
HOT_ROWS = 1_000  # unless it has fewer rows than this


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], counts: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)``, inner or left, in which no task gets all rows of a frequent key.

    ``counts`` (key, n) says how many rows of ``left`` have each key, and must be cheap to read. No more than HOT_SHARE keys
    can have more than one in HOT_SHARE of all rows; their rows of ``left`` are dealt over parts by a hash of
    ``by``, and the rows of ``right`` are repeated for each part.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return left.join(right, keys, how)
    hot = [(*r[:-1], r["n"] // limit + 1) for r in counts.where(F.col("n") > limit).dropna(subset=keys).select(*keys, "n").collect()]
    if not hot:
        return left.join(right, keys, how)
    schema = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    parts = F.broadcast(left.sparkSession.createDataFrame(hot, f"{schema}, __parts long"))
    part = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("__parts"))).cast("long")
    dealt = left.join(parts, keys, "left").withColumn("__part", part).drop("__parts")
    repeated = right.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(repeated, [*keys, "__part"], how).drop("__part")


def freeing(run, hold: bool = False):
    """A function over Arrow batches that gives the memory of its task back to the system, since a Python worker stays for further tasks. ``hold`` keeps it until then."""

    def wrapped(batches):
        if hold:
            hold_on()
        yield from run(batches)
        give_back()

    return wrapped


HELD = 128 << 20  # bytes at the end of the heap that stay with a process


def hold_on() -> None:
    """Freed memory stays with this process until ``give_back``: arrays of a MB or two otherwise come from the system anew, page by page, for each step of numpy's."""
    if hasattr(c := ctypes.CDLL(None), "mallopt"):
        c.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, HELD)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Returns memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


class BitFilter:
    """A set of longs as a bitmap of fixed size, broadcast: it passes all members and few others.

    The bitmap is made by one aggregation of at most BITS / 64 groups, whatever the input; the more
    members, the more it lets through, so an exact semi-join must follow.
    """

    BITS = 1 << 24

    def __init__(self, members: DataFrame, column: str):
        at = F.pmod(F.xxhash64(column), F.lit(self.BITS))
        word = at.cast("long") % (self.BITS // 64)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(at / (self.BITS // 64)).cast("int"))
        words = members.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
        bitmap = np.zeros(self.BITS // 64, np.int64)
        bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self.shared = members.sparkSession.sparkContext.broadcast(bitmap)

    def test(self, values: np.ndarray) -> np.ndarray:
        at = xxhash64(values) % np.uint64(self.BITS)
        words = self.shared.value.view(np.uint64)
        return (words[(at % np.uint64(self.BITS // 64)).astype(np.int64)] >> (at // np.uint64(self.BITS // 64))) & np.uint64(1) == 1


def xxhash64(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of longs, as uint64."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    roll = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    v = np.asarray(values, np.int64).view(np.uint64)
    h = (np.full(len(v), seed, np.uint64) + p5 + np.uint64(8)) ^ (roll(v * p2, 31) * p1)
    h = roll(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


LAST = (1 << 63) - 1


def row_key() -> tuple[Column, Column]:
    """What tells documents apart: the id, or the largest number for none, and a hash of the text that also says whether there is an id."""
    return F.coalesce("doc_id", F.lit(LAST)).cast("long"), F.xxhash64("text", F.col("doc_id").isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
