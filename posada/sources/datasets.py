"""A dataset of examples as JSON lines by split, with a manifest that is written last and checked by the reader.

A folder without a manifest is an export that wasn't finished. The manifest has a row for each split and label source with its number of examples and a digest that
doesn't depend on their order, so that a lost, repeated or altered example shows, whatever the files are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from posada.operators.evaluation import split_dataset

FORMAT = "posada-dataset/1"
SPLITS = ("train", "val", "test")


class BrokenDataset(ValueError):
    """An export that can't be used: not finished, not whole, or with examples of one content in two splits."""


def _line(columns: list[str]) -> Column:
    """A row as JSON with its columns by name, as the digest sees it before writing and after reading."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def manifest_of(examples: DataFrame, source: str | None = None) -> DataFrame:
    """(split, origen, n, huella): counts and digests; the digest is the sum of 32-bit pieces of each row's SHA-256, so copies count."""
    sha = F.sha2(_line([c for c in examples.columns if c != "split"]).cast("binary"), 256)
    piece = lambda k: F.sum(F.conv(F.substring("__sha", k, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    rows = examples.select("split", (F.col(source) if source else F.lit("")).alias("origen"), sha.alias("__sha"))
    return rows.groupBy("split", "origen").agg(F.count("*").alias("n"), F.concat_ws("-", *(piece(k) for k in (1, 9, 17, 25))).alias("huella"))


def leaks(examples: DataFrame, *content: str) -> DataFrame:
    """(content, splits): contents that stand in more than one split; missing values are values."""
    sets = examples.groupBy(*content).agg(F.array_sort(F.collect_set("split")).alias("splits"))  # three at most
    return sets.where(F.size("splits") > 1)


def export(examples: DataFrame, folder: str, key: str, content: tuple[str, ...], val: float = 0.1, test: float = 0.15, source: str | None = None) -> DataFrame:
    """Writes examples by the split that their ``key`` draws and returns the manifest.

    Refuses, before anything is written, examples without a key and contents that would stand in two splits (their key is no key of the content),
    and a folder that is there already. A job that is lost while it writes leaves no manifest.
    """
    if "split" in examples.columns:
        raise ValueError("examples have a column split already")
    parted = split_dataset(examples, key, val, test)
    found = parted.where(F.col(key).isNull()).limit(1).count()
    if found:
        raise BrokenDataset(f"examples without {key}")
    leaked = leaks(parted, *content).limit(5).collect()
    if leaked:
        raise BrokenDataset(f"contents in several splits, such as {leaked[0].asDict()}")
    session = examples.sparkSession
    parted.write.partitionBy("split").option("ignoreNullFields", "false").json(f"{folder}/examples")  # fails if it is there
    written = _examples(session, folder, examples.schema)
    manifest = manifest_of(written, source).withColumns({"formato": F.lit(FORMAT), "val": F.lit(val), "test": F.lit(test), "clave": F.lit(key), "fuente": F.lit(source)})
    manifest.coalesce(1).write.json(f"{folder}/manifest")  # a few rows
    return session.read.json(f"{folder}/manifest")


def _examples(session: SparkSession, folder: str, schema: StructType) -> DataFrame:
    made = StructType([*schema.fields]).add("split", "string")
    return session.read.schema(made).option("mode", "FAILFAST").json(f"{folder}/examples")


def read(session: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The examples of a whole export, with their split; raises ``BrokenDataset`` for one that isn't finished or isn't what its manifest says."""
    from pyspark.errors import AnalysisException

    try:
        manifest = session.read.schema("split string, origen string, n long, huella string, formato string, fuente string").json(f"{folder}/manifest")
    except AnalysisException as e:
        raise BrokenDataset(f"{folder} has no manifest: the export wasn't finished") from e
    form = manifest.select("formato", "fuente").distinct().collect()
    if [r.formato for r in form] not in ([FORMAT], []):
        raise BrokenDataset(f"{folder} has another format")
    examples = _examples(session, folder, schema)
    there = manifest_of(examples, form[0].fuente if form else None)
    said, got = manifest.select("split", "origen", "n", "huella").alias("m"), there.alias("t")
    same = F.col("m.split").eqNullSafe(F.col("t.split")) & F.col("m.origen").eqNullSafe(F.col("t.origen")) & F.col("m.n").eqNullSafe(F.col("t.n")) & F.col("m.huella").eqNullSafe(F.col("t.huella"))
    off = said.join(got, same, "full_outer").where(F.col("m.n").isNull() | F.col("t.n").isNull()).select(F.coalesce("m.split", "t.split").alias("split")).distinct().collect()
    if off:
        raise BrokenDataset(f"examples of {', '.join(sorted(str(r.split) for r in off))} aren't those of the manifest")
    return examples
