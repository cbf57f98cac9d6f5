"""Write modes as transforms of old and new rows (survey K01-K11, D01, D08). Each returns what the table should hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RejectedRows(ValueError):
    """Raised by ``require`` with the first errors found."""


def require(errors: DataFrame, most: int = 25) -> None:
    """Nothing is written if there is any error; at most ``most`` are reported."""
    found = errors.limit(most).collect()
    if found:
        raise RejectedRows("; ".join(str(tuple(r)) for r in found))


def replace_slice(old: DataFrame, new: DataFrame, slice_: Column) -> DataFrame:
    """The slice's old rows go."""
    return old.where(~F.coalesce(slice_, F.lit(False))).unionByName(new)


def write_slice(new: DataFrame, path: str, *partitions: str) -> None:
    """K02 on files: only the partitions that ``new`` has are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def replace_keys(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows whose key is in the file go."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def _null_safe(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], update: tuple[str, ...] | None = None, keep_if_blank: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key; ``update`` names the columns that change (all by default), those in ``keep_if_blank`` only if the new value isn't blank."""
    update = tuple(c for c in old.columns if c not in keys) if update is None else update
    joined = old.alias("o").withColumn("__o", F.lit(True)).join(new.alias("n").withColumn("__n", F.lit(True)), _null_safe(keys), "full_outer")
    there, came = F.col("__o").isNotNull(), F.col("__n").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        fresh = came if c in update else came & ~there
        if c in keep_if_blank:
            fresh = fresh & (~there | (F.coalesce(F.col(f"n.{c}"), F.lit("")) != ""))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")

    return joined.select(*(pick(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is there already are ignored; of new rows with one key one stays."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def sparse_overwrite(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One column takes the new value where there is one."""
    fresh = new.select(*keys, F.col(column).alias("__v"))
    return old.join(fresh, keys, "left").withColumn(column, F.coalesce("__v", column)).select(*old.columns)
