"""Exports (survey K12-K17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spanish_text(df: DataFrame) -> DataFrame:
    """Decimals with a comma, dates as dd/mm/yyyy, all else as text."""
    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("decimal") or kind in ("double", "float"):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(","))
        elif kind == "date":
            c = F.date_format(c, "dd/MM/yyyy")
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, a header, and a byte-order mark before its first name so that spreadsheets know it is UTF-8."""
    text = spanish_text(df)
    first = text.columns[0]
    text.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, sep=";", header=True)


def invoice_documents(invoices: DataFrame, lines: DataFrame, taxes: DataFrame) -> DataFrame:
    """One JSON document for each invoice, with lines and taxes nested in order."""
    nest = lambda df, order, name: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in df.columns if c not in ("document_id", order))))).alias(name))
    joined = invoices.join(nest(lines, "orden", "lineas"), "document_id", "left").join(nest(taxes, "tipo", "impuestos"), "document_id", "left")
    head = [c for c in invoices.columns if c != "document_id"]
    return joined.select("document_id", F.to_json(F.struct(F.lit("factura/1").alias("formato"), *head, "lineas", "impuestos")).alias("json"))


def write_splits(examples: DataFrame, path: str) -> DataFrame:
    """JSON lines below split=..., and a manifest of counts."""
    examples.write.mode("overwrite").partitionBy("split").json(path)
    counts = examples.groupBy("split").agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "-manifest")
    return counts


def label_files(labels: DataFrame, existing: DataFrame) -> DataFrame:
    """(nombre, json) of labels to write: equal stems get a suffix, names that exist stay unless the label was corrected."""
    from posada.operators.shapes import suffix_repeats

    named = suffix_repeats(labels, [], "stem", "document_id")
    kept = existing.select(F.col("nombre").alias("stem")).withColumn("hay", F.lit(True))
    return named.join(kept, "stem", "left").where(F.col("hay").isNull() | F.col("corregido")).select(F.col("stem").alias("nombre"), "json")
