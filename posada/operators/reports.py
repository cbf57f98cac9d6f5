"""Metrics of read documents, with lines and taxes compared as multisets, and the report of a base against a trained model.

Lines are compared by counts: of every (document, values) both sides are counted, and what they have in common are matches. So equal lines
count as often as they stand, order doesn't matter, and no pair of lines is ever formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posada.operators.evaluation import rate


def tallies(sides: dict[str, DataFrame], columns: list[str], amount: str | None = None) -> DataFrame:
    """(columns, one count by side's name): how often each table holds each distinct row, told by one aggregate over all tables; with ``amount`` its sum too, as ``<name>_suma``. Missing values are values."""
    of = [F.col(amount).alias("__a")] if amount else []
    tagged = [df.select(*columns, *of, F.lit(k).alias("__side")) for k, df in enumerate(sides.values())]
    counts = [F.count_if(F.col("__side") == k).alias(name) for k, name in enumerate(sides)]
    sums = [F.sum(F.when(F.col("__side") == k, F.col("__a"))).alias(f"{name}_suma") for k, name in enumerate(sides) if amount]
    return reduce(DataFrame.unionByName, tagged).groupBy(*columns).agg(*counts, *sums)


def matches(truth: DataFrame, predicted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, acertadas, sobran, faltan, iguales): lines in common, only predicted, only true, and whether both sides are the same multiset. Missing values are values."""
    both = tallies({"__t": truth, "__p": predicted}, [*keys, *values])
    t, p = F.col("__t"), F.col("__p")
    common = F.least(t, p)
    return both.groupBy(*keys).agg(F.sum(common).alias("acertadas"), F.sum(p - common).alias("sobran"), F.sum(t - common).alias("faltan"), F.bool_and(t == p).alias("iguales"))


def line_scores(found: DataFrame) -> DataFrame:
    """One row of ``matches``: precision, recall and the share of documents whose lines are all right."""
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("acertadas", "sobran", "faltan")), F.count_if("iguales").alias("iguales"), F.count("*").alias("n"))
    tp = F.col("acertadas")
    return sums.select("acertadas", "sobran", "faltan", rate(tp, tp + F.col("sobran")).alias("precision"), rate(tp, tp + F.col("faltan")).alias("recall"), rate(F.col("iguales"), F.col("n")).alias("documentos_iguales"))


def document_metrics(results: DataFrame) -> DataFrame:
    """(metrica, valor, n) over documents (error, cuadra, debe_cuadrar, revisar, lineas, lineas_leidas, impuestos_iguales).

    Documents with an error count as failures only; ``lineas`` and ``impuestos_iguales`` are null where the truth has none.
    """
    one = F.struct("error", "cuadra", "debe_cuadrar", "revisar", "lineas", "lineas_leidas", "impuestos_iguales")
    return _metrics(results.select(one.alias("r")), ["r"]).select("metrica", "r.valor", "r.n")


def _metrics(results: DataFrame, names: list[str]) -> DataFrame:
    """(metrica, a struct (valor, n) by name) of documents that hold a struct of ``document_metrics``' columns by name; one aggregate tells all."""
    by_name = {name: _hits(F.col(name)) for name in names}
    sums = results.agg(*(F.struct(F.count_if(hit & of).alias("k"), F.count_if(of).alias("n")).alias(f"{name}_{what}") for name, hits in by_name.items() for what, (hit, of) in hits.items()))
    part = lambda name, what: F.struct(rate(F.col(f"{name}_{what}.k"), F.col(f"{name}_{what}.n")).alias("valor"), F.col(f"{name}_{what}.n").alias("n")).alias(name)
    rows = F.explode(F.array(*(F.struct(F.lit(what).alias("metrica"), *(part(name, what) for name in names)) for what in by_name[names[0]])))
    return sums.select(rows.alias("r")).select("r.*")


def _hits(r: Column) -> dict[str, tuple[Column, Column]]:
    """By metric what hits, and among which documents."""
    ok = r["error"].isNull()
    return {
        "fallos": (~ok, F.lit(True)), "reconciliacion": (r["cuadra"].eqNullSafe(F.coalesce(r["debe_cuadrar"], F.lit(True))), ok), "revision": (F.coalesce(r["revisar"], F.lit(False)), ok),
        "numero_de_lineas": (r["lineas"].eqNullSafe(r["lineas_leidas"]), ok & r["lineas"].isNotNull()), "impuestos": (r["impuestos_iguales"], ok & r["impuestos_iguales"].isNotNull()),
    }


def compared_documents(results: DataFrame, names: list[str]) -> DataFrame:
    """Q31: as ``compared``, of documents that hold each reading's columns of ``document_metrics`` in a struct of its name, so that all readings are told from one table."""
    return _changes(_metrics(results, names).select("metrica", *(F.col(f"{n}.valor").alias(n) for n in names)), names)


def compared(reports: dict[str, DataFrame]) -> DataFrame:
    """Q31: reports (metrica, valor) side by side, one column each, and the change from the first to the last."""
    names = list(reports)
    parts = [df.select("metrica", *(F.col("valor").alias(n) if n == name else F.lit(None).cast("double").alias(n) for n in names)) for name, df in reports.items()]
    met = reduce(DataFrame.unionByName, parts).groupBy("metrica").agg(*(F.max(n).alias(n) for n in names))
    return _changes(met, names)


def _changes(met: DataFrame, names: list[str]) -> DataFrame:
    return met.withColumn("cambio", F.round(F.col(names[-1]) - F.col(names[0]), 4))
