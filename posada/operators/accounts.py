"""Q08, UD06: annual accounts, several statements of one model whose lines refer to each other.

A model is a table (``statements.MODEL``): lines take accounts, stand below other lines, or sum lines of their own statement or, as
``statement:line``, of another. Every line is thus a sum of lines that take accounts, so the whole model is resolved once, in order of dependence, into
how often each line counts each of those; a cycle is an error that names its lines. The values are then one join of the accounts' balances
with that table and one aggregate, however deep the model is.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.functions.numbers import money, zero_if_null
from posada.operators.statements import assign, year_balances

Key = tuple[str, str]


def resolved(lines: list) -> dict[Key, Counter]:
    """Of each (statement, line) how often it counts each line's own accounts; names of lines that don't exist count as nothing."""
    by = {(r["estado"], r["ref"]): r for r in lines}
    below: dict[Key, list[Key]] = {}
    for (statement, ref), r in by.items():
        if r["padre"]:
            below.setdefault((statement, r["padre"]), []).append((statement, ref))
    done: dict[Key, Counter] = {}

    def go(key: Key, open_: list[Key]) -> Counter:
        if key in open_:
            raise ValueError("lines that sum each other: " + " -> ".join(":".join(k) for k in [*open_[open_.index(key) :], key]))
        if key not in done:
            formula = by[key]["formula"] or []
            parts = [tuple(p.split(":", 1)) if ":" in p else (key[0], p) for p in formula] if formula else below.get(key, [])
            made = Counter() if formula else Counter({key: 1})
            for part in parts:
                if part in by:
                    made.update(go(part, [*open_, key]))
            done[key] = made
        return done[key]

    for key in by:
        go(key, [])
    return done


def annual_accounts(lines: DataFrame, model: DataFrame, years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(estado, seccion, ref, orden, actual, anterior) of every line, and (estado, cuenta, columna, saldo) of accounts that have none.

    The balance sheet's line marked ``resultado`` also takes what groups 6 and 7 still hold. The model is a form of some hundred lines.
    """
    spark, form = lines.sparkSession, model.collect()
    own, left = None, None
    for statement in sorted({r["estado"] for r in form}):
        balances = year_balances(lines, statement, years)
        if statement == "balance":
            results = [r["ref"] for r in form if r["estado"] == statement and r["resultado"]]
            pending = balances.where(F.left("cuenta", F.lit(1)).isin("6", "7")).groupBy("columna").agg(money(-F.sum("saldo")).alias("v"))
            more = pending.select(F.explode(F.array(*(F.lit(r) for r in results))).alias("ref"), "columna", "v") if results else None
            balances = balances.where(~F.left("cuenta", F.lit(1)).isin("6", "7"))
        else:
            more = None
        placed = assign(balances, model.where(F.col("estado") == statement))
        direct = placed.where("ref IS NOT NULL").select("ref", "columna", money(F.when(F.col("signo") == "deudor", F.col("saldo")).otherwise(-F.col("saldo"))).alias("v"))
        direct = (direct if more is None else direct.unionByName(more)).select(F.lit(statement).alias("de"), F.col("ref").alias("linea"), "columna", "v")
        rest = placed.where("ref IS NULL").select(F.lit(statement).alias("estado"), "cuenta", "columna", "saldo")
        own, left = (direct, rest) if own is None else (own.unionByName(direct), left.unionByName(rest))
    table = [(s, r, a, b, n) for (s, r), parts in resolved(form).items() for (a, b), n in parts.items()]
    # lines are summed before they meet the table
    sums = own.groupBy("de", "linea", "columna").agg(F.sum("v").alias("v"))
    counted = spark.createDataFrame(table, "estado string, ref string, de string, linea string, veces int").join(sums, ["de", "linea"])
    of = lambda k: money(zero_if_null(F.sum(F.when(F.col("columna") == k, F.col("v") * F.col("veces")))))
    values = counted.groupBy("estado", "ref").agg(of(0).alias("actual"), of(1).alias("anterior"))
    shown = model.select("estado", "seccion", "ref", "orden").join(values, ["estado", "ref"], "left")
    return shown.select("estado", "seccion", "ref", "orden", *(money(zero_if_null(F.col(c))).alias(c) for c in ("actual", "anterior"))), left


def sheet_check(values: DataFrame, assets: str, liabilities: str) -> DataFrame:
    """One row: the balance sheet's two totals in both years, and whether they agree."""
    rows = values.where(F.col("estado") == "balance")
    one = lambda ref, c: F.sum(F.when(F.col("ref") == ref, F.col(c)))
    sums = rows.agg(*(one(ref, c).alias(f"{name}_{c}") for name, ref in (("activo", assets), ("pasivo", liabilities)) for c in ("actual", "anterior")))
    return sums.withColumn("cuadra", (F.col("activo_actual") == F.col("pasivo_actual")) & (F.col("activo_anterior") == F.col("pasivo_anterior")))
