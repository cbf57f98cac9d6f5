"""A42, Q31 over ``lineitem``: orders as documents, and two readings of them that lose, double and alter lines by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import reports
from posada.plans.driver_queries import register
from posada.plans.mapping import read

_TRUTH = "verdad AS (SELECT l_orderkey AS documento, CAST(l_quantity AS BIGINT) AS cantidad, CAST(round(l_extendedprice * 100) AS BIGINT) AS importe, l_returnflag AS f, l_linestatus AS e, l_linenumber AS k FROM lineitem)"


def _read_sql(name: str, good: bool) -> str:
    """Lines of number 4 are lost, first returned ones come twice, those of status F lose a cent; the better reading does the first only."""
    price = "importe" if good else "CASE WHEN e = 'F' AND f = 'A' THEN importe - 1 ELSE importe END"
    twice = "" if good else f" UNION ALL SELECT documento, cantidad, {price}, f FROM verdad WHERE f = 'R' AND k = 1"
    return f"{name} AS (SELECT documento, cantidad, {price} AS importe, f FROM verdad WHERE k <> 4{twice})"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("documento"), F.col("l_quantity").cast("long").alias("cantidad"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("importe"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("e"), F.col("l_linenumber").alias("k"))
    off = rows.withColumn("importe", F.when((F.col("e") == "F") & (F.col("f") == "A"), F.col("importe") - 1).otherwise(F.col("importe")))
    base = off.where("k <> 4").unionByName(off.where("f = 'R' AND k = 1"))
    return rows, base, rows.where("k <> 4")


def _match_sql(name: str) -> str:
    return f"""SELECT documento, sum(least(t, p))::BIGINT AS acertadas, sum(p - least(t, p))::BIGINT AS sobran, sum(t - least(t, p))::BIGINT AS faltan, bool_and(t = p) AS iguales FROM (
      SELECT documento, cantidad, importe, sum(t) AS t, sum(p) AS p FROM (SELECT documento, cantidad, importe, 1 AS t, 0 AS p FROM verdad UNION ALL SELECT documento, cantidad, importe, 0, 1 FROM {name}) GROUP BY 1, 2, 3) GROUP BY 1"""


@register("a42_line_matches", f"WITH {_TRUTH}, {_read_sql('leido', False)} {_match_sql('leido')}")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, base, _ = _tables(spark, sf_dir)
    return reports.matches(truth, base, ["documento"], ["cantidad", "importe"])


def _results(truth: DataFrame, readings: dict[str, DataFrame]) -> DataFrame:
    """Documents of the truth as ``compared_documents`` takes them: one without a line was not read, sums should agree, returned lines are looked at, flags stand for taxes."""
    lines = reports.tallies({"verdad": truth, **readings}, ["documento", "f"], "importe")
    sums = lambda n: (F.sum(n).alias(n), F.sum(f"{n}_suma").alias(f"{n}_suma"), F.sum(F.when(F.col("f") == "R", F.col(n))).alias(f"{n}_r"), F.bool_and(F.col("verdad") == F.col(n)).alias(f"{n}_iguales"))
    met = lines.groupBy("documento").agg(*(c for n in ("verdad", *readings) for c in sums(n))).where("verdad > 0 AND documento IS NOT NULL")

    def reading(n: str) -> Column:
        error = F.when(F.col(n) == 0, "sin lineas")
        return F.struct(
            error.alias("error"), (F.col("verdad_suma") == F.col(f"{n}_suma")).alias("cuadra"), F.lit(True).alias("debe_cuadrar"), (F.col(f"{n}_r") > 1).alias("revisar"),
            F.col("verdad").alias("lineas"), F.col(n).alias("lineas_leidas"), F.col(f"{n}_iguales").alias("impuestos_iguales"),
        ).alias(n)

    return met.select(*(reading(n) for n in readings))


def _report_sql(name: str) -> str:
    return f"""(WITH t AS (SELECT documento, count(*) AS n, sum(importe) AS s FROM verdad GROUP BY 1), g AS (SELECT documento, count(*) AS n, sum(importe) AS s, count(*) FILTER (f = 'R') AS r FROM {name} GROUP BY 1),
      x AS (SELECT documento, bool_and(a = b) AS same FROM (SELECT documento, f, sum(a) AS a, sum(b) AS b FROM (SELECT documento, f, 1 AS a, 0 AS b FROM verdad UNION ALL SELECT documento, f, 0, 1 FROM {name}) GROUP BY 1, 2) GROUP BY 1),
      d AS (SELECT g.n IS NOT NULL AS ok, t.s = g.s AS c, g.r > 1 AS v, t.n = g.n AS l, x.same FROM t LEFT JOIN g ON g.documento = t.documento JOIN x ON x.documento = t.documento)
      SELECT unnest(['fallos', 'reconciliacion', 'revision', 'numero_de_lineas', 'impuestos']) AS metrica, unnest([round(count(*) FILTER (NOT ok) / count(*), 4), round(count(*) FILTER (ok AND c) / nullif(count(*) FILTER (ok), 0), 4), round(count(*) FILTER (ok AND v) / nullif(count(*) FILTER (ok), 0), 4),
        round(count(*) FILTER (ok AND l) / nullif(count(*) FILTER (ok), 0), 4), round(count(*) FILTER (ok AND same) / nullif(count(*) FILTER (ok), 0), 4)]) AS valor FROM d)"""


@register("q31_compared_report", f"WITH {_TRUTH}, {_read_sql('uno', False)}, {_read_sql('dos', True)} SELECT a.metrica, a.valor AS base, b.valor AS entrenado, round(b.valor - a.valor, 4) AS cambio FROM {_report_sql('uno')} a JOIN {_report_sql('dos')} b ON b.metrica = a.metrica")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, base, better = _tables(spark, sf_dir)
    return reports.compared_documents(_results(truth, {"base": base, "entrenado": better}), ["base", "entrenado"])


@register("q31_line_scores", f"WITH {_TRUTH}, {_read_sql('leido', False)}, m AS ({_match_sql('leido')}) SELECT sum(acertadas)::BIGINT AS acertadas, sum(sobran)::BIGINT AS sobran, sum(faltan)::BIGINT AS faltan, round(sum(acertadas) / sum(acertadas + sobran), 4) AS precision, round(sum(acertadas) / sum(acertadas + faltan), 4) AS recall, round(count(*) FILTER (iguales) / count(*), 4) AS documentos_iguales FROM m")
def q31_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, base, _ = _tables(spark, sf_dir)
    return reports.line_scores(reports.matches(truth, base, ["documento"], ["cantidad", "importe"]))
