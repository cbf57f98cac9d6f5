"""Q08 over the driver's tables: every line item is booked twice, to the account of its part and against that of its supplier, so entries balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import accounts, ledger, statements
from posada.plans.driver_queries import register
from posada.plans.mapping import ASIENTO, asiento, cents, read

YEAR = 1995
#: statement, section, side, line, above, accounts, sums, takes the year's result
FORM = (
    ("balance", 0, "deudor", "A.I", None, "2", (), False), ("balance", 0, "deudor", "A.II", None, "3, 5", (), False), ("balance", 0, "deudor", "A.III", None, "4", (), False), ("balance", 0, "deudor", "TA", None, "", ("A.I", "A.II", "A.III"), False),
    ("balance", 1, "acreedor", "P.I", None, "10, 11, 12", (), False), ("balance", 1, "acreedor", "P.I.r", "P.I", "", (), True), ("balance", 1, "acreedor", "P.II", None, "1, 4", (), False), ("balance", 1, "acreedor", "TP", None, "", ("P.I", "P.II"), False),
    ("pyg", 0, "acreedor", "1", None, "7", (), False), ("pyg", 0, "acreedor", "2", None, "(6)", (), False), ("pyg", 0, "acreedor", "D", None, "", ("1", "2"), False),
    ("ecpn", 0, "acreedor", "RA", None, "", ("pyg:D",), False), ("ecpn", 0, "acreedor", "T", None, "", ("RA", "balance:P.I", "S"), False), ("ecpn", 0, "acreedor", "S", None, "", ("balance:P.II", "pyg:1"), False),
)

_BOOKED = f"""WITH {ASIENTO}, booked AS (
  SELECT l_orderkey AS id, CAST(l_partkey % 7 + 1 AS VARCHAR) || lpad(CAST(l_suppkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS cuenta, CAST(l_extendedprice AS DECIMAL(14,2)) AS v FROM lineitem
  UNION ALL SELECT l_orderkey, CAST(l_suppkey % 7 + 1 AS VARCHAR) || lpad(CAST(l_partkey * 7919 % 10000000 AS VARCHAR), 7, '0'), -CAST(l_extendedprice AS DECIMAL(14,2)) FROM lineitem),
s AS (SELECT cuenta, a.ejercicio AS y, sum(v) AS todo, sum(v) FILTER (a.tipo <> 'regularizacion') AS curso FROM booked b JOIN asiento a ON a.id = b.id WHERE a.estado = 'contabilizado' AND a.tipo <> 'cierre' AND a.ejercicio IN ({YEAR}, {YEAR - 1}) GROUP BY 1, 2),
v AS (SELECT y, coalesce(sum(todo) FILTER (left(cuenta, 1) = '2'), 0) AS a1, coalesce(sum(todo) FILTER (left(cuenta, 1) IN ('3', '5')), 0) AS a2, coalesce(sum(todo) FILTER (left(cuenta, 1) = '4' AND todo > 0), 0) AS a3,
    coalesce(-sum(todo) FILTER (left(cuenta, 2) IN ('10', '11', '12')), 0) AS p1, coalesce(-sum(todo) FILTER (left(cuenta, 1) IN ('6', '7')), 0) AS r, coalesce(-sum(todo) FILTER (left(cuenta, 1) = '1' AND left(cuenta, 2) NOT IN ('10', '11', '12') OR left(cuenta, 1) = '4' AND todo < 0), 0) AS p2,
    coalesce(-sum(curso) FILTER (left(cuenta, 1) = '7'), 0) AS i, coalesce(-sum(curso) FILTER (left(cuenta, 1) = '6'), 0) AS g FROM s GROUP BY 1),
l AS (SELECT y, unnest([
    {{'e': 'balance', 'k': 'A.I', 'v': a1}}, {{'e': 'balance', 'k': 'A.II', 'v': a2}}, {{'e': 'balance', 'k': 'A.III', 'v': a3}}, {{'e': 'balance', 'k': 'TA', 'v': a1 + a2 + a3}}, {{'e': 'balance', 'k': 'P.I', 'v': p1 + r}}, {{'e': 'balance', 'k': 'P.I.r', 'v': r}}, {{'e': 'balance', 'k': 'P.II', 'v': p2}}, {{'e': 'balance', 'k': 'TP', 'v': p1 + r + p2}},
    {{'e': 'pyg', 'k': '1', 'v': i}}, {{'e': 'pyg', 'k': '2', 'v': g}}, {{'e': 'pyg', 'k': 'D', 'v': i + g}}, {{'e': 'ecpn', 'k': 'RA', 'v': i + g}}, {{'e': 'ecpn', 'k': 'S', 'v': p2 + i}}, {{'e': 'ecpn', 'k': 'T', 'v': i + g + p1 + r + p2 + i}}]) AS x FROM v)"""


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines, two for each line item."""
    li = read(spark, sf_dir, "lineitem")
    code = lambda a, b: F.concat((F.col(a) % 7 + 1).cast("string"), F.lpad((F.col(b) * 7919 % 10000000).cast("string"), 7, "0"))
    none, price = F.lit(0).cast("decimal(14,2)"), cents("l_extendedprice")
    sides = F.array(F.struct(code("l_partkey", "l_suppkey").alias("cuenta"), price.alias("debe"), none.alias("haber")), F.struct(code("l_suppkey", "l_partkey").alias("cuenta"), none.alias("debe"), price.alias("haber")))
    return li.select(F.col("l_orderkey").alias("asiento_id"), F.col("l_linenumber").cast("long").alias("orden"), F.explode(sides).alias("x")).select("asiento_id", "orden", "x.*", F.lit("").alias("punteo"), F.lit("").alias("concepto"))


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spark.createDataFrame([(e, s, side, ref, up, k, codes, list(f), result) for k, (e, s, side, ref, up, codes, f, result) in enumerate(FORM)], statements.MODEL)
    return accounts.annual_accounts(ledger.with_headers(booked(spark, sf_dir), asiento(spark, sf_dir)), model, (YEAR, YEAR - 1))[0]


@register("q08_annual_accounts", _BOOKED + f"SELECT x.e AS estado, x.k AS ref, CAST(coalesce(sum(x.v) FILTER (y = {YEAR}), 0) AS DECIMAL(24,2)) AS actual, CAST(coalesce(sum(x.v) FILTER (y = {YEAR - 1}), 0) AS DECIMAL(24,2)) AS anterior FROM l GROUP BY 1, 2")
def q08_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir).select("estado", "ref", "actual", "anterior")


@register("q08_balance_sheet_agrees", _BOOKED + f"""SELECT CAST(coalesce(sum(x.v) FILTER (x.k = 'TA' AND y = {YEAR}), 0) AS DECIMAL(24,2)) AS activo_actual, CAST(coalesce(sum(x.v) FILTER (x.k = 'TA' AND y = {YEAR - 1}), 0) AS DECIMAL(24,2)) AS activo_anterior,
  CAST(coalesce(sum(x.v) FILTER (x.k = 'TP' AND y = {YEAR}), 0) AS DECIMAL(24,2)) AS pasivo_actual, CAST(coalesce(sum(x.v) FILTER (x.k = 'TP' AND y = {YEAR - 1}), 0) AS DECIMAL(24,2)) AS pasivo_anterior, TRUE AS cuadra FROM l""")
def q08_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.sheet_check(_accounts(spark, sf_dir), "TA", "TP")
