"""The driver's tables seen as the engine's tables, in Spark and as DuckDB common table expressions.

Journal lines come from ``lineitem`` and headers from ``orders``; account codes are made
from part and supplier keys so that every level of the plan has several codes. Both forms of
a view must agree column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(name: str) -> F.Column:
    return F.col(name).cast("decimal(14,2)")


def asiento(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal headers."""
    o = read(spark, sf_dir, "orders")
    kind = F.left("o_orderpriority", F.lit(1))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").cast("long").alias("ejercicio"),
        F.to_date("o_orderdate").alias("fecha"),
        F.col("o_orderkey").alias("numero"),
        F.when(kind == "1", "apertura").when(kind == "3", "ajuste").when(kind == "4", "regularizacion").when(kind == "5", "cierre").otherwise("operacion").alias("tipo"),
        F.when(F.col("o_orderstatus") == "F", "contabilizado").when(F.col("o_orderstatus") == "P", "anulado").otherwise("borrador").alias("estado"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("H"), (F.col("o_custkey") % 5).cast("string"))).alias("hoja"),
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") - 1).alias("revierte"),
        F.concat(F.lit("F-"), (F.col("o_custkey") % 50).cast("string")).alias("numero_externo"),
        F.concat(F.lit("Pedido "), F.col("o_orderpriority")).alias("concepto"),
    )


def apunte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines; debit or credit by the return flag."""
    li = read(spark, sf_dir, "lineitem")
    credit = F.col("l_returnflag") == "R"
    code = F.concat((F.col("l_partkey") % 7 + 1).cast("string"), F.lpad((F.col("l_suppkey") * 7919 % 10000000).cast("string"), 7, "0"))
    return li.select(
        F.col("l_orderkey").alias("asiento_id"),
        F.col("l_linenumber").cast("long").alias("orden"),
        code.alias("cuenta"),
        F.concat_ws(" ", F.lit("N/FRA"), "l_returnflag", "l_linestatus").alias("concepto"),
        F.when(credit, F.lit(0)).otherwise(cents("l_extendedprice")).cast("decimal(14,2)").alias("debe"),
        F.when(credit, cents("l_extendedprice")).otherwise(F.lit(0)).cast("decimal(14,2)").alias("haber"),
        F.when(F.col("l_linestatus") == "O", "").otherwise("punteado").alias("punteo"),
    )


def cuenta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts: every code in use, and the codes above them, named by what they are."""
    codes = apunte(spark, sf_dir).select("cuenta").distinct()
    every = codes.select(F.explode(F.array(*(F.left("cuenta", F.lit(n)) for n in (1, 2, 3, 4, 5, 8)))).alias("codigo")).distinct()
    return every.select("codigo", F.concat(F.lit("Cuenta "), "codigo").alias("nombre"), (F.length("codigo") == 8).alias("imputable"), F.lit(True).alias("activa"))


ASIENTO = """asiento AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS ejercicio, CAST(o_orderdate AS DATE) AS fecha, o_orderkey AS numero,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'apertura' WHEN '3' THEN 'ajuste' WHEN '4' THEN 'regularizacion' WHEN '5' THEN 'cierre' ELSE 'operacion' END AS tipo,
    CASE o_orderstatus WHEN 'F' THEN 'contabilizado' WHEN 'P' THEN 'anulado' ELSE 'borrador' END AS estado,
    CASE WHEN o_custkey % 5 > 0 THEN 'H' || CAST(o_custkey % 5 AS VARCHAR) END AS hoja,
    CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey - 1 END AS revierte,
    'F-' || CAST(o_custkey % 50 AS VARCHAR) AS numero_externo, 'Pedido ' || o_orderpriority AS concepto
  FROM orders)"""

APUNTE = """apunte AS (
  SELECT l_orderkey AS asiento_id, CAST(l_linenumber AS BIGINT) AS orden,
    CAST(l_partkey % 7 + 1 AS VARCHAR) || lpad(CAST(l_suppkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS cuenta,
    'N/FRA ' || l_returnflag || ' ' || l_linestatus AS concepto,
    CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DECIMAL(14,2)) ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS debe,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(14,2)) ELSE CAST(0 AS DECIMAL(14,2)) END AS haber,
    CASE WHEN l_linestatus = 'O' THEN '' ELSE 'punteado' END AS punteo
  FROM lineitem)"""

LEDGER = f"WITH {ASIENTO}, {APUNTE}"
