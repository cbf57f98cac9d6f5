"""Further operators over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posada.functions import numbers, text
from posada.operators import evaluation, ledger, predicates, profit, shapes
from posada.plans.driver_queries import register
from posada.plans.hotel_queries import _BUY, _CREDIT, YEAR, _departments, apunte_iva
from posada.plans.mapping import APUNTE, ASIENTO, LEDGER, apunte, asiento, cents, cuenta, read
from posada.plans.tools import account_by_month
from posada.sources import writes


@register("a24_vat_by_month", _CREDIT + """ SELECT CAST(month(fecha) AS BIGINT) AS mes, CAST(coalesce(sum(cuota) FILTER (libro = 'repercutido'), 0) AS DECIMAL(24,2)) AS repercutido, CAST(coalesce(sum(cuota) FILTER (libro = 'soportado'), 0) AS DECIMAL(24,2)) AS soportado,
  CAST(coalesce(sum(cuota) FILTER (libro = 'repercutido'), 0) - coalesce(sum(cuota) FILTER (libro = 'soportado'), 0) AS DECIMAL(24,2)) AS liquidar FROM v GROUP BY 1""")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.vat_by_month(apunte_iva(spark, sf_dir), YEAR)


@register("a31_supplier_ranking", _BUY + """, w AS (SELECT codigo_proveedor, departamento, sum(abs(importe)) AS w FROM con GROUP BY 1, 2), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codigo_proveedor ORDER BY w DESC, departamento) AS r FROM w) WHERE r = 1)
SELECT c.codigo_proveedor, count(*) AS documentos, CAST(sum(c.importe) AS DECIMAL(24,2)) AS importe, any_value(m.departamento) AS departamento FROM con c JOIN m USING (codigo_proveedor) GROUP BY 1""")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _departments(spark, sf_dir).withColumn("proveedor", F.col("codigo_proveedor").cast("string"))
    return profit.supplier_ranking(bought).drop("proveedor")


@register("a35_extras_by_person", """SELECT 'p' || CAST(user_id % 20 AS VARCHAR) AS persona, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS importe, count(*) AS meses FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = e.select(F.lit(2026).alias("anio"), F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("persona"), F.col("value").cast("decimal(12,2)").alias("importe"))
    return profit.extras_by_person(rows, 2026)


@register("a16_lines_per_sheet", f"""{LEDGER} SELECT coalesce(s.hoja, 'sin') AS hoja, count(*) AS apuntes, count(CASE WHEN a.punteo = '' THEN 1 END) AS pendientes FROM apunte a JOIN asiento s ON s.id = a.asiento_id GROUP BY 1""")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir))
    return lines.groupBy(F.coalesce("hoja", F.lit("sin")).alias("hoja")).agg(F.count("*").alias("apuntes"), F.count_if(F.col("punteo") == "").alias("pendientes"))


@register("j33_inherited_field", f"""WITH {APUNTE}, c AS (SELECT DISTINCT left(cuenta, n) AS codigo FROM apunte, (SELECT unnest([1, 2, 3, 4, 5, 8]) AS n)),
d AS (SELECT codigo, CASE WHEN length(codigo) = 3 THEN 'grupo ' || codigo WHEN codigo = '4' THEN 'cuatro' ELSE '' END AS definicion FROM c)
SELECT codigo, (SELECT arg_max(u.definicion, length(u.codigo)) FROM d u WHERE u.definicion <> '' AND starts_with(d.codigo, u.codigo)) AS heredado FROM d""")
def j33(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cuenta(spark, sf_dir).withColumn("definicion", F.when(F.length("codigo") == 3, F.concat(F.lit("grupo "), "codigo")).when(F.col("codigo") == "4", "cuatro").otherwise(""))
    return ledger.account_card(known, "definicion")


@register("p12_amount_range", f"WITH {APUNTE} SELECT asiento_id, orden, cuenta, debe + haber AS importe FROM apunte WHERE debe + haber BETWEEN 1000 AND 1500")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.col("debe") + F.col("haber")).cast("decimal(15,2)")
    return apunte(spark, sf_dir).withColumn("importe", amount).where(F.col("importe").between(1000, 1500)).select("asiento_id", "orden", "cuenta", "importe")


@register("p04_any_prefix", f"WITH {APUNTE} SELECT cuenta, count(*) AS n FROM apunte WHERE regexp_matches(cuenta, '^(6|72|4000)') GROUP BY 1")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apunte(spark, sf_dir).where(predicates.any_prefix(F.col("cuenta"), ["6", "72", "4000"])).groupBy("cuenta").agg(F.count("*").alias("n"))


@register("p25_one_sided_lines", f"WITH {APUNTE} SELECT asiento_id, count(*) AS n FROM apunte WHERE (debe > 0) <> (haber > 0) GROUP BY 1")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apunte(spark, sf_dir).where(predicates.one_sided(F.col("debe"), F.col("haber"))).groupBy("asiento_id").agg(F.count("*").alias("n"))


@register("w05_balance_by_month", f"""{LEDGER}, m AS (SELECT CAST(month(s.fecha) AS BIGINT) AS mes, sum(a.debe - a.haber) AS v FROM apunte a JOIN asiento s ON s.id = a.asiento_id WHERE s.estado = 'contabilizado' AND s.ejercicio = {YEAR} AND s.tipo <> 'cierre' AND starts_with(a.cuenta, '5') GROUP BY 1)
SELECT i AS mes, 'Cuenta 5' AS serie, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS DECIMAL(24,2)) AS valor FROM range(1, 13) AS t(i) LEFT JOIN m ON m.mes = i""")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return account_by_month({"apunte": apunte(spark, sf_dir), "asiento": asiento(spark, sf_dir)}, YEAR, "5")


@register("w13_suffix_repeats", """SELECT s_suppkey, CASE WHEN k > 1 THEN n || ' (' || k || ')' ELSE n END AS nombre FROM (SELECT s_suppkey, 'nacion ' || s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)""")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nacion "), F.col("s_nationkey").cast("string")).alias("nombre"))
    return shapes.suffix_repeats(s, [], "nombre", "s_suppkey")


@register("w15_cluster", """WITH g AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2 THEN 1 ELSE 0 END AS g FROM events),
r AS (SELECT user_id, value, sum(g) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS g FROM g), c AS (SELECT user_id, g, min(value) AS desde, max(value) AS hasta, count(*) AS n FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, desde) AS k, sum(n) OVER (PARTITION BY user_id) AS todos FROM c) SELECT user_id, desde, hasta, n FROM k WHERE k = 1 AND n >= 2 AND 2 * n >= todos""")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.cluster_1d(read(spark, sf_dir, "events"), "user_id", "value", 2.0)


@register("w19_prune", """SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY DATE '2020-01-01' + CAST(doc_id % 3000 AS INTEGER) DESC) AS r, DATE '2020-01-01' + CAST(doc_id % 3000 AS INTEGER) AS f FROM documents) WHERE r > 3 AND DATE '2021-06-01' - f > 30""")
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = read(spark, sf_dir, "documents").select("doc_id", "lang", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int")).alias("f"))
    return shapes.prune(copies, "lang", "f", "2021-06-01", 30, 3).select("doc_id")


@register("u02_years", "SELECT DISTINCT y FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders UNION SELECT CAST(year(l_shipdate) AS BIGINT) FROM lineitem)")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = lambda t, c: read(spark, sf_dir, t).select(F.year(c).cast("long").alias("y"))
    return years("orders", "o_orderdate").union(years("lineitem", "l_shipdate")).distinct().orderBy(F.desc("y"))


@register("u07_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.last_wins(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@register("k08_sparse_overwrite", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "x").alias("c_mktsegment"))
    return writes.sparse_overwrite(old, new, ["c_custkey"], "c_mktsegment")


@register("k03_replace_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'nuevo' FROM customer WHERE c_custkey % 5 = 0")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return writes.replace_keys(old, old.where("c_custkey % 5 = 0").withColumn("c_name", F.lit("nuevo")), "c_custkey")


@register("f49_snap_rate", """SELECT o_orderkey, CAST((o_orderkey % 60) * 0.5 AS DECIMAL(6,2)) AS tipo FROM orders WHERE o_totalprice > 20000""")
def f49(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = ((F.col("o_orderkey") % 60) * F.lit(Decimal("0.5"))).cast("decimal(6,2)")
    quota = F.round(cents("o_totalprice") * rate / F.lit(100), 2).cast("decimal(14,2)")
    return read(spark, sf_dir, "orders").where("o_totalprice > 20000").select("o_orderkey", numbers.snap_rate(cents("o_totalprice"), quota).alias("tipo"))


@register("f11_invoice_key", "SELECT p_partkey, left(regexp_replace(upper(strip_accents(p_brand || '-Ñandú/' || p_type)), '[^0-9A-Z]', '', 'g'), 100) AS clave FROM part")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.invoice_key(F.concat(F.col("p_brand"), F.lit("-Ñandú/"), F.col("p_type"))).alias("clave"))


@register("f69_holdout", "SELECT source, arg_min(lang, (md5(lang), lang)) AS lang FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1")
def f69(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.holdout_by_digest(read(spark, sf_dir, "documents"), "source", "lang")


@register("j34_missing_months", f"""WITH {ASIENTO} SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS meses FROM (SELECT DISTINCT month(fecha) AS m FROM asiento WHERE ejercicio = 1998 EXCEPT SELECT DISTINCT month(fecha) FROM asiento WHERE ejercicio = 1998 AND month(fecha) % 3 = 1)""")
def j34(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = asiento(spark, sf_dir).where("ejercicio = 1998").withColumn("mes", F.month("fecha"))
    return profit.months_without(heads, heads.where("mes % 3 = 1"))


@register("w08_share_of_month", """WITH s AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS mes, o_orderpriority AS serie, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS v FROM orders GROUP BY 1, 2)
SELECT mes, serie, round(100 * CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY mes) AS DOUBLE), 4) AS peso FROM s""")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("mes"), F.col("o_orderpriority").alias("serie")).agg(F.sum(cents("o_totalprice")).alias("v"))
    return sums.select("mes", "serie", F.round(numbers.percent(F.col("v"), F.sum("v").over(Window.partitionBy("mes"))), 4).alias("peso"))
