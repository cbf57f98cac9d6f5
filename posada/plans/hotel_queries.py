"""Profit, cash, payroll, statement and entry queries over the driver's tables, each with its DuckDB form.

Reservations are orders (stay of o_orderkey % 5 nights from the order's date, agency by customer segment);
purchases are line items, departments come from brands; creditors and VAT are line items by supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions import dates, numbers
from posada.operators import cash, entries, ledger, predicates, profit, shapes, statements
from posada.plans.driver_queries import register
from posada.plans.mapping import APUNTE, LEDGER, apunte, asiento, cents, read
from posada.plans.tools import profit_and_loss_by_month

YEAR, TODAY = 1997, "1997-06-15"


# ------------------------------------------------------------------ reservations


def reserva(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.to_date("o_orderdate")
    names = F.when(F.col("c_mktsegment") == "BUILDING", "111 Booking.com BV").when(F.col("c_mktsegment") == "MACHINERY", "Expedia Lodging").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "Cliente directo"
    ).otherwise(F.col("c_mktsegment"))
    zero = F.lit(0).cast("decimal(12,2)")
    return o.select(
        F.col("o_orderkey").alias("numero"), names.alias("agencia"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("habitaciones"), start.alias("entrada"),
        F.date_add(start, (F.col("o_orderkey") % 5).cast("int")).alias("salida"), cents("o_totalprice").alias("total_estancias"), F.lit(30).cast("decimal(12,2)").alias("fact_extras"),
        zero.alias("pend_extras"), F.lit(7).cast("decimal(12,2)").alias("fact_impuesto"), zero.alias("pend_tasas"),
    )


_NIGHTS = f"""WITH reserva AS (
  SELECT o_orderkey AS numero, CASE c_mktsegment WHEN 'BUILDING' THEN '111 Booking.com BV' WHEN 'MACHINERY' THEN 'Expedia Lodging' WHEN 'HOUSEHOLD' THEN 'Cliente directo' ELSE c_mktsegment END AS agencia,
    o_orderkey % 2 + 1 AS habitaciones, CAST(o_orderdate AS DATE) AS entrada, greatest(o_orderkey % 5, 1) AS n, CAST(o_totalprice AS DECIMAL(14,2)) AS total
  FROM orders JOIN customer ON c_custkey = o_custkey),
noche AS (SELECT *, entrada + CAST(i AS INTEGER) AS d FROM reserva, unnest(range(0, n)) AS t(i)),
parte AS (
  SELECT numero, agencia, habitaciones, CAST(month(d) AS BIGINT) AS mes, d <= DATE '{TODAY}' AS realizado, count(*) AS noches, any_value(n) AS n, any_value(total) AS total
  FROM noche WHERE year(d) = {YEAR} GROUP BY ALL),
p AS (
  SELECT numero, agencia, habitaciones, mes, realizado, noches, CAST(round(CAST(total AS DECIMAL(30,12)) * noches * 100 / (n * 110), 6) AS DECIMAL(28,6)) AS estancias,
    CAST(round(CAST(30 AS DECIMAL(30,12)) * noches * 100 / (n * 110), 6) AS DECIMAL(28,6)) AS extras, CAST(round(CAST(7 AS DECIMAL(30,12)) * noches / n, 6) AS DECIMAL(28,6)) AS tasas FROM parte)"""


def _prorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.prorated_by_month(reserva(spark, sf_dir), YEAR, TODAY, with_vat=False)


@register("q16_proration", _NIGHTS + " SELECT numero, mes, realizado, noches, round(CAST(estancias AS DOUBLE), 4) AS estancias, round(CAST(extras AS DOUBLE), 4) AS extras, round(CAST(tasas AS DOUBLE), 4) AS tasas FROM p")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prorated(spark, sf_dir).select("numero", "mes", "realizado", "noches", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("estancias", "extras", "tasas")))


@register("q16_revenue_by_month", _NIGHTS + """ SELECT mes, round(CAST(coalesce(sum(estancias) FILTER (realizado), 0) AS DOUBLE), 0) AS estancias, round(CAST(coalesce(sum(tasas) FILTER (realizado), 0) AS DOUBLE), 0) AS tasas,
  round(CAST(coalesce(sum(estancias + extras + tasas) FILTER (NOT realizado), 0) AS DOUBLE), 0) AS previsto, CAST(coalesce(sum(noches * habitaciones) FILTER (realizado), 0) AS BIGINT) AS noches_hab FROM p GROUP BY 1""")
def q16_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = profit.revenue_by_month(_prorated(spark, sf_dir))
    return sums.select("mes", *(F.round(F.col(c).cast("double"), 0).alias(c) for c in ("estancias", "tasas", "previsto")), "noches_hab")


@register("a30_agencies", _NIGHTS + """ SELECT agencia AS nombre, count(DISTINCT numero) AS reservas, CAST(sum(noches * habitaciones) AS BIGINT) AS noches_hab, round(CAST(sum(estancias) AS DOUBLE), 0) AS estancias,
  round(CAST(sum(estancias) AS DOUBLE) / CAST(sum(noches * habitaciones) AS DOUBLE), 3) AS adr FROM p WHERE realizado GROUP BY 1""")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profit.by_agency(_prorated(spark, sf_dir))
    return out.select("nombre", "reservas", "noches_hab", F.round(F.col("estancias").cast("double"), 0).alias("estancias"), F.round("adr", 3).alias("adr"))


@register("q17_channel_weights", _NIGHTS + """, c AS (SELECT mes, CASE WHEN lower(agencia) LIKE '%directo%' THEN 'Directos' WHEN lower(agencia) LIKE '%booking%' THEN 'Booking' WHEN lower(agencia) LIKE '%expedia%' THEN 'Expedia' END AS canal, * EXCLUDE (mes) FROM p WHERE realizado),
s AS (SELECT mes, canal, sum(estancias + extras + tasas) AS i, CAST(sum(noches * habitaciones) AS BIGINT) AS noches FROM c WHERE canal IS NOT NULL GROUP BY 1, 2)
SELECT mes, canal, noches, round(100 * CAST(i AS DOUBLE) / CAST(sum(i) OVER (PARTITION BY mes) AS DOUBLE), 3) AS peso_ingresos, round(100 * CAST(noches AS DOUBLE) / CAST(sum(noches) OVER (PARTITION BY mes) AS DOUBLE), 3) AS peso_noches FROM s""")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profit.channel_weights(_prorated(spark, sf_dir))
    return out.select("mes", "canal", "noches", F.round("peso_ingresos", 3).alias("peso_ingresos"), F.round("peso_noches", 3).alias("peso_noches"))


# ------------------------------------------------------------------ purchases and departments

_BRANDS = ("COCINA", "bar", "Comedor", "Lavandería", "Recepcion")


def compra(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_linestatus") == "O", "A").otherwise("F").alias("tipo"), F.col("l_orderkey").cast("string").alias("numero"), F.col("l_suppkey").cast("int").alias("codigo_proveedor"),
        F.to_date("l_shipdate").alias("fecha"), cents("l_extendedprice").alias("bruto"), F.lit(0).cast("decimal(12,2)").alias("dto_pp"), F.lit(0).cast("decimal(12,2)").alias("portes_gastos"),
        cents("l_extendedprice").alias("total"),
    )


def listado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery notes with a department: of suppliers whose key isn't a multiple of three, the lines of every third order."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.element_at(F.array(*(F.lit(b) for b in _BRANDS)), (F.substring("p_brand", -1, 1).cast("int") % 5 + 1))
    return li.where((F.col("l_suppkey") % 3 != 0) & (F.col("l_orderkey") % 3 == 0)).select(
        F.when(F.col("l_linestatus") == "O", "A").otherwise("F").alias("tipo"), F.col("l_orderkey").cast("string").alias("numero"), F.col("l_suppkey").cast("int").alias("codigo_proveedor"),
        F.to_date("l_shipdate").alias("fecha"), cents("l_extendedprice").alias("total"), brand.alias("departamento"),
    )


def asignacion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 6 = 0")
    return s.select(F.lit("proveedor").alias("origen"), F.col("s_suppkey").cast("string").alias("clave"), F.lit("Mantenimiento").alias("departamento"))


_CANON = """CASE lower(strip_accents(departamento)) WHEN 'cocina' THEN 'Cocina' WHEN 'bar' THEN 'Bar' WHEN 'comedor' THEN 'Comedor' WHEN 'lavanderia' THEN 'Pisos' WHEN 'recepcion' THEN 'Recepción' END"""
_BUY = f"""WITH compra AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'F' END AS tipo, CAST(l_orderkey AS VARCHAR) AS numero, CAST(l_suppkey AS INTEGER) AS codigo_proveedor, CAST(l_shipdate AS DATE) AS fecha, CAST(l_extendedprice AS DECIMAL(14,2)) AS importe FROM lineitem),
listado AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'F' END AS tipo, CAST(l_orderkey AS VARCHAR) AS numero, CAST(l_suppkey AS INTEGER) AS codigo_proveedor, CAST(l_shipdate AS DATE) AS fecha, CAST(l_extendedprice AS DECIMAL(14,2)) AS total,
    (['COCINA', 'bar', 'Comedor', 'Lavandería', 'Recepcion'])[CAST(right(p_brand, 1) AS INTEGER) % 5 + 1] AS departamento
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 3 <> 0 AND l_orderkey % 3 = 0),
peso AS (SELECT codigo_proveedor, departamento, sum(abs(total)) AS peso FROM listado GROUP BY 1, 2),
habitual AS (SELECT codigo_proveedor, departamento FROM (SELECT *, row_number() OVER (PARTITION BY codigo_proveedor ORDER BY peso DESC, departamento) AS r FROM peso) WHERE r = 1),
exacto AS (SELECT tipo, numero, codigo_proveedor, departamento FROM (SELECT *, row_number() OVER (PARTITION BY tipo, numero, codigo_proveedor ORDER BY fecha DESC, departamento DESC) AS r FROM listado) WHERE r = 1),
con AS (
  SELECT c.*, CASE WHEN e.departamento IS NOT NULL THEN {_CANON.replace('departamento', 'e.departamento')} WHEN h.departamento IS NOT NULL THEN {_CANON.replace('departamento', 'h.departamento')}
      WHEN c.codigo_proveedor % 6 = 0 AND c.codigo_proveedor IN (SELECT s_suppkey FROM supplier) THEN 'Mantenimiento' ELSE 'Sin asignar' END AS departamento,
    CASE WHEN e.departamento IS NOT NULL THEN 'albaran' WHEN h.departamento IS NOT NULL THEN 'habitual' WHEN c.codigo_proveedor % 6 = 0 AND c.codigo_proveedor IN (SELECT s_suppkey FROM supplier) THEN 'manual' ELSE 'sin' END AS origen_depto
  FROM compra c LEFT JOIN exacto e USING (tipo, numero, codigo_proveedor) LEFT JOIN habitual h ON h.codigo_proveedor = c.codigo_proveedor)"""


def _departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.purchases_with_department(compra(spark, sf_dir), listado(spark, sf_dir), asignacion(spark, sf_dir), predicates.purchase_amount(False))


@register("a25_weighted_mode", _BUY + " SELECT codigo_proveedor, departamento AS habitual FROM habitual")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.habitual_department(listado(spark, sf_dir))


@register("j15_fallback", _BUY + " SELECT departamento, origen_depto, count(*) AS lineas, CAST(sum(importe) AS DECIMAL(24,2)) AS importe FROM con GROUP BY 1, 2")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _departments(spark, sf_dir).groupBy("departamento", "origen_depto").agg(F.count("*").alias("lineas"), numbers.money(F.sum("importe")).alias("importe"))


@register("a32_coverage", _BUY + " SELECT origen_depto, count(*) AS lineas, CAST(sum(importe) AS DECIMAL(24,2)) AS importe FROM con GROUP BY 1")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.coverage(_departments(spark, sf_dir))


@register("j05_listings_without_purchase", _BUY + f" SELECT tipo, numero, codigo_proveedor FROM listado l WHERE year(fecha) = {YEAR} AND NOT EXISTS (SELECT 1 FROM compra c WHERE c.tipo = l.tipo AND c.numero = l.numero AND c.codigo_proveedor = l.codigo_proveedor AND year(c.fecha) = {YEAR} AND month(c.fecha) < 7)")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = compra(spark, sf_dir).where(predicates.within(F.col("fecha"), f"{YEAR}-01-01", f"{YEAR}-06-30"))
    return profit.listings_without_purchase(listado(spark, sf_dir), half, YEAR).select("tipo", "numero", "codigo_proveedor")


@register("o05_top_rest", """WITH s AS (SELECT s_name AS nombre, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS importe, count(DISTINCT l_orderkey) AS documentos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY importe DESC, nombre) AS r, count(*) OVER () AS k FROM s)
SELECT CASE WHEN k <= 11 OR r <= 10 THEN nombre ELSE 'Resto (' || (k - 10) || ')' END AS nombre, CAST(sum(importe) AS DECIMAL(24,2)) AS importe, CAST(sum(documentos) AS BIGINT) AS documentos FROM r GROUP BY 1""")
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    sums = li.groupBy("l_suppkey").agg(numbers.money(F.sum(cents("l_extendedprice"))).alias("importe"), F.count_distinct("l_orderkey").alias("documentos"))
    ranked = sums.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("nombre"), "importe", "documentos")
    return profit.top_with_rest(ranked, 10, "nombre", "importe", "documentos")


# ------------------------------------------------------------------ creditors and VAT


def factura(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("fichero"), F.concat(F.lit("Acreedor "), (F.col("o_custkey") % 40).cast("string")).alias("acreedor"), F.to_date("o_orderdate").alias("fecha"),
        F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(" ")).alias("documento"), F.when(F.col("o_custkey") % 9 == 0, "21300001").otherwise(F.concat(F.lit("62"), (F.col("o_custkey") % 8).cast("string"), F.lit("00000"))).alias("cuenta"),
        cents("o_totalprice").alias("importe"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 5000).cast("int")).alias("asiento"),
    )


def apunte_iva(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderkey % 4 < 3")
    return o.select(
        F.when(F.col("o_orderkey") % 10 == 6, "repercutido").otherwise("soportado").alias("libro"), F.to_date("o_orderdate").alias("fecha"), (F.col("o_orderkey") % 900).cast("string").alias("documento"),
        F.concat(F.when(F.col("o_orderkey") % 20 == 6, "N/FRA ").otherwise("S/FRA "), F.element_at(F.array(F.lit("hotel BAR"), F.lit("Comedor"), F.lit("otros")), (F.col("o_custkey") % 3 + 1).cast("int"))).alias("concepto"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("410"), F.lpad((F.col("o_custkey") % 40).cast("string"), 5, "0"))).otherwise("40000001").alias("cuenta"),
        F.round(cents("o_totalprice") * F.lit(21) / F.lit(100), 2).cast("decimal(12,2)").alias("cuota"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 5000).cast("int")).alias("asiento"),
    )


_CREDIT = f"""WITH f AS (
  SELECT 'f' || CAST(o_custkey % 40 AS VARCHAR) AS fichero, CAST(o_orderdate AS DATE) AS fecha, CAST(o_orderkey % 900 AS VARCHAR) AS doc, CASE WHEN o_custkey % 9 = 0 THEN '21300001' ELSE '62' || CAST(o_custkey % 8 AS VARCHAR) || '00000' END AS cuenta,
    CAST(o_totalprice AS DECIMAL(14,2)) AS importe, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5000 AS INTEGER) END AS asiento FROM orders WHERE year(o_orderdate) = {YEAR}),
v AS (
  SELECT CASE WHEN o_orderkey % 10 = 6 THEN 'repercutido' ELSE 'soportado' END AS libro, CAST(o_orderdate AS DATE) AS fecha, CAST(o_orderkey % 900 AS VARCHAR) AS doc,
    CASE WHEN o_orderkey % 20 = 6 THEN 'N/FRA ' ELSE 'S/FRA ' END || (['hotel BAR', 'Comedor', 'otros'])[o_custkey % 3 + 1] AS concepto, CASE WHEN o_custkey % 2 = 0 THEN '410' || lpad(CAST(o_custkey % 40 AS VARCHAR), 5, '0') ELSE '40000001' END AS cuenta,
    CAST(round(CAST(o_totalprice AS DECIMAL(14,2)) * 21 / 100, 2) AS DECIMAL(12,2)) AS cuota, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5000 AS INTEGER) END AS asiento FROM orders WHERE o_orderkey % 4 < 3 AND year(o_orderdate) = {YEAR}),
sop AS (SELECT asiento, doc, sum(cuota) AS cuota, max(CASE WHEN starts_with(cuenta, '410') THEN cuenta END) AS cuenta_410 FROM v WHERE libro = 'soportado' GROUP BY 1, 2),
isp AS (SELECT DISTINCT asiento, doc FROM v WHERE libro = 'repercutido' AND starts_with(upper(concepto), 'S/FRA')),
net AS (SELECT f.*, left(f.cuenta, 3) AS c3, starts_with(f.cuenta, '2') AS inversion, sop.cuota IS NOT NULL AS casada, CASE WHEN isp.doc IS NULL THEN coalesce(sop.cuota, 0) ELSE 0 END AS iva
  FROM f LEFT JOIN sop ON sop.asiento IS NOT DISTINCT FROM f.asiento AND sop.doc = f.doc LEFT JOIN isp ON isp.asiento IS NOT DISTINCT FROM f.asiento AND isp.doc = f.doc)"""


@register("q19_creditor_invoices", _CREDIT + " SELECT fichero, fecha, c3 AS cuenta, inversion, casada, CAST(iva AS DECIMAL(24,2)) AS iva, CAST(importe - iva AS DECIMAL(24,2)) AS importe FROM net")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profit.creditor_invoices(factura(spark, sf_dir), apunte_iva(spark, sf_dir), YEAR)
    return out.select("fichero", "fecha", "cuenta", "inversion", "casada", "iva", numbers.money(F.col("importe")).alias("importe"))


@register("a29_creditors_by_account", _CREDIT + " SELECT c3 AS cuenta, CAST(sum(importe - iva) AS DECIMAL(24,2)) AS importe, round(100 * CAST(sum(importe - iva) AS DOUBLE) / CAST(sum(sum(importe - iva)) OVER () AS DOUBLE), 4) AS pct FROM net WHERE NOT inversion GROUP BY 1")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profit.by_account(profit.creditor_invoices(factura(spark, sf_dir), apunte_iva(spark, sf_dir), YEAR), False)
    return out.withColumn("pct", F.round("pct", 4))


@register("a33_orphan_vat", _CREDIT + """ SELECT trim(regexp_replace(concepto, '^S/FRA ', '')) AS nombre, CAST(sum(cuota) AS DECIMAL(24,2)) AS cuota FROM v WHERE libro = 'soportado' AND starts_with(cuenta, '410')
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.asiento IS NOT DISTINCT FROM v.asiento AND f.doc = v.doc AND f.fichero < 'f2') GROUP BY 1 HAVING abs(sum(cuota)) >= 1000 ORDER BY abs(sum(cuota)) DESC, 1 LIMIT 5""")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.orphan_vat(apunte_iva(spark, sf_dir), factura(spark, sf_dir).where("fichero < 'f2'"), YEAR)


@register("q18_dining_from_vat", _CREDIT + """, m AS (SELECT CASE WHEN concepto LIKE '% BAR%' THEN 'Bar' WHEN concepto LIKE '%Comedor%' THEN 'Comedor' END AS serie, cuota,
    CASE WHEN month(fecha) % 3 = 0 AND day(fecha) >= 28 THEN [month(fecha) - 2, month(fecha) - 1, month(fecha)] ELSE [month(fecha)] END AS ms FROM v WHERE libro = 'repercutido' AND starts_with(concepto, 'N/FRA '))
SELECT CAST(mes AS BIGINT) AS mes, serie, CAST(round(sum(round(CAST(cuota AS DECIMAL(28,12)) * 10 / len(ms), 6)), 2) AS DECIMAL(24,2)) AS valor FROM m, unnest(ms) AS t(mes) WHERE serie IS NOT NULL GROUP BY 1, 2""")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit.vat_revenue(apunte_iva(spark, sf_dir), YEAR)


@register("f43_quarter_spread", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(unnest(CASE WHEN month(d) % 3 = 0 AND day(d) >= 28 THEN [month(d) - 2, month(d) - 1, month(d)] ELSE [month(d)] END) AS BIGINT) AS mes FROM o""")
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", F.explode(F.transform(dates.invoice_months(F.col("d")), lambda m: m.cast("long"))).alias("mes"))


def gasto(o: DataFrame) -> DataFrame:
    d = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit("Alquiler").alias("concepto"), F.lit("").alias("acreedor"), F.lit("62100000").alias("cuenta"), cents("o_totalprice").alias("base"),
        F.lit(0).cast("decimal(12,2)").alias("iva"), d.alias("desde"), F.date_add(d, (F.col("o_orderkey") % 120).cast("int")).alias("hasta"),
    )


def _expense_shares(expenses: DataFrame) -> DataFrame:
    return profit.additional_expenses(expenses, YEAR, TODAY).select("fecha", "fichero", F.round("importe", 1).cast("double").alias("importe"))


@register("f44_additional_expenses", f"""WITH g AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(14,2)) AS base, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS b FROM orders),
d AS (SELECT id, base, b - a + 1 AS todos, date_trunc('month', a + CAST(i AS INTEGER)) AS fecha, count(*) AS dias FROM g, unnest(range(0, b - a + 1)) AS t(i) GROUP BY ALL)
SELECT CAST(fecha AS DATE) AS fecha, 'gasto-' || id AS fichero, CAST(round(CAST(round(CAST(base AS DOUBLE) * dias / todos, 6) AS DECIMAL(28,6)), 1) AS DOUBLE) AS importe FROM d WHERE year(fecha) = {YEAR} AND fecha <= DATE '1997-06-01'""")
def f44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expense_shares(gasto(read(spark, sf_dir, "orders")))


# ------------------------------------------------------------------ summary


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = profit.long_series(profit.revenue_by_month(_prorated(spark, sf_dir)), "estancias", "extras", "tasas", "previsto", "noches_hab")
    bought = compra(spark, sf_dir).where(predicates.in_year(F.col("fecha"), YEAR)).groupBy(F.month("fecha").cast("long").alias("mes")).agg(numbers.money(F.sum("total")).alias("valor"))
    owed = profit.creditor_invoices(factura(spark, sf_dir), apunte_iva(spark, sf_dir), YEAR)
    owed = owed.groupBy(F.month("fecha").cast("long").alias("mes"), F.when(F.col("inversion"), "inversiones").otherwise("acreedores").alias("serie")).agg(numbers.money(F.sum("importe")).alias("valor"))
    return revenue.unionByName(bought.select("mes", F.lit("proveedores").alias("serie"), "valor")).unionByName(owed.select("mes", "serie", "valor")).unionByName(profit.vat_revenue(apunte_iva(spark, sf_dir), YEAR).select("mes", "serie", "valor"))


@register("q15_profit_summary", _NIGHTS.replace("WITH reserva", _CREDIT + ", reserva") + f""", serie AS (
  SELECT mes, sum(estancias + extras + tasas) FILTER (realizado) AS ingresos, 0 AS gastos FROM p GROUP BY 1
  UNION ALL SELECT CAST(unnest(ms) AS BIGINT), c, 0 FROM (SELECT CAST(cuota AS DECIMAL(28,12)) * 10 / len(ms) AS c, ms FROM (SELECT cuota, CASE WHEN month(fecha) % 3 = 0 AND day(fecha) >= 28 THEN [month(fecha) - 2, month(fecha) - 1, month(fecha)] ELSE [month(fecha)] END AS ms FROM v
    WHERE libro = 'repercutido' AND starts_with(concepto, 'N/FRA ') AND (concepto LIKE '% BAR%' OR concepto LIKE '%Comedor%')))
  UNION ALL SELECT CAST(month(fecha) AS BIGINT), 0, importe - iva FROM net WHERE NOT inversion
  UNION ALL SELECT CAST(month(l_shipdate) AS BIGINT), 0, CAST(l_extendedprice AS DECIMAL(14,2)) FROM lineitem WHERE year(l_shipdate) = {YEAR}),
m AS (SELECT i AS mes, coalesce(sum(ingresos), 0) AS ingresos, coalesce(sum(gastos), 0) AS gastos FROM range(1, 13) AS t(i) LEFT JOIN serie ON mes = i GROUP BY 1)
SELECT mes, round(CAST(ingresos AS DOUBLE), 0) AS ingresos, round(CAST(gastos AS DOUBLE), 0) AS gastos, round(CAST(ingresos - gastos AS DOUBLE) / 100, 0) AS beneficio, round(CAST(sum(ingresos - gastos) OVER (ORDER BY mes) AS DOUBLE) / 100, 0) AS acumulado FROM m""")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = profit.monthly_summary(_series(spark, sf_dir))
    rounded = lambda c, by: F.round(F.col(c).cast("double") / by, 0).alias(c)
    return whole.select("mes", rounded("ingresos", 1), rounded("gastos", 1), rounded("beneficio", 100), rounded("acumulado", 100))


# ------------------------------------------------------------------ cash and payroll


def caja(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).pivot("event_type", ["view", "click", "purchase", "signup", "error"]).agg(F.sum(F.col("value").cast("decimal(12,2)")))
    amount = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(12,2)")
    names = dict(zip(("bar", "comedor", "chill_out", "ecotasa", "menus"), ("view", "click", "purchase", "signup", "error")))
    return e.select(
        F.year("d").alias("anio"), F.month("d").alias("mes"), F.day("d").alias("dia"), *(amount(F.col(v)).alias(k) for k, v in names.items()),
        *(F.lit(0).cast("decimal(12,2)").alias(c) for c in ("facturas", "parking_efectivo", "parking_visa")),
    )


_CASH = """WITH d AS (SELECT CAST(ts AS DATE) AS d, event_type, CAST(value AS DECIMAL(12,2)) AS v FROM events),
s AS (SELECT CAST(year(d) AS BIGINT) AS anio, CAST(month(d) AS BIGINT) AS mes, coalesce(sum(v) FILTER (event_type = 'view'), 0) AS bar, coalesce(sum(v) FILTER (event_type = 'click'), 0) AS comedor, coalesce(sum(v) FILTER (event_type = 'purchase'), 0) AS chill_out FROM d GROUP BY 1, 2)"""


@register("a18_cash_by_month", _CASH + """ SELECT mes, CAST(bar AS DECIMAL(24,2)) AS bar, CAST(comedor AS DECIMAL(24,2)) AS comedor, CAST(chill_out AS DECIMAL(24,2)) AS chill_out, CAST(bar + comedor + chill_out AS DECIMAL(24,2)) AS ventas,
  round(100 * CAST(bar AS DOUBLE) / nullif(CAST(bar + comedor + chill_out AS DOUBLE), 0), 4) AS peso_bar FROM s WHERE anio = (SELECT min(anio) FROM s)""")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = caja(spark, sf_dir)
    year = read(spark, sf_dir, "events").agg(F.year(F.min("ts"))).first()[0]
    return cash.month_sums(days, year).select("mes", "bar", "comedor", "chill_out", "ventas", F.round("peso_bar", 4).alias("peso_bar"))


def nomina(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 300).cast("string").alias("nif"), F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes"), F.col("o_orderkey").alias("orden"),
        F.element_at(F.array(*(F.lit(x) for x in ("Cocina", "", "Bar", "Pisos"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("departamento"), cents("o_totalprice").alias("cost_tot"),
        F.when(F.col("o_orderkey") % 10 == 0, 50).otherwise(0).cast("decimal(10,2)").alias("importe_extra"),
    )


_PAY = "WITH n AS (SELECT CAST(o_custkey % 300 AS VARCHAR) AS nif, year(o_orderdate) AS anio, month(o_orderdate) AS mes, o_orderkey AS orden, (['Cocina', '', 'Bar', 'Pisos'])[o_orderkey % 4 + 1] AS departamento, CAST(o_totalprice AS DECIMAL(14,2)) AS cost_tot, CASE WHEN o_orderkey % 10 = 0 THEN 50 ELSE 0 END AS importe_extra FROM orders)"


@register("a20_payroll_by_department", _PAY + f" SELECT departamento, CAST(sum(cost_tot) AS DECIMAL(24,2)) AS coste, CAST(sum(importe_extra) AS DECIMAL(24,2)) AS extras, count(DISTINCT nif) AS empleados, count(*) AS nominas FROM n WHERE anio = {YEAR} GROUP BY 1")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash.payroll_by_department(nomina(spark, sf_dir), YEAR)


@register("a22_payroll_matrix", _PAY + " SELECT departamento, " + ", ".join(f"CAST(coalesce(sum(cost_tot) FILTER (mes = {m}), 0) AS DECIMAL(24,2)) AS m{m:02d}" for m in range(1, 13)) + f" FROM n WHERE anio = {YEAR} GROUP BY 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash.payroll_matrix(nomina(spark, sf_dir), YEAR)


@register("j14_carry_department", _PAY + f""", u AS (SELECT nif, departamento AS previo FROM (SELECT *, row_number() OVER (PARTITION BY nif ORDER BY anio DESC, mes DESC, departamento DESC) AS r FROM n WHERE (anio <> {YEAR} OR mes <> 3) AND departamento <> '') WHERE r = 1)
SELECT n.nif, n.orden, CASE WHEN n.departamento = '' THEN coalesce(u.previo, '') ELSE n.departamento END AS departamento FROM n LEFT JOIN u USING (nif) WHERE anio = {YEAR} AND mes = 3""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash.carry_department(nomina(spark, sf_dir), YEAR, 3).select("nif", "orden", "departamento")


# ------------------------------------------------------------------ statements, charts, entries

_RULES = (("60", "6"), ("6000", "6"), ("7", "7"), ("70012", "7"), ("4", "4"))


@register("j10_longest_prefix", f"""WITH {APUNTE}, r(prefijo) AS (VALUES ('60'), ('6000'), ('7'), ('70012'), ('4')), c AS (SELECT DISTINCT cuenta FROM apunte)
SELECT cuenta, prefijo FROM (SELECT c.cuenta, r.prefijo, row_number() OVER (PARTITION BY c.cuenta ORDER BY length(r.prefijo) DESC) AS k FROM c JOIN r ON starts_with(c.cuenta, r.prefijo)) WHERE k = 1""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(a,) for a, _ in _RULES], "prefijo string")
    return statements.longest_prefix(apunte(spark, sf_dir), "cuenta", rules, "prefijo")


_FORM = (("1", "70, 71"), ("4", "(60), 61"), ("7", "(62), (63), 6001"), ("A", ("1", "4", "7")), ("17", "64"), ("D", ("A", "17")))


@register("q08_profit_and_loss", f"""{LEDGER}, s AS (SELECT a.cuenta, CASE WHEN s.ejercicio = {YEAR} THEN 0 ELSE 1 END AS col, sum(a.debe - a.haber) AS v FROM apunte a JOIN asiento s ON s.id = a.asiento_id
  WHERE s.estado = 'contabilizado' AND s.ejercicio IN ({YEAR}, {YEAR - 1}) AND s.tipo NOT IN ('regularizacion', 'cierre') AND left(a.cuenta, 1) IN ('6', '7') GROUP BY 1, 2),
r AS (SELECT CASE WHEN starts_with(cuenta, '6001') THEN '7' WHEN left(cuenta, 2) IN ('70', '71') THEN '1' WHEN left(cuenta, 2) IN ('60', '61') THEN '4' WHEN left(cuenta, 2) IN ('62', '63') THEN '7' WHEN left(cuenta, 2) = '64' THEN '17' END AS ref,
  -sum(v) FILTER (col = 0) AS a, -sum(v) FILTER (col = 1) AS b FROM s GROUP BY 1),
l AS (SELECT ref, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM r WHERE ref IS NOT NULL)
SELECT f.ref, CAST(f.orden AS INTEGER) AS orden, CAST(coalesce(sum(l.a), 0) AS DECIMAL(24,2)) AS actual, CAST(coalesce(sum(l.b), 0) AS DECIMAL(24,2)) AS anterior
FROM (VALUES ('1', 0, ['1']), ('4', 1, ['4']), ('7', 2, ['7']), ('A', 3, ['1', '4', '7']), ('17', 4, ['17']), ('D', 5, ['1', '4', '7', '17'])) AS f(ref, orden, partes) LEFT JOIN l ON list_contains(f.partes, l.ref) GROUP BY 1, 2""")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir))
    model = statements.model_table(spark, "pyg", _FORM)
    return statements.statement(statements.year_balances(lines, "pyg", (YEAR, YEAR - 1)), model, ("6", "7")).drop("seccion")


@register("a23_profit_and_loss_by_month", f"""{LEDGER}, m AS (SELECT CAST(month(s.fecha) AS BIGINT) AS mes, coalesce(sum(a.haber - a.debe) FILTER (left(a.cuenta, 1) = '7'), 0) AS i, coalesce(sum(a.debe - a.haber) FILTER (left(a.cuenta, 1) = '6'), 0) AS g
  FROM apunte a JOIN asiento s ON s.id = a.asiento_id WHERE s.estado = 'contabilizado' AND s.ejercicio = {YEAR} AND s.tipo NOT IN ('regularizacion', 'cierre') AND left(a.cuenta, 1) IN ('6', '7') GROUP BY 1)
SELECT mes, 'Ingresos' AS serie, CAST(i AS DECIMAL(24,2)) AS valor FROM m UNION ALL SELECT mes, 'Gastos', CAST(g AS DECIMAL(24,2)) FROM m UNION ALL SELECT mes, 'Resultado', CAST(i - g AS DECIMAL(24,2)) FROM m""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit_and_loss_by_month({"apunte": apunte(spark, sf_dir), "asiento": asiento(spark, sf_dir)}, YEAR)


@register("q37_purchase_entries", """WITH d AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(14,2)) AS base, [21, 10, 4, 0][o_orderkey % 4 + 1] AS iva, [0, 15][o_orderkey % 2 + 1] AS ret FROM orders),
c AS (SELECT *, CAST(round(CAST(base * iva AS DECIMAL(20,4)) * 0.01, 2) AS DECIMAL(14,2)) AS q, CAST(round(CAST(base * ret AS DECIMAL(20,4)) * 0.01, 2) AS DECIMAL(14,2)) AS w FROM d),
l AS (SELECT id, 1 AS k, '60000000' AS cuenta, base AS debe, CAST(0 AS DECIMAL(14,2)) AS haber FROM c UNION ALL SELECT id, 2, '47200000', q, 0 FROM c UNION ALL SELECT id, 3, '47510000', 0, w FROM c UNION ALL SELECT id, 4, '40000000', 0, base + q - w FROM c)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS orden, cuenta, CAST(debe AS DECIMAL(14,2)) AS debe, CAST(haber AS DECIMAL(14,2)) AS haber FROM l WHERE debe <> 0 OR haber <> 0""")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("o_orderkey") % by + 1).cast("int"))
    data = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), cents("o_totalprice").alias("base"), pick((21, 10, 4, 0), 4).alias("iva"), pick((0, 15), 2).alias("retencion"),
        F.lit("60000000").alias("gasto"), F.lit("40000000").alias("proveedor"),
    )
    return entries.lines(data, "compra", "id")


@register("w14_fill_down", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seccion FROM events""")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("seccion", F.when(F.col("event_type") == "purchase", F.col("event_id"))).withColumn("k", F.struct("ts", "event_id"))
    return shapes.fill_down(e, ["user_id"], "k", "seccion").select("event_id", "seccion")


@register("w18_last_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.last_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


@register("w20_latest_flag", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS actual FROM events")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.latest_flag(read(spark, sf_dir, "events").withColumn("k", F.struct("ts", "event_id")), "user_id", "k").select("event_id", "actual")


@register("w03_balance_breaks", """WITH x AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k, CAST(l_extendedprice AS DECIMAL(14,2)) AS debe FROM lineitem),
s AS (SELECT *, CAST(sum(debe) OVER (PARTITION BY l_suppkey ORDER BY k ROWS UNBOUNDED PRECEDING) + CASE WHEN k % 97 >= 50 THEN 5 ELSE 0 END AS DECIMAL(20,2)) AS saldo FROM x),
p AS (SELECT *, CAST(lag(saldo) OVER (PARTITION BY l_suppkey ORDER BY k) + debe AS DECIMAL(20,2)) AS esperado FROM s)
SELECT l_suppkey, k, esperado, saldo FROM p WHERE abs(esperado - saldo) > 0.01""")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("l_suppkey")
    li = read(spark, sf_dir, "lineitem").withColumn("debe", cents("l_extendedprice"))
    rows = li.withColumn("k", F.row_number().over(by.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")).cast("long"))
    total = F.sum("debe").over(by.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("k") % 97 >= 50, 5).otherwise(0)
    rows = rows.withColumn("saldo", total.cast("decimal(20,2)")).withColumn("haber", F.lit(0).cast("decimal(14,2)"))
    return shapes.local_breaks(rows, "l_suppkey", "k")
