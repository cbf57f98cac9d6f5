"""Reports, cards, tools and exports over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posada.functions import keys, text
from posada.operators import cash, evaluation, invoices, ledger, predicates, profit
from posada.plans import tools
from posada.plans.driver_queries import register
from posada.plans.mapping import APUNTE, ASIENTO, LEDGER, apunte, asiento, cents, cuenta, read
from posada.sources import sinks, writes
from posada.streaming import events as streams

def _key() -> Column:
    return F.col("o_orderkey")


# ------------------------------------------------------------------ profit


_DEPARTMENTS = """WITH ing AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Bar' WHEN 1 THEN 'Comedor' WHEN 2 THEN 'Comedor' ELSE 'Parking' END AS nombre, CAST(o_totalprice AS DECIMAL(24,2)) AS v FROM orders WHERE o_orderkey % 4 < 3),
com AS (SELECT ['Bar', 'Cocina', 'Sin asignar'][l_suppkey % 3 + 1] AS nombre, CAST(l_extendedprice AS DECIMAL(24,2)) AS v FROM lineitem WHERE year(CAST(l_shipdate AS DATE)) = 1997),
nom AS (SELECT ['Bar', 'Pisos', 'Sin asignar'][c_custkey % 3 + 1] AS nombre, CAST(c_custkey AS DECIMAL(24,2)) + CASE WHEN c_custkey % 12 + 1 > 6 THEN 5 ELSE 0 END AS v FROM customer),
ext AS (SELECT ['Bar', 'Sin asignar'][c_custkey % 2 + 1] AS nombre, CAST(7 AS DECIMAL(24,2)) AS v FROM customer WHERE c_custkey % 12 + 1 <= 6),
t AS (SELECT nombre, v AS i, 0 AS p, 0 AS n FROM ing UNION ALL SELECT nombre, 0, v, 0 FROM com UNION ALL SELECT nombre, 0, 0, v FROM nom UNION ALL SELECT nombre, 0, 0, v FROM ext)
SELECT nombre, CAST(sum(i) AS DECIMAL(24,2)) AS ingresos, CAST(sum(p) AS DECIMAL(24,2)) AS proveedores, CAST(sum(n) AS DECIMAL(24,2)) AS nominas, CAST(sum(p) + sum(n) AS DECIMAL(24,2)) AS total,
  CASE WHEN sum(i) <> 0 THEN CAST(sum(i) - sum(p) - sum(n) AS DECIMAL(24,2)) END AS resultado FROM t GROUP BY 1"""


def _by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k, *names: F.array(*(F.lit(n) for n in names))[k.cast("int")]
    c = F.col("c_custkey")
    dining = read(spark, sf_dir, "orders").select(pick(_key() % 4, "Bar", "Comedor", "Menús", "Parking").alias("serie"), cents("o_totalprice").alias("valor"))
    bought = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("fecha"), pick(F.col("l_suppkey") % 3, "Bar", "Cocina", "Sin asignar").alias("departamento"), cents("l_extendedprice").alias("importe"))
    month = (c % 12 + 1).cast("int")
    customers = read(spark, sf_dir, "customer")
    pay = customers.select(F.lit(1997).alias("anio"), month.alias("mes"), pick(c % 3, "BAR", "lavandería", "").alias("departamento"), c.cast("decimal(12,2)").alias("cost_tot"), F.lit(5).cast("decimal(12,2)").alias("importe_extra"))
    extras = customers.where(month <= 6).select(F.lit(1997).alias("anio"), month.alias("mes"), F.concat(F.lit("p"), (c % 2).cast("string")).alias("persona"), F.lit(7).cast("decimal(12,2)").alias("importe"))
    assigned = spark.createDataFrame([("personal", "p0", "Bar"), ("proveedor", "p1", "Bar")], "origen string, clave string, departamento string")
    return profit.by_department(dining, bought, pay, extras, assigned, 1997)


@register("a27_by_department", _DEPARTMENTS)
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_department(spark, sf_dir)


@register("o04_sentinel_last", f"SELECT nombre, row_number() OVER (ORDER BY nombre = 'Sin asignar', total DESC, nombre) AS puesto FROM ({_DEPARTMENTS})")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy(F.col("nombre") == text.UNASSIGNED, F.desc("total"), "nombre")  # a row for each department
    return _by_department(spark, sf_dir).select("nombre", F.row_number().over(order).cast("long").alias("puesto"))


@register("a36_year_totals", """WITH s AS (SELECT month(CAST(o_orderdate AS DATE)) AS mes, CAST(o_totalprice AS DECIMAL(14,2)) AS v FROM orders)
SELECT CAST(sum(v) AS DECIMAL(24,2)) AS ingresos, CAST(sum(CASE WHEN mes % 2 = 0 THEN v ELSE 0 END) AS DECIMAL(24,2)) AS gastos, CAST(sum(CASE WHEN mes % 2 = 0 THEN 0 ELSE v END) AS DECIMAL(24,2)) AS beneficio, CAST(sum(v) AS DECIMAL(24,2)) AS estancias,
  CAST(count(*) AS DECIMAL(24,2)) AS noches_hab, CAST(0 AS DECIMAL(24,2)) AS inversiones, CAST(sum(CASE WHEN mes % 2 = 0 THEN 0 ELSE v END) AS DOUBLE) / CAST(sum(v) AS DOUBLE) * 100 AS margen, CAST(sum(v) AS DOUBLE) / count(*) AS adr FROM s""")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, month = cents("o_totalprice"), F.month(F.to_date("o_orderdate"))
    even = month % 2 == 0
    rows = read(spark, sf_dir, "orders").select(month.alias("mes"), v.alias("ingresos"), F.when(even, v).otherwise(0).alias("gastos"), F.when(even, 0).otherwise(v).alias("beneficio"), v.alias("estancias"), F.lit(1).alias("noches_hab"), F.lit(0).alias("inversiones"))
    return profit.year_totals(rows)


# ------------------------------------------------------------------ text, keys, control


@register("f15_redact")  # SQL engines take \b by ASCII only, so this is tested against Python's re
def f15_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("texto"))


@register("f52_backoff", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(greatest(event_id % 50 - 10, 0), 30)::DOUBLE ELSE least(30, 2 * pow(2, event_id % 6)) * (0.5 + (event_id % 10) / 20.0) END AS espera FROM events")
def f52(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    asked = F.when(e % 4 == 0, (e % 50 - 10).cast("double"))
    return read(spark, sf_dir, "events").select("event_id", streams.backoff_seconds(e % 6, (e % 10) / 10, asked, 2.0, 30.0).alias("espera"))


@register("f63_canonical_args", """SELECT o_orderkey, '{"cuenta":"' || (o_orderkey % 9) || '","hasta":"2001-08-01","limite":"' || CASE WHEN o_orderkey % 2 = 0 THEN '10' ELSE '50' END || '","texto":"bar ' || lower(left(o_orderpriority, 3)) || '"}' AS argumentos FROM orders""")
def f63(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('{"texto": " BAR '), F.left("o_orderpriority", F.lit(3)), F.lit(' ", "cuenta": "'), (_key() % 9).cast("string"), F.lit('"'), F.when(_key() % 2 == 0, ', "limite": "10"').otherwise(""), F.lit("}"))
    defaults = {"limite": "50", "hasta": "2001-08-01"}
    return read(spark, sf_dir, "orders").select("o_orderkey", keys.canonical_args(raw, defaults, ("texto",)).alias("argumentos"))


@register("p09_regex", r"SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[13]-.*(URGENT|MEDIUM)$')")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderpriority").rlike("^[13]-.*(URGENT|MEDIUM)$")).select("o_orderkey")


@register("j02_left_fk", f"WITH {ASIENTO}, h AS (SELECT 'H' || i AS hoja, 'Hoja ' || i AS nombre FROM unnest(range(1, 4)) AS t(i)) SELECT id, coalesce(nombre, '') AS hoja FROM asiento LEFT JOIN h USING (hoja)")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = spark.range(1, 4).select(F.concat(F.lit("H"), F.col("id").cast("string")).alias("hoja"), F.concat(F.lit("Hoja "), F.col("id").cast("string")).alias("nombre"))
    return asiento(spark, sf_dir).join(sheets, "hoja", "left").select("id", F.coalesce("nombre", F.lit("")).alias("hoja"))


@register("o01_multi_sort", f"WITH {ASIENTO} SELECT id, row_number() OVER (ORDER BY fecha, numero, id) AS puesto FROM asiento QUALIFY puesto <= 200")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = asiento(spark, sf_dir).orderBy("fecha", "numero", "id").limit(200)
    return first.select("id", F.row_number().over(Window.orderBy("fecha", "numero", "id")).cast("long").alias("puesto"))  # 200 rows


# ------------------------------------------------------------------ ledger cards, tools


_CODES = f"""WITH {APUNTE}, codigos AS (SELECT DISTINCT left(cuenta, n) AS codigo FROM apunte, (SELECT unnest([1, 2, 3, 4, 5, 8]) AS n))"""


@register("q13_account_card", _CODES + """, t AS (SELECT c.codigo, sum(debe) AS d, sum(haber) AS h FROM codigos c JOIN apunte a ON starts_with(a.cuenta, c.codigo) GROUP BY 1),
p AS (SELECT c.codigo, max(length(a.codigo)) AS n, count(a.codigo) AS ancestros FROM codigos c LEFT JOIN codigos a ON starts_with(c.codigo, a.codigo) AND a.codigo <> c.codigo GROUP BY 1),
k AS (SELECT left(codigo, n) AS codigo, count(*) AS hijos FROM p WHERE n IS NOT NULL GROUP BY 1)
SELECT codigo, ancestros, coalesce(hijos, 0) AS hijos, CAST(coalesce(d, 0) AS DECIMAL(24,2)) AS debe, CAST(coalesce(h, 0) AS DECIMAL(24,2)) AS haber, CAST(coalesce(d, 0) - coalesce(h, 0) AS DECIMAL(24,2)) AS saldo FROM p LEFT JOIN t USING (codigo) LEFT JOIN k USING (codigo)""")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.account_cards(cuenta(spark, sf_dir), apunte(spark, sf_dir))


@register("q11_account_search", _CODES + " SELECT codigo FROM codigos WHERE starts_with(codigo, '4')")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.buscar_cuentas({"cuenta": cuenta(spark, sf_dir)}, "4").select("codigo")


@register("q21_year_grid", "SELECT CAST(day(CAST(o_orderdate AS DATE)) AS BIGINT) AS dia, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN month(CAST(o_orderdate AS DATE)) = {m} THEN CAST(o_totalprice AS DECIMAL(14,2)) END), 0) AS DECIMAL(24,2)) AS m{m:02d}" for m in range(1, 13)) + " FROM orders WHERE year(CAST(o_orderdate AS DATE)) = 1996 GROUP BY 1")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    days = read(spark, sf_dir, "orders").select(F.year(d).alias("anio"), F.month(d).alias("mes"), F.day(d).alias("dia"), cents("o_totalprice").alias("bar"))
    return cash.year_grid(days, 1996, "bar")


@register("q22_payroll_months", "SELECT CAST(c_custkey % 12 + 1 AS INTEGER) AS mes, count(*) AS nominas, count(DISTINCT c_custkey % 40) AS empleados, CAST(sum(CAST(c_acctbal AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS coste FROM customer GROUP BY 1")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    pay = read(spark, sf_dir, "customer").select(F.lit(2001).alias("anio"), (c % 12 + 1).cast("int").alias("mes"), (c % 40).cast("string").alias("nif"), cents("c_acctbal").alias("cost_tot"))
    return cash.payroll_months(pay, 2001)


# ------------------------------------------------------------------ exports, writes, evaluation


@register("k07_update_or_create", "SELECT c_custkey, 'v' || c_custkey AS valor FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'viejo' FROM customer WHERE c_custkey % 2 = 1")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey")
    old = c.where("c_custkey % 4 > 0").withColumn("valor", F.lit("viejo"))
    return writes.upsert(old, c.where("c_custkey % 2 = 0").withColumn("valor", F.concat(F.lit("v"), F.col("c_custkey").cast("string"))), ("c_custkey",))


@register("k10_skip_existing", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'viejo' ELSE 'nuevo' END AS valor FROM customer")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return writes.insert_absent(c.where("c_custkey % 3 = 0").withColumn("valor", F.lit("viejo")), c.withColumn("valor", F.lit("nuevo")), "c_custkey")


@register("d08_vat_to_expense", "SELECT DISTINCT l_orderkey AS asiento_iva, 'gasto' AS concepto FROM lineitem")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    vat = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asiento_iva")).withColumn("concepto", F.lit("gasto"))
    return writes.insert_absent(vat.where("asiento_iva % 5 = 0").distinct(), vat, "asiento_iva")


@register("k12_spanish_text", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, replace(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), '.', ',') AS importe, strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS fecha FROM orders")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.spanish_text(read(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("importe"), F.to_date("o_orderdate").alias("fecha")))


@register("k15_invoice_documents", """SELECT o_orderkey AS document_id, count(*) AS lineas, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS importe FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "orders").select(_key().alias("document_id"), F.col("o_orderpriority").alias("numero"))
    li = read(spark, sf_dir, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("orden"), cents("l_extendedprice").alias("importe"))
    taxes = heads.select("document_id", F.lit("iva").alias("tipo"), F.lit(21).alias("pct"))
    made = sinks.invoice_documents(heads, lines, taxes)
    back = F.from_json("json", "formato string, lineas array<struct<orden:int,importe:decimal(14,2)>>")
    return made.select("document_id", back.alias("j")).where("j.lineas IS NOT NULL AND j.formato = 'factura/1'").select("document_id", F.explode("j.lineas").alias("l")).groupBy("document_id").agg(
        F.count("*").alias("lineas"), F.sum("l.importe").cast("decimal(24,2)").alias("importe"))


@register("k17_label_files", """WITH l AS (SELECT c_custkey, 's' || (c_custkey % 40) AS stem, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS k FROM customer),
n AS (SELECT c_custkey, CASE WHEN k > 1 THEN stem || ' (' || k || ')' ELSE stem END AS nombre FROM l) SELECT nombre, CAST(c_custkey AS VARCHAR) AS json FROM n WHERE nombre NOT IN ('s1', 's2') OR c_custkey % 2 = 0""")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    labels = read(spark, sf_dir, "customer").select(c.alias("document_id"), F.concat(F.lit("s"), (c % 40).cast("string")).alias("stem"), c.cast("string").alias("json"), (c % 2 == 0).alias("corregido"))
    return sinks.label_files(labels, spark.createDataFrame([("s1",), ("s2",)], "nombre string"))


@register("q33_manifest", "WITH d AS (SELECT CAST(('0x' || left(sha256('p' || (o_custkey % 500)), 8)) AS BIGINT) / 4294967295.0 AS u FROM orders) SELECT CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM d GROUP BY 1")
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("p"), (F.col("o_custkey") % 500).cast("string")).alias("grupo"))
    return evaluation.manifest(evaluation.split_dataset(examples, "grupo"))


@register("q35_batch_report", "SELECT CASE WHEN n > 1 THEN 'revisar' ELSE 'ok' END AS estado, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) GROUP BY 1")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cif"), F.col("o_orderpriority").alias("numero"), _key().cast("string").alias("fichero"), F.lit("ok").alias("estado"))
    return invoices.batch_duplicates(rows).groupBy("estado").agg(F.count("*").alias("n"))


@register("a42_same_multiset", "SELECT o_orderkey, o_orderkey % 3 <> 1 AS iguales FROM orders")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array(F.lit(2), F.lit(1), F.lit(2))
    b = F.when(_key() % 3 == 1, F.array(F.lit(1), F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(2), F.lit(1)))
    return read(spark, sf_dir, "orders").select("o_orderkey", evaluation.same_multiset(a, b).alias("iguales"))


@register("p19_open_years", f"{LEDGER} SELECT DISTINCT s.ejercicio FROM asiento s WHERE s.estado = 'borrador'")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asiento(spark, sf_dir).where(~predicates.posted(F.col("estado")) & predicates.in_force(F.col("estado"))).select("ejercicio").distinct()
