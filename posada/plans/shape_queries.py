"""Functions, positional operators, archive, profit matrices and writes over the driver's tables, each with its DuckDB form."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions import dates, keys, numbers, text
from posada.operators import archive, cash, evaluation, invoices, ledger, predicates, profit, shapes, statements
from posada.plans.driver_queries import register
from posada.plans.mapping import APUNTE, ASIENTO, LEDGER, apunte, asiento, cents, cuenta, read
from posada.sources import writes
from posada.streaming import events as streams

# ------------------------------------------------------------------ text, numbers, dates


def _orders(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", *columns)


def _of(index: Column, *values: str | None) -> Column:
    """One of a few values by a number."""
    return F.array(*(F.lit(v) for v in values))[index.cast("int")]


def _key() -> Column:
    return F.col("o_orderkey")


@register("f02_compact_key", "SELECT c_custkey, regexp_replace(lower(c_name) || 'aeiounc' || CAST(c_custkey AS VARCHAR), '[^a-z0-9]', '', 'g') AS clave FROM customer")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("c_name"), F.lit(" ÁÉ-í_óÚ/ñ.Ç "), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.compact_key(raw).alias("clave"))


@register("f04_company_tokens", "SELECT c_custkey, list_sort(list_distinct(['hotel', 'sol', 'cliente', CAST(c_custkey AS VARCHAR)])) AS palabras FROM customer WHERE length(CAST(c_custkey AS VARCHAR)) > 1 UNION ALL SELECT c_custkey, ['cliente', 'hotel', 'sol'] FROM customer WHERE length(CAST(c_custkey AS VARCHAR)) = 1")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("El Hotel, del SOL (Cliente) "), F.col("c_custkey").cast("string"), F.lit(" hotel S.L.U."))
    return read(spark, sf_dir, "customer").select("c_custkey", text.company_tokens(raw).alias("palabras"))


@register("f06_split_code", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS codigo, CASE WHEN c_custkey % 3 = 0 THEN 'solo' ELSE c_name || ' - x' END AS nombre FROM customer")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, "solo").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(" - "), F.col("c_name"), F.lit(" - x")))
    s = text.split_code(raw)
    return read(spark, sf_dir, "customer").select("c_custkey", s["code"].alias("codigo"), s["name"].alias("nombre"))


@register("f07_remove_prefix", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'otro ' || o_orderpriority END AS nombre FROM orders")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(_key() % 2 == 0, "S/FRA ").otherwise("otro "), F.col("o_orderpriority"))
    return _orders(spark, sf_dir, F.regexp_replace(raw, "^S/FRA ", "").alias("nombre"))


@register("f08_concept_class", "SELECT o_orderkey, ['venta', 'compra', 'otro'][o_orderkey % 3 + 1] AS clase FROM orders")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(_key() % 3, "n/fra Bar", "S/FRA Luz", "Ajuste")
    return _orders(spark, sf_dir, text.lines_with_prefix(raw, {"N/FRA": "venta", "S/FRA": "compra"}, "otro").alias("clase"))


@register("f12_aliases", "SELECT o_orderkey, ['EUR', 'USD', 'JPY', NULL][o_orderkey % 4 + 1] AS moneda, ['ES', 'DE', NULL, 'FR'][o_orderkey % 4 + 1] AS pais FROM orders")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.currency(_of(_key() % 4, " euros", "US$", "¥", "12")).alias("moneda"), numbers.country(_of(_key() % 4, "españa", "Germany", "Marte", "fr ")).alias("pais"))


@register("f13_clean", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE left(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) || ' fin', 8) END AS limpio FROM orders")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(_key() % 5 == 0, "  \t ").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" \n  fin ")))
    return _orders(spark, sf_dir, text.clean(raw, 8).alias("limpio"))


@register("f17_function_name", "SELECT c_custkey, left(regexp_replace('buscar ' || c_name || repeat('-x', 40), '[^A-Za-z0-9_]', '_', 'g'), 64) AS funcion FROM customer")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", text.function_name(F.concat(F.lit("buscar "), F.col("c_name"), F.repeat(F.lit("-x"), 40))).alias("funcion"))


@register("f22_name_key", "SELECT c_custkey, 'NIÑOAEU' || regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS clave FROM customer")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", text.name_key(F.concat(F.lit("niño áÉü "), F.col("c_name"))).alias("clave"))


@register("f23_invented_figures", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['9,99'] ELSE [] END AS inventadas FROM orders")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(text.spanish_amount(F.col("o_totalprice")), F.lit(" €"))
    answer = F.concat(F.lit("Son "), shown, F.when(_key() % 3 == 0, " y 9,99 €").otherwise(""))
    return _orders(spark, sf_dir, text.invented_figures(answer, F.concat(F.lit("total "), shown)).alias("inventadas"))


@register("f31_parse_payroll", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,6)) AS importe FROM orders")
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.parse_payroll(F.concat(F.lit(" "), text.spanish_amount(F.col("o_totalprice")))).alias("importe"))


@register("f34_percentage", "SELECT o_orderkey, CAST(round(CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 21 AS DECIMAL(20,4)) * 0.01, 2) AS DECIMAL(20,2)) AS cuota FROM orders")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.percentage_of(cents("o_totalprice"), F.lit(21)).cast("decimal(20,2)").alias("cuota"))


@register("f45_days_in_month", "SELECT o_orderkey, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS dias FROM orders")
def f45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, dates.days_in_month(F.to_date("o_orderdate")).alias("dias"))


@register("f41_months_of_names", "SELECT o_orderkey, CAST([3, 9, NULL, 12][o_orderkey % 4 + 1] AS INTEGER) AS mes, CAST([2025, NULL, 2024, 2031][o_orderkey % 4 + 1] AS INTEGER) AS anio, CAST(o_orderkey % 12 + 1 AS INTEGER) AS mes_fichero FROM orders")
def f41(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("nominas_"), F.lpad((_key() % 12 + 1).cast("string"), 2, "0"), F.lit("_2025.csv"))
    return _orders(
        spark, sf_dir, dates.month_of_name(_of(_key() % 4, "Marzo 25", " SEPT", "total", "diciembre")).alias("mes"), dates.year_of_name(_of(_key() % 4, "caja 2025.xls", "caja", "x2024y2023", "2031")).alias("anio"),
        dates.month_and_year_of_file(file)["mes"].alias("mes_fichero"),
    )


@register("f46_parse_int", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS n FROM orders")
def f46(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.parse_int(F.when(_key() % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), _key().cast("string"), F.lit(".0 ")))).alias("n"))


@register("f47_side_of_balance", "SELECT o_orderkey, ['saldado', 'deudor', 'acreedor'][o_orderkey % 3 + 1] AS lado FROM orders")
def f47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.side_of_balance(F.when(_key() % 3 == 1, cents("o_totalprice")).when(_key() % 3 == 2, -cents("o_totalprice")).otherwise(F.lit(0))).alias("lado"))


@register("f48_unit", "SELECT o_orderkey, CAST([0.01, 1, 0.001, 0.01][o_orderkey % 4 + 1] AS DECIMAL(10,3)) AS unidad FROM orders")
def f48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.unit(_of(_key() % 4, "EUR", "JPY", "KWD", "XXX")).cast("decimal(10,3)").alias("unidad"))


@register("f50_fit", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN CAST(round(o_totalprice, 2) AS DECIMAL(20,2)) END AS valor FROM orders")
def f50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, numbers.fit(cents("o_totalprice"), 7, 2).cast("decimal(20,2)").alias("valor"))


@register("f51_token_cost", "SELECT o_orderkey, round((o_orderkey * 3.0 + (o_orderkey % 100) * 15.0) / 1000000, 8) AS coste FROM orders")
def f51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, F.round(numbers.token_cost(_key(), _key() % 100, F.lit(3.0), F.lit(15.0)), 8).alias("coste"))


@register("f68_group_keys", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'p' || (o_custkey % 3) END AS proveedor, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'p' || (o_custkey % 3) END || '|' || o_orderpriority AS factura, CAST(o_orderkey AS VARCHAR) AS documento FROM orders")
def f68(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")))
    key = lambda by: keys.group_key(by, supplier, F.col("o_orderpriority"), _key())
    return _orders(spark, sf_dir, key("supplier").alias("proveedor"), key("invoice").alias("factura"), key("document").alias("documento"))


@register("f71_fingerprint", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS huella FROM customer""")
def f71(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", keys.fingerprint(F.col("c_custkey"), F.col("c_name")).alias("huella"))


@register("f14_comparable", """SELECT o_orderkey, ['12.35', '1997-03-02', 'B12345674', 'F001', 'DOS PALABRAS', NULL, NULL][o_orderkey % 7 + 1] AS valor FROM orders""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _of(_key() % 7, "gross_total", "invoice_date", "supplier_tax_id", "invoice_number", "supplier_name", "supplier_name", "tax_total")
    value = _of(_key() % 7, "12.345001", "02/03/1997", "es-b 1234567.4", "f-00/1", " dos \n palabras", "", "doce")
    return _orders(spark, sf_dir, archive.comparable(name, value).alias("valor"))


@register("f62_json", "SELECT o_orderkey, o_orderkey % 3 = 0 AS valido, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS total FROM orders")
def f62(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(_key() % 3 == 0, F.concat(F.lit('{"numero": "A", "total": '), _key().cast("string"), F.lit("}"))).when(_key() % 3 == 1, '{"total": null, "numero": "A"}').otherwise("no es json {")
    made = archive.parsed_json(_orders(spark, sf_dir, raw.alias("texto")), "texto", "numero string, total long", ("numero", "total"))
    return made.select("o_orderkey", "valido", F.col("dato.total").alias("total"))


@register("f64_calls", "SELECT o_orderkey AS id, CAST(1 AS INTEGER) AS orden, 'buscar pedido' AS nombre, '{\"activo\": true, \"clave\": ' || o_orderkey || '}' AS argumentos FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, CAST(2 AS INTEGER), 'g', '{\"z\": [1, 2]}' FROM orders WHERE o_orderkey % 2 = 0")
def f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posada.operators import extraction

    good = F.concat(F.lit("[buscar pedido(clave="), _key().cast("string"), F.lit(", activo=true), g(z=[1, 2])]"))
    return extraction.extract_calls(read(spark, sf_dir, "orders").select(_key().alias("id"), F.when(_key() % 2 == 0, good).otherwise("f(x=1)").alias("text")))


# ------------------------------------------------------------------ predicates


@register("p07_p11_line_filters", f"""WITH {APUNTE} SELECT asiento_id, orden, cuenta FROM apunte WHERE lower(concepto) = 'n/fra a f' AND (debe = (SELECT max(debe) FROM apunte) OR haber = (SELECT max(debe) FROM apunte) OR debe > 50000)""")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = apunte(spark, sf_dir)
    most = lines.agg(F.max("debe")).first()[0]
    hit = predicates.same_text(F.col("concepto"), "N/fra A F") & (predicates.amount_on_either_side(most, F.col("debe"), F.col("haber")) | (F.col("debe") > 50000))
    return lines.where(hit).select("asiento_id", "orden", "cuenta")


@register("p23_scoped", "SELECT o_orderkey FROM orders WHERE o_custkey % 4 IN (1, 3)")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.scoped(read(spark, sf_dir, "orders").withColumn("empresa_id", F.col("o_custkey") % 4), [1, 3]).select("o_orderkey")


# ------------------------------------------------------------------ years, dates


_YEARS = "anios AS (SELECT * FROM (VALUES (1993, DATE '1993-01-01', DATE '1993-12-31'), (1994, DATE '1994-01-01', DATE '1994-12-31'), (1995, DATE '1994-12-01', DATE '1995-12-31'), (1997, DATE '1997-01-01', DATE '1997-12-31')) AS t(anio, fecha_inicio, fecha_fin))"


def _years(spark: SparkSession) -> DataFrame:
    rows = [(1993, "1993-01-01", "1993-12-31"), (1994, "1994-01-01", "1994-12-31"), (1995, "1994-12-01", "1995-12-31"), (1997, "1997-01-01", "1997-12-31")]
    return spark.createDataFrame(rows, "anio int, a string, b string").select("anio", F.to_date("a").alias("fecha_inicio"), F.to_date("b").alias("fecha_fin"))


@register("j12_year_of_date", f"WITH {_YEARS} SELECT o_orderkey, anio FROM orders LEFT JOIN anios ON CAST(o_orderdate AS DATE) BETWEEN fecha_inicio AND fecha_fin")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.year_of(_orders(spark, sf_dir, F.to_date("o_orderdate").alias("fecha")), _years(spark)).select("o_orderkey", "anio")


def _company_years(spark: SparkSession, sf_dir: str, name: Column) -> DataFrame:
    """Each customer as a company whose "years" reach from the first to the last order of one name."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("empresa"), name.alias("anio"), F.to_date("o_orderdate").alias("fecha"))
    return orders.groupBy("empresa", "anio").agg(F.min("fecha").alias("fecha_inicio"), F.max("fecha").alias("fecha_fin"))


_COMPANY_YEARS = "anios AS (SELECT o_custkey AS empresa, {name} AS anio, min(CAST(o_orderdate AS DATE)) AS fecha_inicio, max(CAST(o_orderdate AS DATE)) AS fecha_fin FROM orders GROUP BY ALL)"


@register("j13_previous_year", f"WITH {_COMPANY_YEARS.format(name='year(CAST(o_orderdate AS DATE))')} SELECT a.empresa, a.anio, (SELECT max(b.anio) FROM anios b WHERE b.empresa = a.empresa AND b.fecha_fin < a.fecha_inicio) AS anterior FROM anios a")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.previous_year(_company_years(spark, sf_dir, F.year(F.to_date("o_orderdate"))), "empresa")


@register("p20_overlapping_years", f"WITH {_COMPANY_YEARS.format(name='o_orderpriority')} SELECT DISTINCT b.empresa, b.anio FROM anios a JOIN anios b ON a.empresa = b.empresa AND (a.fecha_inicio, a.anio) < (b.fecha_inicio, b.anio) AND a.fecha_fin >= b.fecha_inicio")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.overlapping_years(_company_years(spark, sf_dir, F.col("o_orderpriority")), "empresa").select("empresa", "anio")


@register("t07_realised", "SELECT o_orderkey, CAST(o_orderdate AS DATE) <= DATE '1996-06-15' AS realizado FROM orders")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.realised(_orders(spark, sf_dir, F.to_date("o_orderdate").alias("d")), "d", "1996-06-15").select("o_orderkey", "realizado")


# ------------------------------------------------------------------ positions


@register("w03_resync_fold", """WITH b AS (SELECT l_orderkey AS f, l_linenumber AS k, CAST(l_linenumber AS DECIMAL(20,2)) AS d, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s, (l_orderkey + l_linenumber) % 4 = 0 AND l_linenumber > 1 AS mal, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
p AS (SELECT *, s + 100 * sum(mal::INT) OVER (PARTITION BY f ORDER BY k) AS saldo FROM b)
SELECT f AS fichero, k AS orden, CAST(saldo - 100 AS DECIMAL(20,2)) AS esperado, CAST(saldo AS DECIMAL(20,2)) AS saldo FROM p WHERE mal AND r > 1""")
def w03_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("fichero").orderBy("orden")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fichero"), F.col("l_linenumber").alias("orden")).distinct()
    bad = ((F.col("fichero") + F.col("orden")) % 4 == 0) & (F.col("orden") > 1)
    rows = li.withColumn("debe", F.col("orden").cast("decimal(20,2)")).withColumn("haber", F.lit(0).cast("decimal(20,2)"))
    rows = rows.withColumn("saldo", (F.sum("orden").over(order) + 100 * F.sum(bad.cast("int")).over(order)).cast("decimal(20,2)"))
    return shapes.balance_breaks(rows, "fichero", "orden")


@register("w09_neighbours", """WITH m AS (SELECT DISTINCT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS anio, CAST(month(CAST(o_orderdate AS DATE)) AS INTEGER) AS mes FROM orders)
SELECT anio, mes, lag(anio * 100 + mes) OVER w AS anterior, lead(anio * 100 + mes) OVER w AS siguiente FROM m WINDOW w AS (ORDER BY anio, mes)""")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    months = read(spark, sf_dir, "orders").select(F.year(d).alias("anio"), F.month(d).alias("mes"))
    n = lambda c: F.col(c)["anio"] * 100 + F.col(c)["mes"]
    return cash.neighbours(months).select("anio", "mes", n("anterior").alias("anterior"), n("siguiente").alias("siguiente"))


@register("w12_last_month", "SELECT CAST(max(mes) AS INTEGER) AS mes FROM (SELECT month(CAST(o_orderdate AS DATE)) AS mes FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    sums = read(spark, sf_dir, "orders").where(F.year(d) == 1998).groupBy(F.month(d).alias("mes")).agg(F.sum(cents("o_totalprice")).alias("a"))
    every = spark.range(1, 13).select(F.col("id").cast("int").alias("mes")).join(sums, "mes", "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return cash.last_month_with_data(every, "a")


@register("w16_rows_by_height", "SELECT l_orderkey AS page, l_linenumber AS n, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3) - 1 AS fila FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    words = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.cast("long").alias("n")).distinct().select(
        "page", "n", (F.floor(F.col("n") / 3) * 20 + F.col("n") % 3 * 2).cast("double").alias("top"), (F.col("n") % 3 * 50).cast("double").alias("left"), F.lit(10.0).alias("height"))
    return shapes.rows_by_height(words).select("page", "n", "fila")


@register("j27_join_by_rank", """WITH a AS (SELECT l_orderkey AS p, l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
b AS (SELECT l_orderkey AS p, l_linenumber * 10 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 > 0 OR l_linenumber > 1))
SELECT p, k, x, y FROM a JOIN b USING (p, k, n)""")
def j27(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_linenumber").alias("x")).distinct()
    right = li.where((F.col("p") % 3 > 0) | (F.col("x") > 1)).select("p", (F.col("x") * 10).alias("y"), (-F.col("x")).alias("o"))
    return shapes.join_by_rank(li, right, "p", "x", "o").select("p", F.col("k").cast("long").alias("k"), "x", "y")


@register("j28_value_beside", "SELECT DISTINCT l_orderkey AS page, 'Total' AS label, 'v1' AS value, 9.0 AS distance FROM lineitem")
def j28(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda left, bottom, right, top, t: F.struct(*(F.lit(float(v)).alias(c) for c, v in (("left", left), ("bottom", bottom), ("right", right), ("top", top))), F.lit(t).alias("text"))
    cells = F.array(cell(0, 100, 40, 110, "Total"), cell(49, 101, 80, 111, "v1"), cell(5, 70, 30, 80, "v2"), cell(300, 100, 340, 110, "v3"), cell(45, 100, 48, 110, "x"))
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page")).distinct().select("page", F.explode(cells).alias("c")).select("page", "c.*")
    return shapes.value_beside(pages, F.col("text") == "Total", F.col("text").startswith("v"))


@register("j29_smallest_container", """WITH r AS (SELECT p_partkey % 20 AS page, p_partkey AS region, CAST(p_partkey % 30 AS DOUBLE) AS a, CAST(p_partkey % 30 + 5 + p_partkey % 50 AS DOUBLE) AS b FROM part),
p AS (SELECT s_suppkey AS id, s_suppkey % 20 AS page, CAST(s_suppkey % 40 AS DOUBLE) AS x FROM supplier)
SELECT id, arg_min(region, ((b - a) * 10, region)) AS region FROM p JOIN r USING (page) WHERE x BETWEEN a AND b GROUP BY 1""")
def j29(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    regions = read(spark, sf_dir, "part").select((k % 20).alias("page"), k.alias("region"), (k % 30).cast("double").alias("left"), (k % 30 + 5 + k % 50).cast("double").alias("right"), F.lit(0.0).alias("bottom"), F.lit(10.0).alias("top"))
    s = F.col("s_suppkey")
    points = read(spark, sf_dir, "supplier").select(s.alias("id"), (s % 20).alias("page"), (s % 40).cast("double").alias("x"), F.lit(5.0).alias("y"))
    return shapes.smallest_container(points, regions)


@register("j30_nearest_offset", """WITH n AS (SELECT l_orderkey AS d, 'n' || (l_partkey % 5) AS name, l_linenumber * 10 AS o FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY d, name) AS veces FROM n)
SELECT d AS document_id, arg_min(name, (abs(o - 35), -veces, name)) AS name FROM c GROUP BY 1""")
def j30(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string")).alias("name"), (F.col("l_linenumber") * 10).alias("offset"))
    return shapes.nearest_offset(names, names.select("document_id").distinct().withColumn("anchor", F.lit(35)))


@register("s16_blocks", """WITH r AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS n, l_linenumber % 3 = 0 AS b FROM lineitem)
SELECT f, n, sum(b::INT) OVER (PARTITION BY f ORDER BY n) AS bloque FROM r QUALIFY NOT b""")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("n")).distinct()
    return shapes.blocks_by_blank(rows, "f", "n", F.col("n") % 3 == 0)


@register("a40_delivery_notes", """WITH s AS (SELECT l_orderkey AS document_id, 'A' || (l_linenumber % 2) AS albaran, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS suma FROM lineitem GROUP BY 1, 2)
SELECT document_id, albaran, suma FROM s WHERE document_id % 4 = 1""")
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("A"), (F.col("l_linenumber") % 2).cast("string")).alias("albaran"), cents("l_extendedprice").alias("importe"))
    printed = lines.groupBy("document_id", "albaran").agg((F.sum("importe") + F.when(F.first("document_id") % 4 == 1, Decimal("0.06")).otherwise(Decimal("0.05"))).cast("decimal(24,2)").alias("total"))
    return shapes.delivery_note_totals(lines, printed).select("document_id", "albaran", "suma")


@register("ud04_column_table", """WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT page, count(*) AS n FROM l GROUP BY 1)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY l.n) AS BIGINT) AS k, 'servicio numero' AS descripcion, CAST(l.n + 0.5 AS DECIMAL(14,2)) AS importe FROM l JOIN c USING (page) WHERE c.n >= 2""")
def ud04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from posada.operators.extraction import NOT_A_CHARGE

    word = lambda left, top, t: F.struct(left.cast("double").alias("left"), top.cast("double").alias("top"), F.lit(8.0).alias("height"), t.alias("text"))
    n = F.col("n")
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    # descriptions every 20, amounts every 27 points: not aligned; odd pages lack the last description's amount
    shown = F.replace((n + F.lit(Decimal("0.50"))).cast("decimal(14,2)").cast("string"), F.lit("."), F.lit(","))
    words = li.select("page", F.explode(F.array(word(F.lit(50), n * 20, F.lit("servicio")), word(F.lit(90), n * 20 + 1, F.lit("numero")), word(F.lit(400) + n % 2, n * 27 + 1000, shown))).alias("w")).select("page", "w.*")
    extra = li.select("page").distinct().select("page", F.explode(F.array(word(F.lit(400), F.lit(5000), F.lit("99,00")), word(F.lit(50), F.lit(5001), F.lit("Subtotal")))).alias("w")).select("page", "w.*")
    odd = li.where("page % 2 = 1").groupBy("page").agg(F.max("n").alias("n")).select("page", F.explode(F.array(word(F.lit(50), F.lit(3000), F.lit("sobra")))).alias("w")).select("page", "w.*")
    return archive.column_table(words.unionByName(extra).unionByName(odd), tuple(sorted(NOT_A_CHARGE)))


# ------------------------------------------------------------------ archive


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(_key() % 5 == 0, F.lit(None)).when(_key() % 2 == 0, "ok").otherwise("revisar")
    return read(spark, sf_dir, "orders").select(
        _key().alias("referencia"), state.alias("estado"), F.when(_key() % 5 != 0, _key() % 7 == 0).alias("confirmado"), _of(F.col("o_custkey") % 3, "Bar", "Pisos", "Cocina").alias("departamento"),
        F.concat(F.lit("factura_"), _key().cast("string"), F.lit(".pdf")).alias("archivo"), F.concat(F.lit("F-"), F.col("o_custkey").cast("string")).alias("numero"), F.concat(F.lit("Proveedor "), (F.col("o_custkey") % 50).cast("string")).alias("proveedor"),
        F.concat(F.lit("B"), (F.col("o_custkey") % 50).cast("string")).alias("nif"), F.to_date("o_orderdate").alias("fecha"), cents("o_totalprice").alias("total"), (F.col("o_custkey") % 4).alias("empresa_id"),
    )


_ARCHIVE = """WITH d AS (SELECT o_orderkey AS referencia, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'revisar' END AS estado, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 = 0 END AS confirmado,
  ['Bar', 'Pisos', 'Cocina'][o_custkey % 3 + 1] AS departamento, 'factura_' || o_orderkey || '.pdf' AS archivo, 'F-' || o_custkey AS numero, 'Proveedor ' || (o_custkey % 50) AS proveedor, 'B' || (o_custkey % 50) AS nif,
  CAST(o_orderdate AS DATE) AS fecha, CAST(o_totalprice AS DECIMAL(14,2)) AS total, o_custkey % 4 AS empresa_id FROM orders)"""


@register("q25_invoice_search", _ARCHIVE + """ SELECT 'ia' AS origen, referencia, proveedor, nif, numero, fecha, total FROM d WHERE empresa_id IN (1, 2) AND (proveedor ILIKE '%edor 7%' OR lower(nif) = 'edor 7') AND fecha BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'
UNION ALL SELECT 'archivo', referencia, proveedor, nif, numero, fecha, total FROM d WHERE referencia % 3 = 0 AND (proveedor ILIKE '%edor 7%' OR lower(nif) = 'edor 7') AND fecha BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _archive(spark, sf_dir)
    return archive.search({"ia": d, "archivo": d.where("referencia % 3 = 0").drop("empresa_id")}, [1, 2], supplier="edor 7", first="1994-01-01", last="1996-12-31")


@register("q26_training_readiness", """WITH d AS (SELECT ['approved', 'needs_review', 'queued', 'processing', 'failed', 'rejected'][o_orderkey % 6 + 1] AS estado, o_orderkey % 6 = 0 OR (o_orderkey % 6 = 1 AND o_custkey % 3 = 0) AS listo FROM orders)
SELECT count(*) FILTER (listo) AS listas, count(*) FILTER (estado = 'approved') AS aprobadas, count(*) FILTER (listo) - count(*) FILTER (estado = 'approved') AS etiquetadas, count(*) FILTER (listo AND estado = 'needs_review') AS solo_contexto,
  count(*) FILTER (NOT listo AND estado = 'needs_review') AS necesitan_revision, count(*) FILTER (estado IN ('queued', 'processing')) AS en_cola, count(*) FILTER (estado = 'failed') AS con_error, count(*) FILTER (estado = 'rejected') AS rechazadas FROM d""")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select(_of(_key() % 6, "approved", "needs_review", "queued", "processing", "failed", "rejected").alias("estado"), ((_key() % 6 == 0) | ((_key() % 6 == 1) & (F.col("o_custkey") % 3 == 0))).alias("listo"))
    return archive.training_readiness(d)


@register("q28_archive_counters", _ARCHIVE + " SELECT count(*) AS total, count(*) FILTER (estado IS NULL) AS sin_extraer, count(*) FILTER (estado = 'ok') AS correctas, count(*) FILTER (estado = 'revisar') AS a_revisar, count(*) FILTER (confirmado) AS confirmadas FROM d")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_counters(_archive(spark, sf_dir))


@register("p22_archive_list", _ARCHIVE + " SELECT referencia FROM d WHERE (archivo ILIKE '%a_1%' OR numero ILIKE '%a_1%' OR proveedor ILIKE '%a_1%') AND estado = 'ok' AND departamento = 'Bar' AND (confirmado IS NULL OR NOT confirmado)")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_list(_archive(spark, sf_dir), "A_1", "ok", "Bar", "no").select("referencia")


@register("v17_review_reasons", """SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'sin nombre de proveedor' END, CASE WHEN o_orderkey % 3 = 0 THEN 'sin CIF de proveedor' END, CASE WHEN o_orderkey % 5 = 0 THEN 'sin numero de factura' END, CASE WHEN o_orderkey % 7 = 0 THEN 'sin fecha' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ninguna linea reconocida' WHEN o_orderkey % 4 = 1 THEN 'los totales NO cuadran' END, CASE WHEN o_orderkey % 6 = 0 THEN 'fecha dudosa' END], lambda x: x IS NOT NULL) AS motivos FROM orders""")
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _orders(
        spark, sf_dir, F.when(_key() % 2 != 0, "X").otherwise(" ").alias("nombre"), F.when(_key() % 3 != 0, "B1").alias("cif"), F.when(_key() % 5 != 0, "1").alias("numero"), F.when(_key() % 7 != 0, F.col("o_orderdate")).alias("fecha"),
        (_key() % 4).cast("int").alias("n_lineas"), (_key() % 4 != 1).alias("cuadra"), F.when(_key() % 6 == 0, F.array(F.lit("texto por OCR"), F.lit("fecha dudosa"))).alias("notas"),
    )
    return results.select("o_orderkey", archive.review_reasons(results, ("texto por OCR",)).alias("motivos"))


@register("j31_names", f"WITH {APUNTE}, g AS (SELECT left(cuenta, 3) AS codigo, count(*) AS n FROM apunte GROUP BY 1) SELECT codigo, n, CASE WHEN codigo < '4' THEN 'Cuenta ' || codigo ELSE '' END AS nombre FROM g")
def j31(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = apunte(spark, sf_dir).groupBy(F.left("cuenta", F.lit(3)).alias("codigo")).agg(F.count("*").alias("n"))
    return archive.with_names(groups, cuenta(spark, sf_dir).where("codigo < '4'"))


@register("j32_link_supplier", "SELECT o_orderkey, CASE WHEN o_custkey % 30 < 20 THEN o_custkey % 30 END AS proveedor_id FROM orders")
def j32(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = _orders(spark, sf_dir, F.concat(F.lit("es-b"), F.lpad((F.col("o_custkey") % 30).cast("string"), 8, "0")).alias("supplier_tax_id"))
    suppliers = spark.range(20).select(F.col("id").alias("proveedor_id"), F.concat(F.lit("B"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("cif"))
    return archive.link_supplier(drafts, suppliers.unionByName(suppliers.withColumn("proveedor_id", F.col("proveedor_id") + 100))).select("o_orderkey", "proveedor_id")


@register("k11_replace_children", "SELECT l_orderkey AS document_id, l_linenumber AS orden, 'viejo' AS v FROM lineitem WHERE l_orderkey % 4 > 0 UNION ALL SELECT l_orderkey, l_linenumber, 'nuevo' FROM lineitem WHERE l_orderkey % 8 = 0")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("orden"), F.lit("viejo").alias("v"))
    again = old.where("document_id % 4 = 0")
    return archive.replace_children(old, again.where("document_id % 8 = 0").withColumn("v", F.lit("nuevo")), again)


@register("k14_line_export", _ARCHIVE + " SELECT l_orderkey AS document_id, l_linenumber AS orden, fecha FROM lineitem JOIN d ON referencia = l_orderkey WHERE confirmado")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("orden"))
    return archive.invoice_export(_archive(spark, sf_dir).withColumnRenamed("referencia", "document_id"), lines, True)[1].select("document_id", "orden", "fecha")


@register("d01_created_lines", f"""{LEDGER}, c AS (SELECT asiento_id, 2 AS k FROM apunte WHERE debe > 0 GROUP BY 1),
l AS (SELECT asiento_id, orden, cuenta, debe, haber FROM apunte WHERE debe > 0 UNION ALL SELECT asiento_id, 900, '12900000', 0, sum(debe) FROM apunte WHERE debe > 0 AND asiento_id % 3 > 0 GROUP BY 1),
g AS (SELECT asiento_id FROM l JOIN asiento s ON s.id = asiento_id WHERE s.ejercicio = 1997 GROUP BY 1 HAVING sum(debe) = sum(haber))
SELECT asiento_id, cuenta, debe, haber, row_number() OVER (PARTITION BY asiento_id ORDER BY haber > 0, orden, cuenta, debe, haber) AS nuevo_orden FROM l WHERE asiento_id IN (SELECT asiento_id FROM g)""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = apunte(spark, sf_dir).where("debe > 0").select("asiento_id", "orden", "cuenta", "debe", "haber")
    rest = own.where("asiento_id % 3 > 0").groupBy("asiento_id").agg(F.sum("debe").cast("decimal(14,2)").alias("haber")).select("asiento_id", F.lit(900).cast("long").alias("orden"), F.lit("12900000").alias("cuenta"), F.lit(0).cast("decimal(14,2)").alias("debe"), "haber")
    codes = own.select(F.col("cuenta").alias("codigo")).distinct().unionByName(spark.createDataFrame([("12900000",)], "codigo string")).withColumn("imputable", F.lit(True)).withColumn("activa", F.lit(True))
    years = spark.range(1).select(F.lit(1997).cast("long").alias("anio"), F.to_date(F.lit("1997-01-01")).alias("fecha_inicio"), F.to_date(F.lit("1997-12-31")).alias("fecha_fin"), F.lit(False).alias("cerrado"))
    return archive.create_entries(asiento(spark, sf_dir), own.unionByName(rest), codes, years)[1].select("asiento_id", "cuenta", "debe", "haber", "nuevo_orden")


@register("d04_marks", f"WITH {APUNTE}, a AS (SELECT *, CASE WHEN orden = 3 THEN 'conciliado' ELSE punteo END AS p FROM apunte) SELECT asiento_id, orden, CASE WHEN asiento_id % 5 = 0 AND p <> 'conciliado' THEN 'revisar' ELSE p END AS punteo FROM a")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = apunte(spark, sf_dir).withColumn("punteo", F.when(F.col("orden") == 3, "conciliado").otherwise(F.col("punteo"))).withColumn("punteado_en", F.lit(None).cast("timestamp")).withColumn("punteo_nota", F.lit(""))
    return archive.mark(lines, lines.where("asiento_id % 5 = 0"), "revisar", "2001-08-01 10:00:00", "nota").select("asiento_id", "orden", "punteo")


@register("d03_voided_sums", f"{LEDGER} SELECT a.cuenta, CAST(sum(debe) AS DECIMAL(24,2)) AS debe FROM apunte a JOIN asiento s ON s.id = a.asiento_id WHERE s.estado <> 'anulado' GROUP BY 1")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir)).where(predicates.in_force(F.col("estado")))
    return lines.groupBy("cuenta").agg(numbers.money(F.sum("debe")).alias("debe"))


@register("t08_leases", """WITH j AS (SELECT event_id, ts, event_id % 3 AS m FROM events), n AS (SELECT max(ts) AS now FROM events),
v AS (SELECT count(*) AS vivas FROM j, n WHERE m = 1 AND epoch(now) - epoch(ts) < 600), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM j, n WHERE m = 0 OR m = 1 AND epoch(now) - epoch(ts) >= 600)
SELECT event_id AS documento_id FROM r, v WHERE k <= greatest(25 - vivas, 0)""")
def t08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    now = str(e.agg(F.max("ts")).first()[0])
    jobs = e.select(F.col("event_id").alias("documento_id"), _of(F.col("event_id") % 3, "queued", "processing", "done").alias("estado"), F.col("ts").alias("creado"), F.col("ts").alias("reclamado_en"))
    return archive.leased(jobs, now, 600, 25)


@register("v18_notices", """WITH m AS (SELECT DISTINCT month(CAST(o_orderdate AS DATE)) AS mes FROM orders WHERE year(CAST(o_orderdate AS DATE)) = 1998),
f AS (SELECT DISTINCT mes FROM (SELECT unnest(range(1, 13)) AS mes) WHERE mes NOT IN (SELECT mes FROM m)), p AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 11 = 0)
SELECT 'nominas' AS clave, 'Meses con ingresos pero sin nóminas importadas' AS aviso, count(*) AS n, string_agg(CAST(mes AS VARCHAR), ', ' ORDER BY mes) AS detalle FROM f HAVING count(*) > 0
UNION ALL SELECT 'personas', 'Personas de la hoja de extras sin departamento asignado', n, '' FROM p WHERE n > 0""")
def v18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    present = read(spark, sf_dir, "orders").where(F.year(d) == 1998).select(F.month(d).cast("long").alias("mes"))
    every = spark.range(1, 13).select(F.col("id").alias("mes"))
    parts = {"nominas": archive.months_notice(every, present), "personas": archive.count_notice(read(spark, sf_dir, "customer").where("c_custkey % 11 = 0")), "vacio": archive.count_notice(present.where("false"))}
    return archive.notices(parts, {"nominas": "Meses con ingresos pero sin nóminas importadas", "personas": "Personas de la hoja de extras sin departamento asignado", "vacio": "nunca"})


# ------------------------------------------------------------------ evaluation, profit, writes


@register("a45_compare_models", "SELECT c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN ['a'] ELSE [] END AS fixed, CASE WHEN c_custkey % 3 = 0 THEN ['c', 'd'] ELSE [] END AS regressed FROM customer WHERE c_custkey % 5 > 0")
def a45(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lit = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    base = read(spark, sf_dir, "customer").select(k.alias("name"), F.when(k % 2 == 0, lit("a", "b")).otherwise(lit("b")).alias("wrong"))
    trained = read(spark, sf_dir, "customer").where(k % 5 > 0).select(k.alias("name"), F.when(k % 3 == 0, lit("d", "b", "c")).otherwise(lit("b")).alias("wrong"))
    return evaluation.compare_models(base, trained)


@register("a46_tool_metrics", """WITH r AS (SELECT o_orderpriority AS escenario, 4 AS ll, o_orderkey % 5 AS co, o_orderkey % 3 AS ej, o_orderkey % 4 = 0 AS inv FROM orders)
SELECT escenario, count(*) AS n, round(sum(co)::DOUBLE / sum(ll), 4) AS tasa_correctas, round(sum(ej)::DOUBLE / sum(ll), 4) AS tasa_ejecutadas, count(*) FILTER (inv) AS con_inventadas FROM r GROUP BY ROLLUP (escenario)""")
def a46(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("escenario"), F.lit(4).alias("llamadas"), (_key() % 5).alias("correctas"), (_key() % 3).alias("ejecutadas"),
        F.when(_key() % 4 == 0, "son 12,00 € y 3,50 €").otherwise("son 12,00 €").alias("respuesta"), F.lit("total 12,00 €").alias("resultados"),
    )
    return evaluation.tool_metrics(rows)


@register("a43_pair_metrics", """WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey % 2 = 0), f AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey % 3 = 0),
h AS (SELECT count(*) AS n FROM e JOIN f USING (a, b)) SELECT (SELECT n FROM h) AS hits, (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM f) AS "found",
round((SELECT n FROM h)::DOUBLE / (SELECT count(*) FROM f), 4) AS "precision", round((SELECT n FROM h)::DOUBLE / (SELECT count(*) FROM e), 4) AS recall""")
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return evaluation.pair_metrics(pairs.where("a % 2 = 0"), pairs.where("a % 3 = 0"))


@register("a48_counts_by_origin", "SELECT source AS origen, lang AS licencia, count(*) AS n FROM documents GROUP BY 1, 2")
def a48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("origen"), F.col("lang").alias("licencia")).agg(F.count("*").alias("n"))


@register("a49_mean_confidence", "SELECT event_type, round(avg(value), 4) AS confianza FROM events WHERE value >= 0 GROUP BY 1")
def a49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("value >= 0").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("confianza"))


@register("a34_control_difference", "SELECT o_orderkey, abs(CAST(o_orderkey % 90 AS INTEGER)) > greatest(50, CAST(o_totalprice AS DECIMAL(14,2)) * 0.0002) AND o_totalprice <> 0 AS avisa FROM orders")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = (cents("o_totalprice") / 100).cast("decimal(20,4)")
    return _orders(spark, sf_dir, profit.control_difference(journal + _key() % 90, journal).alias("avisa"))


@register("a28_by_category", """WITH p AS (SELECT '400' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ficha, CAST(l_extendedprice AS DECIMAL(14,2)) AS p, 0 AS c FROM lineitem UNION ALL SELECT '400' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), 0, CAST(l_tax * 100 AS DECIMAL(14,2)) FROM lineitem),
t AS (SELECT '400' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ficha, CASE WHEN s_suppkey % 4 > 0 THEN 'cat' || (s_suppkey % 4) END AS categoria FROM supplier)
SELECT coalesce(categoria, 'Otros') AS nombre, CAST(sum(p) AS DECIMAL(24,2)) AS proveedores, CAST(sum(c) AS DECIMAL(24,2)) AS acreedores, CAST(sum(p) + sum(c) AS DECIMAL(24,2)) AS total FROM p LEFT JOIN t USING (ficha) GROUP BY 1""")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    card = lambda c: F.concat(F.lit("400"), F.lpad(F.col(c).cast("string"), 6, "0"))
    s = F.col("s_suppkey")
    parties = read(spark, sf_dir, "supplier").select(card("s_suppkey").alias("cuenta"), F.when(s % 4 > 0, F.concat(F.lit("cat"), (s % 4).cast("string"))).otherwise("").alias("categoria"))
    bought = li.select(F.col("l_suppkey").alias("codigo_proveedor"), cents("l_extendedprice").alias("importe"))
    return profit.by_category(bought, li.select(card("l_suppkey").alias("ficha"), (F.col("l_tax") * 100).cast("decimal(14,2)").alias("importe")), parties)


@register("a21_payroll_burden", "SELECT " + ", ".join(f"CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * {k}) AS DECIMAL(24,2)) AS {n}" for k, n in enumerate(("deveng", "irpf_din", "irpf_esp", "ss_trabaj", "ss_empr", "s_neto", "cost_tot"), 1)) + " FROM lineitem WHERE l_linenumber = 1")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("deveng", "irpf_din", "irpf_esp", "ss_trabaj", "ss_empr", "s_neto", "cost_tot")
    pay = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 2000).alias("anio"), *((cents("l_extendedprice") * k).alias(n) for k, n in enumerate(names, 1)))
    return cash.payroll_burden(pay, 2001)


@register("j16_third_party", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '4100000' || (c_custkey % 7) WHEN 1 THEN '41000001' WHEN 2 THEN '41000002' END AS ficha, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INTEGER) AS tier FROM customer WHERE c_custkey % 4 < 3""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 4 == 0, F.concat(F.lit("4100000"), (k % 7).cast("string"))).otherwise(F.concat(F.lit("9"), k.cast("string"))).alias("cuenta"),
        _of(k % 4, "Nada que ver", "Luz y Agua S.L.", "Limpiezas Norte", "Otra empresa").alias("nombre"),
    )
    names = names.withColumn("nombre", F.when(k % 4 == 2, F.lit("Limpiezas del Norte Bahía")).otherwise(F.col("nombre")))
    parties = spark.createDataFrame([("41000000", "Cero"), ("41000001", "Agua Luz"), ("41000002", "Limpiezas Norte SL"), *((f"4100000{i}", f"p{i}q{i}") for i in range(3, 7))], "cuenta string, nombre string").withColumn("tipo", F.lit("acreedor"))
    found = profit.match_third_party(names.select("cuenta", "nombre"), parties)
    return names.join(found, ["cuenta", "nombre"]).select("c_custkey", "ficha", "tier")


@register("j11_longest_prefix_nature", f"WITH {APUNTE}, r AS (SELECT * FROM (VALUES ('1', 'patrimonio'), ('4', 'terceros'), ('47', 'hacienda'), ('6', 'gasto')) AS t(p, n)), c AS (SELECT DISTINCT cuenta FROM apunte) SELECT cuenta, arg_max(n, length(p)) AS naturaleza FROM c JOIN r ON starts_with(cuenta, p) GROUP BY 1")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("1", "patrimonio"), ("4", "terceros"), ("47", "hacienda"), ("6", "gasto")], "prefijo string, naturaleza string")
    return statements.longest_prefix(apunte(spark, sf_dir).select("cuenta").distinct(), "cuenta", rules, "prefijo").join(rules, "prefijo").select("cuenta", "naturaleza")


@register("k05_keep_if_blank", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NUEVO' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = old.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "NUEVO").otherwise(""))
    return writes.upsert(old, new, ("c_custkey",), keep_if_blank=("c_mktsegment",))


@register("k02_replace_slice", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey + 1000000, 'BUILDING' FROM customer WHERE c_custkey % 5 = 0")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return writes.replace_slice(old, old.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")), F.col("c_mktsegment") == "BUILDING")


@register("k09_dense_month", """WITH d AS (SELECT CAST(day(CAST(o_orderdate AS DATE)) AS BIGINT) AS dia, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS bar FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29' GROUP BY 1)
SELECT CAST(i AS BIGINT) AS dia, CAST(coalesce(bar, 0) AS DECIMAL(24,2)) AS bar FROM unnest(range(1, 30)) AS t(i) LEFT JOIN d ON dia = i""")
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    days = read(spark, sf_dir, "orders").groupBy(F.year(d).alias("anio"), F.month(d).alias("mes"), F.day(d).alias("dia")).agg(F.sum(cents("o_totalprice")).alias("bar"))
    days = days.withColumns({c: F.lit(0).cast("decimal(12,2)") for c in cash.AMOUNTS if c != "bar"})
    return cash.dense_month(days, 1996, 2).select("dia", "bar")


@register("u10_subset", "SELECT o_orderkey, o_orderkey % 2 = 0 AS dentro FROM orders")
def u10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.when(_key() % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("z")))
    return _orders(spark, sf_dir, (F.size(F.array_except(small, F.array(F.lit("b"), F.lit("a"), F.lit("c")))) == 0).alias("dentro"))


@register("t05_uploads", "SELECT DISTINCT o_custkey % 3 AS entidad, sha256(o_orderpriority) AS sha FROM orders WHERE NOT (o_custkey % 3 = 1 AND o_orderpriority = '1-URGENT')")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("entidad"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("sha"))
    known = files.where(F.col("entidad") == 1).join(spark.createDataFrame([("1-URGENT",)], "p string").select(F.sha2(F.col("p").cast("binary"), 256).alias("sha")), "sha", "left_semi")
    return streams.drop_repeated_uploads(files, known, "entidad", "sha")


@register("t03_retries", "SELECT event_id, CAST(60 * pow(2, event_id % 3 - 1) AS BIGINT) AS espera_s FROM events WHERE event_id % 2 = 0")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "x").alias("error"), (F.col("event_id") % 3).alias("intento"))
    return streams.split_failed(rows, 3)[0].select("event_id", "espera_s")


@register("o08_result_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300")
def o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(300).select("o_orderkey")


@register("o13_series_by_sum", "SELECT o_orderpriority AS serie, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS valor, row_number() OVER (ORDER BY sum(CAST(o_totalprice AS DECIMAL(14,2))) DESC, o_orderpriority) AS puesto FROM orders GROUP BY 1")
def o13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("serie")).agg(numbers.money(F.sum(cents("o_totalprice"))).alias("valor"))
    return sums.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("valor"), "serie")).cast("long"))  # a row for each series


@register("p28_retention", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1995-06-01' AND o_orderstatus IN ('F', 'P') AND o_orderkey % 4 > 0")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, F.to_date("o_orderdate").alias("fecha_retencion"), F.col("o_orderstatus").alias("estado"), F.when(_key() % 4 > 0, "k").otherwise("").alias("clave"))
    return predicates.retention_candidates(rows, "1995-06-01", ["F", "P"]).select("o_orderkey")
