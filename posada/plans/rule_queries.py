"""Invoice rules, postings and integrity controls over the driver's tables, each with its DuckDB form.

Every order becomes a draft of one case: a correct invoice but for what the case changes. The SQL side lists the codes
that each case must raise and whether it blocks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import integrity, invoices, ledger
from posada.plans.driver_queries import register
from posada.plans.mapping import APUNTE, ASIENTO, LEDGER, apunte, asiento, cents, cuenta, read

OWN = ("A58818501", "B58378431")
CONTEXT_CODES = ("POSSIBLE_DUPLICATE", "PAGE_QUALITY", "CUSTOMER_MISMATCH")


def _money(x: str) -> Column:
    return F.lit(Decimal(x)).cast("decimal(14,2)")


def _line(**change) -> Column:
    base = {"quantity": "2", "unit_price": "50", "discount": None, "tax_rate": "21", "subtotal": "100.00", "total": "121.00"} | change
    types = {"quantity": "decimal(14,4)", "unit_price": "decimal(14,6)", "discount": "decimal(14,2)", "tax_rate": "decimal(6,3)", "subtotal": "decimal(14,2)", "total": "decimal(14,2)"}
    parts = [F.lit(base[k] and Decimal(base[k])).cast(t).alias(k) for k, t in types.items()]
    return F.struct(*parts, F.array(*(F.lit(x) for x in base.get("unreadable", ()))).cast("array<string>").alias("unreadable"))


def _tax(kind: str = "vat", rate: str = "21", base: str | None = "100.00", amount: str | None = "21.00") -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(Decimal(rate)).cast("decimal(6,3)").alias("rate"), F.lit(base and Decimal(base)).cast("decimal(14,2)").alias("base"), F.lit(amount and Decimal(amount)).cast("decimal(14,2)").alias("amount")
    )


def _date(x: str) -> Column:
    return F.lit(x).cast("date")


def _copy(kind: str, approved: bool = False) -> dict:
    return {"duplicates": F.array(F.struct(F.lit(kind).alias("kind"), F.lit(approved).alias("approved"), F.lit("7").alias("documento")))}


FIELDS = ("supplier_name", "supplier_tax_id", "invoice_number", "invoice_date", "currency", "net_subtotal", "tax_total", "gross_total", "due_date", "supplier_country", "customer_tax_id", "discount_total", "charges_total", "withholding_total", "amount_due")

#: The codes that each case must raise, sorted, and whether it blocks.
EXPECTED: list[tuple[str, bool]] = [
    ("", False),
    ("NOT_AN_INVOICE", True),
    ("SIMPLIFIED_INVOICE", True),
    ("CREDIT_NOTE", False),
    ("SUPPLIER_MISSING", True),
    ("FIELD_UNREADABLE", True),
    ("REQUIRED_ABSENT", True),
    ("REQUIRED_MISSING", True),
    ("CURRENCY_MISSING", True),
    ("FIELD_UNREADABLE", True),
    ("OPTIONAL_UNREADABLE", False),
    ("FIELD_INVALID", True),
    ("LOW_CONFIDENCE", True),
    ("CURRENCY_UNKNOWN", True),
    ("NEGATIVE_TOTAL,TOTAL_MISMATCH", True),
    ("SUPPLIER_IS_OWN_COMPANY", True),
    ("TAX_ID_INVALID", True),
    ("TAX_ID_UNVERIFIED", False),
    ("COUNTRY_TAX_ID_MISMATCH", True),
    ("CUSTOMER_OTHER_COMPANY", True),
    ("CUSTOMER_MISMATCH", True),
    ("FUTURE_DATE", True),
    ("OLD_DATE", True),
    ("DUE_BEFORE_ISSUE", True),
    ("LINE_UNREADABLE", True),
    ("LINE_ARITHMETIC", True),
    ("LINE_TOTAL_MISMATCH", True),
    ("LINES_SUM_MISMATCH", True),
    ("LINE_RATE_NOT_IN_BREAKDOWN", False),
    ("TAX_ARITHMETIC", True),
    ("TAX_RATE_UNUSUAL", True),
    ("TAX_ROW_INCOMPLETE", True),
    ("TAX_TOTAL_MISMATCH", True),
    ("WITHHOLDING_MISMATCH", True),
    ("BASE_MISMATCH", True),
    ("TOTAL_MISMATCH", True),
    ("TOTAL_UNVERIFIED", True),
    ("AMOUNT_DUE_MISMATCH", True),
    ("DUPLICATE_APPROVED", True),
    ("DUPLICATE_SUSPECTED", True),
    ("POSSIBLE_DUPLICATE", True),
    ("LEGACY_MATCH", False),
    ("PAGE_QUALITY", True),
]
_EXPECTED = "(VALUES " + ", ".join(f"({k}, '{codes}', {str(blocks).lower()})" for k, (codes, blocks) in enumerate(EXPECTED)) + ") AS c(caso, codigos, bloqueado)"


def _base() -> dict[str, Column]:
    """A correct invoice."""
    return {
        "document_type": F.lit("invoice"), "supplier_name": F.lit("Proveedor"), "supplier_tax_id": F.lit("B12345674"), "invoice_number": F.lit("F-1"), "invoice_date": _date("2001-06-01"), "currency": F.lit("EUR"),
        "net_subtotal": _money("100.00"), "tax_total": _money("21.00"), "gross_total": _money("121.00"), "due_date": _date("2001-07-01"), "supplier_country": F.lit("ES"), "customer_tax_id": F.lit(OWN[0]),
        "discount_total": _money("0.00"), "charges_total": _money("0.00"), "withholding_total": _money("0.00"), "amount_due": _money("121.00"), "lines": F.array(_line()), "taxes": F.array(_tax()),
        "duplicates": F.array().cast("array<struct<kind:string,approved:boolean,documento:string>>"), "page_problems": F.array().cast("array<struct<page:int,message:string>>"),
    }


def _cases() -> list[dict]:
    """What each case changes, in the order of EXPECTED (states under "state", confidences under "low")."""
    return [
        {},
        {"document_type": F.lit("not_an_invoice")},
        {"document_type": F.lit("receipt")},
        {"document_type": F.lit("credit_note")},
        {"state": {"supplier_name": "absent", "supplier_tax_id": "absent"}},
        {"state": {"gross_total": "unreadable"}},
        {"state": {"invoice_number": "absent"}},
        {"state": {"invoice_date": "missing"}},
        {"state": {"currency": "absent"}},
        {"state": {"net_subtotal": "unreadable"}},
        {"state": {"due_date": "unreadable"}},
        {"state": {"due_date": "missing"}},
        {"low": "gross_total"},
        {"currency": F.lit("XYZ")},
        {"gross_total": _money("-121.00"), "amount_due": _money("-121.00")},
        {"supplier_tax_id": F.lit(OWN[1])},
        {"supplier_tax_id": F.lit("B12345678")},
        {"supplier_tax_id": F.lit("DE123456789"), "supplier_country": F.lit("DE")},
        {"supplier_country": F.lit("FR")},
        {"customer_tax_id": F.lit(OWN[1])},
        {"customer_tax_id": F.lit("B12345674")},
        {"invoice_date": _date("2001-08-03"), "due_date": _date("2001-09-01")},
        {"invoice_date": _date("1995-01-01")},
        {"due_date": _date("2001-05-01")},
        {"lines": F.array(_line(unreadable=("subtotal",)))},
        {"lines": F.array(_line(quantity="3"))},
        {"lines": F.array(_line(total="130.00"))},
        {"lines": F.array(_line(unit_price="45", subtotal="90.00", total="108.90"))},
        {"lines": F.array(_line(tax_rate="10", total="110.00"))},
        {"taxes": F.array(_tax(amount="25.00")), "tax_total": _money("25.00"), "gross_total": _money("125.00"), "amount_due": _money("125.00")},
        {"taxes": F.array(_tax(rate="20", amount="20.00")), "tax_total": _money("20.00"), "gross_total": _money("120.00"), "amount_due": _money("120.00"), "lines": F.array(_line(tax_rate="20", total="120.00"))},
        {"taxes": F.array(_tax(amount=None))},
        {"tax_total": _money("22.00")},
        {"taxes": F.array(_tax(), _tax("withholding", "15", "100.00", "15.00")), "withholding_total": _money("10.00"), "amount_due": _money("111.00")},
        {"taxes": F.array(_tax(base="90.00", amount="18.90")), "tax_total": _money("18.90"), "gross_total": _money("108.90"), "amount_due": _money("108.90")},
        {"gross_total": _money("126.00"), "amount_due": _money("126.00")},
        {"taxes": F.array().cast("array<struct<kind:string,rate:decimal(6,3),base:decimal(14,2),amount:decimal(14,2)>>"), "state": {"net_subtotal": "absent"}},
        {"amount_due": _money("100.00")},
        _copy("business_key", True),
        _copy("business_key"),
        _copy("same_amount_date"),
        _copy("legacy"),
        {"page_problems": F.array(F.struct(F.lit(2).alias("page"), F.lit("oscura").alias("message")))},
    ]


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases()
    case = (F.col("o_orderkey") % len(cases)).cast("int")

    def choose(name: str, base: Column, of) -> Column:
        out = None
        for k, change in enumerate(cases):
            if name in change if of is None else of(change) is not None:
                value = change[name] if of is None else of(change)
                out = F.when(F.col("caso") == k, value) if out is None else out.when(F.col("caso") == k, value)
        return base if out is None else out.otherwise(base)

    states = F.create_map(*(x for f in FIELDS for x in (F.lit(f), choose(f, F.lit("present"), lambda c, f=f: F.lit(c["state"][f]) if f in c.get("state", {}) else None))))
    low = F.create_map(F.lit("gross_total"), choose("low", F.lit("high"), lambda c: F.lit("low") if "low" in c else None))
    drafts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), case.alias("caso"))
    drafts = drafts.select("*", states.alias("states"), low.alias("confidences"), *(choose(n, b, None).alias(n) for n, b in _base().items()))
    unread = {f: F.when(F.col("states")[f] == "present", F.col(f)) for f in FIELDS}
    return invoices.validate(drafts.withColumns(unread), "2001-08-01", OWN[0], OWN)


@register("v01_v11_rule_cases", f"SELECT caso, codigos, bloqueado, count(*) AS n FROM orders JOIN {_EXPECTED} ON caso = o_orderkey % {len(EXPECTED)} GROUP BY ALL")
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_join(F.array_sort(F.transform("issues", lambda x: x["code"])), ",")
    return _checked(spark, sf_dir).groupBy("caso", codes.alias("codigos"), F.col("blocked").alias("bloqueado")).agg(F.count("*").alias("n"))


@register("v13_trainable", f"""SELECT caso, entrenable, count(*) AS n FROM (SELECT o_orderkey % {len(EXPECTED)} AS caso,
  o_orderkey % {len(EXPECTED)} IN (0, 3, 10, 17, 28, 41) OR o_orderkey % {len(EXPECTED)} IN (20, 40, 42) AS entrenable FROM orders) GROUP BY ALL""")
def v13(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = invoices.pending(F.col("issues"), F.array().cast("array<string>"))
    return _checked(spark, sf_dir).groupBy("caso", invoices.trainable(waiting, CONTEXT_CODES).alias("entrenable")).agg(F.count("*").alias("n"))


@register("v12_field_state", """WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'absent' ELSE 'found' END AS dicho, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS leido FROM orders)
SELECT o_orderkey, CASE WHEN dicho = 'unreadable' THEN 'unreadable' WHEN dicho = 'absent' AND leido IS NULL THEN 'absent' WHEN leido IS NOT NULL THEN 'present' ELSE 'missing' END AS estado FROM f""")
def v12(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 3 == 0, "unreadable").when(F.col("o_orderkey") % 3 == 1, "absent").otherwise("found")
    return read(spark, sf_dir, "orders").select("o_orderkey", invoices.field_state(said, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("estado"))


@register("a39_totals_by_rate", """WITH l AS (SELECT l_orderkey AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 10 ELSE 21 END AS iva, CAST(l_extendedprice AS DECIMAL(14,2)) AS importe FROM lineitem),
s AS (SELECT document_id, iva, sum(importe) AS base FROM l GROUP BY 1, 2)
SELECT document_id, CAST(iva AS DECIMAL(6,3)) AS iva_porcentaje, CAST(base AS DECIMAL(24,2)) AS base, CAST(round(CAST(base * iva AS DECIMAL(30,5)) * 0.01, 2) AS DECIMAL(24,2)) AS cuota FROM (SELECT document_id, CAST(iva AS DECIMAL(6,3)) AS iva, CAST(base AS DECIMAL(20,2)) AS base FROM s)""")
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("l_linenumber") % 3 == 0, 4).when(F.col("l_linenumber") % 3 == 1, 10).otherwise(21).cast("decimal(6,3)")
    return invoices.totals_by_rate(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), rate.alias("iva_porcentaje"), cents("l_extendedprice").alias("importe")))


@register("a53_completeness", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + 1 AS campos FROM orders")
def a53(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, k).alias("a"), F.when(k % 3 == 0, k).alias("b"), "o_orderdate")
    return rows.select("o_orderkey", invoices.completeness("a", "b", "o_orderdate").alias("campos"))


_STATES = "['queued', 'processing', 'needs_review', 'pending_approval', 'failed', 'rejected', 'approved']"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in (
    ("queued", ("processing",)), ("processing", ("needs_review", "pending_approval", "failed", "queued")), ("needs_review", ("pending_approval", "rejected", "queued")),
    ("pending_approval", ("approved", "rejected", "needs_review", "queued")), ("failed", ("queued",)), ("rejected", ("queued",))) for b in bs)


@register("d06_transition", f"""WITH d AS (SELECT o_orderkey AS documento_id, {_STATES}[o_orderkey % 7 + 1] AS estado FROM orders),
c AS (SELECT o_orderkey AS documento_id, {_STATES}[(o_orderkey // 7) % 7 + 1] AS hasta, {_STATES}[CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE o_orderkey % 7 + 1 END] AS desde FROM orders)
SELECT documento_id, CASE WHEN c.desde = d.estado AND (c.desde, c.hasta) IN ({_ALLOWED}) THEN c.hasta ELSE d.estado END AS estado FROM d JOIN c USING (documento_id)""")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("queued", "processing", "needs_review", "pending_approval", "failed", "rejected", "approved")))
    k = F.col("o_orderkey").cast("int")
    o = read(spark, sf_dir, "orders")
    documents = o.select(F.col("o_orderkey").alias("documento_id"), names[k % 7].alias("estado"))
    changes = o.select(F.col("o_orderkey").alias("documento_id"), F.when(k % 11 == 0, names[0]).otherwise(names[k % 7]).alias("desde"), names[F.floor(k / 7).cast("int") % 7].alias("hasta"), F.lit(1).alias("ts"))
    return invoices.transition(documents, changes)


@register("d07_field_changes", """SELECT c_custkey, 'c_name' AS campo, c_name AS antes, upper(c_name) || '!' AS despues FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, NULL FROM customer WHERE c_custkey % 6 = 0""")
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return invoices.field_changes(old, new, "c_custkey", ["c_name", "c_mktsegment"])


# ------------------------------------------------------------------ postings and integrity


_ACCOUNTS = """cuentas AS (SELECT DISTINCT left(cuenta, n) AS codigo, n = 8 AND CAST(left(cuenta, 1) AS INTEGER) <> 6 AS imputable, CAST(left(cuenta, 1) AS INTEGER) <> 3 AS activa FROM apunte, (SELECT unnest([1, 2, 3, 4, 5, 8]) AS n))"""


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.left("codigo", F.lit(1))
    return cuenta(spark, sf_dir).withColumn("imputable", F.col("imputable") & (first != "6")).withColumn("activa", first != "3")


@register("a13_odd_accounts", f"""{LEDGER}, {_ACCOUNTS} SELECT a.cuenta, count(*) AS n FROM apunte a JOIN asiento s ON s.id = a.asiento_id JOIN cuentas c ON c.codigo = a.cuenta
WHERE s.estado = 'contabilizado' AND s.ejercicio = 1997 AND NOT (c.imputable AND c.activa) GROUP BY 1""")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir))
    return integrity.odd_accounts(ledger.posted_lines(lines, 1997), _accounts(spark, sf_dir))


@register("p24_out_of_year", f"WITH {ASIENTO} SELECT id, fecha FROM asiento WHERE ejercicio = 1997 AND NOT fecha BETWEEN DATE '1997-02-01' AND DATE '1997-11-30'")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.out_of_year(asiento(spark, sf_dir), 1997, "1997-02-01", "1997-11-30")


@register("j08_opening_differences", f"""{LEDGER}, n AS (SELECT a.cuenta, sum(CASE WHEN s.tipo = 'apertura' AND s.ejercicio = 1997 THEN a.debe - a.haber END) AS ap, sum(CASE WHEN s.tipo = 'cierre' AND s.ejercicio = 1996 THEN a.debe - a.haber END) AS ci
  FROM apunte a JOIN asiento s ON s.id = a.asiento_id GROUP BY 1)
SELECT cuenta, CAST(coalesce(ap, 0) AS DECIMAL(24,2)) AS apertura, CAST(coalesce(-ci, 0) AS DECIMAL(24,2)) AS cierre FROM n WHERE coalesce(ap, 0) <> coalesce(-ci, 0)""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ledger.with_headers(apunte(spark, sf_dir), asiento(spark, sf_dir))
    of = lambda kind, year: lines.where((F.col("tipo") == kind) & (F.col("ejercicio") == year))
    return integrity.opening_differences(of("apertura", 1997), of("cierre", 1996))


@register("q09_integrity_report", f"""{LEDGER}, {_ACCOUNTS}, l AS (SELECT a.*, s.ejercicio, s.tipo, s.estado FROM apunte a JOIN asiento s ON s.id = a.asiento_id), p AS (SELECT * FROM l WHERE estado = 'contabilizado' AND ejercicio = 1997),
c1 AS (SELECT s.id FROM asiento s LEFT JOIN apunte a ON a.asiento_id = s.id WHERE s.ejercicio = 1997 AND s.estado = 'contabilizado' GROUP BY 1 HAVING count(a.asiento_id) < 2 OR coalesce(sum(a.debe), 0) <> coalesce(sum(a.haber), 0)),
c2 AS (SELECT 1 FROM (SELECT sum(debe) AS d, sum(haber) AS h FROM p) WHERE d <> h UNION ALL SELECT 1 FROM (SELECT sum(debe) AS d, sum(haber) AS h FROM p) WHERE d <> h
  UNION ALL SELECT 1 FROM (SELECT sum(CASE WHEN d > h THEN d - h END) AS x, sum(CASE WHEN h > d THEN h - d END) AS y FROM (SELECT cuenta, sum(debe) AS d, sum(haber) AS h FROM p GROUP BY 1)) WHERE coalesce(x, 0) <> coalesce(y, 0)),
c3 AS (SELECT p.cuenta FROM p JOIN cuentas c ON c.codigo = p.cuenta WHERE NOT (c.imputable AND c.activa) GROUP BY 1),
c4 AS (SELECT id FROM asiento WHERE ejercicio = 1997 AND NOT fecha BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'),
c5 AS (SELECT * FROM (SELECT numero - coalesce(lag(numero) OVER (ORDER BY numero), 0) AS g FROM (SELECT DISTINCT numero FROM asiento WHERE ejercicio = 1997)) WHERE g > 1),
c6 AS (SELECT id FROM asiento WHERE ejercicio = 1997 AND estado = 'borrador'),
c7 AS (SELECT a.id FROM asiento a JOIN asiento b ON b.id = a.revierte WHERE b.estado = 'anulado' AND a.estado <> 'anulado' AND a.ejercicio = 1997),
n AS (SELECT cuenta, coalesce(sum(CASE WHEN tipo = 'apertura' AND ejercicio = 1997 THEN debe - haber END), 0) AS ap, coalesce(-sum(CASE WHEN tipo = 'cierre' AND ejercicio = 1996 THEN debe - haber END), 0) AS ci FROM l WHERE estado = 'contabilizado' GROUP BY 1),
r AS (SELECT 'cuadre' AS control, 'error' AS malo, (SELECT count(*) FROM c1) AS n UNION ALL SELECT 'totales', 'error', (SELECT count(*) FROM c2) UNION ALL SELECT 'cuentas', 'aviso', (SELECT count(*) FROM c3)
  UNION ALL SELECT 'fechas', 'error', (SELECT count(*) FROM c4) UNION ALL SELECT 'numeracion', 'aviso', (SELECT count(*) FROM c5) UNION ALL SELECT 'borradores', 'aviso', (SELECT count(*) FROM c6)
  UNION ALL SELECT 'reversiones', 'error', (SELECT count(*) FROM c7) UNION ALL SELECT 'apertura', 'aviso', (SELECT count(*) FROM n WHERE ap <> ci) UNION ALL SELECT 'punteo', 'aviso', 0)
SELECT control, CASE WHEN n > 0 THEN malo ELSE 'ok' END AS estado, n FROM r""")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.report(asiento(spark, sf_dir), apunte(spark, sf_dir), _accounts(spark, sf_dir), 1997, "1997-01-01", "1997-12-31")


@register("v14_posting_errors", f"""{LEDGER}, {_ACCOUNTS}, t AS (SELECT a.asiento_id, count(*) AS n, sum(debe) AS d, sum(haber) AS h, count(CASE WHEN (debe > 0) = (haber > 0) THEN 1 END) AS malos, count(CASE WHEN NOT imputable THEN 1 END) AS agr, count(CASE WHEN NOT activa THEN 1 END) AS ina
  FROM apunte a LEFT JOIN cuentas c ON c.codigo = a.cuenta GROUP BY 1)
SELECT s.id, list_filter([CASE WHEN coalesce(n, 0) < 2 THEN 'DOS_APUNTES' END, CASE WHEN coalesce(d <> h, TRUE) THEN 'DESCUADRE' END, CASE WHEN coalesce(malos > 0, TRUE) THEN 'UN_LADO' END, CASE WHEN coalesce(agr > 0, TRUE) THEN 'NO_IMPUTABLE' END,
  CASE WHEN coalesce(ina > 0, TRUE) THEN 'INACTIVA' END, CASE WHEN s.ejercicio NOT IN (1996, 1997) OR month(s.fecha) = 12 THEN 'FECHA' END, CASE WHEN s.ejercicio <> 1997 THEN 'CERRADO' END], lambda x: x IS NOT NULL) AS errores
FROM asiento s LEFT JOIN t ON t.asiento_id = s.id""")
def v14(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = spark.createDataFrame([(1996, "1996-01-01", "1996-11-30", True), (1997, "1997-01-01", "1997-11-30", False)], "anio long, a string, b string, cerrado boolean")
    years = years.select("anio", F.to_date("a").alias("fecha_inicio"), F.to_date("b").alias("fecha_fin"), "cerrado")
    return ledger.posting_errors(asiento(spark, sf_dir), apunte(spark, sf_dir), _accounts(spark, sf_dir), years)
