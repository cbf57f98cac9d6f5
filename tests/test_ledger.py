"""The five-entry fiscal year whose figures are known by hand."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from posada.operators import integrity, ledger, predicates, statements

ENTRIES = [
    (1, "2026-01-01", "apertura", "", [("57200001", 1000, 0), ("12900001", 0, 1000)]),
    (2, "2026-03-02", "operacion", "F-1", [("60000001", 100, 0), ("47200001", 10, 0), ("40000001", 0, 110)]),
    (3, "2026-04-01", "operacion", "V-1", [("43000001", 1100, 0), ("70500001", 0, 1000), ("47700001", 0, 100)]),
    (4, "2026-05-02", "operacion", "", [("57200001", 1100, 0), ("43000001", 0, 1100)]),
    (5, "2026-05-03", "operacion", "", [("40000001", 110, 0), ("57200001", 0, 110)]),
]


def tables(spark, entries=ENTRIES, year=2026, state="contabilizado"):
    heads = [(n, year, date.fromisoformat(d), n, t, state, None, None, x, f"asiento {n}") for n, d, t, x, _ in entries]
    lines = [(n, k, c, D(a), D(b), "", "x") for n, _, _, _, ls in entries for k, (c, a, b) in enumerate(ls, 1)]
    asiento = spark.createDataFrame(heads, "id long, ejercicio long, fecha date, numero long, tipo string, estado string, hoja string, revierte long, numero_externo string, concepto string")
    apunte = spark.createDataFrame(lines, "asiento_id long, orden long, cuenta string, debe decimal(14,2), haber decimal(14,2), punteo string, concepto string")
    return asiento, apunte


@pytest.fixture(scope="module")
def year(spark):
    asiento, apunte = tables(spark)
    return asiento, apunte, ledger.with_headers(apunte, asiento)


def test_period_trial_balance(year):
    may = ledger.period_trial_balance(year[2], 2026, "2026-05-01", "2026-05-31")
    bank = may.where("codigo = '57200001'").first()
    assert (bank.anterior_debe, bank.periodo_debe, bank.periodo_haber, bank.acumulado_debe, bank.acumulado_haber, bank.saldo_deudor) == (1000, 1100, 110, 2100, 110, 1990)
    checks = ledger.period_checks(may).first()
    assert checks.periodo_debe == 1210 and checks.cuadra_periodo and checks.cuadra_saldos


def test_levels_and_range(year):
    level = lambda n, **k: [r.codigo for r in ledger.period_trial_balance(year[2], 2026, "2026-01-01", "2026-12-31", n, **k).orderBy("codigo").collect()]
    assert level(1) == ["1", "4", "5", "6", "7"]
    assert level(3, code_first="4", code_last="47") == ["400", "430", "472", "477"]
    codes = {r.codigo: r.debe for r in ledger.all_levels(year[1]).collect()}
    assert codes["5"] == codes["572"] == codes["57200001"] == 2100


def test_trial_balance_agrees_with_extract(year):
    for r in ledger.trial_balance(year[2], 2026).collect():
        last = ledger.extract(year[2], 2026, r.cuenta).orderBy(F.desc("fecha"), F.desc("orden")).first()
        assert last.saldo == r.saldo


def test_extract_opening_and_marks(year):
    rows = ledger.extract(year[2], 2026, "572", first="2026-05-03").collect()
    assert [r.saldo for r in rows] == [1990]
    assert ledger.extract(year[2], 2026, "572", mark="punteado").count() == 0
    assert ledger.extract(year[2], 2026, "572", mark="sin").count() == 3


def test_drafts_and_closing_do_not_count(spark):
    asiento, apunte = tables(spark, state="borrador")
    lines = ledger.with_headers(apunte, asiento)
    assert ledger.period_trial_balance(lines, 2026, "2026-01-01", "2026-12-31").count() == 0
    assert ledger.trial_balance(lines, 2026).count() == 8


def test_counterparts(year):
    found = {(r.asiento_id, r.cuenta): (r.n_contrapartidas, r.contrapartida) for r in ledger.counterparts(year[1]).collect()}
    assert found[(2, "40000001")] == (2, "Varias (2)") and found[(2, "60000001")] == (1, "40000001")


def test_journal_shows_whole_entries(year):
    rows = ledger.journal(year[0], year[1], line=F.col("cuenta").startswith("472")).collect()
    assert [(r.id, r.total_debe, r.total_haber, r.n_apuntes) for r in rows] == [(2, 110, 110, 3)]


def test_year_comparison(spark):
    now = spark.createDataFrame([("705", D(-500)), ("600", D(0))], "codigo string, saldo decimal(24,2)")
    before = spark.createDataFrame([("705", D(-1000))], "codigo string, saldo decimal(24,2)")
    assert [tuple(r) for r in ledger.year_comparison(now, before).collect()] == [("705", -500, -1000, 500, D("50.0"))]


def test_integrity_notices_tampering(spark, year):
    assert integrity.unbalanced(year[0], year[1], 2026).count() == 0
    changed = [*ENTRIES[:4], (5, "2026-05-03", "operacion", "", [("40000001", 110, 0), ("57200001", 0, 100)])]
    asiento, apunte = tables(spark, changed)
    accounts = apunte.select(F.col("cuenta").alias("codigo"), F.lit(True).alias("imputable"), F.lit(True).alias("activa")).distinct()
    states = {r.control: r.estado for r in integrity.report(asiento, apunte, accounts, 2026, "2026-01-01", "2026-12-31").collect()}
    assert states["cuadre"] == states["totales"] == "error" and states["fechas"] == states["numeracion"] == states["apertura"] == "ok"


def test_next_free_code(spark):
    codes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "codigo string")
    assert ledger.next_free_code(codes("57200001", "57200004", "572"), "572").first()[0] == "57200005"
    assert ledger.next_free_code(codes("4009", "4001", "4002"), "400", 4).first()[0] == "4003"


def test_closing_balances_out(year):
    lines = ledger.closing_lines(ledger.non_zero_balances(year[2], predicates.any_prefix(F.col("cuenta"), ["6", "7"])), "12900000")
    assert lines.agg(F.sum("debe") - F.sum("haber")).first()[0] == 0
    assert {r.cuenta: r.haber for r in lines.collect()}["12900000"] == 900


def test_statement_with_sections_and_pending_result(spark, year):
    rows = [
        ("balance", 0, "deudor", "A", None, 0, "", [], False), ("balance", 0, "deudor", "A.1", "A", 1, "57, 472", [], False), ("balance", 0, "deudor", "A.2", "A", 2, "551", [], False),
        ("balance", 1, "acreedor", "P", None, 3, "", [], False), ("balance", 1, "acreedor", "P.1", "P", 4, "129", [], True), ("balance", 1, "acreedor", "P.2", "P", 5, "477, 551", [], False),
    ]
    model = spark.createDataFrame(rows, statements.MODEL)
    balances = statements.year_balances(year[2], "balance", (2026, 2025))
    values = statements.statement(balances, model, ("1", "2", "3", "4", "5"))
    got = {r.ref: r.actual for r in values.collect()}
    assert got == {"A": 2000, "A.1": 2000, "A.2": 0, "P": 2000, "P.1": 1900, "P.2": 100}
    assert {r.seccion: r.actual for r in statements.section_totals(values, model).collect()} == {0: 2000, 1: 2000}


def test_mixed_account_goes_by_its_sign(spark):
    model = spark.createDataFrame([("b", 0, "deudor", "A", None, 0, "551", [], False), ("b", 1, "acreedor", "P", None, 1, "551", [], False)], statements.MODEL)
    balances = spark.createDataFrame([("55100001", 0, D(5)), ("55100002", 0, D(-7))], "cuenta string, columna int, saldo decimal(24,2)")
    assert {r.cuenta: r.ref for r in statements.assign(balances, model).collect()} == {"55100001": "A", "55100002": "P"}


def test_abridged_accounts(spark):
    figures = spark.createDataFrame([(2025, D(5_000_000), D(9_000_000), 10), (2026, D(3_000_000), D(7_000_000), None)], "anio int, activo decimal(20,2), cifra decimal(20,2), trabajadores int")
    now = {r.anio: r for r in statements.may_abridge(figures).collect()}[2026]
    assert now.balance_este and not now.balance_puede and now.pyg_puede
