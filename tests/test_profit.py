"""Reservations, departments, creditors and cash with figures known by hand."""

from datetime import date
from decimal import Decimal as D

from posada.operators import cash, profit, shapes
from posada.schema import SCHEMAS


def table(spark, name, *rows):
    fields = [f.strip().split(" ") for f in SCHEMAS[name].replace("(12,2)", "#").replace("(10,2)", "@").replace("(14,2)", "!").split(",")]
    blank = lambda kind: "" if kind == "string" else D(0) if kind.startswith("decimal") else False if kind == "boolean" else None
    return spark.createDataFrame([tuple(r.get(n, blank(k)) for n, k in fields) for r in rows], SCHEMAS[name])


def stay(spark, first, last, amount, **more):
    return table(spark, "reserva", {"numero": 1, "entrada": date.fromisoformat(first), "salida": date.fromisoformat(last), "total_estancias": D(amount), "habitaciones": 1, "agencia": "Booking.com"} | more)


def months(df, column="estancias"):
    return {r.mes: r[column] for r in profit.revenue_by_month(df).collect()}


def test_nights_fall_into_their_months(spark):
    got = profit.prorated_by_month(stay(spark, "2026-04-30", "2026-05-04", 400), 2026, "2026-06-15")
    assert months(got) == {4: 100, 5: 300} and sum(months(got, "noches_hab").values()) == 4


def test_net_of_vat(spark):
    got = profit.prorated_by_month(stay(spark, "2026-05-01", "2026-05-02", 220, fact_extras=D(11), fact_impuesto=D(8)), 2026, "2026-06-15", with_vat=False)
    row = profit.revenue_by_month(got).first()
    assert (row.estancias, row.extras, row.tasas) == (200, 10, 8)


def test_forecast_begins_after_today(spark):
    row = profit.revenue_by_month(profit.prorated_by_month(stay(spark, "2026-06-14", "2026-06-18", 400), 2026, "2026-06-15")).first()
    assert (row.estancias, row.previsto) == (200, 200)


def test_other_years_and_day_use(spark):
    assert months(profit.prorated_by_month(stay(spark, "2025-12-30", "2026-01-02", 300), 2026, "2026-06-15")) == {1: 100}
    assert months(profit.prorated_by_month(stay(spark, "2026-03-03", "2026-03-03", 50), 2026, "2026-06-15")) == {3: 50}


def test_quarterly_vat_is_spread(spark):
    vat = table(spark, "apunte_iva", {"libro": "repercutido", "fecha": date(2026, 6, 30), "concepto": "N/FRA hotel BAR", "cuota": D(300)})
    assert {(r.mes, r.serie): r.valor for r in profit.vat_revenue(vat, 2026).collect()} == {(4, "Bar"): 1000, (5, "Bar"): 1000, (6, "Bar"): 1000}


def test_one_cash_sheet_switches_the_source(spark):
    vat = table(spark, "apunte_iva", {"libro": "repercutido", "fecha": date(2026, 1, 10), "concepto": "N/FRA hotel BAR", "cuota": D(300)})
    days = table(spark, "caja_dia", {"anio": 2026, "mes": 4, "dia": 1, "bar": D(1000), "chill_out": D(320), "comedor": D(550), "menus": D(110), "parking_visa": D(121)})
    got = {(r.mes, r.serie): r.valor for r in profit.dining_revenue(days, vat, 2026).collect()}
    assert got == {(4, "Bar"): 1200, (4, "Comedor"): 500, (4, "Menús"): 100, (4, "Parking"): 100}
    assert profit.dining_revenue(days, vat, 2025).count() == 0


def test_vat_is_matched_by_entry_and_document(spark):
    day = date(2026, 2, 1)
    invoices = table(spark, "factura_acreedor", {"fichero": "luz", "acreedor": "Luz", "fecha": day, "documento": "1 ", "cuenta": "62800000", "importe": D(121), "asiento": 5},
                     {"fichero": "obra", "acreedor": "Obra", "fecha": day, "documento": "2", "cuenta": "21200000", "importe": D(9000)},
                     {"fichero": "web", "acreedor": "Web", "fecha": day, "documento": "3", "cuenta": "62700000", "importe": D(50), "asiento": 7})
    vat = table(spark, "apunte_iva", {"libro": "soportado", "fecha": day, "documento": "1", "cuota": D(21), "asiento": 5, "cuenta": "41000001"},
                {"libro": "soportado", "fecha": day, "documento": "3", "cuota": D(10), "asiento": 7}, {"libro": "repercutido", "fecha": day, "documento": "3", "concepto": "S/FRA web", "cuota": D(10), "asiento": 7})
    got = {r.fichero: r for r in profit.creditor_invoices(invoices, vat, 2026).collect()}
    assert got["luz"].importe == 100 and got["luz"].casada and got["luz"].cuenta_410 == "41000001"
    assert got["obra"].inversion and got["obra"].importe == 9000
    assert got["web"].importe == 50 and got["web"].casada


def test_expense_by_days(spark):
    rent = table(spark, "gasto_adicional", {"id": 1, "concepto": "Alquiler", "cuenta": "62100000", "base": D(1200), "desde": date(2026, 1, 1), "hasta": date(2026, 12, 31)})
    got = profit.additional_expenses(rent, 2026, "2026-06-15").collect()
    assert len(got) == 6 and abs(sum(r.importe for r in got) - D(1200) * 181 / 365) < D("0.001")


def test_departments_fall_back(spark):
    listing = table(spark, "departamento_albaran", {"tipo": "A", "numero": "1", "codigo_proveedor": 7, "fecha": date(2026, 1, 1), "total": D(300), "departamento": "COCINA"},
                    {"tipo": "A", "numero": "2", "codigo_proveedor": 7, "fecha": date(2026, 1, 2), "total": D(-400), "departamento": "lavanderia"})
    buy = lambda n, p: {"tipo": "A", "numero": n, "codigo_proveedor": p, "fecha": date(2026, 3, 1), "total": D(10)}
    manual = table(spark, "asignacion_departamento", {"origen": "proveedor", "clave": "8", "departamento": "bar"})
    got = profit.purchases_with_department(table(spark, "compra_proveedor", buy("1", 7), buy("9", 7), buy("1", 8), buy("1", 9)), listing, manual, profit.F.col("total"))
    assert {(r.numero, r.codigo_proveedor): (r.departamento, r.origen_depto) for r in got.collect()} == {
        ("1", 7): ("Cocina", "albaran"), ("9", 7): ("Pisos", "habitual"), ("1", 8): ("Bar", "manual"), ("1", 9): ("Sin asignar", "sin")}


def test_third_party_tiers(spark):
    parties = table(spark, "tercero", {"cuenta": "41000001", "nombre": "Aguas del Sur, S.L.", "tipo": "acreedor"}, {"cuenta": "41000002", "nombre": "Luz Norte SA", "tipo": "acreedor"}, {"cuenta": "40000003", "nombre": "Pan", "tipo": "proveedor"})
    names = spark.createDataFrame([("41000002", "otra cosa"), (None, "AGUAS SUR"), (None, "Luz Norte Comercial"), (None, "Pan")], "cuenta string, nombre string")
    assert {r.nombre: (r.ficha, r.tier) for r in profit.match_third_party(names, parties).collect()} == {"otra cosa": ("41000002", 0), "AGUAS SUR": ("41000001", 1), "Luz Norte Comercial": ("41000002", 2)}


def test_top_with_rest(spark):
    rows = spark.createDataFrame([(f"p{k}", D(100 - k)) for k in range(5)], "nombre string, importe decimal(12,2)")
    assert {r.nombre: r.importe for r in profit.top_with_rest(rows, 2, "nombre", "importe").collect()} == {"p0": 100, "p1": 99, "Resto (3)": 98 + 97 + 96}
    assert profit.top_with_rest(rows, 4, "nombre", "importe").count() == 5


def test_dense_month_and_payroll(spark):
    days = table(spark, "caja_dia", {"anio": 2026, "mes": 4, "dia": 31, "bar": D(9)}, {"anio": 2026, "mes": 4, "dia": 2, "bar": D(5)})
    got = cash.dense_month(days, 2026, 4)
    assert got.count() == 30 and got.agg({"bar": "sum"}).first()[0] == 5
    pay = table(spark, "nomina_mensual", {"nif": "1", "anio": 2026, "mes": 2, "departamento": ""}, {"nif": "1", "anio": 2025, "mes": 9, "departamento": "Bar"}, {"nif": "1", "anio": 2026, "mes": 5, "departamento": "Pisos"})
    assert cash.carry_department(pay, 2026, 2).first().departamento == "Pisos"


def test_balance_breaks_resync(spark):
    rows = spark.createDataFrame([("f", 1, D(10), D(0), D(10)), ("f", 2, D(5), D(0), D(20)), ("f", 3, D(0), D(4), D(16))], "f string, k long, debe decimal(14,2), haber decimal(14,2), saldo decimal(14,2)")
    assert [(r.k, r.esperado) for r in shapes.balance_breaks(rows, "f", "k").collect()] == [(2, 15)]
    assert [(r.k, r.esperado) for r in shapes.local_breaks(rows, "f", "k").collect()] == [(2, 15)]
