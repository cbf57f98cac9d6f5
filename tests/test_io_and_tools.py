from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from posada.operators import evaluation, invoices, shapes
from posada.plans import tools
from posada.plans.text_queries import _drafts
from posada.sources import readers, sinks, writes
from posada.streaming import events


def test_sniffed_payroll(spark, tmp_path):
    (tmp_path / "n_03_2026.csv").write_text("﻿Hotel;;\nNóminas marzo;;\nN.I.F.;Trabajador;Depto.;Cost. Tot.\n12345678Z;Ana;Cocina;1.234,50\n;;;\n", encoding="utf-8")
    got = readers.payroll(spark, str(tmp_path)).collect()
    assert [(r.nif, r.nombre, r.departamento, r.cost_tot) for r in got] == [("12345678Z", "Ana", "Cocina", D("1234.50"))]


def test_bookings_by_position(spark, tmp_path):
    head = ";".join(readers.BOOKING_HEADER)
    row = lambda n, total: f"{n};01/02/2026;08/05 - SIDE TOURS;x;BB;1;R1;Conf;Ana;;30/04/2026;04/05/2026;1;2;0;0;10,00;img;1,00;2,00;3,00;6,00;0;0;0;0;{total};0;F1"
    (tmp_path / "a.csv").write_text("\n".join([head, row(7, "1.400,50"), row(8, "100"), ";" * 28, "Total" + ";" * 26 + "1.500,50;;"]), encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n".join([head, row(9, "5"), row(9, "5"), "Total" + ";" * 26 + "99;;"]), encoding="utf-8")
    (tmp_path / "c.csv").write_text("otra;cosa\n1;2\n", encoding="utf-8")
    rows, errors = readers.bookings(spark, str(tmp_path))
    got = {(r.numero, r.total_estancias) for r in rows.where("fichero = 'a.csv'").collect()}
    assert got == {(7, D("1400.50")), (8, D("100.00"))}
    first = rows.where("numero = 7").first()
    assert (first.agencia_codigo, first.agencia, first.no_reembolsable, first.entrada, first.adultos, first.deposito, first.facturas) == ("08/05", "SIDE TOURS", True, date(2026, 4, 30), 2, D("10.00"), "F1")
    assert sorted(tuple(r) for r in errors.collect()) == [("b.csv", "el total no cuadra"), ("b.csv", "números repetidos"), ("c.csv", "cabecera inesperada")]


def test_ledger_folder(spark, tmp_path):
    head = ";".join(readers.LEDGER_HEADER)
    (tmp_path / "acr_luz_sur_2026.csv").write_text("\n".join([head, "01/01/2026;;APERTURA;;0;10;-10;1;1", "02/01/2026;A1;S/FRA LUZ DEL SUR;622;0;100,50;-110,50;2;1", "03/01/2026;;N/PAGO LUZ;572;60;0;-40,50;3;1", "04/01/2026;A2;s/fra ;622;5;0;-35,50;4;1"]), encoding="utf-8")
    rows, breaks = readers.ledgers(spark, str(tmp_path))
    assert [r.tipo for r in rows.orderBy("fila").collect()] == ["apertura", "factura", "pago", "factura"]
    assert [(r.fila, r.esperado, r.saldo) for r in breaks.collect()] == [(4, D("-50.50"), D("-40.50"))]
    made = readers.creditor_movements(rows).orderBy("asiento").collect()
    assert [(r.fichero, r.acreedor, r.documento, r.importe) for r in made] == [("luz_sur", "LUZ DEL SUR", "A1", D("100.50")), ("luz_sur", "luz_sur", "A2", D("-5.00"))]


def test_third_parties(spark, tmp_path):
    (tmp_path / "t.csv").write_text("cuenta,nombre,nif\n400001,Uno  SL,B1,,,,,Bebidas,Bar\n41000002,Dos,,,,,,,\n41000002,Dos,B2,,,,,Luz,\n999,X\n,y\n", encoding="utf-8")
    got = {r.cuenta: (r.nombre, r.nif, r.tipo, r.categoria, r.departamentos) for r in readers.third_parties(spark, str(tmp_path)).collect()}
    assert got == {"400001": ("Uno SL", "B1", "proveedor", "Bebidas", "Bar"), "41000002": ("Dos", "B2", "acreedor", "Luz", ""), "999": ("X", "", "otro", "", "")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f", "A", date(2026, 1, 2), "d", "62", D("1234.50"), 1, 2)], "fichero string, acreedor string, fecha date, documento string, cuenta string, importe decimal(12,2), asiento int, linea int")
    sinks.write_csv(df, str(tmp_path / "x"))
    assert [tuple(r) for r in readers.creditors(spark, str(tmp_path / "x")).collect()] == [tuple(r) for r in df.collect()]


def test_wide_months_and_chart_of_accounts(spark, tmp_path):
    wide = spark.createDataFrame([("Ana", "10,5", "", "3")], "persona string, a string, b string, c string")
    assert {(r.mes, r.importe) for r in readers.wide_months(wide, ["persona"], ["a", "b", "c"]).collect()} == {(1, D("10.50")), (3, D("3.00"))}
    (tmp_path / "plan.json").write_text('{"cuentas": [{"codigo": "5", "nombre": "x"}, {"codigo": "572", "nombre": "y"}, {"codigo": "57", "nombre": "z"}]}')
    assert {r.codigo: r.padre for r in readers.chart_of_accounts(spark, str(tmp_path / "plan.json")).collect()} == {"5": None, "57": "5", "572": "57"}


def test_write_modes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", ""), (3, "C", "y")], "k int, v string, w string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(writes.upsert(old, new, ("k",), keep_if_blank=("w",))) == [(1, "a", "x"), (2, "B", ""), (3, "C", "y")]
    assert rows(writes.replace_keys(old, new, "k")) == [(1, "a", "x"), (2, "B", ""), (3, "C", "y")]
    assert rows(writes.insert_absent(old, new, "k")) == [(1, "a", "x"), (2, "b", ""), (3, "C", "y")]
    assert rows(writes.replace_slice(old, new, F.col("k") == 1)) == [(2, "B", ""), (2, "b", ""), (3, "C", "y")]
    assert rows(writes.sparse_overwrite(old, new.select("k", F.nullif("w", F.lit("")).alias("w")), ["k"], "w")) == [(1, "a", "x"), (2, "b", "")]
    with pytest.raises(writes.RejectedRows):
        writes.require(old)
    writes.require(old.where("k > 9"))


def test_rules_find_wrong_totals(spark):
    checked = invoices.validate(_drafts(spark, "/root/testdata/sf0.001"), "1996-01-01", company="A58818501")
    assert checked.where("id % 7 = 0 AND NOT blocked").count() == 0
    late = checked.where("invoice_date > '1996-01-02'").select(F.transform("issues", lambda x: x["code"]).alias("c"))
    assert late.where(~F.array_contains("c", "FUTURE_DATE")).count() == 0
    blank = _drafts(spark, "/root/testdata/sf0.001").limit(1).withColumn("states", F.create_map(F.lit("currency"), F.lit("absent")))
    codes = {x.code for x in invoices.validate(blank, "1996-01-01").first().issues}
    assert {"SUPPLIER_MISSING", "REQUIRED_MISSING", "CURRENCY_MISSING"} <= codes


def test_transitions(spark):
    docs = spark.createDataFrame([(1, "queued"), (2, "approved")], "documento_id int, estado string")
    changes = spark.createDataFrame([(1, "queued", "processing", 1), (2, "approved", "queued", 1), (1, "failed", "queued", 2)], "documento_id int, desde string, hasta string, ts int")
    assert {r.documento_id: r.estado for r in invoices.transition(docs, changes).collect()} == {1: "processing", 2: "approved"}


def test_metrics(spark):
    v = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "g string, v long")
    row = evaluation.latency(v, "v", "g").first()
    assert (row.mean, row.p95) == (2, 4)
    assert evaluation.nearest_rank_by_count(v, "v", "g").first().p95 == 4
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    m = evaluation.pair_metrics(pairs, pairs.where("a = 1")).first()
    assert (m.hits, m.precision, m.recall) == (1, 1.0, 0.5)


def test_shapes(spark):
    words = spark.createDataFrame([(1, 0.0, 10.0, 10.0), (1, 50.0, 11.0, 10.0), (1, 0.0, 30.0, 10.0)], "page int, left double, top double, height double")
    assert sorted(r.fila for r in shapes.rows_by_height(words).collect()) == [0, 0, 1]
    points = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 90.0)], "page int, x double")
    assert tuple(shapes.cluster_1d(points, "page", "x", 5.0).first()) == (1, 1.0, 3.0, 3)
    cells = spark.createDataFrame([(1, 0.0, 90.0, 40.0, 100.0, "Fecha"), (1, 50.0, 90.0, 80.0, 100.0, "01/02/2026"), (1, 0.0, 60.0, 40.0, 70.0, "03/04/2026")], "page int, left double, bottom double, right double, top double, text string")
    assert shapes.value_beside(cells, F.col("text") == "Fecha", F.col("text").rlike(r"^\d")).first().value == "01/02/2026"


def test_tools(spark):
    from tests.test_ledger import tables

    asiento, apunte = tables(spark)
    t = {"asiento": asiento, "apunte": apunte, "cuenta": apunte.select(F.col("cuenta").alias("codigo"), F.lit("Banco").alias("nombre")).distinct()}
    can = frozenset({"contabilidad"})
    got = tools.run("saldo_cuenta", {"ejercicio": 2026, "cuenta": "572", "desde": "2026-05-01", "hasta": "2026-05-31"}, t, can)
    assert got.status == "ok" and got.rows[0]["final"] == 1990
    assert tools.run("nada", {}, t, can).status == "unknown_tool"
    assert tools.run("resumen_cajas", {"anio": 2026}, t, can).status == "forbidden"
    assert tools.run("saldo_cuenta", {"ejercicio": "2026"}, t, can).status == "invalid"
    assert tools.run("buscar_cuentas", {"texto": "999"}, t, can).status == "empty"
    assert {s["name"] for s in tools.available(can)} >= {"saldo_cuenta", "diario_asientos"}
    t["cuenta"] = t["cuenta"].withColumn("imputable", F.lit(True)).withColumn("activa", F.lit(True))
    controls = {r["control"]: r["estado"] for r in tools.run("comprobacion_contable", {"ejercicio": 2026}, t, can).rows}
    assert controls["cuadre"] == controls["totales"] == "ok"
    assert tools.run("cuentas_anuales", {"ejercicio": 2026}, t, can).status == "ok"
    old = spark.createDataFrame([(1, "Luz", "B1", "F-7", date(2026, 1, 2), D("5.00"))], "referencia int, proveedor string, nif string, numero string, fecha date, total decimal(12,2)")
    stores = {"gestion_facturas": old, "facturas_ia": old.withColumn("empresa_id", F.lit(9)), "empresas": spark.createDataFrame([(8,)], "empresa_id int")}
    bills = frozenset({"facturas"})
    assert [r["origen"] for r in tools.run("buscar_facturas", {"proveedor": "luz", "desde": "2026-01-01"}, stores, bills).rows] == ["gestion_facturas"]
    assert tools.run("buscar_facturas", {}, stores, bills).status == "error" and tools.run("buscar_facturas", {"proveedor": "x"}, stores, can).status == "forbidden"
    ready = tools.run("estado_entrenamiento_facturas", {}, {"documentos": spark.createDataFrame([("approved", True), ("needs_review", False)], "estado string, listo boolean")}, bills)
    assert (ready.rows[0]["listas"], ready.rows[0]["necesitan_revision"]) == (1, 1)
    chart = tools.build_chart("saldo_cuenta_mensual", t, 2026, cuenta="572", last=5)
    assert [r.valor for r in chart.orderBy("mes").collect()] == [1000, 1000, 1000, 1000, 1990]
    with pytest.raises(ValueError):
        tools.build_chart("saldo_cuenta_mensual", t, 2026, cuenta="572", first=9, last=5)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01-01 10:00:00"), (1, "2026-01-01 10:05:00"), (2, "2026-01-01 10:06:00")], "id int, t string").select("id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.drop_replays(stream).writeStream.foreachBatch(events.idempotent_append(str(tmp_path / "out"), lambda d: d)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    rows = spark.createDataFrame([("x", 1), (None, 1), ("x", 3)], "error string, intento int")
    again, dead = events.split_failed(rows)
    assert [(r.intento, r.espera_s) for r in again.collect()] == [(1, 60)] and dead.count() == 1
