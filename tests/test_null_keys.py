"""Rows with missing keys are kept, and counted once."""

from decimal import Decimal

from pyspark.sql import functions as F

from posada.operators import evaluation, ledger, profit, shapes


def test_renumber_keeps_missing_dates(spark):
    rows = [(1, 2024, None, "diario"), (2, 2024, "2024-01-05", "diario"), (3, 2024, None, "cierre"), (4, None, None, None), (5, None, "2024-02-01", "apertura")]
    df = spark.createDataFrame(rows, "id int, ejercicio int, fecha string, tipo string").withColumn("fecha", F.to_date("fecha"))
    assert {r.id: r.nuevo_numero for r in ledger.renumber(df).collect()} == {1: 1, 2: 2, 3: 3, 5: 1, 4: 2}


def test_extract_keeps_missing_dates(spark):
    rows = [(1, "57", "5", "0", None), (2, "57", "7", "0", "2024-03-01")]
    df = spark.createDataFrame(rows, "numero int, cuenta string, debe string, haber string, fecha string")
    df = df.select("numero", "cuenta", F.col("debe").cast("decimal(14,2)"), F.col("haber").cast("decimal(14,2)"), F.to_date("fecha").alias("fecha"), F.lit(2024).alias("ejercicio"), F.lit("").alias("punteo"), F.lit("contabilizado").alias("estado"), F.lit("diario").alias("tipo"), F.lit(1).alias("orden"))
    assert {r.numero: r.saldo for r in ledger.extract(df, 2024, "57").collect()} == {1: Decimal(5), 2: Decimal(12)}


def test_top_with_rest_counts_a_missing_name_once(spark):
    df = spark.createDataFrame([(None, 100), ("a", 40), ("b", 20), ("c", 6)], "nombre string, importe int")
    got = [(r.nombre, int(r.importe)) for r in profit.top_with_rest(df, 2, "nombre", "importe").collect()]
    assert got == [(None, 100), ("a", 40), ("Resto (2)", 26)]


def test_number_gaps_of_the_missing_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 4), ("x", 2)], "serie string, numero long")
    assert sorted(map(tuple, ledger.number_gaps(df, "serie", "numero").collect()), key=repr) == sorted([(None, 2, 3), ("x", 1, 1)], key=repr)


def test_latency_and_median_of_the_missing_group(spark):
    df = spark.createDataFrame([(None, 10), (None, 30), (None, 20), ("m", 5)], "modelo string, ms int")
    assert {r.modelo: (r["mean"], r.p95) for r in evaluation.latency(df, "ms", "modelo").collect()} == {None: (20, 30), "m": (5, 5)}
    assert {r.modelo: r.mediana for r in evaluation.upper_median(df, "ms", "modelo").collect()} == {None: 20, "m": 5}


def test_years_beyond_any_number(spark):
    years = spark.range(1500).select(F.col("id").cast("int").alias("anio"), F.expr("date_add(DATE'1990-01-01', cast(id * 10 as int))").alias("fecha_inicio"), F.expr("date_add(DATE'1990-01-01', cast(id * 10 + 8 as int))").alias("fecha_fin"))
    dates = spark.range(15000).select(F.expr("date_add(DATE'1990-01-01', cast(id as int))").alias("fecha"), "id")
    got = {r.id: r.anio for r in shapes.year_of(dates, years).collect()}
    assert len(got) == 15000 and all(got[k] == (k // 10 if k % 10 < 9 else None) for k in got)
    assert shapes.year_of(spark.createDataFrame([(None,)], "fecha date"), years).collect()[0].anio is None


def test_previous_and_overlapping_years(spark):
    rows = [("a", 1, "2020-01-01", "2020-12-31"), ("a", 2, "2021-01-01", "2021-06-30"), ("a", 3, "2021-06-30", "2022-06-30"), (None, 1, "2020-01-01", "2020-12-31"), (None, 2, "2022-01-01", None), ("b", 9, "2021-01-01", "2021-12-31")]
    years = spark.createDataFrame(rows, "empresa string, anio int, i string, f string").select("empresa", "anio", F.to_date("i").alias("fecha_inicio"), F.to_date("f").alias("fecha_fin"))
    assert {(r.empresa, r.anio): r.anterior for r in shapes.previous_year(years, "empresa").collect()} == {("a", 1): None, ("a", 2): 1, ("a", 3): 1, (None, 1): None, (None, 2): 1, ("b", 9): None}
    assert [(r.empresa, r.anio) for r in shapes.overlapping_years(years, "empresa").collect()] == [("a", 3)]
