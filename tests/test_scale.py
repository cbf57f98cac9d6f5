"""What operators do on large groups and large key ranges: sizes of plans and joins, not times."""

import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from posada.operators import archive, blocks, extraction, headers, invoices, ledger, rates, reports, shapes
from posada.plans import driver_queries, evaluation_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def joined_rows(df):
    """Rows that the joins of a query put out."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        here = node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return here + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rates_are_told_without_trying_all(spark):
    """No row for each of sixty rates, and documents are dealt once for each input."""
    sub = spark.createDataFrame([(1, 1000)], "document_id long, subtotal long")
    printed = spark.createDataFrame([(1, a) for a in (600, 126, 400, 40, 1000, 1166)], "document_id long, amount long")
    numbers = spark.createDataFrame([(1, 42), (1, 20)], "document_id long, rate int")
    infer = lambda: rates.infer(sub, printed, numbers)
    assert [(r.total, r.bases, r.quotas, r.rates, r.several) for r in infer().collect()] == [(1166, [600, 400], [126, 40], [42, 20], False)]
    assert plan(infer()).count("Join ") == 2


def test_nearest_rate_is_the_one_found_by_trying(spark):
    """Bases of one cent to a few euros, where many rates make one quota."""
    pairs = [(b, q) for b in range(1, 140) for q in range(1, 45)]
    a = F.array("q")
    got = spark.createDataFrame(pairs, "b long, q long").select("b", "q", rates.options(F.array("b"), a).alias("o")).collect()
    for r in got:
        tried = [(abs(r.b * x - 200 * r.q), x) for x in range(1, 61) if (r.b * x + 100) // 200 == r.q]
        assert [o.rate for o in r.o] == ([min(tried)[1]] if tried else [])


def test_rows_of_a_page_run_sorted(spark):
    """Rows by the rule, words in any order, some without a place; pages are no groups of pandas."""
    rng = random.Random(5)
    words = [(p, rng.choice([None, *map(float, range(0, 400, 3))]), float(rng.randint(0, 90)), rng.choice([None, 5.0, 10.0, 30.0]), f"w{n}") for n, p in enumerate(rng.choices([None, 1, 2, 3], k=600))]
    df = spark.createDataFrame(words, "page long, top double, left double, height double, text string").repartition(5)
    out = shapes.rows_by_height(df)
    got = {r.text: r.fila for r in out.collect()}
    for page in (None, 1, 2, 3):
        number, base = -1, None
        last = lambda x: (x is None, x or 0)
        for _, top, _, height, text in sorted((w for w in words if w[0] == page), key=lambda w: (last(w[1]), w[2], last(w[3]))):
            if number < 0 or (None not in (base, top, height) and top - base > 0.6 * height):
                number, base = number + 1, top
            assert got[text] == number
    assert len(got) == 600 and "FlatMapGroups" not in plan(out)


def test_copies_of_regions_and_points_make_no_pairs(spark):
    """400 regions with the same sides and 400 points at one place meet once."""
    regions = spark.range(400).select(F.lit(1).alias("page"), F.col("id").alias("region"), *(F.lit(v).alias(c) for c, v in (("left", 0.0), ("bottom", 0.0), ("right", 9.0), ("top", 9.0))))
    regions = regions.unionByName(regions.where("region = 7").withColumn("right", F.lit(8.0)))
    points = spark.range(400).select("id", F.lit(1).alias("page"), F.lit(3.0).alias("x"), F.lit(9.0).alias("y"))
    out = shapes.smallest_container(points, regions)
    assert joined_rows(out) < 1000
    assert {(r.id, r.region) for r in out.collect()} == {(k, 7) for k in range(400)}


def test_inserted_numbers_may_be_customers(spark, tmp_path):
    """orders' numbers plus 100000 are of another origin than customers with such numbers."""
    spark.createDataFrame([(2, "a"), (100002, "b")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2,), (2,), (3,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = driver_queries.queries()["k06_insert_absent"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(2, "a"), (100002, "b"), (100002, "x")]


def test_pairs_found_twice_are_not_gathered(spark):
    """An entry pair that agrees by number and by content is one row, without an aggregate over pairs."""
    heads = spark.createDataFrame([(k, 1997, "1997-01-01", "c", "borrador", n) for k, n in ((1, "F"), (2, "f"), (3, ""), (4, None))], "id long, ejercicio long, fecha string, concepto string, estado string, numero_externo string")
    lines = spark.createDataFrame([(k, "57", 1) for k in (1, 2, 3, 4)], "asiento_id long, cuenta string, debe long")
    pairs = lambda: ledger.possible_duplicates(heads, lines.withColumn("debe", F.col("debe").cast("decimal(14,2)")))
    assert sorted(tuple(r) for r in pairs().collect()) == [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
    assert not re.search(r"Aggregate\(keys=\[id#\d+L?, id_2", plan(pairs()))


def test_rules_run_once(spark):
    """v_rules: no filter repeats the rules."""
    query = driver_queries.queries()["v_rules"](spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    shown = query._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert shown.count("FUTURE_DATE") == 1


def test_blocks_in_two_orders(spark):
    """A sheet's rows are sorted by row, and by name and row, and by nothing else."""
    rows = spark.createDataFrame([("a", "s", 0, ["", "Enero", "Feb", "Marzo"]), ("a", "s", 1, ["P", "1", "2", "x"]), ("a", "s", 3, ["P", "", "", "5"]), ("a", "s", 4, ["Totales", "1", "2", "5"]), ("a", "s", 5, ["Q", "7", "", ""])], "path string, sheet string, row long, celdas array<string>")
    made = blocks.month_blocks(rows)
    assert sorted((r.row, r.bloque, r.persona, r.mes, float(r.importe)) for r in made.amounts.collect()) == [(1, 1, "P", 1, 1.0), (1, 1, "P", 2, 2.0), (3, 2, "P (2)", 3, 5.0)]
    assert plan(blocks.month_blocks(rows).amounts).count(" Sort ") <= 2


def test_many_documents_of_one_key(spark):
    """Each document meets its key once, whatever the number of others."""
    d = spark.range(300).select(F.col("id").alias("documento_id"), F.lit(1).alias("empresa_id"), F.lit("B1").alias("proveedor_nif_norm"), (F.col("id") % 2).cast("string").alias("numero_norm"), F.lit("1997-01-01").cast("date").alias("fecha_factura"), F.lit(1).alias("total_bruto"))
    out = invoices.duplicates(d)
    assert joined_rows(out) <= 600
    got = {}
    for r in out.collect():
        got.setdefault((r.documento_id, r.kind), []).append(r.otro)
    assert got == {(k, kind): [x for x in range(20) if x != k and (x % 2 == k % 2) == (kind == "business_key")][:5] for k in range(300) for kind in ("business_key", "same_amount_date")}


def test_labels_and_values_by_their_own_patterns(spark):
    """labels' patterns run once for each cell, on the side of labels alone."""
    cells = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 9.0, 9.0, "Factura:")], "document_id long, page int, cell int, left double, bottom double, right double, top double, text string")
    assert headers.labelled_values(cells)._jdf.queryExecution().optimizedPlan().toString().count(headers.DATE_LABEL) == 1


def test_cells_of_a_page_are_not_dealt(spark):
    """lines are dealt once, by order; neither cells nor the values found go through another exchange."""
    assert plan(driver_queries.queries()["f21_cell_headers"](spark, "/root/testdata/sf0.001")).count("Exchange ") == 1


def test_invoice_texts_are_dealt(spark):
    """Q29: one small partition of texts is work for more than one task; rates are those found by trying."""
    texts = spark.createDataFrame([(1, "Servicio de limpieza 10,00\nTotal 11,00\n1,00")], "document_id long, text string").coalesce(1)
    out = extraction.extract(texts)
    assert out.rdd.getNumPartitions() > 1 and out.first().tipos == "10"
    for b in range(1, 120):
        for q in range(1, 45):
            base, quota = Decimal(b) / 100, Decimal(q) / 100
            tried = [(abs(base * r / 100 - quota), r) for r in extraction.RATES if extraction.cents(base * r / 100) == quota]
            assert extraction.snap(base, quota) == (min(tried)[1] if tried else None)


def test_readings_are_compared_in_one_table(spark):
    """Q31: both readings and the truth are counted by one aggregate, without joins, and matches by two; a document not read, lines without a flag and lines without a document."""
    schema = "documento long, cantidad long, importe long, f string"
    truth = spark.createDataFrame([(1, 1, 5, "R"), (1, 1, 5, "R"), (2, 1, 7, None), (3, 2, 8, "A"), (None, 1, 1, "A")], schema)
    base = spark.createDataFrame([(1, 1, 5, "R"), (2, 1, 7, None), (4, 1, 1, "A"), (None, 1, 1, "A")], schema)
    better = truth.where("documento < 3")
    found = reports.matches(truth, base, ["documento"], ["cantidad", "importe"])
    assert plan(found).count("HashAggregate(") == 4
    out = reports.compared_documents(evaluation_queries._results(truth, {"base": base, "entrenado": better}), ["base", "entrenado"])
    assert plan(out).count("HashAggregate(") == 6 and "Join" not in plan(out)
    assert {r.metrica: tuple(r)[1:] for r in out.collect()} == {
        "fallos": (0.3333, 0.3333, 0.0), "reconciliacion": (0.5, 1.0, 0.5), "revision": (0.0, 0.5, 0.5), "numero_de_lineas": (0.5, 1.0, 0.5), "impuestos": (0.5, 1.0, 0.5),
    }
    nothing = reports.compared_documents(evaluation_queries._results(truth.limit(0), {"base": base, "entrenado": better}), ["base", "entrenado"]).collect()
    assert len(nothing) == 5 and all(tuple(r)[1:] == (None, None, None) for r in nothing)


def test_lines_of_good_accounts_meet_no_accounts(spark, monkeypatch):
    """A thousand lines of one account are not dealt by it; those of a closed, a doubled, an unknown and a missing account count as before, also in parts."""
    heads = spark.range(4).select("id", F.lit(1997).alias("ejercicio"), F.to_date(F.lit("1997-05-01")).alias("fecha"), F.lit("x").alias("concepto"))
    years = spark.range(1).select(F.lit(1997).alias("anio"), F.to_date(F.lit("1997-01-01")).alias("fecha_inicio"), F.to_date(F.lit("1997-12-31")).alias("fecha_fin"), F.lit(False).alias("cerrado"))
    accounts = spark.createDataFrame([("1", True, True), ("2", True, False), ("3", True, True), ("3", False, True)], "codigo string, imputable boolean, activa boolean")
    side = lambda k: (Decimal(k % 2), Decimal(1 - k % 2))
    rows = [(0, k, "1", *side(k)) for k in range(1000)]
    schema = "asiento_id long, orden long, cuenta string, debe decimal(14,2), haber decimal(14,2)"
    told = lambda lines: ledger.posting_errors(heads, spark.createDataFrame(lines, schema), accounts, years)
    assert joined_rows(told(rows)) < 100
    monkeypatch.setattr(ledger, "LINES_OF_ACCOUNT", 10)
    rows += [(1, k, "2", *side(k)) for k in range(50)] + [(2, 1, "3", Decimal(1), Decimal(0))] + [(3, k, c, *side(k)) for k, c in enumerate(["9", *[None] * 31])]
    got = {r.id: r.errores for r in told(rows).collect()}
    assert got == {0: [], 1: ["INACTIVA"], 2: ["DESCUADRE", "NO_IMPUTABLE"], 3: ["NO_IMPUTABLE", "INACTIVA"]}
    written = archive.create_entries(heads, spark.createDataFrame(rows, schema), accounts, years)[1]
    assert written.columns == [*(c.split()[0] for c in schema.split(", ")), "nuevo_orden"]
    assert [(r.asiento_id, r.nuevo_orden) for r in written.orderBy("nuevo_orden").collect()] == [(0, k + 1) for k in range(1000)]
