from datetime import date
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posada.functions import dates, keys, numbers, taxid, text
from posada.operators import extraction
from posada.operators.predicates import in_code_range


def column(spark, f, *values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]


def test_amounts(spark):
    assert column(spark, numbers.parse_spanish, "1.234,56", "1234.56", "1 234 €", "", "x", "2,345") == [D("1234.56"), D("1234.56"), D("1234"), None, None, D("2.34")]
    got = column(spark, numbers.parse_amount, "1,234.56", "1.234,56", "12,5 €", "(12,50)", "12,50-", "1.234.567", "1e400", "doce", "", "999999999999", "-3")
    assert got == [D("1234.56"), D("1234.56"), D("12.5"), D("-12.5"), D("-12.5"), D("1234567"), None, None, None, None, D("-3")]
    assert column(spark, numbers.parse_payroll, "1.234", "1.234,5") == [D(1234), D("1234.5")]


def test_dates(spark):
    assert column(spark, dates.parse_date, "2026-03-02T10", "2/3/26", "02-03-2026", "31/02/2026", "x", None) == [date(2026, 3, 2)] * 3 + [None] * 3
    assert column(spark, dates.invoice_months, date(2026, 6, 30), date(2026, 6, 27), date(2026, 5, 31), kind="date") == [[4, 5, 6], [6], [5]]
    assert column(spark, dates.month_of_name, "Marzo 26", "SEPT", "x") == [3, 9, None]


@pytest.mark.parametrize("nif, good", [("12345678Z", True), ("12345678A", False), ("X1234567L", True), ("B12345674", True), ("B12345675", False), ("A58818501", True), ("Q2826000H", True), ("DE123456789", True), ("", True), ("??", False)])
def test_tax_ids(spark, nif, good):
    assert column(spark, taxid.is_valid, nif) == [good]


def test_tax_id_normal_form(spark):
    assert column(spark, taxid.normalise, " es b-12.345/674", None) == ["B12345674", ""]


def test_text(spark):
    assert column(spark, text.department, "COCINA", "cocina ", "Recepcion", "lavandería", "spa", " ", None) == ["Cocina", "Cocina", "Recepción", "Pisos", "Spa", "Sin asignar", "Sin asignar"]
    assert column(spark, text.channel, "111 Expedia Group", "BOOKING", "otra", None) == ["Expedia", "Booking", None, None]
    assert column(spark, text.redact, "ES9121000418450200051332, 4111 1111 1111 1111, 4111 1111 1111 1112, a.b@c.es") == ["[IBAN], [TARJETA], 4111 1111 1111 1112, [EMAIL]"]
    assert column(spark, text.split_code, "12 - Uno - Dos", "Solo")[0].asDict() == {"code": "12", "name": "Uno - Dos"}
    assert column(spark, text.language, "the house is in the way", "necesito una factura", "12") == ["en", "es", "?"]
    assert column(spark, text.company_tokens, "Aguas del Sur, S.L.", None) == [["aguas", "sur"], []]


def test_rates_snap(spark):
    rows = spark.createDataFrame([(D("100.00"), D("7.50")), (D("33.33"), D("7.00")), (D("100.00"), D("7.77"))], "b decimal(14,2), q decimal(14,2)")
    assert [r[0] for r in rows.select(numbers.snap_rate(F.col("b"), F.col("q"))).collect()] == [D("7.5"), D("21"), None]


def test_blind_index_is_hmac(spark):
    import hashlib
    import hmac

    assert column(spark, lambda c: keys.blind_index("clave", c), "B12345674") == [hmac.new(b"clave", b"B12345674", hashlib.sha256).hexdigest()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("0123456789", min_size=1, max_size=8), min_size=1, max_size=8), st.text("0123456789", max_size=3), st.text("0123456789", max_size=3))
def test_code_range(spark, codes, first, last):
    want = [not (first and c[: len(first)] < first) and not (last and c[: len(last)] > last) for c in codes]
    assert column(spark, lambda c: in_code_range(c, first, last), *codes) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(-10**6, 10**6, places=2), min_size=1, max_size=10))
def test_printed_amounts_are_read_back(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v decimal(12,2)")
    assert [r[0] for r in rows.orderBy("k").select(numbers.parse_spanish(text.spanish_amount(F.col("v")))).collect()] == values


def test_invoice_text():
    head, rows = extraction.read_invoice("FACTURA Nº: A-15\nFECHA: 02/03/2026\nCIF B12345674\nALB1 Vino tinto 10 5,00 50,00\nAgua mineral grande 5 10,00 50,00\nBase 100,00\nCuota 7,50\nTotal 107,50")
    assert (head["numero"], head["fecha"], head["cif"], head["total"], head["tipos"], head["cuadra"]) == ("A-15", "02/03/2026", "B12345674", D("107.50"), "7.5", True)
    assert [(r["codigo"], r["importe"]) for r in rows] == [("ALB1", D("50.00")), ("", D("50.00"))]
    head, rows = extraction.read_invoice("Servicio de limpieza 200,00 €\nSubtotal 200,00\nTotal 233,00")
    assert len(rows) == 1 and not head["cuadra"]
    assert extraction.read_invoice("")[0]["n_lineas"] == 0


def test_two_rates():
    text_ = "Vino de la casa 1 60,00 60,00\nAgua de manantial 1 40,00 40,00\n60,00 40,00\n6,00 8,40\nTotal 114,40"
    assert extraction.read_invoice(text_)[0]["tipos"] == "10,21"


def test_calls():
    assert extraction.parse_calls("[f(x=1), a.g(y=[2, 'z'])]") == [("f", {"x": 1}), ("a.g", {"y": [2, "z"]})]
    assert extraction.parse_calls("f(1)") is None and extraction.parse_calls("f(x=y)") is None and extraction.parse_calls("no") is None


def test_redact_against_re(spark):
    """IBANs, cards by Luhn and mail addresses against Python's re, on the smallest documents and on awkward neighbours."""
    import re

    def luhn(digits):
        return sum(x if i % 2 == 0 else 2 * x // 10 + 2 * x % 10 for i, x in enumerate(int(c) for c in digits[::-1])) % 10 == 0

    def want(t):
        t = re.sub(text.IBAN, "[IBAN]", t)
        for card in dict.fromkeys(re.findall(text.CARD, t)):
            if luhn(re.sub("[^0-9]", "", card)):
                t = t.replace(card, "[TARJETA]")
        return re.sub(text.EMAIL, "[EMAIL]", t)

    found = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    found += ["4465758382889437 ñandú", "é4465758382889437", "tarjeta 4465-7583-8288-9437, y ES91 2100 0418 4502 0005 1332.", "a.b+c@d-e.com 4465758382889438", ""]
    rows = spark.createDataFrame([(t,) for t in found], "t string").select("t", text.redact(F.col("t")).alias("r")).collect()
    assert all(r.r == want(r.t) for r in rows)
