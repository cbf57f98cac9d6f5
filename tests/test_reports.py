"""Multisets of lines and the metrics of documents."""

from posada.operators import reports


def test_lines_match_as_multisets(spark):
    schema = "d string, q int, p int"
    truth = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 2, None), ("b", 1, 1), ("c", 3, 3), (None, 1, 1)], schema)
    got = spark.createDataFrame([("a", 2, None), ("a", 1, 5), ("a", 9, 9), ("b", 1, 1), ("d", 4, 4), (None, 1, 1)], schema)
    found = reports.matches(truth, got, ["d"], ["q", "p"])
    assert {r.d: tuple(r)[1:] for r in found.collect()} == {"a": (2, 1, 1, False), "b": (1, 0, 0, True), "c": (0, 0, 1, False), "d": (0, 1, 0, False), None: (1, 0, 0, True)}
    assert tuple(reports.line_scores(found).first()) == (4, 2, 2, 0.6667, 0.6667, 0.4)
    assert tuple(reports.line_scores(found.limit(0)).first()) == (0, 0, 0, None, None, None)


def test_document_metrics(spark):
    schema = "error string, cuadra boolean, debe_cuadrar boolean, revisar boolean, lineas int, lineas_leidas int, impuestos_iguales boolean"
    rows = [(None, True, True, False, 3, 3, True), (None, False, False, True, 3, 2, False), (None, None, None, None, None, 7, None), ("x", True, True, True, 1, 1, True)]
    got = {r.metrica: (r.valor, r.n) for r in reports.document_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"fallos": (0.25, 4), "reconciliacion": (0.6667, 3), "revision": (0.3333, 3), "numero_de_lineas": (0.5, 2), "impuestos": (0.5, 2)}
    base, better = (spark.createDataFrame(x, "metrica string, valor double") for x in ([("a", 0.5), ("b", None)], [("a", 0.75), ("c", 1.0)]))
    assert sorted(map(tuple, reports.compared({"base": base, "mejor": better}).collect())) == [("a", 0.5, 0.75, 0.25), ("b", None, None, None), ("c", None, 1.0, None)]
