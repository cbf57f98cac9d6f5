"""Cell headers, supplier names, typed sort, month blocks and dataset exports."""

import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from posada.operators import blocks, headers, sorting
from posada.sources import datasets

CELLS = "document_id long, page int, cell int, left double, bottom double, right double, top double, text string"


def test_headers_of_cells(spark):
    rows = [
        # below its label beats a farther one beside it; a date and an amount are no numbers
        (1, 1, 1, 100, 700, 160, 710, "Nº FACTURA:"), (1, 1, 2, 105, 680, 150, 690, "Nº A-77"), (1, 1, 3, 240, 700, 280, 710, "B-88"), (1, 1, 4, 165, 700, 190, 710, "12,50"),
        (1, 1, 5, 300, 700, 360, 710, "FECHA EMISIÓN"), (1, 1, 6, 300, 669, 350, 679, " 01/02/2024 "), (1, 1, 7, 300, 690, 350, 699, "01/02/2024 x"),
        # the value of most pages wins
        (2, 1, 1, 0, 0, 40, 10, "Factura"), (2, 1, 2, 50, 0, 90, 10, "X1"), (2, 2, 3, 0, 0, 40, 10, "Factura"), (2, 2, 4, 50, 0, 90, 10, "Y2"), (2, 3, 5, 0, 0, 40, 10, "INVOICE NO."), (2, 3, 6, 50, 0, 90, 10, "Y2"),
        # too far, on another page, without a place, and labels alone; negative places
        (3, 1, 1, 0, 700, 40, 710, "Número"), (3, 1, 2, 161, 700, 190, 710, "C-1"), (3, 1, 3, 0, 650, 40, 667, "C-2"), (3, 2, 4, 0, 690, 40, 699, "C-3"), (3, 1, 5, None, None, None, None, "C-4"), (3, 1, 6, 0, 0, 1, 1, None),
        (4, 1, 1, -200, -300, -160, -290, "Nº"), (4, 1, 2, -130, -300, -100, -290, "D-9"),
    ]
    df = spark.createDataFrame([(*r[:3], *(None if x is None else float(x) for x in r[3:7]), r[7]) for r in rows], CELLS)
    assert {r.document_id: (r.numero, r.fecha) for r in headers.header_from_cells(df).collect()} == {1: ("A-77", "01/02/2024"), 2: ("Y2", None), 3: (None, None), 4: ("D-9", None)}
    assert headers.header_from_cells(df.limit(0)).collect() == []


def test_cell_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows, box = [], {}
    for k in range(400):
        x, y, w, h = rnd.uniform(-50, 600), rnd.uniform(-50, 800), rnd.uniform(1, 300), rnd.uniform(4, 14)
        box[k] = (x, y, x + w, y + h, rnd.choice(["Nº", f"F-{k}", "texto", f"F-{k}"]))
        rows.append((1, 1, k, *box[k]))
    want = {}
    for e, (l, b, r, t, s) in box.items():
        near = []
        for c, (l2, b2, r2, t2, s2) in box.items():
            if s == "Nº" and s2.startswith("F-"):
                if -1 <= b - t2 <= 32 and min(r, r2) - max(l, l2) >= 0.3 * max(min(r - l, r2 - l2), 1):
                    near.append((max(b - t2, 0), c, s2))
                elif abs((t + b - t2 - b2) / 2) <= 4 and -1 <= l2 - r <= 120:
                    near.append((max(l2 - r, 0), c, s2))
        if near:
            want[e] = min(near)[2]
    got = headers.labelled_values(spark.createDataFrame(rows, CELLS)).where("campo = 'numero'").collect()
    assert len(want) > 20 and {r.etiqueta: r.valor for r in got} == want


def test_whole_pages_equal_cells(spark):
    """Pages in one row give the pairs and headers that their cells give as rows, with crowded pages, places and texts that are missing, and pages without a label."""
    import random

    rnd = random.Random(8)
    texts = ("Nº", "Factura:", " FECHA ", "Fecha de emisión", "Nº F-1", "F-2", "F-2", "\u00a0G/7\u00a0", "12,50", "01/02/2024", "3/4/25", "B12345678", "texto", "", None)
    rows = []
    for d in range(60):
        for k in range(rnd.choice((1, 3, 12, 60))):
            x, y, w, h = rnd.uniform(-50, 150), rnd.uniform(-30, 60), rnd.uniform(1, 150), rnd.uniform(4, 14)
            place = [x, y, x + w, y + h]
            if rnd.random() < 0.15:
                place[rnd.randrange(4)] = None
            rows.append((d, k % 2, k, *place, rnd.choice(texts) if d else "texto"))
    cells = spark.createDataFrame(rows, CELLS)
    pages = cells.groupBy("document_id", "page").agg(F.collect_list(F.struct("cell", *headers.CELL, "text")).alias("cells"))
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    pairs = headers.page_values(pages).select("document_id", "page", F.explode("valores").alias("x")).select("document_id", "page", "x.campo", "x.etiqueta", "x.m.valor", "x.m.distancia")
    want = plain(headers.labelled_values(cells))
    assert len({r[2] for r in want}) == 2 and len(want) > 100 and plain(pairs) == want
    got = plain(headers.header_from_pages(pages))
    assert got == plain(headers.header_from_cells(cells)) and len(got) == 60 and (0, None, None) in got
    assert headers.header_from_pages(pages.limit(0)).collect() == []


def test_supplier_names(spark):
    texts = [
        (1, "FACTURA Acme Sistemas del Norte, S.L.\nCIF B12345678\nHotel Mar SA A11111111\n"), (2, "Luz SA\nLuz SA\nSol SL\n"), (3, "B12345678 nada\n"), (4, None), (5, ""),
        (6, "Casa Uno SL CIF: A-11111111\nCasa Dos S.A.U. B87654321\nFACTURA CIF S.L.\n"), (7, "Hotel Mar Playa S.L.\nOtra Cosa C.B.\n12345678Z"),
    ]
    got = headers.supplier_names(spark.createDataFrame(texts, "document_id long, text string"), ("Hotel Mar",), ("A11111111",)).collect()
    assert {r.document_id: (r.cif, r.nombre) for r in got} == {
        1: ("B12345678", "Acme Sistemas del Norte S.L."), 2: (None, "Luz SA"), 3: ("B12345678", None), 4: (None, None), 5: (None, None), 6: ("B87654321", "Casa Dos S.A.U."), 7: ("12345678Z", "Otra Cosa C.B."),
    }


def test_typed_sort(spark):
    rows = [(1, "1.234,50 €"), (2, "(20,00)"), (3, ""), (4, "-3"), (5, None), (6, "7"), (7, "7,0"), (8, "1,2,3")]
    df = spark.createDataFrame(rows, "k int, v string")
    order = lambda *a, **kw: [r.k for r in sorting.typed_sort(df, "v", *a, **kw).collect()]
    assert order("num", "k") == [3, 5, 8, 2, 4, 6, 7, 1]
    assert order("num", "k", descending=True) == [1, 6, 7, 4, 2, 3, 5, 8]
    df = spark.createDataFrame([(1, "31/01/2024"), (2, "nada"), (3, "el 01/02/2023")], "k int, v string")
    assert order("fecha", "k") == [2, 3, 1]
    df = spark.createDataFrame([(1, "ñu"), (2, "Oca"), (3, "nz"), (4, "Ábaco"), (5, "abeto")], "k int, v string")
    assert order("texto", "k") == [5, 3, 2, 4, 1]
    assert order("texto", "k", collation="es") == [4, 5, 3, 1, 2]
    with pytest.raises(ValueError):
        sorting.typed_key(F.col("v"), "otro")


def test_month_blocks(spark):
    cash = [("c", "cash", 1, ["COCINA"]), ("c", "cash", 2, ["Ana Gil"]), ("c", "cash", 3, ["José  Paz"]), ("c", "cash", 4, [""]), ("c", "cash", 5, ["Nadie"]), ("c", "cash", 6, ["bar"]), ("c", "cash", 7, ["Eva Rey"]), ("c", "cash", 8, ["total"])]
    sheet = [
        (1, ["Extras", "Enero"]), (3, ["", "Ene", "feb.", "x", "MARZO"]), (4, ["Ana  Gil", "10.005", "", "9", "texto"]), (5, ["jose paz", "5"]), (6, ["Eva Rey", "1", "0", "", "2.5"]), (7, ["TOTAL", "16"]),
        (8, ["Eva Rey", "4"]), (9, ["Pisos", "", "3"]), (11, ["Otro", "1"]), (12, ["", "99"]), (13, ["Ana Gil", "", "2"]), (14, ["Totales año", "21", "50", "", "2.5"]), (15, ["Fuera", "7"]),
    ]
    rows = spark.createDataFrame(cash + [("f", "2024", k, c) for k, c in sheet], "path string, sheet string, row int, celdas array<string>")
    made = blocks.month_blocks(rows.where("path = 'f'"), blocks.persons_of_sections(rows.where("path = 'c'")))
    got = sorted((r.row, r.bloque, r.persona, r.departamento, r.mes, r.importe) for r in made.amounts.collect())
    d = Decimal
    assert got == [
        (4, 1, "Ana Gil", "Cocina", 1, d("10.00")), (5, 1, "jose paz", "Cocina", 1, d(5)), (6, 1, "Eva Rey", "Cocina", 1, d(1)), (6, 1, "Eva Rey", "Cocina", 3, d("2.50")), (8, 2, "Eva Rey (2)", "", 1, d(4)),
        (9, 2, "Pisos", "Pisos", 2, d(3)), (11, 3, "Otro", "", 1, d(1)), (13, 4, "Ana Gil (2)", "", 2, d(2)),
    ]
    assert sorted((r.row, r.aviso) for r in made.notices.collect()) == [(4, "texto ignorado en el mes 3: texto"), (8, "repetido: Eva Rey (2)"), (13, "repetido: Ana Gil (2)"), (14, "no cuadra el mes 2: 5.00")]
    assert made.headless.collect() == []
    assert [tuple(r) for r in blocks.month_blocks(rows.where("path = 'c'")).headless.collect()] == [("c", "cash")]


def test_dataset_export(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("k"), (F.col("id") % 60).cast("string")).alias("key"), F.concat(F.lit("texto "), (F.col("id") % 120).cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "revisado").alias("origen"), F.lit(None).cast("string").alias("nota"))
    folder = str(tmp_path / "d")
    manifest = datasets.export(df, folder, "key", ("text",), source="origen")
    assert manifest.agg(F.sum("n")).first()[0] == 300 and {r.split for r in manifest.collect()} == {"train", "val", "test"}
    back = datasets.read(spark, folder, df.schema)
    assert sorted(map(tuple, back.drop("split").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert datasets.leaks(back, "key").count() == 0
    with pytest.raises(Exception, match="exist"):
        datasets.export(df, folder, "key", ("text",))
    with pytest.raises(datasets.BrokenDataset, match="several splits"):
        datasets.export(df.withColumn("text", F.lit("igual")), str(tmp_path / "e"), "key", ("text",))
    with pytest.raises(datasets.BrokenDataset, match="without"):
        datasets.export(df.withColumn("key", F.lit(None).cast("string")), str(tmp_path / "e"), "key", ("text",))
    assert not (tmp_path / "e").exists()


@pytest.mark.parametrize("harm", ["altered", "lost", "repeated", "moved", "unfinished"])
def test_broken_exports_are_refused(spark, tmp_path, harm):
    df = spark.range(40).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    datasets.export(df, str(tmp_path / "d"), "key", ("text",))
    part = next(p for p in sorted(pathlib.Path(tmp_path / "d" / "examples").glob("split=train/*.json")) if p.stat().st_size)
    for crc in (tmp_path / "d").rglob(".*.crc"):
        crc.unlink()
    lines = part.read_text().splitlines(True)
    if harm == "unfinished":
        (tmp_path / "d" / "manifest").rename(tmp_path / "gone")
    elif harm == "moved":
        part.rename(tmp_path / "d" / "examples" / "split=test" / "moved.json")
    else:
        part.write_text("".join({"altered": [lines[0].replace("t", "u"), *lines[1:]], "lost": lines[1:], "repeated": [*lines, lines[0]]}[harm]))
    with pytest.raises(datasets.BrokenDataset):
        datasets.read(spark, str(tmp_path / "d"), df.schema)
