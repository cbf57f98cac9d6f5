"""Workbooks written part by part and read back."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from posada.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write(path, sheets, strings):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {NS} {REL}><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k + 7}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        # parts are numbered against the order of the sheets, so only the relations tell them apart
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="t" Target="worksheets/sheet{len(sheets) - k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for k, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{len(sheets) - k}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    strings = ["<t>Día</t>", '<t xml:space="preserve"> Importe </t>', "<r><t>Ca</t></r><r><t>ja</t></r>"]
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
    write(folder / "caja 2025.xlsx", [("Resumen", '<row r="1"><c r="A1" t="s"><v>2</v></c></row>'), ("Mayo 26", head + '<row r="3"><c r="A3"><v>45809</v></c><c r="C3"><v>12.5</v></c><c r="AB3" t="b"><v>1</v></c><c r="AC3"/></row>'), ("ABRIL", head), ("Notas", "")], strings)
    write(folder / "otra.xlsx", [("septiembre 2024", '<row r="1"><c r="B1" t="inlineStr"><is><t>en línea</t></is></c></row>'), ("junio", '<row r="1"><c r="A1" t="str"><v>x</v></c></row>')], [])
    (folder / "rota.xlsx").write_bytes(b"no zip")
    return workbooks.read(spark, str(folder / "*.xlsx"))


def name(path):
    return path.rsplit("/", 1)[1].replace("%20", " ")


def test_cells_of_two_books(books):
    got = {(name(r.path), r.sheet, r.row, r.col): r.value for r in books.cells.collect()}
    assert got == {
        ("caja 2025.xlsx", "Resumen", 1, 1): "Caja", ("caja 2025.xlsx", "Mayo 26", 2, 1): "Día", ("caja 2025.xlsx", "Mayo 26", 2, 3): " Importe ", ("caja 2025.xlsx", "Mayo 26", 3, 1): "45809", ("caja 2025.xlsx", "Mayo 26", 3, 3): "12.5",
        ("caja 2025.xlsx", "Mayo 26", 3, 28): "true", ("caja 2025.xlsx", "ABRIL", 2, 1): "Día", ("caja 2025.xlsx", "ABRIL", 2, 3): " Importe ", ("otra.xlsx", "septiembre 2024", 1, 2): "en línea", ("otra.xlsx", "junio", 1, 1): "x"}
    assert [(name(r.path), r.value) for r in sorted(workbooks.first_sheet(books).collect(), key=lambda r: r.path)] == [("caja 2025.xlsx", "Caja"), ("otra.xlsx", "en línea")]


def test_month_sheets_and_rows(books):
    assert sorted((name(r.path), r.sheet, r.mes, r.anio) for r in workbooks.month_sheets(books).collect() if r.anio) == [("caja 2025.xlsx", "ABRIL", 4, 2025), ("caja 2025.xlsx", "Mayo 26", 5, 2026), ("otra.xlsx", "septiembre 2024", 9, 2024)]
    assert [(r.sheet, r.anio) for r in workbooks.month_sheets(books).where("anio IS NULL").collect()] == [("junio", None)]
    rows = {r.row: r.celdas for r in workbooks.sheet_rows(workbooks.month_cells(books).where("mes = 5").select("path", "sheet", "row", "col", "value")).collect()}
    assert rows[2] == ["Día", "", " Importe "] and rows[3][:3] == ["45809", "", "12.5"] and len(rows[3]) == 28
    assert books.cells.where("row = 3 AND col = 1").select(workbooks.serial_date(F.col("value"))).first()[0] == datetime.date(2025, 6, 1)


def test_broken_files_are_named(books):
    assert [(name(r.path), r.part) for r in books.broken.collect()] == [("rota.xlsx", None)]
