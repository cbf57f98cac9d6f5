"""Sheets of persons by month, whose blocks of rows are departments.

The header is a sheet's first row with three months or more; it says which column is which month. Rows without a name, and rows named
"total", part the blocks; a row named "totales" ends the sheet and is checked against the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.dates import month_of_name
from posada.functions.text import squeeze, strip_accents

SHEET = ["path", "sheet"]
LEAST_MONTHS, TOLERANCE = 3, "0.5"

# Departments, which may also stand as a row's name.
DEPARTMENTS = ("Cocina", "Bar", "Comedor", "Recepción", "Pisos", "Mantenimiento", "Lavandería")


@dataclass(frozen=True)
class MonthBlocks:
    """``amounts`` (path, sheet, row, bloque, persona, departamento, mes, importe), ``notices`` (path, sheet, row, aviso), and ``headless`` sheets (path, sheet)."""

    amounts: DataFrame
    notices: DataFrame
    headless: DataFrame


def _plain(c: Column) -> Column:
    return squeeze(strip_accents(c))


def _department(key: Column) -> Column:
    """The department that a plain name is, else null."""
    return F.coalesce(*(F.when(key == _plain(F.lit(d)), F.lit(d)) for d in DEPARTMENTS))


def persons_of_sections(rows: DataFrame) -> DataFrame:
    """(clave, departamento): persons below a department's name, up to a row without a name; of one in several sections the last counts."""
    named = rows.withColumn("clave", _plain(F.coalesce(F.get("celdas", F.lit(0)), F.lit(""))))
    order = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("clave") == "", F.lit("")).otherwise(_department(F.col("clave")))
    held = named.withColumn("mark", mark).withColumn("departamento", F.last("mark", ignorenulls=True).over(order))
    persons = held.where(F.col("mark").isNull() & (F.col("departamento") != "") & ~F.col("clave").isin("total", "totales"))
    return persons.groupBy("clave").agg(F.max_by("departamento", F.struct(*SHEET, "row")).alias("departamento"))


def month_blocks(rows: DataFrame, persons: DataFrame | None = None) -> MonthBlocks:
    """Rows (path, sheet, row, celdas) as ``workbooks.sheet_rows`` gives them; rows that a workbook leaves out are blank ones.

    ``persons`` (clave, departamento) tells persons' departments; a block has the one that most of its persons have, of equally many the one met
    first, and a person named like a department is that department. A name that repeats in a sheet becomes "name (2)". Amounts are rounded half to
    even; zeros are left out; texts in a month's column are notices, and so are months whose sum isn't the sheet's total.
    """
    months = F.filter(F.transform("celdas", lambda c, j: F.struct(j.alias("j"), F.when(j > 0, month_of_name(strip_accents(c))).alias("mes"))), lambda x: x["mes"].isNotNull())
    read = rows.withColumn("nombre", squeeze(F.coalesce(F.get("celdas", F.lit(0)), F.lit("")))).withColumn("clave", _plain(F.col("nombre"))).withColumn("meses", months)
    # rows are numbered by the workbook, so a row that it leaves out shows as a step; one order by sheet and row serves all of this
    order = Window.partitionBy(*SHEET).orderBy("row")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.min(F.when(F.size("meses") >= LEAST_MONTHS, F.struct("row", "meses"))).over(so_far)
    body = read.withColumn("h", head).drop("meses").where(F.col("row") > F.col("h.row")).withColumn("columnas", F.col("h.meses")).drop("h")
    body = body.withColumn("fin", F.min(F.when(F.col("clave").startswith("totales"), F.col("row"))).over(so_far))
    inside = body.where(F.col("fin").isNull())
    person = ~F.col("clave").isin("", "total")
    step = (F.coalesce(F.col("row") - F.lag("row").over(order) > 1, F.lit(False)) | ~person).cast("int")
    blocks = inside.withColumn("step", step).withColumn("g", F.sum("step").over(so_far)).where(person)
    begins = F.coalesce(F.col("g") != F.lag("g").over(order), F.lit(True)).cast("long")
    blocks = blocks.withColumn("begins", begins).withColumn("bloque", F.sum("begins").over(so_far)).drop("step", "g", "begins", "fin")
    k = F.row_number().over(Window.partitionBy(*SHEET, "nombre").orderBy("row"))
    named = blocks.withColumn("k", k).withColumn("persona", F.when(F.col("k") > 1, F.concat("nombre", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("nombre")))
    named = _with_departments(named, persons)
    cells = named.select(*SHEET, "row", "bloque", "persona", "departamento", F.explode("columnas").alias("c"), "celdas")
    cells = cells.select(*SHEET, "row", "bloque", "persona", "departamento", F.col("c.mes").alias("mes"), F.trim(F.get("celdas", F.col("c.j"))).alias("valor")).withColumn("n", _number(F.col("valor")))
    amounts = cells.where("n <> 0").select(*SHEET, "row", "bloque", "persona", "departamento", "mes", F.bround("n", 2).cast("decimal(14,2)").alias("importe"))
    repeated = named.where("k > 1").select(*SHEET, "row", F.concat(F.lit("repetido: "), "persona").alias("aviso"))
    ignored = cells.where("n IS NULL AND valor <> ''").select(*SHEET, "row", F.concat(F.lit("texto ignorado en el mes "), F.col("mes").cast("string"), F.lit(": "), F.left("valor", F.lit(60))).alias("aviso"))
    totals = body.where(F.col("row") == F.col("fin")).select(*SHEET, "row", F.explode("columnas").alias("c"), "celdas").select(*SHEET, "row", F.col("c.mes").alias("mes"), _number(F.trim(F.get("celdas", F.col("c.j")))).alias("total")).where("total <> 0")
    sums = amounts.groupBy(*SHEET, "mes").agg(F.sum("importe").alias("suma"))
    suma = F.coalesce("suma", F.lit(0)).cast("decimal(24,2)")
    differ = totals.join(sums, [*SHEET, "mes"], "left").where(F.abs(suma - F.col("total")) > F.lit(TOLERANCE).cast("decimal(4,2)"))
    differ = differ.select(*SHEET, "row", F.concat(F.lit("no cuadra el mes "), F.col("mes").cast("string"), F.lit(": "), suma.cast("string")).alias("aviso"))
    headless = rows.select(*SHEET).distinct().join(read.where(F.size("meses") >= LEAST_MONTHS).select(*SHEET).distinct(), SHEET, "left_anti")
    return MonthBlocks(amounts, repeated.unionByName(ignored).unionByName(differ), headless)


def _number(c: Column) -> Column:
    return c.try_cast("decimal(28,10)")


def _with_departments(named: DataFrame, persons: DataFrame | None) -> DataFrame:
    own = _department(F.col("clave"))
    if persons is None:
        return named.withColumn("departamento", F.coalesce(own, F.lit("")))
    known = persons.select("clave", F.col("departamento").alias("de"))
    # persons are looked up as they are printed, without the number of a repeated name
    votes = named.where("k = 1").join(known, "clave").groupBy(*SHEET, "bloque", "de").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    won = votes.groupBy(*SHEET, "bloque").agg(F.min_by("de", F.struct((-F.col("n")).alias("n"), "first")).alias("votado"))
    plain = F.when(F.col("k") == 1, own)
    return named.join(won, [*SHEET, "bloque"], "left").withColumn("departamento", F.coalesce(plain, "votado", F.lit(""))).drop("votado")
