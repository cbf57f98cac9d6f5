"""Readers of the hotel's exports (survey S01-S18, S23). Spreadsheets are to be saved as CSV first: no spreadsheet library is needed.

All readers are distributed: none collects a file. Rows of files whose order matters carry
``fila``, the line's number in its file, which needs whole files in one task and is meant for the
small hand-made sheets that have junk above their header.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions.dates import parse_date
from posada.functions.numbers import parse_int, parse_payroll, parse_spanish
from posada.functions.text import compact_key, lines_with_prefix, split_code, squeeze, strip_accents
from posada.operators.shapes import balance_breaks


def table(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """S01, S20."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """All columns as declared; a byte-order mark before the first field goes."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding, enforceSchema=True, mode="PERMISSIVE")
    first = df.columns[0]
    return df.withColumn(first, F.regexp_replace(first, "^﻿", "")) if dict(df.dtypes)[first] == "string" else df


def creditors(spark: SparkSession, path: str) -> DataFrame:
    """Fichero;acreedor;fecha;documento;cuenta;importe;asiento;linea, typed."""
    raw = csv(spark, path, "fichero string, acreedor string, fecha string, documento string, cuenta string, importe string, asiento string, linea string")
    return raw.select(
        "fichero", "acreedor", parse_date(F.col("fecha")).alias("fecha"), F.coalesce("documento", F.lit("")).alias("documento"), "cuenta",
        parse_spanish(F.col("importe")).cast("decimal(12,2)").alias("importe"), F.col("asiento").try_cast("int").alias("asiento"), F.col("linea").try_cast("int").alias("linea"),
    )


def extras(spark: SparkSession, path: str) -> DataFrame:
    """Anio;mes;persona;departamento;importe."""
    raw = csv(spark, path, "anio string, mes string, persona string, departamento string, importe string")
    return raw.select(F.col("anio").try_cast("int").alias("anio"), F.col("mes").try_cast("int").alias("mes"), F.trim("persona").alias("persona"), "departamento", parse_spanish(F.col("importe")).cast("decimal(12,2)").alias("importe"))


def marked_rows(spark: SparkSession, path: str, schema: str, marker: str, marks: tuple[str, ...] = ("A", "F"), encoding: str = "UTF-8") -> DataFrame:
    """Of a report with repeated page headers and subtotals, the rows whose marker column has one of the marks."""
    return csv(spark, path, schema, sep=",", header=False, encoding=encoding).where(F.trim(marker).isin(*marks))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small files with file name and number from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("fichero"), F.split("value", "\r?\n").alias("ls"))
    return whole.select("fichero", F.posexplode("ls").alias("k", "linea")).select("fichero", (F.col("k") + 1).cast("long").alias("fila"), F.regexp_replace("linea", "^﻿", "").alias("linea"))


def sniffed(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], must_have: str, sep: str = ";", within: int | None = None) -> DataFrame:
    """The header is each file's first line with a cell that is an alias of ``must_have``.

    Known columns are found by their aliases (unaccented letters and digits only; the first occurrence wins),
    all others are ignored; rows before the header go. All values are text.
    """
    lines = text_lines(spark, path).withColumn("celdas", F.split("linea", sep))
    keys = F.transform("celdas", lambda c: compact_key(c))
    wanted = F.array(*(F.lit(a) for a in aliases[must_have]))
    candidates = lines.where(F.arrays_overlap(keys, wanted))
    if within:
        candidates = candidates.where(F.col("fila") <= within)
    headers = candidates.groupBy("fichero").agg(F.min(F.struct("fila", "celdas")).alias("h")).select("fichero", F.col("h.fila").alias("cabecera"), F.transform("h.celdas", lambda c: compact_key(c)).alias("claves"))

    def cell(names: tuple[str, ...]) -> Column:
        at = F.array_min(F.filter(F.array(*(F.array_position("claves", F.lit(a)) for a in names)), lambda x: x > 0))
        return F.trim(F.try_element_at("celdas", at.cast("int")))

    rows = lines.join(headers, "fichero").where(F.col("fila") > F.col("cabecera"))
    return rows.select("fichero", "fila", *(cell(names).alias(c) for c, names in aliases.items()))


# Names that a payroll sheet may give its columns.
PAYROLL_ALIASES = {
    "nif": ("nif", "dni"), "nombre": ("nombre", "trabajador", "empleado"), "departamento": ("departamento", "depto"), "deveng": ("deveng", "devengado"),
    "ss_trabaj": ("sstrabaj",), "ss_empr": ("ssempr",), "s_neto": ("sneto", "neto"), "cost_tot": ("costtot", "costetotal", "coste"),
}


def payroll(spark: SparkSession, path: str) -> DataFrame:
    """A payroll sheet with titles above its header."""
    raw = sniffed(spark, path, PAYROLL_ALIASES, "nif").where(F.coalesce("nif", F.lit("")) != "")
    money = ("deveng", "ss_trabaj", "ss_empr", "s_neto", "cost_tot")
    return raw.select("fichero", "nif", "nombre", "departamento", *(parse_payroll(F.col(c)).cast("decimal(10,2)").alias(c) for c in money))


# Headers of the exports that are read by position, and what the concepts of a creditor's ledger begin with.
LEDGER_HEADER = ("Fecha", "Documento", "Concepto", "Contrapartida", "Debe", "Haber", "Saldo", "Asiento", "Linea")
BOOKING_HEADER = (
    "Reserva", "Fecha Reserva", "Agencia", "Age", "Tarifa", "NR", "Reserva Agencia", "Estado", "Nombre", "Grupo", "Entrada", "Salida", "Hab.", "Ad", "Ni", "Cu", "Depósito", "Oferta",
    "€ Estancias", "€ Extras", "€ Impuesto", "€ Total", "€ Estancias", "€ Extras", "€ Tasas", "€ Total", "Total Estancias", "Total Garantías", "Facturas",
)
CONCEPT_KINDS = {"S/FRA": "factura", "N/PAGO": "pago", "COBRO": "cobro", "APERTURA": "apertura"}
PARTY_KINDS = {"400": "proveedor", "410": "acreedor", "430": "cliente"}


def positional(spark: SparkSession, path: str, header: tuple[str, ...], sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """(fichero, fila, celdas) of the rows below each file's first line, and (fichero, error) of files whose first line isn't the header."""
    lines = text_lines(spark, path).withColumn("celdas", F.transform(F.split("linea", sep), lambda c: F.trim(c)))
    first = lines.where("fila = 1").select("fichero", (F.slice("celdas", 1, len(header)) == F.array(*(F.lit(h) for h in header))).alias("buena"))
    blank = F.forall(F.slice("celdas", 1, len(header)), lambda c: c == "")
    rows = lines.where("fila > 1").where(~blank).join(first.where("buena"), "fichero", "left_semi")
    return rows.select("fichero", "fila", "celdas"), first.where(~F.col("buena")).select("fichero", F.lit("cabecera inesperada").alias("error"))


def _cell(k: int) -> Column:
    return F.coalesce(F.get("celdas", F.lit(k)), F.lit(""))


def bookings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reservations of the hotel's export, and (fichero, error) where the header differs, a number repeats or the sum isn't that of the file's "Total" row."""
    rows, errors = positional(spark, path, BOOKING_HEADER)
    amount = lambda k: F.coalesce(parse_spanish(_cell(k)), F.lit(0)).cast("decimal(12,2)")
    is_total = F.lower(_cell(0)) == "total"
    agency = split_code(_cell(2))
    names = {
        "deposito": 16, "fact_estancias": 18, "fact_extras": 19, "fact_impuesto": 20, "fact_total": 21, "pend_estancias": 22, "pend_extras": 23, "pend_tasas": 24, "pend_total": 25, "total_estancias": 26,
    }
    counts = {"habitaciones": 12, "adultos": 13, "ninos": 14, "cunas": 15}
    made = rows.where(~is_total & (_cell(0) != "")).select(
        "fichero", parse_int(_cell(0)).alias("numero"), parse_date(_cell(1)).alias("fecha_reserva"), agency["code"].alias("agencia_codigo"), agency["name"].alias("agencia"), _cell(4).alias("tarifa"),
        (F.coalesce(parse_int(_cell(5)), F.lit(0)) != 0).alias("no_reembolsable"), _cell(6).alias("ref_agencia"), _cell(7).alias("estado"), _cell(9).alias("grupo"), parse_date(_cell(10)).alias("entrada"), parse_date(_cell(11)).alias("salida"),
        *(F.coalesce(parse_int(_cell(k)), F.lit(0)).cast("int").alias(n) for n, k in counts.items()), *(amount(k).alias(n) for n, k in names.items()), F.left(_cell(28), F.lit(255)).alias("facturas"),
    )
    printed = rows.where(is_total).groupBy("fichero").agg(F.max(amount(26)).alias("esperado"))
    sums = made.groupBy("fichero").agg(F.sum("total_estancias").alias("suma"), (F.count("*") != F.count_distinct("numero")).alias("repetidos"))
    bad = sums.join(printed, "fichero", "left")
    errors = errors.unionByName(bad.where("repetidos").select("fichero", F.lit("números repetidos").alias("error")))
    return made, errors.unionByName(bad.where(F.abs(F.col("esperado") - F.col("suma")) > Decimal("0.05")).select("fichero", F.lit("el total no cuadra").alias("error")))


def ledgers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Movements of all ledger extracts of a folder, with the kind that the concept begins with, and (fichero, fila, esperado, saldo) where the printed balance breaks."""
    rows, _ = positional(spark, path, LEDGER_HEADER)
    amount = lambda k: F.coalesce(parse_spanish(_cell(k)), F.lit(0)).cast("decimal(14,2)")
    typed = rows.select(
        "fichero", "fila", parse_date(_cell(0)).alias("fecha"), _cell(1).alias("documento"), _cell(2).alias("concepto"), _cell(3).alias("cuenta"), amount(4).alias("debe"), amount(5).alias("haber"), amount(6).alias("saldo"),
        parse_int(_cell(7)).cast("int").alias("asiento"), parse_int(_cell(8)).cast("int").alias("linea"),
    )
    # the first line is checked against zero, as a line before it would be
    start = typed.select("fichero").distinct().select("fichero", F.lit(0).cast("long").alias("fila"), *(F.lit(0).cast("decimal(14,2)").alias(c) for c in ("debe", "haber", "saldo")))
    breaks = balance_breaks(typed.select("fichero", "fila", "debe", "haber", "saldo").unionByName(start), "fichero", "fila")
    return typed.withColumn("tipo", lines_with_prefix(F.col("concepto"), CONCEPT_KINDS, "otro")), breaks


def creditor_movements(movements: DataFrame) -> DataFrame:
    """The invoices among a folder's movements, with the creditor's name and the slug of the file's name, in the form that ``creditors`` reads."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace("fichero", r"\.[^.]*$", ""), "^acr_", ""), "_[^_]*$", "")
    name = F.trim(F.substr("concepto", F.lit(len("S/FRA") + 1)))
    rows = movements.where("tipo = 'factura'")
    return rows.select(slug.alias("fichero"), F.when(name != "", name).otherwise(slug).alias("acreedor"), "fecha", "documento", "cuenta", (F.col("haber") - F.col("debe")).cast("decimal(12,2)").alias("importe"), "asiento", "linea")


def third_parties(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Third parties of a list without a header; rows whose first cell isn't an account go. Of rows with one account the one with most filled cells stays."""
    raw = spark.read.csv(path, sep=",", header=False, encoding=encoding, schema=", ".join(f"c{k} string" for k in range(9)))
    plain = lambda k, n: F.left(squeeze(F.col(f"c{k}")), F.lit(n))
    account = F.trim(F.regexp_replace("c0", "^\ufeff", ""))
    kinds = F.create_map(*(F.lit(x) for pair in PARTY_KINDS.items() for x in pair))
    rows = raw.where(account.rlike("^[0-9]+$")).select(
        account.alias("cuenta"), plain(1, 150).alias("nombre"), plain(2, 30).alias("nif"), F.coalesce(F.try_element_at(kinds, F.left(account, F.lit(3))), F.lit("otro")).alias("tipo"), plain(7, 60).alias("categoria"), plain(8, 150).alias("departamentos"),
    )
    filled = sum(((F.col(c) != "").cast("int") for c in ("nombre", "nif", "categoria", "departamentos")), F.lit(0))
    best = F.max(F.struct(filled.alias("k"), *(c for c in rows.columns if c != "cuenta"))).alias("b")
    return rows.groupBy("cuenta").agg(best).select("cuenta", *(f"b.{c}" for c in rows.columns if c != "cuenta"))


def wide_months(df: DataFrame, ids: list[str], months: list[str]) -> DataFrame:
    """Column k is month k; blanks are skipped."""
    named = df.select(*ids, *(F.col(c).cast("string").alias(str(k)) for k, c in enumerate(months, 1)))
    long = named.unpivot(ids, [str(k) for k in range(1, len(months) + 1)], "mes", "texto")
    return long.withColumn("mes", F.col("mes").cast("int")).withColumn("importe", parse_spanish(F.col("texto"))).where("importe IS NOT NULL").drop("texto")


def with_department_of_file(df: DataFrame, departments: dict[str, str]) -> DataFrame:
    """The department whose key is the longest one that the file's name holds."""
    name = strip_accents(F.col("_metadata.file_name"))
    out = None
    for key in sorted(departments, key=lambda k: (-len(k), k)):
        hit = name.contains(key)
        out = F.when(hit, F.lit(departments[key])) if out is None else out.when(hit, F.lit(departments[key]))
    return df.select("*", out.alias("departamento"))


def chart_of_accounts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document with an array ``cuentas`` of (codigo, nombre, definicion); the parent is the longest shorter code."""
    schema = "cuentas array<struct<codigo:string,nombre:string,definicion:string>>"
    flat = spark.read.json(path, schema=schema, multiLine=True).select(F.inline("cuentas"))
    up = flat.select("codigo", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("codigo") - 1, F.lit(1))), lambda i: F.left("codigo", i))).alias("arriba"))
    known = flat.select(F.col("codigo").alias("arriba"))
    parent = up.where("arriba <> codigo").join(known, "arriba").groupBy("codigo").agg(F.max_by("arriba", F.length("arriba")).alias("padre"))
    return flat.join(parent, "codigo", "left")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S18."""
    return spark.read.json(path, schema=schema)


def tree(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder with their digest and the first part of their path; contents are not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    below = F.regexp_replace("path", "^.*?" + path.rstrip("/").split("/")[-1] + "/", "")
    return files.select("path", F.sha2("content", 256).alias("checksum"), "length", F.substring_index(below, "/", 1).alias("departamento"), kind_of(F.col("content")).alias("tipo"))


def kind_of(content: Column) -> Column:
    """A file's kind by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")


def pdf_kind(pages: DataFrame, least: int = 50) -> DataFrame:
    """A document is digital if its pages have ``least`` characters on average."""
    return pages.groupBy("document_id").agg(F.avg(F.length(F.trim("text"))).alias("media")).select("document_id", F.when(F.col("media") >= least, "digital").otherwise("scanned").alias("source_type"))


def pair_by_stem(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two file listings whose names agree but for the extension."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return a.withColumn("stem", stem).join(b.withColumn("stem", stem).withColumnRenamed("path", "path_2"), "stem")
