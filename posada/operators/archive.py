"""The invoice archive and its two stores, review reasons, notices and document writes (survey Q25, Q26, Q28, Q34, J31, J32, V17, V18, K11, K14, D01, D04, F14, F62, P23, P26)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.functions import dates, numbers, taxid, text
from posada.operators import ledger, predicates

# Which fields are compared as amounts and as dates.
AMOUNT_FIELDS = ("net_subtotal", "tax_total", "gross_total", "discount_total", "charges_total", "withholding_total", "amount_due")
DATE_FIELDS = ("invoice_date", "due_date")
# Reasons for review, in order.
NO_NAME, NO_ID, NO_NUMBER, NO_DATE = "sin nombre de proveedor", "sin CIF de proveedor", "sin numero de factura", "sin fecha"
NO_LINES, NOT_RECONCILED = "ninguna linea reconocida", "los totales NO cuadran"


class MissingCriteria(ValueError):
    """A search without any criterion."""


def scoped(rows: DataFrame, companies: list[int]) -> DataFrame:
    """Rows of the companies that the caller may see; none without any."""
    return rows.where(F.col("empresa_id").isin(*companies)) if companies else rows.where(F.lit(False))


def comparable(name: Column, value: Column) -> Column:
    """what a field's value counts as when it is compared: amounts with two decimals, dates as ISO, ids and numbers in normal form, other text squeezed and upper case; blank is null."""
    raw = F.nullif(value, F.lit(""))
    amount = F.bround(raw.try_cast("decimal(24,6)"), 2).cast("decimal(20,2)").cast("string")
    return (
        F.when(name.isin(*AMOUNT_FIELDS), amount).when(name.isin(*DATE_FIELDS), dates.parse_date(raw).cast("string"))
        .when(name.isin("supplier_tax_id", "customer_tax_id"), F.nullif(taxid.normalise(raw), F.lit(""))).when(name == "invoice_number", F.nullif(text.invoice_key(raw), F.lit("")))
        .when(raw.isNotNull(), text.squeeze(F.upper(raw)))
    )


def parsed_json(rows: DataFrame, column: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """adds ``dato`` (the document by its schema) and ``valido``: it is JSON, and no required field is null."""
    made = rows.withColumn("dato", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    good = F.lit(True)
    for f in required:
        good = good & F.col(f"dato.{f}").isNotNull()
    return made.withColumn("valido", F.coalesce(F.col("dato").isNotNull() & good, F.lit(False)))


def review_reasons(results: DataFrame, informative: tuple[str, ...] = ()) -> Column:
    """Why a result needs a look, in order; notes that only inform don't count."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fixed = [(blank(F.col("nombre")), NO_NAME), (blank(F.col("cif")), NO_ID), (blank(F.col("numero")), NO_NUMBER), (F.col("fecha").isNull(), NO_DATE)]
    lines = F.when(F.col("n_lineas") == 0, NO_LINES).when(~F.col("cuadra"), NOT_RECONCILED)
    notes = F.filter(F.coalesce("notas", F.array().cast("array<string>")), lambda n: ~n.isin(*informative)) if informative else F.coalesce("notas", F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(*(F.when(bad, why) for bad, why in fixed), lines)), notes)


def with_names(groups: DataFrame, accounts: DataFrame) -> DataFrame:
    """The name of each grouped code, blank where the plan lacks it."""
    return groups.join(accounts.select("codigo", F.col("nombre")), "codigo", "left").withColumn("nombre", F.coalesce("nombre", F.lit("")))


def link_supplier(drafts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The supplier (its least id) whose tax id has the draft's normal form; null without one."""
    known = suppliers.where(taxid.normalise(F.col("cif")) != "").groupBy(taxid.normalise(F.col("cif")).alias("nif")).agg(F.min("proveedor_id").alias("proveedor_id"))
    return drafts.withColumn("nif", taxid.normalise(F.col("supplier_tax_id"))).join(known, "nif", "left").drop("nif")


def search(stores: Mapping[str, DataFrame], companies: list[int] | None = None, supplier: str = "", number: str = "", first: str | None = None, last: str | None = None, total=None) -> DataFrame:
    """Q25: invoices of all given stores that fulfil every criterion, newest first by store.

    A store has referencia, proveedor, nif, numero, fecha, total, and empresa_id where it is divided by company. At least one criterion must be given.
    """
    if not any([supplier, number, first, last, total is not None]):
        raise MissingCriteria("one of supplier, number, dates or total")
    out = None
    for name, rows in stores.items():
        found = scoped(rows, companies or []) if "empresa_id" in rows.columns else rows
        if supplier:
            found = found.where(predicates.holds_text(supplier, F.col("proveedor")) | predicates.same_text(F.col("nif"), supplier))
        if number:
            found = found.where(predicates.holds_text(number, F.col("numero")))
        found = found.where(predicates.within(F.col("fecha"), first, last))
        if total is not None:
            found = found.where(F.col("total") == F.lit(total))
        found = found.select(F.lit(name).alias("origen"), "referencia", "proveedor", "nif", "numero", "fecha", "total")
        out = found if out is None else out.unionByName(found)
    return out


def training_readiness(documents: DataFrame) -> DataFrame:
    """Q26: one row of counts from (estado, listo): ``listo`` marks documents that may teach, approved ones or such with warnings about context only."""
    of = lambda *names: F.count_if(F.col("estado").isin(*names))
    ready, context = F.count_if(F.col("listo")), F.count_if(F.col("listo") & (F.col("estado") == "needs_review"))
    return documents.agg(
        ready.alias("listas"), of("approved").alias("aprobadas"), (ready - of("approved")).alias("etiquetadas"), context.alias("solo_contexto"), (of("needs_review") - context).alias("necesitan_revision"),
        of("queued", "processing").alias("en_cola"), of("failed").alias("con_error"), of("rejected").alias("rechazadas"),
    )


def archive_counters(documents: DataFrame) -> DataFrame:
    """Q28: the archive's counters from (estado, confirmado), null where nothing was extracted."""
    return documents.agg(
        F.count("*").alias("total"), F.count_if(F.col("estado").isNull()).alias("sin_extraer"), F.count_if(F.col("estado") == "ok").alias("correctas"),
        F.count_if(F.col("estado") == "revisar").alias("a_revisar"), F.count_if(F.coalesce("confirmado", F.lit(False))).alias("confirmadas"),
    )


def archive_list(documents: DataFrame, term: str = "", state: str = "", department: str = "", confirmed: str = "") -> DataFrame:
    """Documents by the archive's filters; blank ones do nothing."""
    out = documents
    if term:
        out = out.where(predicates.holds_text(term, F.col("archivo"), F.col("numero"), F.col("proveedor")))
    if state == "pendiente":
        out = out.where(F.col("estado").isNull())
    elif state:
        out = out.where(F.col("estado") == state)
    if department:
        out = out.where(F.col("departamento") == department)
    if confirmed:
        out = out.where(F.coalesce("confirmado", F.lit(False)) if confirmed == "si" else predicates.not_confirmed(F.col("confirmado")))
    return out


def replace_children(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """The children of documents that were extracted again are those of the new extraction, none if it has none."""
    return old.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def invoice_export(invoices: DataFrame, lines: DataFrame, only_confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The invoices' rows in order of date and id, and their lines in that order and their own."""
    rows = invoices.where(F.coalesce("confirmado", F.lit(False))) if only_confirmed else invoices
    head = rows.orderBy(F.asc_nulls_last("fecha"), "document_id")
    body = lines.join(rows.select("document_id", "fecha"), "document_id").orderBy(F.asc_nulls_last("fecha"), "document_id", "orden")
    return head, body


def mark(lines: DataFrame, chosen: DataFrame, state: str, when: str, note: str | None = None) -> DataFrame:
    """Sets the mark of chosen lines (asiento_id, orden). Reconciled lines keep theirs, and so keep the whole set from being marked (see ``blocked_marks``)."""
    picked = chosen.select("asiento_id", "orden").distinct().withColumn("__elegido", F.lit(True))
    hit = F.col("__elegido").isNotNull() & (F.col("punteo") != "conciliado")
    made = lines.join(picked, ["asiento_id", "orden"], "left")
    new = {"punteo": F.when(hit, F.lit(state)).otherwise(F.col("punteo")), "punteado_en": F.when(hit, F.lit(when if state else None).cast("timestamp")).otherwise(F.col("punteado_en"))}
    if note is not None:
        new["punteo_nota"] = F.when(hit, F.left(F.lit(note), F.lit(255))).otherwise(F.col("punteo_nota"))
    return made.withColumns(new).select(*lines.columns)


def blocked_marks(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen lines that are reconciled with the bank; with any, nothing may be marked."""
    return lines.join(chosen.select("asiento_id", "orden").distinct(), ["asiento_id", "orden"], "left_semi").where(F.col("punteo") == "conciliado").select("asiento_id", "orden")


def create_entries(heads: DataFrame, lines: DataFrame, accounts: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and lines that may be written, lines numbered with debits first, and (id, errores) of the entries that may not; an entry goes in whole or not at all."""
    errors = ledger.posting_errors(heads, lines, accounts, years)
    good = errors.where(F.size("errores") == 0).select("id")
    # an entry goes in whole, so its lines can be numbered before, and the join takes them in the window's order; a semi-join would be made once for each part of a union
    numbered = ledger.renumber_lines(lines, "cuenta", "debe", "haber")
    kept = numbered.join(good.select(F.col("id").alias("asiento_id")).distinct(), "asiento_id").select(*numbered.columns)
    return heads.join(good, "id", "left_semi"), kept, errors.where(F.size("errores") > 0)


def notices(parts: Mapping[str, DataFrame], texts: Mapping[str, str]) -> DataFrame:
    """(aviso, n, detalle) of the profit model's data, one row for each part that has rows.

    A part is (n, detalle) in one row or none; ``texts`` name the notices.
    """
    out = None
    for name, rows in parts.items():
        one = rows.where("n > 0").select(F.lit(name).alias("clave"), F.lit(texts[name]).alias("aviso"), F.col("n").cast("long").alias("n"), F.col("detalle").cast("string").alias("detalle"))
        out = one if out is None else out.unionByName(one)
    return out


def months_notice(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Months that have one thing and lack another."""
    missing = expected.select("mes").distinct().join(present.select("mes").distinct(), "mes", "left_anti")
    return missing.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("mes")), lambda m: m.cast("string")), ", ").alias("detalle"))


def count_notice(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.lit("").alias("detalle"))


def leased(jobs: DataFrame, now: str, lease_seconds: int, running: int) -> DataFrame:
    """Jobs to be claimed: queued ones, and processing ones whose lease has run out, oldest first, as many as there is room for beside live leases."""
    live = (F.col("estado") == "processing") & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("reclamado_en") < lease_seconds)
    free = jobs.agg((F.lit(running) - F.count_if(live)).alias("libres"))
    ready = jobs.where((F.col("estado") == "queued") | ((F.col("estado") == "processing") & ~live)).orderBy("creado", "documento_id").limit(running)
    numbered = ready.select("documento_id", "creado").agg(F.array_sort(F.collect_list(F.struct("creado", "documento_id"))).alias("cola"))  # ``running`` rows
    return numbered.crossJoin(free).select(F.explode(F.slice("cola", F.lit(1), F.greatest(F.col("libres"), F.lit(0)))).alias("j")).select("j.documento_id")  # one row by one row


def column_table(words: DataFrame, not_a_charge: tuple[str, ...], margin: float = 20.0, tolerance: float = 15.0) -> DataFrame:
    """UD04: (page, k, descripcion, importe) of pages whose descriptions and amounts stand in two columns that aren't aligned by row.

    Words are (page, left, top, height, text). Amounts in the largest run of left edges make the column; words left of it make description rows; rows
    with a word of totals give neither. The k-th description goes with the k-th amount, and only where both are as many.
    """
    from posada.operators import shapes

    rows = shapes.rows_by_height(words)
    tokens = F.split(F.upper("text"), r"[\s,:.]+")
    charge = ~F.max(F.coalesce(F.exists(tokens, lambda t: t.isin(*not_a_charge)), F.lit(False))).over(Window.partitionBy("page", "fila"))
    # dealt by page once, whole: what follows needs no further shuffle of words, and shares this one
    rows = rows.repartition("page").withColumn("cargo", charge).where("cargo").drop("cargo")
    is_amount = F.col("text").rlike(r"^(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d+,\d{2}|\d+\.\d{2})$")
    column = shapes.cluster_1d(rows.where(is_amount).select("page", "left"), "page", "left", tolerance).select("page", "desde")
    placed = rows.join(column, "page")
    amounts = placed.where(is_amount & (F.col("left") >= F.col("desde") - 5)).select("page", "top", numbers.parse_amount(F.col("text")).cast("decimal(14,2)").alias("importe"))
    left = placed.where(F.col("left") < F.col("desde") - margin)
    lines = left.groupBy("page", "fila").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ").alias("descripcion"))
    lines = lines.where(F.col("descripcion").rlike("[A-Za-z]{3}"))
    return shapes.join_by_rank(lines, amounts, "page", "fila", "top").select("page", F.col("k").cast("long").alias("k"), "descripcion", "importe")
