"""Profit model (survey Q15-Q20, Q34): revenue by night, purchases by department, creditors net of VAT, personnel.

Money is decimal. Amounts shared among nights or months keep six decimals until they are
summed. Monthly results are long: (mes, serie, valor), so that series can be united, summed
and pivoted at the edge. "hoy" is a parameter; nothing reads the clock.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.dates import invoice_months, month_overlap_days, month_starts, nights
from posada.functions.numbers import base_of_quota, money, net_of_vat, percent, zero_if_null
from posada.functions.text import CHANNELS, UNASSIGNED, channel, company_tokens, department, strip_accents
from posada.operators.predicates import in_year, overlaps

# VAT in percent.
VAT_LODGING, VAT_DINING, VAT_PARKING = 10, 10, 21
OTHERS = "Otros"
SIX = "decimal(28,6)"


def six(c: Column) -> Column:
    return F.round(c.cast("decimal(38,12)"), 6).cast(SIX)


# ------------------------------------------------------------------ reservations


def prorated_by_month(reservations: DataFrame, year: int, today: str, with_vat: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Q16: each reservation's figures by month of ``year``, split into realised and forecast nights.

    Closed form: nights of a month up to ``today`` and after it are counted from dates, no night is
    exploded. Columns: numero, agencia, habitaciones, mes, realizado, noches, estancias, extras, tasas.
    """
    first, last = f"{year}-01-01", f"{year}-12-31"
    n = nights(F.col("entrada"), F.col("salida"))
    base = reservations.where(overlaps(F.col("entrada"), F.col("salida"), first, last)).withColumn("n", n)
    base = base.withColumn("ultima", F.date_add("entrada", F.col("n") - 1)).where(overlaps(F.col("entrada"), F.col("ultima"), first, last))
    months = month_starts(F.greatest("entrada", F.lit(first).cast("date")), F.least("ultima", F.lit(last).cast("date")))
    by_month = base.withColumn("m", F.explode(months))
    now = F.lit(today).cast("date")
    parts = F.array(
        F.struct(F.lit(True).alias("realizado"), month_overlap_days(F.col("entrada"), F.least("ultima", now), F.col("m")).alias("noches")),
        F.struct(F.lit(False).alias("realizado"), month_overlap_days(F.greatest("entrada", F.date_add(now, 1)), F.col("ultima"), F.col("m")).alias("noches")),
    )
    split = by_month.withColumn("p", F.explode(parts)).select("*", "p.*").where("noches > 0")
    gross = lambda c: c if with_vat else net_of_vat(c, VAT_LODGING)
    share = lambda c: six(c.cast("decimal(28,12)") * F.col("noches") / F.col("n"))
    return split.select(
        "numero", "agencia", "habitaciones", F.month("m").cast("long").alias("mes"), "realizado", F.col("noches").cast("long").alias("noches"),
        share(gross(F.col("total_estancias"))).alias("estancias"), share(gross(F.col("fact_extras") + F.col("pend_extras"))).alias("extras"),
        share(F.col("fact_impuesto") + F.col("pend_tasas")).alias("tasas"), *extra,
    )


def revenue_by_month(prorated: DataFrame) -> DataFrame:
    """Realised stays, extras and taxes, room nights, and the forecast, by month."""
    real, all3 = F.col("realizado"), F.col("estancias") + F.col("extras") + F.col("tasas")
    add = lambda cond, c: money(zero_if_null(F.sum(F.when(cond, c))))
    return prorated.groupBy("mes").agg(
        add(real, F.col("estancias")).alias("estancias"), add(real, F.col("extras")).alias("extras"), add(real, F.col("tasas")).alias("tasas"),
        add(~real, all3).alias("previsto"), F.coalesce(F.sum(F.when(real, F.col("noches") * F.col("habitaciones"))), F.lit(0)).cast("long").alias("noches_hab"),
    )


def by_agency(prorated: DataFrame, with_forecast: bool = False, month: int | None = None) -> DataFrame:
    """Reservations, room nights, income and average daily rate of each agency."""
    rows = prorated if with_forecast else prorated.where("realizado")
    rows = rows if month is None else rows.where(F.col("mes") == month)
    name = F.when(F.coalesce("agencia", F.lit("")) == "", "Sin agencia").otherwise(F.col("agencia"))
    out = rows.groupBy(name.alias("nombre")).agg(
        F.count_distinct("numero").alias("reservas"), F.sum(F.col("noches") * F.col("habitaciones")).cast("long").alias("noches_hab"),
        money(F.sum("estancias")).alias("estancias"), money(F.sum(F.col("estancias") + F.col("extras") + F.col("tasas"))).alias("ingresos"),
    )
    every = F.sum("ingresos").over(Window.partitionBy())
    out = out.withColumn("adr", F.try_divide(F.col("estancias").cast("double"), F.col("noches_hab"))).withColumn("principal", channel(F.col("nombre")))
    return out.withColumn("pct", percent(F.col("ingresos"), every))  # a window over agencies, not over reservations


def channel_weights(prorated: DataFrame, with_forecast: bool = False) -> DataFrame:
    """Each main channel's share of a month's income and room nights among main channels; null without any."""
    rows = (prorated if with_forecast else prorated.where("realizado")).withColumn("canal", channel(F.col("agencia"))).where("canal IS NOT NULL")
    sums = rows.groupBy("mes", "canal").agg(
        money(F.sum(F.col("estancias") + F.col("extras") + F.col("tasas"))).alias("ingresos"), F.sum(F.col("noches") * F.col("habitaciones")).cast("long").alias("noches")
    )
    month = Window.partitionBy("mes")
    return sums.select("mes", "canal", "ingresos", "noches", *(percent(F.col(c), F.sum(c).over(month)).alias(f"peso_{c}") for c in ("ingresos", "noches")))


# ------------------------------------------------------------------ bar, dining, parking


def cash_revenue(days: DataFrame, year: int, with_vat: bool = False) -> DataFrame:
    """Q18: (mes, serie, valor) from the daily cash sheets; tourist tax and invoices don't count."""
    net = lambda c, vat: c if with_vat else net_of_vat(c, vat)
    series = {
        "Bar": net(F.col("bar") + F.col("chill_out"), VAT_DINING), "Comedor": net(F.col("comedor"), VAT_DINING), "Menús": net(F.col("menus"), VAT_DINING),
        "Parking": net(F.col("parking_efectivo") + F.col("parking_visa"), VAT_PARKING),
    }
    rows = days.where(F.col("anio") == year).select(F.col("mes").cast("long").alias("mes"), F.explode(F.array(*(F.struct(F.lit(k).alias("serie"), six(v).alias("v")) for k, v in series.items()))).alias("s"))
    return rows.groupBy("mes", F.col("s.serie").alias("serie")).agg(money(F.sum("s.v")).alias("valor"))


def vat_revenue(vat: DataFrame, year: int, with_vat: bool = False) -> DataFrame:
    """Q18's fallback: bar and dining from the quotas of issued invoices, quarterly invoices spread over their months."""
    text = strip_accents(F.col("concepto"))
    serie = F.when(text.contains(" bar"), "Bar").when(text.contains("comedor"), "Comedor")
    rows = vat.where((F.col("libro") == "repercutido") & in_year(F.col("fecha"), year) & F.upper("concepto").startswith("N/FRA ")).withColumn("serie", serie).where("serie IS NOT NULL")
    base = base_of_quota(F.col("cuota"), VAT_DINING)
    amount = base + F.col("cuota") if with_vat else base
    months = rows.select("serie", amount.alias("v"), invoice_months(F.col("fecha")).alias("ms")).select("serie", six(F.col("v") / F.size("ms")).alias("v"), F.explode("ms").alias("mes"))
    return months.groupBy(F.col("mes").cast("long").alias("mes"), "serie").agg(money(F.sum("v")).alias("valor"))


def dining_revenue(days: DataFrame, vat: DataFrame, year: int, with_vat: bool = False) -> DataFrame:
    """One cash sheet in the year is enough for all months to come from cash sheets."""
    cash = cash_revenue(days, year, with_vat)
    any_cash = days.where(F.col("anio") == year).limit(1).select(F.lit(1).alias("hay"))
    return cash.unionByName(vat_revenue(vat, year, with_vat).join(any_cash, F.lit(True), "left_anti"))


# ------------------------------------------------------------------ purchases


def habitual_department(listing: DataFrame) -> DataFrame:
    """A supplier's department with the largest sum of absolute totals, ties by name."""
    sums = listing.groupBy("codigo_proveedor", "departamento").agg(F.sum(F.abs("total")).alias("peso"))
    rank = F.row_number().over(Window.partitionBy("codigo_proveedor").orderBy(F.desc("peso"), "departamento"))
    return sums.withColumn("r", rank).where("r = 1").select("codigo_proveedor", F.col("departamento").alias("habitual"))


def purchases_with_department(purchases: DataFrame, listing: DataFrame, manual: DataFrame, amount: Column) -> DataFrame:
    """The delivery note's own department, else the supplier's habitual, else the manual one, else unassigned.

    ``origen_depto`` says which it was. The listings of all years count for the habitual department.
    """
    keys = ["tipo", "numero", "codigo_proveedor"]
    exact = listing.groupBy(*keys).agg(F.max_by("departamento", F.struct("fecha", "departamento")).alias("exacto"))
    own = manual.where("origen = 'proveedor'").select(F.col("clave").alias("codigo_texto"), department(F.col("departamento")).alias("manual"))
    out = purchases.withColumn("importe", amount).withColumn("codigo_texto", F.col("codigo_proveedor").cast("string"))
    out = out.join(exact, keys, "left").join(habitual_department(listing), "codigo_proveedor", "left").join(own, "codigo_texto", "left")
    has_manual = F.coalesce("manual", F.lit(UNASSIGNED)) != UNASSIGNED
    name = F.when(F.col("exacto").isNotNull(), department(F.col("exacto"))).when(F.col("habitual").isNotNull(), department(F.col("habitual"))).when(has_manual, F.col("manual")).otherwise(UNASSIGNED)
    origin = F.when(F.col("exacto").isNotNull(), "albaran").when(F.col("habitual").isNotNull(), "habitual").when(has_manual, "manual").otherwise("sin")
    return out.withColumn("departamento", name).withColumn("origen_depto", origin).drop("exacto", "habitual", "manual", "codigo_texto")


def coverage(purchases: DataFrame) -> DataFrame:
    """Lines and amount by how the department was found."""
    return purchases.groupBy("origen_depto").agg(F.count("*").alias("lineas"), money(zero_if_null(F.sum("importe"))).alias("importe"))


def listings_without_purchase(listing: DataFrame, purchases: DataFrame, year: int) -> DataFrame:
    """J05."""
    return listing.where(in_year(F.col("fecha"), year)).join(purchases, ["tipo", "numero", "codigo_proveedor"], "left_anti")


# ------------------------------------------------------------------ creditors


def _document_key() -> list[Column]:
    return [F.col("asiento"), F.trim(F.coalesce("documento", F.lit(""))).alias("doc")]


def creditor_invoices(invoices: DataFrame, vat: DataFrame, year: int, with_vat: bool = False) -> DataFrame:
    """Invoices with the VAT of the same entry and document taken off.

    Null entries match each other. VAT that is also in the issued book (reverse charge) isn't taken off,
    but counts as matched.
    """
    own = vat.where(in_year(F.col("fecha"), year))
    received = own.where("libro = 'soportado'").groupBy(*_document_key()).agg(
        F.sum("cuota").alias("cuota"), F.max(F.when(F.col("cuenta").startswith("410"), F.col("cuenta"))).alias("cuenta_410")
    )
    reverse = own.where((F.col("libro") == "repercutido") & F.upper("concepto").startswith("S/FRA")).select(*_document_key()).distinct().withColumn("isp", F.lit(True))
    left = invoices.where(in_year(F.col("fecha"), year)).withColumn("doc", F.trim(F.coalesce("documento", F.lit("")))).alias("f")
    match = lambda side: F.col("f.asiento").eqNullSafe(F.col(f"{side}.asiento")) & (F.col("f.doc") == F.col(f"{side}.doc"))
    joined = left.join(received.alias("v"), match("v"), "left").join(reverse.alias("r"), match("r"), "left")
    iva = F.when(F.col("r.isp").isNull(), zero_if_null(F.col("v.cuota"))).otherwise(F.lit(Decimal("0.00")))
    return joined.select(
        "f.fecha", "f.fichero", "f.acreedor", F.left("f.cuenta", F.lit(3)).alias("cuenta"), F.col("f.cuenta").startswith("2").alias("inversion"),
        money(iva).alias("iva"), F.struct("f.fichero", "f.documento", "f.asiento").alias("documento"), F.col("v.cuenta_410").alias("cuenta_410"),
        six(F.col("f.importe") if with_vat else F.col("f.importe") - iva).alias("importe"), F.col("v.cuota").isNotNull().alias("casada"),
    )


def orphan_vat(vat: DataFrame, invoices: DataFrame, year: int, least: int = 1000, top: int = 5) -> DataFrame:
    """creditors' VAT without an invoice, by name, large sums only, the largest first."""
    own = vat.where(in_year(F.col("fecha"), year) & (F.col("libro") == "soportado") & F.col("cuenta").startswith("410")).withColumn("doc", F.trim(F.coalesce("documento", F.lit("")))).alias("v")
    known = invoices.where(in_year(F.col("fecha"), year)).select(*_document_key()).distinct().alias("f")
    alone = own.join(known, F.col("v.asiento").eqNullSafe(F.col("f.asiento")) & (F.col("v.doc") == F.col("f.doc")), "left_anti")
    name = F.trim(F.regexp_replace("concepto", "^S/FRA ", ""))
    sums = alone.groupBy(name.alias("nombre")).agg(money(F.sum("cuota")).alias("cuota")).where(F.abs("cuota") >= least)
    return sums.orderBy(F.desc(F.abs("cuota")), "nombre").limit(top)


def additional_expenses(expenses: DataFrame, year: int, today: str, with_forecast: bool = False, with_vat: bool = False) -> DataFrame:
    """Date-range expenses by month in proportion to days; months after today's are forecast."""
    rows = expenses.where(overlaps(F.col("desde"), F.col("hasta"), f"{year}-01-01", f"{year}-12-31"))
    rows = rows.withColumn("m", F.explode(month_starts(F.col("desde"), F.col("hasta")))).where(F.year("m") == year)
    if not with_forecast:
        rows = rows.where(F.col("m") <= F.trunc(F.lit(today).cast("date"), "month"))
    amount = F.col("base") + F.col("iva") if with_vat else F.col("base")
    days, every = month_overlap_days(F.col("desde"), F.col("hasta"), F.col("m")), F.date_diff("hasta", "desde") + 1
    share = lambda c: six(c.cast("decimal(28,12)") * days / every)
    return rows.select(
        F.col("m").alias("fecha"), F.concat(F.lit("gasto-"), F.col("id").cast("string")).alias("fichero"),
        F.when(F.coalesce("acreedor", F.lit("")) != "", F.col("acreedor")).otherwise(F.col("concepto")).alias("acreedor"),
        F.left("cuenta", F.lit(3)).alias("cuenta"), F.col("cuenta").startswith("2").alias("inversion"), share(amount).alias("importe"),
    )


def match_third_party(names: DataFrame, parties: DataFrame) -> DataFrame:
    """The creditor of each (cuenta, nombre): the exact account, else equal words, else words that hold one another.

    Candidates share a word, so that names are joined through their words and not each with each; ties go
    to the lowest account.
    """
    mine = names.select("cuenta", "nombre").distinct().withColumn("w", company_tokens(F.col("nombre")))
    exact = mine.join(parties.select(F.col("cuenta"), F.col("cuenta").alias("ficha")), "cuenta").select("cuenta", "nombre", "ficha", F.lit(0).alias("tier"))
    creditors = parties.where("tipo = 'acreedor'").select(F.col("cuenta").alias("ficha"), company_tokens(F.col("nombre")).alias("t"))
    pairs = mine.select("cuenta", "nombre", "w", F.explode("w").alias("word")).join(creditors.select("ficha", "t", F.explode("t").alias("word")), "word").drop("word").distinct()
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    tier = F.when(F.col("w") == F.col("t"), 1).when(inside("w", "t") | inside("t", "w"), 2)
    fuzzy = pairs.withColumn("tier", tier).where("tier IS NOT NULL").select("cuenta", "nombre", "ficha", "tier")
    best = F.row_number().over(Window.partitionBy("cuenta", "nombre").orderBy("tier", "ficha"))
    return exact.unionByName(fuzzy).withColumn("r", best).where("r = 1").select("cuenta", "nombre", "ficha", "tier")


# ------------------------------------------------------------------ personnel and assembly


def personnel(payroll: DataFrame, extras: DataFrame, year: int) -> DataFrame:
    """(mes, coste_nomina, extras_personal): a month's extras sheet replaces the extras noted in the payroll."""
    cost = payroll.where(F.col("anio") == year).groupBy(F.col("mes").cast("long").alias("mes")).agg(money(F.sum("cost_tot")).alias("c"), money(F.sum("importe_extra")).alias("e"))
    sheet = extras.where(F.col("anio") == year).groupBy(F.col("mes").cast("long").alias("mes")).agg(money(F.sum("importe")).alias("s"))
    both = cost.join(sheet, "mes", "full_outer")
    return both.select("mes", money(zero_if_null(F.col("c"))).alias("coste_nomina"), money(zero_if_null(F.coalesce("s", "e"))).alias("extras_personal"))


def long_series(df: DataFrame, *columns: str) -> DataFrame:
    """Month columns as (mes, serie, valor)."""
    return df.select("mes", F.explode(F.array(*(F.struct(F.lit(c).alias("serie"), F.col(c).cast("decimal(24,2)").alias("valor")) for c in columns))).alias("s")).select("mes", "s.serie", "s.valor")


INCOME = ("estancias", "extras", "tasas", "Bar", "Comedor", "Menús", "Parking")
COSTS = ("proveedores", "acreedores", "coste_nomina", "extras_personal")


def monthly_summary(series: DataFrame, with_forecast: bool = False) -> DataFrame:
    """Twelve rows with every series, income, costs, profit and its running sum; months without rows are zero."""
    months = series.sparkSession.range(1, 13).select(F.col("id").alias("mes"))
    wanted = [*INCOME, "previsto", *COSTS, "inversiones", "noches_hab", "iva_repercutido", "iva_soportado"]
    wide = months.join(series.groupBy("mes").pivot("serie", wanted).agg(F.sum("valor")), "mes", "left")
    wide = wide.select("mes", *(money(zero_if_null(F.col(f"`{c}`"))).alias(c) for c in wanted))
    add = lambda names: money(sum((F.col(f"`{c}`") for c in names), F.lit(Decimal("0.00"))))
    wide = wide.withColumn("ingresos", add([*INCOME, *(["previsto"] if with_forecast else [])])).withColumn("gastos", add(COSTS))
    wide = wide.withColumn("beneficio", money(F.col("ingresos") - F.col("gastos"))).withColumn("iva_liquidar", money(F.col("iva_repercutido") - F.col("iva_soportado")))
    running = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # twelve rows
    return wide.withColumn("acumulado", money(F.sum("beneficio").over(running)))


def year_totals(summary: DataFrame, month: int | None = None) -> DataFrame:
    """Sums over the period, margin and average daily rate."""
    rows = summary if month is None else summary.where(F.col("mes") == month)
    sums = rows.agg(*(money(F.sum(c)).alias(c) for c in ("ingresos", "gastos", "beneficio", "estancias", "noches_hab", "inversiones")))
    return sums.withColumn("margen", percent(F.col("beneficio"), F.col("ingresos"))).withColumn("adr", F.try_divide(F.col("estancias").cast("double"), F.col("noches_hab").cast("double")))


def by_department(dining: DataFrame, purchases: DataFrame, payroll: DataFrame, extras: DataFrame, assigned: DataFrame, year: int) -> DataFrame:
    """Income, suppliers and payroll of each department; unassigned last, then by falling total."""
    part = lambda df, kind, name, value: df.select(F.lit(kind).alias("tipo"), name.alias("nombre"), value.cast("decimal(24,2)").alias("v"))
    own = assigned.where("origen = 'personal'").select(F.col("clave").alias("persona"), department(F.col("departamento")).alias("depto"))
    sheets = extras.where(F.col("anio") == year)
    months = sheets.select("mes").distinct().withColumn("hoja", F.lit(True))
    pay = payroll.where(F.col("anio") == year).join(months, "mes", "left")
    rows = (
        part(dining, "ingresos", F.when(F.col("serie") == "Menús", "Comedor").otherwise(F.col("serie")), F.col("valor")).where("nombre <> 'Parking' AND v <> 0")
        .unionByName(part(purchases.where(in_year(F.col("fecha"), year)), "proveedores", F.col("departamento"), zero_if_null(F.col("importe"))))
        .unionByName(part(pay, "nominas", department(F.col("departamento")), F.col("cost_tot") + F.when(F.col("hoja").isNull(), F.col("importe_extra")).otherwise(0)))
        .unionByName(part(sheets.join(own, "persona", "left"), "nominas", F.coalesce("depto", F.lit(UNASSIGNED)), F.col("importe")))
    )
    kinds = ["ingresos", "proveedores", "nominas"]
    wide = rows.groupBy("nombre").pivot("tipo", kinds).agg(F.sum("v")).select("nombre", *(money(zero_if_null(F.col(k))).alias(k) for k in kinds))
    wide = wide.withColumn("total", money(F.col("proveedores") + F.col("nominas")))
    wide = wide.withColumn("resultado", F.when(F.col("ingresos") != 0, money(F.col("ingresos") - F.col("total"))))
    return wide.orderBy(F.col("nombre") == UNASSIGNED, F.desc("total"), "nombre")


def by_category(purchases: DataFrame, creditors: DataFrame, parties: DataFrame) -> DataFrame:
    """Suppliers and creditors by their category; unknown ones last. ``creditors`` has ficha and importe."""
    kind = parties.select(F.col("cuenta").alias("ficha"), F.nullif("categoria", F.lit("")).alias("categoria"))
    a = purchases.select(F.concat(F.lit("400"), F.lpad(F.col("codigo_proveedor").cast("string"), 6, "0")).alias("ficha"), F.col("importe").alias("p"), F.lit(0).alias("c"))
    b = creditors.select("ficha", F.lit(0).alias("p"), F.col("importe").alias("c"))
    rows = a.unionByName(b).join(kind, "ficha", "left").groupBy(F.coalesce("categoria", F.lit(OTHERS)).alias("nombre"))
    out = rows.agg(money(F.sum("p")).alias("proveedores"), money(F.sum("c")).alias("acreedores")).withColumn("total", money(F.col("proveedores") + F.col("acreedores")))
    return out.orderBy(F.col("nombre") == OTHERS, F.desc("total"), "nombre")


def by_account(creditors: DataFrame, investment: bool) -> DataFrame:
    """A29."""
    sums = creditors.where(F.col("inversion") == investment).groupBy("cuenta").agg(money(F.sum("importe")).alias("importe"))
    return sums.withColumn("pct", percent(F.col("importe"), F.sum("importe").over(Window.partitionBy())))


def top_with_rest(ranked: DataFrame, n: int, name: str, amount: str, count: str | None = None) -> DataFrame:
    """The n largest rows and one row of the rest; all rows if there are n + 1 at most."""
    kept = [name, amount] + ([count] if count else [])
    sums = [money(F.sum(amount)).alias(amount)] + ([F.sum(count).cast("long").alias(count)] if count else [])
    first = ranked.select(*kept).orderBy(F.desc(amount), name).limit(n)
    names = first.agg(F.collect_list(F.struct(F.col(name).alias("name"))).alias("names"))  # one row of n names, a missing one among them
    rest = ranked.select(*kept).join(F.broadcast(names), F.exists("names", lambda x: x["name"].eqNullSafe(F.col(name))), "left_anti")
    rest = rest.agg(F.count("*").alias("k"), F.max(name).alias("solo"), *sums).where("k > 0")
    label = F.when(F.col("k") == 1, F.col("solo")).otherwise(F.concat(F.lit("Resto ("), F.col("k").cast("string"), F.lit(")")))
    return first.withColumn(amount, money(F.col(amount))).unionByName(rest.select(label.alias(name), amount, *([count] if count else [])))


def months_without(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Months of the first that the second lacks, as one list; null if there is none."""
    missing = expected.select("mes").distinct().join(present.select("mes").distinct(), "mes", "left_anti")
    return missing.agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list("mes")), lambda m: m.cast("string")), ","), F.lit("")).alias("meses"))


def control_difference(book: Column, journal: Column) -> Column:
    """Whether two totals differ by more than 50 and more than 2 %."""
    return (journal != 0) & (F.abs(book - journal) > F.greatest(F.lit(Decimal("50")), journal * F.lit(Decimal("0.02"))))


CHANNEL_NAMES = tuple(name for name, _ in CHANNELS)


def supplier_ranking(purchases: DataFrame, name: str = "proveedor") -> DataFrame:
    """Documents, amount and the department with the largest absolute amount of each supplier, the largest first."""
    keys = ["codigo_proveedor", name]
    sums = purchases.groupBy(*keys).agg(F.count("*").alias("documentos"), money(F.sum("importe")).alias("importe"))
    weight = purchases.groupBy(*keys, "departamento").agg(F.sum(F.abs("importe")).alias("w"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "departamento"))
    main = weight.withColumn("r", best).where("r = 1").select(*keys, "departamento")
    return sums.join(main, keys).orderBy(F.desc("importe"), name)


def extras_by_person(extras: DataFrame, year: int) -> DataFrame:
    """Sum and number of sheets of each person, the largest first."""
    rows = extras.where(F.col("anio") == year).groupBy("persona").agg(money(F.sum("importe")).alias("importe"), F.count("*").alias("meses"))
    return rows.orderBy(F.desc("importe"), "persona")


def vat_by_month(vat: DataFrame, year: int) -> DataFrame:
    """Charged and borne VAT of each month, and what is to be paid."""
    rows = vat.where(in_year(F.col("fecha"), year)).groupBy(F.month("fecha").cast("long").alias("mes"))
    part = lambda book: money(zero_if_null(F.sum(F.when(F.col("libro") == book, F.col("cuota")))))
    return rows.agg(part("repercutido").alias("repercutido"), part("soportado").alias("soportado")).withColumn("liquidar", money(F.col("repercutido") - F.col("soportado")))
