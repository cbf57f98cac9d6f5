"""Integrity controls of a fiscal year (survey Q09, V15): each is a small DataFrame of findings, and one of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posada.functions.numbers import money, zero_if_null
from posada.operators.ledger import creditor, debtor, number_gaps, with_headers

OK, WARNING, ERROR = "ok", "aviso", "error"


def unbalanced(asiento: DataFrame, apunte: DataFrame, year: int) -> DataFrame:
    """Posted entries with fewer than two lines or unequal sides."""
    sums = apunte.groupBy(F.col("asiento_id").alias("id")).agg(F.sum("debe").alias("d"), F.sum("haber").alias("h"), F.count("*").alias("k"))
    heads = asiento.where((F.col("ejercicio") == year) & (F.col("estado") == "contabilizado")).select("id").join(sums, "id", "left")
    out = heads.select("id", money(zero_if_null(F.col("d"))).alias("debe"), money(zero_if_null(F.col("h"))).alias("haber"), F.coalesce("k", F.lit(0)).cast("long").alias("n"))
    return out.where((F.col("n") < 2) | (F.col("debe") != F.col("haber")))


def three_totals(posted: DataFrame) -> DataFrame:
    """The same totals by entry, by account and as balances; a row for each view."""
    by = {}
    for view, key in (("asiento", "asiento_id"), ("cuenta", "cuenta")):
        by[view] = posted.groupBy(key).agg(F.sum("debe").alias("d"), F.sum("haber").alias("h"))
    sums = lambda df, view: df.agg(money(zero_if_null(F.sum("d"))).alias("debe"), money(zero_if_null(F.sum("h"))).alias("haber")).select(F.lit(view).alias("vista"), "debe", "haber")
    balances = by["cuenta"].select(debtor(F.col("d") - F.col("h")).alias("d"), creditor(F.col("d") - F.col("h")).alias("h"))
    return sums(by["asiento"], "asiento").unionByName(sums(by["cuenta"], "cuenta")).unionByName(sums(balances, "saldos"))


def odd_accounts(posted: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines on accounts that take none."""
    bad = accounts.where(~F.col("imputable") | ~F.col("activa")).select(F.col("codigo").alias("cuenta"))
    return posted.join(bad, "cuenta").groupBy("cuenta").agg(F.count("*").alias("n"))


def out_of_year(asiento: DataFrame, year: int, first: str, last: str) -> DataFrame:
    """P24."""
    inside = F.col("fecha").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return asiento.where((F.col("ejercicio") == year) & ~inside).select("id", "fecha")


def double_corrections(asiento: DataFrame) -> DataFrame:
    """Entries that reverse one that is voided as well."""
    void = asiento.where(F.col("estado") == "anulado").select(F.col("id").alias("revierte"))
    return asiento.where(F.col("estado") != "anulado").join(void, "revierte").select("id", "revierte")


def opening_differences(opening: DataFrame, closing: DataFrame) -> DataFrame:
    """Accounts whose opening isn't the last closing with sides swapped."""
    net = lambda df, name: df.groupBy("cuenta").agg(F.sum(F.col("debe") - F.col("haber")).alias(name))
    both = net(opening, "apertura").join(net(closing, "cierre"), "cuenta", "full_outer")
    both = both.select("cuenta", money(zero_if_null(F.col("apertura"))).alias("apertura"), money(zero_if_null(-F.col("cierre"))).alias("cierre"))
    return both.where(F.col("apertura") != F.col("cierre"))


def pending_marks(posted: DataFrame) -> DataFrame:
    return posted.where(F.col("punteo").isin("revisar", "discrepancia")).groupBy("punteo").agg(F.count("*").alias("n"))


def report(asiento: DataFrame, apunte: DataFrame, accounts: DataFrame, year: int, first: str, last: str, balance_gap: DataFrame | None = None) -> DataFrame:
    """Q09: (control, estado, n) of the ten controls; ``balance_gap`` has a row if assets and the rest differ."""
    lines = with_headers(apunte, asiento)
    posted = lines.where((F.col("ejercicio") == year) & (F.col("estado") == "contabilizado"))
    own = asiento.where(F.col("ejercicio") == year)
    totals = three_totals(posted)
    opening = posted.where(F.col("tipo") == "apertura")
    closing = lines.where((F.col("ejercicio") == year - 1) & (F.col("estado") == "contabilizado") & (F.col("tipo") == "cierre"))
    # the control applies only if there are both entries: the closing joins whatever the opening has
    comparable = opening_differences(opening, closing).join(opening.select(F.lit(1).alias("a")).limit(1), F.lit(True), "left_semi").join(closing.select(F.lit(1).alias("b")).limit(1), F.lit(True), "left_semi")
    sides = totals.where(F.col("debe") != F.col("haber")).select("vista")
    parts = [
        ("cuadre", unbalanced(asiento, apunte, year), ERROR), ("totales", sides, ERROR), ("cuentas", odd_accounts(posted, accounts), WARNING),
        ("fechas", out_of_year(asiento, year, first, last), ERROR), ("numeracion", number_gaps(own, "ejercicio", "numero"), WARNING),
        ("borradores", own.where(F.col("estado") == "borrador"), WARNING), ("reversiones", double_corrections(asiento).join(own.select("id"), "id", "left_semi"), ERROR),
        ("apertura", comparable, WARNING), ("punteo", pending_marks(posted), WARNING),
    ]
    if balance_gap is not None:
        parts.append(("balance", balance_gap, ERROR))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("control"), F.when(F.col("n") > 0, bad).otherwise(OK).alias("estado"), "n") for name, df, bad in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
