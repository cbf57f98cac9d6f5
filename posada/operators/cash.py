"""Daily cash (survey Q21, A18, A19, K09) and payroll."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.numbers import money, percent, zero_if_null

SALES = ("bar", "comedor", "chill_out")
OTHER = ("ecotasa", "menus", "facturas", "parking_efectivo", "parking_visa")
AMOUNTS = SALES + OTHER


def month_sums(days: DataFrame, year: int) -> DataFrame:
    """Sums of each measure by month, row totals, and each sale's share."""
    sums = days.where(F.col("anio") == year).groupBy(F.col("mes").cast("long").alias("mes")).agg(*(money(zero_if_null(F.sum(c))).alias(c) for c in AMOUNTS))
    total = lambda names: money(sum((F.col(c) for c in names), F.lit(0)))
    sums = sums.withColumn("ventas", total(SALES)).withColumn("otros", total(OTHER))
    return sums.select("*", *(percent(F.col(c), F.col("ventas")).alias(f"peso_{c}") for c in SALES))


def dense_month(days: DataFrame, year: int, month: int) -> DataFrame:
    """A row for each day of the month, zero where there was none; days that the month lacks are ignored."""
    first = F.to_date(F.lit(f"{year}-{month:02d}-01"))
    calendar = days.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("fecha")).select(F.day("fecha").cast("long").alias("dia"))
    own = days.where((F.col("anio") == year) & (F.col("mes") == month)).select(F.col("dia").cast("long").alias("dia"), *AMOUNTS)
    return calendar.join(own, "dia", "left").select("dia", *(money(zero_if_null(F.col(c))).alias(c) for c in AMOUNTS))


def year_grid(days: DataFrame, year: int, column: str) -> DataFrame:
    """Q21: a row for each day of the month, a column for each month."""
    wide = days.where(F.col("anio") == year).groupBy(F.col("dia").cast("long").alias("dia")).pivot("mes", list(range(1, 13))).agg(F.sum(column))
    return wide.select("dia", *(money(zero_if_null(F.col(f"`{m}`"))).alias(f"m{m:02d}") for m in range(1, 13)))


def payroll_months(payroll: DataFrame, year: int) -> DataFrame:
    """Q22: payslips, employees and cost of each month."""
    return payroll.where(F.col("anio") == year).groupBy("mes").agg(F.count("*").alias("nominas"), F.count_distinct("nif").alias("empleados"), money(F.sum("cost_tot")).alias("coste"))


def neighbours(months: DataFrame) -> DataFrame:
    """The months before and after each, among those that exist."""
    order = Window.orderBy("anio", "mes")
    at = F.struct("anio", "mes")
    return months.select("anio", "mes").distinct().withColumn("anterior", F.lag(at).over(order)).withColumn("siguiente", F.lead(at).over(order))


def last_month_with_data(summary: DataFrame, *columns: str) -> DataFrame:
    """The last month in which any column differs from zero."""
    any_value = F.exists(F.array(*(F.col(c) for c in columns)), lambda x: x != 0)
    return summary.where(any_value).agg(F.max("mes").alias("mes"))


def payroll_by_department(payroll: DataFrame, year: int) -> DataFrame:
    """Cost, extras and distinct employees of each department."""
    return payroll.where(F.col("anio") == year).groupBy("departamento").agg(
        money(F.sum("cost_tot")).alias("coste"), money(F.sum("importe_extra")).alias("extras"), F.count_distinct("nif").alias("empleados"), F.count("*").alias("nominas")
    )


def payroll_matrix(payroll: DataFrame, year: int) -> DataFrame:
    """A row for each department, a column for each month."""
    wide = payroll.where(F.col("anio") == year).groupBy("departamento").pivot("mes", list(range(1, 13))).agg(F.sum("cost_tot"))
    return wide.select("departamento", *(money(zero_if_null(F.col(f"`{m}`"))).alias(f"m{m:02d}") for m in range(1, 13)))


def payroll_burden(payroll: DataFrame, year: int) -> DataFrame:
    """Taxes and contributions of the year in one row."""
    names = ("deveng", "irpf_din", "irpf_esp", "ss_trabaj", "ss_empr", "s_neto", "cost_tot")
    return payroll.where(F.col("anio") == year).agg(*(money(zero_if_null(F.sum(c))).alias(c) for c in names))


def carry_department(payroll: DataFrame, year: int, month: int) -> DataFrame:
    """A month's blank departments filled with each employee's latest other department, whatever its date."""
    own = payroll.where((F.col("anio") == year) & (F.col("mes") == month))
    others = payroll.where(((F.col("anio") != year) | (F.col("mes") != month)) & (F.col("departamento") != ""))
    latest = others.groupBy("nif").agg(F.max(F.struct("anio", "mes", "departamento"))["departamento"].alias("previo"))
    blank = F.coalesce("departamento", F.lit("")) == ""
    return own.join(latest, "nif", "left").withColumn("departamento", F.when(blank, F.coalesce("previo", F.lit(""))).otherwise(F.col("departamento"))).drop("previo")
