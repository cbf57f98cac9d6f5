"""Date functions as Column expressions (survey F40-F45). "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and short names in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def parse_date(c: Column) -> Column:
    """ISO first (the first ten characters), then day, month, year with / . or -, two-digit years in this century."""
    raw = F.trim(c)
    day, month, year = (F.regexp_extract(raw, r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})$", k) for k in (1, 2, 3))
    whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    iso = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left(raw, F.lit(10)))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(F.nullif(F.concat_ws("-", whole, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("--")), "yyyy-MM-dd"))


def month_of_name(c: Column) -> Column:
    """the month that a sheet's name begins with (three letters are enough), else null."""
    key = F.lower(F.trim(c))
    out = None
    for k, name in enumerate(MONTHS, 1):
        hit = key.startswith(name[:3])
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out


def year_of_name(c: Column) -> Column:
    """the first four-digit year in a name, else null."""
    return F.nullif(F.regexp_extract(c, r"(20[0-9]{2})", 1), F.lit("")).cast("int")


def month_and_year_of_file(c: Column) -> Column:
    """(month, year) of names such as x_03_2026.csv."""
    pattern = r"([0-9]{2})_([0-9]{4})"
    return F.struct(F.regexp_extract(c, pattern, 1).try_cast("int").alias("mes"), F.regexp_extract(c, pattern, 2).try_cast("int").alias("anio"))


def nights(arrival: Column, departure: Column) -> Column:
    """at least one, a day use counting as a night."""
    return F.greatest(F.date_diff(departure, arrival), F.lit(1))


def night_dates(arrival: Column, departure: Column) -> Column:
    """the dates of the nights."""
    return F.sequence(arrival, F.date_add(arrival, nights(arrival, departure) - 1))


def invoice_months(date: Column) -> Column:
    """an invoice of a quarter's end (28th or later of its last month) belongs to its three months."""
    m = F.month(date)
    return F.when((m % 3 == 0) & (F.day(date) >= 28), F.array(m - 2, m - 1, m)).otherwise(F.array(m))


def days_in_month(date: Column) -> Column:
    """F45."""
    return F.day(F.last_day(date))


def month_starts(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def month_overlap_days(first: Column, last: Column, month_start: Column) -> Column:
    """days of the closed range that fall in a month."""
    return F.greatest(F.date_diff(F.least(last, F.last_day(month_start)), F.greatest(first, month_start)) + 1, F.lit(0))
