"""Predicates as Column factories (survey P01-P30, in part). Text is '' rather than null when blank."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(estado: Column) -> Column:
    """Voided entries never count."""
    return estado != "anulado"


def posted(estado: Column) -> Column:
    """P02."""
    return estado == "contabilizado"


def ledger_base(lines: DataFrame, year: int, only_posted: bool = False, with_closing: bool = False) -> DataFrame:
    """Lines (joined with their headers) of a fiscal year that count."""
    out = lines.where((F.col("ejercicio") == year) & in_force(F.col("estado")))
    if only_posted:
        out = out.where(posted(F.col("estado")))
    return out if with_closing else out.where(F.col("tipo") != "cierre")


def any_prefix(code: Column, prefixes: list[str]) -> Column:
    """P04."""
    return reduce(or_, (code.startswith(p) for p in prefixes), F.lit(False))


def in_code_range(code: Column, first: str = "", last: str = "") -> Column:
    """Between two prefixes, codes below ``last`` included."""
    out = F.lit(True)
    if first:
        out = out & (F.left(code, F.lit(len(first))) >= first)
    if last:
        out = out & (F.left(code, F.lit(len(last))) <= last)
    return out


def holds_text(text: str, *columns: Column) -> Column:
    """Any of the columns holds the text, whatever its case; no character is a wildcard."""
    return reduce(or_, (F.upper(F.coalesce(c, F.lit(""))).contains(text.upper()) for c in columns))


def same_text(c: Column, text: str) -> Column:
    """P07."""
    return F.upper(c) == text.upper()


def begins_with(c: Column, text: str) -> Column:
    """P08."""
    return F.upper(c).startswith(text.upper())


def account_matches(text: str, code: Column, name: Column, nif: Column | None = None) -> Column:
    """P10: digits are a code's beginning, anything else part of the name or a tax id."""
    if text.isdigit():
        return code.startswith(text)
    out = holds_text(text, name)
    return out | same_text(nif, text) if nif is not None else out


def amount_on_either_side(amount: Decimal, debe: Column, haber: Column) -> Column:
    """P11."""
    return (debe == F.lit(amount)) | (haber == F.lit(amount))


def near_amount(amount: Decimal, c: Column) -> Column:
    """Within 1 %, at least one cent."""
    margin = max((amount * Decimal("0.01")).quantize(Decimal("0.01"), ROUND_HALF_EVEN), Decimal("0.01"))
    return c.between(F.lit(amount - margin), F.lit(amount + margin))


def on_side(side: str, debe: Column, haber: Column) -> Column:
    """P14."""
    return {"debe": debe > 0, "haber": haber > 0}.get(side, F.lit(True))


def within(date: Column, first: str | None = None, last: str | None = None) -> Column:
    """Closed bounds."""
    out = F.lit(True)
    if first:
        out = out & (date >= F.lit(first).cast("date"))
    if last:
        out = out & (date <= F.lit(last).cast("date"))
    return out


def overlaps(first: Column, last: Column, begin: str, end: str) -> Column:
    """Closed ranges that share a day."""
    return (first <= F.lit(end).cast("date")) & (last >= F.lit(begin).cast("date"))


def in_year(date: Column, year: int) -> Column:
    """As a range, so that it reaches a scan's statistics."""
    return within(date, f"{year}-01-01", f"{year}-12-31")


def not_confirmed(c: Column) -> Column:
    """Null counts as not confirmed."""
    return c.isNull() | ~c


def one_sided(debe: Column, haber: Column) -> Column:
    """P25: exactly one side is positive and none is negative."""
    return (debe >= 0) & (haber >= 0) & ((debe > 0) != (haber > 0))


def retention_candidates(c: DataFrame, today: str, states: list[str]) -> DataFrame:
    """P28."""
    return c.where((F.col("fecha_retencion") <= F.lit(today).cast("date")) & F.col("estado").isin(*states) & (F.col("clave") != ""))


def purchase_amount(with_vat: bool) -> Column:
    """P29."""
    return F.col("total") if with_vat else F.col("bruto") - F.col("dto_pp") + F.col("portes_gastos")
