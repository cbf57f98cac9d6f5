"""Order by what a printed cell means, a number, a date or a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("num", "fecha", "texto")


def typed_key(c: Column, kind: str, collation: str | None = None) -> Column:
    """What a cell is sorted by.

    ``num``: Spanish figures, negative in brackets or after a minus, all other signs ignored; what is no number comes before all numbers. ``fecha``:
    the first dd/mm/yyyy in the text as yyyymmdd, blank for none. ``texto``: lower case, by code points, or by a collation such as "es", which puts
    ñ after n and marks after letters.
    """
    shown = F.trim(F.coalesce(c, F.lit("")))
    if kind == "num":
        kept = F.regexp_replace(shown, r"[^\d,().-]", "")
        negative = kept.rlike(r"^\(.*\)$") | kept.startswith("-")
        figures = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[()-]", ""), r"\.", ""), r"^([^,]*),", "$1.")
        size = F.when(figures == "", F.lit(0.0)).otherwise(figures.try_cast("double"))
        return F.coalesce(F.when(kept != "", F.when(negative, -size).otherwise(size)), F.lit(float("-inf")))
    if kind == "fecha":
        part = lambda k: F.regexp_extract(shown, r"(\d{2})/(\d{2})/(\d{4})", k)
        return F.concat(part(3), part(2), part(1))
    if kind == "texto":
        return F.collate(shown, collation) if collation else F.lower(shown)
    raise ValueError(f"kind {kind!r} is none of {', '.join(KINDS)}")


def typed_order(column: str, kind: str, descending: bool = False, collation: str | None = None) -> Column:
    key = typed_key(F.col(column), kind, collation)
    return key.desc() if descending else key.asc()


def typed_sort(rows: DataFrame, column: str, kind: str, order: str, descending: bool = False, collation: str | None = None) -> DataFrame:
    """Rows by a typed column; equal ones stay in ``order``, whichever way the column goes."""
    return rows.orderBy(typed_order(column, kind, descending, collation), order)


def typed_rank(by: str, column: str, kind: str, order: str, descending: bool = False, collation: str | None = None) -> Column:
    """A row's place in its table on the screen (``by``)."""
    return F.row_number().over(Window.partitionBy(by).orderBy(typed_order(column, kind, descending, collation), order)).cast("long")
