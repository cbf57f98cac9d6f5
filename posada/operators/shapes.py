"""Positional, spatial and sequential operators of the document readers (survey W03, W13-W20, J27-J30, A40, UD04)."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance_breaks(lines: DataFrame, by: str, order: str, tolerance: str = "0.01") -> DataFrame:
    """Lines whose printed balance isn't the one before plus debit less credit.

    The balance is taken from the print after a break, as a fold over each file's lines in order; a
    file is one ledger and fits a task. Without the fold, drifts below the tolerance would add up.
    """
    item = F.struct(F.col(order).alias("k"), F.col("debe").cast("decimal(20,2)").alias("d"), F.col("haber").cast("decimal(20,2)").alias("h"), F.col("saldo").cast("decimal(20,2)").alias("s"))
    start = F.struct(F.lit(None).cast("decimal(20,2)").alias("s"), F.array().cast("array<struct<k:bigint,esperado:decimal(20,2),saldo:decimal(20,2)>>").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        want = (acc["s"] + x["d"] - x["h"]).cast("decimal(20,2)")
        off = F.coalesce(F.abs(want - x["s"]) > F.lit(Decimal(tolerance)), F.lit(False))
        row = F.struct(x["k"].cast("bigint").alias("k"), want.alias("esperado"), x["s"].alias("saldo"))
        # a first line, and a line after a break, start from what is printed
        return F.struct(F.when(off | acc["s"].isNull(), x["s"]).otherwise(want).alias("s"), F.when(off, F.concat(acc["bad"], F.array(row))).otherwise(acc["bad"]).alias("bad"))

    folded = lines.groupBy(by).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step)["bad"].alias("bad"))
    return folded.select(by, F.explode("bad").alias("b")).select(by, F.col("b.k").alias(order), "b.esperado", "b.saldo")


def local_breaks(lines: DataFrame, by: str, order: str, tolerance: str = "0.01") -> DataFrame:
    """W03's local form: each line against the one printed before it. Needs no fold, and scales within a file."""
    previous = F.lag("saldo").over(Window.partitionBy(by).orderBy(order))
    want = previous + F.col("debe") - F.col("haber")
    return lines.withColumn("esperado", want.cast("decimal(20,2)")).where(F.abs(F.col("esperado") - F.col("saldo")) > F.lit(Decimal(tolerance))).select(by, order, "esperado", F.col("saldo").cast("decimal(20,2)").alias("saldo"))


def suffix_repeats(rows: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """The second of a name becomes "name (2)" and so on."""
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    return rows.withColumn(name, F.when(k > 1, F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def fill_down(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """Blanks take the last value above them."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})


def blocks_by_blank(rows: DataFrame, by: str, order: str, is_blank: Column) -> DataFrame:
    """Numbers the blocks between blank rows; blank rows go."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("bloque", F.sum(is_blank.cast("int")).over(window).cast("long")).where(~is_blank)


def cluster_1d(points: DataFrame, by: str, x: str, tolerance: float) -> DataFrame:
    """The largest run of positions whose neighbours are within ``tolerance``, if it has two points and half of all.

    Columns: by, desde, hasta, n. Ties go to the leftmost run.
    """
    order = Window.partitionBy(by).orderBy(x)
    gap = F.coalesce((F.col(x) - F.lag(x).over(order) > tolerance).cast("int"), F.lit(0))
    numbered = points.withColumn("g", gap).withColumn("g", F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy(by, "g").agg(F.min(x).alias("desde"), F.max(x).alias("hasta"), F.count("*").alias("n"))
    every = Window.partitionBy(by)
    best = F.row_number().over(every.orderBy(F.desc("n"), "desde"))
    ranked = runs.withColumn("todos", F.sum("n").over(every)).withColumn("r", best)
    return ranked.where((F.col("r") == 1) & (F.col("n") >= 2) & (2 * F.col("n") >= F.col("todos"))).select(by, "desde", "hasta", "n")


def rows_by_height(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Numbers the printed rows of a page from its words (page, left, top, height).

    A word joins the row if its top is within ``tolerance`` heights of the row's highest top. Words come sorted, so that is the
    row's first; a word without a top or height joins the row before it. Spark sorts pages and words, and Python runs
    over the sorted words with one row's state, whatever a page's size. Words at one place go by height.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, number, base = None, -1, None  # before the first word
        for b in batches:
            fila = []
            for p, top, height in zip(*(b.column(c).to_pylist() for c in ("page", "top", "height"))):
                if number < 0 or p != page:
                    page, number, base = p, 0, top
                elif base is not None and top is not None and height is not None and top - base > tolerance * height:
                    number, base = number + 1, top
                fila.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fila, pa.int64())], [*b.schema.names, "fila"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    order = ["page", *(F.asc_nulls_last(c) for c in ("top", "left", "height"))]
    return words.repartition("page").sortWithinPartitions(*order).mapInArrow(run, f"{fields}, fila long")


def join_by_rank(left: DataFrame, right: DataFrame, by: str, order_left: str, order_right: str) -> DataFrame:
    """The k-th of one side with the k-th of the other, only where both have as many."""
    a = left.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order_left))).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    b = right.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(order_right))).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return a.join(b, [by, "k", "n"]).drop("n")


def value_beside(cells: DataFrame, label: Column, passes: Column, reach: float = 300.0) -> DataFrame:
    """For each label cell the nearest cell to its right or below it that passes a check.

    Cells: page, left, bottom, right, top, text. Pairs are made within a page only.
    """
    names = ("left", "bottom", "right", "top", "text")
    a = cells.where(label).select("page", *(F.col(c).alias(f"l_{c}") for c in names))
    b = cells.where(passes & ~label)
    beside = (F.col("left") >= F.col("l_right") - 1) & (F.abs(F.col("bottom") - F.col("l_bottom")) <= (F.col("l_top") - F.col("l_bottom")))
    below = (F.col("top") <= F.col("l_bottom") + 1) & (F.col("left") < F.col("l_right")) & (F.col("right") > F.col("l_left"))
    distance = F.when(beside, F.col("left") - F.col("l_right")).otherwise(F.col("l_bottom") - F.col("top"))
    near = a.join(b, "page").where(beside | below).withColumn("distance", distance).where(F.col("distance") <= reach)
    best = F.row_number().over(Window.partitionBy("page", "l_text", "l_left", "l_bottom").orderBy("distance", "text"))
    return near.withColumn("r", best).where("r = 1").select("page", F.col("l_text").alias("label"), F.col("text").alias("value"), "distance")


def smallest_container(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The smallest region of the page that holds a point (id, page, x, y); an id that stands at several places has one region.

    Of regions with the same sides the first alone counts, and a place is looked up once, however many points stand there.
    """
    sides = ("left", "right", "bottom", "top")
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("bottom"), F.col("top"))
    area = (F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))
    boxes = regions.groupBy("page", *sides).agg(F.min("region").alias("region"))
    places = points.groupBy("page", "x", "y").agg(F.lit(1).alias("n")).drop("n")
    held = places.join(boxes, "page").where(inside).groupBy("page", "x", "y").agg(F.min(F.struct(area.alias("area"), F.col("region"))).alias("held"))
    return points.join(held, ["page", "x", "y"]).groupBy("id").agg(F.min("held")["region"].alias("region"))


def nearest_offset(names: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each document's name nearest to the anchor's offset; of equally near ones the one that is repeated more."""
    counted = names.withColumn("veces", F.count("*").over(Window.partitionBy("document_id", "name")))
    gap = F.abs(F.col("offset") - F.col("anchor"))
    return counted.join(anchors, "document_id").groupBy("document_id").agg(F.min(F.struct(gap.alias("gap"), (-F.col("veces")).alias("veces"), F.col("name")))["name"].alias("name"))


def latest_flag(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Marks each key's latest row."""
    return rows.withColumn("actual", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1)


def last_turns(turns: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last 2 n messages of each conversation."""
    return turns.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__r") <= 2 * n).drop("__r")


def prune(copies: DataFrame, kind: str, date: str, today: str, days: int, least: int) -> DataFrame:
    """Copies to delete: older than ``days``, but never a kind's newest ``least``."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(date)))
    return copies.withColumn("__r", rank).where((F.col("__r") > least) & (F.date_diff(F.lit(today).cast("date"), F.col(date)) > days)).drop("__r")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """A38."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def delivery_note_totals(lines: DataFrame, printed: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """Sums of lines against printed totals."""
    sums = lines.groupBy("document_id", "albaran").agg(F.sum("importe").cast("decimal(24,2)").alias("suma"))
    return sums.join(printed, ["document_id", "albaran"]).where(F.abs(F.col("suma") - F.col("total")) > F.lit(Decimal(tolerance)))


def overlapping_years(years: DataFrame, *by: str) -> DataFrame:
    """P20: fiscal years (of each company, by ``by``) that begin before an earlier one ends."""
    order = Window.partitionBy(*by).orderBy("fecha_inicio", "anio").rowsBetween(Window.unboundedPreceding, -1)  # a company has a handful of years
    return years.withColumn("previo", F.max("fecha_fin").over(order)).where(F.col("previo") >= F.col("fecha_inicio")).drop("previo")


def year_of(dates: DataFrame, years: DataFrame) -> DataFrame:
    """The fiscal year that holds each date, null if none does; ``years`` has a row for each fiscal year, of which there may be any number.

    Each year is repeated for the months that it touches, so dates meet it by an equi-join.
    """
    month = lambda d: F.trunc(d, "month")
    months = F.sequence(month("fecha_inicio"), month("fecha_fin"), F.expr("interval 1 month"))
    held = years.where("fecha_inicio <= fecha_fin").select("anio", "fecha_inicio", "fecha_fin", F.explode(months).alias("__mes"))
    on = (month("fecha") == F.col("__mes")) & F.col("fecha").between(F.col("fecha_inicio"), F.col("fecha_fin"))
    return dates.join(held, on, "left").drop("fecha_inicio", "fecha_fin", "__mes")


def previous_year(years: DataFrame, *by: str) -> DataFrame:
    """Each fiscal year's predecessor (in its company, by ``by``), the last that ended before it began."""
    ends = years.where(F.col("fecha_fin").isNotNull()).select(F.col("fecha_fin").alias("dia"), F.lit(1).alias("fin"), F.struct("fecha_fin", "anio").alias("de"), F.lit(None).alias("anio"), *by)
    starts = years.select(F.col("fecha_inicio").alias("dia"), F.lit(0).alias("fin"), F.lit(None).alias("de"), "anio", *by)
    # beginnings and ends in one order (a year that ends on the day itself hasn't ended): two rows for each year
    before = Window.partitionBy(*by).orderBy("dia", "fin").rowsBetween(Window.unboundedPreceding, -1)
    met = starts.unionByName(ends).withColumn("previo", F.max("de").over(before))
    return met.where("fin = 0").select(*by, "anio", F.col("previo.anio").alias("anterior"))
