"""Statutory statements (survey Q08, J10, J11, UD06, V16).

A statement model is a table, one row for each line: estado, seccion, signo (deudor or acreedor),
ref, padre, orden, cuentas (a list such as "201, (2801)"), formula (array of refs) and
resultado (takes the pending result). Models are data: pass any. The shorter ones are given
here; the full balance is to be loaded, e.g. from JSON, with MODEL as its schema.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posada.functions.keys import account_list, prefixes
from posada.functions.numbers import money, zero_if_null

MODEL = "estado string, seccion int, signo string, ref string, padre string, orden int, cuentas string, formula array<string>, resultado boolean"

# The abridged profit and loss account, (ref, accounts) or (ref, refs that it sums).
ABRIDGED_PROFIT_AND_LOSS = (
    ("1", "700, 701, 702, 703, 704, 705, (706), (708), (709)"),
    ("2", "(6930), 71*, 7930"),
    ("3", "73"),
    ("4", "(600), (601), (602), 606, (607), 608, 609, 61*, (6931), (6932), (6933), 7931, 7932, 7933"),
    ("5", "740, 747, 75"),
    ("6", "(64), 7950, 7957"),
    ("7", "(62), (631), (634), 636, 639, (65), (694), (695), 794, 7954"),
    ("8", "(68)"),
    ("9", "746"),
    ("10", "7951, 7952, 7955, 7956"),
    ("11", "(670), (671), (672), (690), (691), (692), 770, 771, 772, 790, 791, 792"),
    ("OR", "(678), 778"),
    ("A", ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "OR")),
    ("12", "760, 761, 762, 767, 769"),
    ("13", "(660), (661), (662), (664), (665), (669)"),
    ("14", "(663), 763"),
    ("15", "(668), 768"),
    ("16", "(666), (667), (673), (675), (696), (697), (698), (699), 766, 773, 775, 796, 797, 798, 799"),
    ("B", ("12", "13", "14", "15", "16")),
    ("C", ("A", "B")),
    ("17", "(6300)*, 6301*, (633), 638"),
    ("D", ("C", "17")),
)

# Limits of the abridged accounts; two of three must hold.
LIMITS = {"balance": (4_000_000, 8_000_000, 50), "pyg": (11_400_000, 22_800_000, 250)}

# Kinds of entries that a statement leaves out.
LEFT_OUT = {"balance": ("cierre",), "pyg": ("regularizacion", "cierre"), "ecpn": ("regularizacion", "cierre")}


def model_table(spark: SparkSession, statement: str, rows: tuple, sign: str = "acreedor") -> DataFrame:
    """A one-section model from (ref, accounts or refs) pairs, in document order."""
    data = [
        (statement, 0, sign, ref, None, k, x if isinstance(x, str) else "", [] if isinstance(x, str) else list(x), False)
        for k, (ref, x) in enumerate(rows)
    ]
    return spark.createDataFrame(data, MODEL)


def abridged_profit_and_loss(spark: SparkSession) -> DataFrame:
    return model_table(spark, "pyg", ABRIDGED_PROFIT_AND_LOSS)


def longest_prefix(codes: DataFrame, code: str, rules: DataFrame, prefix: str) -> DataFrame:
    """Each code's longest prefix among ``rules``, by way of an equi-join with the code's own prefixes."""
    own = codes.select(code).distinct().withColumn(prefix, F.explode(prefixes(F.col(code))))
    return own.join(rules.select(prefix).distinct(), prefix).groupBy(code).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def assign(balances: DataFrame, model: DataFrame) -> DataFrame:
    """The line of each (cuenta, columna, saldo); null if the model has none.

    An account that stands on both sides goes to the debit side if its balance is positive, else to
    the credit side; several lines of one side: the first in document order.
    """
    owners = model.select("seccion", "signo", "ref", "orden", F.explode(account_list(F.col("cuentas"))).alias("prefijo"))
    found = longest_prefix(balances, "cuenta", owners, "prefijo")
    side = F.when(F.col("saldo") > 0, "deudor").otherwise("acreedor")
    rank = Window.partitionBy("cuenta", "columna").orderBy(F.col("signo") != F.col("lado"), "seccion", "orden")
    sides = owners.groupBy("prefijo").agg(F.count_distinct("signo").alias("lados"))
    rows = balances.withColumn("lado", side).join(found, "cuenta").join(owners, "prefijo").join(sides, "prefijo")
    # on one side only, the sign of the balance doesn't choose
    rows = rows.withColumn("lado", F.when(F.col("lados") > 1, F.col("lado")).otherwise(F.col("signo"))).withColumn("r", F.row_number().over(rank)).where("r = 1")
    return balances.join(rows.select("cuenta", "columna", "ref", "signo"), ["cuenta", "columna"], "left")


def year_balances(lines: DataFrame, statement: str, years: tuple[int, int]) -> DataFrame:
    """(cuenta, columna, saldo) of two years, posted entries only, without those that the statement leaves out; columna 0 is the first year."""
    rows = lines.where((F.col("estado") == "contabilizado") & F.col("ejercicio").isin(*years) & ~F.col("tipo").isin(*LEFT_OUT[statement]))
    sums = rows.groupBy("cuenta", F.when(F.col("ejercicio") == years[0], 0).otherwise(1).alias("columna")).agg(money(F.sum(F.col("debe") - F.col("haber"))).alias("saldo"))
    return sums.where("saldo <> 0")


def statement(balances: DataFrame, model: DataFrame, groups: tuple[str, ...], outside: DataFrame | None = None) -> DataFrame:
    """Q08: (seccion, ref, orden, actual, anterior) of every line.

    A line is the sum of what is assigned to it and to the lines below it; formulas sum lines above
    them in the document, step by step for at most as many steps as there are formulas. ``outside``
    gives (ref, actual, anterior) of lines that take their value from another statement.
    """
    spark = balances.sparkSession
    pending = balances.where(F.left("cuenta", F.lit(1)).isin("6", "7")).groupBy("columna").agg(money(-F.sum("saldo")).alias("v"))
    own = assign(balances.where(F.left("cuenta", F.lit(1)).isin(*groups)), model).where("ref IS NOT NULL")
    direct = own.select("ref", "columna", money(F.when(F.col("signo") == "deudor", F.col("saldo")).otherwise(-F.col("saldo"))).alias("v"))
    direct = direct.unionByName(model.where("resultado").select("ref").crossJoin(pending).select("ref", "columna", "v"))  # two rows at most
    lines = {r["ref"]: r for r in model.select("ref", "padre", "orden", "formula").collect()}  # the model is a form of some hundred lines
    above = []
    for ref, r in lines.items():
        at = ref
        while at:
            above.append((ref, at))
            at = lines[at]["padre"]
    closure = spark.createDataFrame(above, "ref string, sobre string")
    sums = direct.join(F.broadcast(closure), "ref").groupBy(F.col("sobre").alias("ref")).agg(
        *(money(zero_if_null(F.sum(F.when(F.col("columna") == k, F.col("v"))))).alias(c) for k, c in enumerate(("actual", "anterior")))
    )
    if outside is not None:
        sums = sums.join(outside.select("ref"), "ref", "left_anti").unionByName(outside.select("ref", *(money(F.col(c)).alias(c) for c in ("actual", "anterior"))))
    terms = _formula_terms(lines)
    table = spark.createDataFrame([(ref, part, n) for ref, parts in terms.items() for part, n in parts.items()], "ref string, parte string, veces int")
    totals = table.join(sums.withColumnRenamed("ref", "parte"), "parte").groupBy("ref").agg(*(money(F.sum(F.col(c) * F.col("veces"))).alias(c) for c in ("actual", "anterior")))
    values = sums.join(totals.select("ref"), "ref", "left_anti").unionByName(totals)
    return model.select("seccion", "ref", "orden").join(values, "ref", "left").select(
        "seccion", "ref", "orden", *(money(zero_if_null(F.col(c))).alias(c) for c in ("actual", "anterior"))
    )


def _formula_terms(lines: dict) -> dict[str, dict[str, int]]:
    """Each formula as counts of lines that aren't formulas; refs that come later in the document, or are unknown, count as zero."""
    out: dict[str, dict[str, int]] = {}
    for ref, r in sorted(lines.items(), key=lambda x: x[1]["orden"]):
        if not r["formula"]:
            continue
        terms: dict[str, int] = {}
        for part in r["formula"]:
            if part not in lines or lines[part]["orden"] >= r["orden"]:
                continue
            for leaf, n in out.get(part, {part: 1}).items():
                terms[leaf] = terms.get(leaf, 0) + n
        out[ref] = terms
    return out


def section_totals(values: DataFrame, model: DataFrame) -> DataFrame:
    """Sums of a section's top lines."""
    top = model.where("padre IS NULL").select("ref")
    return values.join(top, "ref").groupBy("seccion").agg(*(money(F.sum(c)).alias(c) for c in ("actual", "anterior")))


def unclassified(balances: DataFrame, model: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Accounts with a balance in the first year and no line."""
    return assign(balances.where(F.left("cuenta", F.lit(1)).isin(*groups) & (F.col("columna") == 0)), model).where("ref IS NULL").select("cuenta", "saldo")


def may_abridge(figures: DataFrame) -> DataFrame:
    """From (anio, activo, cifra, trabajadores): two of three limits, in the year and in the one before if there is one."""
    def holds(kind: str) -> F.Column:
        assets, turnover, staff = LIMITS[kind]
        parts = (F.col("activo") <= F.lit(Decimal(assets)), F.col("cifra") <= F.lit(Decimal(turnover)), F.coalesce(F.col("trabajadores") <= staff, F.lit(False)))
        return sum((p.cast("int") for p in parts), F.lit(0)) >= 2

    previous = Window.orderBy("anio")
    rows = figures.select("anio", *(holds(k).alias(k) for k in LIMITS))
    follows = F.lag("anio").over(previous) == F.col("anio") - 1
    return rows.select("anio", *(c for k in LIMITS for c in (F.col(k).alias(f"{k}_este"), (F.col(k) & F.coalesce(F.when(follows, F.lag(k).over(previous)), F.lit(True))).alias(f"{k}_puede"))))
