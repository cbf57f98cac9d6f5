"""UD02: the tax rates of an invoice whose lines show none, from the amounts that are printed on it.

A subtotal is split into one to three bases with a printed quota each, such that every quota is its base times a rate (a multiple of 0.5 up to
30) to the cent, and subtotal plus quotas is a printed total. Two and three bases are printed themselves. Fewest bases win; among equals those with most rates
printed, then larger bases, then smaller quotas.

A document's printed amounts are one array. Which rate turns a base into a quota is told from the two in closed form, so sixty rates are
never tried, and of n * n pairs only those with a quota stay; the last part of a split is looked up. Documents are dealt once by id, and
what has a split of fewer parts isn't searched for more. Amounts are cents as whole numbers; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 60  # rates 0.5, 1, ... 30
PARTS = 3


def _rate(base: Column, quota: Column) -> Column:
    """The rate (in halves) nearest to quota / base, of two the lesser; if any rate makes the quota to the cent, it does."""
    return F.greatest(F.lit(1), F.least(F.lit(STEPS), F.call_function("div", 400 * quota + base - 1, 2 * base))).cast("int")


def _made(base: Column, rate: Column) -> Column:
    return F.call_function("div", base * rate + 100, F.lit(200))


def options(bases: Column, amounts: Column) -> Column:
    """Structs (base, quota, rate) of bases with a printed quota, by the nearest rate, then the least. ``rate`` counts halves."""
    def of(b: Column) -> Column:
        likely = F.filter(amounts, lambda q: (200 * q <= b * STEPS + 100) & (200 * q >= b - 100))
        tried = F.transform(likely, lambda q: F.struct(b.alias("base"), q.alias("quota"), _rate(b, q).alias("rate")))
        return F.filter(tried, lambda o: _made(o["base"], o["rate"]) == o["quota"])

    return F.flatten(F.transform(bases, of))


def _splits(subtotal: Column, known: Column, parts: int) -> Column:
    """Structs (bases, quotas, rates): ways to write the subtotal as ``parts`` bases in falling order, each with a quota."""
    def go(rest: Column, above: list[Column]) -> Column:
        left = parts - len(above)
        fits = lambda o: (o["base"] == rest) if left == 1 else (o["base"] < rest) & (o["base"] * left >= rest)
        falls = (lambda o: fits(o) & (o["base"] <= above[-1]["base"])) if above else fits
        if left == 1:
            return F.transform(F.filter(known, falls), lambda o: F.struct(*(F.array(*(x[c] for x in [*above, o])).alias(f"{c}s") for c in ("base", "quota", "rate"))))
        return F.flatten(F.transform(F.filter(known, falls), lambda o: go(rest - o["base"], [*above, o])))

    return go(subtotal, [])


def infer(subtotals: DataFrame, printed: DataFrame, numbers: DataFrame) -> DataFrame:
    """(document_id, total, bases, quotas, rates, several) of the documents that can be solved; ``several`` says that another split fits as well.

    ``subtotals``: (document_id, subtotal); ``printed``: (document_id, amount) in cents; ``numbers``: (document_id, rate), printed numbers as halves.
    """
    # a document's amounts, and at most sixty printed rates that matter
    amounts = printed.where("amount > 0").groupBy("document_id").agg(F.collect_set("amount").alias("amounts"))
    shown = numbers.where(F.col("rate").between(1, STEPS)).groupBy("document_id").agg(F.collect_set("rate").alias("shown"))
    docs = subtotals.where("subtotal > 0").join(amounts, "document_id").join(shown, "document_id", "left")
    docs = docs.withColumn("shown", F.coalesce("shown", F.array().cast("array<int>")))
    bases = F.filter(F.array_union("amounts", F.array("subtotal")), lambda a: a <= F.col("subtotal"))
    docs = docs.withColumn("known", options(bases, F.col("amounts")))

    def ranked(parts: int) -> Column:
        total = lambda w: F.aggregate(w["quotas"], F.col("subtotal"), lambda a, q: a + q)
        count = lambda w: F.size(F.filter(w["rates"], lambda r: F.array_contains("shown", r)))
        good = F.filter(_splits(F.col("subtotal"), F.col("known"), parts), lambda w: F.array_contains("amounts", total(w)))
        return F.transform(good, lambda w: F.struct((-count(w)).alias("n"), F.transform(w["bases"], lambda b: -b).alias("b"), w["quotas"].alias("quotas"), w["rates"].alias("rates"), w["bases"].alias("bases"), total(w).alias("total")))

    for parts in range(1, PARTS + 1):
        found = ranked(parts) if parts == 1 else F.when(F.size("found") > 0, F.col("found")).otherwise(ranked(parts))
        docs = docs.withColumn("found", found)
    # an outer explode, so that no filter repeats the search
    best = docs.select("document_id", "found", F.explode_outer(F.slice(F.array_sort("found"), 1, 1)).alias("x")).where("x IS NOT NULL")
    several = F.size(F.filter("found", lambda w: w["n"] == F.col("x.n"))) > 1
    return best.select("document_id", "x.total", "x.bases", "x.quotas", "x.rates", several.alias("several"))
