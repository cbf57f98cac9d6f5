"""Evaluation metrics and training sets (survey A41-A48, Q31-Q33, J25, J26, W17, O14, U09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posada.functions.keys import split_of
from posada.functions.text import invented_figures
from posada.operators.joins import null_safe_join


def rate(part: Column, whole: Column) -> Column:
    """A share with four decimals, null without a base."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def field_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """From (name, field, value) tables: TP, FP, FN, precision, recall and exact match of each field.

    A value is a true positive if both sides have it and agree; a wrong value is a false positive and
    a false negative at once; blank counts as none.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = truth.select("name", "field", blank(F.col("value")).alias("t")).join(predicted.select("name", "field", blank(F.col("value")).alias("p")), ["name", "field"], "full_outer")
    t, p = F.col("t"), F.col("p")
    agg = both.groupBy("field").agg(
        F.count_if(t == p).alias("tp"), F.count_if(p.isNotNull() & ~F.coalesce(t == p, F.lit(False))).alias("fp"),
        F.count_if(t.isNotNull() & ~F.coalesce(t == p, F.lit(False))).alias("fn"), F.count_if(t.eqNullSafe(p)).alias("iguales"), F.count("*").alias("n"),
    )
    tp = F.col("tp")
    return agg.select("field", "tp", "fp", "fn", rate(tp, tp + F.col("fp")).alias("precision"), rate(tp, tp + F.col("fn")).alias("recall"), rate(F.col("iguales"), F.col("n")).alias("exact_match"))


def value_at(df: DataFrame, c: str, by: list[str], at: Column, name: str) -> DataFrame:
    """The value at place ``at`` (from 1, a function of ``n``) of each group's sorted values; found from counts of distinct values, so no group is gathered."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("n", F.sum("k").over(Window.partitionBy(*by))).withColumn("upto", F.sum("k").over(upto))
    return rows.where(F.col("upto") >= at).groupBy(*by).agg(F.min(c).alias(name))


def nearest_rank_by_count(df: DataFrame, c: str, by: str, q: float = 0.95, name: str = "p95") -> DataFrame:
    """The sorted value at index round-half-even(q * (n - 1))."""
    return value_at(df, c, [by], F.bround(F.lit(q) * (F.col("n") - 1), 0) + 1, name)


def latency(df: DataFrame, c: str, by: str) -> DataFrame:
    """Mean cut to a whole number and nearest-rank p95."""
    means = df.groupBy(by).agg(F.floor(F.sum(c) / F.count(c)).cast("long").alias("mean"))
    return null_safe_join(means, nearest_rank_by_count(df, c, by), [by], "left")


def upper_median(df: DataFrame, c: str, by: str, name: str = "mediana") -> DataFrame:
    """sorted[n // 2]."""
    return value_at(df, c, [by], F.floor(F.col("n") / 2) + 1, name)


def same_multiset(a: Column, b: Column) -> Column:
    """Arrays that are equal but for their order."""
    return F.array_sort(a) == F.array_sort(b)


def duplicate_pairs(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """Unordered pairs of rows that agree in all keys."""
    b = rows.select(F.col(name).alias("b"), *(F.col(k).alias(f"__{k}") for k in keys))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.select(F.col(name).alias("a"), *keys).join(b, cond & (F.col("a") < F.col("b"))).select("a", "b")


def pair_metrics(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Precision and recall of found pairs (a, b)."""
    hits = expected.distinct().join(found.distinct(), ["a", "b"], "left_semi").agg(F.count("*").alias("hits"))
    one = lambda df, n: df.distinct().agg(F.count("*").alias(n))
    rows = hits.crossJoin(one(expected, "expected")).crossJoin(one(found, "found"))  # one row each
    return rows.select("hits", "expected", "found", rate(F.col("hits"), F.col("found")).alias("precision"), rate(F.col("hits"), F.col("expected")).alias("recall"))


def compare_models(base: DataFrame, trained: DataFrame) -> DataFrame:
    """From (name, wrong array<string>) of two models: fields fixed and regressed on the documents that both have."""
    both = base.select("name", F.col("wrong").alias("b")).join(trained.select("name", F.col("wrong").alias("t")), "name")
    return both.select("name", F.array_sort(F.array_except("b", "t")).alias("fixed"), F.array_sort(F.array_except("t", "b")).alias("regressed"))


def tool_metrics(rows: DataFrame) -> DataFrame:
    """From (escenario, llamadas, correctas, ejecutadas, respuesta, resultados): rates by scenario, and over all as scenario null."""
    invented = rows.withColumn("inventadas", F.size(invented_figures(F.col("respuesta"), F.col("resultados"))))
    return invented.rollup("escenario").agg(
        F.count("*").alias("n"), rate(F.sum("correctas"), F.sum("llamadas")).alias("tasa_correctas"), rate(F.sum("ejecutadas"), F.sum("llamadas")).alias("tasa_ejecutadas"),
        F.count_if(F.col("inventadas") > 0).alias("con_inventadas"),
    )


def split_dataset(examples: DataFrame, key: str, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """``split`` follows from the key's hash, so a key's examples stay together whatever else is there."""
    return examples.withColumn("split", split_of(F.col(key), val, test))


def manifest(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split").agg(F.count("*").alias("n"))


def cap_per_key(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int, preferred: Column | None = None) -> DataFrame:
    """N rows in the order of a seeded hash, preferred ones first."""
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key]
    return rows.orderBy(*([F.desc(preferred)] if preferred is not None else []), *order).limit(n)


def mix_to_share(own: DataFrame, public: DataFrame, percent_public: int, key: str, seed: int = 7) -> DataFrame:
    """As many public rows as make ``percent_public`` of the whole."""
    n = own.count() * percent_public // (100 - percent_public)
    return own.withColumn("origen", F.lit("propio")).unionByName(seeded_sample(public, n, key, seed).withColumn("origen", F.lit("publico")))


def holdout_by_digest(templates: DataFrame, by: str, template: str) -> DataFrame:
    """of each group the template with the least md5."""
    return templates.select(by, template).distinct().groupBy(by).agg(F.min_by(template, F.struct(F.md5(F.col(template).cast("binary")), template)).alias(template))
