"""UD02 over the driver's tables: orders as invoices of one to three rates whose amounts are printed in no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import rates
from posada.plans.driver_queries import register
from posada.plans.mapping import read

_SQL = """WITH lines AS (SELECT l_orderkey AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CASE l_linestatus || l_returnflag WHEN 'FA' THEN 8 WHEN 'FR' THEN 20 WHEN 'FN' THEN 20 ELSE 42 END AS r, l_linenumber AS k FROM lineitem),
b AS (SELECT d, CASE WHEN k = 1 THEN r ELSE 8 + 4 * (r // 20) END AS r, sum(c)::BIGINT AS b FROM lines GROUP BY ALL), q AS (SELECT *, (b * r + 100) // 200 AS q FROM b),
s AS (SELECT d, sum(b)::BIGINT AS s, sum(q)::BIGINT AS t FROM q GROUP BY d),
printed AS (SELECT DISTINCT d, a FROM (SELECT d, b AS a FROM q UNION ALL SELECT d, q FROM q UNION ALL SELECT d, s FROM s UNION ALL SELECT d, s + t FROM s) WHERE a > 0),
numbers AS (SELECT DISTINCT d, r FROM q),
bases AS (SELECT p.d, p.a AS b FROM printed p JOIN s ON s.d = p.d WHERE p.a <= s.s),
o AS (SELECT b.d, b.b, p.a AS q, arg_min(k.r, abs(b.b * k.r - 200 * p.a) * 100 + k.r) AS r FROM bases b JOIN printed p ON p.d = b.d JOIN (SELECT unnest(range(1, 61)) AS r) k ON (b.b * k.r + 100) // 200 = p.a GROUP BY ALL),
w AS (
  SELECT o.d, 1 AS n, s.s, [o.b] AS bases, [o.q] AS quotas, [o.r] AS rates FROM o JOIN s ON s.d = o.d AND o.b = s.s
  UNION ALL SELECT x.d, 2, s.s, [x.b, y.b], [x.q, y.q], [x.r, y.r] FROM o x JOIN o y ON y.d = x.d AND y.b <= x.b JOIN s ON s.d = x.d AND x.b + y.b = s.s
  UNION ALL SELECT x.d, 3, s.s, [x.b, y.b, z.b], [x.q, y.q, z.q], [x.r, y.r, z.r] FROM o x JOIN o y ON y.d = x.d AND y.b <= x.b JOIN o z ON z.d = x.d AND z.b <= y.b JOIN s ON s.d = x.d AND x.b + y.b + z.b = s.s),
f AS (SELECT w.*, p.a AS total, len(list_filter(w.rates, lambda r: list_contains(m.rs, r))) AS shown FROM w JOIN printed p ON p.d = w.d AND p.a = w.s + list_sum(w.quotas) JOIN (SELECT d, list(r) AS rs FROM numbers GROUP BY d) m ON m.d = w.d),
g AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n, shown DESC, list_transform(bases, lambda x: -x), quotas, rates) AS k, count(*) OVER (PARTITION BY d, n, shown) AS same FROM f)
SELECT d AS document_id, total::BIGINT AS total, n::BIGINT AS n, array_to_string(bases, ',') AS bases, array_to_string(quotas, ',') AS quotas, array_to_string(rates, ',') AS rates, same > 1 AS several FROM g WHERE k = 1"""


@register("ud02_inferred_rates", _SQL)
def ud02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's invoice: the first line's rate by its flags, the others' by those in another way, so that there are one to three."""
    flags = F.concat("l_linestatus", "l_returnflag")
    rate = F.when(flags == "FA", 8).when(flags.isin("FR", "FN"), 20).otherwise(42)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"), F.when(F.col("l_linenumber") == 1, rate).otherwise(8 + 4 * F.floor(rate / 20)).cast("int").alias("rate"))
    taxed = lines.groupBy("document_id", "rate").agg(F.sum("c").alias("base")).withColumn("quota", F.floor((F.col("base") * F.col("rate") + 100) / 200))
    sums = taxed.groupBy("document_id").agg(F.sum("base").alias("subtotal"), F.sum("quota").alias("t"))
    printed = taxed.select("document_id", F.explode(F.array("base", "quota")).alias("amount")).unionByName(sums.select("document_id", F.explode(F.array("subtotal", F.col("subtotal") + F.col("t"))).alias("amount")))
    found = rates.infer(sums.select("document_id", "subtotal"), printed, taxed.select("document_id", "rate"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("document_id", "total", F.size("bases").cast("long").alias("n"), listed("bases"), listed("quotas"), listed("rates"), "several")
