"""The job queue over the driver's tables: orders as jobs, their lines as claims of a supplier at the ship date and results as many days later as the line has pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.plans.driver_queries import register
from posada.plans.mapping import read
from posada.streaming import queue

DAY = 86_400
POLICY = queue.Policy(lease=14 * DAY, attempts=3, delay=2 * DAY)


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each line; a returned line may be tried again, one that was accepted and returned late may not."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("claim"), "l_suppkey", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("sent"), (F.col("l_quantity").cast("long") * DAY).alias("took"), "l_returnflag")
    outcome = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "retry").otherwise("fatal")
    claim = F.struct(F.col("sent").alias("ts"), (2 * F.col("claim")).cast("int").alias("seq"), F.lit("claim").alias("kind"), F.lit(None).cast("string").alias("outcome"))
    result = F.struct((F.col("sent") + F.col("took")).alias("ts"), (2 * F.col("claim") + 1).cast("int").alias("seq"), F.lit("result").alias("kind"), outcome.alias("outcome"))
    return lines.select(F.col("l_orderkey").alias("job"), "claim", F.col("l_suppkey").alias("worker"), F.explode(F.array(claim, result)).alias("e")).select("job", "e.ts", "e.seq", "e.kind", "claim", "worker", "e.outcome")


_SQL = f"""WITH RECURSIVE log AS (
  SELECT l_orderkey AS job, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) AS ts, CAST(2 * l_linenumber AS INT) AS seq, 'claim' AS kind, CAST(l_linenumber AS BIGINT) AS claim, CAST(NULL AS VARCHAR) AS outcome FROM lineitem
  UNION ALL SELECT l_orderkey, CAST(epoch(CAST(l_shipdate AS TIMESTAMP)) AS BIGINT) + CAST(l_quantity AS BIGINT) * 86400, CAST(2 * l_linenumber + 1 AS INT), 'result', l_linenumber, CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'R' THEN 'retry' ELSE 'fatal' END FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, seq) AS k FROM log),
s AS (
  SELECT job, CAST(0 AS BIGINT) AS k, '' AS decision, 'pending' AS estado, 0 AS intentos, CAST(NULL AS BIGINT) AS duenyo, CAST(NULL AS BIGINT) AS desde, CAST(0 AS BIGINT) AS toca FROM n WHERE k = 1
  UNION ALL
  SELECT job, k, d, CASE d WHEN 'reclamado' THEN 'running' WHEN 'recuperado' THEN 'running' WHEN 'agotado' THEN 'dead' WHEN 'hecho' THEN 'done' WHEN 'reintento' THEN 'pending' WHEN 'muerto' THEN 'dead' ELSE estado END,
    CASE WHEN d IN ('reclamado', 'recuperado') THEN intentos + 1 ELSE intentos END,
    CASE WHEN d IN ('reclamado', 'recuperado') THEN claim WHEN d IN ('ocupado', 'descartado') THEN duenyo END, CASE WHEN d IN ('reclamado', 'recuperado') THEN ts WHEN d IN ('ocupado', 'descartado') THEN desde END,
    CASE WHEN d = 'reintento' THEN ts + {POLICY.delay} * CAST(pow(2, intentos - 1) AS BIGINT) ELSE toca END
  FROM (SELECT s.job, n.k, s.estado, s.intentos, s.duenyo, s.desde, s.toca, n.ts, n.claim,
      CASE WHEN n.kind = 'claim' THEN
        CASE WHEN NOT (s.estado = 'pending' AND s.toca <= n.ts OR s.estado = 'running' AND s.desde < n.ts - {POLICY.lease}) THEN 'ocupado'
             WHEN s.intentos >= {POLICY.attempts} THEN 'agotado' WHEN s.estado = 'running' THEN 'recuperado' ELSE 'reclamado' END
      ELSE CASE WHEN s.estado <> 'running' OR s.duenyo <> n.claim THEN 'descartado' WHEN n.outcome = 'ok' THEN 'hecho'
             WHEN n.outcome = 'retry' AND s.intentos < {POLICY.attempts} THEN 'reintento' ELSE 'muerto' END END AS d
    FROM s JOIN n ON n.job = s.job AND n.k = s.k + 1))
"""


@register("t01_queue_decisions", _SQL + "SELECT n.job, n.ts, n.seq, n.kind, n.claim, s.decision, s.estado, CAST(s.intentos AS INT) AS intentos FROM s JOIN n ON n.job = s.job AND n.k = s.k")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.replay(job_log(spark, sf_dir), POLICY)


@register("t02_committed_results", _SQL + "SELECT s.job, n.claim, CAST(s.intentos AS INT) AS intentos, (SELECT count(*) FROM s x WHERE x.job = s.job AND x.decision = 'descartado') AS descartados FROM s JOIN n ON n.job = s.job AND n.k = s.k WHERE s.decision = 'hecho'")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one result that each finished job took, and how many came from claims that had lost it."""
    decided = queue.replay(job_log(spark, sf_dir), POLICY)
    done = F.max(F.when(F.col("decision") == "hecho", F.struct("claim", "intentos")))
    rows = decided.groupBy("job").agg(done.alias("hecho"), F.count_if(F.col("decision") == "descartado").alias("descartados"))
    return rows.where("hecho IS NOT NULL").select("job", "hecho.claim", "hecho.intentos", "descartados")
