"""F65 over ``conversations``: turns become calls and results by the length of their texts, so that many sequences are broken and many are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.operators import dialogue
from posada.plans.driver_queries import register
from posada.plans.mapping import read

_TURNS = """turnos AS (SELECT conv_id, turn, length(text) AS l,
    CASE WHEN role = 'assistant' AND turn < 5 AND length(text) % 2 = 0 THEN 'tool_call' WHEN role = 'user' AND turn > 1 AND length(text) % 3 > 0 THEN 'tool_response' ELSE role END AS role, text FROM conversations),
hechos AS (SELECT conv_id, turn, l, role, CASE WHEN role = 'tool_call' THEN CASE WHEN l % 10 = 0 THEN '{"name": "f", "arguments": "nada"}' ELSE '{"name": "ver ' || l % 7 || '", "arguments": {"n":' || l || '}}' END ELSE text END AS text FROM turnos),
filas AS (SELECT *, row_number() OVER o AS k, count(*) FILTER (role = 'tool_call') OVER o AS n, count(*) FILTER (role = 'tool_response') OVER o AS m, lag(role) OVER o AS antes FROM hechos WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
sumas AS (SELECT conv_id, count(*) AS turnos, max(n) AS llamadas, max(m) AS m, arg_max(role, k) AS ultimo, count(*) FILTER (role = 'tool_call' AND l % 10 = 0) AS ilegibles, count(*) FILTER (m > n) AS sueltas, count(*) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool_call', 'tool_response')) AS ajenos FROM filas GROUP BY 1),
juicios AS (SELECT conv_id, turnos, llamadas, CASE WHEN ajenos > 0 THEN 'rol desconocido' WHEN ilegibles > 0 THEN 'llamada ilegible' WHEN sueltas > 0 THEN 'respuesta sin llamada' WHEN m < llamadas THEN 'llamada sin respuesta' WHEN ultimo <> 'assistant' THEN 'no acaba el asistente' END AS motivo FROM sumas)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, role = F.length("text"), F.col("role")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", size.alias("l"), F.when((role == "assistant") & (F.col("turn") < 5) & (size % 2 == 0), "tool_call").when((role == "user") & (F.col("turn") > 1) & (size % 3 > 0), "tool_response").otherwise(role).alias("role"))
    call = F.when(F.col("l") % 10 == 0, '{"name": "f", "arguments": "nada"}').otherwise(F.concat(F.lit('{"name": "ver '), (F.col("l") % 7).cast("string"), F.lit('", "arguments": {"n":'), F.col("l").cast("string"), F.lit("}}")))
    return rows.select("conv_id", "turn", "role", F.when(F.col("role") == "tool_call", call).otherwise(F.col("text")).alias("text"))


@register("f65_verdicts", f"WITH {_TURNS} SELECT conv_id, turnos, llamadas, motivo FROM juicios")
def f65_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.verdicts(dialogue.marked(_turns(spark, sf_dir)))


@register("f65_messages", f"""WITH {_TURNS},
buenas AS (SELECT f.*, sum(CASE WHEN role = 'tool_call' AND antes IN ('assistant', 'tool_call') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS mensaje FROM filas f WHERE conv_id IN (SELECT conv_id FROM juicios WHERE motivo IS NULL))
SELECT conv_id, mensaje::BIGINT AS mensaje, CASE arg_min(role, k) WHEN 'tool_call' THEN 'assistant' WHEN 'tool_response' THEN 'tool' ELSE arg_min(role, k) END AS role, coalesce(max(text) FILTER (role <> 'tool_call'), '') AS content,
  CASE WHEN arg_min(role, k) = 'tool_response' THEN 'call_' || max(m) END AS tool_call_id, CASE WHEN arg_min(role, k) = 'tool_response' THEN (SELECT 'ver_' || c.l % 7 FROM filas c WHERE c.conv_id = b.conv_id AND c.role = 'tool_call' AND c.n = max(b.m)) END AS name,
  string_agg('call_' || n || ':ver_' || l % 7 || ':{{"n":' || l || '}}', ' ' ORDER BY n) FILTER (role = 'tool_call') AS calls FROM buenas b GROUP BY conv_id, mensaje""")
def f65_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dialogue.messages(dialogue.marked(_turns(spark, sf_dir)))
    return made.withColumn("calls", F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"])), " ")).drop("tool_calls")
