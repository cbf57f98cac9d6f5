"""conversations re-shaped into messages whose tool calls carry ids and are paired with their results.

Turns are (conv_id, turn, role, text) with the roles system, user, assistant, tool_call and tool_response. A call joins the assistant's
message before it, or begins one; the k-th result belongs to the k-th call. A call is JSON with a name and, as an object or as text,
arguments. A conversation is refused as a whole if a role is unknown, a call can't be read, a result comes while no call is open,
a call stays open, or the last turn isn't the assistant's. All of it is counting along a conversation, so it is windows and one aggregate.

Defined cases: a missing role is unknown; a missing text is empty; turns of one number go by role and text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ROLES = ("system", "user", "assistant", "tool_call", "tool_response")
MAX_NAME = 64


def function_name(name: Column) -> Column:
    """Letters, digits, ``_``, ``.`` and ``-``; each run of others becomes ``_``, none stands at an end; a name that has nothing left is ``funcion``."""
    plain = F.substring(F.btrim(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), 1, MAX_NAME)
    return F.when(plain == "", "funcion").otherwise(plain)


def arguments(call: Column) -> Column:
    """A call's arguments as the JSON text of an object, ``{}`` if there are none; null if they are no object."""
    given = F.try_variant_get(call, "$.arguments", "variant")
    kind = F.schema_of_variant(given)
    inner = F.try_parse_json(F.try_variant_get(call, "$.arguments", "string"))
    is_object = lambda k: F.startswith(k, F.lit("OBJECT"))
    text = F.when(is_object(kind), F.to_json(given)).when((kind == "STRING") & is_object(F.schema_of_variant(inner)), F.to_json(inner))
    empty = given.isNull() | (kind == "VOID") | ((kind == "STRING") & (F.try_variant_get(call, "$.arguments", "string") == ""))
    return F.when(F.coalesce(empty, F.lit(True)), F.lit("{}")).otherwise(text)


def marked(turns: DataFrame) -> DataFrame:
    """Turns with their place k, message number, what their call says, and how many calls (n) and results (m) there were up to them."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("antes", F.lag("role").over(order))
    joins = (F.col("role") == "tool_call") & F.coalesce(F.col("antes").isin("assistant", "tool_call"), F.lit(False))
    rows = rows.withColumn("mensaje", F.sum(F.when(joins, 0).otherwise(1)).over(upto))
    rows = rows.withColumn("n", F.count_if(F.col("role") == "tool_call").over(upto)).withColumn("m", F.count_if(F.col("role") == "tool_response").over(upto))
    call = F.try_parse_json(F.when(F.col("role") == "tool_call", F.col("text")))
    return rows.withColumn("llamada", call).withColumn("nombre", function_name(F.try_variant_get("llamada", "$.name", "string"))).withColumn("argumentos", arguments(F.col("llamada"))).drop("llamada", "antes")


def verdicts(rows: DataFrame) -> DataFrame:
    """(conv_id, turnos, llamadas, motivo) from marked turns; ``motivo`` is null for a conversation that is accepted, else the first reason of these."""
    is_call = F.col("role") == "tool_call"
    sums = rows.groupBy("conv_id").agg(
        F.count("*").alias("turnos"), F.max("n").alias("llamadas"), F.max("m").alias("m"), F.max_by("role", "k").alias("ultimo"),
        F.count_if(~F.col("role").isin(*ROLES)).alias("ajenos"), F.count_if(is_call & (F.col("nombre").isNull() | F.col("argumentos").isNull())).alias("ilegibles"), F.count_if(F.col("m") > F.col("n")).alias("sueltas"),
    )
    reason = (
        F.when(F.col("ajenos") > 0, "rol desconocido").when(F.col("ilegibles") > 0, "llamada ilegible").when(F.col("sueltas") > 0, "respuesta sin llamada")
        .when(F.col("m") < F.col("llamadas"), "llamada sin respuesta").when(F.col("ultimo") != "assistant", "no acaba el asistente")
    )
    return sums.select("conv_id", "turnos", "llamadas", reason.alias("motivo"))


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, mensaje, role, content, tool_call_id, name, tool_calls) of accepted conversations, from marked turns that are cheap to read twice."""
    good = verdicts(rows).where("motivo IS NULL").select("conv_id")
    ident = lambda c: F.concat(F.lit("call_"), c.cast("string"))
    kept = rows.join(good, rows["conv_id"].eqNullSafe(good["conv_id"]), "left_semi")
    calls = kept.where("role = 'tool_call'").select("conv_id", F.col("n").alias("m"), F.col("nombre").alias("de"))
    results = kept.where("role = 'tool_response'").select("conv_id", "mensaje", "m", "text").join(calls.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (calls["m"] == kept["m"])).drop("c", calls["m"])
    results = results.select("conv_id", "mensaje", F.lit("tool").alias("role"), F.col("text").alias("content"), ident(F.col("m")).alias("tool_call_id"), F.col("de").alias("name"), F.lit(None).cast("array<struct<id string, name string, arguments string>>").alias("tool_calls"))
    entry = F.when(F.col("role") == "tool_call", F.struct("n", ident(F.col("n")).alias("id"), F.col("nombre").alias("name"), F.col("argumentos").alias("arguments")))
    said = kept.where("role <> 'tool_response'").groupBy("conv_id", "mensaje").agg(
        F.min_by("role", "k").alias("role"), F.max(F.when(F.col("role") != "tool_call", F.col("text"))).alias("content"), F.array_sort(F.collect_list(entry)).alias("c"))
    listed = F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["arguments"].alias("arguments")))
    said = said.select(
        "conv_id", "mensaje", F.when(F.col("role") == "tool_call", "assistant").otherwise(F.col("role")).alias("role"), F.coalesce("content", F.lit("")).alias("content"),
        F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"), F.when(F.size("c") > 0, listed).alias("tool_calls"))
    return said.unionByName(results)
