"""messages with paired calls, and sequences that are refused."""

from pyspark.sql import functions as F

from posada.operators import dialogue

CALL = '{"name": "ver saldo", "arguments": {"cuenta": "57"}}'


def shape(spark, convs):
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    marked = dialogue.marked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).cache()
    return {r.conv_id: r.motivo for r in dialogue.verdicts(marked).collect()}, sorted(dialogue.messages(marked).collect(), key=lambda r: (r.conv_id, r.mensaje))


def test_calls_join_the_message_before_and_results_are_paired_in_order(spark):
    verdicts, made = shape(spark, {1: [("system", "s"), ("user", "u"), ("assistant", "miro"), ("tool_call", CALL), ("tool_call", '{"name": "b", "arguments": "{\\"x\\": 1}"}'), ("tool_response", "r1"), ("tool_response", "r2"), ("tool_call", '{"name": "c"}'), ("tool_response", None), ("assistant", "fin")]})
    assert verdicts == {1: None}
    assert [(r.role, r.content, r.tool_call_id, r.name) for r in made] == [
        ("system", "s", None, None), ("user", "u", None, None), ("assistant", "miro", None, None), ("tool", "r1", "call_1", "ver_saldo"), ("tool", "r2", "call_2", "b"), ("assistant", "", None, None), ("tool", "", "call_3", "c"), ("assistant", "fin", None, None)]
    assert [[tuple(c) for c in r.tool_calls] for r in made if r.tool_calls] == [[("call_1", "ver_saldo", '{"cuenta":"57"}'), ("call_2", "b", '{"x":1}')], [("call_3", "c", "{}")]]


def test_broken_sequences_are_refused(spark):
    end = ("assistant", "fin")
    verdicts, made = shape(spark, {
        1: [("robot", "x"), end], 2: [(None, "x"), end], 3: [("tool_call", "no json"), ("tool_response", "r"), end], 4: [("tool_call", '{"name": "a", "arguments": [1]}'), ("tool_response", "r"), end], 5: [("tool_call", '{"arguments": {}}'), ("tool_response", "r"), end],
        6: [("tool_response", "r"), ("tool_call", CALL), end], 7: [("tool_call", CALL), end], 8: [("user", "u")], 9: [("tool_call", '{"name": "a", "arguments": "7"}'), ("tool_response", "r"), end], 10: [end],
    })
    assert verdicts == {1: "rol desconocido", 2: "rol desconocido", 3: "llamada ilegible", 4: "llamada ilegible", 5: "llamada ilegible", 6: "respuesta sin llamada", 7: "llamada sin respuesta", 8: "no acaba el asistente", 9: "llamada ilegible", 10: None}
    assert [r.conv_id for r in made] == [10]
    assert shape(spark, {}) == ({}, [])


def test_function_names(spark):
    names = ["SEC Filings", " a.b-c_d ", "__x__", "¡¿!", "é" * 3 + "z" * 80]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(dialogue.function_name(F.col("n"))).collect()]
    assert got == ["SEC_Filings", "a.b-c_d", "x", "funcion", "z" * 64]
