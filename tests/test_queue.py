"""The queue of jobs: leases, late results, retries, and the stream against the fold over the log."""

from pyspark.sql import functions as F

from posada.streaming import queue

LOG = "job long, ts long, seq int, kind string, claim long, worker string, outcome string"
POLICY = queue.Policy(lease=600, attempts=3, delay=60)


def log_rows():
    rows = [
        # 1: worker a loses its lease, b takes the job, a's late result is discarded, b's counts
        (1, 1000, 0, "claim", 1, "a", None), (1, 1300, 0, "claim", 2, "b", None), (1, 1601, 0, "claim", 3, "b", None), (1, 1700, 0, "result", 1, "a", "ok"), (1, 1800, 0, "result", 3, "b", "ok"), (1, 1900, 0, "claim", 4, "a", None),
        # 2: fails, waits 60 s, then 120 s, then is dead
        (2, 1000, 0, "claim", 1, "a", None), (2, 1010, 0, "result", 1, "a", "retry"), (2, 1069, 0, "claim", 2, "a", None), (2, 1070, 0, "claim", 3, "a", None), (2, 1080, 0, "result", 3, "a", "retry"),
        (2, 1200, 0, "claim", 4, "a", None), (2, 1210, 0, "result", 4, "a", "retry"), (2, 1300, 0, "claim", 5, "a", None),
        # 3: lost three times, so never claimed again; 4: a fatal error; 5: a result without a claim
        *((3, 1000 + 601 * k, 0, "claim", k, "a", None) for k in range(4)), (4, 1000, 0, "claim", 1, "a", None), (4, 1000, 1, "result", 1, "a", "fatal"), (5, 1000, 0, "result", 1, "a", "ok"), (5, 1001, 0, "result", None, None, None),
        # 6: a worker that never comes back
        (6, 1000, 0, "claim", 1, "a", None),
    ]
    return rows


def decisions(rows, job):
    return [r.decision for r in sorted(rows, key=lambda r: (r.ts, r.seq)) if r.job == job]


def test_replay(spark):
    got = queue.replay(spark.createDataFrame(log_rows(), LOG).repartition(3), POLICY).collect()
    assert decisions(got, 1) == ["reclamado", "ocupado", "recuperado", "descartado", "hecho", "ocupado"]
    assert decisions(got, 2) == ["reclamado", "reintento", "ocupado", "reclamado", "reintento", "reclamado", "muerto", "ocupado"]
    assert decisions(got, 3) == ["reclamado", "recuperado", "recuperado", "agotado"] and decisions(got, 4) == ["reclamado", "muerto"] and decisions(got, 5) == ["descartado"] * 2
    assert queue.replay(spark.createDataFrame([], LOG), POLICY).collect() == []


def test_stream_decides_as_the_fold(spark, tmp_path):
    """The log arrives in three files; leases that run out are reported by timers."""
    rows = log_rows()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cuts = [(0, 1100), (1100, 1750), (1750, 10**9)]
    for k, (a, b) in enumerate(cuts):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "log"))
    query = queue.stream(source, POLICY, "0 seconds").writeStream.format("memory").queryName("queue_test").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.table("queue_test").collect()
    columns = ["job", "ts", "seq", "kind", "claim", "decision", "estado", "intentos"]
    want = queue.replay(spark.createDataFrame(rows, LOG), POLICY).select(columns).collect()
    plain = lambda rs: sorted((tuple(r[c] for c in columns) for r in rs), key=repr)
    assert plain(r for r in got if r.decision != "vencido") == plain(want)
    assert {(r.job, r.ts) for r in got if r.decision == "vencido"} == {(6, 1601)} and all(r.kind == "lease" for r in got if r.decision == "vencido")
    last = {r.job: r.estado for r in sorted(got, key=lambda r: (r.ts, r.seq)) if r.decision != "vencido"}
    assert last == {1: "done", 2: "dead", 3: "dead", 4: "dead", 5: "pending", 6: "running"}


def test_whole_log_against_python(spark):
    rows = [(j, (j * 37 + k * 211) % 3000, k, ("claim", "result")[k % 2], k // 2, "w", ("ok", "retry", "fatal", "retry")[(j + k) % 4]) for j in range(60) for k in range(12)]
    got = queue.replay(spark.createDataFrame(rows, LOG), POLICY).collect()
    for j in range(60):
        state, want = ("pending", 0, None, None, 0), []
        for r in sorted(spark.createDataFrame([x for x in rows if x[0] == j], LOG).collect() if j < 3 else [], key=lambda r: (r.ts, r.seq)):
            decision, state = queue.decide(state, r, POLICY)
            want.append(decision)
        assert j >= 3 or decisions(got, j) == want
    assert len(got) == len(rows) and got[0].asDict().keys() == {"job", "ts", "seq", "kind", "claim", "decision", "estado", "intentos"} and F is not None


def test_tied_results_in_one_order(spark, tmp_path):
    """Results of one time and line number count in order of outcome, whatever order they are read in: as the SQL has it once its order is total."""
    import datetime

    import duckdb

    from posada.plans import driver_queries

    day = lambda k: datetime.datetime(1995, 1, k)
    rows = [(o, 1, 2 + k, float(9 - k), "NRAR"[(o + k) % 4], day(1 + k)) for o in range(40) for k in range(3)] + [(o, 2, 5, 3.0, "ANR"[o % 3], day(20)) for o in range(0, 40, 2)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp")
    for name, order in (("there", "l_suppkey"), ("back", "-l_suppkey")):
        lines.orderBy(F.expr(order)).coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/there/lineitem.parquet/*.parquet'")
    for name in ("t01_queue_decisions", "t02_committed_results"):
        sql, query = driver_queries.oracle_sql()[name], driver_queries.queries()[name]
        total = sql.replace("ORDER BY ts, seq)", "ORDER BY ts, seq, outcome)")
        assert total != sql
        found = duck.execute(total)
        columns = [d[0] for d in found.description]
        want = sorted(found.fetchall(), key=repr)
        for place in ("there", "back"):
            assert sorted((tuple(r[c] for c in columns) for r in query(spark, str(tmp_path / place)).collect()), key=repr) == want
