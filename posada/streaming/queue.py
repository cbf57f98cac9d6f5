"""A queue of jobs with leases, as a stateful stream and as a fold over its log.

The log has a row for each thing that happens to a job: (job, ts, seq, kind, claim, worker, outcome), ts in seconds. A ``claim`` is
granted if the job waits and its time has come, or if it runs and its lease has run out; a ``result`` counts only if it comes from
the claim that holds the job, so a worker that lost its lease can't commit. What fails and may be tried again waits twice as long
each time; after ``attempts`` claims a job is dead.

Both forms give the log with ``decision`` and the job's state after it. The stream keeps one row of state for each job that isn't finished (of a
finished one only that it is), reports a lease that ran out as soon as the watermark passes it, and is exact if each job's rows come in order of (ts, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "estado string, intentos int, duenyo long, desde long, toca long"
DECIDED = "job long, ts long, seq int, kind string, claim long, decision string, estado string, intentos int"


@dataclass(frozen=True)
class Policy:
    lease: int = 600
    attempts: int = 3
    delay: int = 60


def decide(state: tuple, event: Row, policy: Policy) -> tuple[str, tuple]:
    """The decision on one row of the log, and the state after it."""
    status, tries, owner, since, due = state
    if event.kind == "claim":
        waiting = status == "pending" and due <= event.ts
        expired = status == "running" and since < event.ts - policy.lease
        if not (waiting or expired):
            return "ocupado", state
        if tries >= policy.attempts:
            return "agotado", ("dead", tries, None, None, due)
        return "recuperado" if expired else "reclamado", ("running", tries + 1, event.claim, event.ts, due)
    if status != "running" or owner != event.claim:
        return "descartado", state
    if event.outcome == "ok":
        return "hecho", ("done", tries, None, None, due)
    if event.outcome == "retry" and tries < policy.attempts:
        return "reintento", ("pending", tries, None, None, event.ts + policy.delay * 2 ** (tries - 1))
    return "muerto", ("dead", tries, None, None, due)


class _Queue(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = tuple(self.state.get()) if self.state.exists() else ("pending", 0, None, None, 0)
        for event in sorted(rows, key=lambda r: (r.ts, r.seq)):
            decision, now = decide(now, event, self.policy)
            if now[0] == "running" and now[3] == event.ts and event.kind == "claim":
                self.handle.registerTimer((event.ts + self.policy.lease + 1) * 1000)
            yield Row(job=key[0], ts=event.ts, seq=event.seq, kind=event.kind, claim=event.claim, decision=decision, estado=now[0], intentos=now[1])
        self.state.update(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A lease whose time is over is reported once; the job stays to be claimed by whoever asks next."""
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        now = tuple(self.state.get()) if self.state.exists() else None
        if now and now[0] == "running" and now[3] + self.policy.lease + 1 == at:
            yield Row(job=key[0], ts=at, seq=0, kind="lease", claim=now[2], decision="vencido", estado=now[0], intentos=now[1])

    def close(self) -> None:
        pass


def stream(log: DataFrame, policy: Policy = Policy(), lateness: str = "1 hour") -> DataFrame:
    """The decisions on a streaming log; needs the RocksDB state store. Rows that come later than ``lateness`` are dropped by the watermark."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)
    return timed.groupBy("job").transformWithState(_Queue(policy), DECIDED, "Append", "EventTime")


def _next(state: Column, e: Column, policy: Policy) -> Column:
    """``decide`` as an expression: state and decision after an event."""
    pick = lambda decision, status, tries, owner, since, due: F.struct(
        F.lit(decision).alias("decision"), status.alias("estado"), tries.cast("int").alias("intentos"), owner.cast("long").alias("duenyo"), since.cast("long").alias("desde"), due.cast("long").alias("toca"))
    status, tries, due, none = state["estado"], state["intentos"], state["toca"], F.lit(None)
    same = (status, tries, state["duenyo"], state["desde"], due)
    waiting = (status == "pending") & (due <= e["ts"])
    expired = (status == "running") & (state["desde"] < e["ts"] - policy.lease)
    owned = F.coalesce((status == "running") & (state["duenyo"] == e["claim"]), F.lit(False))
    granted = (F.lit("running"), tries + 1, e["claim"], e["ts"], due)
    later = e["ts"] + policy.delay * F.pow(F.lit(2.0), tries - 1).cast("long")
    ended = lambda status: (F.lit(status), tries, none, none, due)
    claimed = (
        F.when(~F.coalesce(waiting | expired, F.lit(False)), pick("ocupado", *same)).when(tries >= policy.attempts, pick("agotado", *ended("dead")))
        .when(F.coalesce(expired, F.lit(False)), pick("recuperado", *granted)).otherwise(pick("reclamado", *granted))
    )
    reported = (
        F.when(~owned, pick("descartado", *same)).when(F.coalesce(e["outcome"] == "ok", F.lit(False)), pick("hecho", *ended("done")))
        .when((e["outcome"] == "retry") & (tries < policy.attempts), pick("reintento", F.lit("pending"), tries, none, none, later)).otherwise(pick("muerto", *ended("dead")))
    )
    return F.when(e["kind"] == "claim", claimed).otherwise(reported)


def replay(log: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The same decisions from a whole log, without Python. A job's rows (a few for each attempt) are one array."""
    events = F.array_sort(F.collect_list(F.struct("ts", "seq", "kind", "claim", "outcome")))
    start = F.from_json(F.lit('[{"estado": "pending", "intentos": 0, "toca": 0}]'), f"array<struct<decision string, {STATE}>>")
    # every step adds the state after it, so each row's decision stands at its own place
    steps = F.aggregate("e", start, lambda made, e: F.concat(made, F.array(_next(F.element_at(made, -1), e, policy))))
    jobs = log.groupBy("job").agg(events.alias("e")).select("job", "e", steps.alias("s"))
    rows = jobs.select("job", F.explode(F.arrays_zip("e", F.slice("s", 2, F.size("e")).alias("s"))).alias("x"))
    return rows.select("job", "x.e.ts", "x.e.seq", "x.e.kind", "x.e.claim", "x.s.decision", "x.s.estado", "x.s.intentos")
