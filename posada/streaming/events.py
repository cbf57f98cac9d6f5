"""Structured Streaming forms of the queue, replay and audit operators (survey T01-T06), and window extensions over events.

Each function takes and returns a DataFrame, streaming or not; the caller starts the query and names
its checkpoint. Watermarks bound what state is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_replays(events: DataFrame, key: str = "id", ts: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """Of events with one id within the time to live, the first."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def in_signature_window(events: DataFrame, signed_at: str, received_at: str, seconds: int = 300) -> DataFrame:
    """Events whose signature is no older or newer than ``seconds``."""
    gap = F.abs(F.unix_timestamp(received_at) - F.unix_timestamp(signed_at))
    return events.where(gap <= seconds)


def drop_repeated_uploads(files: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Uploads whose (entity, digest) is new; of equal ones in a batch one stays."""
    return files.dropDuplicates(list(keys)).join(known.select(*keys), list(keys), "left_anti")


def current_state(log: DataFrame, key: str, state: str, ts: str, sequence: str) -> DataFrame:
    """Each key's last state from an append-only log; on a stream, in update or complete mode."""
    return log.groupBy(key).agg(F.max(F.struct(ts, sequence, state))[state].alias(state), F.count("*").alias("cambios"))


def idempotent_append(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer. A batch that is run again overwrites its own folder, so results are committed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def split_failed(results: DataFrame, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows to try again, with the seconds to wait (60, doubled each time), and dead letters."""
    failed = results.where("error IS NOT NULL")
    again = failed.where(F.col("intento") < attempts).withColumn("espera_s", (60 * F.pow(F.lit(2.0), F.col("intento") - 1)).cast("long"))
    return again, failed.where(F.col("intento") >= attempts)


def backoff_seconds(attempt: Column, draw: Column, asked: Column, base: float, most: float) -> Column:
    """what to wait before an attempt: what the service asked for, else ``base`` doubled each time and spread by ``draw`` (0 to 1); never more than ``most``."""
    spread = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt)) * (F.lit(0.5) + draw / 2)
    return F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(0.0)), F.lit(most))).otherwise(spread)


def realised(rows: DataFrame, date: str, today: str) -> DataFrame:
    """Whether a date has come, "today" being a parameter."""
    return rows.withColumn("realizado", F.col(date) <= F.lit(today).cast("date"))


# ------------------------------------------------------------------ extensions, without a counterpart among the survey's operators


def tumbling(events: DataFrame, size: str, by: str, lateness: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("inicio"), by, "n", "total")


def sliding(events: DataFrame, size: str, step: str, by: str, lateness: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("inicio"), by, "n")


def sessions(events: DataFrame, gap: str, by: str, lateness: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("inicio"), by, "n")
