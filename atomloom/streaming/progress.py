"""Progress events as streams: running state of a session, windows, deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The states of a research session and where each may lead.
NEXT_STATES = {
    "idle": {"planning", "error", "cancelled"},
    "planning": {"researching", "error", "cancelled"},
    "researching": {"synthesizing", "error", "cancelled"},
    "synthesizing": {"complete", "error", "cancelled"},
    "complete": set(),
    "cancelled": set(),
    "error": set(),
}


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the event files in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def latest(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id") -> DataFrame:
    """Each session's latest event and counters; the same over a stream (update or complete mode) and over a table."""
    last = F.max_by(F.struct("event_type", "value", at), F.struct(at, order))
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), last.alias("last")).select(key, "n_events", F.col("last.event_type").alias("event_type"), F.col("last.value").alias("value"), F.col(f"last.{at}").alias("at"))


def counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, event_type, n): each session's events by type; the same over a stream and over a table."""
    return events.groupBy(key, "event_type").agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, width: str, at: str = "ts", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, at: str = "ts", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.window(at, width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", at: str = "ts", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def after_cursor(events: DataFrame, cursor: int, index: str = "event_index") -> DataFrame:
    """Events that a client has yet to see."""
    return events.where(F.col(index) > cursor)


class SessionMachine(StatefulProcessor):
    """A session's state over its events (session_id, event_index, status): moves that aren't allowed are refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, moves int, refused int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        status, moves, refused = self.state.get() if self.state.exists() else ("idle", 0, 0)
        every = pd.concat(list(rows)).sort_values("event_index")
        for wanted in every["status"]:
            if wanted in NEXT_STATES.get(status, set()):
                status, moves = wanted, moves + 1
            elif wanted != status:
                refused += 1
        self.state.update((status, int(moves), int(refused)))
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "moves": [int(moves)], "refused": [int(refused)]})

    def close(self) -> None:
        pass


def run_machine(events: DataFrame) -> DataFrame:
    """The state machine over a stream; needs the RocksDB state store."""
    return events.groupBy("session_id").transformWithStateInPandas(SessionMachine(), "session_id string, status string, moves int, refused int", "Update", "None")


def known_status(live: DataFrame, stored: DataFrame, key: str = "session_id") -> DataFrame:
    """A session's live status, else the stored one."""
    rows = live.select(key, F.col("status").alias("a")).join(stored.select(key, F.col("status").alias("b")), key, "full_outer")
    return rows.select(key, F.coalesce("a", "b").alias("status"))


def without_cancelled(events: DataFrame, cancelled: DataFrame, key: str = "session_id") -> DataFrame:
    """Events of sessions that no control row cancels; ``cancelled`` is a table, ``events`` a stream or a table."""
    return events.join(cancelled.select(key).distinct(), key, "left_anti")
