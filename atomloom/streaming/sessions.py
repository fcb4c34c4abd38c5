"""Running research sessions as streams: a state machine with timers, live cancellation, and a source that follows one session."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from atomloom.streaming.progress import NEXT_STATES

FINAL = {s for s, after in NEXT_STATES.items() if not after}
STATUS = "session_id string, status string, moves int, refused int, reason string, at timestamp"
STALLED = "stalled"


def advance(state: tuple, rows: list[tuple], stall_ms: int) -> tuple:
    """(status, moves, refused, last) after rows (ms, index, status), in order of time; a longer silence than ``stall_ms`` is an error."""
    status, moves, refused, last = state
    for at, _, wanted in sorted(rows, key=lambda r: (r[0], r[1])):
        if last and at > last + stall_ms and status not in FINAL:
            status, last = "error", last + stall_ms
        if status in FINAL:
            refused += wanted != status
            continue
        if wanted in NEXT_STATES.get(status, set()):
            status, moves = wanted, moves + 1
        elif wanted != status:
            refused += 1
        last = max(last, at)
    return status, int(moves), int(refused), int(last)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    return list(zip(frame["ms"].astype("int64"), frame["event_index"].astype("int64"), frame["status"], strict=True))


class WatchedSession(StatefulProcessor):
    """A session's state over its events and the control rows that cancel it.

    An event-time timer waits for the next event: when the watermark passes it, the session goes to ``error``. When a
    session has ended, another timer waits ``keep_ms`` for rows that come late, then its state is dropped.
    """

    def __init__(self, stall_ms: int, keep_ms: int):
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, moves int, refused int, last long")

    def _wait(self, status: str, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + (self.keep_ms if status in FINAL else self.stall_ms))

    def _row(self, key, state: tuple, reason: str) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "status": [state[0]], "moves": [state[1]], "refused": [state[2]], "reason": [reason], "at": [pd.Timestamp(state[3], unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else ("idle", 0, 0, 0)
        after = advance(before, [r for frame in rows for r in rows_of(frame)], self.stall_ms)
        self.state.update(after)
        self._wait(after[0], after[3])
        yield self._row(key, after, "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, moves, refused, last = tuple(self.state.get())
        if status in FINAL:
            self.state.clear()
            return
        after = ("error", moves, refused, last + self.stall_ms)
        self.state.update(after)
        self._wait("error", after[3])
        yield self._row(key, after, STALLED)

    def close(self) -> None:
        pass


def controlled(events: DataFrame, control: DataFrame) -> DataFrame:
    """Events (session_id, event_index, status, ts) and control rows (session_id, ts), which cancel, as one stream or table."""
    cancels = control.select("session_id", F.lit(2**62).alias("event_index"), F.lit("cancelled").alias("status"), "ts")
    return events.select("session_id", F.col("event_index").cast("long").alias("event_index"), "status", "ts").unionByName(cancels)


def watched(events: DataFrame, control: DataFrame, stall: str = "10 minutes", late: str = "1 minute", keep: str = "1 hour") -> DataFrame:
    """Each session's state as events, cancels and silence change it; a stream over the RocksDB state store, in update mode."""
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = controlled(events, control).withWatermark("ts", late).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.groupBy("session_id").transformWithStateInPandas(WatchedSession(ms(stall), ms(keep)), STATUS, "Update", "EventTime")


def closed(events: DataFrame, control: DataFrame, until: str, stall: str = "10 minutes") -> DataFrame:
    """The same over tables: where each session stands at ``until``. A session's events go through one task."""
    stall_ms, end = int(pd.Timedelta(stall).total_seconds() * 1000), int(pd.Timestamp(until).timestamp() * 1000)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state = advance(("idle", 0, 0, 0), rows_of(frame), stall_ms)
        reason = "event"
        if state[0] not in FINAL and end > state[3] + stall_ms:
            state, reason = ("error", *state[1:3], state[3] + stall_ms), STALLED
        return pd.DataFrame({"session_id": [key[0]], "status": [state[0]], "moves": [state[1]], "refused": [state[2]], "reason": [reason], "at": [pd.Timestamp(state[3], unit="ms")]})

    rows = controlled(events, control).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.groupBy("session_id").applyInPandas(run, STATUS)


class Slice(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class FollowReader(DataSourceStreamReader):
    """Offsets are the client's cursor: the index of the last event it has. They don't pass a session's first final status."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.session = schema.fieldNames(), options["path"], options["session"]
        self.slice, self.start = int(options.get("sliceevents", 1000)), int(options.get("cursor", -1))

    def _held(self, columns: list[str], low: int, high: int | None = None) -> list[dict]:
        """The session's events behind ``low``, by index; the scan is told which rows and columns."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return []
        wanted = (ds.field("session_id") == self.session) & (ds.field("event_index") > low)
        held = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=columns, filter=wanted if high is None else wanted & (ds.field("event_index") <= high))
        return sorted(held.to_pylist(), key=lambda r: r["event_index"])

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def latestOffset(self) -> dict:
        # by the logs alone, so that a query that starts again sees what the one before saw
        held = self._held(["event_index", "status"], -1)
        ends = [r["event_index"] for r in held if r["status"] in FINAL] or [r["event_index"] for r in held[-1:]]
        return {"cursor": max(self.start, *ends[:1], -1)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(low, min(low + self.slice, end["cursor"])) for low in range(start["cursor"], end["cursor"], self.slice)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for row in self._held(self.names, partition.low, partition.high):
            # files may hold times finer than a stream's, without a zone
            yield tuple(v.to_pydatetime().replace(tzinfo=v.tzinfo or timezone.utc) if isinstance(v, pd.Timestamp) else v for v in (row[n] for n in self.names))


class FollowSession(DataSource):
    """``spark.readStream.format("follow_session")``: the events of one session out of a folder of parquet logs, in order.

    Options: ``path`` (in a file system that pyarrow opens), ``session``, ``cursor`` (the last event the client has),
    ``sliceEvents`` a task. Columns: session_id, event_index, status and others that are asked for.
    A query goes on from its checkpoint; events behind a final status are not delivered.
    """

    @classmethod
    def name(cls) -> str:
        return "follow_session"

    def schema(self) -> str:
        return "session_id string, event_index bigint, status string, ts timestamp"

    def streamReader(self, schema: StructType) -> FollowReader:
        return FollowReader(schema, self.options)
