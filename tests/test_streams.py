"""Sessions as streams: timers, cancels, and a source whose offsets are the cursor."""

import random

import pandas as pd
import pytest

from atomloom.streaming import progress, sessions

EVENTS = "session_id string, event_index long, status string, ts timestamp"
CONTROL = "session_id string, ts timestamp"
START = pd.Timestamp("2024-01-01")


def at(minutes):
    return (START + pd.Timedelta(minutes=minutes)).to_pydatetime()


def machine(spark, tmp_path, batches, control, name):
    """Run the machine over one file a trigger; its rows in the order they came."""
    pytest.importorskip("google.protobuf")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(control, CONTROL).coalesce(1).write.parquet(str(tmp_path / "control"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = sessions.watched(progress.read(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema, 1), progress.read(spark, str(tmp_path / "control"), spark.createDataFrame([], CONTROL).schema, 1))
        q = live.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name).collect()


def test_a_stalled_session_goes_to_error_by_its_timer(spark, tmp_path):
    batches = [
        [("stalls", 0, "planning", at(0)), ("works", 0, "planning", at(0)), ("cancelled", 0, "planning", at(0))],
        [("works", 1, "researching", at(8)), ("cancelled", 1, "researching", at(8))],
        [("works", 2, "synthesizing", at(15)), ("other", 0, "planning", at(15))],
        [("works", 3, "complete", at(20)), ("other", 1, "researching", at(24))],
        [("other", 2, "synthesizing", at(31)), ("works", 4, "planning", at(21))],
        [("other", 3, "complete", at(40))],
    ]
    control = [("cancelled", at(6))]
    rows = machine(spark, tmp_path, batches, control, "watched")
    last = {}
    for r in rows:
        if r.session_id not in last or (r.moves + r.refused, r.at) >= (last[r.session_id].moves + last[r.session_id].refused, last[r.session_id].at):
            last[r.session_id] = r
    assert (last["stalls"].status, last["stalls"].reason, last["stalls"].at) == ("error", "stalled", at(10))
    assert last["works"].status == "complete" and last["works"].refused == 1
    assert last["cancelled"].status == "cancelled" and last["other"].status == "complete"
    batch = sessions.closed(spark.createDataFrame([r for b in batches for r in b], EVENTS), spark.createDataFrame(control, CONTROL), until="2024-01-01 00:40:00").collect()
    assert {(r.session_id, r.status, r.moves, r.refused) for r in batch} == {(r.session_id, r.status, r.moves, r.refused) for r in last.values()}


def test_batch_machine_is_going_through_the_rows(spark):
    rng = random.Random(3)
    names = list(progress.NEXT_STATES)
    rows = [(f"s{k % 9}", k, rng.choice(names), at(k * rng.choice([1, 1, 1, 3]) / 4)) for k in range(300)]
    got = {r.session_id: (r.status, r.moves, r.refused) for r in sessions.closed(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([], CONTROL), until="2030-01-01", stall="7 minutes").collect()}
    for key in {r[0] for r in rows}:
        status, moves, refused, last = "idle", 0, 0, None
        for _, _, wanted, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1])):
            if last and ts > last + pd.Timedelta("7 minutes") and progress.NEXT_STATES[status]:
                status = "error"
            if not progress.NEXT_STATES[status]:
                refused += wanted != status
                continue
            if wanted in progress.NEXT_STATES[status]:
                status, moves = wanted, moves + 1
            else:
                refused += wanted != status
            last = ts
        assert got[key] == (status if not progress.NEXT_STATES[status] else "error", moves, refused)


def test_following_a_session_goes_on_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(sessions.FollowSession)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(log)

    def follow():
        source = spark.readStream.format("follow_session").option("path", log).option("session", "a").option("sliceEvents", "3").load()
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.event_index for r in spark.read.schema(EVENTS).parquet(out).collect())

    add([("b", 0, "planning", at(0))])
    assert follow() == []
    add([("a", k, "researching", at(k)) for k in range(10)] + [("b", 1, "complete", at(1))])
    assert follow() == list(range(10))
    assert follow() == list(range(10))
    add([("a", 11, "synthesizing", at(11)), ("a", 10, "researching", at(10))])
    add([("a", 12, "complete", at(12)), ("a", 13, "researching", at(13))])
    assert follow() == list(range(13))
    add([("a", 14, "complete", at(14))])
    assert follow() == list(range(13))
    started = spark.readStream.format("follow_session").option("path", log).option("session", "a").option("cursor", "8").load()
    q = started.writeStream.format("memory").queryName("from_cursor").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_index for r in spark.table("from_cursor").collect()) == [9, 10, 11, 12]
