"""Streams driven batch by batch."""

from contextlib import contextmanager
from datetime import datetime, timedelta

from asofkit.streaming import streams

T0 = datetime(2024, 1, 1)
RUNS = "source string, started_at timestamp, status string"


@contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drive(spark, tmp_path, batches, limit=3600):
    """Alarms after each batch, the batches' files taken one by one."""
    out = []
    with rocksdb(spark):
        for rows in batches:
            spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            s = streams.stale_sources_stream(spark.readStream.schema(RUNS).parquet(str(tmp_path / "in")), "1 minute", limit)
            q = (s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "q"))
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            got = spark.read.schema("source string, last_success timestamp, stale_at timestamp").parquet(str(tmp_path / "out"))
            out.append({(r.source, None if r.last_success is None else int((r.last_success - T0).total_seconds() / 60), int((r.stale_at - T0).total_seconds() / 60)) for r in got.collect()})
    return out


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_failures_move_the_clock(spark, tmp_path):
    """The newest row is a failure; the successes alone would not reach the limit."""
    got = drive(spark, tmp_path, [[("a", at(0), "SUCCESS"), ("b", at(30), "SUCCESS"), ("b", at(70), "FAILED"), (None, None, "SUCCESS")]])
    assert got == [{("a", 0, 60)}]


def test_never_successful_and_rearmed(spark, tmp_path):
    got = drive(spark, tmp_path, [
        [("never", at(0), "FAILED"), ("never", at(50), "FAILED"), ("late", at(5), "SUCCESS"), ("x", at(62), "SUCCESS")],
        [("late", at(64), "SUCCESS"), ("x", at(100), "PARTIAL_FAILED")],  # in time: its alarm at 65 must not come
        [("x", at(150), "FAILED")]])
    assert got[0] == {("never", None, 60)}
    assert got[1] == got[0]
    assert got[2] == got[0] | {("late", 64, 124), ("x", 62, 122)}


def test_dead_letters_are_kept_and_recovered(spark, tmp_path):
    schema, out = "k int, at timestamp", str(tmp_path / "t")
    store = streams.with_dead_letters(out, "at", 600)
    batches = [[(1, at(0)), (2, at(60))], [(3, at(49)), (4, at(50)), (5, None)], [], [(6, at(40)), (7, at(200))], [(8, at(100))]]
    for i, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            store(spark.createDataFrame(rows, schema), i)
    late = {r.k: (r.batch, r.behind) for r in spark.read.schema("k int, behind timestamp, batch int").parquet(f"{out}/late").collect()}
    assert late == {3: (1, at(50)), 6: (3, at(50)), 8: (4, at(190))}
    kept = {r.k for r in spark.read.parquet(f"{out}/rows").collect()}
    assert kept | set(late) == set(range(1, 9)) and not kept & set(late)
