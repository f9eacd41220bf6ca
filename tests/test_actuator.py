"""Commands as a sink: a batch that runs twice, one that is aborted, and what the device answers."""

import json

from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.plans.signal_queries import CONFIG
from tidemark.sources import actuator, adapters
from tidemark.streaming import detect as stream


def wanted(session, index, muted=True):
    return {"session_id": session, "window_index": index, "timestamp": float(index), "want_muted": muted, "at_end": False}


def rows_of(spark, path):
    return sorted((r.session_id, r.window_index, r.want_muted, r.batch) for r in actuator.committed(spark, path).collect())


def test_batches_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "log")
    writer = actuator.ActuatorWriter(path)
    assert rows_of(spark, path) == []
    first = [writer.write(iter([wanted("a", 1), wanted("a", 1), wanted("b", 2)])), writer.write(iter([]))]
    assert rows_of(spark, path) == []  # staged is not committed
    writer.commit(first, 0)
    again = [writer.write(iter([wanted("a", 1), wanted("b", 2)]))]
    writer.commit(again, 0)
    assert rows_of(spark, path) == [("a", 1, True, 0), ("b", 2, True, 0)]
    lost = [writer.write(iter([wanted("c", 3)])), None]
    writer.abort(lost, 1)
    assert rows_of(spark, path) == [("a", 1, True, 0), ("b", 2, True, 0)]
    assert len(list((tmp_path / "log" / "staged").iterdir())) == 1
    writer.commit([writer.write(iter([wanted("c", 3, False)])), None], 1)
    writer.commit([], 2)
    assert rows_of(spark, path)[-1] == ("c", 3, False, 1)
    assert json.loads((tmp_path / "log" / "commits" / "2.json").read_text())["files"] == []


def test_stream_of_commands(spark, sf_dir, tmp_path):
    """A stream's commands are the batch's, though its last batch is written again by a query that lost its commit."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(actuator.ActuatorSink)
    config = CONFIG.with_detection(baseline_min_windows=3)
    rows = adapters.windows(spark, sf_dir).filter("session_id < 5 and window_index < 40").select("session_id", "window_index", "timestamp", *detect.READ)
    want = sorted((str(r.session_id), r.window_index, r.want_muted) for r in detect.commands(detect.decisions(rows, config)).filter("not at_end").collect())
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    path, checkpoint = str(tmp_path / "log"), tmp_path / "cp"
    for turn in range(2):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
        decided = stream.decisions(source, config, 0.0)
        query = actuator.commands(decided).writeStream.format("actuator").option("path", path).option("checkpointLocation", str(checkpoint)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        got = sorted((r.session_id, r.window_index, r.want_muted) for r in actuator.committed(spark, path).collect())
        assert want and got == want
        for name in ("0", ".0.crc"):  # the query stopped before it knew that its batch was committed
            (checkpoint / "commits" / name).unlink(missing_ok=True)


def test_what_the_device_did(spark):
    windows = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "session_id string, window_index long, timestamp double")
    answers = spark.createDataFrame([("a", 1.5, False), ("a", 3.0, True), ("b", 0.0, False)], "session_id string, at double, ok boolean")
    got = actuator.obeyed(windows, answers).orderBy("window_index").collect()
    assert [r.command_ok for r in got] == [True, True, False, True, True]
    assert actuator.obeyed(windows, answers.filter(F.lit(False))).filter("not command_ok").count() == 0
