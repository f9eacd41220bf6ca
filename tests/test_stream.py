"""The stream's decisions are the batch's, however its rows are cut and shuffled."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.plans.signal_queries import CONFIG
from tidemark.sources import adapters
from tidemark.streaming import detect as stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = adapters.windows(spark, sf_dir).filter("session_id < 4 and window_index < 40").select("session_id", "window_index", "timestamp", *detect.READ)
    batch = detect.decisions(rows, CONFIG)
    local = rows.toPandas()
    rnd = random.Random(9)
    groups = [[], [], []]
    for i, w in local.iterrows():
        groups[min(2, int(w.window_index) // 14)].append(i)
    for k, own in enumerate(groups):
        rnd.shuffle(own)
        spark.createDataFrame(local.loc[own], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    flush = local.groupby("session_id").first().reset_index()
    flush["window_index"], flush["timestamp"] = 10_000, 10_000.0
    spark.createDataFrame(flush[local.columns], rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b3")
    late = local[local.window_index == 3]
    spark.createDataFrame(late, rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b4")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream.decisions(source, CONFIG, 10.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(f"{tmp_path}/out")
    names = ["session_id", "window_index", "event", "ad_profile", "state", "muted", "baseline_count"]
    assert sorted(map(tuple, out.filter("not late").select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))
    assert out.filter("late").select(F.count_distinct("session_id")).first()[0] == late.session_id.nunique()


def test_idle_sessions_end(spark, sf_dir, tmp_path):
    """Without a flush row: the tail is stepped after the idle time, mutes are taken back, commands are the batch's."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    config = CONFIG.with_detection(baseline_min_windows=3)
    rows = adapters.windows(spark, sf_dir).filter("session_id < 3 and window_index < 30").select("session_id", "window_index", "timestamp", *detect.READ)
    batch = detect.decisions(rows, config)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    query = stream.write_commands(stream.decisions(source, config, 10.0, 3.0), f"{tmp_path}/commands", f"{tmp_path}/cp")
    names = ["session_id", "window_index", "want_muted", "at_end"]
    want = sorted(map(tuple, detect.commands(batch).select(*names).collect()))
    try:
        until, got = time.time() + 90, []
        while got != want and time.time() < until:
            time.sleep(1)
            parts = list(tmp_path.glob("commands/batch=*/*.parquet"))
            got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/commands").select(*names).collect())) if parts else []
    finally:
        query.stop()
    assert want and got == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = ["session_id", "window_index", "event", "ad_profile", "state", "muted", "baseline_count"]


def sources(spark, sf_dir, sessions, windows):
    rows = adapters.windows(spark, sf_dir).filter(F.col("session_id").isin(sessions) & (F.col("window_index") < windows))
    return rows.select("session_id", "window_index", "timestamp", F.timestamp_millis((F.col("timestamp") * 1000).cast("long") + 86_400_000).alias("at"), *detect.READ)


def test_event_time(spark, sf_dir, tmp_path):
    """Three sources that interleave and are late by up to the delay: each window is stepped once, as in the batch; sessions end, state goes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    config = CONFIG.with_detection(baseline_min_windows=3)
    rows = sources(spark, sf_dir, [0, 1, 2], 45)
    batch, local, rnd = detect.decisions(rows, config), rows.toPandas(), random.Random(3)
    # Rows come when they are due, in a time of their own: up to 8 s late, so in any order.
    local["due"] = local.window_index + [rnd.uniform(0, 8) for _ in range(len(local))]
    local = local.sort_values("due")
    for k, part in enumerate(range(0, len(local), 17)):
        spark.createDataFrame(local.iloc[part : part + 17].drop(columns="due"), rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    other = local[local.session_id == 0].drop(columns="due").head(1)
    for k, later in enumerate((60, 200, 400, 600)):  # another session's rows are all that moves the watermark on
        moved = other.assign(session_id=99, window_index=later, timestamp=float(later), at=other["at"].iloc[0] + pd.Timedelta(seconds=later))
        spark.createDataFrame(moved, rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/c{k}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stream.decisions(source, config, 10.0, 30.0, event_time="at", tombstone_seconds=60.0)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").filter("session_id < 99")
    stepped = got.filter("not late and not (at_end and event is null)")
    assert sorted(map(tuple, stepped.select(*NAMES).collect())) == sorted(map(tuple, batch.select(*NAMES).collect()))
    assert got.filter("late").count() == 0 and stepped.count() == stepped.select("session_id", "window_index").distinct().count() == len(local)
    last = {r.session_id: r.muted for r in batch.filter("window_index = 44").collect()}
    assert {r.session_id for r in got.filter("at_end").collect()} == {s for s, m in last.items() if m}
    assert held[-1] < max(held) < 250  # what waits is bounded by the delay, and ended sessions leave


def test_state_gets_a_column(spark, sf_dir, tmp_path):
    """A query is stopped, its state gets one more column, and it goes on from its checkpoint with the same decisions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")
    config = CONFIG.with_detection(baseline_min_windows=3)
    rows = sources(spark, sf_dir, [3, 4], 40).drop("at")
    batch = detect.decisions(rows, config)
    try:
        for k, state in enumerate((stream.STATE, stream.STATE + ", note string")):
            rows.filter(f"window_index >= {20 * k} and window_index < {20 * k + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
            source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
            query = stream.decisions(source, config, 0.0, state=state).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.encodingFormat")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select(*NAMES).collect())) == sorted(map(tuple, batch.select(*NAMES).collect()))
