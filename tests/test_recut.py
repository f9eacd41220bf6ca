"""Windows cut from blocks: of a file's samples in any blocks, and in a stream."""

import random
import wave

import numpy as np
import pytest

from tidemark.operators import recut
from tidemark.sources import wav

RATE = 100
SCHEMA = "session_id string, first_frame long, samples array<float>"


def blocks_of(samples, session, seed):
    rnd, out, at = random.Random(seed), [], 0
    while at < len(samples):
        n = rnd.choice([1, 7, 99, 100, 101, 250])
        out.append((session, at, [float(x) for x in samples[at : at + n]]))
        at += n
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    path = tmp_path_factory.mktemp("wav") / "a.wav"
    data = np.random.default_rng(1).integers(-9999, 9999, 1234).astype("<i2")
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(data.tobytes())
    return list(wav.windows(str(path), 1.0, 0.0)), (data / 32768).astype("float32")


@pytest.mark.parametrize("seed", range(3))
def test_windows_of_a_file_in_any_blocks(spark, recorded, seed):
    want, samples = recorded
    rows = blocks_of(samples, "s", seed) + [("s", 40, []), ("s", 50, None)]
    got = recut.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), RATE).collect()
    assert [(r.window_index, r.first_frame, r.samples, r.whole) for r in sorted(got, key=lambda r: r.window_index)] == [(i, i * RATE, x, True) for i, _, _, x in want]
    assert len(want[-1][3]) == 34


def test_lost_blocks(spark):
    one = [1.0] * 30
    rows = [("s", 0, one), ("s", 60, one), ("s", 90, one), ("s", 250, one)]
    got = {r.window_index: r for r in recut.windows(spark.createDataFrame(rows, SCHEMA), RATE).collect()}
    assert {k: (r.first_frame, len(r.samples), r.whole) for k, r in got.items()} == {0: (0, 70, False), 1: (100, 20, True), 2: (250, 30, True)}


def test_stream(spark, recorded, tmp_path):
    want, samples = recorded
    rows = sorted(blocks_of(samples, "s", 5) + blocks_of(samples, "t", 6), key=lambda r: r[1] + random.Random(r[1]).randrange(150))
    rows += [("u", 10_000, [0.0]), ("u", 20_000, [0.0])]
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = recut.stream(source, RATE, RATE, 4.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").filter("session_id <> 'u'").collect()
    assert sorted((r.session_id, r.window_index, r.samples) for r in got) == [(s, i, x) for s in "st" for i, _, _, x in want]
    assert max(held) <= 20
