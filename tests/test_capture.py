"""Windows of landed segments: any lengths, gaps, ends; a stream that is stopped and goes on equals the batch."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import detect
from tidemark.plans.signal_queries import CONFIG
from tidemark.sources.capture import CaptureSource, CaptureStream, Landing
from tidemark.streaming import detect as stream

RATE = 200


def land(root, session, first, data):
    (root / session).mkdir(parents=True, exist_ok=True)
    with wave.open(str(root / session / f"{first:012d}-{len(data):06d}.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(np.asarray(data, "<i2").tobytes())


def segments(n, rnd, most, gaps=()):
    """(first, stop) of segments that cover n frames but for the gaps, in lengths by chance."""
    out, at = [], 0
    while at < n:
        if gap := next((g for g in gaps if g[0] <= at < g[1]), None):
            at = gap[1]
            continue
        stop = min([n, at + rnd.randrange(1, most), *(g[0] for g in gaps if g[0] > at)])
        out.append((at, stop))
        at = stop
    return out


def brute(data, size, gaps, ended=True):
    """(window, samples, restarted) by the rules, frame by frame."""
    n = len(data)
    have = np.ones(n + 1, bool)
    for a, b in gaps:
        have[a:b] = False
    have[n] = False
    out = []
    for k in range(-(-n // size) if ended else n // size):
        own = [f for f in range(k * size, min((k + 1) * size, n)) if have[f]]
        stop = min((k + 1) * size, n)
        if not own or own[-1] != stop - 1:
            continue  # nothing, or torn
        first = own[-1]
        while first > k * size and have[first - 1]:
            first -= 1
        out.append((k, data[first:stop].tolist(), first == 0 or not have[first - 1]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_whatever_the_segments(seed, tmp_path):
    rnd = random.Random(seed)
    n = rnd.randrange(900, 4000)
    data = np.random.default_rng(seed).integers(-3000, 3000, n)
    gaps = sorted({(a, a + rnd.choice([1, 30, 200, 450])) for a in (rnd.randrange(n) for _ in range(seed))})
    gaps = [g for i, g in enumerate(gaps) if not i or g[0] > gaps[i - 1][1]]
    gaps = [(a, b) for a, b in gaps if b < n]
    for a, b in segments(n, rnd, 700, gaps):
        land(tmp_path, "s", a, data[a:b])
    for per_task in (1, 3, 120):
        landing = Landing(str(tmp_path), RATE, windows_per_task=per_task)
        for ended in (False, True):
            rows = [r for p in landing.parts({}, {"s": [n, ended]}) for r in landing.read(p)]
            want = brute(data, RATE, gaps, ended)
            assert [(r[1], r[5]) for r in rows] == [(k, x) for k, _, x in want]
            for r, (k, samples, _) in zip(rows, want):
                assert r[2] == k and np.allclose(np.array(r[4]) * 32768, samples)
        # In steps of any offsets the same windows come, each once.
        marks = sorted(rnd.sample(range(n), 5))
        steps = [{}, *({"s": [m, False]} for m in marks), {"s": [n, False]}, {"s": [n, True]}]
        whole = [r for p in landing.parts({}, {"s": [n, True]}) for r in landing.read(p)]
        assert [r for a, b in zip(steps, steps[1:]) for p in landing.parts(a, b) for r in landing.read(p)] == whole


def test_offsets_and_retries(tmp_path):
    landing = Landing(str(tmp_path / "later"), RATE, retries=3, retry_initial_seconds=1, retry_max_seconds=3)
    assert landing.landed() == {} and landing.parts({}, {"gone": [500, True]}) == []
    reader = CaptureStream(landing)
    land(tmp_path / "later", "b", 0, np.ones(150))
    land(tmp_path / "later", "a", 100, np.ones(10))
    (tmp_path / "later" / "a" / "end").write_text("")
    (tmp_path / "later" / "a" / "notes.txt").write_text("no segment")
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": [110, True], "b": [150, False]}
    assert [(p.session_id, p.start, p.stop) for p in reader.partitions({}, reader.latestOffset())] == [("a", 0, 1)]
    waits = []

    class Away(Landing):
        def _listed(self):
            if len(waits) < 3:
                raise OSError("away")
            return super()._listed()

    assert Away(landing.path, RATE, retry_max_seconds=3).listed(waits.append).keys() == {"a", "b"} and waits == [1, 2, 3]
    waits.clear()
    with pytest.raises(OSError):
        Away(landing.path, RATE, retries=0).listed(waits.append)
    with pytest.raises(ValueError, match="sampleRate"):
        Landing.of({"path": "x"})
    land(tmp_path / "later", "b", 150, np.ones(60))
    (tmp_path / "later" / "b" / "000000000150-000060.wav").rename(tmp_path / "later" / "b" / "000000000150-000070.wav")
    with pytest.raises(ValueError, match="as many frames"):
        list(landing.read(landing.parts({}, {"b": [220, False]})[0]))


def sound(seconds, rnd):
    """Content, then gaps with louder stretches after them."""
    rng, parts = np.random.default_rng(rnd.randrange(99)), []
    for k in range(seconds):
        loud = 9000 if k % 20 >= 12 else 1500
        parts.append(rng.integers(-loud, loud, RATE))
        if k % 20 in (11, 19):
            parts[-1][RATE // 2 :] = 0
    return np.concatenate(parts)


def test_a_stream_that_is_stopped_goes_on_as_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(CaptureSource)
    root, rnd = tmp_path / "landed", random.Random(5)
    config = CONFIG.with_detection(baseline_min_windows=4, ad_crest_delta_db=-99.0)
    audio = {"one": sound(70, rnd), "two": sound(55, rnd)}
    gaps = {"one": [(8030, 9100)], "two": []}
    due = {s: segments(len(x), rnd, 900, gaps[s]) for s, x in audio.items()}
    options = {"path": str(root), "sampleRate": str(RATE), "windowsPerTask": "16"}

    def windows(rows):
        measured = kernels.window_features(rows, "sample_rate", -60.0, 0.05, ("session_id", "window_index", "timestamp", "stream_restarted"))
        return measured.select("session_id", "window_index", "timestamp", "stream_restarted", *detect.READ)

    def go_on():
        rows = windows(spark.readStream.format("capture").options(**options).load())
        out = stream.decisions(rows, config, 2.0)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        return query

    root.mkdir()
    for turn in range(3):
        for session, own in due.items():
            for a, b in own[turn * len(own) // 3 : (turn + 1) * len(own) // 3]:
                land(root, session, a, audio[session][a:b])
            if turn == 2:
                land(root, session, len(audio[session]), np.zeros(5 * RATE))  # lets what waits go
        query = go_on()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    batch = windows(spark.read.format("capture").options(**options).load())
    starts = batch.filter("stream_restarted").groupBy("session_id").agg(F.sort_array(F.collect_list("window_index")).alias("at"))
    assert {r.session_id: r["at"] for r in starts.collect()} == {"one": [0, 45], "two": [0]}
    names = ["session_id", "window_index", "event", "ad_profile", "state", "muted", "baseline_count"]
    last = {s: len(x) // RATE for s, x in audio.items()}
    want = [tuple(r) for r in detect.decisions(batch, config).select(*names).collect() if r.window_index < last[r.session_id]]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("not late").select(*names).collect() if r.window_index < last[r.session_id]]
    assert sorted(got) == sorted(want) and {"AD_STARTED", "AD_ENDED"} <= {r[2] for r in got}
    assert {r[0] for r in got} == {"one", "two"} and any(r[5] for r in got)
