import wave

import numpy as np
import pytest

from tidemark.config import Detection
from tidemark.operators import dataset, intervals
from tidemark.sources import files
from tidemark.sources.wav import WavSource


def save(path, samples, rate=1000, channels=2, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, f"<i{width}").tobytes())


def test_wav_windows(spark, tmp_path):
    data = np.random.default_rng(3).integers(-32768, 32767, (3500, 2))
    save(tmp_path / "b.wav", data)
    save(tmp_path / "a.wav", data[:1000])
    spark.dataSource.register(WavSource)
    rows = spark.read.format("wav_windows").option("path", str(tmp_path)).option("bytesPerTask", "6000").load().collect()
    own = sorted((r for r in rows if r.path.endswith("b.wav")), key=lambda r: r.window_index)
    assert [(r.window_index, r.timestamp, len(r.samples), r.stream_restarted) for r in own] == [(0, 0.0, 1000, True), (1, 1.0, 1000, False), (2, 2.0, 1000, False), (3, 3.0, 500, False)]
    assert np.concatenate([r.samples for r in own]) == pytest.approx(data.mean(axis=1) / 32768, abs=1e-6)
    assert len(rows) == 5 and {(r.chunk, r.session_id) for r in rows} == {("a", tmp_path.name), ("b", tmp_path.name)}
    by_uri = spark.read.format("wav_windows").option("path", f"file://{tmp_path}").option("sessionId", "s").load().collect()
    assert len(by_uri) == 5 and {r.session_id for r in by_uri} == {"s"}
    save(tmp_path / "c.wav", data, width=4)
    with pytest.raises(Exception, match="16-bit"):
        spark.read.format("wav_windows").option("path", str(tmp_path / "c.wav")).load().collect()


def test_labels(spark, tmp_path):
    (tmp_path / "01.txt").write_text("# comment\n\n1.0\t2.5\tAd\n2.5\t4\tskip\textra\n")
    (tmp_path / "02.txt").write_text("")
    good = files.labels(files.label_lines(spark, str(tmp_path), "s"))
    assert sorted(map(tuple, good.collect())) == [("s", "01", 1.0, 2.5, "ad"), ("s", "01", 2.5, 4.0, "skip")]
    for text, what in (("1\t2", "three columns"), ("x\t2\tad", "not a number"), ("3\t2\tad", "before it starts"), ("1\t2\tsong", "unknown label"), ("1\t3\tad\n2\t4\tad", "overlaps")):
        (tmp_path / "01.txt").write_text(text)
        with pytest.raises(files.LabelError, match=what):
            files.labels(files.label_lines(spark, str(tmp_path), "s"))
    for name in ("01.wav", "03.wav", "b c.wav"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "b c.ads.txt").write_text("")
    wavs, texts = files.listed(spark, str(tmp_path), "*.wav"), files.listed(spark, str(tmp_path), "*.txt")
    with pytest.raises(files.LabelError, match="no labels for 03$"):
        files.paired(wavs, texts)
    (tmp_path / "03.ads.txt").write_text("")
    assert sorted(r.chunk for r in files.paired(wavs, files.listed(spark, str(tmp_path), "*.txt")).collect()) == ["01", "03", "b c"]
    with pytest.raises(files.LabelError, match="no WAV"):
        files.paired(wavs.limit(0), texts)


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"label": "ad", "note": "", "recorded_at": "2026-08-16T15:20:23.5+02:00", "device": "hw:1", "sample_rate": 48000, "channels": 2, "seconds": 30, "wav": "a.wav"}')
    (tmp_path / "session.json").write_text('{"session_id": "s1"}')
    rows = files.sidecars(spark, str(tmp_path))
    assert [(r.label, r.seconds, r.wav) for r in rows.collect()] == [("ad", 30.0, "a.wav")]
    assert rows.selectExpr("date_format(recorded_at, 'HH:mm:ss.S') as t").first().t == "13:20:23.5"
    files.write_sidecars(rows, str(tmp_path / "out"))
    assert files.sidecars(spark, str(tmp_path / "out")).collect() == rows.collect()


def test_session_metadata(spark, tmp_path):
    assert files.session_metadata(spark, str(tmp_path / "session.json")).count() == 0
    (tmp_path / "session.json").write_text('{\n"session_id": "s1", "more": 2}')
    assert files.session_metadata(spark, str(tmp_path / "session.json")).first().session_id == "s1"


def test_device_payloads(spark):
    rows = [(1, '<active-app><app id="12">Films</app></active-app>'), (2, "<active-app><app>Home</app></active-app>"), (3, "<active-app></active-app>"), (4, "<active-app><app id="), (5, None)]
    got = {r.i: (r.app_id, r.app_name) for r in files.active_app(spark.createDataFrame(rows, "i int, payload string")).collect()}
    assert got == {1: ("12", "Films"), 2: ("", "Home"), 3: ("", ""), 4: (None, None), 5: (None, None)}


def test_device_info(spark):
    rows = [
        (1, "<device-info><a>1</a><b-c>x y</b-c></device-info>"), (2, "<?xml version='1.0'?>\n<device-info><a>x &amp; y &lt;b&gt;</a></device-info>"),
        (3, '<device-info v="1"><a id="7">1</a><n><m>deep</m></n><e/></device-info>'), (4, "<device-info><a>1</a><a>2</a></device-info>"),
        (5, "<device-info/>"), (6, "<device-info></device-info>"), (7, "<device-info><a>1"), (8, "not found"), (9, ""), (10, None), (11, "<other><a>1</a></other>"),
    ]
    got = {r.i: r["info"] for r in files.device_info(spark.createDataFrame(rows, "i int, payload string")).collect()}
    want = {1: {"a": "1", "b-c": "x y"}, 2: {"a": "x & y <b>"}, 3: {"a": "1", "n": "", "e": ""}, 4: {"a": "2"}, 5: {}, 6: {}}
    assert got == want | {i: None for i in range(7, 12)}


def test_merge_and_scores(spark):
    spans = spark.createDataFrame([("s", 0.0, 10.0), ("s", 11.99, 12.5), ("s", 14.5, 20.0), ("t", 1.0, 2.0)], "session_id string, start double, end double")
    breaks = intervals.merge(spans)
    assert sorted((r.session_id, r.break_id, r.start, r.end) for r in breaks.collect()) == [("s", 0, 0.0, 12.5), ("s", 1, 14.5, 20.0), ("t", 0, 1.0, 2.0)]
    mutes = spark.createDataFrame([("s", 0, -3.0, 5.0), ("s", 1, 30.0, 31.0)], "session_id string, span int, start double, end double")
    sessions = spark.createDataFrame([("s", 100.0), ("t", 50.0), ("u", 0.0)], "session_id string, duration double")
    scores = {r.session_id: r for r in intervals.score_sessions(sessions, mutes, breaks).collect()}
    s = scores["s"]
    assert (s.breaks, s.caught, s.mutes, s.covered_seconds, s.muted_seconds, s.false_seconds) == (2, 1, 2, 5.0, 9.0, 2.0)
    assert scores["u"].mutes == 0 and scores["t"].caught == 0
    total = intervals.score_totals(intervals.score_sessions(sessions, mutes, breaks), intervals.break_latency(mutes, breaks)).first()
    assert (total.caught, total.median_latency, total.false_per_hour) == (1, -3.0, 3600 * 2 / 150)
    assert [r.span for r in intervals.spurious(mutes, breaks).collect()] == [1]


def test_no_training_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="usable"):
        dataset.write_csv(spark.range(0), str(tmp_path / "x"))
    dataset.write_csv(spark.range(3), str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == 3 and Detection().min_gap_seconds == 0.2


def test_feature_log(spark, sf_dir, tmp_path):
    from tidemark.plans import signal_queries
    from tidemark.sources import sinks

    log = signal_queries.feature_log_rows(spark, sf_dir).filter("session_id < 2")
    for kind in ("json", "csv"):
        for _ in range(2):
            sinks.write_log(log, str(tmp_path / kind), kind)
        back = spark.read.schema(log.schema).option("header", True).format(kind).load(str(tmp_path / kind))
        assert back.count() == 2 * log.count()
        assert sorted(map(str, back.distinct().collect())) == sorted(map(str, log.collect()))
    with pytest.raises(ValueError):
        sinks.write_log(log, str(tmp_path / "x"), "xml")
