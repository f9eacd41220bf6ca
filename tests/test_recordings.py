"""From synthesised WAV and label files to scores and training rows, against a plain loop."""

import wave

import numpy as np
import pytest

from tidemark.config import Audio, Config, Control, Detection, Gate
from tidemark.functions import kernels
from tidemark.operators import fold, recordings
from tidemark.operators.rules import RULES
from tidemark.sources import files
from tidemark.streaming.causal import Memory

CONFIG = Config(
    audio=Audio(frame_seconds=0.05),
    detection=Detection(min_gap_seconds=0.2, max_gap_seconds=1.5, ad_crest_delta_db=-99.0, baseline_min_windows=5, min_ad_seconds=2.0, max_ad_seconds=60.0),
    controller=Control(confirm_windows=2), gate=Gate(armed_apps_only=True, armed_app_ids=("1",)),
)


def sound(rng, rate, seconds, level):
    return rng.normal(size=int(rate * seconds)) * level


def save(path, x, rate, channels=2):
    data = np.clip(np.repeat(x[:, None], channels, 1) * 32767, -32768, 32767).astype("<i2")
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(data.tobytes())


@pytest.fixture(scope="module")
def sessions(tmp_path_factory):
    """Two sessions of chunks with different rates; the ad of the first goes over a cut."""
    out = {}
    for k, (name, rate, channels) in enumerate((("one", 8000, 2), ("two", 4000, 1))):
        rng, folder = np.random.default_rng(k), tmp_path_factory.mktemp(name)
        quiet, loud = (lambda s: sound(rng, rate, s, 0.03)), (lambda s: sound(rng, rate, s, 0.2))
        gap = np.zeros(rate // 2)
        save(folder / "01.wav", np.concatenate([quiet(20), gap, loud(9.5)]), rate, channels)
        save(folder / "02.wav", np.concatenate([loud(6), gap, quiet(18.25)]), rate, channels)
        (folder / "01.ads.txt").write_text("20.5\t30.0\tad\n")
        (folder / "02.ads.txt").write_text("0\t6\tad-cont\n10\t12\tskip\n" if k == 0 else "")
        (folder / "session.json").write_text('{"session_id": "x"}')
        out[name] = str(folder)
    return out


def plain(folder):
    """Windows of a session in order, and its mutes, by a loop."""
    rows, state, memory, t, mutes = [], fold.State(), Memory(), 0.0, []
    config = CONFIG.override({"gate.armed_apps_only": "false"})
    for name in ("01", "02"):
        with wave.open(f"{folder}/{name}.wav", "rb") as f:
            rate = f.getframerate()
            data = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
        x = kernels.mono(data.astype(np.int16))
        for i in range(0, len(x), rate):
            w = kernels.features(x[None, i : i + rate], rate, config.detection.silence_dbfs, 0.05).iloc[0].to_dict()
            was = state.believed_muted
            fold.step(state, memory.seen(w | {"window_index": len(rows), "stream_restarted": not rows}, t, config), t, config, RULES)
            if state.believed_muted and not was:
                mutes.append([t, None])
            if was and not state.believed_muted:
                mutes[-1][1] = t
            rows.append((name, t, w["rms_dbfs"], w["duration_seconds"]))
            t += w["duration_seconds"]
    if mutes and mutes[-1][1] is None:
        mutes[-1][1] = rows[-1][1]
    return rows, mutes, t


def test_scores(spark, sessions):
    by_session, totals, by_break = recordings.scores(spark, sessions, CONFIG)
    got = {r.session_id: r for r in by_session.collect()}
    ads = {"one": (20.5, 36.0), "two": (20.5, 30.0)}
    for name, folder in sessions.items():
        rows, mutes, duration = plain(folder)
        start, end = ads[name]
        assert mutes and got[name].mutes == len(mutes) and got[name].duration == pytest.approx(duration) and got[name].breaks == 1
        assert got[name].muted_seconds == pytest.approx(sum(b - a for a, b in mutes))
        assert got[name].covered_seconds == pytest.approx(sum(max(0, min(b, end) - max(a, start)) for a, b in mutes))
        hit = next(r for r in by_break.collect() if r.session_id == name)
        assert (hit.start, hit.end) == (start, end) and hit.first_mute == min(a for a, b in mutes if a < end and b > start)
    total = totals.first()
    assert total.sessions == 2 and total.caught == 2 and total.covered_seconds == pytest.approx(sum(r.covered_seconds for r in got.values()))


def test_training_rows(spark, sessions):
    got = sorted(recordings.training_rows(spark, sessions, CONFIG).filter("session_id = 'one'").collect(), key=lambda r: r.window_index)
    rows, _, _ = plain(sessions["one"])
    kept = [(i, r) for i, r in enumerate(rows) if not (r[0] == "02" and 10 <= r[1] - 30 + r[3] / 2 < 12)]
    assert [r.window_index for r in got] == [i for i, _ in kept] and len(kept) < len(rows)
    assert [r.rms_dbfs for r in got] == pytest.approx([r[2] for _, r in kept], abs=1e-5)
    assert [r.session_seconds for r in got] == pytest.approx([r[1] for _, r in kept], abs=1e-3)
    assert [r.is_ad for r in got] == [int(20.5 <= r[1] + r[3] / 2 < 36) for _, r in kept]


def test_another_detector(spark, sessions):
    class Loud:
        """Ads are the windows over a level; it remembers one number."""

        def update(self, s, w, t, config):
            loud = w["rms_dbfs"] > -20
            was, s.own["loud"] = s.own.get("loud", False), loud
            event = fold.NONE if loud == was else fold.STARTED if loud else fold.ENDED
            return fold.Decision(event=event, ad_profile=loud, reason="level")

        def reset(self, s):
            s.own.clear()

        def reject(self, s):
            s.own.clear()

    by_session, _, by_break = recordings.scores(spark, sessions, CONFIG, Loud())
    assert {r.first_mute for r in by_break.collect()} == {21.0} and {r.mutes for r in by_session.collect()} == {1}


def test_every_chunk_needs_labels(spark, sessions, tmp_path):
    save(tmp_path / "01.wav", np.zeros(100), 100, 1)
    with pytest.raises(files.LabelError, match="01"):
        recordings.spans(spark, {"s": str(tmp_path)})
    (tmp_path / "01.ads.txt").write_text("")
    assert recordings.spans(spark, {"s": str(tmp_path)}).count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(files.LabelError, match="no WAV"):
        recordings.spans(spark, {"s": str(tmp_path / "empty")})


def test_sessions_are_named_by_their_file(spark, tmp_path):
    for folder, text in (("a", '{"session_id": "evening"}'), ("b", None), ("c", "{}"), ("d", '{"session_id": "b"}'), ("e", '{"session_id": ')):
        (tmp_path / folder).mkdir()
        if text is not None:
            (tmp_path / folder / "session.json").write_text(text)
    path = lambda x: str(tmp_path / x)
    assert recordings.named(spark, [path("a"), path("b") + "/", path("c")]) == {"evening": path("a"), "b": path("b") + "/", "c": path("c")}
    with pytest.raises(ValueError, match="both the session b"):
        recordings.named(spark, [path("b"), path("d")])
    with pytest.raises(Exception, match="(?i)malformed"):
        recordings.named(spark, [path("e")])


def test_grid_of_settings():
    from tidemark.operators import sweep

    tried, settings, bad = sweep.grid(Config(), {"detection.min_gap_seconds": ("0.2", "9.0"), "detection.max_gap_seconds": ("1.0", "10.0")}, {"controller.confirm_windows": "3"})
    assert settings == [{"detection.min_gap_seconds": a, "detection.max_gap_seconds": b} for a, b in (("0.2", "1.0"), ("0.2", "10.0"), ("9.0", "10.0"))]
    assert bad == [{"detection.min_gap_seconds": "9.0", "detection.max_gap_seconds": "1.0"}]
    assert [(c.detection.min_gap_seconds, c.detection.max_gap_seconds, c.controller.confirm_windows) for c in tried] == [(0.2, 1.0, 3), (0.2, 10.0, 3), (9.0, 10.0, 3)]
