import pytest

from tidemark.config import Config, ConfigError


def test_defaults_and_derived_bars():
    c = Config.from_dict(None)
    assert c.detection.stay_delta == 0.0 and c.detection.stay_absolute is None
    assert Config.from_dict({"detection": {"ad_absolute_dbfs": -23}}).detection.stay_absolute == -25.0


@pytest.mark.parametrize("given", [
    {"sound": {}}, {"audio": {"hertz": 1}}, {"audio": {"sample_rate": 1.5}}, {"audio": {"sample_rate": True}}, {"audio": {"frame_seconds": 2.0}},
    {"detection": {"min_gap_seconds": 2.0}}, {"detection": {"ad_stay_loudness_delta_db": 3.0}}, {"detection": {"ad_stay_absolute_dbfs": -25.0}},
    {"detection": {"baseline_alpha": 0.0}}, {"detection": {"max_ad_seconds": 131.0}}, {"gate": {"armed_apps_only": True}}, {"controller": {"confirm_windows": 0}},
])
def test_faults(given):
    with pytest.raises(ConfigError):
        Config.from_dict(given)


def test_override(tmp_path):
    c = Config().override({"detection.require_transition_cue": "no", "controller.confirm_windows": "5", "gate.armed_app_ids": "1, 2", "detection.ad_absolute_dbfs": "-20"})
    assert not c.detection.require_transition_cue and c.controller.confirm_windows == 5 and c.gate.armed_app_ids == ("1", "2")
    assert c.detection.ad_absolute_dbfs == -20.0 and c.detection.stay_absolute == -22.0
    for bad in ({"detection.none": "1"}, {"controller.confirm_windows": "x"}, {"detection.ad_loudness_delta_db": "-1"}):
        with pytest.raises(ConfigError):
            Config().override(bad)
    (tmp_path / "c.json").write_text('{"audio": {"window_seconds": 2}}')
    assert Config.load(str(tmp_path / "c.json")).audio.window_seconds == 2.0


def test_every_section_of_a_file(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("""
audio: {device: "hw:CARD=X", sample_rate: 44100, retry_initial_seconds: 1, retry_max_seconds: 5.0}
detection: {ad_absolute_dbfs: -23.0, ad_stay_absolute_dbfs: -25.0, ad_crest_delta_db: -99.0, loudness_median_windows: 9}
controller: {confirm_windows: 5, max_mute_seconds: 210.0}
roku: {host: "10.0.0.2", port: 8060, armed_apps_only: true, armed_app_ids: ["12"], armed_app_names: ["Films"], assume_muted_at_start: false}
logging: {level: info, feature_log_enabled: true, feature_log_format: csv, decision_heartbeat_windows: 0}
""")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert c.gate.matches("12", "") and c.gate.host == "10.0.0.2" and c.logging.feature_log_format == "csv" and c.audio.device == "hw:CARD=X"
    assert not c.override({"roku.armed_apps_only": "false"}).gate.armed_apps_only
    for bad in ({"roku": {"port": 0}}, {"logging": {"level": "LOUD"}}, {"logging": {"feature_log_format": "xml"}}, {"audio": {"device": ""}}, {"audio": {"retry_max_seconds": 0.5}}, ["audio"]):
        with pytest.raises(ConfigError):
            Config.from_dict(bad)
