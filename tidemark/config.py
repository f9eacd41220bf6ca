"""Settings of the detector and the controller, checked before any job starts.

A threshold that is not set is None (never NaN: Spark orders NaN above every
number). Durations are seconds, levels are decibels relative to full scale.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any, get_type_hints


class ConfigError(ValueError):
    """A setting is unknown, of the wrong type or out of its range."""


def _require(good: bool, what: str) -> None:
    if not good:
        raise ConfigError(what)


@dataclass(frozen=True)
class Audio:
    """The device and the waits between attempts to open it are for a capture source; jobs on recordings don't read them."""

    sample_rate: int = 48_000
    channels: int = 2
    window_seconds: float = 1.0
    frame_seconds: float = 0.05
    device: str = "plughw:CARD=Receiver,DEV=0"
    retry_initial_seconds: float = 1.0
    retry_max_seconds: float = 30.0

    def __post_init__(self) -> None:
        _require(bool(self.device), "audio: device must not be empty")
        _require(0 < self.retry_initial_seconds <= self.retry_max_seconds, "audio: 0 < retry_initial_seconds <= retry_max_seconds")
        _require(self.sample_rate > 0 and self.channels >= 1, "audio: sample_rate and channels must be positive")
        _require(0 < self.frame_seconds <= self.window_seconds, "audio: 0 < frame_seconds <= window_seconds")


@dataclass(frozen=True)
class Detection:
    silence_dbfs: float = -60.0
    require_transition_cue: bool = True
    min_gap_seconds: float = 0.2
    max_gap_seconds: float = 1.5
    cue_grace_seconds: float = 3.0
    loudness_jump_db: float = 3.0
    centroid_shift_ratio: float = 0.25
    ad_loudness_delta_db: float = 2.0
    ad_stay_loudness_delta_db: float | None = None
    ad_crest_delta_db: float = 2.0
    ad_absolute_dbfs: float | None = None
    ad_stay_absolute_dbfs: float | None = None
    loudness_median_windows: int = 1
    baseline_alpha: float = 0.05
    baseline_min_windows: int = 15
    ad_end_windows: int = 2
    min_ad_seconds: float = 5.0
    max_ad_seconds: float = 120.0

    #: Staying in an ad takes so much less level than entering one, where the bar is not set.
    STAY_MARGIN = 2.0

    def __post_init__(self) -> None:
        _require(self.silence_dbfs < 0, "detection: silence_dbfs must be below 0")
        _require(0 < self.min_gap_seconds <= self.max_gap_seconds, "detection: 0 < min_gap_seconds <= max_gap_seconds")
        _require(self.cue_grace_seconds > 0, "detection: cue_grace_seconds must be positive")
        _require(self.loudness_jump_db >= 0 and self.centroid_shift_ratio >= 0, "detection: shifts must not be negative")
        _require(self.stay_delta <= self.ad_loudness_delta_db, "detection: the bar to stay must not be over the bar to enter")
        if self.ad_absolute_dbfs is None:
            _require(self.ad_stay_absolute_dbfs is None, "detection: ad_stay_absolute_dbfs needs ad_absolute_dbfs")
        else:
            _require(self.ad_absolute_dbfs < 0, "detection: ad_absolute_dbfs must be below 0")
            _require(self.stay_absolute <= self.ad_absolute_dbfs, "detection: the bar to stay must not be over the bar to enter")
        _require(self.loudness_median_windows >= 1 and self.baseline_min_windows >= 1 and self.ad_end_windows >= 1, "detection: counts of windows start at 1")
        _require(0 < self.baseline_alpha <= 1, "detection: 0 < baseline_alpha <= 1")
        _require(0 <= self.min_ad_seconds < self.max_ad_seconds, "detection: 0 <= min_ad_seconds < max_ad_seconds")

    @property
    def stay_delta(self) -> float:
        own = self.ad_stay_loudness_delta_db
        return self.ad_loudness_delta_db - self.STAY_MARGIN if own is None else own

    @property
    def stay_absolute(self) -> float | None:
        if self.ad_absolute_dbfs is None:
            return None
        own = self.ad_stay_absolute_dbfs
        return self.ad_absolute_dbfs - self.STAY_MARGIN if own is None else own


@dataclass(frozen=True)
class Control:
    confirm_windows: int = 2
    max_mute_seconds: float = 130.0
    app_check_seconds: float = 10.0

    def __post_init__(self) -> None:
        _require(self.confirm_windows >= 1, "controller: confirm_windows starts at 1")
        _require(self.max_mute_seconds > 0 and self.app_check_seconds >= 0, "controller: max_mute_seconds > 0, app_check_seconds >= 0")


@dataclass(frozen=True)
class Gate:
    """Which apps detection runs for (off: always), and the device that is asked and muted."""

    armed_apps_only: bool = False
    armed_app_ids: tuple[str, ...] = ()
    armed_app_names: tuple[str, ...] = ()
    host: str = "127.0.0.1"
    port: int = 8060
    timeout_seconds: float = 2.0
    assume_muted_at_start: bool = False

    def __post_init__(self) -> None:
        _require(bool(self.host) and 0 < self.port < 1 << 16 and self.timeout_seconds > 0, "gate: needs a host, a TCP port and a positive timeout_seconds")
        _require(not self.armed_apps_only or bool(self.armed_app_ids or self.armed_app_names), "gate: needs an app id or name")

    def matches(self, app_id: str, name: str) -> bool:
        return app_id in self.armed_app_ids or name.strip().lower() in {x.strip().lower() for x in self.armed_app_names}


@dataclass(frozen=True)
class Log:
    """Where and how decisions are logged."""

    LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
    FORMATS = ("jsonl", "csv")

    level: str = "INFO"
    feature_log_enabled: bool = False
    feature_log_path: str = "logs/features.jsonl"
    feature_log_format: str = "jsonl"
    verbose_decisions: bool = False
    decision_heartbeat_windows: int = 60

    def __post_init__(self) -> None:
        _require(self.level.upper() in self.LEVELS and self.feature_log_format in self.FORMATS, f"logging: level is one of {self.LEVELS}, feature_log_format of {self.FORMATS}")
        _require(bool(self.feature_log_path) or not self.feature_log_enabled, "logging: a feature log needs a path")
        _require(self.decision_heartbeat_windows >= 0, "logging: decision_heartbeat_windows must not be negative")


#: Other names of sections in files and overrides.
SECTION_NAMES = {"roku": "gate"}


@dataclass(frozen=True)
class Config:
    audio: Audio = field(default_factory=Audio)
    detection: Detection = field(default_factory=Detection)
    controller: Control = field(default_factory=Control)
    gate: Gate = field(default_factory=Gate)
    logging: Log = field(default_factory=Log)

    def __post_init__(self) -> None:
        _require(self.controller.max_mute_seconds >= self.detection.max_ad_seconds, "controller: max_mute_seconds must not be under detection's max_ad_seconds")

    @classmethod
    def from_dict(cls, given: Mapping[str, Any] | None) -> Config:
        """Sections and settings by name; what is not given has its default."""
        _require(given is None or isinstance(given, Mapping), "settings must be sections by name")
        given = {SECTION_NAMES.get(name, name): own for name, own in (given or {}).items()}
        kinds = {f.name: f.default_factory for f in fields(cls)}
        _require(set(given) <= set(kinds), f"unknown sections: {sorted(set(given) - set(kinds))}")
        return cls(**{name: _section(kinds[name], own or {}, name) for name, own in given.items()})

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file or, where a YAML reader is installed, a YAML one; empty: all defaults."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text) if text.strip() else None)
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def override(self, settings: Mapping[str, str]) -> Config:
        """With `section.key` set from text, by the type of the current setting.

        As the stay bars are part of the settings by then, a sweep of the bar
        to enter below them is an error, not a new derivation.
        """
        out = asdict(self)
        out["detection"] |= {"ad_stay_loudness_delta_db": self.detection.stay_delta, "ad_stay_absolute_dbfs": self.detection.stay_absolute}
        for name, text in settings.items():
            section, _, key = name.partition(".")
            section = SECTION_NAMES.get(section, section)
            _require(section in out and key in out[section], f"unknown setting {name}")
            out[section][key] = _from_text(text, out[section][key], name)
        return Config.from_dict(out)

    def with_detection(self, **changes: Any) -> Config:
        return replace(self, detection=replace(self.detection, **changes))


def _section(kind: type, given: Mapping[str, Any], name: str):
    types = get_type_hints(kind)
    known = {f.name for f in fields(kind)}
    _require(set(given) <= known, f"{name}: unknown settings {sorted(set(given) - known)}")
    return kind(**{key: _typed(value, types[key], f"{name}.{key}") for key, value in given.items()})


def _typed(value: Any, kind: Any, name: str) -> Any:
    if kind == float | None:
        return None if value is None else _typed(value, float, name)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind == tuple[str, ...]:
        _require(isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value), f"{name}: a list of texts is needed")
        return tuple(value)
    _require(type(value) is kind, f"{name}: {kind.__name__} is needed, not {value!r}")
    return value


def _from_text(text: str, now: Any, name: str) -> Any:
    try:
        if isinstance(now, bool):
            return text.strip().lower() in ("1", "true", "yes", "on")
        if isinstance(now, int):
            return int(text)
        if isinstance(now, tuple):
            return tuple(x.strip() for x in text.split(",") if x.strip())
        if isinstance(now, str):
            return text
        return float(text)
    except ValueError:
        raise ConfigError(f"{name}: {text!r} doesn't fit") from None
