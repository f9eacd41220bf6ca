"""What a stream remembers of a session's windows, where window functions can't look back.

The same that `sequence` finds in whole tables: stitched gaps, cue candidates,
the trailing median, restarts and the app that each check finds. Held against it
by the tests, window by window.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from statistics import median

from tidemark.config import Config
from tidemark.operators.rules import less, reaches
from tidemark.operators.sequence import FULLY_SILENT, LEAST_CENTROID


@dataclass(slots=True)
class Memory:
    """Plain values, so it can be stored."""

    held: float = 0.0
    voiced_rms: float | None = None
    voiced_centroid: float | None = None
    recent: list[float] = field(default_factory=list)
    armed: bool = False
    checked_at: float | None = None
    app: str = ""

    def seen(self, w: Mapping, t: float, config: Config) -> dict:
        """The window with what the fold reads beside its features."""
        restarted = bool(w.get("stream_restarted")) and w.get("window_index", 0) > 0
        switched = config.gate.armed_apps_only and w.get("armed") is None and self._asked(w, t, config)
        armed = not config.gate.armed_apps_only or (self.armed if w.get("armed") is None else bool(w["armed"]))
        switched = switched or bool(w.get("app_switched"))
        if restarted or switched:
            self.held, self.voiced_rms, self.voiced_centroid, self.recent = 0.0, None, None, []
        more = {"armed": armed, "app_switched": switched, "gap_seconds": 0.0, "is_cue": False, "smoothed_rms_dbfs": w["rms_dbfs"]}
        return dict(w) | (more | self._features(w, config.detection) if armed else more)

    def _asked(self, w: Mapping, t: float, config: Config) -> bool:
        """Asks for the app if it is time to; is it another armed one?"""
        if self.checked_at is not None and t - self.checked_at < config.controller.app_check_seconds:
            return False
        self.checked_at = t
        if w.get("app_id") is None:
            return False
        name = w.get("app_name") or ""
        self.armed = config.gate.matches(w["app_id"], name)
        before, self.app = self.app, (w["app_id"] or name) if self.armed else ""
        return self.armed and self.app != before

    def _features(self, w: Mapping, cfg) -> dict:
        silent = w["silence_ratio"] >= FULLY_SILENT
        gap = 0.0 if silent else max(self.held + w["leading_silence_seconds"], w["interior_silence_seconds"])
        self.held = self.held + w["duration_seconds"] if silent else w["trailing_silence_seconds"]
        self.recent = [*self.recent, w["rms_dbfs"]][-cfg.loudness_median_windows :]
        cue = not cfg.require_transition_cue or (cfg.min_gap_seconds <= gap <= cfg.max_gap_seconds and self._abrupt(w, cfg))
        if not w["is_silence"]:
            self.voiced_rms = self.voiced_rms if w["rms_dbfs"] is None else w["rms_dbfs"]
            self.voiced_centroid = self.voiced_centroid if w["spectral_centroid_hz"] is None else w["spectral_centroid_hz"]
        known = [x for x in self.recent if x is not None]
        return {"gap_seconds": gap, "is_cue": cue, "smoothed_rms_dbfs": median(known) if known else None}

    def _abrupt(self, w: Mapping, cfg) -> bool:
        if self.voiced_rms is None:
            return True
        size = lambda x: None if x is None else abs(x)
        shift, base = size(less(w["spectral_centroid_hz"], self.voiced_centroid)), self.voiced_centroid
        moved = 0.0 if base is None or base <= LEAST_CENTROID else None if shift is None else shift / base
        return reaches(size(less(w["rms_dbfs"], self.voiced_rms)), cfg.loudness_jump_db) or reaches(moved, cfg.centroid_shift_ratio)
