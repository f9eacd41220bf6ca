"""The detector and its controller as one step over a session's windows.

A step takes the state, a window and its time and gives the window's decision.
Only what depends on earlier decisions is here. What depends on features alone
(gaps, cue candidates, smoothed levels, resets, the app gate) comes with the
window: from window functions over whole tables (`detect.seen`), or from a
stream's memory (`streaming.causal`). Detector and controller are one fold
because the controller clears the detector: when a confirmation fails and when
the mute failsafe trips. Any `Detector` can take the place of the rules (`rules`).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from tidemark.config import Config

CONTENT, SUSPECTED, MUTED = "CONTENT", "AD_SUSPECTED", "MUTED"
STARTED, ENDED, NONE = "AD_STARTED", "AD_ENDED", "NO_CHANGE"


@dataclass(slots=True)
class Baseline:
    rms: float | None = None
    crest: float | None = None
    centroid: float | None = None
    count: int = 0

    def take(self, w: Mapping, alpha: float) -> None:
        keep = 1 - alpha
        # A value that isn't known leaves no mean; the next one begins it.
        mean = lambda own, x: x if own is None or x is None else keep * own + alpha * x
        self.rms, self.crest, self.centroid = mean(self.rms, w["rms_dbfs"]), mean(self.crest, w["crest_db"]), mean(self.centroid, w["spectral_centroid_hz"])
        self.count += 1


@dataclass(slots=True)
class State:
    """All that is carried from one window to the next; plain values, so it can be stored.

    Detectors other than the rules keep what they remember in `own`.
    """

    baseline: Baseline = field(default_factory=Baseline)
    in_ad: bool = False
    ad_started_at: float | None = None
    cue_at: float | None = None
    streak: int = 0
    own: dict[str, Any] = field(default_factory=dict)
    state: str = CONTENT
    pending: int = 0
    muted_at: float | None = None
    believed_muted: bool = False
    unmute_pending: bool = False
    #: Was it this fold that muted? What was muted before it began is not taken back at the end.
    own_mute: bool = False

    @classmethod
    def at_start(cls, config: Config) -> State:
        return cls(believed_muted=config.gate.assume_muted_at_start)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict) -> State:
        return cls(**(given | {"baseline": Baseline(**given["baseline"])}))

    def forget_ad(self) -> None:
        self.in_ad, self.ad_started_at, self.cue_at, self.streak = False, None, None, 0

    def forget_all(self) -> None:
        self.forget_ad()
        self.baseline = Baseline()


@dataclass(slots=True)
class Decision:
    """What the detector says of a window. Baselines are those before the window."""

    event: str = ""
    ad_profile: bool = False
    confidence: float = 0.0
    reason: str = "not armed"
    gap_seconds: float | None = None
    cue_gap_seconds: float | None = None
    cue_active: bool | None = None
    loudness_threshold_db: float | None = None
    loudness_delta_db: float | None = None
    crest_delta_db: float | None = None
    smoothed_rms_dbfs: float | None = None
    baseline_rms_dbfs: float | None = None
    baseline_crest_db: float | None = None
    baseline_centroid_hz: float | None = None
    baseline_count: int | None = None
    ad_elapsed_seconds: float | None = None


class Detector(Protocol):
    """What the fold needs of a detector; all it remembers is in the state."""

    def update(self, s: State, w: Mapping, t: float, config: Config) -> Decision:
        """The decision on one window; event says what begins or ends, ad_profile what the window is like."""

    def reset(self, s: State) -> None:
        """Forgets everything: nothing learned so far holds any more."""

    def reject(self, s: State) -> None:
        """Forgets the ad that it has reported."""


#: Where the controller wants to be after an event, by where it is. Staying put is left out.
_WISHES = {(CONTENT, STARTED): SUSPECTED, (SUSPECTED, ENDED): CONTENT, (MUTED, ENDED): CONTENT}


def _control(s: State, d: Decision, t: float, ok: bool, cfg, detector: Detector) -> None:
    """One transition: what is wanted now, then as much of it as the actuator does (`ok`).

    An unmute that failed is wanted until it works. The detector is told when
    its ad comes to nothing: not confirmed, or muted for too long.
    """
    wish, reject = _WISHES.get((s.state, d.event), s.state), False
    if s.state == MUTED and wish == MUTED:
        overdue = s.muted_at is not None and t - s.muted_at >= cfg.max_mute_seconds
        reject = overdue and not (s.unmute_pending and ok)
        wish = CONTENT if overdue or s.unmute_pending else MUTED
    elif s.state == SUSPECTED and wish == SUSPECTED and not d.ad_profile:
        wish, reject = CONTENT, True
    elif wish == SUSPECTED:
        s.pending = s.pending + 1 if s.state == SUSPECTED else 1
        s.state = SUSPECTED
        wish = MUTED if s.pending >= cfg.confirm_windows else SUSPECTED
    if reject:
        detector.reject(s)
    _move(s, wish, t, ok)


def _move(s: State, wish: str, t: float, ok: bool) -> None:
    if wish == s.state:
        return
    if wish == MUTED:
        if ok or s.believed_muted:
            s.state, s.muted_at, s.believed_muted, s.unmute_pending, s.own_mute = MUTED, t, True, False, True
    elif s.state == MUTED and s.believed_muted and not ok:
        s.unmute_pending = True
    else:
        if s.state == MUTED:
            s.believed_muted = s.unmute_pending = False
        s.state, s.pending, s.muted_at = CONTENT, 0, None


def _break_off(s: State, t: float, ok: bool, detector: Detector) -> None:
    """Nothing learned so far holds any more; nor does a mute, whoever it was."""
    detector.reset(s)
    if s.believed_muted and s.state != MUTED:
        s.believed_muted = s.unmute_pending = not ok
        if not ok:
            return
    _move(s, CONTENT, t, ok)


def step(s: State, w: Mapping, t: float, config: Config, detector: Detector) -> Decision:
    """One window through gate, detector and controller; changes `s`.

    `w` has the features, gap_seconds, is_cue and smoothed_rms_dbfs, and may
    have stream_restarted, armed and app_switched (with the gate on) and
    command_ok (did the actuator obey; default yes).
    """
    ok = w.get("command_ok")
    ok = True if ok is None else bool(ok)
    if w.get("stream_restarted") and w.get("window_index", 0) > 0:
        _break_off(s, t, ok, detector)
    if config.gate.armed_apps_only:
        if w.get("app_switched"):
            detector.reset(s)
        if not w.get("armed"):
            if s.state != CONTENT or s.believed_muted:
                _break_off(s, t, ok, detector)
            return Decision()
    d = detector.update(s, w, t, config)
    _control(s, d, t, ok, config.controller, detector)
    return d


def shut_down(s: State) -> bool:
    """The end of a session: takes back its own mute. Was there one?"""
    muted = s.believed_muted and s.own_mute
    s.state, s.pending, s.muted_at, s.unmute_pending, s.believed_muted = CONTENT, 0, None, False, s.believed_muted and not muted
    return muted
