"""Landed capture as a Spark data source: batch and stream of windows, with offsets.

A recorder lands what it captures as WAV segments, ``<root>/<session>/<first
frame>-<frames>.wav``, in order; the names give the place on the session's
sample clock, so planning needs names only. A file named ``end`` closes a
session. Windows lie on that clock's grid: window k has the frames from k times
the window's size, whatever the segments' lengths.

Frames that no segment has are a gap: the device was lost. The first window
after one (and a session's first) has ``stream_restarted``; the torn window
before it is dropped, as is what a window has before a gap within it. Only the
gap counts: a query that was stopped goes on from its checkpoint without one.

``spark.dataSource.register(CaptureSource)``, then ``spark.readStream`` (or
``spark.read``) ``.format("capture").option("path", root).option("sampleRate",
48000).load()``.
"""

from __future__ import annotations

import re
import time
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.kernels import mono
from tidemark.sources.wav import file_system, frames_per_window

SCHEMA = "session_id string, window_index long, timestamp double, sample_rate int, samples array<float>, stream_restarted boolean"
END = "end"
_SEGMENT = re.compile(r"(\d+)-(\d+)\.wav")


@dataclass(frozen=True)
class Segment:
    first: int
    frames: int
    path: str

    @property
    def stop(self) -> int:
        return self.first + self.frames


@dataclass
class Windows(InputPartition):
    """Windows of a session from one to another (exclusive), and the segments that have frames of them or end right before."""

    session_id: str
    start: int
    stop: int
    segments: tuple[Segment, ...]
    #: Frames that have landed: a window that goes beyond is the last one of its session.
    landed: int


@dataclass(frozen=True)
class Landing:
    """Where segments land, and how they are cut; what a reader is made of."""

    path: str
    sample_rate: int
    window_seconds: float = 1.0
    windows_per_task: int = 120
    retries: int = 5
    retry_initial_seconds: float = 1.0
    retry_max_seconds: float = 30.0

    @classmethod
    def of(cls, options: dict[str, str]) -> Landing:
        option = {k.lower(): v for k, v in options.items()}
        if "path" not in option or "samplerate" not in option:
            raise ValueError("capture needs the options path and sampleRate")
        return cls(
            option["path"], int(option["samplerate"]), float(option.get("windowseconds", "1.0")), int(option.get("windowspertask", "120")), int(option.get("retries", "5")),
            float(option.get("retryinitialseconds", "1.0")), float(option.get("retrymaxseconds", "30.0")),
        )

    @property
    def size(self) -> int:
        return frames_per_window(self.sample_rate, self.window_seconds)

    def _listed(self) -> list[fs.FileInfo]:
        store, place = file_system(self.path)
        return store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))

    def listed(self, sleep: Callable[[float], None] = time.sleep) -> dict[str, tuple[list[Segment], bool]]:
        """Segments of each session in order, and whether it has ended. A store that can't be reached is asked again, after longer and longer."""
        wait, left = self.retry_initial_seconds, self.retries
        while True:
            try:
                found = self._listed()
                break
            except OSError:
                if not left:
                    raise
                sleep(wait)
                wait, left = min(2 * wait, self.retry_max_seconds), left - 1
        sessions: dict[str, tuple[list[Segment], bool]] = {}
        for info in found:
            if info.type != fs.FileType.File:
                continue
            folder, name = info.path.rsplit("/", 2)[-2:]
            segments, ended = sessions.get(folder, ([], False))
            if match := _SEGMENT.fullmatch(name):
                segments.append(Segment(int(match[1]), int(match[2]), info.path))
            sessions[folder] = segments, ended or name == END
        return {s: (sorted((x for x in own if x.frames), key=lambda x: x.first), ended) for s, (own, ended) in sessions.items() if own}

    def landed(self) -> dict[str, list]:
        """The offset: of each session the frame after the last one that has landed, and whether it has ended."""
        return {s: [max(x.stop for x in own), ended] for s, (own, ended) in self.listed().items()}

    def complete(self, landed: int, ended: bool) -> int:
        """How many windows of the grid are complete."""
        return -(-landed // self.size) if ended else landed // self.size

    def parts(self, start: dict[str, list], end: dict[str, list]) -> list[Windows]:
        """The windows that are complete at one offset and weren't at the one before; sessions that have gone since have none."""
        out, sessions = [], self.listed()
        for session, (landed, ended) in sorted(end.items()):
            first, stop = self.complete(*start.get(session, (0, False))), self.complete(landed, ended)
            own = [x for x in sessions.get(session, ([], False))[0] if x.first < landed]
            for at in range(first, stop, self.windows_per_task):
                to = min(at + self.windows_per_task, stop)
                near = tuple(x for x in own if x.stop >= at * self.size and x.first < to * self.size)
                if near:
                    out.append(Windows(session, at, to, near, landed))
        return out

    def read(self, part: Windows) -> Iterator[tuple]:
        """The windows of a part, from runs of frames without a gap."""
        bounds = part.start * self.size, min(part.stop * self.size, part.landed)
        goes_on = any(x.first < bounds[0] <= x.stop for x in part.segments)
        # `before` is where the frames so far end; those that two segments have are taken from the first.
        run, at, before, restarted = [], bounds[0], bounds[0] if goes_on else -1, False
        for segment in part.segments:
            start, stop = max(segment.first, at), min(segment.stop, bounds[1])
            if start >= stop:
                continue
            if start != before:
                if run:
                    yield from self._cut(part, run, before, restarted)
                run, restarted = [], True
            run.append((start, self._frames(segment, start, stop)))
            at = before = stop
        if run:
            yield from self._cut(part, run, before, restarted)

    def _frames(self, segment: Segment, start: int, stop: int) -> np.ndarray:
        store, _ = file_system(self.path)
        with store.open_input_file(segment.path) as raw, wave.open(raw, "rb") as f:
            if f.getsampwidth() != 2 or f.getframerate() != self.sample_rate or f.getnframes() != segment.frames:
                raise ValueError(f"{segment.path}: 16-bit PCM at {self.sample_rate} Hz with as many frames as its name says is needed")
            f.setpos(start - segment.first)
            data = np.frombuffer(f.readframes(stop - start), "<i2")
            return mono(data.astype(np.int16).reshape(-1, f.getnchannels()))

    def _cut(self, part: Windows, run: list[tuple[int, np.ndarray]], stop: int, restarted: bool) -> Iterator[tuple]:
        """Windows of one run: all that it fills up to their end, and the session's last one."""
        first, samples = run[0][0], np.concatenate([x for _, x in run])
        for k in range(first // self.size, -(-stop // self.size)):
            begin, end = max(k * self.size, first), min((k + 1) * self.size, stop)
            if end < (k + 1) * self.size and end < part.landed:
                return  # the device was lost within this window
            yield part.session_id, k, k * self.size / self.sample_rate, self.sample_rate, samples[begin - first : end - first].tolist(), restarted
            restarted = False


class CaptureReader(DataSourceReader):
    """All that has landed, as if every session had ended."""

    def __init__(self, landing: Landing) -> None:
        self.landing = landing

    def partitions(self) -> list[Windows]:
        return self.landing.parts({}, {s: [n, True] for s, (n, _) in self.landing.landed().items()}) or [Windows("", 0, 0, (), 0)]

    def read(self, partition: Windows) -> Iterator[tuple]:
        return self.landing.read(partition)


class CaptureStream(DataSourceStreamReader):
    """Offsets are frames by session, so a batch that runs again reads the same windows."""

    def __init__(self, landing: Landing) -> None:
        self.landing = landing

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.landing.landed()

    def partitions(self, start: dict, end: dict) -> list[Windows]:
        return self.landing.parts(start, end)

    def read(self, partition: Windows) -> Iterator[tuple]:
        return self.landing.read(partition)


class CaptureSource(DataSource):
    """Options: path and sampleRate; windowSeconds, windowsPerTask, retries, retryInitialSeconds, retryMaxSeconds."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(Landing.of(dict(self.options)))

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(Landing.of(dict(self.options)))
