"""WAV files as a Spark data source: 16-bit PCM, cut into windows.

``spark.dataSource.register(WavSource)`` and then
``spark.read.format("wav_windows").option("path", ...).load()``. A file's frames
are at fixed places, so a long one is read in parts, each by its own task. The
driver lists files with their sizes only; headers are read by the tasks. Paths
are local or of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import json
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.kernels import mono

SCHEMA = "session_id string, chunk string, path string, window_index long, timestamp double, sample_rate int, samples array<float>, stream_restarted boolean"


@dataclass
class Part(InputPartition):
    """The windows of a file from k/n of them to (k + 1)/n."""

    session_id: str
    path: str
    k: int
    n: int


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def frames_per_window(rate: int, window_seconds: float) -> int:
    return max(1, round(rate * window_seconds))


def windows(path: str, window_seconds: float, start: float, k: int = 0, n: int = 1) -> Iterator[tuple]:
    """Index, time, rate and samples of the windows of one part of a file; the last window may be shorter, and is kept."""
    store, place = file_system(path)
    with store.open_input_file(place) as raw, wave.open(raw, "rb") as f:
        if f.getsampwidth() != 2:
            raise ValueError(f"{path}: 16-bit PCM is needed")
        rate, channels, size = f.getframerate(), f.getnchannels(), frames_per_window(f.getframerate(), window_seconds)
        total = -(-f.getnframes() // size)
        first, last = total * k // n, total * (k + 1) // n
        f.setpos(min(first * size, f.getnframes()))
        for index in range(first, last):
            data = np.frombuffer(f.readframes(size), "<i2")
            data = data[: len(data) // channels * channels]  # a torn frame at the end is dropped
            if not len(data):
                return
            samples = mono(data.astype(np.int16).reshape(-1, channels))
            yield index, start + index * window_seconds, rate, samples.tolist()


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        option = {k.lower(): v for k, v in options.items()}
        self.sessions = json.loads(option["sessions"]) if "sessions" in option else {option.get("sessionid"): option["path"]}
        self.window_seconds = float(option.get("windowseconds", "1.0"))
        self.start = float(option.get("starttimestamp", "0.0"))
        self.bytes_per_task = int(option.get("bytespertask", str(1 << 26)))

    def _files(self, path: str) -> list[tuple[str, int]]:
        store, place = file_system(path)
        info = store.get_file_info(place)
        found = store.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
        scheme = path[: path.index("://") + 3] if "://" in path and not place.startswith("/") else "file://" if path.startswith("file:") else ""
        return sorted((scheme + x.path, x.size or 0) for x in found if x.type == fs.FileType.File and (x.path == place or x.path.lower().endswith(".wav")))

    def partitions(self) -> list[Part]:
        out = []
        for session, path in self.sessions.items():
            name = path.rstrip("/").rsplit("/", 1)[-1] if session is None else session
            for file, size in self._files(path):
                n = max(1, -(-size // self.bytes_per_task))
                out += [Part(name, file, k, n) for k in range(n)]
        return out or [Part("", "", 0, 1)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path:
            for index, time, rate, samples in windows(partition.path, self.window_seconds, self.start, partition.k, partition.n):
                yield partition.session_id, stem(partition.path), partition.path, index, time, rate, samples, index == 0


class WavSource(DataSource):
    """Options: path (a file or a folder) and sessionId (else the folder's name), or sessions (JSON: folders by id);
    windowSeconds, startTimestamp, bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))
