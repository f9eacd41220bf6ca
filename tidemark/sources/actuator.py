"""Wanted states as a sink that a device reads: each batch is committed once, whatever runs twice.

Tasks stage their rows as files that nobody reads; committing a batch writes one
manifest that names them, and a batch that has its manifest is not committed
again. A device, or what stands for it, reads ``committed`` and tells what came
of each state in a table of acknowledgements (session_id, at, ok); ``obeyed``
gives them to the windows that follow, as the fold's ``command_ok``.

``spark.dataSource.register(ActuatorSink)``, then ``writeStream.format("actuator")
.option("path", folder)``; rows have session_id, window_index, timestamp,
want_muted and at_end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from tidemark.operators import sequence
from tidemark.sources.wav import file_system

SCHEMA = "session_id string, window_index long, timestamp double, want_muted boolean, at_end boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
STAGED, MANIFESTS = "staged", "commits"


@dataclass
class Staged(WriterCommitMessage):
    """A task's file; None if it had no rows."""

    name: str | None


class ActuatorWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _place(self, *parts: str) -> tuple[fs.FileSystem, str]:
        store, root = file_system(self.path)
        return store, "/".join((root.rstrip("/"), *parts))

    def _put(self, folder: str, name: str, text: str) -> None:
        """A file that is there whole or not at all: it is moved to its name."""
        store, place = self._place(folder)
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/.{name}") as out:
            out.write(text.encode())
        store.move(f"{place}/.{name}", f"{place}/{name}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        last: dict[tuple, dict] = {}
        for row in iterator:
            wanted = {n: row[n] for n in NAMES}
            last[wanted["session_id"], wanted["window_index"], wanted["at_end"]] = wanted
        if not last:
            return Staged(None)
        name = f"{uuid.uuid4().hex}.json"
        self._put(STAGED, name, "\n".join(json.dumps(x) for x in last.values()))
        return Staged(name)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        names = [m.name for m in messages if m is not None and m.name]
        store, place = self._place(MANIFESTS, f"{batchId}.json")
        if store.get_file_info(place).type == fs.FileType.File:
            self._discard(names)  # the batch ran again after it was committed
        else:
            self._put(MANIFESTS, f"{batchId}.json", json.dumps({"batch": batchId, "files": names}))

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._discard([m.name for m in messages if m is not None and m.name])

    def _discard(self, names: list[str]) -> None:
        for name in names:
            store, place = self._place(STAGED, name)
            if store.get_file_info(place).type == fs.FileType.File:
                store.delete_file(place)


class ActuatorSink(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "actuator"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> ActuatorWriter:
        return ActuatorWriter(self.options["path"])


def commands(decided: DataFrame) -> DataFrame:
    """A stream of decisions as wanted states: where they change, and where a session ends muted."""
    rows = decided.filter("changed and not late")
    return rows.select(F.col("session_id").cast("string").alias("session_id"), "window_index", "timestamp", F.col("muted").alias("want_muted"), "at_end")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The wanted states of all committed batches, with the batch; staged files without a manifest are not read."""
    store, root = file_system(path)
    if store.get_file_info(f"{root.rstrip('/')}/{MANIFESTS}").type != fs.FileType.Directory:
        return spark.createDataFrame([], f"{SCHEMA}, batch long")
    manifests = spark.read.option("pathGlobFilter", "*.json").schema("batch long, files array<string>").json(f"{path}/{MANIFESTS}")
    named = manifests.select("batch", F.explode("files").alias("_file"))
    # The folder has files only where some batch had rows.
    if named.isEmpty():
        return spark.createDataFrame([], f"{SCHEMA}, batch long")
    rows = spark.read.option("pathGlobFilter", "*.json").schema(SCHEMA).json(f"{path}/{STAGED}").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(named, "_file").drop("_file")


def obeyed(windows: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Adds command_ok to windows: what the last acknowledgement (session_id, at, ok) at or before them says; true without one."""
    found = sequence.latest(windows, acknowledged.select("session_id", "at", F.col("ok").alias("command_ok")))
    return found.withColumn("command_ok", F.coalesce("command_ok", F.lit(True)))
