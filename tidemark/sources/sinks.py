"""Feature logs as files: fixed columns, one row a window."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("json", "csv", "parquet")


def _checked(kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"a log is one of {', '.join(FORMATS)}")
    return kind


def write_log(log: DataFrame, path: str, kind: str = "json") -> None:
    """Appends the rows; fields without a value are left out of JSON and empty in CSV."""
    log.write.mode("append").format(_checked(kind)).option("header", True).save(path)


def stream_log(log: DataFrame, path: str, checkpoint: str, kind: str = "json"):
    """Starts a query that appends the rows of a stream, each once."""
    return log.writeStream.format(_checked(kind)).option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
