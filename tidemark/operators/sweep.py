"""Parameter sweeps: features once, folds of all sessions and configs in parallel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config, ConfigError
from tidemark.operators import detect, intervals
from tidemark.sources import tables


def configs(base: Config, key: str, values: Iterable[str]) -> tuple[list[Config], list[str]]:
    """The configs that are valid, and the values that are not."""
    good, bad = [], []
    for value in values:
        try:
            good.append(base.override({key: value}))
        except ConfigError:
            bad.append(value)
    return good, bad


def grid(base: Config, swept: Mapping[str, Iterable[str]], fixed: Mapping[str, str] | None = None) -> tuple[list[Config], list[dict[str, str]], list[dict[str, str]]]:
    """Configs of all combinations of the swept settings' values, over `fixed` ones; the settings of each, by config_id, and those that are not valid.

    A combination is judged as a whole, so values may depend on each other.
    """
    start = base.override(dict(fixed or {}))
    tried, settings, bad = [], [], []
    for values in product(*swept.values()):
        own = dict(zip(swept, values))
        try:
            tried.append(start.override(own))
            settings.append(own)
        except ConfigError:
            bad.append(own)
    return tried, settings, bad


def named(spark: SparkSession, scores: DataFrame, settings: list[dict[str, str]]) -> DataFrame:
    """Scores by config_id with each config's settings as columns."""
    names = sorted({k for own in settings for k in own})
    rows = spark.createDataFrame([(i, *(own.get(n) for n in names)) for i, own in enumerate(settings)], ", ".join(["config_id int", *(f"`{n}` string" for n in names)]))
    return scores.join(F.broadcast(rows), "config_id")


def sweep(windows: DataFrame, tried: list[Config], breaks: DataFrame, sessions: DataFrame) -> DataFrame:
    """config_id and pooled scores of each config.

    Each window is shuffled once and folded for all configs; `breaks` and
    `sessions` (session_id, duration) are repeated for each. The spans are a
    table while they are scored, or each score would fold again.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(len(tried) - 1))).alias("config_id")
    keys = ("session_id", "config_id")
    mutes = tables.written(detect.mute_spans(detect.decisions(windows, tried, columns=("muted",)), keys=keys), "mutes")
    own = breaks.select("*", each)
    scores = intervals.score_sessions(sessions.select("*", each), mutes, own, keys)
    return intervals.score_totals(scores, intervals.break_latency(mutes, own, keys), ("config_id",))


def skipped(tried: Iterable[str], bad: list[str]) -> str:
    """What a sweep reports of the values that are not valid; empty if all are."""
    n = len(list(tried))
    return f"{len(bad)} of {n} values skipped as invalid: {', '.join(bad)}" if bad else ""
