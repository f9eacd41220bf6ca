"""A detector that is learned: a model's score of each window takes the place of the level rules.

The model is fitted by Spark on training rows and scores windows as a column, so
learning and scoring are whole-table work; only the edges (when an ad begins and
ends) are stepped in order, by a `fold.Detector`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config, Detection
from tidemark.functions.signal import FLOOR_DB
from tidemark.operators import fold, sequence

#: What the model sees of a window; differences from the baseline are 0 while there is none, or none that is finite.
INPUTS = (
    "rms_dbfs", "crest_db", "spectral_centroid_hz", "zero_crossing_rate", "silence_ratio", "max_silence_run_seconds",
    "delta_rms_db", "delta_crest_db", "delta_centroid_ratio", "recent_gap",
)
SCORE = "ad_score"


def inputs(rows: DataFrame) -> DataFrame:
    """Adds the model's inputs to training rows or to windows with deltas and seconds_since_gap."""
    gap = F.exp(-F.coalesce("seconds_since_gap", F.lit(1e9)) / 10.0)
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    known = {c: F.coalesce(finite(c), F.lit(0.0)) for c in INPUTS if c != "recent_gap"}
    level = F.when(F.col("rms_dbfs") == float("-inf"), FLOOR_DB).otherwise(known["rms_dbfs"])
    return rows.withColumns(known | {"rms_dbfs": level, "recent_gap": gap})


def fit(training: DataFrame, regularization: float = 0.01) -> PipelineModel:
    """A logistic regression on training rows (is_ad); ads and content weigh the same in all, however few there are."""
    rows = inputs(training)
    n = rows.agg(F.sum("is_ad").alias("ads"), F.count("*").alias("all")).first()
    if not n.ads or n.ads == n["all"]:
        raise ValueError("training needs ads and content")
    weight = F.when(F.col("is_ad") == 1, n["all"] / (2 * n.ads)).otherwise(n["all"] / (2 * (n["all"] - n.ads)))
    stages = [
        VectorAssembler(inputCols=list(INPUTS), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol="is_ad", weightCol="_weight", regParam=regularization, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def scored(windows: DataFrame, model: PipelineModel, cfg: Detection) -> DataFrame:
    """Adds ad_score, the model's probability that a window is an ad, to windows (with session_id, epoch and chunk)."""
    clocked = sequence.seconds_since_gap(sequence.session_clock(windows), cfg)
    rows = inputs(sequence.feature_deltas(sequence.ema_baseline(clocked, cfg.baseline_alpha)))
    told = model.transform(rows).withColumn(SCORE, vector_to_array("probability")[1])
    return told.select(*windows.columns, SCORE)


def rank_score(windows: DataFrame, labels: DataFrame) -> float:
    """The area under the curve of scored windows against their labels (session_id, window_index, is_ad): 0.5 is chance."""
    return BinaryClassificationEvaluator(rawPredictionCol=SCORE, labelCol="is_ad").evaluate(windows.join(labels, ["session_id", "window_index"]))


@dataclass
class Scored:
    """Edges by scores: an ad begins at one over `enter`, and ends after windows under `stay`, with the rules' spans of time."""

    enter: float = 0.6
    stay: float = 0.4

    def reset(self, s: fold.State) -> None:
        s.forget_all()

    def reject(self, s: fold.State) -> None:
        s.forget_ad()

    def update(self, s: fold.State, w: Mapping, t: float, config: Config) -> fold.Decision:
        cfg, score = config.detection, w[SCORE] or 0.0
        bar = self.stay if s.in_ad else self.enter
        d = fold.Decision(event=fold.NONE, ad_profile=score >= bar and not w["is_silence"], confidence=round(score, 3), reason=f"score {score:.3f}", loudness_threshold_db=bar)
        if not s.in_ad:
            if d.ad_profile:
                s.in_ad, s.ad_started_at, s.streak, d.event = True, t, 0, fold.STARTED
            return d
        elapsed = d.ad_elapsed_seconds = t - s.ad_started_at
        s.streak = 0 if d.ad_profile else s.streak + 1
        if elapsed >= cfg.max_ad_seconds or (s.streak >= cfg.ad_end_windows and elapsed >= cfg.min_ad_seconds):
            s.forget_ad()
            d.event, d.ad_profile = fold.ENDED, False
        return d
