"""A learned detector: better than chance on sessions that it has not seen, and the fold's like any other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Detection
from tidemark.functions import kernels
from tidemark.operators import detect, intervals, trained
from tidemark.plans import signal_queries


@pytest.fixture(scope="module")
def made(spark):
    """Sessions whose ads are louder and flatter; features by rule, labels apart."""
    rng, rows, spans = np.random.default_rng(5), [], []
    for session in range(8):
        ads = np.zeros(240, bool)
        for start in (60, 150):
            start += int(rng.integers(20))
            ads[start : start + 40] = True
            spans.append((session, 0, float(start), float(start + 40), "ad"))
        for i, ad in enumerate(ads):
            level = rng.normal(-17 if ad else -21, 2.0)
            values = dict.fromkeys(kernels.NAMES, 0.0) | {"rms_dbfs": level, "crest_db": rng.normal(8 if ad else 11, 1.5), "spectral_centroid_hz": rng.normal(2300 if ad else 2000, 250),
                                                            "is_silence": False, "duration_seconds": 1.0}
            rows.append({"session_id": session, "epoch": 0, "window_index": i, "timestamp": float(i), "chunk": 0} | values)
    windows = spark.createDataFrame(pd.DataFrame(rows))
    return windows, spark.createDataFrame(spans, "session_id long, chunk long, start double, end double, label string")


def test_held_out_sessions(spark, made):
    windows, spans = made
    cfg = Detection()
    from tidemark.operators import dataset

    training = dataset.training_rows(windows.filter("session_id < 6"), spans.filter("session_id < 6"), cfg)
    model = trained.fit(training)
    held = trained.scored(windows.filter("session_id >= 6"), model, cfg)
    labels = intervals.label_windows(windows.filter("session_id >= 6"), spans).select("session_id", "window_index", (F.col("label") == "ad").cast("double").alias("is_ad"))
    assert held.columns == [*windows.columns, trained.SCORE] and held.count() == 480
    assert trained.rank_score(held, labels) > 0.95
    got = detect.decisions(held, signal_queries.CONFIG, detector=trained.Scored(), columns=("event", "muted", "ad_profile"))
    muted = got.join(labels, ["session_id", "window_index"]).groupBy("is_ad").agg(F.avg(F.col("muted").cast("double")).alias("share")).collect()
    share = {r.is_ad: r.share for r in muted}
    assert share[1.0] > 0.6 and share[0.0] < 0.2
    with pytest.raises(ValueError, match="ads and content"):
        trained.fit(training.filter("is_ad = 0"))


def test_query(spark, sf_dir):
    got = signal_queries.QUERIES["trained_states"](spark, sf_dir).collect()
    assert {r.session_id % 4 for r in got} == {3} and {r.event for r in got} <= {"AD_STARTED", "AD_ENDED", "NO_CHANGE"}
    assert all(0 <= r.ad_score <= 1 for r in got) and any(r.muted for r in got)
