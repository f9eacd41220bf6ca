"""Queries against their SQL, to the last bit, on windows without any sound: their level is minus infinity."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import rules, sequence, trained
from tidemark.plans import signal_queries


@pytest.fixture(scope="module")
def soundless(sf_dir, tmp_path_factory):
    """The smallest events; every 23rd has no sound, so that sessions have several such windows."""
    import duckdb

    folder = tmp_path_factory.mktemp("soundless")
    con = duckdb.connect()
    con.execute(f"""copy (select * replace (case when event_id % 23 = 5 then 0 else value end as value) from '{sf_dir}/events.parquet') to '{folder}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con, str(folder)


def plain(rows):
    return sorted(tuple("" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["feature_log_rows", "feature_deltas", "ema_baseline", "detector_decisions", "decision_log", "controller_states", "epoch_features", "gated_states", "detector_events", "ad_coverage", "break_latency", "false_mute", "cue_active", "cue_candidates"])
def test_query(spark, soundless, name):
    con, folder = soundless
    want = con.execute(signal_queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = signal_queries.QUERIES[name](spark, folder).select(*(f"`{c}`" for c in names)).collect()
    assert got and plain(map(tuple, got)) == plain(want.fetchall())


def test_bars():
    endless = -math.inf
    assert rules.reaches(rules.less(endless, endless), 2.0) and not rules.reaches(rules.less(endless, -20.0), 2.0)
    assert rules.reaches(rules.less(-20.0, endless), 2.0) and not rules.reaches(rules.less(None, -20.0), 2.0)


def test_inputs_of_a_model_are_finite(spark):
    """A window without sound is at the floor; no finite baseline, no difference."""
    values = dict.fromkeys(trained.INPUTS[1:-1], 1.0) | {"seconds_since_gap": 0.0, "rms_dbfs": -math.inf, "delta_rms_db": -math.inf}
    rows = [values, values | {"rms_dbfs": math.nan, "delta_rms_db": math.nan}, values | {"rms_dbfs": -20.0, "delta_rms_db": 3.0}]
    schema = ", ".join(f"{c} double" for c in values)
    got = trained.inputs(spark.createDataFrame([tuple(r[c] for c in values) for r in rows], schema)).select("rms_dbfs", "delta_rms_db").collect()
    assert sorted(map(tuple, got)) == [(-120.0, 0.0), (-20.0, 3.0), (0.0, 0.0)]


@pytest.mark.parametrize("alpha", [0.05, 0.9, 1.0])
def test_an_endless_level_stays_in_the_baseline(spark, alpha):
    """As the recursion has it, also many blocks later, where finite values have faded."""
    n = 6000
    rows = pd.DataFrame({"session_id": 1, "epoch": np.arange(n) // 4800, "window_index": np.arange(n), "is_silence": np.arange(n) % 7 == 0, "rms_dbfs": np.arange(n) % 50 - 60.0,
                         "crest_db": np.arange(n) % 9 + 5.0, "spectral_centroid_hz": np.arange(n) % 97 + 500.0})
    rows.loc[100, "rms_dbfs"], rows.loc[200, "crest_db"], rows.loc[2500, "crest_db"] = -math.inf, -math.inf, math.inf
    names = ["baseline_rms_dbfs", "baseline_crest_db", "baseline_centroid_hz"]
    got = sequence.ema_baseline(spark.createDataFrame(rows), alpha).toPandas().sort_values("window_index")[names].to_numpy(float)
    want, base = np.full((n, 3), np.nan), None
    for i, (silent, epoch, *x) in enumerate(rows[["is_silence", "epoch", "rms_dbfs", "crest_db", "spectral_centroid_hz"]].itertuples(index=False, name=None)):
        base = None if i and epoch != rows.epoch[i - 1] else base
        want[i] = np.nan if base is None else base
        if not silent:
            with np.errstate(invalid="ignore"):
                base = np.array(x) if base is None else (1 - alpha) * base + alpha * np.array(x)
    assert np.isinf(want[4700, 0]) or alpha == 1
    assert np.allclose(got, want, rtol=1e-11, atol=1e-9, equal_nan=True)
