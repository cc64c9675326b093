"""Bounded gap filling equals pandas."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators.timegrid import fill_gaps


def twin(values, unlimited):
    s = pd.Series(values, dtype=float)
    s = s.ffill(limit=3).interpolate(method="linear", limit=10, limit_direction="both").bfill(limit=3)
    return s.ffill().bfill() if unlimited else s


def series(seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=160), 3)
    at = 0
    while at < 160:
        gap = int(rng.integers(1, 45))
        values[at + 1 : at + 1 + gap] = np.nan
        at += gap + int(rng.integers(1, 4))
    if seed % 2:
        values[: int(rng.integers(1, 25))] = np.nan
    return values


@pytest.mark.parametrize("unlimited", [True, False])
@pytest.mark.parametrize("size", [None, "16"])
def test_fill_equals_pandas(spark, unlimited, size):
    if size:
        spark.conf.set("spark.pulsegrid.maxGroupRows", size)
    try:
        data = {f"m{s}": series(s) for s in range(4)} | {"empty": np.full(160, np.nan), "one": np.r_[np.full(60, np.nan), 2.0, np.full(99, np.nan)]}
        rows = [(m, i, None if np.isnan(v) else float(v)) for m, vs in data.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "metric string, ts long, value double")
        got = {(r["metric"], r["ts"]): r["value"] for r in fill_gaps(df, unlimited=unlimited).collect()}
    finally:
        spark.conf.unset("spark.pulsegrid.maxGroupRows")
    for metric, values in data.items():
        for i, want in enumerate(twin(values, unlimited)):
            have = got[metric, i]
            assert (have is None and np.isnan(want)) or abs(have - want) < 1e-9, (metric, i, have, want)
