"""Sweeps of configs and seeds, up to their thresholds."""

from pulsegrid.operators import experiments as X
from pulsegrid.operators.splits import supervised_split
from pulsegrid.plans.experiments import config_sweep_trials

KEYS = ["config", "seed"]
SF_DIR = "/root/testdata/sf0.001"


def test_the_share_of_train_is_a_column(spark):
    rows = [(c, i, int(i >= 40), r) for c, r in (("a", 0.5), ("b", 0.75)) for i in range(60)]
    df = spark.createDataFrame(rows, "config string, win_id int, label int, ratio double")
    got = {r.config: r["count"] for r in supervised_split(df, ["win_id"], train_ratio="ratio", keys=["config"]).where("split = 'train'").groupBy("config").count().collect()}
    assert got == {"a": 20, "b": 30}


def test_thresholds_are_those_of_the_config(spark):
    """100 train scores 0..99; the test windows 0..9 have two segments, and the higher quantile detects one of them."""
    rows = []
    for config, quantile, risk in (("low", 0.5, 0.5), ("high", 0.9, 0.1)):
        rows += [(config, 1, quantile, risk, "train", i, 0, float(i)) for i in range(100)]
        rows += [(config, 1, quantile, risk, "test", 200 + i, label, s) for i, (label, s) in enumerate([(0, 1.0), (1, 80.0), (1, 2.0), (0, 70.0), (0, 3.0), (1, 500.0)])]
    df = spark.createDataFrame(rows, "config string, seed int, quantile double, risk double, split string, win_id int, label int, score double")
    got = {r.config: (r.segments, r.detected, r.alarms, r.valid_alarms) for r in X.split_trials(df, KEYS, ["win_id"]).collect()}
    assert got == {"low": (2, 2, 3, 2), "high": (2, 1, 1, 1)}


def test_every_config_and_seed_is_rated(spark):
    rows = config_sweep_trials(spark, SF_DIR).collect()
    assert len(rows) == 6
    assert all((r.segments is None) == (r.error is not None) == (r.config == "broken") for r in rows)
    assert all(r.valid_alarms <= r.alarms and r.detected <= r.segments for r in rows if r.error is None)
