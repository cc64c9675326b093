"""Ordered computations against pandas, with one key that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ordered as O


def skewed(n=400, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    value = np.where(rng.random(n) < 0.3, np.nan, np.round(rng.normal(size=n), 3))
    return pd.DataFrame({"key": key, "at": rng.permutation(n), "value": value})


def frame(spark, pdf):
    rows = [(k, int(a), None if np.isnan(v) else float(v)) for k, a, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, at long, value double")


def result(df, columns):
    return {r["at"]: tuple(r[c] for c in columns) for r in df.collect()}


def check_all(spark):
    pdf = skewed()
    df = frame(spark, pdf)
    want = pdf.sort_values("at").copy()
    g = want.groupby("key", dropna=False)
    want["pos"] = g.cumcount()
    want["total"] = want["value"].fillna(0).groupby(want["key"].fillna("?")).cumsum()
    want["back"] = g["value"].ffill()
    want["ahead"] = g["value"].bfill()
    want["mean3"] = want["value"].groupby(want["key"].fillna("?")).transform(lambda s: s.rolling(3, min_periods=1).mean())

    assert {k: v[0] for k, v in result(O.positions(df, ["key"], ["at"]), ["pos"]).items()} == dict(zip(want["at"], want["pos"]))

    sums = result(O.running_sums(df, ["key"], ["at"], {"total": F.coalesce("value", F.lit(0.0))}), ["total"])
    assert all(abs(sums[a][0] - t) < 1e-9 for a, t in zip(want["at"], want["total"]))

    for name, backward in (("back", False), ("ahead", True)):
        got = result(O.last_known(df, ["key"], ["at"], {"x": F.col("value")}, backward=backward), ["x"])
        for a, t in zip(want["at"], want[name]):
            assert got[a][0] == (None if np.isnan(t) else t)

    def mean3(rows, w):
        return rows.withColumn("m", F.avg("value").over(w.rowsBetween(-2, 0)))

    got = result(O.row_frames(df, ["key"], ["at"], 2, 0, mean3), ["m"])
    assert len(got) == len(pdf)
    for a, t in zip(want["at"], want["mean3"]):
        assert (got[a][0] is None and np.isnan(t)) or abs(got[a][0] - t) < 1e-9


def test_small_keys(spark):
    check_all(spark)


def test_large_key_is_split(spark, small_groups):
    assert O.split_runs(frame(spark, skewed()), ["key"], ["at"]).select(O.RUN).distinct().count() > 10
    check_all(spark)


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.95, 0.99])
def test_order_statistic(spark, small_groups, q):
    pdf = skewed(500, 7)
    df = frame(spark, pdf)
    got = {r["key"]: r for r in O.order_statistic(df, ["key"], "value", q, "x").collect()}
    line = {r["key"]: r for r in O.order_statistic(df, ["key"], "value", q, "x", interpolate=True).collect()}
    for key, part in pdf.groupby("key", dropna=False):
        values = np.sort(part["value"].dropna().to_numpy())
        key = None if pd.isna(key) else key
        assert got[key]["n"] == values.size
        assert got[key]["x"] == values[int(q * values.size)]
        assert abs(line[key]["x"] - np.quantile(values, q)) < 1e-9


def test_order_statistic_with_one_heavy_value(spark, small_groups):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = np.sort([r[0] for r in df.collect()])
    for q in (0.1, 0.34, 0.9):
        assert O.order_statistic(df, [], "v", q, "x").first()["x"] == values[int(q * 900)]


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]


def test_tasks_stay_small_when_many_keys_are(spark):
    """Adaptive execution would join the partitions of all keys, or runs, as they are a few kilobytes."""
    spark.conf.set(O.MAX_GROUP_ROWS, "400")
    try:
        keys = spark.range(2_400).select((F.col("id") % 24).alias("key"), F.col("id").alias("at"))
        placed = O.positions(keys, ["key"], ["at"])
        assert most_in_a_task(placed) <= 800 and placed.agg(F.sum("pos")).first()[0] == 24 * sum(range(100))
        one = spark.range(2_400).select(F.lit(0).alias("key"), F.col("id").alias("at"))
        for rows in (O.positions(one, ["key"], ["at"]), O.running_sums(one, ["key"], ["at"], {"pos": F.lit(1)}), O.last_known(one, ["key"], ["at"], {"pos": F.col("at")})):
            assert most_in_a_task(rows) <= 1_400 and rows.count() == 2_400
    finally:
        spark.conf.unset(O.MAX_GROUP_ROWS)
