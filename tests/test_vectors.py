"""Matrix steps, kernel features, the one-class margin, per-series regression and reconstruction against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import classify as C
from pulsegrid.operators import oneclass
from pulsegrid.operators import reconstruct as R
from pulsegrid.operators import scoring as S
from pulsegrid.operators import vectors as V
from pulsegrid.operators.oneclass import NU, margin_scores


def arrays(spark, x, label=None):
    label = np.zeros(len(x), dtype=int) if label is None else label
    return spark.createDataFrame([(i, int(c), [float(v) for v in row]) for i, (row, c) in enumerate(zip(x, label))], "id long, label int, x array<double>")


def rings(n=400, seed=1):
    """Two rings, one inside the other: no line parts them."""
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    radius, angle = np.where(label == 1, 1.0, 3.0) + rng.normal(scale=0.1, size=n), rng.uniform(0, 2 * np.pi, n)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), label


def test_matrix_sums_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(500, 3))
    df = arrays(spark, x, np.arange(500) % 4).repartition(7)
    step = lambda g, m: np.stack([m[g == i].sum(axis=0) for i in range(4)]).ravel()
    got = V.matrix_sums(df, "x", "label", 12, step).reshape(4, 3)
    assert np.allclose(got, [x[i::4].sum(axis=0) for i in range(4)])
    assert V.matrix_sums(df.where("false"), "x", "label", 12, step).tolist() == [0.0] * 12
    assert V.with_matrix(df.where("false"), "x", "y double", lambda m: (m.sum(axis=1),)).count() == 0


def test_inner_products_approach_the_kernel(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    z = np.array([r["lifted"] for r in V.fourier_features(arrays(spark, x), "x", 3, 20_000, gamma=0.5).orderBy("id").collect()])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_kernel_margin_parts_rings_that_a_line_cannot(spark):
    x, label = rings()
    df = arrays(spark, x, label)
    found = {}
    for name in ("linear_svc", "kernel_svc"):
        rows = C.cross_predictions(df, ["id"], "x", 2, [name], folds=3).collect()
        assert sorted(r["id"] for r in rows) == list(range(len(x)))
        found[name] = np.mean([r["label"] == r["prediction"] for r in rows])
    assert found["kernel_svc"] > 0.97 and found["linear_svc"] < 0.7


class Asked:
    """Takes the place of an estimator: keeps how many rows each task of a pass over its table reads, and predicts the label."""

    seen = []

    def fit(self, rows):
        Asked.seen.append([r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()])
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", F.col("label"))


def test_fits_read_their_rows_in_several_tasks(spark, monkeypatch):
    """Folds come out of a window, which leaves a small table in one file."""
    x = np.random.default_rng(4).normal(size=(4_000, 2))
    monkeypatch.setattr(C, "models", lambda features, classes: {"asked": (Asked(), "raw")})
    Asked.seen = []
    rows = C.cross_predictions(arrays(spark, x, np.arange(4_000) % 2), ["id"], "x", 2, ["asked"], folds=4).collect()
    assert sorted(r["id"] for r in rows) == list(range(4_000)) and {r["fold"] for r in rows} == {0, 1, 2, 3}
    assert len(Asked.seen) == 4 and all(sum(n) == 3_000 and len(n) >= 4 and max(n) < 1_200 for n in Asked.seen)


def test_margin_passes_read_their_rows_in_several_tasks(spark, monkeypatch):
    x, label = rings(4_000, 3)
    seen = []

    def sums(df, array, group, size, step):
        seen.append(df.select(F.spark_partition_id()).distinct().count())
        return V.matrix_sums(df, array, group, size, step)

    monkeypatch.setattr(oneclass, "matrix_sums", sums)
    rated, _ = margin_scores(arrays(spark, x, label), ["id"], "x", 2, 5, features=16, steps=2)
    assert rated.agg(F.sum("tp") + F.sum("fn")).first()[0] == 5 * 2_000 and min(seen) >= 4


@pytest.mark.parametrize("nu", [NU, 0.2])
def test_share_outside_the_margin_is_nu(spark, nu):
    """Normal rows on a ring; the odd ones lie in its middle, where a distance from the centre would be least."""
    x, label = rings(600, 3)
    x[label == 1] /= 4
    rated, outside = margin_scores(arrays(spark, x, label), ["id"], "x", 2, 5, nu=nu, features=400, gamma=2.0)
    assert np.abs(outside - nu).max() < 0.01
    for r in rated.collect():
        assert r["tp"] + r["fn"] == 300 and r["fp"] + r["tn"] == 60
        assert r["recall"] > 0.95 and r["fp"] < 60 * (nu + 0.15)


def test_models_per_series_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key, scale in (("a", 1.0), ("b", 1e4), (None, 1e-3)):
        x = rng.normal(size=(80, 3)) * scale
        y = 2 * scale + x @ [1.0, -2.0, 0.5] + rng.normal(size=80) * scale / 10
        want[key] = np.linalg.lstsq(np.c_[np.ones(80), x], y, rcond=None)[0]
        rows += [(key, float(v), *map(float, r)) for v, r in zip(y, x)]
    # A constant series: its lags say nothing that the intercept does not.
    rows += [("flat", 5.0, 3.0, 3.0, 3.0)] * 20 + [("a", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, v double, lag_1 double, lag_2 double, lag_3 double")
    fitted = S.fit_lag_regression(df, ["key"], "v", 4)
    got = {r["key"]: r for r in fitted.collect()}
    assert {k: r["n"] for k, r in got.items()} == {"a": 80, "b": 80, None: 80, "flat": 20}
    for key, coefficients in want.items():
        assert np.allclose(got[key]["coefficients"], coefficients, rtol=1e-6)
    flat = S.predict_lag_regression(fitted, df.where("key = 'flat'"), ["key"], "v", 4).first()
    assert abs(flat["v_pred"] - 5.0) < 1e-6


def test_reconstruction_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    x -= x.mean(axis=0)
    df = arrays(spark, x).withColumnRenamed("x", "scaled")
    values, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, np.argsort(values)[::-1][:4]]
    for components, matrix in ((R.fit_components(df), basis), (R.cosine_components(6), R.cosine_components(6))):
        got = R.reconstruction_errors(df, components).orderBy("id").collect()
        rest = x - x @ matrix @ matrix.T
        assert np.allclose([r["mae"] for r in got], np.abs(rest).mean(axis=1)) and np.allclose([r["mse"] for r in got], (rest**2).mean(axis=1))
    with pytest.raises(ValueError):
        R.reconstruction_errors(df, np.ones((6, 2)))


def test_null_arrays_are_refused(spark):
    df = spark.createDataFrame([(1, None)], "id int, x array<double>")
    with pytest.raises(Exception, match="null among the arrays"):
        V.with_matrix(df, "x", "y double", lambda m: (m.sum(axis=1),)).collect()
