"""Every registered query with SQL gives the rows of its SQL twin."""

import pytest

from pulsegrid.plans.registry import registered
from tests.compare import difference, duck, spark_result, sql_result

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, q in registered().items() if q.sql))
def test_query(spark, con, name):
    q = registered()[name]
    assert difference(spark_result(q.run(spark, SF_DIR)), sql_result(con, q.sql)[0]) is None


def test_reconstruction_flags_a_hundredth_of_the_normal_rows(spark):
    rows = registered()["reconstruct_errors"].run(spark, SF_DIR).collect()
    normal = [r for r in rows if r.label == 0]
    assert len({r.vec_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert sum(r.alarm for r in normal) <= 0.01 * len(normal) + 1
    assert min(r.mae for r in rows if r.alarm) >= max(r.mae for r in rows if not r.alarm)


def test_window_reconstruction_counts_what_lies_above(spark):
    (r,) = registered()["window_reconstruct_errors"].run(spark, SF_DIR).collect()
    assert abs(r.threshold - (r.mean_error + 2 * r.std_error)) < 1e-5 and 0 < r.anomalies <= r.n / 4  # as Chebyshev has it


def test_margin_rates_every_fold(spark):
    rows = registered()["one_class_margin"].run(spark, SF_DIR).collect()
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    odd = sum(v == 0 for v in label.values())
    assert sorted(r.fold for r in rows) == list(range(10)) and all(r.tp + r.fn == odd for r in rows)
    assert sum(r.fp + r.tn for r in rows) == len(label) - odd
