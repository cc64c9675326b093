"""Model queries: what is fitted, without fitting it."""

from itertools import product

from pyspark.ml import tuning
from pyspark.sql import functions as F

from pulsegrid.operators import classify as C
from pulsegrid.plans.registry import registered


class Search:
    """Takes the place of the cross-validation and keeps what it was asked for."""

    def __init__(self, **asked):
        Search.asked = asked
        self.avgMetrics = [0.5] * len(asked["estimatorParamMaps"])

    def fit(self, train):
        return self

    def getEstimatorParamMaps(self):
        return self.asked["estimatorParamMaps"]


def test_boosted_grid_is_whole(spark, monkeypatch):
    monkeypatch.setattr(tuning, "CrossValidator", Search)
    rows = registered()["boosted_grid"].run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.max_depth, r.step, r.share) for r in rows) == sorted(product((3, 5, 7), (0.1, 0.01, 0.001), (0.5, 0.7, 1.0)))
    assert Search.asked["numFolds"] == C.BOOSTED_FOLDS == 5
    assert Search.asked["estimator"].getMaxIter() == 20


def test_boosted_fits_share_the_cores(spark, monkeypatch, folder):
    """Each part of the table sends the bins of every level of every tree, so the parts must not grow with the table."""
    parts = []

    class Counted(Search):
        def fit(self, train):
            parts.append(train.select(F.spark_partition_id()).distinct().count())
            assert train.count() == 20_000
            return self

    monkeypatch.setattr(tuning, "CrossValidator", Counted)
    vectors = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    vectors.repartition(40).write.parquet(f"{folder}/embeddings.parquet")
    assert registered()["boosted_grid"].run(spark, folder).count() == 27
    assert parts == [max(1, spark.sparkContext.defaultParallelism // C.BOOSTED_AT_ONCE)]
