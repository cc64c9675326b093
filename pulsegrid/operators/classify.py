"""Classifiers, compared over folds."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import safe_ratio
from pulsegrid.operators.evaluate import f1
from pulsegrid.operators.ordered import attach, order_statistic
from pulsegrid.operators.reconstruct import standardise_array
from pulsegrid.operators.splits import plain_folds, shuffled_rank, stratified_folds
from pulsegrid.operators.vectors import fourier_features
from pulsegrid.storage import dealt, durable

# Seed, folds, phases of normal rows, share of outliers and of the sample, trees and layers of the models below.
SEED = 32
FOLDS = 10
NORMAL_PHASES = ("pre", "pos")
OUTLIER_SHARE = 0.05
SVM_SAMPLE = 0.3

#: Folds that are fitted at the same time.
FOLDS_AT_ONCE = 5

#: Random features of the kernel classifier, and the weight of its margin.
KERNEL_FEATURES, KERNEL_REGULARISATION = 256, 1e-3


def phase_label(kind: Column, phase: Column) -> Column:
    """0 for normal rows and for rows before or after an attack, else 1."""
    return F.when(phase.isin(*NORMAL_PHASES) | (kind == "normal"), 0).otherwise(1)


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Row weights that give every class the same total."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n, classes = df.agg(F.count(F.lit(1))).scalar(), sizes.agg(F.count(F.lit(1))).scalar()
    weights = durable(sizes.withColumn(out, n / (classes * F.col("_n"))), "weights")
    return attach(df, weights, [label], [out])


def stratified_sample(df: DataFrame, ids: Sequence[str], label: str, fraction: float, seed: int = SEED) -> DataFrame:
    """``fraction`` of every class, rounded up, chosen by hash, for estimators that take a sample."""
    sizes = durable(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    ranked = attach(shuffled_rank(df, ids, seed, [label]), sizes, [label], ["_n"])
    return ranked.where(F.col("rank") < F.ceil(F.col("_n") * F.lit(fraction))).drop("rank", "_n")


def models(features: int, classes: int) -> dict[str, tuple[Estimator, str]]:
    """Name -> (estimator, feature column); the columns are ``raw``, ``positive``, ``scaled`` and ``lifted``."""
    common = {"labelCol": "label", "predictionCol": "prediction"}
    svc = LinearSVC(featuresCol="scaled", standardization=False, maxIter=50, **common)
    return {
        "decision_tree": (DecisionTreeClassifier(featuresCol="raw", weightCol="weight", seed=SEED, **common), "raw"),
        "random_forest": (RandomForestClassifier(featuresCol="raw", numTrees=100, seed=SEED, **common), "raw"),
        "gaussian_nb": (NaiveBayes(featuresCol="raw", modelType="gaussian", **common), "raw"),
        "complement_nb": (NaiveBayes(featuresCol="positive", modelType="complement", smoothing=1.0, **common), "positive"),
        "mlp": (
            MultilayerPerceptronClassifier(
                featuresCol="scaled", layers=[features, 100, 50, classes], seed=SEED, maxIter=100, **common
            ),
            "scaled",
        ),
        "linear_svc": (svc, "scaled"),
        "sampled_svc": (svc, "scaled"),
        "kernel_svc": (LinearSVC(featuresCol="lifted", standardization=False, maxIter=50, regParam=KERNEL_REGULARISATION, **common), "lifted"),
    }


def prepare(train: DataFrame, df: DataFrame, array: str, lifted: int = 0) -> DataFrame:
    """Feature columns of ``df``; scaling and shift come from the training rows.

    ``lifted`` is the length of the arrays, if the features of the radial kernel are wanted: a linear margin on them is a curved one on
    the rows.
    """
    scaled = standardise_array(df, train, array, "_scaled")
    lowest = train.select(F.min(F.array_min(array).cast("double"))).scalar()
    numbers = F.transform(F.col(array), lambda x: x.cast("double"))
    positive = F.transform(numbers, lambda x: F.greatest(x - F.col("_low"), F.lit(0.0)))
    if lifted:
        scaled = fourier_features(scaled, "_scaled", lifted, KERNEL_FEATURES, out="_lifted")
    return scaled.withColumn("_low", lowest).select(
        *df.columns,
        *([array_to_vector("_lifted").alias("lifted")] if lifted else []),
        array_to_vector(numbers).alias("raw"),
        array_to_vector(positive).alias("positive"),
        array_to_vector("_scaled").alias("scaled"),
    )


def cross_predictions(
    df: DataFrame, ids: Sequence[str], array: str, length: int, names: Sequence[str], folds: int = FOLDS, classes: int = 2,
    group_rows: int | None = None,
) -> DataFrame:
    """Out-of-fold predictions (model, fold, ids, label, prediction) of the named models."""
    folded = durable(stratified_folds(df, ids, "label", folds, SEED, group_rows), "folds")
    size = folded.count()
    lifted = length if "kernel_svc" in names else 0

    def predicted(fold: int) -> DataFrame:
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        # Written before fitting: an estimator starts many small jobs, and each would ship the whole plan.
        train_rows = durable(dealt(balanced_weights(prepare(train, train, array, lifted)), ids, size), "train")
        test_rows = durable(prepare(train, test, array, lifted), "test")
        parts = []
        for name in names:
            estimator, _ = models(length, classes)[name]
            rows = stratified_sample(train_rows, ids, "label", SVM_SAMPLE) if name == "sampled_svc" else train_rows
            found = estimator.fit(rows).transform(test_rows)
            parts.append(found.select(F.lit(name).alias("model"), "fold", *ids, "label", F.col("prediction").cast("int").alias("prediction")))
        return durable(reduce(DataFrame.unionByName, parts), "predicted")

    # The passes of a fit are short jobs, one after the other, so several folds are fitted at a time to keep the cores busy.
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(predicted), range(folds)))
    return reduce(DataFrame.unionByName, found)


def one_class(
    df: DataFrame, ids: Sequence[str], array: str, length: int, folds: int = FOLDS, normal: int = 0, outliers: float = OUTLIER_SHARE,
    group_rows: int | None = None,
) -> DataFrame:
    """Per fold: precision, recall and F1 of the anomaly class for a boundary around normal rows.

    A row's score is its distance to the centre of the training normals in units of their deviation;
    the boundary leaves the share ``outliers`` of them outside. Each fold tests its held-out normals
    and all anomalies. All normals are used, so no sample size limits the fit.
    """
    is_normal = F.col("label") == normal
    folded = plain_folds(df.where(is_normal), ids, folds, SEED, group_rows).select(*ids, "fold", array)
    every_fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    numbers = F.posexplode(F.transform(F.col(array), lambda x: x.cast("double")))

    # Statistics of all folds but one are those of all rows less those of the fold: one pass over the rows.
    cells = folded.select("fold", numbers.alias("at", "x"))
    part = cells.groupBy("fold", "at").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    left_out = part.select(F.col("fold").alias("part"), "at", "n", "s", "ss").withColumn("fold", every_fold).where("part <> fold")
    moments = left_out.groupBy("fold", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    moments = moments.select("fold", "at", mean.alias("m"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
    listed = F.array_sort(F.collect_list(F.struct("at", "m", "sd")))
    centres = durable(moments.groupBy("fold").agg(listed.alias("centre")), "centres")

    rows = df.where(~is_normal).select(*ids, F.lit(None).cast("int").alias("own"), array).unionByName(
        folded.select(*ids, F.col("fold").alias("own"), array)
    )
    spread = attach(rows.withColumn("fold", every_fold), centres, ["fold"], ["centre"])
    parts = F.zip_with(
        F.transform(F.col(array), lambda x: x.cast("double")), "centre",
        lambda x, c: F.when(c["sd"] > 0, F.pow((x - c["m"]) / c["sd"], 2.0)).otherwise(0.0),
    )
    distance = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
    scored = durable(spread.select(*ids, "own", "fold", F.round(distance, 9).alias("distance")), "distances")
    train = scored.where("own is not null and own <> fold")
    limits = order_statistic(train, ["fold"], "distance", 1 - outliers, "boundary", interpolate=True, group_rows=group_rows)
    tested = attach(scored.where("own is null or own = fold"), durable(limits, "limits"), ["fold"], ["boundary"])
    actual, flagged = F.col("own").isNull(), F.col("distance") > F.col("boundary")
    counts = tested.groupBy("fold").agg(
        F.count_if(actual & flagged).alias("tp"), F.count_if(~actual & flagged).alias("fp"),
        F.count_if(~actual & ~flagged).alias("tn"), F.count_if(actual & ~flagged).alias("fn"),
    )
    rated = counts.withColumns(
        {"precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return rated.withColumn("f1", f1(F.col("precision"), F.col("recall")))


# 3 depths, 3 step sizes, 3 row shares, 5 folds.
BOOSTED_DEPTHS, BOOSTED_STEPS, BOOSTED_SHARES, BOOSTED_FOLDS = (3, 5, 7), (0.1, 0.01, 0.001), (0.5, 0.7, 1.0), 5

#: Models of the grid that are fitted at the same time.
BOOSTED_AT_ONCE = 4


def boosted_grid(
    train: DataFrame, features: str = "raw", depths: Sequence[int] = BOOSTED_DEPTHS, steps: Sequence[float] = BOOSTED_STEPS,
    shares: Sequence[float] = BOOSTED_SHARES, folds: int = BOOSTED_FOLDS, rounds: int = 20, parallelism: int = BOOSTED_AT_ONCE,
):
    """Boosted trees chosen by accuracy over a parameter grid with cross-validation."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    trees = GBTClassifier(featuresCol=features, labelCol="label", maxIter=rounds, seed=42)
    grid = (
        ParamGridBuilder()
        .addGrid(trees.maxDepth, list(depths))
        .addGrid(trees.stepSize, list(steps))
        .addGrid(trees.subsamplingRate, list(shares))
        .build()
    )
    accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    search = CrossValidator(
        estimator=trees, estimatorParamMaps=grid, evaluator=accuracy, numFolds=folds, seed=42, parallelism=parallelism
    )
    return search.fit(train)


def grid_results(fitted) -> list[tuple[int, float, float, float]]:
    """(depth, step, share, mean accuracy) of every grid point of a fitted search."""
    rows = []
    for params, accuracy in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics):
        named = {p.name: v for p, v in params.items()}
        rows.append((int(named["maxDepth"]), float(named["stepSize"]), float(named["subsamplingRate"]), float(accuracy)))
    return rows
