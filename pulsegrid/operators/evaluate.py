"""Quality of alarms and of classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.statistics import safe_ratio
from pulsegrid.operators.labels import in_segment
from pulsegrid.operators.ordered import attach, running_sums

# Fixed value: the F1 that alarms are asked to reach.
TARGET_F1 = 0.8046


def f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def segment_metrics(
    df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", label: str = "label", alarm: str = "alarm",
    target: float = TARGET_F1, group_rows: int | None = None,
) -> DataFrame:
    """Recall over segments hit by an alarm, precision over alarms inside any segment.

    One result row per key for the keys that have rows.
    """
    marked = in_segment(df, keys, idx, label, group_rows)
    hit = F.col(alarm) == 1
    per_segment = marked.groupBy(*keys, "segment").agg(F.count_if(hit).alias("_alarms"))
    inside = F.col("segment").isNotNull()
    totals = per_segment.groupBy(*keys).agg(
        F.count_if(inside).alias("segments"),
        F.count_if(inside & (F.col("_alarms") > 0)).alias("detected"),
        F.coalesce(F.sum("_alarms"), F.lit(0)).alias("alarms"),
        F.coalesce(F.sum(F.when(inside, F.col("_alarms"))), F.lit(0)).alias("valid_alarms"),
    )
    return rated(totals, target)


def rated(totals: DataFrame, target: float = TARGET_F1) -> DataFrame:
    """Adds precision, recall, F1 and whether it meets the target to counts of segments, detected ones, alarms and valid ones."""
    shares = totals.withColumns(
        {
            "segment_precision": safe_ratio(F.col("valid_alarms"), F.col("alarms")),
            "segment_recall": safe_ratio(F.col("detected"), F.col("segments")),
        }
    ).withColumn("segment_f1", f1(F.col("segment_precision"), F.col("segment_recall")))
    return shares.withColumn("meets_target", F.col("segment_f1") >= target)


def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "label", predicted: str = "alarm") -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")
    )
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.withColumn("accuracy", safe_ratio(F.col("tp") + F.col("tn"), total))


def ranking_metrics(
    df: DataFrame, label: str = "label", score: str = "score", group_rows: int | None = None
) -> DataFrame:
    """Exact ROC AUC and average precision; 0 where only one class occurs.

    Rows are first counted per distinct score, so ties share one step of the curve.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")
    )
    ranked = running_sums(
        counts, [], [F.col(score).desc()], {"_tp": F.col("_p"), "_fp": F.col("_n")}, group_rows
    )
    sums = ranked.agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("negatives"),
        F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") / 2)).alias("_area"),
        F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_steps"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        "positives", "negatives",
        F.when(both, F.col("_area") / F.col("positives") / F.col("negatives")).otherwise(0.0).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("positives")).otherwise(0.0).alias("average_precision"),
    )


def confusion_table(df: DataFrame, label: str = "label", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table (actual, predicted, n)."""
    n, actual, predicted = F.col("n"), F.col("actual"), F.col("predicted")
    sides = table.select(
        *keys,
        F.explode(
            F.array(
                F.struct(actual.alias("class"), n.alias("support"), F.lit(0).alias("guessed"), F.when(actual == predicted, n).otherwise(0).alias("hit")),
                F.struct(predicted.alias("class"), F.lit(0).alias("support"), n.alias("guessed"), F.lit(0).alias("hit")),
            )
        ).alias("s"),
    )
    sums = sides.groupBy(*keys, "s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("_guessed"), F.sum("s.hit").alias("_hit")
    )
    return (
        sums.withColumns({"precision": safe_ratio(F.col("_hit"), F.col("_guessed")), "recall": safe_ratio(F.col("_hit"), F.col("support"))})
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .select(*keys, "class", "precision", "recall", "f1", "support")
    )


def report_averages(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted averages of a class report."""
    measures = ("precision", "recall", "f1")
    weight = F.sum("support")
    return report.groupBy(*keys).agg(
        weight.alias("support"),
        safe_ratio(F.sum(F.col("recall") * F.col("support")), weight).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[safe_ratio(F.sum(F.col(m) * F.col("support")), weight).alias(f"weighted_{m}") for m in measures],
    )


def fold_means(per_fold: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return per_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in measures])


def mean_reported(results: DataFrame, measure: str = "accuracy") -> DataFrame:
    """Mean of a measure over the models that report it."""
    return results.agg(F.avg(measure).alias(f"mean_{measure}"), F.count(measure).alias("models"))


def align_labels(windows: DataFrame, labels: DataFrame, key: str = "win_id", require: bool = True) -> DataFrame:
    """Window rows with their label; a missing label is an error, or normal where not required."""
    joined = windows.join(labels.select(key, "label"), key, "left")
    missing = F.raise_error(F.lit("window without label")).cast("int") if require else F.lit(0)
    return joined.withColumn("label", F.coalesce("label", missing))
