"""Parameter trials on score tables and the ledger of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.evaluate import rated
from pulsegrid.operators.labels import in_segment
from pulsegrid.operators.ordered import attach, positions
from pulsegrid.operators.splits import shuffle_key
from pulsegrid.operators.threshold import alarm_level, fit_tails
from pulsegrid.storage import durable

LEDGER_SCHEMA = (
    "experiment string, run string, parent string, params map<string,string>, metrics map<string,double>, error string, ts timestamp"
)


def parameter_grid(spark: SparkSession, space: Mapping[str, Sequence[Any] | Any]) -> DataFrame:
    """All combinations of the values; ``depth`` is null where ``spot_type`` is SPOT.

    Every parameter is exploded from an array literal in turn, so the grid is built from one row.
    """
    grid = spark.range(1).select()
    for name, values in space.items():
        values = values if isinstance(values, (list, tuple)) else [values]
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    if {"spot_type", "depth"} <= set(grid.columns):
        grid = grid.withColumn("depth", F.when(F.col("spot_type") != "SPOT", F.col("depth"))).distinct()
    return grid


def sample_grid(grid: DataFrame, evaluations: int, seed: int) -> DataFrame:
    """At most ``evaluations`` combinations, chosen by hash of seed and values."""
    names = grid.columns
    hashed = grid.withColumn("_h", shuffle_key(seed, *names))
    return hashed.orderBy("_h", *names).limit(evaluations).drop("_h")


def threshold_trials(
    baseline: DataFrame,
    stream: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    idx: str = "idx",
    label: str = "label",
    score: str = "score",
    group_rows: int | None = None,
) -> DataFrame:
    """Segment metrics of every (quantile, risk) of ``grid`` on a labelled score stream, per key, with the threshold of the trial.

    Only thresholds differ between trials, so a trial is a row of the threshold table: the fits of all quantiles share one pass over the
    baseline, and all trials one pass over the stream (``trial_counts``).
    """
    quantiles = [r["quantile"] for r in grid.select("quantile").distinct().orderBy("quantile").collect()]
    fits = durable(fit_tails(baseline, keys, score, quantiles, group_rows=group_rows), "fits")
    levels = fits.join(F.broadcast(grid.select("quantile", F.col("risk").cast("double").alias("risk"))), "quantile")
    levels = levels.select(*keys, "quantile", "risk", alarm_level(F.col("risk")).alias("threshold"))
    return rated(trial_counts(in_segment(stream, keys, idx, label, group_rows), levels, keys, ["quantile", "risk"], score))


def trial_counts(marked: DataFrame, levels: DataFrame, keys: Sequence[str], trial: Sequence[str], score: str = "score") -> DataFrame:
    """Segments, detected segments, alarms and valid alarms of every row (keys, trial columns, threshold) of ``levels``.

    No row is repeated per trial. A row of ``marked`` (its segment or null) counts once, under the number of its key's thresholds that it
    passes, and a segment once, under the number that its highest score passes; what a trial finds is then a sum over a short range of
    these numbers. A null threshold is never passed.
    """
    levels = durable(levels.select(*keys, *trial, "threshold"), "levels")
    cuts = levels.groupBy(*keys).agg(F.array_sort(F.collect_set("threshold")).alias("_cuts"))
    passed = F.size(F.filter("_cuts", lambda t: F.coalesce(F.col(score) > t, F.lit(False))))
    cells = durable(marked.join(cuts, list(keys)).groupBy(*keys, "segment", passed.alias("_passed")).agg(F.count(F.lit(1)).alias("_c")), "cells")
    inside = F.col("segment").isNotNull()
    rows = cells.groupBy(*keys, "_passed").agg(F.sum("_c").alias("alarms"), F.sum(F.when(inside, F.col("_c")).otherwise(0)).alias("valid_alarms"))
    highest = cells.where(inside).groupBy(*keys, "segment").agg(F.max("_passed").alias("_passed"))
    found = rows.join(highest.groupBy(*keys, "_passed").agg(F.count(F.lit(1)).alias("segments")), [*keys, "_passed"], "left")
    tally = found.groupBy(*keys).agg(F.collect_list(F.struct("_passed", "alarms", "valid_alarms", F.coalesce("segments", F.lit(0)).alias("segments"))).alias("_tally"))
    placed = levels.join(cuts, list(keys)).join(tally, list(keys)).withColumn("_at", F.array_position("_cuts", F.col("threshold")))

    def total(field: str, least) -> Column:
        return F.aggregate(F.filter("_tally", lambda x: x["_passed"] >= least), F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    return placed.select(
        *keys, *trial, "threshold", total("segments", F.lit(0)).alias("segments"), total("segments", F.col("_at")).alias("detected"),
        total("alarms", F.col("_at")).alias("alarms"), total("valid_alarms", F.col("_at")).alias("valid_alarms"),
    )


def split_trials(
    windows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "label", score: str = "score", group_rows: int | None = None,
) -> DataFrame:
    """Segment metrics per key on the test windows, with thresholds fitted on its train windows, and the thresholds.

    ``windows`` are the whole timeline of every key and carry ``split`` and the ``quantile`` and ``risk`` of their key. Segments are those
    of the timeline (column ``segment``, if it is there already), so that windows of other splits between two test windows neither join
    nor part them; a segment without a test window does not count.
    """
    windows = durable(windows, "split")
    quantiles = [r["quantile"] for r in windows.select("quantile").distinct().orderBy("quantile").collect()]
    marked = windows
    if "segment" not in windows.columns:
        marked = in_segment(positions(windows, keys, order, "_idx", group_rows), keys, "_idx", label, group_rows)
    test = marked.where("split = 'test'")
    levels = windows.groupBy(*keys).agg(F.first("quantile").alias("quantile"), F.first("risk").alias("risk"))
    if not quantiles:
        levels = levels.withColumn("threshold", F.lit(None).cast("double"))
    else:
        # One pass fits every quantile that occurs; each key then takes its own.
        fits = durable(fit_tails(windows.where("split = 'train'"), keys, score, quantiles, group_rows=group_rows), "fits")
        fitted = attach(levels, fits, [*keys, "quantile"], ["n", "init", "peaks", "gamma", "sigma"])
        levels = fitted.withColumn("threshold", alarm_level(F.col("risk")))
    return rated(trial_counts(test, levels, keys, ["quantile", "risk"], score))


def best_trial(trials: DataFrame, objective: str, params: Sequence[str], keys: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """Row of the best trial per key; trials without the objective do not compete, ties go to smaller parameters."""
    sign = 1 if lowest else -1
    rank = F.struct((sign * F.col(objective)).alias("_o"), *params)
    columns = F.struct(*[c for c in trials.columns if c not in keys])
    best = trials.where(F.col(objective).isNotNull()).groupBy(*keys).agg(F.min_by(columns, rank).alias("_b"))
    return best.select(*keys, "_b.*")


def sweep(
    windows: DataFrame, configs: DataFrame, seeds: Sequence[int], run: Any
) -> DataFrame:
    """``run(rows)`` once over all (config, seed) pairs: rows carry the config's columns and the seed.

    ``configs`` is a small table (config, ..., error); a config with an error is recorded, not run.
    """
    listed = F.array(*[F.lit(int(s)) for s in seeds])
    jobs = configs.withColumn("seed", F.explode(listed))
    names = [c for c in jobs.columns if c != "error"]
    valid = jobs.where(F.col("error").isNull()).agg(F.collect_list(F.struct(*names))).scalar()
    rows = windows.withColumn("_job", F.explode(valid)).select(*windows.columns, "_job.*")
    done = run(rows).withColumn("error", F.lit(None).cast("string"))
    failed = jobs.where(F.col("error").isNotNull()).select("config", "seed", "error")
    return done.unionByName(failed, allowMissingColumns=True)


def check_configs(configs: DataFrame) -> DataFrame:
    """Adds ``error`` to configurations (config, quantile, risk, train_ratio) that cannot run."""
    problem = (
        F.when(~F.col("quantile").between(0.0, 1.0), "quantile outside 0..1")
        .when((F.col("risk") <= 0) | (F.col("risk") >= 1), "risk outside 0..1")
        .when((F.col("train_ratio") <= 0) | (F.col("train_ratio") > 1), "train_ratio outside 0..1")
    )
    return configs.withColumn("error", problem)


def numeric_metrics(columns: Mapping[str, Column]) -> Column:
    """Map of dot-named metrics without null or non-finite values."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(n) for n in columns]), F.array(*[c.cast("double") for c in columns.values()])
    )
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def flatten_numeric(df: DataFrame, prefix: str = "") -> dict[str, Column]:
    """Numeric leaves of nested struct columns under dotted names, for ``numeric_metrics``."""
    from pyspark.sql import types as T

    out: dict[str, Column] = {}

    def walk(fields, path: str) -> None:
        for f in fields:
            name = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, name)
            elif isinstance(f.dataType, T.NumericType):
                out[f"{prefix}{name}"] = F.col(name)

    walk(df.schema.fields, "")
    return out


def ledger_rows(results: DataFrame, experiment: str, run: Column, params: Sequence[str], metrics: Sequence[str], parent: str | None = None) -> DataFrame:
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    return results.select(
        F.lit(experiment).alias("experiment"),
        run.alias("run"),
        F.lit(parent).cast("string").alias("parent"),
        F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(p) for p in params]), F.array(*[F.col(p).cast("string") for p in params])),
            lambda _, v: v.isNotNull(),
        ).alias("params"),
        numeric_metrics({m: F.col(m) for m in metrics}).alias("metrics"),
        error.alias("error"),
        F.current_timestamp().alias("ts"),
    )


def best_run(ledger: DataFrame, metric: str, lowest: bool = True) -> DataFrame:
    """The run with the lowest (or highest) value of a metric, among those that report it."""
    value = ledger.withColumn("value", F.element_at("metrics", metric)).where(F.col("value").isNotNull())
    return value.orderBy(F.col("value").asc() if lowest else F.col("value").desc(), "run").limit(1)


def available_metrics(ledger: DataFrame) -> DataFrame:
    return ledger.select("experiment", F.explode(F.map_keys("metrics")).alias("metric")).distinct()


def latest_version(versions: DataFrame, name: str = "model", version: str = "version") -> DataFrame:
    """The row with the largest version of each model."""
    rest = F.struct(*[c for c in versions.columns if c != name])
    return versions.groupBy(name).agg(F.max_by(rest, version).alias("_r")).select(name, "_r.*")
