"""Sequential threshold detection over whole score tables.

The detector's state after a row depends on all rows before it, yet only through counts, sums over
peaks and a short list of recent scores. A series of moderate size goes through one task. A large
one is split into runs that all work at once, each from an assumed state; then the true states follow
by adding up what the runs changed, and those runs repeat whose assumed state differs from the true one.
When there is none, every run started from the state its predecessors leave, so the outcome is that of
the sequential pass. In practice nearly all runs agree at once. A series in which many do not, since each
run's outcome turns on the one before, is finished after ``ROUNDS`` rounds by one pass in order over the
runs from the first that differs: a stream of batches with one state, so the work stays linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.peaks import PeakState, add_peak, refit, run_drift, run_plain
from pulsegrid.operators.ordered import RUN, split_runs
from pulsegrid.operators.scoring import detrend
from pulsegrid.operators.threshold import GRID_SIZE, fit_thresholds, tail_sign
from pulsegrid.storage import durable

#: Rounds in which all runs that differ work at once, before the rest is passed in order.
ROUNDS = 2

STATUS_NAMES = ("NORMAL", "ABNORMAL", "ALARM")

STATE_FIELDS = [
    T.StructField("init", T.DoubleType()),
    T.StructField("sign", T.IntegerType()),
    T.StructField("risk", T.DoubleType()),
    T.StructField("baseline", T.LongType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("peaks", T.LongType()),
    T.StructField("sum_excess", T.DoubleType()),
    T.StructField("logs", T.ArrayType(T.DoubleType())),
    T.StructField("invs", T.ArrayType(T.DoubleType())),
    T.StructField("recent", T.ArrayType(T.DoubleType())),
]
STATE_NAMES = [f.name for f in STATE_FIELDS]


def start_states(
    baseline: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    score: str = "score",
    quantile: float = 0.98,
    risk: float = 1e-3,
    tail: str = "upper",
    depth: int = 0,
    group_rows: int | None = None,
) -> DataFrame:
    """Calibrated detector state per key from baseline scores; ``depth`` > 0 for the drift detector."""
    sign = tail_sign(tail)
    scores = baseline.select(*keys, *order, score)
    if depth > 0:
        scores = detrend(scores, keys, order, score, depth, "_detrended", group_rows).select(
            *keys, F.col("_detrended").alias(score)
        )
    fitted = fit_thresholds(scores, keys, score, quantile, risk, tail, group_rows)
    nothing = F.array_repeat(F.lit(0.0), GRID_SIZE)
    states = fitted.select(
        *keys,
        "init",
        F.lit(sign).alias("sign"),
        F.lit(float(risk)).alias("risk"),
        F.col("n").alias("baseline"),
        F.coalesce("scale", F.lit(float("nan"))).alias("scale"),
        "threshold",
        F.lit(0).cast("long").alias("accepted"),
        F.col("n").alias("total"),
        F.col("peaks").cast("long").alias("peaks"),
        F.coalesce("sum_excess", F.lit(0.0)).alias("sum_excess"),
        F.coalesce("log_sums", nothing).alias("logs"),
        F.coalesce("inv_sums", nothing).alias("invs"),
    )
    if depth <= 0:
        return states.withColumn("recent", F.array().cast("array<double>"))
    # The latest `depth` scores of a key: the aggregate keeps no more than that many at a time.
    recent = _latest(baseline, keys, order, score, depth)
    return states.join(recent, list(keys))


def _latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, count: int) -> DataFrame:
    """The last ``count`` scores of each key in order; plans as a per-partition top-k first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    kept = df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= count)
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(score).alias("_v"))))
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["_v"]).alias("recent"))


def _array(values) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=float)


def state_from_row(row) -> PeakState:
    return PeakState(
        init=float(row["init"]), sign=int(row["sign"]), risk=float(row["risk"]), baseline=int(row["baseline"]),
        scale=float("nan") if row["scale"] is None else float(row["scale"]), threshold=float(row["threshold"]),
        accepted=int(row["accepted"]), total=int(row["total"]), peaks=int(row["peaks"]), sum_excess=float(row["sum_excess"]),
        logs=_array(row["logs"]), invs=_array(row["invs"]), recent=tuple(float(v) for v in row["recent"]),
    )


def state_to_tuple(s: PeakState) -> tuple:
    return (
        s.init, s.sign, s.risk, s.baseline, s.scale, s.threshold, s.accepted, s.total, s.peaks, s.sum_excess,
        s.logs.tolist(), s.invs.tolist(), list(s.recent),
    )


def _runner(depth: int):
    return run_drift if depth > 0 else run_plain


def detect(
    scores: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    score: str = "score",
    depth: int = 0,
    update_with_alarm: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Adds ``status`` and ``threshold`` to every row of the keys that have a start state."""
    columns = [*keys, *order, score]
    rows = scores.select(*columns)
    result = T.StructType(
        [rows.schema[c] for c in columns] + [T.StructField("status", T.StringType()), T.StructField("threshold", T.DoubleType())]
    )
    runs = split_runs(rows, keys, order, group_rows)
    pairing = list(keys)
    if runs is not None:
        rows, pairing = runs, [*keys, RUN]
        states = _settle(runs, states, keys, order, score, depth, update_with_alarm)
    names = np.array(STATUS_NAMES)

    def judge(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if group.empty or state.empty:
            return pd.DataFrame({f.name: [] for f in result.fields})
        group = group.sort_values(list(order), kind="stable")
        status, threshold = _runner(depth)(
            state_from_row(state.iloc[0]), group[score].to_numpy(dtype=float), update_with_alarm
        )
        return group[columns].assign(status=names[status], threshold=threshold)

    return rows.groupBy(*pairing).cogroup(_renewed(states).groupBy(*pairing)).applyInPandas(judge, result)


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for cogroups of tables with a common origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _settle(
    runs: DataFrame, states: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, depth: int, update_with_alarm: bool
) -> DataFrame:
    """The state in which every run of every key begins."""
    by_run = [*keys, RUN]
    key_fields = [runs.schema[k] for k in keys]
    run_field = [T.StructField(RUN, T.IntegerType())]
    change = T.StructType(
        key_fields + run_field + [
            T.StructField("accepted", T.LongType()), T.StructField("peak_at", T.LongType()),
            T.StructField("scale", T.DoubleType()), T.StructField("peaks", T.LongType()),
            T.StructField("sum_excess", T.DoubleType()), T.StructField("logs", T.ArrayType(T.DoubleType())),
            T.StructField("invs", T.ArrayType(T.DoubleType())), T.StructField("recent", T.ArrayType(T.DoubleType())),
        ]
    )
    settled_schema = T.StructType(key_fields + run_field + STATE_FIELDS)

    def changes(group: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if group.empty or state.empty:
            return pd.DataFrame({f.name: [] for f in change.fields})
        group = group.sort_values(list(order), kind="stable")
        before = state_from_row(state.iloc[0])
        after = replace(before.copy(), added=[])
        _runner(depth)(after, group[score].to_numpy(dtype=float), update_with_alarm)
        # Summed from zero, so that equal peaks give equal sums whatever the assumed state was.
        gain = PeakState(before.init, before.sign, before.risk, before.baseline, after.scale)
        for excess in after.added:
            add_peak(gain, excess)
        first = group.iloc[0]
        return pd.DataFrame(
            [
                [first[k] for k in keys]
                + [
                    int(first[RUN]), after.accepted - before.accepted,
                    after.total - before.baseline - before.accepted if after.added else -1, after.scale,
                    gain.peaks, gain.sum_excess, gain.logs.tolist(), gain.invs.tolist(), list(after.recent),
                ]
            ],
            columns=change.names,
        )

    def chain(run_changes: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if run_changes.empty or state.empty:
            return pd.DataFrame({f.name: [] for f in settled_schema.fields})
        current = state_from_row(state.iloc[0])
        out = []
        for _, c in run_changes.sort_values(RUN).iterrows():
            out.append(tuple(c[k] for k in keys) + (int(c[RUN]),) + state_to_tuple(current))
            if c["peak_at"] >= 0:
                current.scale = current.scale if current.scale > 0 else float(c["scale"])
                current.total = current.baseline + current.accepted + int(c["peak_at"])
                current.peaks += int(c["peaks"])
                current.sum_excess += float(c["sum_excess"])
                current.logs = current.logs + _array(c["logs"])
                current.invs = current.invs + _array(c["invs"])
                refit(current)
            current.accepted += int(c["accepted"])
            current.recent = tuple(c["recent"])
        return pd.DataFrame(out, columns=settled_schema.names)

    present = runs.groupBy(*by_run).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    counted = present.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    assumed = durable(
        counted.join(states, list(keys)).withColumn("accepted", F.col("_before")).select(*settled_schema.names), "states"
    )
    fields = ["scale", "accepted", "total", "peaks", "sum_excess", "logs", "invs", "recent"]
    same = reduce(lambda x, y: x & y, [F.col(f"t.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields])
    made, differ = None, assumed
    for _ in range(ROUNDS):
        again = runs.join(differ.select(*by_run), by_run, "left_semi")
        fresh = again.groupBy(*by_run).cogroup(_renewed(differ).groupBy(*by_run)).applyInPandas(changes, change)
        made = durable(fresh if made is None else fresh.unionByName(made.join(differ.select(*by_run), by_run, "left_anti")), "changes")
        true = durable(made.groupBy(*keys).cogroup(_renewed(states).groupBy(*keys)).applyInPandas(chain, settled_schema), "states")
        differ = durable(true.alias("t").join(assumed.alias("a"), by_run).where(~same).select("t.*"), "differ")
        if differ.isEmpty():
            return true
        assumed = true
    first = durable(differ.groupBy(*keys).agg(F.min(RUN).alias("_from")), "first")
    true = true.join(first, list(keys), "left")
    known = true.where(f"_from is null or {RUN} < _from").select(*settled_schema.names)
    starts = true.where(f"{RUN} = _from").select(*settled_schema.names)
    rest = runs.join(first, list(keys)).where(F.col(RUN) >= F.col("_from")).select(*keys, RUN, *order, score)
    return durable(known.unionByName(_in_order(rest, starts, keys, order, score, depth, update_with_alarm, settled_schema)), "states")


def _in_order(
    rest: DataFrame, starts: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, depth: int, update_with_alarm: bool, schema: T.StructType
) -> DataFrame:
    """The state in which every run of ``rest`` begins, by one pass in order per key; ``starts`` has that of its first run.

    A task holds one batch of rows and one state. The start states travel as rows before the first row of their key.
    """
    state_names = [f.name for f in STATE_FIELDS]
    start = starts.select(*keys, (F.col(RUN) - 1).alias(RUN), F.struct(*state_names).alias("_start"))
    line = rest.unionByName(start, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, RUN, *order)

    def states_of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, run, found = None, None, []
        for batch in batches:
            for number, part in batch.groupby(RUN, sort=False):
                if run is not None and number < run:
                    raise ValueError("rows of a key are out of order")
                if state is None:
                    state, run = state_from_row(part["_start"].iloc[0]), number
                    continue
                if number != run:
                    found.append(tuple(part[k].iloc[0] for k in keys) + (int(number),) + state_to_tuple(state))
                    run = number
                _runner(depth)(state, part[score].to_numpy(dtype=float), update_with_alarm)
            yield pd.DataFrame(found, columns=schema.names)
            found = []

    return line.groupBy(*keys).applyInPandas(states_of_runs, schema)


def trace_summary(detected: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Initial, final and mean threshold and the share of alarms per key."""
    at = F.struct(*order)
    alarm = F.col("status") == "ALARM"
    return detected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(alarm).alias("alarms"),
        F.count_if(F.col("status") == "ABNORMAL").alias("abnormal"),
        F.min_by("threshold", at).alias("initial_threshold"),
        F.max_by("threshold", at).alias("final_threshold"),
        F.avg("threshold").alias("mean_threshold"),
        F.avg(alarm.cast("double")).alias("alarm_rate"),
    )
