"""Alerts with persistence and cooldown.

Per (service, metric, state): a crossing counts towards an alert unless a cooldown is left, in which
case it uses up one step of it; enough counted crossings in a row fire, which resets the count and
starts the cooldown. A row below the threshold resets the count, not the cooldown.

The state is a pair of small integers with ``persistence + cooldown`` possible values, so a run of
rows is a map from the value before it to the value after it. A large key is split into runs whose
maps are computed at once and chained; a second pass then fires the alerts of every run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.ordered import RUN, row_frames, running_sums, split_runs


@dataclass(frozen=True)
class AlertRule:
    metric: str
    state: str
    level: str
    threshold: float
    persistence_steps: int
    cooldown_steps: int


def crossings(rows: DataFrame, rules: Sequence[AlertRule], value: str = "value") -> DataFrame:
    """One row per (row, rule of its metric) with ``crossed``; a negative threshold means "at or below".

    Values that are no finite number, or negative, take no part.
    """
    v = F.col(value)
    listed = F.array(
        *[
            F.when(
                F.col("metric") == r.metric,
                F.struct(
                    F.lit(r.state).alias("state"), F.lit(r.level).alias("level"), F.lit(r.persistence_steps).alias("persistence"),
                    F.lit(r.cooldown_steps).alias("cooldown"),
                    ((-v >= r.threshold) if r.threshold < 0 else (v >= r.threshold)).alias("crossed"),
                ),
            )
            for r in rules
        ]
    )
    usable = rows.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    return usable.withColumn("_rule", F.explode(F.array_compact(listed))).select(*rows.columns, "_rule.*")


def step(crossed: bool, active: int, cooldown: int, persistence: int, pause: int) -> tuple[int, int, bool]:
    """(active, cooldown, fired) after one row."""
    if not crossed:
        return 0, cooldown, False
    if cooldown > 0:
        return active, cooldown - 1, False
    if active + 1 >= persistence:
        return 0, pause, True
    return active + 1, 0, False


def fire(crossed: np.ndarray, active: int, cooldown: int, persistence: int, pause: int) -> tuple[np.ndarray, int, int]:
    """Which rows fire, and the state after the last one.

    A run of crossings uses up what is left of the cooldown, fires once its count is full, and then again after every pause and count;
    so a step is taken per run, not per row.
    """
    fired = np.zeros(crossed.size, dtype=bool)
    need = max(persistence, 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], crossed, [False]]).astype(np.int8)))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if begin:
            active = 0
        first = begin + cooldown + max(need - active, 1) - 1
        if first >= end:
            counted = max(end - begin - cooldown, 0)
            active, cooldown = active + counted, max(cooldown - (end - begin), 0)
            continue
        hits = np.arange(first, end, pause + need)
        fired[hits] = True
        after = end - 1 - int(hits[-1])
        active, cooldown = max(after - pause, 0), max(pause - after, 0)
    if crossed.size and not crossed[-1]:
        active = 0
    return fired, active, cooldown


def _all_states(persistence: int, pause: int) -> list[tuple[int, int]]:
    return [(a, 0) for a in range(max(persistence, 1))] + [(0, c) for c in range(1, pause + 1)]


def alerts(
    crossed: DataFrame, keys: Sequence[str], order: Sequence[str], group_rows: int | None = None, keep_ms: int | None = None, ts: str = "ts"
) -> DataFrame:
    """The rows that fire. ``keys`` name the series; the rule's state is added to them.

    With ``keep_ms`` a series starts anew after a longer gap in ``ts``: what lies between two such gaps is a series of its own.
    """
    if keep_ms:
        parts = _between_gaps(crossed, [*keys, "state"], order, keep_ms, ts, group_rows)
        return alerts(parts, [*keys, "_part"], order, group_rows).drop("_part")
    keys = [*keys, "state"]
    runs = split_runs(crossed, keys, order, group_rows)
    if runs is None:
        rows, by, starts = crossed, keys, None
    else:
        rows, by = runs, [*keys, RUN]
        starts = _run_starts(runs, keys, order)
    schema = rows.schema

    def emit(group: pd.DataFrame, active: int, cooldown: int) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        first = group.iloc[0]
        fired, _, _ = fire(
            group["crossed"].to_numpy(dtype=bool), active, cooldown, int(first["persistence"]), int(first["cooldown"])
        )
        return group[fired]

    if starts is None:
        def alone(group: pd.DataFrame) -> pd.DataFrame:
            return emit(group, 0, 0)

        return rows.groupBy(*by).applyInPandas(alone, schema).drop("crossed")

    def from_start(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return group
        return emit(group, int(start["active0"].iloc[0]), int(start["cooldown0"].iloc[0]))

    starts = starts.select(*[F.col(c).alias(c) for c in starts.columns])
    return rows.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(from_start, schema).drop("crossed", RUN)


def _between_gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep_ms: int, ts: str, group_rows: int | None) -> DataFrame:
    at = F.unix_micros(F.col(ts).cast("timestamp"))

    def opens(df: DataFrame, w) -> DataFrame:
        return df.withColumn("_opens", F.coalesce(at - F.lag(at).over(w) > keep_ms * 1000, F.lit(False)).cast("int"))

    marked = row_frames(rows, keys, order, 1, 0, opens, group_rows)
    return running_sums(marked, keys, order, {"_part": F.col("_opens")}, group_rows).drop("_opens")


def _run_starts(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State before the first row of every run."""
    key_fields = [runs.schema[k] for k in keys]
    run_field = T.StructField(RUN, T.IntegerType())
    map_schema = T.StructType(
        key_fields + [
            run_field, T.StructField("persistence", T.IntegerType()), T.StructField("pause", T.IntegerType()),
            T.StructField("active1", T.ArrayType(T.IntegerType())), T.StructField("cooldown1", T.ArrayType(T.IntegerType())),
        ]
    )
    start_schema = T.StructType(
        key_fields + [run_field, T.StructField("active0", T.IntegerType()), T.StructField("cooldown0", T.IntegerType())]
    )

    def effect(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        first = group.iloc[0]
        persistence, pause = int(first["persistence"]), int(first["cooldown"])
        crossed = group["crossed"].to_numpy(dtype=bool)
        ends = [fire(crossed, a, c, persistence, pause)[1:] for a, c in _all_states(persistence, pause)]
        row = [first[k] for k in keys] + [int(first[RUN]), persistence, pause, [e[0] for e in ends], [e[1] for e in ends]]
        return pd.DataFrame([row], columns=map_schema.names)

    def chain(effects: pd.DataFrame) -> pd.DataFrame:
        active = cooldown = 0
        out = []
        for _, e in effects.sort_values(RUN).iterrows():
            out.append([e[k] for k in keys] + [int(e[RUN]), active, cooldown])
            at = _all_states(int(e["persistence"]), int(e["pause"])).index((active, cooldown))
            active, cooldown = int(e["active1"][at]), int(e["cooldown1"][at])
        return pd.DataFrame(out, columns=start_schema.names)

    effects = runs.groupBy(*keys, RUN).applyInPandas(effect, map_schema)
    return effects.groupBy(*keys).applyInPandas(chain, start_schema)
