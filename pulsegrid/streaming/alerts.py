"""Alerts with persistence and cooldown on a stream.

The state per (series, rule) is two small integers and the time of its last row; a state that holds nothing is cleared at once. With ``keep``,
a series that is silent for longer starts anew: the rule looks at the gap between rows, so it does not depend on how rows fall into
micro-batches, and an event-time timer frees the state once the watermark has passed the gap. A run over what is available ends with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators.alerts import fire

STATE = T.StructType([T.StructField("active", T.IntegerType()), T.StructField("cooldown", T.IntegerType()), T.StructField("last_us", T.LongType())])
# No leading underscore: the state API renames such columns.
_MICROS = "event_micros"


class Hysteresis(StatefulProcessor):
    def __init__(self, columns: Sequence[str], order: Sequence[str], keep_ms: int | None):
        self.columns, self.order, self.keep_ms = list(columns), list(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        active, cooldown, last = self.state.get() if self.state.exists() else (0, 0, None)
        rule, crossed = batch.iloc[0], batch["crossed"].to_numpy(dtype=bool)
        fired, anew = np.zeros(len(batch), dtype=bool), set()
        if self.keep_ms:
            at = batch[_MICROS].to_numpy(dtype=np.int64)
            gaps = np.diff(at, prepend=at[0] if last is None else last)
            anew, last = set(np.flatnonzero(gaps > self.keep_ms * 1000).tolist()), int(at[-1])
        bounds = sorted({0, len(batch)} | anew)
        for begin, end in zip(bounds, bounds[1:]):
            if begin in anew:
                active = cooldown = 0
            fired[begin:end], active, cooldown = fire(crossed[begin:end], active, cooldown, int(rule["persistence"]), int(rule["cooldown"]))
        if self.keep_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if active or cooldown:
            self.state.update((active, cooldown, last))
            if self.keep_ms:
                self.handle.registerTimer(last // 1000 + self.keep_ms + 1)
        else:
            self.state.clear()
        yield batch.loc[fired, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def alerts_stream(
    crossed: DataFrame, keys: Sequence[str], order: Sequence[str], keep_ms: int | None = None, ts: str = "ts", watermark: str = "30 seconds"
) -> DataFrame:
    """The rows of a stream of ``operators.alerts.crossings`` that fire.

    ``keep_ms`` lets a series start anew after a longer gap in ``ts`` (a timestamp). None keeps the state for good.
    """
    columns = [c for c in crossed.columns if c != "crossed"]
    output = T.StructType([crossed.schema[c] for c in columns])
    rows = crossed.withWatermark(ts, watermark).withColumn(_MICROS, F.unix_micros(ts)) if keep_ms else crossed
    return rows.groupBy(*keys, "state").transformWithStateInPandas(
        statefulProcessor=Hysteresis(columns, order, keep_ms),
        outputStructType=output,
        outputMode="Append",
        timeMode="EventTime" if keep_ms else "None",
    )
