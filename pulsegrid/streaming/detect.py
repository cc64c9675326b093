"""The sequential threshold detector on a stream, with the same step as the batch form.

The state of a series is a few numbers and the sums over the threshold grid, whatever the number of
rows and peaks. It starts from the calibrated states of ``operators.spot.start_states``. Rows of a
series that arrive together are ordered by time. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions.peaks import run_drift, run_plain
from pulsegrid.operators.spot import STATE_FIELDS, STATE_NAMES, STATUS_NAMES, state_from_row, state_to_tuple

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Detector(StatefulProcessor):
    """Status and threshold of every row of the series that have a start state."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], score: str, depth: int, update_with_alarm: bool):
        self.columns, self.order, self.score = list(columns), list(order), score
        self.depth, self.update_with_alarm = depth, update_with_alarm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", T.StructType(STATE_FIELDS))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update(state_to_tuple(state_from_row(initialState.iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state = state_from_row(dict(zip(STATE_NAMES, self.state.get())))
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        run = run_drift if self.depth > 0 else run_plain
        status, threshold = run(state, batch[self.score].to_numpy(dtype=float), self.update_with_alarm)
        self.state.update(state_to_tuple(state))
        yield batch[self.columns].assign(status=np.array(STATUS_NAMES)[status], threshold=threshold)

    def close(self) -> None:
        pass


def detect_stream(
    stream: DataFrame, states: DataFrame, keys: Sequence[str], order: Sequence[str], score: str = "score", depth: int = 0,
    update_with_alarm: bool = False,
) -> DataFrame:
    columns = [*keys, *order, score]
    rows = stream.select(*columns)
    output = T.StructType(
        [rows.schema[c] for c in columns] + [T.StructField("status", T.StringType()), T.StructField("threshold", T.DoubleType())]
    )
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Detector(columns, order, score, depth, update_with_alarm),
        outputStructType=output,
        outputMode="Append",
        timeMode="None",
        initialState=states.groupBy(*keys),
    )
