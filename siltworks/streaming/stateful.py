"""Streams with state that a run starts from, and windows that report what came too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .control import step_up

STATE = "updates long, horizon double, n long, total double"
#: The state store that processors of this kind need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Controller(StatefulProcessor):
    """The adaptive horizon of each run: after every ``every`` rows it moves by the batch's mean.

    State is one row of four numbers a run. A run with initial state goes on
    from there, as after a restored checkpoint; others start afresh. Rows count
    in order of ``step`` within a micro-batch and of arrival between them.
    """

    def __init__(self, by: str, order: str, value: str, start: float, gain: float, target: float, every: int = 4, most: float = 500.0) -> None:
        self.by, self.order, self.value = by, order, value
        self.start, self.gain, self.target, self.every, self.most = float(start), gain, target, every, most

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.state.update((int(row["updates"]), float(row["horizon"]), int(row["n"]), float(row["total"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        updates, horizon, n, total = self.state.get() if self.state.exists() else (0, self.start, 0, 0.0)
        out = []
        parts = [part[[self.order, self.value]] for part in rows]  # two numbers a row of one run and micro-batch
        for x in pd.concat(parts).sort_values(self.order, kind="stable")[self.value].tolist() if parts else ():
            n, total = n + 1, total + float(x)
            if n == self.every:
                horizon, updates, n, total = step_up(horizon, total / self.every, self.target, self.gain, self.most), updates + 1, 0, 0.0
                out.append((key[0], updates, horizon))
        self.state.update((updates, horizon, n, total))
        yield pd.DataFrame(out, columns=[self.by, "updates", "horizon"]).astype({"updates": "int64", "horizon": "float64"})

    def close(self) -> None:
        pass


def controlled(stream: DataFrame, processor: Controller, initial: DataFrame | None = None) -> DataFrame:
    """(by, updates, horizon) whenever a run completes a batch; initial: by, updates, horizon, n, total of runs that go on.

    Sets the session's state store to the one that processors need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema[processor.by].dataType.simpleString()
    begun = None if initial is None else initial.groupBy(processor.by)
    return stream.groupBy(processor.by).transformWithStateInPandas(processor, f"{processor.by} {kind}, updates long, horizon double", "Append", "None", begun)


def appended_windows(stream: DataFrame, time: str, every: str, late: str, *by: str) -> DataFrame:
    """(start, by..., n): counts of windows that the watermark has closed, each once, for the append mode."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, every), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def late_rows(query) -> int:
    """How many (partly summed) rows a query has left out so far because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
