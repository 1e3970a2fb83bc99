"""Logs and controllers, as batch folds and as streams.

A stream of training steps keeps one small state per run; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_up(horizon: Any, mean: Any, target: float, gain: float, most: float) -> Any:
    return min(max(horizon + (mean - target) * gain, 1.0), most)


def fold(rows: DataFrame, by: str, order: str, value: str, start: float, gain: float, target: float, every: int = 4, most: float = 500.0) -> DataFrame:
    """(by, updates, horizon) after all whole batches of ``every`` rows of a key, in order.

    The means of the batches are windows and aggregates; only they, one number
    per batch, are folded with the clamp.
    """
    w = Window.partitionBy(by).orderBy(order)
    batch = rows.withColumn("__k", F.floor((F.row_number().over(w) - 1) / every)).groupBy(by, "__k").agg((F.sum(value) / every).alias("__a"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == every)
    means = batch.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__a"))), lambda x: x["__a"]).alias("__m"))
    clamp = lambda h, a: F.greatest(F.lit(1.0), F.least(F.lit(most), h + (a - target) * gain))
    return means.select(by, F.size("__m").cast("long").alias("updates"), F.round(F.aggregate("__m", F.lit(float(start)), clamp), 6).alias("horizon"))


def ema(values: Column, decay: float) -> Column:
    """The moving average of an ordered array, warming up: step s keeps min(decay, (1 + s) / (10 + s))."""
    one = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("v"))

    def go(acc: Column, x: Column) -> Column:
        keep = F.when(acc["s"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(decay), (1 + acc["s"]) / (10 + acc["s"])))
        return F.struct((acc["s"] + 1).alias("s"), (acc["v"] * keep + x * (1 - keep)).alias("v"))

    return F.aggregate(values, one, go, lambda acc: acc["v"])


def trimmed(log: DataFrame, step: str, durable: int) -> DataFrame:
    """The rows up to the last durable step."""
    return log.where(F.col(step) <= durable)


def loss_summary(log: DataFrame, step: str, value: str, recent: int, batch: int) -> DataFrame:
    """(kept, last_step, least, most, recent_mean, kimg): of a log, and the mean of its ``recent`` last rows."""
    last = log.orderBy(F.desc(step)).limit(recent).agg(F.round(F.avg(value), 6).alias("recent_mean"))
    whole = log.agg(F.count(F.lit(1)).alias("kept"), F.max(step).alias("last_step"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.max(step) * batch / 1000, 6).alias("kimg"))
    return whole.crossJoin(last)  # one row each


LOG = "run string, step long, value double"


def read_log(spark, path: str, schema: str = LOG) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a folder of JSON lines, each row once; resumes from its checkpoint."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windows(stream: DataFrame, time: str, every: str, late: str, *by: str) -> DataFrame:
    """Counts per time window and key; rows later than ``late`` are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count(F.lit(1)).alias("n"))


def controlled(stream: DataFrame, by: str, value: str, start: float, gain: float, target: float, every: int = 4, most: float = 500.0) -> DataFrame:
    """(by, updates, horizon) whenever a key completes a batch; the state is (updates, horizon, rows, sum)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        updates, horizon, n, total = state.get if state.exists else (0, float(start), 0, 0.0)
        out = []
        for part in parts:
            for x in part.sort_values("step")[value]:
                n, total = n + 1, total + float(x)
                if n == every:
                    horizon, updates, n, total = step_up(horizon, total / every, target, gain, most), updates + 1, 0, 0.0
                    out.append((key[0], updates, horizon))
        state.update((updates, horizon, n, total))
        yield pd.DataFrame(out, columns=[by, "updates", "horizon"])

    return stream.groupBy(by).applyInPandasWithState(update, f"{by} string, updates long, horizon double", "updates long, horizon double, n long, total double", "append", "NoTimeout")
