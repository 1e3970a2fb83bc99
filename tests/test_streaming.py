import json

import pytest
from pyspark.sql import functions as F

from siltworks.streaming import control


def test_fold_and_ema(spark):
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(6)] + [("b", i, -1.0) for i in range(8)], "run string, step long, x double")
    got = {r.run: (r.updates, r.horizon) for r in control.fold(rows, "run", "step", "x", 10.0, 10.0, 0.6).collect()}
    assert got == {"a": (1, 14.0), "b": (2, 1.0)}
    assert spark.range(1).select(control.ema(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 0.999)).first()[0] == pytest.approx(3 * 9 / 12 + (2 * 9 / 11 + 2 / 11) * 3 / 12)
    assert control.trimmed(rows, "step", 3).count() == 8


def test_streams(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"run": "a", "step": i, "value": 1.0}) for i in range(4)))
    control.append_log(control.read_log(spark, str(log)), str(out), str(tmp_path / "c")).awaitTermination()
    (log / "2.json").write_text(json.dumps({"run": "a", "step": 4, "value": 1.0}))
    control.append_log(control.read_log(spark, str(log)), str(out), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema(control.LOG).json(str(out)).count() == 5  # each row once
    q = control.controlled(control.read_log(spark, str(log)), "run", "value", 10.0, 10.0, 0.6).writeStream.format("memory").queryName("horizons").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("horizons").collect()] == [("a", 1, 14.0)]


def test_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:10", "x"), ("2024-01-01 00:00:50", "x"), ("2024-01-01 00:01:10", "y")], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = control.windows(stream, "ts", "1 minute", "1 minute", "kind").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counted").collect()) == [("x", 2), ("y", 1)]
