import pytest
from pyspark.sql import functions as F

from siltworks.streaming import control, stateful

ROWS = [(f"r{i % 3}", i // 3, ((i * 37) % 11 - 5) / 5) for i in range(120)]


def fold(values, horizon=10.0, updates=0, n=0, total=0.0, gain=4.0, target=0.1, every=4, most=500.0):
    for x in values:
        n, total = n + 1, total + x
        if n == every:
            horizon, updates, n, total = min(max(horizon + (total / every - target) * gain, 1.0), most), updates + 1, 0, 0.0
    return updates, horizon


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, folder, out, state, initial=None):
    """All files of a folder, one a micro-batch; the last row of every run."""
    stream = spark.readStream.schema("run string, step long, value double").option("maxFilesPerTrigger", 1).json(folder)
    found = stateful.controlled(stream, stateful.Controller("run", "step", "value", 10.0, 4.0, 0.1), initial)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return {r.run: (r.updates, r.horizon) for r in spark.read.parquet(out).groupBy("run").agg(F.max("updates").alias("updates"), F.max_by("horizon", "updates").alias("horizon")).collect()}


def test_equals_the_batch_fold(spark, tmp_path, store):
    """Three files of one run's steps each later than the last, then a fourth after a restart."""
    for part in range(3):
        spark.createDataFrame([r for r in ROWS if r[1] // 10 == part], "run string, step long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    got = run(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state"))
    values = lambda run, last: [v for k, s, v in ROWS if k == run and s < last]
    for name in ("r0", "r1", "r2"):
        updates, horizon = fold(values(name, 30))
        assert got[name][0] == updates and abs(got[name][1] - horizon) < 1e-9
    batch = control.fold(spark.createDataFrame([r for r in ROWS if r[1] < 30], "run string, step long, value double"), "run", "step", "value", 10.0, 4.0, 0.1)
    assert {r.run: (r.updates, r.horizon) for r in batch.collect()} == {k: (u, round(h, 6)) for k, (u, h) in got.items()}
    spark.createDataFrame([r for r in ROWS if r[1] // 10 == 3], "run string, step long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    got = run(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert all(abs(got[name][1] - fold(values(name, 40))[1]) < 1e-9 for name in got)


def test_initial_state(spark, tmp_path, store):
    """A run with state goes on inside its batch; the others start afresh."""
    spark.createDataFrame([r for r in ROWS if r[1] < 9], "run string, step long, value double").coalesce(1).write.json(str(tmp_path / "log"))
    initial = spark.createDataFrame([("r1", 7, 99.0, 3, 0.5), ("r9", 1, 2.0, 0, 0.0)], "run string, updates long, horizon double, n long, total double")
    got = run(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state"), initial)
    values = [v for k, s, v in ROWS if k == "r1" and s < 9]
    assert got["r1"] == pytest.approx(fold(values, 99.0, 7, 3, 0.5)) and got["r0"] == pytest.approx(fold([v for k, s, v in ROWS if k == "r0" and s < 9])) and "r9" not in got


def test_rows_beyond_the_watermark(spark, tmp_path):
    """A row older than the last batch's watermark is left out and counted; closed windows come once."""
    for i, times in enumerate((["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 05:00:00"], ["2024-01-01 04:30:00"], ["2024-01-01 00:20:00", "2024-01-01 09:00:00"], ["2024-01-01 09:30:00"])):
        spark.createDataFrame([(t, "k") for t in times], "ts string, k string").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    found = stateful.appended_windows(stream, "ts", "1 hour", "1 hour", "k")
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((str(r.start), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 04:00:00", 1), ("2024-01-01 05:00:00", 1)] and stateful.late_rows(query) == 1
