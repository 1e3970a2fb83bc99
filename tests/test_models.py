import random

import pytest

from siltworks.operators import models
from siltworks.sources import annotations, sinks


def test_predictability(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(2 * (i % 2), 0.5), rng.gauss(0, 1)], "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "k int, f array<double>, y string")
    found = models.predictions(frame, "k", "f", "y", folds=3)
    assert {r.label: (r.rows, r.right >= 27) for r in models.accuracy(found).collect()} == {"a": (30, True), "b": (30, True)}
    with pytest.raises(ValueError, match="two classes"):
        models.predictions(frame.where("y = 'a'"), "k", "f", "y")


def test_exchange_round_trip(spark, tmp_path):
    rows = [("i.png", 80, 64, [("d", 0.1, 0.25, 0.5, 0.75)]), ("none.png", 80, 64, [])]
    images = spark.createDataFrame(rows, "name string, width int, height int, boxes array<struct<label:string,x1:double,y1:double,x2:double,y2:double>>")
    sinks.exchange_xml(images, str(tmp_path / "x"))
    boxes, bad = annotations.exchange(spark, str(tmp_path / "x"))
    assert [tuple(r) for r in boxes.where("label IS NOT NULL").collect()] == [("i.png", "d", 0.1, 0.25, 0.5, 0.75)] and bad.collect() == []
