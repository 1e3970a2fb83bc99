import hashlib
import json

import numpy as np
import pytest

from siltworks.operators import augmentation as aug

KIND = "stem string, height int, width int, channels int, data binary, targets array<struct<cid: int, x1: double, y1: double, x2: double, y2: double>>"


def test_turns():
    image = np.arange(5 * 5 * 3, dtype=np.uint8).reshape(5, 5, 3)
    assert (aug.turned(image, aug.rotation(5, 5, 0)) == image).all()
    # about the middle of an odd image's middle pixel a quarter turn moves whole pixels
    about = aug.rotation(4, 4, 90)  # the centre (2, 2) is a pixel of the 5 x 5 image
    assert (aug.turned(image, about) == np.rot90(image)).all()
    far = aug.turned(np.zeros((9, 9, 1), np.uint8), aug.rotation(9, 9, 45))
    assert far[0, 0, 0] == aug.BORDER and far[4, 4, 0] == 0


def test_boxes():
    box = [(1, 0.4, 0.4, 0.6, 0.6)]
    assert aug.turned_boxes(box, aug.rotation(100, 50, 0), 100, 50, False) == [(1, *(pytest.approx(v) for v in (0.4, 0.4, 0.6, 0.6)))]
    assert aug.turned_boxes([(0, 0.1, 0.2, 0.3, 0.4)], aug.rotation(10, 10, 0), 10, 10, True)[0][1:] == pytest.approx((0.7, 0.2, 0.9, 0.4))
    assert aug.turned_boxes([(0, 0.0, 0.0, 0.01, 0.01)], aug.rotation(100, 100, 45), 100, 100, False) == []
    turned = aug.turned_boxes([(0, 0.5, 0.2, 0.7, 0.3)], aug.rotation(100, 100, 90), 100, 100, False)[0]
    assert turned[1:] == pytest.approx((0.2, 0.3, 0.3, 0.5))


def test_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", 12, 16, 3, rng.integers(0, 255, (12, 16, 3), dtype=np.uint8).tobytes(), [(1, 0.25, 0.25, 0.75, 0.75)]) for i in range(5)] + [("none", 2, 2, 1, bytes(4), [])]
    settings = {"degrees": 20, "flip_probability": 0.5, "noise_std": 0.02, "copies_per_real": 3}
    run = lambda parts, seed=1: {r.stem: r for r in aug.copies(spark.createDataFrame(rows, KIND).repartition(parts), settings, seed).collect()}
    got = run(1)
    assert len(got) == 18 and got == run(4) and got.keys().isdisjoint(run(2, seed=2))
    for r in got.values():
        told = json.loads(r.provenance)
        assert r.data_sha256 == hashlib.sha256(r.data).hexdigest() and r.label_sha256 == hashlib.sha256(r.label.encode()).hexdigest() and told["source_stem"] == r.source_stem and abs(told["angle"]) <= 20
        assert r.label == aug.label_of([tuple(t) for t in r.targets]) and (len(r.targets) == 1) == (r.source_stem != "none")
    still = aug.copies(spark.createDataFrame(rows, KIND), {"degrees": 0, "flip_probability": 0, "noise_std": 0, "copies_per_real": 1}, 0).collect()
    assert {r.source_stem: bytes(r.data) for r in still} == {r[0]: r[4] for r in rows}
    assert aug.copies(spark.createDataFrame([], KIND), settings, 0).collect() == []
