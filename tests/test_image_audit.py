import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import names
from siltworks.operators import image_audit, inventory, models, screening
from siltworks.sources import exports


def test_split_inventory(spark):
    images = spark.createDataFrame([("train", "a", False), ("train", "a", None), ("train", "b", True), ("val", "c", False)], "split string, stem string, corrupt boolean")
    labels = spark.createDataFrame([("train", "a", "0 1"), ("train", "z", " \n\t"), ("test", "q", "1")], "split string, stem string, text string")
    got = {r.split: tuple(r)[1:] for r in image_audit.split_inventory(images, labels).collect()}
    assert got == {"train": (3, 2, 1, 1, 1, 1, False), "val": (1, 0, 0, 1, 0, 0, False), "test": (None,) * 6 + (True,)}
    none = image_audit.split_inventory(images.limit(0), labels.limit(0)).collect()
    assert len(none) == 3 and all(r.missing and r.images is None for r in none)


def test_common_values_and_shapes(spark):
    rows = spark.createDataFrame([(i, "s", v) for i, v in enumerate("bbaacde" + "f")] + [(99, None, "x")], "i int, s string, v string")
    top = [(r.s, r.v, r.n) for r in image_audit.most_common(rows, ["s"], "v", "i").collect()]
    # of the values seen once the earliest stay
    assert set(top) == {("s", "a", 2), ("s", "b", 2), ("s", "c", 1), ("s", "d", 1), ("s", "e", 1), (None, "x", 1)} and len(top) == 6
    sizes = spark.createDataFrame([("s", w, 2, False) for w in (1, 2, 4, 9)] + [("s", 100, 2, True), ("s", 5, 0, False), ("t", 7, 7, True), (None, 6, 3, False)], "s string, w int, h int, bad boolean")
    got = {r.s: tuple(r)[1:] for r in image_audit.aspect_quantiles(sizes, ["s"], "w", "h", F.col("bad")).collect()}
    assert got["s"] == tuple(np.percentile([0.5, 1, 2, 4.5], [0, 25, 50, 75, 100])) and got["t"] == (1,) * 5 and got[None] == (2,) * 5
    gray = spark.createDataFrame([("s", True, False), ("s", None, False), ("s", True, True), ("t", True, True)], "s string, g boolean, bad boolean")
    assert {r.s: (r.readable, r.share) for r in image_audit.grayscale_share(gray, ["s"], F.col("g"), F.col("bad")).collect()} == {"s": (2, 0.5), "t": (0, 0.0)}
    images = spark.createDataFrame([("train", i) for i in range(4)], "split string, k int")
    boxes = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (3, "d")], "k int, c string")
    assert {r.bucket: r.images for r in image_audit.class_buckets(images, boxes, "split", "k", "c").collect()} == {"0": 1, "1": 1, "2": 1, "3+": 1}


def test_polygon_sample(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", "fg"[i % 2], "ab"[rng.integers(2)], "polygon" if rng.integers(3) else "box", int(rng.integers(3, 9))) for i in range(60) for _ in range(rng.integers(1, 4))]
    shapes = spark.createDataFrame(rows, "k string, family string, cls string, kind string, points int")
    want = {}
    polygons = sorted({r[0] for r in rows if r[3] == "polygon"})
    of = lambda k, kinds: max(r[4] for r in rows if r[0] == k and r[3] in kinds)
    for c in "ab":
        mine = sorted((k for k in polygons if any(r[0] == k and r[2] == c and r[3] == "polygon" for r in rows)), key=lambda k: of(k, ("polygon",)))
        for spot in {0, len(mine) // 4, len(mine) // 2, 3 * len(mine) // 4, len(mine) - 1}:
            want.setdefault(mine[spot], set()).add(f"class:{c}")
    for f in "fg":
        best = max((k for k in polygons if int(k) % 2 == "fg".index(f)), key=lambda k: of(k, ("polygon", "box")))
        want.setdefault(best, set()).add(f"family:{f}")
    found = image_audit.polygon_sample(shapes, "k", "family", ["a", "b", "missing"])
    assert {r.k: r.reasons for r in found.collect()} == {k: sorted(v) for k, v in want.items()}
    assert image_audit.polygon_sample(shapes.limit(0), "k", "family", ["a"]).collect() == []
    texts = spark.createDataFrame([("d/img12_jpg.rf.ab.jpg",), ("12.png",), ("plain.rf.9.jpg",), ("",)], "n string")
    assert [r[0] for r in texts.select(names.digit_family(F.col("n"))).collect()] == ["img", "numeric", "plain", "numeric"]


def test_smoke_sample(spark):
    images = spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    boxes = spark.createDataFrame([("a", 0, 9), ("b", 0, 1), ("c", 0, 9), ("c", 0, 9), ("d", 1, 9), ("d", 1, 9), ("e", 0, 9), ("f", 2, 1)], "k string, c int, side int")
    usable = F.col("side") >= 8
    pick = lambda limit, classes=(0, 1): sorted(r.k for r in inventory.smoke_sample(images, boxes, "k", "c", usable, limit, classes).collect())
    assert pick(3) == ["a", "c", "d"] and pick(5) == ["a", "b", "c", "d", "e"] and pick(50) == list("abcdef")
    for limit, classes, why in ((2, (0, 1), "need 3 images of 2"), (9, (0, 1, 2), "too few of")):
        with pytest.raises(ValueError, match=why):
            pick(limit, classes)


def softmax_fit(x, y, classes):
    """Weights of a multinomial regression by plain gradient steps: summed loss and half the squared weights."""
    w, b, one = np.zeros((x.shape[1], classes)), np.zeros(classes), np.eye(classes)[y]
    for _ in range(20_000):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= (x.T @ (p - one) + w) * 0.01
        b -= (p - one).sum(0) * 0.01
    return w, b


def test_predictions_equal_another_fit(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(3, size=90)
    x = rng.normal(size=(90, 2)) + 1.2 * np.array([[0, 0], [1, 1], [1, -1]])[y]
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], "abc"[y[i]]) for i in range(90)] + [(100, None, "a"), (101, [1.0, 1.0], None)], "k int, f array<double>, y string")
    at = {r.k: r.fold for r in models.folds_of(frame.where("f IS NOT NULL AND y IS NOT NULL"), "k", "y", 3).collect()}
    fold = np.array([at[i] for i in range(90)])
    for c in range(3):  # stratified
        sizes = np.bincount(fold[y == c], minlength=3)
        assert sizes.max() - sizes.min() <= 1
    want = np.empty(90, int)
    for k in range(3):
        train = fold != k
        mean, sd = x[train].mean(0), x[train].std(0, ddof=1)
        w, b = softmax_fit((x[train] - mean) / sd, y[train], 3)
        want[~train] = ((x[~train] - mean) / sd @ w + b).argmax(1)
    found = models.predictions(frame, "k", "f", "y", folds=3)
    got = {r.k: r.predicted for r in found.collect()}
    assert sorted(got) == list(range(90)) and sum(got[i] == "abc"[want[i]] for i in range(90)) >= 89
    cells = models.told(found).collect()
    right = sum(got[i] == "abc"[y[i]] for i in range(90))
    assert sum(r.n for r in cells) == 90 and {round(r.accuracy, 9) for r in cells} == {round(right / 90, 9)}


def test_crop_settings_and_review_items(spark):
    assert screening.crop_settings() == {"margin": 0.0, "min_box_side": 8, "canonical_orientation": False}
    assert screening.crop_settings({"margin": 0, "canonical_orientation": True}, 4) == {"margin": 0.0, "min_box_side": 4, "canonical_orientation": True}
    for wrong in ({"x": 1}, {"margin": True}, {"margin": 0.6}, {"margin": float("nan")}, {"margin": "0"}, {"min_box_side": 0}, {"min_box_side": 2.0}, {"min_box_side": True}, {"canonical_orientation": 1}):
        with pytest.raises(ValueError, match="crop settings|can't be"):
            screening.crop_settings(wrong)
    subject = json.loads(screening.subject(spark.createDataFrame([("i", "p")], "id string, path string"), "candidates").first().subject)
    assert subject["id"] == "i" and subject["gan_identity"] is None and len(subject) == 8
    placed = spark.createDataFrame([("p", "bg", "h", 1, 2, 3, 4), ("q", "gone", "h", 0, 0, 1, 1)], "id string, background string, background_sha256 string, x int, y int, w int, h int")
    grounds = spark.createDataFrame([("bg", "b.png")], "background string, path string")
    got = {r.id: (r.path, [tuple(b) for b in r.boxes]) for r in screening.review_items(placed, "placements", backgrounds=grounds).collect()}
    assert got == {"p": ("b.png", [("placement", 1, 2, 4, 6)]), "q": (None, [("placement", 0, 0, 1, 1)])}
    made = spark.createDataFrame([("c", "c.png", "s", 10, 20, [(1, 0.1, 0.2, 0.5, 1.0)])], "id string, path string, sha256 string, width int, height int, targets array<struct<cid:int,x1:double,y1:double,x2:double,y2:double>>")
    assert [tuple(b) for b in screening.review_items(made, "composites", ["a", "b"]).first().boxes] == [("b", 1.0, 4.0, 5.0, 20.0)]
    assert screening.review_items(made, "candidates").first().boxes == []
    for call in (lambda: screening.review_items(made, "other"), lambda: screening.review_items(placed, "placements")):
        with pytest.raises(ValueError, match="stage|backgrounds"):
            call()


def test_scan_outputs(spark, tmp_path):
    rows = [("A", "b.png", "approved", "g", "u", 0, 1), ("B", "a.png", "approved", "g", None, 2, 0), ("A", "c.png", "pending", "h", "u", 1, 2)]
    records = spark.createDataFrame(rows, "source string, image string, status string, group string, unit string, boxes int, duplicates int")
    folder = str(tmp_path / "scan")
    summary = exports.write_scan(spark, folder, records, {"threshold": 5}, {"note": "é"})
    assert summary["status_counts"] == {"approved": 2, "pending": 1} and (summary["similarity_groups"], summary["cross_source_groups"], summary["capture_units"], summary["duplicate_rows_removed"]) == (2, 1, 1, 3)
    assert summary["sources"]["A"] == {"images": 2, "empty": 1, "statuses": {"approved": 1, "pending": 1}}
    assert json.loads(exports.read_text(spark, f"{folder}/summary.json")) == summary and json.loads(exports.read_text(spark, f"{folder}/run_info.json")) == {"note": "é"}
    groups = spark.read.json(f"{folder}/groups")
    assert {(r.group, r.source, r.image) for r in groups.collect()} == {("g", "A", "b.png"), ("g", "B", "a.png"), ("h", "A", "c.png")}
    with pytest.raises(Exception, match="exist"):
        exports.write_scan(spark, folder, records, {}, {})
