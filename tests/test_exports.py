import hashlib
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import images
from siltworks.operators import inventory, screening, study
from siltworks.sources import annotations, exports

ROWS = "split string, stem string, suffix string, source string, `group` string, status string, content binary, image_sha256 string"
BOXES = "split string, stem string, line int, cid int, cx double, cy double, w double, h double"


def rows_of(spark, **more):
    data = [(s, f"{s}{i}", ".png", "src", f"g{s}{i}", more.get("status", "approved"), f"{s}{i}".encode(), hashlib.sha256(f"{s}{i}".encode()).hexdigest()) for s in ("train", "val", "test") for i in range(2)]
    boxes = [(s, f"{s}{i}", 1, i, 0.5, 0.5, 0.1, 0.25) for s in ("train", "val", "test") for i in range(2)]
    return spark.createDataFrame(data, ROWS), spark.createDataFrame(boxes, BOXES)


def test_export_round_trip(spark, tmp_path):
    path = str(tmp_path / "dataset")
    rows, boxes = rows_of(spark)
    exports.export_dataset(rows, boxes, path, ["rust", "dent"], "reviewed")
    assert exports.check_export(spark, path, ["rust", "dent"]).collect() == []
    assert {r.violation for r in exports.check_export(spark, path, ["dent", "rust"]).collect()} == {"class_order"}
    manifest, pictures, labels, names, counts = exports.read_export(spark, path)
    assert names == ["rust", "dent"] and counts["quality"] == "reviewed" and counts["class"]["val"] == {"rust": 1, "dent": 1} and counts["images"]["test"] == {"": 2}
    found = inventory.inventory(manifest, pictures.select("split", "stem", F.lit("p").alias("path"), F.lit(64).alias("width"), F.lit(48).alias("height")), labels, 2)
    assert [tuple(t) for t in found.where("stem = 'val1'").first().targets] == [(1, 0.45, 0.375, 0.55, 0.625)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        exports.export_dataset(rows, boxes, path, ["rust", "dent"], "reviewed")


def test_export_is_blocked(spark, tmp_path):
    rows, boxes = rows_of(spark)
    with pytest.raises(ValueError, match="train:dent"):
        exports.export_dataset(rows, boxes.where("stem <> 'train1'"), str(tmp_path / "a"), ["rust", "dent"], "reviewed")
    with pytest.raises(Exception, match="input changed during export"):
        exports.export_dataset(rows.withColumn("content", F.concat("content", F.lit(b"x"))), boxes, str(tmp_path / "b"), ["rust", "dent"], "reviewed")


def test_every_violation(spark):
    rows, boxes = rows_of(spark)
    from siltworks.sources.sinks import label_text

    labels = label_text(boxes).withColumn("sha256", F.sha2("text", 256))
    manifest = rows.join(labels.select("split", "stem", F.col("sha256").alias("label_sha256")), ["split", "stem"]).drop("content", "suffix")
    pictures = rows.select("split", "stem", F.sha2("content", 256).alias("sha256"))
    find = lambda m=manifest, i=pictures, l=labels, quality="reviewed", strict=True: {r.violation for r in inventory.violations(m, i, l, ["a", "b"], ["a", "b"], quality, strict).collect()}  # noqa: E731,E741
    assert find() == set()
    change = lambda df, stem, column, value: df.withColumn(column, F.when(F.col("stem") == stem, F.lit(value)).otherwise(F.col(column)))
    assert find(quality=None) == {"quality_missing"} and find(quality="provisional") == {"not_reviewed"} and find(quality="provisional", strict=False) == set()
    assert find(m=change(manifest, "val0", "status", "provisional")) == {"not_approved"}
    assert find(m=manifest.unionByName(manifest.where("stem = 'val0'"))) == {"repeated_image"}
    assert find(m=change(manifest, "val0", "group", "gtrain0")) == {"group_crosses_splits"}
    assert find(m=change(manifest, "val0", "image_sha256", "x")) == {"image_changed"} and find(m=change(manifest, "val0", "label_sha256", "x")) == {"label_changed"}
    assert find(i=pictures.where("stem <> 'val0'")) == {"image_missing_or_ambiguous"} and find(i=pictures.unionByName(pictures.where("stem = 'val0'"))) == {"image_missing_or_ambiguous"}
    assert find(m=manifest.where("stem <> 'val0'")) == {"outside_manifest", "class_missing"}
    assert find(l=labels.where("stem <> 'val0'")) == {"label_missing", "class_missing"}
    assert find(l=change(labels, "val0", "text", "0 1 1 1")) == {"not_a_box", "class_missing"} and find(l=change(labels, "val0", "text", "7 .1 .1 .1 .1")) == {"invalid_class", "class_missing"}
    assert "invalid_split" in find(m=change(manifest, "val0", "split", "dev")) and "empty" in find(m=manifest.limit(0))


def test_folders_lists_and_labels(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("names: {1: dent, 0: rust}\n")
    (tmp_path / "README.a.txt").write_text("of no account")
    assert exports.readme_of(spark, str(tmp_path)) is None
    (tmp_path / "README.dataset.txt").write_text("second")
    assert exports.readme_of(spark, str(tmp_path)) == ("README.dataset.txt", "second")
    (tmp_path / "README.roboflow.txt").write_text("first")
    assert exports.classes_of(spark, str(tmp_path)) == ["rust", "dent"] and exports.classes_of(spark, str(tmp_path / "none"), ["x"]) == ["x"]
    assert exports.readme_of(spark, str(tmp_path)) == ("README.roboflow.txt", "first")
    exports.run_lists(spark.createDataFrame([("train", "b"), ("train", "a"), ("val", "c")], "split string, path string"), str(tmp_path / "run"), ["rust"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "run/train")).collect()] == ["a", "b"]
    texts = spark.createDataFrame([("a", "0 .5 .5 .2 .2\n1 .1 .1 .9 .1 .9 .5 .1 .5"), ("b", "")], "path string, text string")
    got = {r.path: (r.text, r.boxes, r.polygons) for r in exports.converted_labels(texts, 2).collect()}
    assert got == {"a": ("0 0.5 0.5 0.2 0.2\n1 0.5 0.3 0.8 0.4", 1, [2]), "b": ("", 0, [])}
    with pytest.raises(Exception, match="invalid annotation: a:1"):
        exports.converted_labels(spark.createDataFrame([("a", "9 .5 .5 .2 .2")], texts.schema), 2).collect()
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("annotations.xml", '<annotations><image id="0" name="i.png" width="80" height="64"><box label="d" xtl="8" ytl="16" xbr="40" ybr="48"></box></image></annotations>')
    boxes, bad = annotations.exchange(spark, str(tmp_path / "x.zip"))
    assert [tuple(r) for r in boxes.select("x1", "y1", "x2", "y2").collect()] == [(0.1, 0.25, 0.5, 0.75)] and bad.collect() == []
    (tmp_path / "y.xml").write_text("<annotations></annotations>")
    with pytest.raises(ValueError, match="larger"):
        annotations.exchange(spark, str(tmp_path / "y.xml"), most=5)


def test_plans_and_versions(spark, tmp_path):
    path = str(tmp_path / "study")
    payload = {"code_identity": "c", "split_manifest_sha256": "s", "weights": {"m": "w"}, "seeds": [0]}
    jobs = spark.createDataFrame([("j1",), ("j2",)], "job string")
    plan = exports.store_plan(spark, path, payload, spark.createDataFrame([("s", "a")], "subset string, stem string"), jobs)
    assert exports.load_plan(spark, path, "c", "s", {"m": "w"}) == plan
    for args, why in ((("d", "s", {"m": "w"}), "code"), (("c", "t", {"m": "w"}), "data"), (("c", "s", {"m": "v"}), "weights")):
        with pytest.raises(ValueError, match=f"{why}.* changed|changed"):
            exports.load_plan(spark, path, *args)
    assert study.plan_problem({**plan, "seeds": [1]}, "c", "s", {"m": "w"}) == "the plan changed"
    assert study.plan_problem(study.stored_plan({**payload, "weights": {"m": None}}), "c", "s", {}) == "m had no weights when planned"
    status = exports.Versions(spark, f"{path}/status")
    rows, version = status.read()
    assert {r.state for r in rows.collect()} == {"pending"} and version == 0
    assert status.replace(rows.withColumn("state", F.lit("running")), 0) == 1 and {r.state for r in status.read()[0].collect()} == {"running"}
    with pytest.raises(ValueError, match="changed meanwhile"):
        status.replace(rows, 0)
    (tmp_path / "study/status/attempts/2").mkdir()  # an interrupted write
    assert status.read()[1] == 1 and status.replace(rows, 1) == 2 and status.unclaimed() == ["2"]
    cache = str(tmp_path / "cache")
    (tmp_path / "cache").mkdir()  # of an interrupted build
    assert exports.attempt(spark, cache) == f"{cache}_incomplete_1" and exports.attempt(spark, cache) is None
    spark.range(1).write.parquet(cache)
    with pytest.raises(ValueError, match="there already"):
        exports.attempt(spark, cache)
    good = {"seeds": [0, 1], "models": {"m": {"backend": "x"}}, "arms": {"a": {"kind": "real"}}}
    assert study.plan_problems(good, ["x"], ["real"]) == [] and len(study.plan_problems({"seeds": [0, 0], "models": {"m": {"backend": "y"}}, "arms": {}}, ["x"], ["real"])) == 3
    assert study.sources_of(["s"], {"s": "D1"}, False) == ["D1"]
    for bad in ([], ["s", "s"], ["t"], ["s", "r"]):
        with pytest.raises(ValueError):
            study.sources_of(bad, {"s": "D1", "r": "D2"}, False)
    assert study.names_differ({1: "b", 0: "a"}, ["a", "b"]) is False and study.names_differ({0: "b"}, ["a"])
    providers = study.RowProviders()
    providers.register("real", lambda x: x)
    assert providers.rows("real", 5) == 5 and "pyspark" in study.environment()
    with pytest.raises(ValueError, match="no rows"):
        providers.rows("other")


def test_settings():
    assert screening.settings_for({"min_side": 8})["min_side"] == 8
    for bad in ({"x": 1}, {"min_side": True}, {"min_side": 0}, {"min_side": 1.5}, {"min_gray_std": float("nan")}, {"min_gray_std": -1}, {"near_duplicate_hamming": 65}, {"min_gray_std": "5"}):
        with pytest.raises(ValueError):
            screening.settings_for(bad)


def test_near_copies_of_accepted_rows_only(spark):
    """A rejected row is not compared with; of accepted ones the first is named."""
    cols = "seq long, id string, error string, sha256 string, expected_sha256 string, width long, height long, gray_std double, laplacian_variance double, pixel_hash string, phash long, checkpoint_now string, checkpoint_sha256 string, class_id int, class_name string"
    row = lambda i, pixel, phash, **k: (i, f"r{i}", k.get("error"), "s", k.get("expected", "s"), 99, 99, 50.0, 50.0, pixel, phash, "c", "c", 0, "a")
    rows = [row(0, "p0", 0, expected="other"), row(1, "p1", 1), row(2, "p1", 1), row(3, "p3", 3), row(4, "p4", 255), row(5, "p5", 7), row(6, "p6", 0, error="OSError")]
    got = {r.id: (r.outcome, r.codes) for r in screening.screen(spark.createDataFrame(rows, cols), "candidates", ["a"]).collect()}
    assert got["r0"] == ("reject", ["image_hash_mismatch"]) and got["r1"] == ("pass", []) and got["r2"] == ("reject", ["exact_duplicate_of:r1"])
    assert got["r3"] == ("needs_review", ["near_duplicate_of:r1"]) and got["r4"] == ("pass", []) and got["r5"] == ("needs_review", ["near_duplicate_of:r1"]) and got["r6"] == ("reject", ["unreadable_or_invalid:OSError"])


def test_picks(spark):
    rows = spark.createDataFrame([("x", "g1", 0.9), ("x", "g2", 0.5), ("y", "g1", 0.8), ("y", "g3", 0.2)], "c string, g string, s double")
    assert inventory.most_without_repeats(rows, "c", "g", "s") == [("x", "g1"), ("y", "g3")]
    frame = spark.createDataFrame([(i, b"abc" if i else b"xyz", hashlib.sha256(b"abc").hexdigest(), "v") for i in range(3)], "id long, content binary, sha256 string, col string")
    good, bad = exports.patches(frame, spark.createDataFrame([(0, "v"), (1, "v")], "id long, col string"), "id", ["col"])
    assert [r.id for r in good.collect()] == [1] and sorted((r.violation, r.key) for r in bad.collect()) == [("no_source", "2"), ("patch_changed", "0")]


def test_image_files():
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    block = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xd9"
    assert images.orientation(jpeg) == 6 and images.orientation(b"\x89PNG") == 1 and images.orientation(b"\xff\xd8\xff") == 1
    grid = np.arange(64 * 64).reshape(64, 64) % 256
    assert images.resized(np.full((50, 70), 7), 32).tolist() == np.full((32, 32), 7).tolist() and images.resized(grid, 32).shape == (32, 32)
    weights = images.lanczos(100, 32)
    assert np.abs(weights.sum(axis=1) - (1 << 22)).max() < 100 and (images.lanczos(32, 32).argmax(axis=1) == np.arange(32)).all()
    assert images.luma(np.array([[[255, 255, 255], [0, 0, 255]]], np.uint8)).tolist() == [[255, 76]]
    assert json.dumps(images.perceptual_hash(grid)).lstrip("-").isdigit()
