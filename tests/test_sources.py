import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltworks.sources import annotations, sinks


def test_labels(spark):
    texts = spark.createDataFrame([("a", "0 .1 .1 .9 .1 .9 .5 .1 .5\n0 .1 .1 .9 .1 .9 .5 .1 .5\n\n"), ("b", "nan 1\n1 .5 .5 .2 .2"), ("c", "")], "path string, text string")
    got = {r.path: r for r in annotations.normalised_annotations(texts, ["rust", "dent"], {"rust": "Rust"}, ["Rust"]).collect()}
    assert len(got["a"].annotations) == 1 and got["a"].duplicates == 1 and got["a"].annotations[0].box[2] == pytest.approx(0.8)
    assert got["b"].issues == ["invalid:nonfinite/empty", "unmapped_class:dent"] and "c" not in got


def test_coco(spark, tmp_path):
    def export(name, **more):
        data = {"categories": [{"id": 0, "name": "unused"}, {"id": 7, "name": "rust"}], "images": [{"id": 1, "file_name": "image.png", "width": 100, "height": 80}, {"id": 2, "file_name": "none.png", "width": 100, "height": 80}]}
        data["annotations"] = [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 20, 40, 20]}, {"id": 2, "image_id": 1, "category_id": 7, "bbox": [90, 20, 40, 20]}]
        (tmp_path / name).write_text(json.dumps(data | more))
        return str(tmp_path / name)

    boxes, bad = annotations.coco(spark, {"train": export("a.json"), "val": export("b.json")})
    assert bad.collect() == []
    rows = sorted(boxes.where("split = 'val'").collect(), key=lambda r: (r.image_id, r.annotation_id or 0))
    assert (rows[0].cx, rows[0].cy, rows[0].w, rows[0].h) == pytest.approx((0.3, 0.375, 0.4, 0.25)) and rows[0].issue is None and rows[0].category == "rust"
    assert [r.issue for r in rows] == [None, "box outside image", None] and rows[2].annotation_id is None
    path = export("c.json", annotations=[{"id": 1, "image_id": 99, "category_id": 3, "bbox": [0, 0, 1, 1]}, {"id": 1, "image_id": 1, "category_id": 7, "bbox": [0, 0, 1, 1]}], images=[{"id": 1, "file_name": "../image.png", "width": 1, "height": 1}])
    assert {r.violation for r in annotations.coco(spark, {"train": path})[1].collect()} == {"unknown_image", "unknown_category", "repeated_annotation", "unsafe_path"}


def test_reviews(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b"\xef\xbb\xbfimage,action\na,approve\nb,\n")
    assert annotations.reviews(spark, str(tmp_path / "r.csv")).count() == 2
    for text in ("image,action\na,approve\na,\n", "image,action\na,what\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError, match="unique"):
            annotations.reviews(spark, str(tmp_path / "bad.csv"))


def test_exchange(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<annotations><image id="0" name="i.png" width="80" height="64"><box label="d" xtl="8" ytl="16" xbr="40" ybr="48"></box><box label="d" xtl="8" ytl="16" xbr="99" ybr="48"></box></image></annotations>')
    boxes, bad = annotations.exchange(spark, str(tmp_path / "x.xml"))
    assert [tuple(r) for r in boxes.select("x1", "y1", "x2", "y2").collect()] == [(0.1, 0.25, 0.5, 0.75)]
    assert [tuple(r) for r in bad.collect()] == [("box outside image", "i.png")]
    (tmp_path / "y.xml").write_text("<!DOCTYPE x><annotations></annotations>")
    with pytest.raises(ValueError, match="DOCTYPE"):
        annotations.exchange(spark, str(tmp_path / "y.xml"))


def test_files(spark, tmp_path):
    (tmp_path / "d/train/images").mkdir(parents=True)
    (tmp_path / "d/train/images/a.JPG").write_bytes(b"x")
    (tmp_path / "d/train/images/a.txt").write_bytes(b"x")
    assert [(r.split, r.stem) for r in annotations.image_files(spark, str(tmp_path / "d")).collect()] == [("train", "a")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("valid/images/a.png", b"1")
        z.writestr("valid/labels/a.txt", b"2")
        z.writestr("other.txt", b"3")
    got = {(r.split, r.kind, r.name, bytes(r.content)) for r in annotations.archive_members(spark, str(tmp_path / "z.zip")).collect()}
    assert got == {("val", "images", "a.png", b"1"), ("val", "labels", "a.txt", b"2")}
    assert annotations.resolve(["One", "two"], "ONE") == "One" and annotations.class_names({1: "b", 0: "a"}) == ["a", "b"]
    with pytest.raises(ValueError, match="2 folders"):
        annotations.resolve(["xa", "xb"], "x", exactly=True)
    with pytest.raises(ValueError, match="JSON list"):
        annotations.subset_list("null")
    texts = ["dataset - v3 2024, v9 of the tool\nThe dataset includes 12 images.\nNo image augmentation techniques", "v7\nAugmentation was applied to create 3 versions: \nflip\nPre-processing was applied: resize\nno image augmentation", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", annotations.readme_facts(F.col("t"), F.lit("README.dataset.txt")))
    named = {"file": "README.dataset.txt"}
    assert [r.facts for r in rows.orderBy("i").collect()] == [
        named | {"version_line": "- v3", "augmentation": "none stated", "image_count_readme": "12"},
        named | {"augmentation": "Augmentation was applied to create 3 versions:", "preprocessing": "Pre-processing was applied: resize"}, named, {},
    ]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k long, a string"), spark.createDataFrame([(2, 0.5)], "k long, b double")
    assert sinks.union_csv([a, b], str(tmp_path / "u")) == ["k", "a", "b"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.manifest(a, str(tmp_path / "u"))
    with pytest.raises(Exception, match="not finite"):
        sinks.finite(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    records = spark.createDataFrame([("i", True, "approve", ["p", "q"]), ("j", False, "approve", [])], "image string, stale boolean, action string, issues array<string>")
    sinks.review_queue(records, str(tmp_path / "q"))
    got = {r.image: (r.action, r.notes) for r in spark.read.option("header", True).csv(str(tmp_path / "q")).fillna("").collect()}
    assert got == {"i": ("", "p; q"), "j": ("approve", "")}
    boxes = spark.createDataFrame([("train", "s", 2, 1, 0.1, 0.2, 0.3, 0.4), ("train", "s", 1, 0, 0.5, 0.5, 1.0, 1.0)], "split string, stem string, line int, cid int, cx double, cy double, w double, h double")
    assert sinks.label_text(boxes).first().text == "0 0.5 0.5 1 1\n1 0.1 0.2 0.3 0.4"
    sinks.export(sinks.label_text(boxes), str(tmp_path / "e"))
    assert (tmp_path / "e/split=train").is_dir()
    path = str(tmp_path / "f.json")
    sinks.write_json({"a": 1}, path)
    with pytest.raises(FileExistsError):
        sinks.write_json({}, path)
    with pytest.raises(ValueError, match="JSON compliant"):
        sinks.write_json(float("nan"), str(tmp_path / "g.json"))
    with pytest.raises(ValueError, match="changed"):
        sinks.replace_file("new", path, expected="other")
    sinks.replace_file("new", path)
    assert open(path).read() == "new" and sinks.markdown(a, "T").startswith("# T\n\n| k | a |")
