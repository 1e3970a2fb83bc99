import base64
import hashlib
import json
import random

import pytest

from siltworks.sources import coco, json_arrays


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    """Many ranges in few tasks."""
    monkeypatch.setattr(json_arrays, "MAX_TASKS", 4)


PIXEL = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def texts(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "\n", " ", "漢"]) for _ in range(rng.randrange(30)))


@pytest.mark.parametrize("target", [1, 7, 200, 1 << 20])
def test_objects_of_any_range(spark, tmp_path, target):
    """Texts full of quotes, backslashes and brackets; nested values, other values of the root, two documents."""
    rng, want, paths = random.Random(target), set(), []
    for n in range(2):
        rows = {k: [{"id": i, "t": texts(rng), "more": [{"x": [texts(rng)]}, []]} for i in range(25 if target > 7 else 2)] for k in ("a", 'b"\\é', "c")}
        document = {"info": {"a": [{"id": 99}], "deep": {"x": {}}}, **rows, "numbers": [1, [{"no": 1}]], "none": [], "text": "[{"}
        path = tmp_path / f"{n}.json"
        path.write_bytes(b"\xef\xbb\xbf" * n + json.dumps(document, ensure_ascii=bool(n), indent=n or None).encode())
        paths.append(str(path))
        want |= {(str(path), k, json.dumps(x, sort_keys=True)) for k, found in rows.items() for x in found}
    found = json_arrays.elements(spark, paths, target).collect()
    assert len(found) == len(want) and {(r.path, r.section, json.dumps(json.loads(r.text), sort_keys=True)) for r in found} == want


def test_documents_that_are_not_whole(spark, tmp_path):
    path = tmp_path / "x.json"
    for text in ('{"a": [{"id": 1}', '{"a": [{"id": "}]}', "}{"):
        path.write_text(text)
        with pytest.raises(ValueError, match="whole"):
            json_arrays.elements(spark, [str(path)], 4)
    path.write_text('[{"a": []}]')
    with pytest.raises(Exception, match="no object"):
        json_arrays.elements(spark, [str(path)])
    path.write_text("")
    assert json_arrays.elements(spark, [str(path)]).count() == 0 and json_arrays.elements(spark, []).count() == 0
    with pytest.raises(ValueError, match="no file"):
        json_arrays.elements(spark, [str(tmp_path / "none.json")])


def export(root, first, splits=("train", "val", "test"), **more):
    for split in splits:
        folder = root / "images" / split if first else root / ("valid" if split == "val" else split)
        folder.mkdir(parents=True)
        (folder / f"{split}.png").write_bytes(PIXEL)
        data = {"images": [{"id": 1, "file_name": f"./{split}.png", "width": 1, "height": 1}], "categories": [{"id": 10, "name": "b"}, {"id": 9, "name": "a"}]}
        data["annotations"] = [{"id": 5, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 0.5]}, {"id": 6, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 0.5]}, {"id": 7, "image_id": 1, "category_id": 10, "bbox": [0, 0, 1, 1], "iscrowd": 1}]
        data["annotations"] += [{"id": 8, "image_id": 1, "category_id": 9, "bbox": b} for b in ([0, 0, 1], ["x", 0, 1, 1], [0.5, 0, 1, 1], None)]
        for i, a in enumerate(data["annotations"]):
            a["id"] = i
        label = root / "annotations" / f"instances_{split}.json" if first else folder / "_annotations.coco.json"
        label.parent.mkdir(exist_ok=True)
        label.write_text(json.dumps(data | more.get(split, {})))
    return str(root)


@pytest.mark.parametrize("first", [True, False])
def test_scan_of_both_layouts(spark, tmp_path, first):
    root = export(tmp_path, first)
    rows = {r.split: r for r in coco.scan(spark, root, {"a": "rust"}, ["dent", "rust"], target=50).collect()}
    assert set(rows) == {"train", "val", "test"}
    r = rows["val"]
    assert r.file == ("images/val/val.png" if first else "valid/val.png") and r.file_sha256 == hashlib.sha256(PIXEL).hexdigest()
    assert r.label_sha256 == hashlib.sha256(open(r.path, "rb").read()).hexdigest()
    stated = json.dumps({"categories": {9: "a", 10: "b"}, "mapping": {"a": "rust"}, "targets": ["dent", "rust"]}, sort_keys=True)
    assert r.class_order == {9: "a", 10: "b"}
    assert r.schema_sha256 == hashlib.sha256(json.dumps(json.loads(stated), sort_keys=True).encode()).hexdigest()
    assert r.issues == ["coco_box_outside_image", "invalid_coco_box", "unmapped_class:b", "unsupported_crowd_annotation"] and r.duplicates == 1 and not r.empty
    assert [(a.line, a.source_class, a.target_class, a.target_id, a.box) for a in r.annotations] == [(0, "a", "rust", 1, [0.5, 0.25, 1.0, 0.5]), (2, "b", None, None, [0.5, 0.5, 1.0, 1.0])]


def test_files_that_differ(spark, tmp_path):
    root = export(tmp_path, True, ["train"], train={"images": [{"id": 1, "file_name": "train.png", "width": 2, "height": 1}, {"id": 2, "file_name": "bad.png", "width": 1, "height": 1}], "annotations": []})
    (tmp_path / "images/train/bad.png").write_bytes(b"no image")
    rows = {r.file: r for r in coco.scan(spark, root, {}, [], ["train"]).collect()}
    assert {f: (r.issues, r.empty, r.annotations) for f, r in rows.items()} == {"images/train/train.png": (["coco_dimension_mismatch"], True, []), "images/train/bad.png": (["corrupt_image"], True, [])}


def test_fatal_cases(spark, tmp_path):
    images = [{"id": 1, "file_name": "a/../train.png", "width": 1, "height": 1}, {"id": 1, "file_name": "train.png", "width": 0, "height": 1}, {"id": 2, "file_name": "../x.png", "width": 1, "height": 1}]
    images += [{"id": 3, "file_name": "/x.png", "width": 1, "height": 1}, {"id": 4, "file_name": "gone.png", "width": 1}]
    more = {"images": images, "categories": [{"id": 1, "name": "a"}, {"id": 1, "name": "b"}], "annotations": [{"id": 1, "image_id": 9, "category_id": 1}, {"id": 1, "image_id": 2, "category_id": 3}]}
    root = export(tmp_path, True, ["train"], train=more)
    (tmp_path / "images/train/new.PNG").write_bytes(PIXEL)
    parts = coco.tables(spark, coco.layout(root, ["train"]))
    found = {(r.violation, r.key) for r in coco.violations(parts, coco.image_facts(spark, root)).collect()}
    assert found == {
        ("repeated_category", "1"), ("repeated_image", "1"), ("repeated_annotation", "1"), ("unknown_image", "9"), ("unknown_category", "3"), ("unsafe_path", "../x.png"), ("unsafe_path", "/x.png"),
        ("repeated_path", "images/train/train.png"), ("invalid_dimensions", "train.png"), ("invalid_dimensions", "gone.png"), ("missing_file", "images/train/gone.png"), ("unlisted_file", "images/train/new.PNG"),
    }
    with pytest.raises(ValueError, match="invalid_dimensions"):
        coco.scan(spark, root, {}, [], ["train"])
    with pytest.raises(ValueError, match="no document"):
        coco.layout(root, ["val"])
