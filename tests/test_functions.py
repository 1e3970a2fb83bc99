import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import geometry, identity, images, names


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_boxes(spark):
    assert one(spark, *geometry.corners(*lits(0.3, 0.375, 0.4, 0.25))) == pytest.approx((0.1, 0.25, 0.5, 0.5))
    assert one(spark, *geometry.turned(*lits(0, 0, 0.25, 1))) == (0, 0, 1, 0.25)
    assert one(spark, *geometry.flipped(*lits(0.05, 0.05, 0.15, 0.15))) == pytest.approx((0.85, 0.05, 0.95, 0.15))
    assert one(spark, *geometry.pixel_box(lits(0.25, 0.25, 0.75, 0.75), F.lit(100), F.lit(80))) == (25, 20, 75, 60)
    assert one(spark, geometry.iou(lits(0, 0, 2, 2), lits(1, 1, 3, 3)), geometry.iou(lits(0, 0, 0, 0), lits(0, 0, 0, 0))) == pytest.approx((1 / 7, 0))
    assert one(spark, *geometry.rotated(lits(0.4, 0.4, 0.6, 0.6), F.lit(90.0))) == pytest.approx((0.4, 0.4, 0.6, 0.6))
    square = F.array(*lits(0.1, 0.1, 0.9, 0.1, 0.9, 0.5, 0.1, 0.5))
    assert one(spark, geometry.polygon_area(square), *geometry.polygon_bounds(square)) == pytest.approx((0.32, 0.1, 0.1, 0.9, 0.5))
    assert one(spark, geometry.margin_pixels(F.lit(10.0), F.lit(0.25)), *geometry.crop_window(lits(10, 20, 20, 60), F.lit(0.25))) == (3, 7, 10, 23, 70)
    assert one(spark, *geometry.letterbox(F.lit(100), F.lit(50), 640)) == pytest.approx((6.4, 640, 320))


@pytest.mark.parametrize(("line", "problem"), [
    ("1 .5 .5 .5 .5", None), ("nan .5 .5 .2 .2", "nonfinite/empty"), ("", "nonfinite/empty"), ("9 .5 .5 .2 .2", "class"), ("1.5 .5 .5 .2 .2", "class"), ("1 1.5 .5 .2 .2", "range"),
    ("1 .5 .5 0 .2", "area"), ("1 .1 .5 .5 .2", "box outside image"), ("1 .5 .5 .2", "arity"), ("1 .1 .1 .9 .1 .9 .5 .1", "arity"), ("1 .1 .1 .2 .2 .3 .3", "polygon area"), ("1 .1 .1 .9 .1 .9 .5", None),
])
def test_label_lines(spark, line, problem):
    assert one(spark, geometry.label_problem(F.split(F.lit(line), " "), 3)) == (problem,)


def test_names(spark):
    assert one(spark, names.stem(F.lit("a/b.c.png")), names.suffix(F.lit("a/b.c.png")), names.export_base(F.lit("x_jpg.RF.0af9.jpg")), names.numeric_family(F.lit("12_a")), names.numeric_family(F.lit("a12"))) == ("b.c", ".png", "x_jpg", "12", None)
    assert one(spark, names.label_path(F.lit("d/train/images/a/images/x.jpg")), names.prefix_family(F.lit("b_1"), ["a_", "b_"])) == ("d/train/labels/a/images/x.txt", "b_")
    units = ["scene(\\d+)", "^(-.*)?$"]
    assert one(spark, names.capture_unit(F.lit("scene7_1"), units), names.capture_unit(F.lit(""), units)) == ("0:7", "1:")
    with pytest.raises(Exception, match="no capture unit"):
        one(spark, names.capture_unit(F.lit("other"), units))
    assert one(spark, names.inside(F.lit("/a/b/c"), F.lit("/a/b")), names.inside(F.lit("/a/b/../c"), F.lit("/a/b")), names.inside(F.lit("/a/bc"), F.lit("/a/b"))) == (True, False, False)


def test_identity(spark):
    value = '{"b": [1, 2.5], "a": "é"}'
    got = one(spark, identity.canonical_hash(F.lit(value)), identity.spaced_hash(F.lit(value)), identity.short_number(F.lit(0.1)), identity.duration(F.lit(90061)), identity.duration(F.lit(59.9)), identity.subset_key(F.lit(0), F.lit(0.05)))
    data = json.loads(value)
    want = [hashlib.sha256(json.dumps(data, sort_keys=True, separators=s).encode()).hexdigest() for s in ((",", ":"), (", ", ": "))]
    assert got == (*want, "0.1", "1d 01:01:01", "00:00:59", "seed0_f00500")
    assert one(spark, identity.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), identity.hash_from_hex(F.lit("ffffffffffffffff"))) == (64, -1)
    assert one(spark, identity.group_id(F.array(F.lit("b"), F.lit("a")))) == (hashlib.sha256(b"a\nb").hexdigest()[:20],)
    assert one(spark, identity.sign_bits(F.array(*[F.lit(1.0 if i in (0, 63) else -1.0) for i in range(64)]))) == (-(2**63) + 1,)
    assert one(spark, identity.export_stem(F.lit("s"), F.lit("p"))) == ("s_" + hashlib.sha256(b"p").hexdigest()[:24],)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 255, (12, 16)).astype(float)
    lap = sum(np.roll(g, s, a) for s, a in ((1, 0), (-1, 0), (1, 1), (-1, 1)))
    assert images.sharpness(g) == pytest.approx((lap - 4 * g).var()) and images.noise(g) == pytest.approx(np.median(np.abs(g - (lap + g) / 5)))
    assert images.sharpness(g, "reflect") != images.sharpness(g) and images.sharpness(np.ones((1, 1))) == 0
    assert np.allclose(images.inverse_haar(*images.haar(g)), g)
    assert len(images.colour_features(np.zeros((4, 4, 3), np.uint8))) == 54
    blotch = np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8)))
    assert ((images.perceptual_hash(blotch) ^ images.perceptual_hash(blotch + rng.normal(size=blotch.shape))) & (2**64 - 1)).bit_count() <= 4
    assert ((images.perceptual_hash(blotch) ^ images.perceptual_hash(blotch.T)) & (2**64 - 1)).bit_count() > 8
    assert images.crop(np.arange(12).reshape(3, 4, 1), -1, 0, 2, 2)[..., 0].tolist() == [[1, 0, 1], [5, 4, 5]]
    import struct
    import zlib

    def png(a):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + r.tobytes() for r in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(rng.integers(0, 255, (20, 30, 3), dtype=np.uint8)))
    (tmp_path / "b.png").write_bytes(png(np.full((20, 30, 3), 9, np.uint8)))
    (tmp_path / "c.png").write_bytes(b"no image")
    rows = {r.path[-5:]: r for r in images.measured(spark.read.format("image").load(str(tmp_path))).collect()}
    assert (rows["a.png"].height, rows["a.png"].grayscale, rows["b.png"].grayscale, rows["b.png"].contrast) == (20, False, True, 0)
    assert rows["c.png"].corrupt and rows["c.png"].phash is None and rows["a.png"].sharpness > 0


def test_fields_of_a_line_are_read_once(spark):
    """A condition that names the numbers anew would convert each field again, dozens of times a row."""
    plan = spark.range(1).select(geometry.label_problem(F.split(F.col("id").cast("string"), " "), 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("cast(lambda") == 1
