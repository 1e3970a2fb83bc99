"""Technical screening: reasons to reject and flags for review, in one plan.

Rows carry what was measured of an image (null ``error`` if it could be read);
their order is ``seq``. An image that equals an earlier one without reasons is
rejected; one that is near an earlier accepted image is flagged with the first
of them. Rejected rows are never compared with, and since which rows are
accepted depends on reasons and equality alone, no row has to wait for another.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import neardup
from .quality_gates import codes, outcome

VERSION = 1
#: The limits that apply unless a study sets others.
DEFAULTS = {"min_side": 16, "min_gray_std": 5.0, "min_laplacian_variance": 15.0, "near_duplicate_hamming": 2}
STAGES = ("candidates", "composites")


def settings_for(given: Mapping | None = None) -> dict:
    """The defaults with a study's settings; unknown names, truth values, text, negative and unfit numbers are errors."""
    out = {**DEFAULTS, **(given or {})}
    unknown = sorted(set(out) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"unknown screening settings: {unknown}")
    for name, value in out.items():
        whole = name in ("min_side", "near_duplicate_hamming")
        fits = type(value) is int or not whole and type(value) is float and math.isfinite(value)
        if not fits or value < 0 or name == "min_side" and value < 1 or name == "near_duplicate_hamming" and value > 64:
            raise ValueError(f"{name} can't be {value!r}")
    return out


def crop_settings(given: Mapping | None = None, min_side: int = 8) -> dict:
    """How patches are cut: margin (a share of each side, up to a half), min_box_side and canonical_orientation.

    Unknown names, truth values as numbers, and numbers out of range are errors.
    """
    out = {"margin": 0.0, "min_box_side": min_side, "canonical_orientation": False}
    unknown = sorted(set(given or {}) - set(out))
    if unknown:
        raise ValueError(f"unknown crop settings: {unknown}")
    out.update(given or {})
    margin, side = out["margin"], out["min_box_side"]
    fits = {
        "margin": type(margin) in (int, float) and 0 <= margin <= 0.5,  # false for NaN
        "min_box_side": type(side) is int and side >= 1,
        "canonical_orientation": type(out["canonical_orientation"]) is bool,
    }
    if bad := [name for name, fine in fits.items() if not fine]:
        raise ValueError(", ".join(f"{name} can't be {out[name]!r}" for name in bad))
    return {**out, "margin": float(margin)}


def subject(rows: DataFrame, stage: str) -> DataFrame:
    """(id, subject): what a receipt vouches for, as JSON; it differs by stage, and a field that rows lack is null."""
    if stage not in STAGES:
        raise ValueError(f"a stage is one of {STAGES}")
    fields = {"candidates": ("id", "path", "sha256", "class_id", "class_name", "checkpoint", "checkpoint_sha256", "gan_identity"), "composites": ("id", "path", "sha256", "label_sha256", "width", "height")}[stage]
    held = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return rows.select("id", F.to_json(F.struct(*held), {"ignoreNullFields": "false"}).alias("subject"))


BOX = "array<struct<label: string, x1: double, y1: double, x2: double, y2: double>>"


def review_items(rows: DataFrame, stage: str, names: Sequence[str] = (), backgrounds: DataFrame | None = None) -> DataFrame:
    """(id, path, sha256, boxes): what a reviewer is shown of a row, boxes in pixels.

    candidates: id, path, sha256; no boxes. placements: id, background,
    background_sha256, x, y, w, h; the image is the background's (background,
    path) and the rectangle is a box named placement. composites: id, path,
    sha256, width, height, targets (cid and corners in shares of the image).
    A placement without its background has a null path.
    """
    if stage == "candidates":
        return rows.select("id", "path", "sha256", F.array().cast(BOX).alias("boxes"))
    if stage == "placements":
        if backgrounds is None:
            raise ValueError("placements need their backgrounds")
        x, y, w, h = (F.col(c).cast("double") for c in "xywh")
        box = F.struct(F.lit("placement").alias("label"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
        of = backgrounds.select("background", F.col("path").alias("__path"))
        return rows.join(of, "background", "left").select("id", F.col("__path").alias("path"), F.col("background_sha256").alias("sha256"), F.array(box).cast(BOX).alias("boxes"))
    if stage == "composites":
        label = lambda t: F.get(F.array(*[F.lit(n) for n in names]), t["cid"])
        scaled = lambda t: F.struct(label(t).alias("label"), *[(t[c] * F.col("width" if c[0] == "x" else "height")).alias(c) for c in ("x1", "y1", "x2", "y2")])
        return rows.select("id", "path", "sha256", F.transform("targets", scaled).cast(BOX).alias("boxes"))
    raise ValueError("a stage is candidates, placements or composites")


def _candidate(names: Sequence[str]) -> dict[str, Column]:
    listed = F.array(*[F.lit(n) for n in names])
    cid = F.col("class_id")
    known = cid.isNotNull() & (cid >= 0) & (cid < len(names)) & F.get(listed, cid.cast("int")).eqNullSafe(F.col("class_name"))
    return {"checkpoint_hash_mismatch": ~F.col("checkpoint_now").eqNullSafe(F.col("checkpoint_sha256")), "invalid_class": ~F.coalesce(known, F.lit(False))}


def _composite(names: Sequence[str]) -> dict[str, Column]:
    x, y, w, h = (F.col(f"region.{c}") for c in "xywh")
    inside = (F.least(x, y) >= 0) & (F.least(w, h) > 0) & (x + w <= F.col("width")) & (y + h <= F.col("height"))
    unit = lambda t: (t["x1"] >= 0) & (t["x1"] < t["x2"]) & (t["x2"] <= 1) & (t["y1"] >= 0) & (t["y1"] < t["y2"]) & (t["y2"] <= 1) & (t["cid"] >= 0) & (t["cid"] < len(names))
    return {
        "invalid_composite_region": ~F.coalesce(inside, F.lit(False)),
        "label_hash_mismatch": ~F.col("label_now").eqNullSafe(F.col("label_sha256")),
        "labels_disagree_with_targets": ~F.col("label_text").eqNullSafe(F.col("target_text")),
        "dimension_mismatch": ~(F.col("record_width").eqNullSafe(F.col("width")) & F.col("record_height").eqNullSafe(F.col("height"))),
        "invalid_target_box": F.exists("targets", lambda t: ~F.coalesce(unit(t), F.lit(False))),
    }


def screen(rows: DataFrame, stage: str, names: Sequence[str], given: Mapping | None = None) -> DataFrame:
    """``rows`` with reasons, flags, outcome and codes (reasons and flags, sorted).

    rows: seq, id, error, sha256, expected_sha256, width, height, gray_std,
    laplacian_variance, pixel_hash, phash; candidates: checkpoint_now,
    checkpoint_sha256, class_id, class_name; composites: region (x, y, w, h),
    label_now, label_sha256, label_text, target_text, record_width,
    record_height, targets, and the two measures are of the region.
    """
    limits = settings_for(given)
    if stage not in STAGES:
        raise ValueError(f"a stage is one of {STAGES}")
    read = F.col("error").isNull()
    own = _candidate(names) if stage == "candidates" else _composite(names)
    reasons = codes(image_hash_mismatch=~F.col("sha256").eqNullSafe(F.col("expected_sha256")), **{k: read & c for k, c in own.items()})
    broken = F.when(~read, F.array(F.concat(F.lit("unreadable_or_invalid:"), "error"))).otherwise(F.array().cast("array<string>"))
    small = {"small_image": F.least("width", "height") < limits["min_side"]}
    if stage == "composites":
        small["small_inserted_region"] = ~own["invalid_composite_region"] & (F.least("region.w", "region.h") < limits["min_side"])
    flags = codes(**{k: read & c for k, c in {**small, "low_contrast_or_blank": F.col("gray_std") < limits["min_gray_std"], "low_detail_or_blur": F.col("laplacian_variance") < limits["min_laplacian_variance"]}.items()})
    marked = materialize(rows.withColumns({"reasons": F.concat(reasons, broken), "flags": flags}))
    sound = marked.where(F.size("reasons") == 0)
    first = sound.groupBy("pixel_hash").agg(F.min(F.struct("seq", "id")).alias("first"))
    copies = sound.join(first, "pixel_hash").where(F.col("seq") != F.col("first.seq")).select("seq", F.col("first.id").cast("string").alias("copy_of"))
    accepted = sound.join(copies, "seq", "left_anti")
    near = neardup.first_earlier(accepted.select("seq", "phash"), "seq", "phash", limits["near_duplicate_hamming"])
    near = near.join(accepted.select(F.col("seq").alias("near"), F.col("id").cast("string").alias("near_to")), "near").drop("near")
    out = marked.join(copies, "seq", "left").join(near, "seq", "left")
    add = lambda array, text, column: F.concat(array, F.when(F.col(column).isNotNull(), F.array(F.concat(F.lit(text), F.col(column)))).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({"reasons": add(F.col("reasons"), "exact_duplicate_of:", "copy_of"), "flags": add(F.col("flags"), "near_duplicate_of:", "near_to")}).drop("copy_of", "near_to")
    return out.withColumn("outcome", outcome(F.col("reasons"), F.col("flags"))).withColumn("codes", F.array_sort(F.array_distinct(F.concat("reasons", "flags"))))


def outcomes(screened: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return screened.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def passed(screened: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """(rows that passed with their turn among the classes, violations): repeated ids and classes without any."""
    from .quality_gates import repeated
    from .selection import round_robin

    rows = screened.where("outcome = 'pass'")
    lacking = screened.sparkSession.createDataFrame([(i,) for i in range(classes)], "class_id int").join(rows.select("class_id").distinct(), "class_id", "left_anti")
    bad = repeated(rows, ["id"], "repeated").select("violation", "key").unionByName(lacking.select(F.lit("class_missing").alias("violation"), F.col("class_id").cast("string").alias("key")))
    return round_robin(rows, "class_id", "id"), bad


def undecided(rows: DataFrame, approved: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows without a decision, the first ``limit`` of them."""
    out = rows.where(F.col(approved).isNull())
    return out if limit is None else out.orderBy(order).limit(limit)
