"""Matching predictions to targets and comparing bags of boxes.

Greedy matching is sequential inside one image. Images are dealt to buckets by
hash, and a task matches all images of a bucket side by side in numpy: first the
surest detection of every image (and class), then every second one, and so on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGETS = "image string, cid int, x1 double, y1 double, x2 double, y2 double"
PREDICTIONS = "image string, cid int, conf double, x1 double, y1 double, x2 double, y2 double"
BOX = ["x1", "y1", "x2", "y2"]
#: Rows of both sides that a bucket of images is meant to hold.
BUCKET = 200_000


def _by_bucket(left: DataFrame, right: DataFrame, more: list[str], run, schema: str, rows: int | None = None) -> DataFrame:
    """Apply ``run`` to the two sides of every bucket of images.

    Images are dealt to buckets by hash, one for ``BUCKET`` rows and a few for
    each shuffle partition. Columns get new identities: both sides may stem from
    one frame.
    """
    rows = left.count() + right.count() if rows is None else rows
    buckets = max(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET))

    def new(df: DataFrame, columns: list[str]):
        return df.select(*[F.col(c).alias(c) for c in columns], F.pmod(F.xxhash64("image"), F.lit(buckets)).alias("bucket")).groupBy("bucket")

    return new(left, ["image", "cid", *more, *BOX]).cogroup(new(right, ["image", "cid", *BOX])).applyInPandas(lambda p, t: run(p, t), schema)


def _by_image(left: DataFrame, right: DataFrame, match, schema: str) -> DataFrame:
    """Apply ``match`` to the two sides of every image, bucket by bucket."""
    names = [n.split()[0] for n in schema.split(", ")]

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        parts = [{k: g for k, g in side.groupby("image", sort=False).indices.items()} for side in (p, t)]
        values = [(side["cid"].to_numpy(), side[BOX].to_numpy(float)) for side in (p, t)]
        none = np.empty(0, np.int64)
        rows = []
        for image in dict.fromkeys([*parts[0], *parts[1]]):
            i, j = parts[0].get(image, none), parts[1].get(image, none)
            rows += match(image, values[0][0][i], values[0][1][i], values[1][0][j], values[1][1][j])
        return pd.DataFrame(rows, columns=names)

    return _by_bucket(left, right, [], run, schema)


def places(group: np.ndarray) -> np.ndarray:
    """The place of every row among those of its group, from 0; ``group`` is sorted."""
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    return np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)]))


def _sides(p: pd.DataFrame, t: pd.DataFrame, classes: bool = True) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Both sides with group (an image, and a class of it) in its order: predictions by falling conf, targets as they came, with their index in the image."""
    p, t = p[p["image"].notna()], t[t["image"].notna()].copy()
    code = pd.factorize(pd.concat([p["image"], t["image"]]))[0]
    cid, own = np.unique(np.concatenate([p["cid"].astype("int64"), t["cid"].astype("int64")]), return_inverse=True)
    group = code * len(cid) + own if classes else code
    order = np.argsort(code[len(p) :], kind="stable")
    index = np.empty(len(t), np.int64)
    index[order] = places(code[len(p) :][order])
    p, t = p.assign(group=group[: len(p)]), t.assign(group=group[len(p) :], index=index)
    p = p.iloc[np.lexsort((-p["conf"].to_numpy(float), p["group"].to_numpy()))]
    return p, t.iloc[np.argsort(t["group"].to_numpy(), kind="stable")]


def assign(group: np.ndarray, box: np.ndarray, t_group: np.ndarray, t_box: np.ndarray, limits: np.ndarray, ignored: np.ndarray | None = None, clamp: bool = True, last: bool = True) -> np.ndarray:
    """The target that each detection takes, or -1: (sets of ignored targets, limits, detections).

    Both sides are sorted by group, detections of a group by falling sureness. A
    detection takes the free target of its group with the largest overlap that
    reaches the limit, the last (or first) of equal ones; targets that are
    ignored come only if no other will do. A round serves the detections of one
    place in all groups, so its pairs are at most as many as the targets.
    """
    ignored = np.zeros((1, len(t_group)), bool) if ignored is None else ignored
    out = np.full((len(ignored), len(limits), len(group)), -1)
    start = np.searchsorted(t_group, group)
    n = np.searchsorted(t_group, group, "right") - start
    place = places(group)
    order = np.argsort(place, kind="stable")
    order = order[n[order] > 0]
    free = np.ones((len(ignored), len(limits), len(t_group)), bool)
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else ():
        k = n[rows]
        first = np.cumsum(k) - k
        who = np.repeat(np.arange(len(rows)), k)
        at = np.arange(len(who))
        j = at - first[who] + start[rows][who]
        over = overlaps(box[rows[who]], t_box[j], clamp)
        fits = over >= limits[:, None]
        for a, skipped in enumerate(ignored):
            open_, picked = fits & free[a][:, j], np.full((len(limits), len(rows)), -1)
            for kind in (False, True):
                some = open_ & (skipped[j] == kind)
                if kind:
                    some &= picked[:, who] < 0
                if not some.any():
                    continue
                best = np.maximum.reduceat(np.where(some, over, -np.inf), first, axis=1)
                some &= over == best[:, who]
                spot = np.maximum.reduceat(np.where(some, at, -1), first, axis=1) if last else np.minimum.reduceat(np.where(some, at, len(at)), first, axis=1)
                hit = (spot >= 0) & (spot < len(at))
                picked[hit] = j[spot[hit]]
            out[a][:, rows] = picked
            t, w = np.nonzero(picked >= 0)
            free[a][t, picked[t, w]] = False
    return out


def overlaps(a: np.ndarray, b: np.ndarray, clamp: bool = True) -> np.ndarray:
    """Intersection over union of the boxes of each row."""
    side = (lambda x: np.maximum(x, 0)) if clamp else (lambda x: x)
    w = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0)
    h = np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)
    area = lambda x: side(x[:, 2] - x[:, 0]) * side(x[:, 3] - x[:, 1])
    union = area(a) + area(b) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def greedy(predictions: DataFrame, targets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image, cid, conf, hit, target): class by class, the surest prediction takes its best free target.

    conf and target of a missed target: null and its place; hit: tp, fp or fn.
    Equal overlaps go to the first target; a prediction under the threshold
    leaves its target free.
    """

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, t = _sides(p, t)
        taken = assign(p["group"].to_numpy(), p[BOX].to_numpy(float), t["group"].to_numpy(), t[BOX].to_numpy(float), np.array([threshold]), clamp=False, last=False)[0, 0]
        hit, missed = taken >= 0, np.ones(len(t), bool)
        missed[taken[hit]] = False
        target = pd.array(np.zeros(len(p), np.int32), dtype="Int32")
        target[hit] = t["index"].to_numpy()[taken[hit]].astype(np.int32)
        target[~hit] = pd.NA
        found = pd.DataFrame({"image": p["image"].to_numpy(), "cid": p["cid"].to_numpy(np.int32), "conf": p["conf"].to_numpy(float), "hit": np.where(hit, "tp", "fp"), "target": target})
        rest = t[missed]
        lost = pd.DataFrame({"image": rest["image"].to_numpy(), "cid": rest["cid"].to_numpy(np.int32), "conf": np.full(len(rest), np.nan), "hit": np.full(len(rest), "fn", object), "target": pd.array(rest["index"].to_numpy(np.int32), dtype="Int32")})
        return pd.concat([found, lost])

    return _by_bucket(predictions, targets, ["conf"], run, "image string, cid int, conf double, hit string, target int")


def confusion(predictions: DataFrame, targets: DataFrame, classes: int, threshold: float = 0.5) -> DataFrame:
    """(image, truth, predicted): matched whatever the class; ``classes`` stands for background.

    Equal overlaps go to the last target.
    """

    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, t = _sides(p, t, classes=False)
        taken = assign(p["group"].to_numpy(), p[BOX].to_numpy(float), t["group"].to_numpy(), t[BOX].to_numpy(float), np.array([threshold]))[0, 0]
        hit, missed = taken >= 0, np.ones(len(t), bool)
        missed[taken[hit]] = False
        truth = np.full(len(p), classes)
        truth[hit] = t["cid"].to_numpy()[taken[hit]]
        rest = t[missed]
        return pd.DataFrame({"image": np.concatenate([p["image"], rest["image"]]), "truth": np.concatenate([truth, rest["cid"]]), "predicted": np.concatenate([p["cid"], np.full(len(rest), classes)])})

    return _by_bucket(predictions, targets, ["conf"], run, "image string, truth int, predicted int")


THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))
#: Pixel areas by which boxes are told apart.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def graded(predictions: DataFrame, targets: DataFrame, areas: Mapping[str, tuple[float, float]] = AREAS, most: Sequence[int] = (1, 10, 300), thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(state, image, cid, area, conf, place, marks, n): one row per detection, and the counts that a report needs.

    Class by class and image by image, the ``max(most)`` surest detections are
    matched; place: theirs in that order, from 0. marks: a number for each area,
    with bit i set where threshold i makes the detection a hit, and bit
    len(thresholds) + i where it does not count, as its target or the unmatched
    detection itself lies outside the area's bounds. So ten thresholds are no
    ten rows, which would all be put in one order.

    Rows of the state target give a class's number (n) of targets within an
    area's bounds. Rows of the states limit (place), area (place, area),
    threshold (place, conf) and rows (n: predictions) name what was asked.
    """
    t = len(thresholds)
    if t > 31:
        raise ValueError("at most 31 thresholds")
    names, limits = list(areas), np.minimum(np.array(thresholds, float), 1 - 1e-10)
    bit = 1 << np.arange(t, dtype=np.int64)

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = _sides(p, q)
        place = places(p["group"].to_numpy())
        p, place = p[place < max(most)], place[place < max(most)]
        box, t_box = p[BOX].to_numpy(float), q[BOX].to_numpy(float)
        size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        outside = lambda x: np.array([(size(x) < low) | (size(x) > high) for low, high in areas.values()]).reshape(len(names), -1)
        ignored = outside(t_box)
        taken = assign(p["group"].to_numpy(), box, q["group"].to_numpy(), t_box, limits, ignored)
        out = pd.DataFrame({"image": p["image"].to_numpy(), "cid": p["cid"].to_numpy(np.int32), "conf": p["conf"].to_numpy(float), "place": place.astype(np.int32)})
        for a, (own, lost) in enumerate(zip(taken, outside(box))):
            hit = own >= 0
            besides = hit & (ignored[a][own] if len(q) else False)
            out[f"m{a}"] = bit @ (hit & ~besides) + (bit @ (besides | (~hit & lost)) << t)
        return out

    rows = predictions.count()
    marks = [f"m{a}" for a in range(len(names))]
    found = _by_bucket(predictions, targets, ["conf"], run, "image string, cid int, conf double, place int, " + ", ".join(f"{m} long" for m in marks), rows + targets.count())
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    sums = targets.where("image IS NOT NULL").groupBy("cid").agg(*[F.count_if((area >= float(low)) & (area <= float(high))).alias(f"n{a}") for a, (low, high) in enumerate(areas.values())])
    counts = sums.select("cid", F.inline(F.array(*[F.struct(F.lit(name).alias("area"), F.col(f"n{a}").alias("n")) for a, name in enumerate(names)]))).where("n > 0")
    schema = "state string, image string, cid int, area string, conf double, place int, marks array<long>, n long"
    given = [("limit", None, None, None, None, int(m), None, None) for m in most] + [("area", None, None, name, None, i, None, None) for i, name in enumerate(names)]
    given += [("threshold", None, None, None, float(x), i, None, None) for i, x in enumerate(thresholds)] + [("rows", None, None, None, None, None, None, rows)]
    none = lambda kind: F.lit(None).cast(kind)
    detections = found.select(F.lit("detection").alias("state"), "image", "cid", none("string").alias("area"), "conf", "place", F.array(*marks).alias("marks"), none("long").alias("n"))
    totals = counts.select(F.lit("target").alias("state"), none("string").alias("image"), F.col("cid").cast("int").alias("cid"), "area", none("double").alias("conf"), none("int").alias("place"), none("array<long>").alias("marks"), "n")
    return detections.unionByName(totals).unionByName(predictions.sparkSession.createDataFrame(given, schema))


def same_boxes(actual: DataFrame, expected: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """(image, same): whether two bags of labelled boxes agree, each box using up one of the other bag."""

    def compare(image, cid, box, t_cid, t_box) -> list[tuple]:
        left = list(zip(t_cid.tolist(), t_box.tolist()))
        if len(cid) != len(left):
            return [(image, False)]
        for c, x in zip(cid.tolist(), box.tolist()):
            at = next((k for k, (d, y) in enumerate(left) if c == d and all(abs(u - v) <= tolerance for u, v in zip(x, y))), None)
            if at is None:
                return [(image, False)]
            left.pop(at)
        return [(image, True)]

    return _by_image(actual, expected, compare, "image string, same boolean")
