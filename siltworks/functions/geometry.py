"""Box and polygon expressions over DataFrame columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]  # x1, y1, x2, y2


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Centre box to corner box."""
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    """Corner box to centre box."""
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def normalise(box: Box, width: Column, height: Column) -> tuple[Column, ...]:
    """Pixel corners to shares of the image, clipped to [0, 1]."""
    scaled = (box[0] / width, box[1] / height, box[2] / width, box[3] / height)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in scaled)


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share; extents never below 0."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a: Box, b: Box, clamp: bool = True) -> Column:
    """Intersection over union, 0 where the union is 0. clamp: whether negative extents count as 0 in areas."""
    side = (lambda x: F.greatest(F.lit(0.0), x)) if clamp else (lambda x: x)
    area = lambda x: side(x[2] - x[0]) * side(x[3] - x[1])
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def disjoint(a: Box, b: Box) -> Column:
    return overlap(a, b) <= 0


def polygon_bounds(xy: Column) -> tuple[Column, ...]:
    """Corner box of a flat array x1, y1, x2, y2, ..."""
    part = lambda k: F.filter(xy, lambda _, i: i % 2 == k)
    return F.array_min(part(0)), F.array_min(part(1)), F.array_max(part(0)), F.array_max(part(1))


def polygon_area(xy: Column) -> Column:
    """Area inside a polygon given as a flat array, by the shoelace sum."""
    n = (F.size(xy) / 2).cast("int")
    at = lambda i, k: F.element_at(xy, (2 * (i % n) + k + 1).cast("int"))
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def pixel_box(box: Box, width: Column, height: Column) -> tuple[Column, ...]:
    """Shares to whole pixels, rounded outwards and clipped to the image."""
    zero = F.lit(0).cast("long")
    return (
        F.greatest(zero, F.floor(box[0] * width)), F.greatest(zero, F.floor(box[1] * height)),
        F.least(width.cast("long"), F.ceil(box[2] * width)), F.least(height.cast("long"), F.ceil(box[3] * height)),
    )


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def margin_pixels(side: Column, share: Column) -> Column:
    return half_up(side * share)


def turned(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    """A box of unit coordinates after a clockwise quarter turn: (0, 0, .25, 1) becomes (0, 0, 1, .25)."""
    return 1 - y2, x1, 1 - y1, x2


def flipped(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    """Mirrored left to right."""
    return 1 - x2, y1, 1 - x1, y2


def rotated(box: Box, degrees: Column, cx: float = 0.5, cy: float = 0.5) -> tuple[Column, ...]:
    """The clipped bounding box of a box's corners turned about (cx, cy)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    xs, ys = [], []
    for x in (box[0], box[2]):
        for y in (box[1], box[3]):
            xs.append(cx + (x - cx) * c + (y - cy) * s)
            ys.append(cy - (x - cx) * s + (y - cy) * c)
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return clip(F.least(*xs)), clip(F.least(*ys)), clip(F.greatest(*xs)), clip(F.greatest(*ys))


def letterbox(width: Column, height: Column, size: int) -> tuple[Column, ...]:
    """(ratio, scaled width, scaled height) that fit a square of ``size``; halves go to even."""
    ratio = F.least(F.lit(size) / width, F.lit(size) / height)
    return ratio, F.bround(width * ratio).cast("long"), F.bround(height * ratio).cast("long")


def crop_window(box: Box, share: Column) -> tuple[Column, ...]:
    """(left, top, right, bottom) of a pixel box with a margin that is a share of each side."""
    mx, my = margin_pixels(box[2] - box[0], share), margin_pixels(box[3] - box[1], share)
    return box[0] - mx, box[1] - my, box[2] + mx, box[3] + my


def label_problem(fields: Column, classes: int) -> Column:
    """Why a label line (array of its fields) is not valid, or null; the first reason of a fixed order.

    A line is a class and either a centre box (4 numbers) or a polygon (6 or
    more, an even count), all within [0, 1].
    """
    # a lambda's variable is worked out once; written in, the numbers would be read again wherever they are used
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    slack = 1e-6

    def problem(numbers: Column, xy: Column) -> Column:
        cid, n = numbers[0], F.size(xy)
        x1, y1, x2, y2 = corners(F.get(xy, F.lit(0)), F.get(xy, F.lit(1)), F.get(xy, F.lit(2)), F.get(xy, F.lit(3)))
        return (
            F.when((F.size(numbers) < 1) | F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "nonfinite/empty")
            .when((cid != F.floor(cid)) | (cid < 0) | (cid >= classes), "class")
            .when(F.exists(xy, lambda x: (x < 0) | (x > 1)), "range")
            .when((n == 4) & ((F.get(xy, F.lit(2)) <= 0) | (F.get(xy, F.lit(3)) <= 0)), "area")
            .when((n == 4) & ((x1 < -slack) | (y1 < -slack) | (x2 > 1 + slack) | (y2 > 1 + slack)), "box outside image")
            .when(n == 4, F.lit(None).cast("string"))
            .when((n < 6) | (n % 2 == 1), "arity")
            .when(F.when(n >= 6, polygon_area(xy)).otherwise(F.lit(1.0)) <= 1e-12, "polygon area")
        )

    rest = lambda v: F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    return once(F.transform(fields, lambda x: x.try_cast("double")), lambda v: once(rest(v), lambda xy: problem(v, xy)))
