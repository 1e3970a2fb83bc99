"""Rotated, mirrored and noisy copies of images with their boxes and provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .selection import identity

#: What lies beyond a turned image's corners.
BORDER = 114
SCHEMA = "stem string, source_stem string, repetition int, height int, width int, channels int, data binary, data_sha256 string, label string, label_sha256 string, targets array<struct<cid: int, x1: double, y1: double, x2: double, y2: double>>, provenance string"


def rotation(width: int, height: int, degrees: float) -> np.ndarray:
    """The 2 x 3 matrix that turns an image about its centre, counter-clockwise as it is seen."""
    a, b = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cx, cy = width / 2, height / 2
    return np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy]])


def turned(image: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The image under a matrix, by bilinear weights of the four pixels around each point's origin."""
    h, w = image.shape[:2]
    back = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    y, x = np.mgrid[0:h, 0:w]
    u, v = (back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in (0, 1))
    framed = np.full((h + 2, w + 2, image.shape[2]), BORDER, float)
    framed[1:-1, 1:-1] = image
    u, v = np.clip(u, -1, w) + 1, np.clip(v, -1, h) + 1
    i, j = np.minimum(u.astype(int), w), np.minimum(v.astype(int), h)
    p, q = (u - i)[..., None], (v - j)[..., None]
    out = (framed[j, i] * (1 - p) + framed[j, i + 1] * p) * (1 - q) + (framed[j + 1, i] * (1 - p) + framed[j + 1, i + 1] * p) * q
    return np.rint(out).astype(np.uint8)


def turned_boxes(targets: list, matrix: np.ndarray, width: int, height: int, flip: bool) -> list[tuple]:
    """The clipped boxes around the turned corners, mirrored on demand; those that leave the image are left out."""
    out = []
    for cid, x1, y1, x2, y2 in targets:
        corners = np.array([[x * width, y * height, 1] for x in (x1, x2) for y in (y1, y2)]) @ matrix.T
        low, high = corners.min(axis=0) / (width, height), corners.max(axis=0) / (width, height)
        left, top, right, bottom = np.clip([*low, *high], 0, 1).tolist()
        if flip:
            left, right = 1 - right, 1 - left
        if right > left and bottom > top:
            out.append((int(cid), left, top, right, bottom))
    return out


def label_of(targets: list[tuple]) -> str:
    return "".join(f"{c} {(x1 + x2) / 2:.12g} {(y1 + y2) / 2:.12g} {x2 - x1:.12g} {y2 - y1:.12g}\n" for c, x1, y1, x2, y2 in targets)


def copies(images: DataFrame, settings: Mapping, seed: int) -> DataFrame:
    """``copies_per_real`` altered copies of every image, with labels, hashes and where they come from.

    images: stem, height, width, channels, data, targets. settings: degrees,
    flip_probability, noise_std (in shares of the grey range) and
    copies_per_real. An image's draws depend on seed, stem and repetition
    alone, so neither order nor partitioning matters.
    """
    kept = {k: settings[k] for k in ("degrees", "flip_probability", "noise_std", "copies_per_real")}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                image = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                targets = [tuple(t[c] for c in ("cid", "x1", "y1", "x2", "y2")) for t in row.targets]
                out = []
                for k in range(kept["copies_per_real"]):
                    rng = np.random.default_rng(int(identity([row.stem, seed, k])[:16], 16))
                    angle, flip = float(rng.uniform(-kept["degrees"], kept["degrees"])), bool(rng.random() < kept["flip_probability"])
                    matrix = rotation(row.width, row.height, angle)
                    made = turned(image, matrix)
                    made = (made[:, ::-1] if flip else made) + rng.normal(0, kept["noise_std"] * 255, made.shape)
                    data = np.clip(made, 0, 255).astype(np.uint8).tobytes()
                    boxes = turned_boxes(targets, matrix, row.width, row.height, flip)
                    label = label_of(boxes)
                    told = json.dumps({"method": "classical", "source_stem": row.stem, "angle": angle, "flip": flip, "seed": seed, "settings": kept}, sort_keys=True)
                    stem = "classical_" + identity([row.stem, seed, k, kept])[:24]
                    held = [dict(zip(("cid", "x1", "y1", "x2", "y2"), b)) for b in boxes]
                    out.append((stem, row.stem, k, row.height, row.width, row.channels, data, hashlib.sha256(data).hexdigest(), label, hashlib.sha256(label.encode()).hexdigest(), held, told))
                # an image's copies at a time: a part of images is never held altered as a whole
                yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in SCHEMA.split("targets")[0].rstrip(", ").split(",")] + ["targets", "provenance"])

    return images.select("stem", "height", "width", "channels", "data", "targets").mapInPandas(run, SCHEMA)
