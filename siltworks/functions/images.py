"""Measures of decoded images (height, width, channels, bytes in row order) as Pandas UDFs over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red image; one channel is taken as it is."""
    return image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299]) if image.shape[2] >= 3 else image[..., 0].astype(float)


def sharpness(g: np.ndarray, border: str = "wrap") -> float:
    """Variance of the four-neighbour Laplacian; border: wrap or reflect (without the edge itself)."""
    p = np.pad(g, 1, mode=border) if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def noise(g: np.ndarray) -> float:
    """Median absolute difference from the mean of a pixel and its four neighbours."""
    p = np.pad(g, 1, mode="wrap")
    return float(np.median(np.abs(g - (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] + g) / 5)))


def contrast(g: np.ndarray) -> float:
    return float(g.std())


def luma(image: np.ndarray) -> np.ndarray:
    """Whole grey levels of a blue-green-red image, in 16-bit fixed point; one channel is taken as it is."""
    if image.shape[2] < 3:
        return image[..., 0]
    b, g, r = (image[..., c].astype(np.int64) for c in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000 >> 16).astype(np.uint8)


def lanczos(n: int, size: int) -> np.ndarray:
    """(size, n) whole weights, of 22 bits, by which a row of n pixels becomes one of ``size``."""
    scale = n / size
    stretch = max(scale, 1.0)
    reach = 3 * stretch
    out = np.zeros((size, n), np.int64)
    for i in range(size):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - reach + 0.5)), min(n, int(centre + reach + 0.5))
        x = (np.arange(low, high) - centre + 0.5) / stretch
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum() * (1 << 22)
        out[i, low:high] = np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)
    return out


def resized(g: np.ndarray, size: int) -> np.ndarray:
    """Grey levels over a size x size grid by Lanczos' window in whole numbers: rows first, rounded, then columns."""
    half = 1 << 21
    wide = np.clip(g.astype(np.int64) @ lanczos(g.shape[1], size).T + half >> 22, 0, 255) if g.shape[1] != size else g.astype(np.int64)
    return np.clip(lanczos(g.shape[0], size) @ wide + half >> 22, 0, 255) if g.shape[0] != size else wide


def perceptual_hash(g: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest cosine terms of a 32 x 32 image, above their median or not; signed."""
    n = 32
    k = np.arange(n)
    basis = 2 * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resized(np.clip(np.rint(g), 0, 255), n) @ basis.T)[:8, :8]
    bits = (low > np.median(low)).reshape(-1)
    return int(np.packbits(bits).view(">i8")[0])


def orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG file's bytes; 1 without one, or if it can't be read."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            if not order:
                return 1
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    return number(entry + 8, 2) or 1
            return 1
        if kind == 0xDA:
            break
        at += 2 + size
    return 1


def colour_features(image: np.ndarray) -> list[float]:
    """16 bins, mean and deviation of each of three channels: 54 numbers."""
    out: list[float] = []
    for c in range(3):
        v = image[..., min(c, image.shape[2] - 1)].astype(float)
        bins = np.histogram(v, bins=16, range=(0, 256))[0]
        out += [*(bins / max(1, v.size)), v.mean() / 255, v.std() / 255]
    return [float(x) for x in out]


def haar(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four half-size bands of an image with even sides."""
    a, b, c, d = x[::2, ::2], x[::2, 1::2], x[1::2, ::2], x[1::2, 1::2]
    return (a + b + c + d) / 2, (a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2


def inverse_haar(ll: np.ndarray, lh: np.ndarray, hl: np.ndarray, hh: np.ndarray) -> np.ndarray:
    out = np.empty((2 * ll.shape[0], 2 * ll.shape[1]), ll.dtype)
    out[::2, ::2], out[::2, 1::2] = (ll + lh + hl + hh) / 2, (ll - lh + hl - hh) / 2
    out[1::2, ::2], out[1::2, 1::2] = (ll + lh - hl - hh) / 2, (ll - lh - hl + hh) / 2
    return out


def crop(image: np.ndarray, left: int, top: int, right: int, bottom: int, turn: bool = False) -> np.ndarray:
    """A window that may reach over the edges, which mirror the image; turned by a quarter on demand."""
    pads = [(max(0, -top), max(0, bottom - image.shape[0])), (max(0, -left), max(0, right - image.shape[1])), (0, 0)]
    out = np.pad(image, pads, mode="reflect")[top + pads[0][0] : bottom + pads[0][0], left + pads[1][0] : right + pads[1][0]]
    return np.rot90(out) if turn else out


def _udf(kind, measure):
    @F.pandas_udf(kind)
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        """Null for images that could not be decoded (height -1)."""
        return pd.Series([measure(pixels(h, w, c, d)) if h > 0 else None for h, w, c, d in zip(height, width, channels, data)])

    return run


sharpness_of = _udf(DoubleType(), lambda x: sharpness(gray(x)))
edge_sharpness_of = _udf(DoubleType(), lambda x: sharpness(gray(x), "reflect"))
noise_of = _udf(DoubleType(), lambda x: noise(gray(x)))
contrast_of = _udf(DoubleType(), lambda x: contrast(gray(x)))
hash_of = _udf(LongType(), lambda x: perceptual_hash(luma(x)))
colours_of = _udf(ArrayType(DoubleType()), colour_features)
grayscale_of = _udf(BooleanType(), lambda x: bool((x == x[..., :1]).all()))


@F.pandas_udf(IntegerType())
def orientation_of(content: pd.Series) -> pd.Series:
    """The EXIF orientation of files' bytes."""
    return pd.Series([orientation(bytes(x)) if x is not None else None for x in content], dtype="Int32")


def pixel_hash(height, width, data):
    """SHA-256 of size and pixels."""
    return F.sha2(F.concat(F.concat_ws("x", height, width).cast("binary"), data), 256)


def measured(images):
    """The rows of Spark's image source with all measures."""
    i = [F.col(f"image.{c}") for c in ("height", "width", "nChannels", "data")]
    return images.select(
        F.col("image.origin").alias("path"), *[c.alias(n) for c, n in zip(i[:3], ("height", "width", "channels"))], (i[0] < 0).alias("corrupt"),
        sharpness_of(*i).alias("sharpness"), edge_sharpness_of(*i).alias("edge_sharpness"), noise_of(*i).alias("noise"), contrast_of(*i).alias("contrast"), hash_of(*i).alias("phash"), grayscale_of(*i).alias("grayscale"), pixel_hash(i[0], i[1], i[3]).alias("pixels"),
    )
