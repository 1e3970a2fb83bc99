"""What an audit says of a source's images: their pairs with labels, sizes, kinds, shapes and a sample to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inventory import SPLITS
from .selection import running
from .statistics import percentiles

RANKS = (0.0, 0.25, 0.5, 0.75, 1.0)


def split_inventory(images: DataFrame, labels: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """(split, images, labels, empty_labels, orphan_images, orphan_labels, corrupt_images, missing), a row for each of ``splits``.

    images: split, stem, corrupt; labels: split, stem, text. They meet on
    (split, stem), each side as one row of counts. A split without any image is
    missing and its counts are null, whatever labels lie there.
    """
    at = ["split", "stem"]
    a = images.groupBy(*at).agg(F.count(F.lit(1)).alias("i"), F.count_if(F.coalesce("corrupt", F.lit(False))).alias("bad"))
    b = labels.groupBy(*at).agg(F.count(F.lit(1)).alias("l"), F.count_if(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("blank"))
    both = a.join(b, at, "full_outer")
    sums = both.groupBy("split").agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("images"), F.coalesce(F.sum("l"), F.lit(0)).alias("labels"), F.coalesce(F.sum("blank"), F.lit(0)).alias("empty_labels"),
        F.coalesce(F.sum(F.when(F.col("l").isNull(), F.col("i"))), F.lit(0)).alias("orphan_images"), F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col("l"))), F.lit(0)).alias("orphan_labels"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("corrupt_images"),
    )
    wanted = images.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    found = wanted.join(sums, "split", "left").withColumn("missing", F.coalesce(F.col("images") == 0, F.lit(True)))
    counts = [c for c in sums.columns if c != "split"]
    return found.select("split", *[F.when(~F.col("missing"), F.col(c)).alias(c) for c in counts], "missing")


def most_common(rows: DataFrame, by: Sequence[str], value: str, order: str, n: int = 5) -> DataFrame:
    """(by..., value, n): each key's ``n`` commonest values; of equally common ones those that come first in ``order``.

    Values are counted before they are ranked, and every task passes on its
    first ``n`` of a key only, so a key with many values is no one's burden.
    """
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "__first", value)
    return counted.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= n).drop("__i", "__first")


def aspect_quantiles(images: DataFrame, by: Sequence[str], width: str, height: str, corrupt: Column | None = None) -> DataFrame:
    """(by..., p0, p25, p50, p75, p100) of width / height of readable images; 1 throughout for keys without any."""
    fine = F.col(height) > 0
    if corrupt is not None:
        fine = fine & ~F.coalesce(corrupt, F.lit(False))
    found = percentiles(images.where(fine).withColumn("__aspect", F.col(width) / F.col(height)), by, "__aspect", RANKS)
    names = [f"p{round(100 * r)}" for r in RANKS]
    keys = images.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return keys.join(found, same, "left").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(by)], *[F.coalesce(n, F.lit(1.0)).alias(n) for n in names])


def grayscale_share(images: DataFrame, by: Sequence[str], grayscale: Column, corrupt: Column) -> DataFrame:
    """(by..., readable, share): how many images can be read, and the share of those without colours (0 for none)."""
    bad = F.coalesce(corrupt, F.lit(False))
    sums = images.groupBy(*by).agg(F.count_if(~bad).alias("readable"), F.count_if(~bad & F.coalesce(grayscale, F.lit(False))).alias("__gray"))
    return sums.withColumn("share", F.col("__gray") / F.greatest("readable", F.lit(1))).drop("__gray")


def class_buckets(images: DataFrame, boxes: DataFrame, by: str, key: str, cls: str) -> DataFrame:
    """(by, bucket, images): how many images show 0, 1, 2 or 3+ classes; images: by, key; boxes: key, cls."""
    shown = boxes.groupBy(key).agg(F.count_distinct(cls).alias("__k"))
    k = F.coalesce("__k", F.lit(0))
    bucket = F.when(k >= 3, "3+").otherwise(k.cast("string"))
    return images.select(by, key).join(shown, key, "left").groupBy(by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("images"))


def polygon_sample(shapes: DataFrame, key: str, family: str, classes: Sequence[str]) -> DataFrame:
    """(key, reasons): images with polygons to look at, a few of every class and one of every family of file names.

    shapes: key, family, cls, kind, points. Images of a class (a polygon of it)
    are ordered by the points of their longest polygon, then by key; those at
    places 0, n/4, n/2, 3n/4 (rounded down) and the last are taken. Of a family
    the image with the longest shape of any kind is taken, ties to the smallest
    key. A reason is ``class:<name>`` or ``family:<name>``.
    """
    polygon = F.col("kind") == "polygon"
    per = shapes.groupBy(key, family).agg(F.max("points").alias("__any"), F.max(F.when(polygon, F.col("points"))).alias("__points")).where("__points IS NOT NULL")
    known = shapes.where(polygon & F.col("cls").isin(list(classes))).select(key, "cls").distinct()
    placed = running(known.join(per.select(key, "__points"), key), ["cls"], ["__points", key], "__place")
    sizes = known.groupBy(F.col("cls").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    n, at = F.col("__n"), F.col("__place") - 1
    spots = at.isin(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - 1)
    first = placed.join(F.broadcast(sizes), F.col("cls") == F.col("__c")).where(spots).select(key, F.concat(F.lit("class:"), "cls").alias("reason"))  # sizes: a row per listed class
    longest = per.groupBy(family).agg(F.min(F.struct((-F.col("__any")).alias("p"), F.col(key).alias("k"))).alias("__best"))
    second = longest.select(F.col("__best.k").alias(key), F.concat(F.lit("family:"), family).alias("reason"))
    return first.unionByName(second).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
