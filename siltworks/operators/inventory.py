"""A frozen export: its typed inventory, its integrity, its counts, and samples of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.identity import canonical_hash
from ..session import materialize
from .quality_gates import crossing, repeated
from .selection import running

SPLITS = ("train", "val", "test")
TARGET = "struct<cid: int, x1: double, y1: double, x2: double, y2: double>"


def label_rows(labels: DataFrame) -> DataFrame:
    """(split, stem, fields): the lines of label files, blank ones aside."""
    lines = labels.select("split", "stem", F.explode(F.split("text", "\r?\n")).alias("line")).where("trim(line) <> ''")
    return lines.select("split", "stem", F.split(F.trim("line"), r"\s+").alias("fields"))


def inventory(manifest: DataFrame, images: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """Manifest rows with path, width, height and targets: the label's boxes as corners, clipped to the image.

    images: (split, stem, path, width, height); labels: (split, stem, text).
    Rows meet on (split, stem). A line that is no box of a known class within
    the image is an error when it is read.
    """
    numbers = F.transform("fields", lambda x: x.try_cast("double"))
    rows = label_rows(labels).select("split", "stem", numbers.alias("v"))
    v = [F.get("v", F.lit(i)) for i in range(5)]
    x1, y1, x2, y2 = geometry.corners(*v[1:])
    slack = 1e-6
    wrong = (F.size("v") != 5) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (v[0] != F.floor(v[0])) | (v[0] < 0) | (v[0] >= classes)
    wrong = wrong | (v[3] <= 0) | (v[4] <= 0) | (F.least(x1, y1) < -slack) | (F.greatest(x2, y2) > 1 + slack)
    cid = F.when(wrong, F.raise_error(F.concat(F.lit("invalid geometry: "), "stem")).cast("int")).otherwise(v[0].cast("int"))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    target = F.struct(cid.alias("cid"), clip(x1).alias("x1"), clip(y1).alias("y1"), clip(x2).alias("x2"), clip(y2).alias("y2"))
    boxes = rows.groupBy("split", "stem").agg(F.array_sort(F.collect_list(target)).alias("targets"))
    found = manifest.join(images, ["split", "stem"]).join(boxes, ["split", "stem"], "left")
    return found.withColumn("targets", F.coalesce("targets", F.array().cast(f"array<{TARGET}>")))


def violations(manifest: DataFrame, images: DataFrame, labels: DataFrame, names: Sequence[str], core: Sequence[str], quality: str | None, strict: bool, splits: Sequence[str] = SPLITS) -> DataFrame:
    """(violation, key, rows): what keeps an export from being used; empty if nothing does.

    manifest: split, stem, group, status and the recorded image_sha256 and
    label_sha256; images: split, stem, sha256 of the files; labels: split, stem,
    text, sha256. names: the export's classes, core: those expected.
    """
    spark = manifest.sparkSession
    whole = [("class_order", list(names) != list(core)), ("quality_missing", quality not in ("reviewed", "provisional")), ("not_reviewed", strict and quality == "provisional"), ("empty", not manifest.limit(1).count())]
    found = spark.createDataFrame([(n, "", 1) for n, bad in whole if bad], "violation string, key string, rows long")

    def some(rows: DataFrame, name: str, key: Column) -> DataFrame:
        return rows.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("violation"), "key", "rows")

    key = F.concat_ws("/", "split", "stem")
    at = ["split", "stem"]
    files = images.groupBy(*at).agg(F.count(F.lit(1)).alias("files"), F.min("sha256").alias("image_now"))
    texts = labels.groupBy(*at).agg(F.min("sha256").alias("label_now"))
    rows = manifest.join(files, at, "left").join(texts, at, "left")
    known = rows.where(F.col("split").isin(list(splits)))
    parts = label_rows(labels.join(manifest.select(*at).distinct(), at, "left_semi")).withColumn("cid", F.get("fields", F.lit(0)).try_cast("int"))
    right = (F.size("fields") == 5) & F.col("cid").isNotNull() & (F.col("cid") >= 0) & (F.col("cid") < len(core))
    # every split times every class, a few dozen rows
    scaffold = spark.createDataFrame([(s, i) for s in splits for i in range(len(core))], "split string, cid int")
    checks = [
        some(rows.where(~F.col("split").isin(list(splits)) | F.col("split").isNull()), "invalid_split", key),
        repeated(manifest, ["stem"], "repeated_image"),
        some(known.where(F.coalesce("files", F.lit(0)) != 1), "image_missing_or_ambiguous", key),
        some(known.where("label_now IS NULL"), "label_missing", key),
        some(known.where((F.col("files") == 1) & ~F.col("image_now").eqNullSafe(F.col("image_sha256"))), "image_changed", key),
        some(known.where(F.col("label_now").isNotNull() & ~F.col("label_now").eqNullSafe(F.col("label_sha256"))), "label_changed", key),
        some(parts.where(F.size("fields") != 5), "not_a_box", key),
        some(parts.where((F.size("fields") == 5) & ~F.coalesce(right, F.lit(False))), "invalid_class", key),
        crossing(manifest, "group", "split"),
        some(files.join(manifest.select(*at).distinct(), at, "left_anti").where(F.col("split").isin(list(splits))), "outside_manifest", key),
        some(scaffold.join(parts.where(right).select("split", "cid").distinct(), ["split", "cid"], "left_anti"), "class_missing", F.concat_ws("/", "split", F.col("cid").cast("string"))),
    ]
    if strict:
        checks.append(some(manifest.where(~F.col("status").eqNullSafe(F.lit("approved"))), "not_approved", key))
    for check in checks:
        found = found.unionByName(check)
    return found


def export_counts(rows: DataFrame, boxes: DataFrame, classes: Sequence[str], splits: Sequence[str] = SPLITS) -> DataFrame:
    """(split, kind, name, n): images by split and source, boxes by split and class, 0 where there are none.

    rows: split, source per image; boxes: split, name per box.
    """
    spark = rows.sparkSession
    images = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit("images").alias("kind"), F.lit("").alias("name"), "n")
    sources = rows.groupBy("split", F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("split", F.lit("source").alias("kind"), "name", "n")
    scaffold = spark.createDataFrame([(s, c) for s in splits for c in classes], "split string, name string")
    per = scaffold.join(boxes.groupBy("split", "name").agg(F.count(F.lit(1)).alias("n")), ["split", "name"], "left").select("split", F.lit("class").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return images.unionByName(sources).unionByName(per)


def uncovered(counts: DataFrame) -> list[str]:
    """``split:class`` of the classes that a split lacks; an export with any of them is blocked."""
    return sorted(f"{r['split']}:{r['name']}" for r in counts.where("kind = 'class' AND n = 0").collect())


def scan_summary(records: DataFrame) -> DataFrame:
    """(source, images, empty, groups, units, duplicates, statuses): a row per source, statuses as a map of counts.

    records: source, status, group, unit, boxes, duplicates.
    """
    states = records.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    sums = records.groupBy("source").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("boxes") == 0).alias("empty"), F.count_distinct("group").alias("groups"), F.count_distinct("unit").alias("units"), F.sum("duplicates").alias("duplicates"))
    return sums.join(states, "source")


def cross_source_groups(records: DataFrame) -> DataFrame:
    """(groups, crossing): groups, and those of several sources."""
    per = records.groupBy("group").agg(F.count_distinct("source").alias("sources"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("sources") > 1).alias("crossing"))


def planning(records: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(level, source, cls, total, fraction, expected, verdict): per source and pooled, after removal of duplicates on each level.

    records: source, cls, key; records of one key are copies.
    """
    single = records.groupBy("source", "cls").agg(F.count_distinct("key").alias("total")).select(F.lit("single").alias("level"), "source", "cls", "total")
    pooled = records.groupBy("cls").agg(F.count_distinct("key").alias("total")).select(F.lit("pooled").alias("level"), F.lit(None).cast("string").alias("source"), "cls", "total")
    each = single.unionByName(pooled).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    size = F.col("total") * F.lit(0.7) * F.col("fraction")
    return each.withColumn("expected", F.bround(size).cast("long")).withColumn("verdict", F.when(size < 5, "FAIL").when(size < 20, "WARN").otherwise("OK"))


def representatives(records: DataFrame, component: str, path: str) -> DataFrame:
    """(component, path): the smallest path of each component."""
    return records.groupBy(component).agg(F.min(path).alias(path))


def subset_identity(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, identity, rows): SHA-256 of the JSON list of a subset's rows, ordered by their first column."""
    one = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    return one.select(by, canonical_hash(F.to_json("r", {"ignoreNullFields": "false"})).alias("identity"), F.size("r").cast("long").alias("rows"))


def display_ids(rows: DataFrame, by: str, order: str, pattern: str) -> DataFrame:
    """``rows`` with display: an id of the key and the row's place in its order."""
    return running(rows, [by], [order], "__place").withColumn("display", F.format_string(pattern, F.col(by), "__place")).drop("__place")


def resize_risk(rows: DataFrame, kind: str, width: Column, height: Column) -> DataFrame:
    """(kind, n, under_2, under_4): boxes whose short side is under two and four pixels."""
    side = F.least(width, height)
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(side < 2).alias("under_2"), F.count_if(side < 4).alias("under_4"))


def by_side(rows: DataFrame, width: Column, height: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): rows by their short side, with the reason why one is skipped."""
    reason = F.when(F.least(width, height) < least, F.lit(f"smaller than {least}"))
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL"), marked.where("reason IS NOT NULL")


def class_count(lines: DataFrame, fields: str) -> DataFrame:
    """(classes): one more than the largest class id of any label line."""
    return lines.agg((F.max(F.get(fields, F.lit(0)).try_cast("int")) + 1).alias("classes"))


def two_of_each(rows: DataFrame, key: str, cls: str, usable: Column, each: int = 2) -> DataFrame:
    """The keys, in order, that bring a class a usable box while it has fewer than ``each``.

    A key counts if before it some class of its usable boxes had fewer than
    ``each`` boxes in the keys that count: every key before that one brings its
    first boxes too, so these are the keys with a box among the first ``each``
    keys' boxes of some class, and running sums tell.
    """
    per = rows.where(usable).groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(cls).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # only the first ``each`` keys of a class can matter to it
    first = per.withColumn("i", F.row_number().over(Window.partitionBy(cls).orderBy(key))).where(F.col("i") <= each)
    needed = first.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < each)
    return needed.select(key).distinct()


def most_without_repeats(rows: DataFrame, cls: str, group: str, score: str) -> list[tuple]:
    """(class, group) of the best score of each class, classes in order, no group twice.

    As many candidates of a class as there are classes are looked at: more can't be needed.
    """
    n = rows.select(cls).distinct().count()
    w = Window.partitionBy(cls).orderBy(F.desc(score), group)
    best = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n).orderBy(cls, "i").collect()
    taken: dict = {}
    for r in best:
        if r[cls] not in taken and r[group] not in taken.values():
            taken[r[cls]] = r[group]
    return list(taken.items())


def smoke_sample(images: DataFrame, boxes: DataFrame, key: str, cls: str, usable: Column, limit: int, expected: Sequence, each: int = 2) -> DataFrame:
    """``limit`` rows of ``images`` whose boxes show every class of ``expected`` at least ``each`` times, the others in order of ``key``.

    boxes: key, cls and what ``usable`` asks for. A class with fewer usable
    boxes, or one that cannot be shown within the limit, is an error.
    """
    wanted = boxes.where(F.col(cls).isin(list(expected)))
    found = {r[0]: r[1] for r in wanted.where(usable).groupBy(cls).count().collect()}  # a row per expected class
    lacking = [c for c in expected if found.get(c, 0) < each]
    needed = materialize(two_of_each(wanted, key, cls, usable, each))
    most = needed.count()
    if lacking or most > limit:
        raise ValueError(f"{each} usable boxes of every class need {most} images of {limit}" + (f"; too few of {lacking}" if lacking else ""))
    chosen = images.join(needed, key, "left_semi")
    return chosen.unionByName(images.join(needed, key, "left_anti").orderBy(key).limit(limit - most))
