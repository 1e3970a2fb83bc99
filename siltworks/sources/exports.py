"""Frozen exports, plans and status tables in the store: written once, read back, checked, replaced by version."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory, study
from ..session import materialize
from .annotations import class_names, label_lines
from .sinks import label_text


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark writes; an existing one is an error."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} files at {path}")
    return rows[0][0]


def classes_of(spark: SparkSession, folder: str, fallback: Sequence[str] = ()) -> list[str]:
    """The class names of a folder's data.yaml: a list, or a map in the order of its keys; without the file the fallback."""
    import yaml

    p, fs = _path(spark, f"{folder}/data.yaml")
    if not fs.exists(p):
        return list(fallback)
    return class_names((yaml.safe_load(read_text(spark, f"{folder}/data.yaml").lstrip("﻿")) or {}).get("names"), fallback)


#: The README files of an export, the first that is there counts.
READMES = ("README.roboflow.txt", "README.dataset.txt")


def readme_of(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """(name, text) of a folder's README, or null; see ``annotations.readme_facts``."""
    p, fs = _path(spark, folder)
    there = {f.getPath().getName() for f in fs.listStatus(p) if f.isFile()}
    return next(((name, read_text(spark, f"{folder}/{name}")) for name in READMES if name in there), None)


def export_dataset(rows: DataFrame, boxes: DataFrame, path: str, names: Sequence[str], quality: str) -> None:
    """Write a dataset export: images and labels by split, the split manifest, counts and data.yaml.

    rows: split, stem, suffix, source, group, status, content, image_sha256;
    boxes: split, stem, line, cid, cx, cy, w, h. An image whose bytes no longer
    have their hash is an error, as is a split that lacks a class.
    """
    import yaml

    spark = rows.sparkSession
    named = boxes.select("split", F.get(F.array(*[F.lit(n) for n in names]), F.col("cid")).alias("name"))
    counts = materialize(inventory.export_counts(rows, named, names))
    lacking = inventory.uncovered(counts)
    if lacking:
        raise ValueError(f"export blocked, classes without boxes: {', '.join(lacking)}")
    now = F.sha2("content", 256)
    same = F.when(now == F.col("image_sha256"), now).otherwise(F.raise_error(F.concat(F.lit("input changed during export: "), "stem")))
    rows.select("split", "stem", "suffix", "content", same.alias("sha256")).write.mode("errorifexists").partitionBy("split").parquet(f"{path}/images")
    texts = rows.select("split", "stem").join(label_text(boxes), ["split", "stem"], "left").select("split", "stem", F.coalesce("text", F.lit("")).alias("text"))
    texts.withColumn("sha256", F.sha2("text", 256)).write.mode("errorifexists").partitionBy("split").json(f"{path}/labels")
    labels = spark.read.schema("stem string, text string, sha256 string, split string").json(f"{path}/labels")
    manifest = rows.drop("content", "suffix").join(labels.select("split", "stem", F.col("sha256").alias("label_sha256")), ["split", "stem"])
    manifest.write.mode("errorifexists").json(f"{path}/split_manifest")
    held: dict = {}
    for r in counts.collect():  # splits times classes and sources
        held.setdefault(r["kind"], {}).setdefault(r["split"], {})[r["name"]] = r["n"]
    write_text(spark, f"{path}/counts.json", json.dumps({"quality": quality, **held}, sort_keys=True))
    write_text(spark, f"{path}/data.yaml", yaml.safe_dump({"train": "train/images", "val": "val/images", "test": "test/images", "names": list(names)}, sort_keys=False))


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str], dict]:
    """(manifest, images, labels, names, counts) of an export; hashes are those of what lies there now."""
    images = spark.read.parquet(f"{path}/images").select("split", "stem", "suffix", "content", F.sha2("content", 256).alias("sha256"))
    labels = spark.read.schema("stem string, text string, split string").json(f"{path}/labels").withColumn("sha256", F.sha2("text", 256))
    return spark.read.json(f"{path}/split_manifest"), images, labels, classes_of(spark, path), json.loads(read_text(spark, f"{path}/counts.json"))


def check_export(spark: SparkSession, path: str, core: Sequence[str], strict: bool = True) -> DataFrame:
    """What keeps the export at ``path`` from being used."""
    manifest, images, labels, names, counts = read_export(spark, path)
    return inventory.violations(manifest, images, labels, names, core, counts.get("quality"), strict)


def write_scan(spark: SparkSession, folder: str, records: DataFrame, config: Mapping, run: Mapping) -> dict:
    """Write a scan's ``groups``, ``summary.json``, ``settings.json`` and ``run_info.json`` into a folder; the summary is returned.

    records: source, image, status, group, unit, boxes, duplicates. ``groups``
    has a JSON line (group, source, image) per record, each group's together
    and in the order of its images: of any size, as no group is ever one value.
    The summary has one entry per source and no more.
    """
    lines = records.select("group", "source", "image")
    lines.repartitionByRange("group", "image").sortWithinPartitions("group", "image").write.json(f"{folder}/groups")
    per = {r["source"]: {"images": r["images"], "empty": r["empty"], "statuses": dict(r["statuses"])} for r in inventory.scan_summary(records).collect()}
    whole, states = inventory.cross_source_groups(records).first(), records.groupBy("status").count().collect()
    units = records.where("unit IS NOT NULL").select("source", "unit").distinct().count()
    summary = {
        "sources": per, "status_counts": {r["status"]: r["count"] for r in states}, "similarity_groups": whole["groups"], "cross_source_groups": whole["crossing"],
        "capture_units": units, "duplicate_rows_removed": records.agg(F.sum("duplicates")).first()[0] or 0,
    }
    for name, value in (("summary", summary), ("settings", config), ("run_info", run)):
        write_text(spark, f"{folder}/{name}.json", json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False))
    return summary


def run_lists(rows: DataFrame, path: str, names: Sequence[str], column: str = "path") -> None:
    """The image lists of a run, a text folder for each split, and their data.yaml. rows: split, path."""
    import yaml

    spark = rows.sparkSession
    splits = [r[0] for r in rows.select("split").distinct().orderBy("split").collect()]
    for split in splits:
        rows.where(F.col("split") == split).select(column).orderBy(column).write.mode("errorifexists").text(f"{path}/{split}")
    write_text(spark, f"{path}/data.yaml", yaml.safe_dump({"path": path, "names": list(names), **{s: f"{path}/{s}" for s in splits}}, sort_keys=False))


def converted_labels(texts: DataFrame, classes: int, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, text, boxes, polygons): label texts with every polygon as its box, in ten digits; a bad line is an error when it is read.

    polygons: the lines that were polygons.
    """
    from ..functions.geometry import centre
    from ..functions.identity import import_number

    lines = label_lines(texts, classes, path_col, text_col)
    kind = F.when(F.col("problem").isNull(), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("invalid annotation: "), F.col(path_col).cast("string"), F.lit(":"), F.col("line").cast("string"))).cast("string"))
    # of a box the four numbers as they stand, of a polygon the box around it
    numbers = [F.when(kind == "box", F.get("xy", F.lit(i))).otherwise(v) for i, v in enumerate(centre(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))]
    one = F.concat_ws(" ", F.col("cid").cast("string"), *[import_number(v) for v in numbers])
    rows = lines.select(path_col, "line", (kind == "polygon").alias("turned"), one.alias("row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n")
    made = rows.groupBy(path_col).agg(joined.alias("text"), F.count_if(~F.col("turned")).alias("boxes"), F.array_sort(F.collect_list(F.when(F.col("turned"), F.col("line")))).alias("polygons"))
    none = F.array().cast("array<int>")
    return texts.select(path_col).join(made, path_col, "left").select(path_col, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("polygons", none).alias("polygons"))


def store_plan(spark: SparkSession, path: str, payload: Mapping, subsets: DataFrame, jobs: DataFrame) -> dict:
    """Write a study's plan with its identity, its subsets (subset, stem) and a pending status for every job."""
    plan = study.stored_plan(payload)
    subsets.write.mode("errorifexists").partitionBy("subset").parquet(f"{path}/subsets")
    Versions(spark, f"{path}/status").replace(jobs.select("job", F.lit("pending").alias("state")), None)
    write_text(spark, f"{path}/plan.json", json.dumps(plan, sort_keys=True))
    return plan


def load_plan(spark: SparkSession, path: str, code: str, split: str, weights: Mapping[str, str | None]) -> dict:
    """A stored plan, if it, its code, data and weights are what they were."""
    plan = json.loads(read_text(spark, f"{path}/plan.json"))
    problem = study.plan_problem(plan, code, split, weights)
    if problem:
        raise ValueError(problem)
    return plan


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A small file with this text at ``path``, unless there is one: of several writers exactly one gets True.

    The text is whole before it can be seen: it is written beside and then put
    in place in one step that fails if the place is taken, a link in a local
    folder, a rename without overwriting elsewhere (atomic where the store's is).
    """
    beside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    p, fs = _path(spark, path)
    q = _path(spark, beside)[0]
    if fs.getScheme() == "file":
        try:
            os.link(q.toUri().getPath(), p.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(q, False)
    if fs.exists(p) or not fs.rename(q, p):
        fs.delete(q, False)
        return False
    return True


class Versions:
    """A table that is replaced as a whole; of those who replace the same version one succeeds.

    A writer fills an attempt folder of its own, then claims the next number by a
    marker that names the folder. Readers follow markers alone, so what
    is half written is never seen, and nothing is ever moved.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _names(self, folder: str) -> list[str]:
        p, fs = _path(self.spark, f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def last(self) -> int | None:
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=None)

    def folder(self, number: int) -> str:
        return f"{self.path}/attempts/{read_text(self.spark, f'{self.path}/versions/{number}')}"

    def read(self, number: int | None = None) -> tuple[DataFrame, int]:
        last = self.last() if number is None else number
        if last is None:
            raise ValueError(f"nothing at {self.path}")
        return self.spark.read.parquet(self.folder(last)), last

    def prepare(self, rows: DataFrame) -> str:
        """Write rows to an attempt folder that no other writer has; gives its name."""
        name = uuid.uuid4().hex
        rows.write.mode("errorifexists").parquet(f"{self.path}/attempts/{name}")
        return name

    def claim(self, name: str, expected: int | None) -> int:
        """Make an attempt the version after ``expected``; an error if that number is taken."""
        number = 0 if expected is None else expected + 1
        if self.last() != expected or not put_if_absent(self.spark, f"{self.path}/versions/{number}", name):
            raise ValueError(f"{self.path} changed meanwhile: version {self.last()}, not {expected}")
        return number

    def replace(self, rows: DataFrame, expected: int | None) -> int:
        """Write the next version; ``expected`` is the one that ``rows`` were made from."""
        if self.last() != expected:
            raise ValueError(f"{self.path} changed meanwhile: version {self.last()}, not {expected}")
        return self.claim(self.prepare(rows), expected)

    def unclaimed(self) -> list[str]:
        """Attempt folders that no version names: refused, interrupted or still being written."""
        named = {read_text(self.spark, f"{self.path}/versions/{n}") for n in self._names("versions") if n.isdigit()}
        return sorted(n for n in self._names("attempts") if n not in named)


def attempt(spark: SparkSession, path: str) -> str | None:
    """Make room for a cache at ``path`` that one writer at a time builds: what an interrupted write left there is moved aside, and its new place given.

    A cache that was written in full is an error. Tables with several writers: :class:`Versions`.
    """
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    if fs.exists(_path(spark, f"{path}/_SUCCESS")[0]):
        raise ValueError(f"{path} is there already")
    k = 1
    while fs.exists(_path(spark, f"{path}_incomplete_{k}")[0]):
        k += 1
    fs.rename(p, _path(spark, f"{path}_incomplete_{k}")[0])
    return f"{path}_incomplete_{k}"


def image_issues(orientation: Column, width: Column, height: Column, stated_width: Column, stated_height: Column, corrupt: Column) -> Column:
    """Issues of a decoded image: unreadable, turned by its EXIF tag, or not of the stated size."""
    differ = ~(width.eqNullSafe(stated_width) & height.eqNullSafe(stated_height))
    found = [F.when(corrupt, "corrupt_image"), F.when(~corrupt & (F.coalesce(orientation, F.lit(1)) != 1), "nontrivial_exif_orientation"), F.when(~corrupt & stated_width.isNotNull() & differ, "image_dimensions_differ")]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def patches(rows: DataFrame, sources: DataFrame, on: str, columns: Sequence[str], digest: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(patches, violations): patches whose bytes have their hash and whose recorded source columns are the source's.

    rows: on, content, ``digest`` and the columns; sources: on and the columns.
    """
    from ..operators.workflow import provenance

    wrong = rows.where(F.sha2("content", 256) != F.col(digest)).select(F.lit("patch_changed").alias("violation"), F.col(on).cast("string").alias("key"))
    bad = materialize(wrong.unionByName(provenance(rows, sources, on, columns)))
    good = rows.join(bad.select(F.col("key").alias("__key")).distinct(), F.col(on).cast("string") == F.col("__key"), "left_anti")
    return good, bad
