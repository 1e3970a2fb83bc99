"""Readers of annotation exports: label text, JSON exports, review tables, XML exchange, archives and logs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, names
from ..session import delete_path, materialize, shared_folder

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def image_files(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, split, stem, bytes, sha256, md5) of the images under ``<root>/<split>/images``; files are read where they lie."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    split = F.regexp_extract("path", r"/([^/]+)/images/", 1)
    return files.select("path", split.alias("split"), names.stem(F.col("path")).alias("stem"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")).where("split <> ''")


def resolve(folders: Sequence[str], hint: str, exactly: bool = False) -> str:
    """The folder whose name holds a hint, whatever its case: the first, or the only one."""
    found = [f for f in folders if hint.lower() in f.lower()]
    if not found or exactly and len(found) > 1:
        raise ValueError(f"{len(found)} folders match {hint!r}")
    return found[0]


def class_names(listed: Sequence[str] | Mapping[int, str] | None, fallback: Sequence[str] = ()) -> list[str]:
    """Class names from a list, or from a map in the order of its keys."""
    if listed is None:
        return list(fallback)
    return [listed[k] for k in sorted(listed)] if isinstance(listed, Mapping) else list(listed)


def readme_facts(text: Column, name: Column) -> Column:
    """What an export's README says, as a map of what was found: file, version_line, augmentation, preprocessing and image_count_readme.

    name: which of ``exports.READMES`` the text is. A text that names its
    augmentation steps is believed over one that denies any.
    """
    whole = lambda p: F.nullif(F.trim(F.regexp_extract(text, f"(?i){p}", 0)), F.lit(""))
    denied = F.when(text.rlike("(?i)No image augmentation"), "none stated")
    facts = {
        "file": F.when(text.isNotNull(), name), "version_line": whole(r"- v\d+"), "augmentation": F.coalesce(whole(r"augmentation was applied[^\n]*"), denied),
        "preprocessing": whole(r"pre-processing was applied[^\n]*"), "image_count_readme": F.nullif(F.regexp_extract(text, r"(?i)includes (\d+) images", 1), F.lit("")),
    }
    every = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)])
    return F.map_filter(every, lambda _, v: v.isNotNull()).alias("facts")


def label_lines(texts: DataFrame, classes: int, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, fields, problem, kind, cid, x1, y1, x2, y2): one row per line that isn't blank; bad lines have a problem and no box."""
    rows = texts.select(path_col, F.posexplode(F.split(text_col, "\r?\n")).alias("line", "raw")).where("trim(raw) <> ''")
    rows = rows.select(path_col, (F.col("line") + 1).alias("line"), F.split(F.trim("raw"), r"\s+").alias("fields"))
    rows = rows.withColumn("problem", geometry.label_problem(F.col("fields"), classes))
    xy = F.transform(F.slice("fields", 2, F.greatest(F.size("fields") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    rows = rows.withColumn("xy", F.when(F.col("problem").isNull(), xy)).withColumn("kind", F.when(F.size("xy") == 4, "box").when(F.size("xy") > 4, "polygon"))
    box = geometry.corners(*[F.get("xy", F.lit(i)) for i in range(4)])
    hull = geometry.polygon_bounds(F.col("xy"))
    sides = {c: F.when(F.col("kind") == "box", b).otherwise(h) for c, b, h in zip(("x1", "y1", "x2", "y2"), box, hull)}
    cid = F.when(F.col("problem").isNull(), F.get("fields", F.lit(0)).try_cast("double").cast("int"))
    return rows.withColumns({"cid": cid, **sides})


def normalised_annotations(texts: DataFrame, source_classes: Sequence[str], mapping: Mapping[str, str], targets: Sequence[str], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, annotations, issues, duplicates): labels with their source and target classes.

    A line that repeats an earlier one is dropped and counted; classes without
    a target and bad lines become sorted, distinct issues.
    """
    lines = label_lines(texts, len(source_classes), path_col, text_col)
    raw = F.get(F.array(*[F.lit(c) for c in source_classes]), F.col("cid"))
    known = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]) if mapping else F.lit(None).cast("map<string,string>")
    lines = lines.withColumn("source_class", raw).withColumn("target_class", F.try_element_at(known, F.col("source_class")))
    lines = lines.withColumn("target_id", F.nullif(F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target_class")), F.lit(0)).cast("int") - 1)
    same = Window.partitionBy(path_col, "cid", F.array_join(F.transform("xy", lambda v: v.cast("string")), " ")).orderBy("line")
    lines = lines.withColumn("again", F.col("problem").isNull() & (F.row_number().over(same) > 1))
    issue = F.when(F.col("problem").isNotNull(), F.concat(F.lit("invalid:"), "problem")).when(F.col("target_id").isNull(), F.concat(F.lit("unmapped_class:"), F.coalesce("source_class", F.lit(""))))
    box = F.array(*geometry.centre(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    one = F.struct("line", "source_class", "kind", F.col("xy").alias("coordinates"), "target_class", "target_id", box.alias("box"))
    return lines.groupBy(path_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("problem").isNull() & ~F.col("again"), one))).alias("annotations"),
        F.array_sort(F.collect_set(issue)).alias("issues"),
        F.count_if("again").alias("duplicates"),
    )


COCO = "categories array<struct<id: bigint, name: string>>, images array<struct<id: bigint, file_name: string, width: int, height: int>>, annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, iscrowd: int>>"


def coco(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(boxes, violations) of JSON exports by split, whose ids are local to their split.

    boxes: split, file_name, width, height, category, cid, issue and the centre
    box in shares of the image; images without boxes have one row without. The
    violations are fatal: repeated ids, references to nothing, unsafe paths.
    """
    whole = None
    for split, path in paths.items():
        part = spark.read.option("multiLine", True).schema(COCO).json(path).withColumn("split", F.lit(split))
        whole = part if whole is None else whole.unionByName(part)
    images = whole.select("split", F.inline("images")).withColumnsRenamed({"id": "image_id"})
    cats = whole.select("split", F.inline("categories")).withColumnsRenamed({"id": "category_id", "name": "category"})
    anns = whole.select("split", F.inline("annotations"))
    bad = lambda df, what, key: df.groupBy("split", F.col(key).cast("string").alias("key")).count().where("count > 1").select(F.lit(what).alias("violation"), "split", "key")
    lost = lambda key, of, what: anns.join(of, ["split", key], "left_anti").select(F.lit(what).alias("violation"), "split", F.col(key).cast("string").alias("key"))
    violations = bad(images, "repeated_image", "image_id").unionByName(bad(cats, "repeated_category", "category_id")).unionByName(bad(anns, "repeated_annotation", "id"))
    violations = violations.unionByName(lost("image_id", images, "unknown_image")).unionByName(lost("category_id", cats, "unknown_category"))
    unsafe = images.where(F.col("file_name").rlike(r"(^|/)\.\.(/|$)|^/")).select(F.lit("unsafe_path").alias("violation"), "split", F.col("file_name").alias("key"))
    rows = images.join(anns.withColumnRenamed("id", "annotation_id"), ["split", "image_id"], "left").join(cats, ["split", "category_id"], "left")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    issue = F.when(F.col("annotation_id").isNull(), F.lit(None)).when((F.size("bbox") != 4) | (w <= 0) | (h <= 0), "area").when((x < 0) | (y < 0) | (x + w > F.col("width")) | (y + h > F.col("height")), "box outside image").when(F.coalesce("iscrowd", F.lit(0)) != 0, "crowd")
    centre = {"cx": (x + w / 2) / F.col("width"), "cy": (y + h / 2) / F.col("height"), "w": w / F.col("width"), "h": h / F.col("height")}
    return rows.withColumn("issue", issue.cast("string")).withColumns(centre).drop("bbox"), violations.unionByName(unsafe)


def reviews(spark: SparkSession, path: str, key: str = "image", actions: Sequence[str] = ("", "approve", "exclude", "repair", "quarantine")) -> DataFrame:
    """A review table; missing or repeated keys and unknown actions are errors."""
    rows = spark.read.option("header", True).csv(path).fillna("")
    bad = rows.where((F.col(key) == "") | ~F.col("action").isin(list(actions))).limit(1).count()
    if bad or rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: keys must be present and unique, and actions one of {sorted(actions)}")
    return rows


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def subset_list(text: str) -> list[str]:
    """Names from a JSON list; anything else is an error."""
    found = json.loads(text)
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError("a JSON list of names is needed")
    return found


EXCHANGE = "_id string, _name string, _width int, _height int, box array<struct<_label: string, _xtl: double, _ytl: double, _xbr: double, _ybr: double, _rotation: double, _outside: int>>, tag array<struct<_label: string>>, polygon array<struct<_label: string>>"


def exchange(spark: SparkSession, path: str, most: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """(boxes, violations) of an image-annotation XML file, bare or the one annotations.xml of a ZIP; boxes in shares of the image.

    Larger documents than ``most`` bytes and those with a DOCTYPE, an ENTITY or
    tracks are refused; a box must be upright, finite and inside its image.
    """
    folder = None
    if path.lower().endswith(".zip"):
        texts = [bytes(r["content"]) for r in archive_members(spark, path, r"(^|/)()(annotations\.xml)$", most).select("content").limit(2).collect()]
        if len(texts) != 1:
            raise ValueError(f"{path}: one annotations.xml is needed")
        folder = shared_folder(spark, "exchange")
        spark.createDataFrame([(texts[0].decode("utf-8-sig"),)], "value string").coalesce(1).write.text(folder)
        path = folder
    elif spark.read.format("binaryFile").load(path).where(F.col("length") > most).limit(1).count():
        raise ValueError(f"{path} is larger than {most} bytes")
    if spark.read.text(path).where(F.col("value").rlike("(?i)<!DOCTYPE|<!ENTITY|<track[ >]")).limit(1).count():
        raise ValueError(f"{path}: DOCTYPE, ENTITY and tracks are not accepted")
    images = spark.read.format("xml").option("rowTag", "image").schema(EXCHANGE).load(path)
    if folder:
        images = materialize(images)
        delete_path(spark, folder)
    boxes = images.select(F.col("_name").alias("name"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.explode_outer("box").alias("b"))
    b = {c: F.col(f"b._{c}") for c in ("label", "xtl", "ytl", "xbr", "ybr", "rotation", "outside")}
    problem = (
        F.when(F.col("b").isNull(), F.lit(None).cast("string")).when(F.coalesce(b["rotation"], F.lit(0.0)) != 0, "rotated").when(F.coalesce(b["outside"], F.lit(0)) != 0, "outside")
        .when(b["xtl"].isNull() | b["ytl"].isNull() | b["xbr"].isNull() | b["ybr"].isNull(), "nonfinite")
        .when((b["xtl"] < 0) | (b["ytl"] < 0) | (b["xbr"] > F.col("width")) | (b["ybr"] > F.col("height")) | (b["xtl"] >= b["xbr"]) | (b["ytl"] >= b["ybr"]), "box outside image")
    )
    out = boxes.select("name", b["label"].alias("label"), (b["xtl"] / F.col("width")).alias("x1"), (b["ytl"] / F.col("height")).alias("y1"), (b["xbr"] / F.col("width")).alias("x2"), (b["ybr"] / F.col("height")).alias("y2"), problem.alias("problem"))
    shapes = images.where(F.size(F.coalesce("polygon", F.array())) > 0).select(F.lit("polygon").alias("violation"), F.col("_name").alias("key"))
    return out.where("problem IS NULL").drop("problem"), out.where("problem IS NOT NULL").select(F.col("problem").alias("violation"), F.col("name").alias("key")).unionByName(shapes)


def archive_members(spark: SparkSession, path: str, pattern: str = r"([^/]+)/(images|labels)/([^/]+)$", most: int = 50_000_000) -> DataFrame:
    """(archive, split, kind, name, content) of the members of ZIP files that match; ``valid`` is read as ``val``.

    A file is one row of one task, in any store that Spark reads; files of over
    a few hundred megabytes: ``archives.members`` reads them by ranges.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        m = re.search(pattern, info.filename)
                        if not m or info.is_dir() or ".." in info.filename.split("/"):
                            continue
                        if info.file_size > most:
                            raise ValueError(f"{info.filename} is too large")
                        yield pd.DataFrame({"archive": [archive], "split": ["val" if m[1] == "valid" else m[1]], "kind": [m[2]], "name": [m[3]], "content": [z.read(info)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, split string, kind string, name string, content binary")
