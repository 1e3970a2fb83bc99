"""JSON detection exports in either of two folder layouts, with everything that is fatal as rows and issues by image."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, images
from ..session import materialize
from .annotations import IMAGE_SUFFIXES, image_files
from .archives import opened
from .json_arrays import TARGET, digests, elements

# fixed values: the fields of the three arrays
FIELDS = {
    "categories": "id long, name string",
    "images": "id long, file_name string, width long, height long",
    "annotations": "id long, image_id long, category_id long, bbox array<double>, iscrowd int",
}
DOCUMENTS = "split string, path string, folder string"


def exists(path: str) -> bool:
    fs, name = opened(path)
    return fs.get_file_info(name).type != pafs.FileType.NotFound


def layout(root: str, splits: Sequence[str] = ("train", "val", "test")) -> list[tuple[str, str, str]]:
    """(split, document, image folder below the root) of each split.

    ``annotations/instances_<split>.json`` beside ``images/<split>``, or, where
    there is no such document, ``<split>/_annotations.coco.json`` among its
    images, val in the folder ``valid``.
    """
    out = []
    for split in splits:
        label, folder = f"{root}/annotations/instances_{split}.json", f"images/{split}"
        if not exists(label):
            folder = "valid" if split == "val" else split
            label = f"{root}/{folder}/_annotations.coco.json"
        if not exists(label):
            raise ValueError(f"{root} has no document for {split}")
        out.append((split, label, folder))
    return out


def resolved(name: Column) -> Column:
    """A relative path without . and .. steps; null for one that leaves its folder, is absolute, empty or null."""
    up = F.array(F.lit(None).cast("string"))  # a null step marks a path that has left

    def step(done: Column, part: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(up)
        return F.when(F.exists(done, lambda x: x.isNull()), done).when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    steps = F.aggregate(F.split(name, "/"), F.array().cast("array<string>"), step)
    fine = name.isNotNull() & ~F.startswith(name, F.lit("/")) & ~F.exists(steps, lambda x: x.isNull()) & (F.size(steps) > 0)
    return F.when(fine, F.array_join(steps, "/"))


def tables(spark: SparkSession, documents: Sequence[tuple[str, str, str]], target: int = TARGET) -> dict[str, DataFrame]:
    """categories, images and annotations of all documents, beside split, path and folder of theirs; ids belong to their document."""
    of = spark.createDataFrame(list(documents), DOCUMENTS)
    rows = materialize(elements(spark, [d[1] for d in documents], target).where(F.col("section").isin(*FIELDS)).join(of, "path"))
    return {name: rows.where(F.col("section") == name).select("split", "path", "folder", "place", F.from_json("text", fields).alias("x")).select("split", "path", "folder", "place", "x.*") for name, fields in FIELDS.items()}


def violations(parts: Mapping[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """(violation, path, key, rows): what makes an export unusable.

    repeated_category, repeated_image, repeated_annotation: an id twice in its
    document, or missing; unknown_image, unknown_category: references to
    nothing; unsafe_path, repeated_path: a file outside its folder, or named
    twice by any documents; invalid_dimensions. With ``files`` (path below the
    root): missing_file and unlisted_file.
    """
    cats, imgs, anns = parts["categories"], parts["images"], parts["annotations"]
    text = lambda c: F.col(c).cast("string").alias("key")
    repeated = lambda df, what: df.groupBy("path", "id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR id IS NULL").select(F.lit(what).alias("violation"), "path", text("id"), "rows")

    def unknown(key: str, of: DataFrame, what: str) -> DataFrame:
        # one row a key on both sides, whatever its annotations
        used = anns.groupBy("path", key).agg(F.count(F.lit(1)).alias("rows"))
        return used.join(of.select("path", F.col("id").alias(key)).where(F.col(key).isNotNull()), ["path", key], "left_anti").select(F.lit(what).alias("violation"), "path", text(key), "rows")

    where = F.concat("folder", F.lit("/"), resolved(F.col("file_name")))
    named = imgs.select("path", "file_name", "width", "height", where.alias("file"))
    out = repeated(cats, "repeated_category").unionByName(repeated(imgs, "repeated_image")).unionByName(repeated(anns, "repeated_annotation"))
    out = out.unionByName(unknown("image_id", imgs, "unknown_image")).unionByName(unknown("category_id", cats, "unknown_category"))
    one = F.lit(1).cast("long").alias("rows")
    out = out.unionByName(named.where("file IS NULL").select(F.lit("unsafe_path").alias("violation"), "path", text("file_name"), one))
    # a file named by several documents has its least one's path
    twice = named.where("file IS NOT NULL").groupBy("file").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    out = out.unionByName(twice.select(F.lit("repeated_path").alias("violation"), "path", text("file"), "rows"))
    flat = named.where("NOT coalesce(width > 0 AND height > 0, false)")
    out = out.unionByName(flat.select(F.lit("invalid_dimensions").alias("violation"), "path", text("file_name"), one))
    if files is not None:
        there = files.select("file").distinct()
        lost = named.where("file IS NOT NULL").select("path", "file").join(there, "file", "left_anti")
        new = there.join(named.where("file IS NOT NULL").select("file"), "file", "left_anti")
        out = out.unionByName(lost.select(F.lit("missing_file").alias("violation"), "path", text("file"), one))
        out = out.unionByName(new.select(F.lit("unlisted_file").alias("violation"), F.lit(None).cast("string").alias("path"), text("file"), one))
    return out


def graded_annotations(parts: Mapping[str, DataFrame], class_map: Mapping[str, str], targets: Sequence[str]) -> DataFrame:
    """Annotations beside their image and category, with source_class, target_class, target_id, issues (array), again and box.

    box: the centre box in shares of the image, null unless four finite numbers
    lie in it (to 1e-6); again: it repeats an earlier box of its image and
    category. A box with another issue than these stays. Rows that refer to nothing are violations, not rows here.
    """
    imgs = parts["images"].select("path", F.col("id").alias("image_id"), "width", "height")
    cats = parts["categories"].select("path", F.col("id").alias("category_id"), F.col("name").alias("source_class"))
    rows = parts["annotations"].join(imgs, ["path", "image_id"]).join(cats, ["path", "category_id"])
    known = F.create_map(*[x for k, v in class_map.items() for x in (F.lit(k), F.lit(v))]) if class_map else F.lit(None).cast("map<string,string>")
    target = F.try_element_at(known, F.col("source_class"))
    place = F.nullif(F.array_position(F.array(*[F.lit(t) for t in targets]).cast("array<string>"), target), F.lit(0)).cast("int") - 1
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    finite = F.coalesce((F.size("bbox") == 4) & F.forall("bbox", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    within = (F.least(x, y) >= 0) & (F.least(w, h) > 0) & (x + w <= F.col("width") + 1e-6) & (y + h <= F.col("height") + 1e-6)
    rows = rows.withColumns({"target_class": target, "target_id": place, "finite": finite, "within": finite & within})
    issues = F.array(
        F.when(F.col("target_id").isNull(), F.concat(F.lit("unmapped_class:"), F.coalesce("source_class", F.lit("")))), F.when(F.coalesce("iscrowd", F.lit(0)) != 0, "unsupported_crowd_annotation"),
        F.when(~F.col("finite"), "invalid_coco_box").when(~F.col("within"), "coco_box_outside_image"),
    )
    centre = F.when(F.col("within"), F.array((x + w / 2) / F.col("width"), (y + h / 2) / F.col("height"), w / F.col("width"), h / F.col("height")))
    rows = rows.withColumns({"issues": F.filter(issues, lambda i: i.isNotNull()), "box": centre})
    # the earliest of equal boxes comes from an aggregate, so copies by the thousand are combined before they move
    same = ["path", "image_id", "category_id", "bbox"]
    first = rows.where("within").groupBy(*same).agg(F.min("place").alias("first"))
    rows = rows.join(first, same, "left").withColumn("again", F.coalesce(F.col("within") & (F.col("place") > F.col("first")), F.lit(False)))
    return rows.drop("finite", "within", "first")


def records(parts: Mapping[str, DataFrame], class_map: Mapping[str, str], targets: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """One row per image: split, path, file, width, height, schema_sha256, annotations, issues, duplicates, empty.

    annotations: array of (line, source_class, kind, coordinates, target_class,
    target_id, box) by place in the document; issues: sorted and distinct;
    empty: no annotation refers to the image, a bad one included. With
    ``files`` (file, sha256, and what is known of width, height, orientation,
    corrupt): their sha256 and issues of unreadable and turned images and those
    of another size. What :func:`violations` reports as fatal is not repaired.
    """
    graded = graded_annotations(parts, class_map, targets)
    kept = F.col("box").isNotNull() & ~F.col("again")
    one = F.struct("place", F.col("id").alias("line"), "source_class", F.lit("box").alias("kind"), F.col("bbox").alias("coordinates"), "target_class", "target_id", "box")
    per = graded.groupBy("path", "image_id").agg(
        F.array_sort(F.collect_list(F.when(kept, one))).alias("annotations"), F.array_distinct(F.flatten(F.collect_set("issues"))).alias("found"), F.count_if("again").alias("duplicates"), F.count(F.lit(1)).alias("n")
    )
    plain = F.transform("annotations", lambda a: a.dropFields("place"))
    cats = F.map_from_entries(F.array_sort(F.collect_set(F.struct("id", "name"))))
    # the names that a document gives its ids, and what is made of them
    names = parts["categories"].groupBy("path").agg(cats.alias("class_order"))
    stated = json.dumps({"mapping": dict(class_map), "targets": list(targets)})[1:]
    schema = F.concat(F.lit('{"categories": '), F.to_json("class_order"), F.lit(", " + stated))
    names = names.select("path", "class_order", identity.spaced_hash(schema).alias("schema_sha256"))
    rows = parts["images"].withColumn("file", F.concat("folder", F.lit("/"), resolved(F.col("file_name")))).withColumnRenamed("id", "image_id")
    rows = rows.join(per, ["path", "image_id"], "left").join(names, "path", "left")
    nothing = F.array().cast("array<string>")
    more = nothing
    columns = ["split", "path", "image_id", "file", "width", "height", "class_order", "schema_sha256"]
    if files is not None:
        known = {c: F.col(c) if c in files.columns else F.lit(None).cast(kind) for c, kind in {"sha256": "string", "width": "long", "height": "long", "orientation": "int", "corrupt": "boolean"}.items()}
        rows = rows.join(files.select("file", *[c.alias(f"file_{n}") for n, c in known.items()]), "file", "left")
        readable = ~F.coalesce("file_corrupt", F.lit(False))
        differ = F.col("file_width").isNotNull() & ((F.col("file_width") != F.col("width")) | (F.col("file_height") != F.col("height")))
        more = F.array(F.when(~readable, "corrupt_image"), F.when(readable & differ, "coco_dimension_mismatch"), F.when(readable & (F.coalesce("file_orientation", F.lit(1)) != 1), "nontrivial_exif_orientation"))
        columns.append("file_sha256")
    issues = F.array_sort(F.array_compact(F.concat(F.coalesce("found", nothing), more)))
    return rows.select(*columns, F.coalesce(plain, F.array().cast(graded_type(rows))).alias("annotations"), issues.alias("issues"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("empty", F.col("n") == 0).drop("n")


def graded_type(rows: DataFrame) -> str:
    """The type of ``annotations`` without the place that orders them."""
    kind = rows.select(F.transform("annotations", lambda a: a.dropFields("place")).alias("a")).schema["a"].dataType
    return kind.simpleString()


def image_facts(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(file, sha256, width, height, orientation, corrupt) of all images below a root, decoded where they lie."""
    bare = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
    below = lambda c: F.substring_index(c, bare, -1)
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in suffixes) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    raw = raw.select(below(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), images.orientation_of("content").alias("orientation"))
    seen = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    seen = seen.select(below(F.col("image.origin")).alias("file"), F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), (F.col("image.height") < 0).alias("corrupt"))
    return raw.join(seen, "file")


def scan(spark: SparkSession, root: str, class_map: Mapping[str, str], targets: Sequence[str], splits: Sequence[str] = ("train", "val", "test"), target: int = TARGET) -> DataFrame:
    """:func:`records` of an export and its image files, with label_sha256; anything fatal is an error that names some of it."""
    documents = layout(root, splits)
    parts, files = tables(spark, documents, target), materialize(image_facts(spark, root))
    bad = violations(parts, files).orderBy("violation", "key").limit(5).collect()
    if bad:
        raise ValueError(f"{root}: " + "; ".join(f"{r['violation']} {r['key']}" for r in bad))
    hashes = digests(spark, [d[1] for d in documents]).withColumnRenamed("sha256", "label_sha256")
    return records(parts, class_map, targets, files).join(hashes, "path")
