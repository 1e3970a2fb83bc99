"""JSON detection exports over documents: a document is an image, its labels are boxes; written, split, read back and checked."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ..session import materialize, table
from ..sources import archives, coco
from .registry import SPLIT, query, split_of
from .round_trips import folder

#: Images of one JSON document, and the bytes of it that one range reads.
IMAGES, RANGE = 20_000, 1 << 18
NAMES = ["low", "high"]

#: Images with a size, a name and a box each; some leave their folder, share a name, have no width, refer to nothing or repeat an id.
EXPORT = f"""
    i AS (SELECT doc_id, {SPLIT} AS split, CASE WHEN doc_id % 73 = 0 THEN 0 ELSE 40 + coalesce(n_chars, 0) % 100 END AS width,
            CASE WHEN doc_id % 83 = 0 THEN NULL WHEN doc_id % 79 = 0 THEN 'same.png' ELSE doc_id || '.png' END AS name FROM documents),
    l AS (SELECT doc_id, coalesce(quality, 0) AS q, coalesce(toxic, 0) AS t, doc_id % 50 AS x, 1 + doc_id % 60 AS w FROM labels)
"""


@contextmanager
def written(spark, d):
    """(categories, images and annotations) of the documents that the tables make."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    count = 1 + docs.count() // IMAGES
    key = F.col("doc_id")
    place = [split_of(key).alias("split"), F.pmod(F.xxhash64(key), F.lit(count)).alias("bucket")]
    # a leading step back that stays inside, and one that does not
    name = F.when(key % 83 == 0, F.concat(F.lit("d/../../"), key)).when(key % 79 == 0, "d/../same.png").otherwise(F.concat(F.lit("./d/../"), key, F.lit(".png")))
    width = F.when(key % 73 == 0, F.lit(0)).otherwise(40 + F.coalesce("n_chars", F.lit(0)) % 100)
    images = docs.select(*place, F.struct(key.alias("id"), name.alias("file_name"), width.cast("long").alias("width"), F.lit(200).alias("height")).alias("image"))
    q, t = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    numbers = [(key % 50).cast("double"), F.lit(0.0), (1 + key % 60).cast("double")]
    box = F.when(key % 31 == 0, F.array(*numbers)).otherwise(F.array(*numbers, F.lit(10.0)))
    one = lambda number: F.struct(number.alias("id"), F.when(key % 97 == 0, -1 - key).otherwise(key).alias("image_id"), q.alias("category_id"), box.alias("bbox"), t.alias("iscrowd"))
    both = F.when(q == 1, F.array(one(2 * key), one(F.when(key % 89 == 0, 2 * key).otherwise(2 * key + 1)))).otherwise(F.array(one(2 * key)))
    boxes = labels.select(*place, F.explode(both).alias("annotation"))
    rows = images.unionByName(boxes, allowMissingColumns=True)
    cats = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(NAMES)]).alias("categories")
    # a bucket has about IMAGES images, whatever the table
    whole = rows.groupBy("split", "bucket").agg(F.collect_list("image").alias("images"), F.collect_list("annotation").alias("annotations"))
    with folder(spark, "json") as path:
        whole.select("split", "bucket", F.to_json(F.struct("images", "annotations", cats)).alias("value")).write.partitionBy("split", "bucket").text(path)
        fs, below = archives.opened(path)
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(below, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".txt")]
        parts = [(f[len(below) :].split("split=")[1].split("/")[0], path + f[len(below) :]) for f in sorted(found)]
        yield coco.tables(spark, [(split, p, f"images/{split}") for split, p in parts], RANGE)


@query(f"""
    WITH {EXPORT}, j AS (SELECT i.*, l.doc_id IS NOT NULL AS boxed, q, t, i.doc_id % 31 = 0 AS broken, x + w <= width AS inside, (x + w / 2) / nullif(width, 0) AS cx FROM i LEFT JOIN l ON i.doc_id = l.doc_id AND i.doc_id % 97 <> 0)
    SELECT split, doc_id AS image_id, 'images/' || split || '/' || name AS file, (boxed AND inside AND NOT broken)::INTEGER AS boxes, CASE WHEN boxed AND inside AND NOT broken THEN round(cx, 9) END AS cx,
        CASE WHEN boxed AND inside AND NOT broken AND q = 1 THEN 1 END::INTEGER AS target_id, (boxed AND inside AND NOT broken AND q = 1)::BIGINT AS duplicates, NOT boxed AS empty,
        array_to_string(list_filter([CASE WHEN NOT broken AND NOT inside THEN 'coco_box_outside_image' END, CASE WHEN boxed AND broken THEN 'invalid_coco_box' END, CASE WHEN q = 0 THEN 'unmapped_class:low' END, CASE WHEN t <> 0 THEN 'unsupported_crowd_annotation' END], lambda v: v IS NOT NULL), ';') AS issues FROM j
""")
def coco_records(spark, d):
    with written(spark, d) as parts:
        found = coco.records(parts, {"high": "good"}, ["bad", "good"])
        box = F.get("annotations", F.lit(0))
        return materialize(found.select("split", "image_id", "file", F.size("annotations").alias("boxes"), F.round(F.get(box["box"], F.lit(0)), 9).alias("cx"), box["target_id"].alias("target_id"), "duplicates", "empty", F.array_join("issues", ";").alias("issues")))


@query(f"""
    WITH {EXPORT}, u AS (SELECT CASE WHEN doc_id % 97 = 0 THEN -1 - doc_id ELSE doc_id END AS image_id, 1 + (q = 1)::BIGINT AS rows FROM l)
    SELECT 'unknown_image' AS violation, image_id::VARCHAR AS key, rows FROM u WHERE image_id NOT IN (SELECT doc_id FROM i)
    UNION ALL SELECT 'repeated_annotation', (2 * doc_id)::VARCHAR, 2 FROM l WHERE q = 1 AND doc_id % 89 = 0
    UNION ALL SELECT 'unsafe_path', 'd/../../' || doc_id, 1 FROM i WHERE name IS NULL
    UNION ALL SELECT 'repeated_path', 'images/' || split || '/same.png', count(*) FROM i WHERE name = 'same.png' GROUP BY split HAVING count(*) > 1
    UNION ALL SELECT 'invalid_dimensions', CASE WHEN name IS NULL THEN 'd/../../' || doc_id WHEN name = 'same.png' THEN 'd/../same.png' ELSE './d/../' || name END, 1 FROM i WHERE width = 0
""")
def coco_violations(spark, d):
    with written(spark, d) as parts:
        return materialize(coco.violations(parts).drop("path"))
