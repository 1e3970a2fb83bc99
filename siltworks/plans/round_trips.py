"""Writers and readers over the driver's tables: what was written is read back, and the files are removed."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import inventory
from ..session import delete_path, materialize, shared_folder, table
from ..sources import annotations, archives, exports, sinks
from .registry import BOXES, SPLIT, docs_split, line_boxes, query, split_of


@contextmanager
def folder(spark, name):
    path = shared_folder(spark, name)
    try:
        yield path
    finally:
        delete_path(spark, path)


@query("SELECT doc_id, lang, n_chars FROM documents")
def manifest_round_trip(spark, d):
    with folder(spark, "manifest") as path:
        sinks.manifest(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path)
        return materialize(annotations.jsonl(spark, path, "doc_id long, lang string, n_chars long"))


@query("""
    SELECT doc_id::VARCHAR AS image, source, CASE WHEN n_chars < 300 THEN '' WHEN quality = 1 THEN 'approve' WHEN quality = 0 THEN 'exclude' WHEN lang = 'de' THEN 'repair' ELSE '' END AS action,
        CASE WHEN n_chars >= 300 AND toxic = 1 THEN 'toxic' WHEN n_chars < 1000 AND lang = 'en' THEN 'short; english' WHEN n_chars < 1000 THEN 'short' WHEN lang = 'en' THEN 'english' ELSE '' END AS notes
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def review_round_trip(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    action = F.when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "exclude").when(F.col("lang") == "de", "repair")
    issues = F.filter(F.array(F.when(F.col("n_chars") < 1000, "short"), F.when(F.col("lang") == "en", "english")), lambda x: x.isNotNull())
    records = rows.select(F.col("doc_id").cast("string").alias("image"), "source", action.alias("action"), F.when(F.col("toxic") == 1, "toxic").alias("notes"), (F.col("n_chars") < 300).alias("stale"), issues.alias("issues"))
    with folder(spark, "reviews") as path:
        sinks.review_queue(records, path)
        return materialize(annotations.reviews(spark, path).select("image", "source", "action", "notes"))


@query("SELECT c_custkey::VARCHAR AS key, c_nationkey::VARCHAR AS nation, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey::VARCHAR, NULL, s_name FROM supplier")
def union_round_trip(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    with folder(spark, "union") as path:
        columns = sinks.union_csv([a, b], path)
        return materialize(spark.read.option("header", True).csv(path).select(*columns))


@query(f"""
    WITH r AS (SELECT *, {SPLIT} AS split FROM documents)
    SELECT split, doc_id::VARCHAR AS stem, source, (n_chars % 2)::INTEGER AS cid, round(greatest(0, 0.5 - n_chars / 50000.0::DOUBLE), 9) AS x1, round(least(1, 0.5 + n_chars / 50000.0::DOUBLE), 9) AS x2, sha256(coalesce(text, '')) AS sha256 FROM r
""")
def export_round_trip(spark, d):
    docs = docs_split(spark, d).withColumn("stem", F.col("doc_id").cast("string"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("split", "stem", F.lit(".txt").alias("suffix"), "source", F.col("stem").alias("group"), F.lit("approved").alias("status"), content.alias("content"), F.sha2(content, 256).alias("image_sha256"))
    # wide boxes reach past their image; a share over 1 is cut when the export is read
    wide = F.least(F.lit(1.0), F.col("n_chars") / 25000)
    boxes = docs.select("split", "stem", F.lit(1).alias("line"), (F.col("n_chars") % 2).cast("int").alias("cid"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.greatest(wide, F.lit(1e-9)).alias("w"), F.lit(0.5).alias("h"))
    with folder(spark, "export") as path:
        exports.export_dataset(rows, boxes, path, ["even", "odd"], "reviewed")
        manifest, images, labels, names, _ = exports.read_export(spark, path)
        found = inventory.inventory(manifest, images.select("split", "stem", F.lit("p").alias("path"), F.lit(1).alias("width"), F.lit(1).alias("height"), "sha256"), labels, len(names))
        box = F.col("targets")[0]
        return materialize(found.select("split", "stem", "source", box["cid"].alias("cid"), F.round(box["x1"], 9).alias("x1"), F.round(box["x2"], 9).alias("x2"), "sha256"))


@query(f"""
    WITH t AS ({BOXES}) SELECT l_orderkey::VARCHAR AS name, 'c' || l_linenumber AS label, round(round(x1 / 2 * 1000, 6) / 1000, 6) AS x1, round(round(y2 / 2 * 800, 6) / 800, 6) AS y2 FROM t
    WHERE round(x1 / 2 * 1000, 6) >= 0 AND round(y1 / 2 * 800, 6) >= 0 AND round(x2 / 2 * 1000, 6) <= 1000 AND round(y2 / 2 * 800, 6) <= 800 AND x1 < x2 AND y1 < y2
""")
def exchange_round_trip(spark, d):
    half = [(F.col(c) / 2).alias(c) for c in ("x1", "y1", "x2", "y2")]
    boxes = line_boxes(spark, d).select(F.col("l_orderkey").cast("string").alias("name"), F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("label"), *half).alias("box"))
    images = boxes.groupBy("name").agg(F.collect_list("box").alias("boxes")).select("name", F.lit(1000).alias("width"), F.lit(800).alias("height"), "boxes")
    with folder(spark, "exchange") as path:
        sinks.exchange_xml(images, path)
        found, _ = annotations.exchange(spark, path, most=1 << 40)
        return materialize(found.select("name", "label", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2")))


@query("SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'pending' END AS state FROM orders")
def versioned_status(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), "o_orderstatus")
    with folder(spark, "status") as path:
        status = exports.Versions(spark, path)
        first = status.replace(jobs.select("job", F.lit("pending").alias("state")), None)
        status.replace(jobs.select("job", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("pending").alias("state")), first)
        return materialize(status.read()[0])


@query(f"SELECT {SPLIT} AS split, doc_id::VARCHAR AS stem, strlen(text) AS bytes, sha256(text) AS sha256, quality::VARCHAR AS label FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL")
def package_round_trip(spark, d):
    """Texts as images beside their labels in packages of archives, read back by ranges of members and paired."""
    key = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    texts = docs.select(F.concat(split_of(F.col("doc_id")), F.lit("/images/"), key, F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("sha256"))
    # only ids meet: a split follows from its id
    known = table(spark, d, "labels").where("quality IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    labels = known.select(F.concat(split_of(F.col("doc_id")), F.lit("/labels/"), key, F.lit(".txt")).alias("name"), F.col("quality").cast("string").cast("binary").alias("content"))
    with folder(spark, "package") as path:
        archives.write_package(texts.unionByName(labels.withColumn("sha256", F.sha2("content", 256))), path)
        found = archives.paired(archives.members(spark, path))
        return materialize(found.select("split", "stem", F.octet_length("image").cast("long").alias("bytes"), F.sha2("image", 256).alias("sha256"), "label"))
