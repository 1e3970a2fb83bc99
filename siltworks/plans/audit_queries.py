"""Audits of images and their labels: inventories, common values, shapes, measures of pixels, samples to look at."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images, names
from ..operators import image_audit, inventory, models, screening
from ..session import table
from ..sources import annotations
from .registry import SPLIT, query, rounded, split_of


@query(f"""
    WITH i AS (SELECT {SPLIT} AS split, doc_id::VARCHAR AS stem, n_chars < 60 AS corrupt FROM documents WHERE lang <> 'de' OR {SPLIT} <> 'val'),
    l AS (SELECT {SPLIT} AS split, CASE WHEN quality = 0 AND doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS stem, CASE WHEN toxic = 1 THEN chr(10) || ' ' ELSE quality::VARCHAR END AS text FROM labels),
    s AS (SELECT unnest(['train', 'val', 'test', 'extra']) AS split),
    c AS (SELECT s.split, (SELECT count(*) FROM i WHERE i.split = s.split) AS images, (SELECT count(*) FROM l WHERE l.split = s.split) AS labels, (SELECT count(*) FROM l WHERE l.split = s.split AND trim(text, ' ' || chr(10)) = '') AS empty_labels,
        (SELECT count(*) FROM i WHERE i.split = s.split AND NOT EXISTS (FROM l WHERE l.split = i.split AND l.stem = i.stem)) AS orphan_images, (SELECT count(*) FROM l WHERE l.split = s.split AND NOT EXISTS (FROM i WHERE l.split = i.split AND l.stem = i.stem)) AS orphan_labels,
        (SELECT count(*) FROM i WHERE i.split = s.split AND corrupt) AS corrupt_images FROM s)
    SELECT split, CASE WHEN images > 0 THEN images END AS images, CASE WHEN images > 0 THEN labels END AS labels, CASE WHEN images > 0 THEN empty_labels END AS empty_labels, CASE WHEN images > 0 THEN orphan_images END AS orphan_images,
        CASE WHEN images > 0 THEN orphan_labels END AS orphan_labels, CASE WHEN images > 0 THEN corrupt_images END AS corrupt_images, images = 0 AS missing FROM c
""")
def split_inventory(spark, d):
    docs = table(spark, d, "documents").withColumn("split", split_of(F.col("doc_id"))).where("lang <> 'de' OR split <> 'val'")
    rows = docs.select("split", F.col("doc_id").cast("string").alias("stem"), (F.col("n_chars") < 60).alias("corrupt"))
    stem = F.concat(F.when((F.col("quality") == 0) & (F.col("doc_id") % 3 == 0), "x").otherwise(""), F.col("doc_id").cast("string"))
    labels = table(spark, d, "labels").select(split_of(F.col("doc_id")).alias("split"), stem.alias("stem"), F.when(F.col("toxic") == 1, "\n ").otherwise(F.col("quality").cast("string")).alias("text"))
    return image_audit.split_inventory(rows, labels, ("train", "val", "test", "extra"))


@query("""
    WITH v AS (SELECT doc_id, source, unnest([{'what': 'size', 'value': n_chars // 100 || 'x' || n_chars % 3}, {'what': 'suffix', 'value': '.' || lang}], recursive := true) FROM documents),
    c AS (SELECT source, what, value, count(*) AS n, min(doc_id) AS first FROM v GROUP BY ALL)
    SELECT source, what, value, n FROM c QUALIFY row_number() OVER (PARTITION BY source, what ORDER BY n DESC, first, value) <= 5
""")
def common_values(spark, d):
    """The five commonest sizes and suffixes of every source."""
    docs = table(spark, d, "documents")
    size = F.concat_ws("x", F.floor(F.col("n_chars") / 100).cast("string"), (F.col("n_chars") % 3).cast("string"))
    kind = names.suffix(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")))
    both = F.inline(F.array(F.struct(F.lit("size").alias("what"), size.alias("value")), F.struct(F.lit("suffix").alias("what"), kind.alias("value"))))
    return image_audit.most_common(docs.select("doc_id", "source", both), ["source", "what"], "value", "doc_id")


@query("""
    WITH a AS (SELECT l_linestatus, l_quantity / (l_tax * 100) AS r FROM lineitem WHERE l_tax > 0 AND l_returnflag <> 'R')
    SELECT m.l_linestatus, round(coalesce(min(r), 1), 9) AS p0, round(coalesce(quantile_cont(r, 0.25), 1), 9) AS p25, round(coalesce(quantile_cont(r, 0.5), 1), 9) AS p50, round(coalesce(quantile_cont(r, 0.75), 1), 9) AS p75, round(coalesce(max(r), 1), 9) AS p100
    FROM (SELECT DISTINCT l_linestatus FROM lineitem) m LEFT JOIN a USING (l_linestatus) GROUP BY 1
""")
def aspect_quantiles(spark, d):
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_quantity", (F.col("l_tax") * 100).alias("high"), (F.col("l_returnflag") == "R").alias("corrupt"))
    return rounded(image_audit.aspect_quantiles(rows, ["l_linestatus"], "l_quantity", "high", F.col("corrupt")), "p0", "p25", "p50", "p75", "p100")


def drawn(spark, d):
    """Documents as images of 4 x 4 pixels, whose bytes are digests of the whole text; French ones have no colours, the shortest can't be read."""
    text = F.coalesce("text", F.lit(""))
    plain = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.repeat(F.substring(F.md5(text), 2 * i + 1, F.lit(2)), F.lit(3))), "")
    code = F.when(F.col("lang") == "fr", plain).otherwise(F.concat(F.sha2(text, 256), F.md5(text)))
    side = F.when(F.col("n_chars") < 60, -1).otherwise(4)
    return table(spark, d, "documents").select("doc_id", "source", side.alias("height"), side.alias("width"), F.lit(3).alias("channels"), F.unhex(code).alias("data"))


PIXELS = """
    t AS (SELECT doc_id, source, n_chars, CASE WHEN lang = 'fr' THEN list_transform(range(0, 48), lambda i: substr(md5(coalesce(text, '')), 2 * (i // 3)::INTEGER + 1, 2)) ELSE list_transform(range(0, 48), lambda i: substr(sha256(coalesce(text, '')) || md5(coalesce(text, '')), 2 * i::INTEGER + 1, 2)) END AS h FROM documents),
    p AS (SELECT doc_id, source, n_chars, h, list_transform(h, lambda x: ('0x' || x)::INTEGER) AS p FROM t)
"""


@query(f"""
    WITH {PIXELS}, g AS (SELECT doc_id, h, p, list_transform(range(0, 16), lambda i: 0.114::DOUBLE * p[3 * i + 1] + 0.587::DOUBLE * p[3 * i + 2] + 0.299::DOUBLE * p[3 * i + 3]) AS g FROM p WHERE n_chars >= 60),
    l AS (SELECT doc_id, h, p, g, list_transform(range(0, 16), lambda i: g[4 * ((i // 4 + 3) % 4) + i % 4 + 1] + g[4 * ((i // 4 + 1) % 4) + i % 4 + 1] + g[4 * (i // 4) + (i % 4 + 3) % 4 + 1] + g[4 * (i // 4) + (i % 4 + 1) % 4 + 1]) AS w,
        list_transform(range(0, 16), lambda i: g[4 * abs(i // 4 - 1) + i % 4 + 1] + g[4 * (3 - abs(2 - i // 4)) + i % 4 + 1] + g[4 * (i // 4) + abs(i % 4 - 1) + 1] + g[4 * (i // 4) + 3 - abs(2 - i % 4) + 1]) AS r FROM g)
    SELECT doc_id, round(sqrt(list_var_pop(list_transform(range(1, 17), lambda i: w[i] - 4 * g[i]))), 6) AS sharpness_root, round(sqrt(list_var_pop(list_transform(range(1, 17), lambda i: r[i] - 4 * g[i]))), 6) AS edge_sharpness_root,
        round(list_median(list_transform(range(1, 17), lambda i: abs(g[i] - (w[i] + g[i]) / 5))), 6) AS noise, round(list_stddev_pop(g), 6) AS contrast, list_bool_and(list_transform(range(0, 16), lambda i: p[3 * i + 1] = p[3 * i + 2] AND p[3 * i + 1] = p[3 * i + 3])) AS grayscale,
        sha256(encode('4x4') || from_hex(array_to_string(h, ''))) AS pixels FROM l
    UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, sha256(encode('-1x-1') || from_hex(array_to_string(h, ''))) FROM p WHERE n_chars < 60
""")
def image_measures(spark, d):
    """Two sharpnesses (as roots, which no rounding splits), noise, contrast, absence of colours and the pixel hash of every image."""
    rows, args = drawn(spark, d), ("height", "width", "channels", "data")
    found = {"sharpness_root": F.sqrt(images.sharpness_of(*args)), "edge_sharpness_root": F.sqrt(images.edge_sharpness_of(*args)), "noise": images.noise_of(*args), "contrast": images.contrast_of(*args)}
    return rows.select("doc_id", *[F.round(f, 6).alias(n) for n, f in found.items()], images.grayscale_of(*args).alias("grayscale"), images.pixel_hash(F.col("height"), F.col("width"), F.col("data")).alias("pixels"))


@query(f"WITH {PIXELS} SELECT source, count(*) FILTER (WHERE n_chars >= 60) AS readable, round(count(*) FILTER (WHERE n_chars >= 60 AND list_bool_and(list_transform(range(0, 16), lambda i: p[3 * i + 1] = p[3 * i + 2] AND p[3 * i + 1] = p[3 * i + 3]))) / greatest(count(*) FILTER (WHERE n_chars >= 60), 1), 9) AS share FROM p GROUP BY 1")
def grayscale_share(spark, d):
    rows = drawn(spark, d).withColumn("grayscale", images.grayscale_of("height", "width", "channels", "data"))
    return rounded(image_audit.grayscale_share(rows, ["source"], F.col("grayscale"), F.col("height") < 0), "share")


@query("""
    WITH k AS (SELECT o_orderkey, o_orderstatus, count(DISTINCT l_returnflag) AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25 GROUP BY ALL)
    SELECT o_orderstatus, CASE WHEN k >= 3 THEN '3+' ELSE k::VARCHAR END AS bucket, count(*) AS images FROM k GROUP BY ALL
""")
def class_buckets(spark, d):
    boxes = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return image_audit.class_buckets(table(spark, d, "orders"), boxes, "o_orderstatus", "o_orderkey", "l_returnflag")


@query("""
    WITH m AS (SELECT l_orderkey AS id, coalesce(nullif(regexp_extract(md5(l_orderkey::VARCHAR), '^[a-f]*'), ''), 'numeric') AS family, l_returnflag AS cls, l_linestatus = 'F' AS polygon, l_quantity::INTEGER AS points FROM lineitem),
    i AS (SELECT id, family, max(points) AS longest, max(CASE WHEN polygon THEN points END) AS points FROM m GROUP BY ALL HAVING bool_or(polygon)),
    c AS (SELECT DISTINCT id, cls FROM m WHERE polygon),
    r AS (SELECT id, cls, row_number() OVER (PARTITION BY cls ORDER BY points, id) - 1 AS spot, count(*) OVER (PARTITION BY cls) AS n FROM c JOIN i USING (id)),
    u AS (SELECT id, 'class:' || cls AS reason FROM r WHERE spot IN (0, n // 4, n // 2, 3 * n // 4, n - 1) UNION (SELECT id, 'family:' || family FROM i QUALIFY row_number() OVER (PARTITION BY family ORDER BY longest DESC, id) = 1))
    SELECT id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY 1
""")
def polygon_sample(spark, d):
    name = F.concat(F.md5(F.col("l_orderkey").cast("string")), F.lit("_png.rf.0a1b.jpg"))
    kind = F.when(F.col("l_linestatus") == "F", "polygon").otherwise("box")
    shapes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), names.digit_family(name).alias("family"), F.col("l_returnflag").alias("cls"), kind.alias("kind"), F.col("l_quantity").cast("int").alias("points"))
    return image_audit.polygon_sample(shapes, "id", "family", ["A", "N", "R"]).select("id", F.array_join("reasons", ",").alias("reasons"))


README = "CASE doc_id % 4 WHEN 0 THEN concat('Set - V', n_chars, ' v2', chr(10), 'Includes ', doc_id, ' images.', chr(10), 'No image augmentation') WHEN 1 THEN concat('no image augmentation', chr(10), 'Pre-processing was applied: ', lang, ' ', chr(10), coalesce(text, '')) WHEN 2 THEN concat('Augmentation was applied to ', coalesce(text, '')) ELSE coalesce(text, '') END"


@query(f"""
    WITH r AS (SELECT doc_id, {README} AS t FROM documents)
    SELECT doc_id, nullif(regexp_extract(t, '- v[0-9]+', 0, 'i'), '') AS version_line, coalesce(nullif(trim(regexp_extract(t, 'augmentation was applied[^\\n]*', 0, 'i')), ''), CASE WHEN regexp_matches(t, 'no image augmentation', 'i') THEN 'none stated' END) AS augmentation,
        nullif(trim(regexp_extract(t, 'pre-processing was applied[^\\n]*', 0, 'i')), '') AS preprocessing, nullif(regexp_extract(t, 'includes ([0-9]+) images', 1, 'i'), '') AS image_count_readme FROM r
""")
def readme_facts(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{README} AS t").select("doc_id", annotations.readme_facts(F.col("t"), F.lit("README.dataset.txt")))
    return rows.select("doc_id", *[F.col("facts")[k].alias(k) for k in ("version_line", "augmentation", "preprocessing", "image_count_readme")])


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity >= 8 GROUP BY ALL),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linenumber ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    c AS (SELECT DISTINCT l_orderkey FROM r WHERE before < 2)
    SELECT l_orderkey FROM c UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (FROM c) ORDER BY o_orderkey LIMIT 200 - (SELECT count(*) FROM c))
""")
def smoke_sample(spark, d):
    """200 orders whose lines have two usable boxes of every class."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return inventory.smoke_sample(orders, table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") >= 8, 200, range(1, 8))


@query("""
    SELECT 'candidates' AS stage, doc_id AS id, source AS path, md5(coalesce(text, '')) AS sha256, NULL AS label, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2 FROM documents
    UNION ALL SELECT 'placements', l_orderkey * 10 + l_linenumber, o_orderstatus, 's' || l_suppkey, 'placement', l_quantity, l_linenumber, l_quantity + 5, l_linenumber + 7 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + 1
    UNION ALL SELECT 'composites', l_orderkey * 10 + l_linenumber, l_returnflag, 's' || l_suppkey, CASE l_linenumber WHEN 1 THEN 'dent' WHEN 2 THEN 'rust' END, l_discount * 640, l_tax * 480, 0.5::DOUBLE * 640, 0.75::DOUBLE * 480 FROM lineitem
""")
def review_items(spark, d):
    """What reviewers are shown at each of the three stages."""
    lines = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("sha256", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("sha256"))
    placed = lines.select("id", (F.col("l_orderkey") + 1).alias("background"), F.col("sha256").alias("background_sha256"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"), F.lit(5).alias("w"), F.lit(7).alias("h"))
    grounds = table(spark, d, "orders").select(F.col("o_orderkey").alias("background"), F.col("o_orderstatus").alias("path"))
    target = F.struct((F.col("l_linenumber") - 1).alias("cid"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("y1"), F.lit(0.5).alias("x2"), F.lit(0.75).alias("y2"))
    made = lines.select("id", F.col("l_returnflag").alias("path"), "sha256", F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(target).alias("targets"))
    found = screening.review_items(docs, "candidates").withColumn("stage", F.lit("candidates"))
    found = found.unionByName(screening.review_items(placed, "placements", backgrounds=grounds).withColumn("stage", F.lit("placements")))
    found = found.unionByName(screening.review_items(made, "composites", ["dent", "rust"]).withColumn("stage", F.lit("composites")))
    return found.select("stage", "id", "path", "sha256", F.explode_outer("boxes").alias("b")).select("stage", "id", "path", "sha256", "b.*")


@query()
def source_predictability(spark, d):
    """How well an embedding's label can be told from it, by five-fold cross-validation."""
    return rounded(models.told(models.predictions(table(spark, d, "embeddings"), "vec_id", "embedding", "label")), "accuracy")
