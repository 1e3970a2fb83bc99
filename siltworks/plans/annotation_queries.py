"""Label texts, boxes and polygons over the driver's tables: order lines are the boxes of an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import inventory, quality_gates
from ..sources import annotations, exports
from ..session import table
from .registry import BOXES, line_boxes, query

#: Label lines of an order: a class, a centre box with some values out of range, and after every third line a blank one.
LINES = """SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS cid, l_quantity / 50 AS cx, l_discount * 10 AS cy, l_tax * 5 AS w, l_discount * 4 AS h,
    CASE WHEN l_linenumber >= 7 THEN 'class' WHEN l_quantity / 50 > 1 OR l_discount * 10 > 1 OR l_tax * 5 > 1 OR l_discount * 4 > 1 THEN 'range' WHEN l_tax * 5 <= 0 OR l_discount * 4 <= 0 THEN 'area'
        WHEN l_quantity / 50 - l_tax * 5 / 2 < -1e-6 OR l_discount * 10 - l_discount * 4 / 2 < -1e-6 OR l_quantity / 50 + l_tax * 5 / 2 > 1 + 1e-6 OR l_discount * 10 + l_discount * 4 / 2 > 1 + 1e-6 THEN 'box outside image' END AS problem
    FROM lineitem"""


def label_texts(spark, d):
    """(path, text): the label file of every order."""
    number = lambda x: x.cast("string")
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), number(F.col("l_quantity") / 50), number(F.col("l_discount") * 10), number(F.col("l_tax") * 5), number(F.col("l_discount") * 4))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey"), line.alias("line")))).alias("lines"))
    return rows.select("path", F.array_join(F.transform("lines", lambda x: F.when(x["l_linenumber"] % 3 == 0, F.concat(x["line"], F.lit("\n  "))).otherwise(x["line"])), "\n").alias("text"))


@query(f"""
    WITH t AS ({LINES})
    SELECT l_orderkey AS path, coalesce(problem, 'valid') AS problem, count(*) AS lines, round(sum(CASE WHEN problem IS NULL THEN cx - w / 2 END), 6) AS x1, round(sum(CASE WHEN problem IS NULL THEN cy + h / 2 END), 6) AS y2,
        sum(CASE WHEN problem IS NULL THEN cid::INTEGER END)::BIGINT AS cids FROM t GROUP BY ALL
""")
def label_text_scan(spark, d):
    lines = annotations.label_lines(label_texts(spark, d), 7)
    return lines.groupBy("path", F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("lines"), F.round(F.sum("x1"), 6).alias("x1"), F.round(F.sum("y2"), 6).alias("y2"), F.sum("cid").alias("cids"))


@query(f"""
    WITH t AS ({LINES}), c AS (SELECT *, 'c' || cid::INTEGER AS source_class, CASE cid::INTEGER WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'a' WHEN 4 THEN 'x' END AS target FROM t),
    i AS (SELECT l_orderkey, CASE WHEN problem IS NOT NULL THEN 'invalid:' || problem WHEN coalesce(target, '') NOT IN ('a', 'b') THEN 'unmapped_class:' || source_class END AS issue, problem IS NULL AS kept,
        row_number() OVER (PARTITION BY l_orderkey, cid, cx, cy, w, h, problem IS NULL ORDER BY l_linenumber) > 1 AND problem IS NULL AS again, target FROM c)
    SELECT l_orderkey AS path, string_agg(DISTINCT issue, ';' ORDER BY issue) AS issues, count(*) FILTER (WHERE kept AND NOT again) AS boxes, count(*) FILTER (WHERE again) AS duplicates,
        count(*) FILTER (WHERE kept AND NOT again AND target = 'a') AS mapped FROM i GROUP BY ALL
""")
def normalised_labels(spark, d):
    found = annotations.normalised_annotations(label_texts(spark, d), [f"c{i}" for i in range(7)], {"c1": "a", "c2": "b", "c3": "a", "c4": "x"}, ["a", "b"])
    issues = F.nullif(F.array_join("issues", ";"), F.lit(""))
    return found.select("path", issues.alias("issues"), F.size("annotations").cast("long").alias("boxes"), F.col("duplicates").cast("long").alias("duplicates"), F.size(F.filter("annotations", lambda a: a["target_id"] == 0)).cast("long").alias("mapped"))


def vector(i):
    return f"((embedding[{i}]::DOUBLE + 1) / 2)"


@query(f"""
    WITH p AS (SELECT vec_id, [{", ".join(vector(i) for i in range(1, 9))}] AS xy FROM embeddings)
    SELECT vec_id, round(abs(xy[1] * xy[4] - xy[3] * xy[2] + xy[3] * xy[6] - xy[5] * xy[4] + xy[5] * xy[8] - xy[7] * xy[6] + xy[7] * xy[2] - xy[1] * xy[8]) / 2, 9) AS area,
        round(least(xy[1], xy[3], xy[5], xy[7]), 9) AS x1, round(least(xy[2], xy[4], xy[6], xy[8]), 9) AS y1, round(greatest(xy[1], xy[3], xy[5], xy[7]), 9) AS x2, round(greatest(xy[2], xy[4], xy[6], xy[8]), 9) AS y2
    FROM p
""")
def polygon_areas(spark, d):
    xy = F.transform(F.slice("embedding", 1, 8), lambda x: (x.cast("double") + 1) / 2)
    rows = table(spark, d, "embeddings").select("vec_id", xy.alias("xy"))
    bounds = geometry.polygon_bounds(F.col("xy"))
    return rows.select("vec_id", F.round(geometry.polygon_area(F.col("xy")), 9).alias("area"), *[F.round(b, 9).alias(n) for b, n in zip(bounds, ("x1", "y1", "x2", "y2"))])


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 8 / 2 AS x1, l_tax * 5 / 2 AS y1, l_discount * 8 / 2 + l_quantity / 100 AS x2, l_tax * 5 / 2 + l_quantity / 200 AS y2, 640 + l_linenumber AS w, 480 - l_linenumber AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, greatest(0, floor(x1 * w))::BIGINT AS left, greatest(0, floor(y1 * h))::BIGINT AS top, least(w, ceil(x2 * w))::BIGINT AS right, least(h, ceil(y2 * h))::BIGINT AS bottom,
        (floor(x1 * 100) - floor((floor(x2 * 100) - floor(x1 * 100)) * 0.25::DOUBLE + 0.5))::BIGINT AS crop_left, round(least(320.0::DOUBLE / w, 320.0::DOUBLE / h), 9) AS ratio,
        round_even(w * least(320.0::DOUBLE / w, 320.0::DOUBLE / h), 0)::BIGINT AS scaled, round(1 - y2, 9) AS turned, round(1 - x2, 9) AS flipped,
        round(greatest(0, least(1, x1 / 2)), 9) AS share FROM b
""")
def box_transforms(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 8 / 2).alias("x1"), (F.col("l_tax") * 5 / 2).alias("y1"), (F.col("l_discount") * 8 / 2 + F.col("l_quantity") / 100).alias("x2"),
        (F.col("l_tax") * 5 / 2 + F.col("l_quantity") / 200).alias("y2"), (640 + F.col("l_linenumber")).alias("w"), (480 - F.col("l_linenumber")).alias("h"),
    )
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    left, top, right, bottom = geometry.pixel_box(box, F.col("w"), F.col("h"))
    hundredths = [F.floor(c * 100) for c in box]
    ratio, scaled, _ = geometry.letterbox(F.col("w"), F.col("h"), 320)
    return rows.select(
        "l_orderkey", "l_linenumber", left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), geometry.crop_window(hundredths, F.lit(0.25))[0].cast("long").alias("crop_left"),
        F.round(ratio, 9).alias("ratio"), scaled.alias("scaled"), F.round(geometry.turned(*box)[0], 9).alias("turned"), F.round(geometry.flipped(*box)[0], 9).alias("flipped"),
        F.round(geometry.normalise(box, F.lit(2.0), F.lit(2.0))[0], 9).alias("share"),
    )


@query(f"""
    WITH t AS ({BOXES}), a AS (SELECT *, cos(radians(l_linenumber * 10)) AS c, sin(radians(l_linenumber * 10)) AS s FROM t),
    p AS (SELECT l_orderkey, l_linenumber, [0.5 + (x1 - 0.5) * c + (y1 - 0.5) * s, 0.5 + (x1 - 0.5) * c + (y2 - 0.5) * s, 0.5 + (x2 - 0.5) * c + (y1 - 0.5) * s, 0.5 + (x2 - 0.5) * c + (y2 - 0.5) * s] AS x,
        [0.5 - (x1 - 0.5) * s + (y1 - 0.5) * c, 0.5 - (x1 - 0.5) * s + (y2 - 0.5) * c, 0.5 - (x2 - 0.5) * s + (y1 - 0.5) * c, 0.5 - (x2 - 0.5) * s + (y2 - 0.5) * c] AS y FROM a)
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, list_min(x))), 6) AS x1, round(greatest(0, least(1, list_min(y))), 6) AS y1, round(greatest(0, least(1, list_max(x))), 6) AS x2, round(greatest(0, least(1, list_max(y))), 6) AS y2 FROM p
""")
def rotated_boxes(spark, d):
    box = geometry.rotated([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("l_linenumber") * 10)
    return line_boxes(spark, d).select("l_orderkey", "l_linenumber", *[F.round(b, 6).alias(n) for b, n in zip(box, ("x1", "y1", "x2", "y2"))])


@query(f"WITH t AS ({BOXES}) SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'nonfinite' WHEN l_linenumber >= 7 THEN 'class' WHEN x1 * 1.5 - 0.1 NOT BETWEEN 0 AND 1 THEN 'confidence' WHEN x1 > 1 OR y1 > 1 OR x2 > 1 OR y2 > 1 OR x1 < 0 OR y1 < 0 THEN 'box' ELSE 'valid' END AS problem, count(*) AS n FROM t GROUP BY ALL")
def prediction_gate(spark, d):
    t = line_boxes(spark, d)
    conf = F.when(F.col("l_orderkey") % 97 == 0, float("nan")).otherwise(F.col("x1") * 1.5 - 0.1)
    problem = quality_gates.prediction_problem(F.col("l_linenumber"), conf, [F.col(c) for c in ("x1", "y1", "x2", "y2")], 7)
    return t.groupBy(F.coalesce(problem, F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (WHERE least(l_quantity, l_tax * 100) < 2) AS under_2, count(*) FILTER (WHERE least(l_quantity, l_tax * 100) < 4) AS under_4 FROM lineitem GROUP BY ALL")
def resize_risk(spark, d):
    return inventory.resize_risk(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity"), F.col("l_tax") * 100)


@query("SELECT least(l_quantity, l_discount * 100) < 8 AS skipped, count(*) AS n, sum(l_quantity) AS side, min(CASE WHEN least(l_quantity, l_discount * 100) < 8 THEN 'smaller than 8' END) AS reason FROM lineitem GROUP BY ALL")
def min_side_filter(spark, d):
    kept, skipped = inventory.by_side(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount") * 100, 8)
    count = lambda df, flag: df.agg(F.lit(flag).alias("skipped"), F.count("*").alias("n"), F.sum("l_quantity").alias("side"), F.min("reason").alias("reason"))
    return count(kept, False).unionByName(count(skipped, True))


@query("SELECT 1 + max(l_linenumber) AS classes FROM lineitem")
def class_count(spark, d):
    return inventory.class_count(annotations.label_lines(label_texts(spark, d), 1 << 30), "fields")


@query(f"""
    WITH p AS (SELECT vec_id, [{", ".join(vector(i) for i in range(1, 9))}] AS xy FROM embeddings),
    b AS (SELECT vec_id, least(xy[1], xy[3], xy[5], xy[7]) AS x1, least(xy[2], xy[4], xy[6], xy[8]) AS y1, greatest(xy[1], xy[3], xy[5], xy[7]) AS x2, greatest(xy[2], xy[4], xy[6], xy[8]) AS y2 FROM p)
    SELECT vec_id AS path, printf('0 %.10g %.10g %.10g %.10g', (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1) AS text, 0::BIGINT AS boxes, 1 AS polygons FROM b
""")
def reimported_labels(spark, d):
    xy = F.transform(F.slice("embedding", 1, 8), lambda x: ((x.cast("double") + 1) / 2).cast("string"))
    texts = table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.concat(F.lit("0 "), F.array_join(xy, " ")).alias("text"))
    return exports.converted_labels(texts, 1).withColumn("polygons", F.size("polygons"))
