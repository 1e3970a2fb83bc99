"""Placement proposals over orders: an order is an image, its lines are boxes, nations are candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import placement
from ..session import table
from .registry import query

#: The attempts of all proposals beside each other; SQL makes them all and keeps the first that is free.
PROPOSALS = """
    WITH r AS (SELECT o_orderpriority AS subset, o_orderkey::VARCHAR AS stem, 480 + o_orderkey % 160 AS width, 360 + o_orderkey % 120 AS height,
            row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey::VARCHAR) - 1 AS place, count(*) OVER (PARTITION BY o_orderpriority) AS of FROM orders),
    l AS (SELECT l_orderkey::VARCHAR AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS line, l_discount * 8 AS x1, l_tax * 10 AS y1, l_quantity / 200 AS side FROM lineitem),
    b AS (SELECT subset, stem, line, line % 3 AS cid, x1, y1, least(1, x1 + side) AS x2, least(1, y1 + side) AS y2 FROM l JOIN r USING (stem)),
    e AS (SELECT *, row_number() OVER (PARTITION BY subset, cid ORDER BY stem, line) - 1 AS place, count(*) OVER (PARTITION BY subset, cid) AS of FROM b),
    c AS (SELECT subset, 'c' || n_nationkey AS id, n_nationkey % 3 AS cid, (n_nationkey % 5) / 10 AS margin, n_nationkey % 2 = 0 AS canonical, row_number() OVER (PARTITION BY subset ORDER BY 'c' || n_nationkey) - 1 AS turn, count(*) OVER (PARTITION BY subset) AS turns FROM nation, (SELECT DISTINCT subset FROM r)),
    w AS (SELECT subset, unnest(range(0, 1 + count(*) // 100)) AS i FROM r GROUP BY subset),
    p AS (SELECT w.subset, w.i, c.id, c.cid, margin, canonical, unnest(range(0, 500)) AS t FROM w JOIN c ON c.subset = w.subset AND c.turn = w.i % c.turns),
    u AS (SELECT *, concat('7:', subset, ':', i, ':', t, ':') AS k FROM p),
    n AS (SELECT *, ('0x' || md5(k || 'background')[1:8])::BIGINT / 4294967296.0::DOUBLE AS ub, ('0x' || md5(k || 'exemplar')[1:8])::BIGINT / 4294967296.0::DOUBLE AS ue,
                 ('0x' || md5(k || 'x')[1:8])::BIGINT / 4294967296.0::DOUBLE AS ux, ('0x' || md5(k || 'y')[1:8])::BIGINT / 4294967296.0::DOUBLE AS uy FROM u),
    f AS (SELECT subset, cid, any_value(of) AS of FROM e GROUP BY ALL), g AS (SELECT subset, any_value(of) AS of FROM r GROUP BY ALL),
    d AS (SELECT n.*, r.stem, r.width, r.height, e.x2 - e.x1 AS sw, e.y2 - e.y1 AS sh FROM n JOIN g USING (subset) JOIN f ON f.subset = n.subset AND f.cid = n.cid
          JOIN r ON r.subset = n.subset AND r.place = floor(ub * g.of)::BIGINT JOIN e ON e.subset = n.subset AND e.cid = n.cid AND e.place = floor(ue * f.of)::BIGINT),
    s AS (SELECT *, greatest(8, least(width - 4, round_even(sw * width, 0)))::BIGINT AS w0, greatest(8, least(height - 4, round_even(sh * height, 0)))::BIGINT AS h0 FROM d),
    m AS (SELECT *, floor(w0 * margin + 0.5)::BIGINT AS px0, floor(h0 * margin + 0.5)::BIGINT AS py0 FROM s),
    m1 AS (SELECT *, CASE WHEN w0 + 2 * px0 > width - 4 THEN width - 4 - 2 * px0 ELSE w0 END AS w, CASE WHEN h0 + 2 * py0 > height - 4 THEN height - 4 - 2 * py0 ELSE h0 END AS h FROM m),
    m2 AS (SELECT *, CASE WHEN w <> w0 THEN floor(w * margin + 0.5)::BIGINT ELSE px0 END AS px, CASE WHEN h <> h0 THEN floor(h * margin + 0.5)::BIGINT ELSE py0 END AS py FROM m1),
    m3 AS (SELECT *, w + 2 * px AS rw, h + 2 * py AS rh FROM m2),
    m4 AS (SELECT *, 2 + floor(ux * greatest(width - rw - 3, 1))::BIGINT AS x, 2 + floor(uy * greatest(height - rh - 3, 1))::BIGINT AS y FROM m3),
    ok AS (SELECT * FROM m4 WHERE x + rw < width AND y + rh < height),
    hit AS (SELECT DISTINCT ok.subset, i, t FROM ok JOIN b ON b.subset = ok.subset AND b.stem = ok.stem
            WHERE least((x + rw) / width, b.x2) > greatest(x / width, b.x1) AND least((y + rh) / height, b.y2) > greatest(y / height, b.y1)),
    first AS (SELECT * FROM ok ANTI JOIN hit USING (subset, i, t) QUALIFY row_number() OVER (PARTITION BY subset, i ORDER BY t) = 1)
    SELECT subset, printf('blend_%06d', i) AS id, stem AS background_stem, id AS candidate_id, concat_ws(',', x, y, rw, rh) AS rectangle, concat_ws(',', x + px, y + py, w, h) AS core, canonical AND h > w AS quarter_turn FROM first
"""


@query(PROPOSALS)
def blend_proposals(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("subset"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("stem"))
    records = orders.select("subset", "stem", F.md5("stem").alias("sha256"), (480 + F.col("key") % 160).alias("width"), (360 + F.col("key") % 120).alias("height"))
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x, y, side = F.col("l_discount") * 8, F.col("l_tax") * 10, F.col("l_quantity") / 200
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("stem"), F.row_number().over(by).alias("line"), x.alias("x1"), y.alias("y1"), F.least(F.lit(1.0), x + side).alias("x2"), F.least(F.lit(1.0), y + side).alias("y2"))
    boxes = lines.join(records.select("subset", "stem"), "stem").withColumn("cid", (F.col("line") % 3).cast("int"))
    subsets = orders.groupBy("subset").agg((1 + F.floor(F.count("*") / 100)).alias("n"))
    nations = F.col("n_nationkey")
    some = table(spark, d, "nation").select(F.concat(F.lit("c"), nations).alias("id"), (nations % 3).cast("int").alias("cid"), ((nations % 5) / 10).alias("margin"), (nations % 2 == 0).alias("canonical"))
    candidates = subsets.select("subset").crossJoin(F.broadcast(some))  # a few rows on both sides
    found = placement.propose(records, boxes, candidates, subsets, seed=7)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return found.select("subset", "id", "background_stem", "candidate_id", text("rectangle_xywh").alias("rectangle"), text("core_box_xywh").alias("core"), "quarter_turn")
