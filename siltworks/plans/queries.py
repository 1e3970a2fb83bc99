"""Curation and evaluation queries over the driver's tables.

The driver's tables hold no images; each operator runs on an analogue: a
document is an image, its text the file, lang its class, source its camera;
labels are reviews; order lines are boxes; the signs of an embedding are its
perceptual hash. ORACLE_SQL has the same results in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, identity
from ..operators import matching, measures, neardup, quality_gates, selection, statistics, workflow
from ..operators.components import connected_components
from ..session import delete_path, materialize, shared_folder, table
from ..streaming import control
from .registry import BITS, BOXES, ORACLE_SQL, QUERIES, SPLIT, docs_split, hashes, line_boxes, query, rounded  # noqa: F401


@query(f"SELECT {SPLIT} AS split, lang, count(*) AS documents, count(DISTINCT source) AS sources, count(*) FILTER (WHERE n_chars < 200) AS short, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def inventory_by_split(spark, d):
    return docs_split(spark, d).groupBy("split", "lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") < 200).alias("short"), F.sum("n_chars").alias("chars"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.doc_id IS NULL THEN 'orphan_label' ELSE 'paired' END AS state, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def orphans_full_outer(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("l_id"))
    both = a.join(b, a.doc_id == b.l_id, "full_outer")
    return both.groupBy(F.when(F.col("l_id").isNull(), "unlabelled").when(F.col("doc_id").isNull(), "orphan_label").otherwise("paired").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_unlisted(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL")
def left_semi_members(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT 'order' AS violation, l_orderkey::VARCHAR AS key, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL
    UNION ALL SELECT 'supplier', l_suppkey::VARCHAR, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY ALL
    UNION ALL SELECT 'repeated_line', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def referential_gate(spark, d):
    lines = table(spark, d, "lineitem")
    found = quality_gates.dangling(lines, table(spark, d, "orders"), "l_orderkey", "o_orderkey", "order")
    found = found.unionByName(quality_gates.dangling(lines, table(spark, d, "supplier"), "l_suppkey", "s_suppkey", "supplier"))
    return found.unionByName(quality_gates.repeated(lines, ["l_orderkey", "l_linenumber"], "repeated_line"))


STATUS = """CASE WHEN source = 'src3' THEN 'excluded_unmapped' WHEN (quality IS NOT NULL OR lang = 'de' OR (lang = 'fr' AND n_chars < 900)) AND doc_id % 11 = 0 THEN 'quarantine_stale_review' WHEN quality = 0 THEN 'excluded_review'
    WHEN n_chars < 100 THEN 'quarantine_invalid' WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 1 THEN 'quarantine_incomplete_approval' WHEN lang = 'de' THEN 'quarantine_review' WHEN lang = 'fr' AND n_chars < 900 THEN 'quarantine_review'
    WHEN doc_id % 13 = 0 THEN 'quarantine_prior_review' WHEN n_chars = 0 THEN 'quarantine_empty' ELSE 'pending_review' END"""


@query(f"SELECT {STATUS} AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def review_left_join_status(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    no = F.lit(False)
    status = quality_gates.review_status(
        issues=F.col("n_chars") < 100, unmapped=F.coalesce(F.col("source") == "src3", no), stale=F.col("doc_id") % 11 == 0,
        action=F.when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "exclude").when(F.col("lang") == "de", "repair").when((F.col("lang") == "fr") & (F.col("n_chars") < 900), "quarantine"), complete=F.col("toxic") == 0,
        prior=F.col("doc_id") % 13 == 0, empty=F.col("n_chars") == 0, required=True,
    )
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT md5(text) AS h, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT n AS copies, count(*) AS groups, sum(n - 1)::BIGINT AS surplus, count(*) FILTER (WHERE s > 1) AS across FROM g GROUP BY n")
def exact_dup_groups(spark, d):
    g = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    return g.groupBy(F.col("n").alias("copies")).agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("s") > 1).alias("across"))


@query("""
    WITH r AS (SELECT d.doc_id, md5(text) AS h, quality FROM documents d LEFT JOIN labels l USING (doc_id)),
    g AS (SELECT h, count(DISTINCT quality) AS kinds, min(CASE WHEN quality = 1 THEN doc_id END) AS approved, min(doc_id) AS first FROM r GROUP BY h)
    SELECT doc_id, CASE WHEN kinds > 1 THEN 'quarantine_conflicting_labels' WHEN doc_id = coalesce(approved, first) THEN 'canonical' ELSE 'duplicate_exact' END AS status,
           CASE WHEN kinds <= 1 AND doc_id <> coalesce(approved, first) THEN coalesce(approved, first) END AS duplicate_of
    FROM r JOIN g USING (h)
""")
def dup_canonical_conflict(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = rows.groupBy("h").agg(F.count_distinct("quality").alias("kinds"), F.coalesce(F.min(F.when(F.col("quality") == 1, F.col("doc_id"))), F.min("doc_id")).alias("lead"))
    status = F.when(F.col("kinds") > 1, "quarantine_conflicting_labels").when(F.col("doc_id") == F.col("lead"), "canonical").otherwise("duplicate_exact")
    return rows.join(g, "h").select("doc_id", status.alias("status"), F.when((F.col("kinds") <= 1) & (F.col("doc_id") != F.col("lead")), F.col("lead")).alias("duplicate_of"))


PAIRS = f"WITH b AS ({BITS}) SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.bits, y.bits))::INTEGER AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 20"


@query(PAIRS)
def hamming_pairs(spark, d):
    bits = hashes(spark, d)
    return neardup.hamming_join(bits, bits, "vec_id", "bits", 20, ordered=True)


@query(f"WITH b AS ({BITS}) SELECT 'low' AS side, count(*) AS n FROM b x WHERE label < 5 AND EXISTS (FROM b y WHERE y.label >= 5 AND bit_count(xor(x.bits, y.bits)) <= 20) UNION ALL SELECT 'high', count(*) FROM b x WHERE label >= 5 AND EXISTS (FROM b y WHERE y.label < 5 AND bit_count(xor(x.bits, y.bits)) <= 20)")
def hamming_semijoin(spark, d):
    bits = hashes(spark, d)
    low, high = bits.where("label < 5"), bits.where("label >= 5")
    count = lambda a, b, name: neardup.within_reach(a, b, "vec_id", "bits", 20).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count(low, high, "low").unionByName(count(high, low, "high"))


@query(f"WITH b AS ({BITS}), f AS (SELECT *, min(vec_id) OVER (PARTITION BY bits) AS first FROM b), a AS (SELECT * FROM f WHERE vec_id = first) SELECT y.vec_id, min(x.vec_id) AS near FROM a x JOIN a y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.bits, y.bits)) <= 20 GROUP BY 1")
def near_dup_first_match(spark, d):
    rows = neardup.distinct_first(hashes(spark, d), "vec_id", "bits")  # a row equal to an earlier one is not accepted
    return neardup.first_earlier(rows, "vec_id", "bits", 20, accepted=F.col("vec_id") == F.col("first"))


def joined_groups(spark, d) -> DataFrame:
    """(vec_id, component) under hash links and a shared key: the label and a run of 25 ids."""
    bits = hashes(spark, d).withColumn("key", F.concat_ws("/", "label", F.floor(F.col("vec_id") / 25)))
    near = neardup.links(bits, "vec_id", "bits", 20)
    found = connected_components(near.unionByName(neardup.key_edges(bits, "vec_id", ["key"])))
    return bits.join(found.withColumnRenamed("vertex", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))


COMPONENTS = f"""
    WITH RECURSIVE b AS MATERIALIZED ({BITS}),
    p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM b x JOIN b y ON x.vec_id <> y.vec_id
        WHERE bit_count(xor(x.bits, y.bits)) <= 20 OR (x.label = y.label AND x.vec_id // 25 = y.vec_id // 25)),
    r AS (SELECT vec_id, vec_id AS seen FROM b UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.seen = p.a),
    c AS (SELECT vec_id, min(seen) AS component FROM r GROUP BY vec_id)
"""


@query(f"{COMPONENTS} SELECT vec_id, component FROM c")
def components(spark, d):
    return joined_groups(spark, d)


@query(f"{COMPONENTS} SELECT component, count(*) AS members, substr(sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR)), 1, 20) AS group_id FROM c GROUP BY component HAVING count(*) > 1 ORDER BY members DESC, component LIMIT 5")
def cluster_stats(spark, d):
    rows = materialize(joined_groups(spark, d))
    top = rows.groupBy("component").agg(F.count("*").alias("members")).where("members > 1").orderBy(F.desc("members"), "component").limit(5)
    # members are gathered of these five alone: an id is a hash of all of them
    return rows.join(F.broadcast(top), "component").groupBy("component", "members").agg(identity.group_id(F.collect_list(F.col("vec_id").cast("string"))).alias("group_id")).orderBy(F.desc("members"), "component")


CROSSING = f"{COMPONENTS}, s AS (SELECT component, count(*) AS n, count(DISTINCT vec_id % 3) AS splits FROM c GROUP BY 1) SELECT sum(n) FILTER (WHERE n > 1)::BIGINT AS clustered, count(*) FILTER (WHERE n > 1) AS clusters, count(*) FILTER (WHERE n > 1 AND splits > 1) AS crossing FROM s"


@query(CROSSING)
def cluster_crossings(spark, d):
    s = joined_groups(spark, d).groupBy("component").agg(F.count("*").alias("n"), F.count_distinct(F.col("vec_id") % 3).alias("splits"))
    many = F.col("n") > 1
    return s.agg(F.sum(F.when(many, F.col("n"))).alias("clustered"), F.count_if(many).alias("clusters"), F.count_if(many & (F.col("splits") > 1)).alias("crossing"))


@query(f"SELECT 'group_crosses_splits' AS violation, md5(text) AS key, count(*) AS rows FROM (SELECT *, {SPLIT} AS split FROM documents) GROUP BY ALL HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    return quality_gates.crossing(docs_split(spark, d).withColumn("h", F.md5("text")), "h", "split").select("violation", "key", "rows")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, .05), 4) AS p5, round(quantile_cont(l_extendedprice, .25), 4) AS p25, round(quantile_cont(l_extendedprice, .5), 4) AS p50, round(quantile_cont(l_extendedprice, .75), 4) AS p75, round(quantile_cont(l_extendedprice, .95), 4) AS p95 FROM lineitem GROUP BY ALL")
def area_percentiles(spark, d):
    p = statistics.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95])
    return p.select("l_returnflag", *[F.round(c, 4).alias(c) for c in p.columns[1:]])


@query("WITH n AS (SELECT o_orderstatus, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus) SELECT o_orderstatus, round(avg(k), 6) AS mean, max(k) AS most, count(*) FILTER (WHERE k = 0) AS none FROM n GROUP BY ALL")
def boxes_per_image(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    n = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return n.groupBy("o_orderstatus").agg(F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("most"), F.count_if(F.col("k") == 0).alias("none"))


@query("WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '+' ORDER BY l_returnflag || l_linestatus) AS classes, count(DISTINCT l_returnflag || l_linestatus) AS k FROM lineitem GROUP BY 1) SELECT classes, CASE WHEN k >= 3 THEN '3+' ELSE k::VARCHAR END AS bucket, count(*) AS orders FROM s GROUP BY ALL ORDER BY orders DESC, classes LIMIT 5")
def cooccurrence_top(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("c"))
    bucket = F.when(F.size("c") >= 3, "3+").otherwise(F.size("c").cast("string"))
    return s.groupBy(F.array_join("c", "+").alias("classes"), bucket.alias("bucket")).agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "classes").limit(5)


FRACTIONS = [0.05, 0.1, 0.25, 0.5, 1.0]


@query("WITH k AS (SELECT lang, count(DISTINCT md5(text)) AS n FROM documents GROUP BY 1), f AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS fraction) SELECT lang, fraction, round_even(n * 0.7::DOUBLE * fraction, 0)::BIGINT AS expected, CASE WHEN n * 0.7::DOUBLE * fraction < 5 THEN 'FAIL' WHEN n * 0.7::DOUBLE * fraction < 20 THEN 'WARN' ELSE 'OK' END AS verdict FROM k, f")
def planning_matrix(spark, d):
    k = table(spark, d, "documents").groupBy("lang").agg(F.count_distinct(F.md5("text")).alias("n"))
    each = k.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FRACTIONS])))  # a fixed list: no join at all
    size = F.col("n") * F.lit(0.7) * F.col("fraction")
    return each.select("lang", "fraction", F.bround(size).cast("long").alias("expected"), F.when(size < 5, "FAIL").when(size < 20, "WARN").otherwise("OK").alias("verdict"))


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber AS cid, l_quantity / 50 AS cx, l_discount * 10 AS cy, l_tax * 5 AS w, l_discount * 4 AS h FROM lineitem)
    SELECT coalesce(CASE WHEN cid >= 7 THEN 'class' WHEN cx < 0 OR cx > 1 OR cy < 0 OR cy > 1 OR w < 0 OR w > 1 OR h < 0 OR h > 1 THEN 'range' WHEN w <= 0 OR h <= 0 THEN 'area'
        WHEN cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6 THEN 'box outside image' END, 'valid') AS problem, count(*) AS n FROM t GROUP BY ALL
""")
def geometry_validate(spark, d):
    line = F.transform(F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 5, F.col("l_discount") * 4), lambda x: x.cast("string"))
    problem = geometry.label_problem(line, 7)
    return table(spark, d, "lineitem").select(F.coalesce(problem, F.lit("valid")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


SQL_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"""
    WITH t AS ({BOXES}), p AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, {SQL_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
        FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT l_orderkey, a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.3
""")
def iou_pairs(spark, d):
    t = line_boxes(spark, d)
    a, b = t.alias("a"), t.alias("b")
    box = lambda x: [F.col(f"{x}.{c}") for c in ("x1", "y1", "x2", "y2")]
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"), geometry.iou(box("a"), box("b")).alias("iou")).where("iou >= 0.3").withColumn("iou", F.round("iou", 6))


@query(f"WITH t AS ({BOXES}) SELECT l_orderkey, l_linenumber FROM t a WHERE l_linenumber = 1 AND NOT EXISTS (FROM t b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > 1 AND {SQL_IOU} > 0)")
def disjoint_anti(spark, d):
    t = line_boxes(spark, d)
    a, b = t.where("l_linenumber = 1").alias("a"), t.where("l_linenumber > 1").alias("b")
    box = lambda x: [F.col(f"{x}.{c}") for c in ("x1", "y1", "x2", "y2")]
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & ~geometry.disjoint(box("a"), box("b")), "left_anti").select("l_orderkey", "l_linenumber")


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


SQL_RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1"


#: The boxes of an order, numbered, as line numbers repeat; moved a little, so that no two overlaps are equal.
TARGETS = """SELECT l_orderkey, j, j % 3 AS cid, l_discount * 8 + j * 0.003::DOUBLE AS x1, l_tax * 10 + j * j * 0.001::DOUBLE AS y1, l_discount * 8 + j * 0.003::DOUBLE + l_quantity / 100 AS x2, l_tax * 10 + j * j * 0.001::DOUBLE + l_quantity / 100 AS y2
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS j FROM lineitem)"""
GREEDY = """
    WITH RECURSIVE b AS (%s), t AS (SELECT l_orderkey, list({'j': j, 'cid': cid, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY j) AS ts,
        list({'k': j, 'cid': cid, 'x1': x1 + j * 0.01::DOUBLE, 'y1': y1, 'x2': x2 + j * 0.01::DOUBLE, 'y2': y2} ORDER BY j) AS ps FROM b GROUP BY 1),
    r AS (SELECT l_orderkey, 0 AS k, []::BIGINT[] AS used, NULL::BIGINT AS cid, NULL::DOUBLE AS conf, NULL::BIGINT AS hit FROM t
        UNION ALL SELECT l_orderkey, k + 1, CASE WHEN best.over >= 0.5 THEN list_append(used, best.j) ELSE used END, p.cid, 1 / (1 + p.k), CASE WHEN best.over >= 0.5 THEN best.j END
        FROM (SELECT l_orderkey, k, used, ps[k + 1] AS p, %s AS best FROM r JOIN t USING (l_orderkey) WHERE k < len(ps)))
"""
OVER = "greatest(0, least(ps[k + 1].x2, t.x2) - greatest(ps[k + 1].x1, t.x1)) * greatest(0, least(ps[k + 1].y2, t.y2) - greatest(ps[k + 1].y1, t.y1))"
AREAS = "((ps[k + 1].x2 - ps[k + 1].x1) * (ps[k + 1].y2 - ps[k + 1].y1) + (t.x2 - t.x1) * (t.y2 - t.y1))"
#: The best free target: the largest overlap, then the first or the last place.
BEST = "list_max(list_transform(list_filter(ts, lambda t: NOT list_contains(used, t.j) %s), lambda t: {'over': %s / (%s - %s), 'place': %st.j, 'j': t.j}))"


@query(f"""{GREEDY % (TARGETS, BEST % ("", OVER, AREAS, OVER, ""))},
    m AS (SELECT r.l_orderkey, coalesce(b.cid, 3) AS truth, r.cid AS predicted FROM r LEFT JOIN b ON r.l_orderkey = b.l_orderkey AND r.hit = b.j WHERE r.k > 0
        UNION ALL SELECT b.l_orderkey, b.cid, 3 FROM b JOIN (SELECT l_orderkey, arg_max(used, k) AS used FROM r GROUP BY 1) u USING (l_orderkey) WHERE NOT list_contains(u.used, b.j))
    SELECT truth, predicted, count(*) AS n FROM m GROUP BY ALL
""")
def confusion(spark, d):
    predictions, targets = shifted_boxes(spark, d)
    return matching.confusion(predictions, targets, 3).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def shifted_boxes(spark, d):
    """(predictions, targets) of every order: its lines' boxes, and the same moved right, the surest least."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, d, "lineitem").withColumn("j", F.row_number().over(w))
    x, y, side = F.col("l_discount") * 8 + F.col("j") * 0.003, F.col("l_tax") * 10 + F.col("j") * F.col("j") * 0.001, F.col("l_quantity") / 100
    boxes = rows.select(F.col("l_orderkey").cast("string").alias("image"), (F.col("j") % 3).cast("int").alias("cid"), "j", x.alias("x1"), y.alias("y1"), (x + side).alias("x2"), (y + side).alias("y2"))
    predictions = boxes.select("image", "cid", (1 / (1 + F.col("j"))).alias("conf"), (F.col("x1") + F.col("j") * 0.01).alias("x1"), "y1", (F.col("x2") + F.col("j") * 0.01).alias("x2"), "y2")
    return predictions, boxes.select("image", "cid", "x1", "y1", "x2", "y2")


@query("SELECT quality AS truth, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def class_confusion(spark, d):
    return measures.confusion(labelled(spark, d).select(F.col("quality").alias("truth"), (F.col("n_chars") >= 300).cast("int").alias("predicted")))




@query(f"WITH t AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars >= 300) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= 300) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 300) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, tp, fp, fn, {SQL_RATES} FROM t")
def precision_recall(spark, d):
    said, true = F.col("n_chars") >= 300, F.col("quality") == 1
    hits = labelled(spark, d).withColumn("hit", F.when(said & true, "tp").when(said, "fp").when(true, "fn"))
    return rounded(measures.counts(hits, ["lang"]), "precision", "recall", "f1")


@query(f"WITH s AS (SELECT quality, n_chars FROM documents JOIN labels USING (doc_id)), t AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1 AND n_chars >= threshold) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= threshold) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < threshold) AS fn FROM s, (SELECT unnest([100, 300, 1000, 3000, 10000]) AS threshold) GROUP BY 1) SELECT threshold, tp, fp, fn, {SQL_RATES} FROM t")
def confidence_sweep(spark, d):
    return rounded(measures.sweep(labelled(spark, d), "n_chars", "quality", [100, 300, 1000, 3000, 10000]), "precision", "recall", "f1")


@query("""
    WITH s AS (SELECT lang, n_chars, doc_id, quality FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT lang, sum(quality) OVER w AS tp, row_number() OVER w AS n, sum(quality) OVER (PARTITION BY lang) AS total FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)),
    e AS (SELECT lang, tp / total AS recall, tp / n AS precision, total FROM r),
    p AS (SELECT unnest(range(0, 101)) AS k),
    q AS (SELECT lang, any_value(total)::BIGINT AS positives, k, max(CASE WHEN recall >= k / 100 - 1e-12 THEN precision END) AS best FROM e, p GROUP BY lang, k)
    SELECT lang, any_value(positives) AS positives, round(sum(coalesce(best, 0)) / 101, 9) AS ap FROM q GROUP BY lang
""")
def average_precision(spark, d):
    return rounded(measures.average_precision(labelled(spark, d), "n_chars", "quality", "doc_id", by=["lang"]), "ap")


@query("""
    WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS hit, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT user_id, hit, n, r, (('0x' || md5('7:' || r || ':' || user_id)[1:8])::BIGINT) / 4294967296.0::DOUBLE AS u FROM g, range(0, 2000) t(r)),
    k AS (SELECT r, hit, n, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.999916758850712)::INT AS times FROM s),
    b AS (SELECT r, sum(hit * times) / sum(n * times) AS share FROM k GROUP BY r)
    SELECT count(*) AS repetitions, round(quantile_cont(share, .025), 9) AS low, round(quantile_cont(share, .975), 9) AS high FROM b
""")
def bootstrap_ci(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("hit"), F.count("*").alias("n"))
    drawn = statistics.draws(g, "user_id", 2000, "7")
    b = drawn.groupBy("repetition").agg((F.sum(F.col("hit") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("share"))
    p = F.percentile("share", [0.025, 0.975])
    return b.agg(F.count("*").alias("repetitions"), F.round(p[0], 9).alias("low"), F.round(p[1], 9).alias("high"))


@query("WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY ALL) SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM s")
def seed_summary(spark, d):
    s = statistics.summary(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("""
    WITH r AS (SELECT o_orderpriority AS model, o_orderstatus AS arm, o_custkey % 3 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL), s AS (SELECT model, arm, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM r GROUP BY ALL)
    SELECT model, arm, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(mean - 4.302652729696142 * sd / sqrt(3), 2) AS ci_low, round(mean + 4.302652729696142 * sd / sqrt(3), 2) AS ci_high FROM s
""")
def seed_intervals(spark, d):
    """Three seeds of every model and arm: 4.3026... is Student's t at 97.5 % with two degrees of freedom."""
    s = statistics.summary(runs(spark, d), ["model", "arm"], "v")
    return s.select("model", "arm", "n", *[F.round(c, k).alias(c) for c, k in (("mean", 4), ("sd", 4), ("ci_low", 2), ("ci_high", 2))])


RUNS = "SELECT o_orderpriority AS model, o_custkey % 3 AS seed, o_orderstatus AS arm, avg(o_totalprice) AS v FROM orders GROUP BY ALL"


def runs(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 3).alias("seed"), F.col("o_orderstatus").alias("arm")).agg(F.avg("o_totalprice").alias("v"))


@query(f"""
    WITH r AS ({RUNS}), x AS (SELECT a.model, a.arm, a.seed, a.v - b.v AS v FROM r a JOIN r b ON a.model = b.model AND a.seed = b.seed AND b.arm = 'O' WHERE a.arm <> 'O'),
    k AS (SELECT *, rank() OVER (PARTITION BY model, arm ORDER BY abs(v)) AS rank FROM x),
    s AS (SELECT model, arm, count(*) AS n_pairs, avg(v) AS mean, avg(v) / stddev_samp(v) AS dz, sum(CASE WHEN v > 0 THEN rank ELSE 0 END) AS up, sum(CASE WHEN v < 0 THEN rank ELSE 0 END) AS down FROM k GROUP BY ALL)
    SELECT model, arm, n_pairs, round(mean, 4) AS mean, round(dz, 6) AS dz, round(1 - abs(dz * sqrt(3)) / sqrt(dz * dz * 3 + 2), 6) AS t_p,
        [0.25, 0.5, 0.75, 1.0][least(up, down)::INTEGER + 1]::DOUBLE AS wilcoxon_p, round((up - down) / 6, 6) AS rank_biserial FROM s
""")
def paired_difference(spark, d):
    """Three pairs each: with two degrees of freedom Student's distribution has a closed form, and the signed ranks have eight patterns."""
    t = statistics.paired_tests(statistics.paired(runs(spark, d), ["model", "seed"], "arm", "O", "v"), ["model", "arm"])
    return t.select("model", "arm", "n_pairs", F.round("mean", 4).alias("mean"), *[F.round(c, 6).alias(c) for c in ("dz", "t_p", "wilcoxon_p", "rank_biserial")])


@query("WITH p AS (SELECT p_brand, avg(p_retailprice) / 10000 AS p FROM part GROUP BY 1), r AS (SELECT p_brand, p, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, p_brand) + 1)) AS raw FROM p) SELECT p_brand, round(p, 9) AS p, round(max(raw) OVER (ORDER BY p, p_brand ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r")
def holm_adjust(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 10000).alias("p"))
    return rounded(statistics.holm(p, "p", "p_brand"), "p", "adjusted").select("p_brand", "p", "adjusted")


@query("SELECT p_partkey, p_type, avg(rn) OVER (PARTITION BY p_type, p_size) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size) AS rn FROM part)")
def average_rank(spark, d):
    return measures.average_rank(table(spark, d, "part").select("p_partkey", "p_type", "p_size"), "p_size", ["p_type"]).select("p_partkey", "p_type", "rank")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, .95), 6) AS p95, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY ALL")
def latency_stats(spark, d):
    rows = table(spark, d, "events")
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(1000 / F.avg("value"), 6).alias("per_second"))
    p = statistics.percentiles(rows, ["event_type"], "value", [0.5, 0.95])
    return means.join(p, "event_type").select("event_type", "mean", F.round("p50", 6).alias("median"), F.round("p95", 6).alias("p95"), "per_second")


@query(f"WITH t AS (SELECT *, {SPLIT} AS split FROM documents), k AS (SELECT * FROM (SELECT DISTINCT split FROM t), (SELECT DISTINCT lang FROM t)) SELECT k.split, k.lang, count(doc_id) AS instances, count(DISTINCT source) AS groups, median(n_chars) AS median_chars FROM k LEFT JOIN t USING (split, lang) GROUP BY ALL")
def dataset_inventory(spark, d):
    t = docs_split(spark, d)
    counts = t.groupBy("split", "lang").agg(F.count("doc_id").alias("instances"), F.count_distinct("source").alias("groups"))
    found = materialize(counts.join(statistics.percentiles(t, ["split", "lang"], "n_chars", [0.5]), ["split", "lang"], "left"))
    scaffold = found.select("split").distinct().crossJoin(found.select("lang").distinct())  # three splits times the classes
    full = scaffold.join(found, ["split", "lang"], "left")
    return full.select("split", "lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("instances", "groups")], F.col("p50").alias("median_chars"))


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('[0,\"' || doc_id || '\"]'), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE place <= ceil(n * 0.1::DOUBLE)")
def nested_prefix(spark, d):
    return selection.nested_prefix(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 0.1)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def round_robin(spark, d):
    return selection.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 AS again FROM documents) ORDER BY again, doc_id LIMIT 40")
def coverage_sample(spark, d):
    return selection.coverage_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 40)


def few_names(df: DataFrame, most: int = 100) -> list:
    """The distinct values of a study's dimension; more than ``most`` are an error."""
    found = sorted(r[0] for r in df.distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} names: {df.columns[0]}")
    return found


@query("SELECT printf('seed%d_f%05d', s, (f * 10000)::INTEGER) AS subset, printf('seed%d_f%05d', s, (f * 10000)::INTEGER) || '_' || arm || '_' || model AS job FROM (SELECT unnest([0, 1, 2]) AS s), (SELECT unnest([0.25, 0.5, 1.0]) AS f), (SELECT DISTINCT o_orderstatus AS arm FROM orders), (SELECT DISTINCT r_name AS model FROM region)")
def experiment_grid(spark, d):
    arms, models = (few_names(table(spark, d, t).select(c)) for t, c in (("orders", "o_orderstatus"), ("region", "r_name")))
    subsets = spark.createDataFrame([(s, f) for s in (0, 1, 2) for f in (0.25, 0.5, 1.0)], "s int, f double").select(identity.subset_key(F.col("s"), F.col("f")).alias("subset"))
    return workflow.grid(subsets, arms, models).select("subset", "job")


@query("SELECT doc_id AS id, lang AS kind, NULL::INTEGER AS turn FROM documents UNION ALL SELECT conv_id, role, turn FROM conversations")
def union_augmented(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("kind"), F.col("turn").cast("int").alias("turn"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT 'left' AS side, doc_id AS key FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def key_set_equality(spark, d):
    return quality_gates.set_differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def distinct_geometry(spark, d):
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN n_chars < 50 OR lang IS NULL THEN 'reject' WHEN n_chars < 300 OR regexp_matches(text, '[*#%$&]{3}') THEN 'needs_review' ELSE 'pass' END AS outcome FROM documents) GROUP BY ALL")
def screening_outcomes(spark, d):
    reasons = quality_gates.codes(small=F.col("n_chars") < 50, no_class=F.col("lang").isNull())
    flags = quality_gates.codes(short=F.col("n_chars") < 300, symbols=F.col("text").rlike("[*#%$&]{3}"))
    return table(spark, d, "documents").groupBy(quality_gates.outcome(reasons, flags).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 25)::INTEGER AS page, source, doc_id FROM documents")
def review_pages(spark, d):
    return selection.pages(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("WITH t AS (SELECT event_id, value FROM events WHERE event_id <= (SELECT max(event_id) * 9 // 10 FROM events)), r AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS rn FROM t) SELECT count(*) AS kept, max(event_id) AS last_step, round(avg(value) FILTER (WHERE rn <= 100), 6) AS recent_mean, min(value) AS least, max(value) AS most, round(max(event_id) * 2 / 1000, 6) AS kimg FROM r")
def log_trim_last100(spark, d):
    log = table(spark, d, "events").select("event_id", "value")
    durable = log.agg((F.max("event_id") * 9 / 10).cast("long")).first()[0]  # the last step that was saved
    return control.loss_summary(control.trimmed(log, "event_id", durable), "event_id", "value", 100, 2)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_event_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""
    WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, sign(value - 20) AS x FROM events),
    b AS (SELECT user_id, i // 4 AS k, sum(x) / 4 AS a FROM s GROUP BY 1, 2 HAVING count(*) = 4),
    r AS (SELECT user_id, 0 AS k, greatest(1, least(500, 10 + (a - 0.6::DOUBLE) * 10)) AS horizon FROM b WHERE k = 0
        UNION ALL SELECT r.user_id, r.k + 1, greatest(1, least(500, horizon + (b.a - 0.6::DOUBLE) * 10)) FROM r JOIN b ON b.user_id = r.user_id AND b.k = r.k + 1)
    SELECT user_id, max(k) + 1 AS updates, round(max_by(horizon, k), 6) AS horizon FROM r GROUP BY user_id
""")
def controller_fold(spark, d):
    from ..streaming.control import fold

    signs = table(spark, d, "events").select("user_id", "event_id", F.signum(F.col("value") - 20).alias("x"))
    return fold(signs, "user_id", "event_id", "x", start=10.0, gain=10.0, target=0.6)


@query("SELECT source, count(*) AS rows, count(*) FILTER (WHERE lang = 'de') AS lang_de, count(*) FILTER (WHERE lang = 'en') AS lang_en, count(*) FILTER (WHERE lang = 'es') AS lang_es, count(*) FILTER (WHERE lang = 'fr') AS lang_fr FROM documents GROUP BY ALL")
def group_features(spark, d):
    return selection.group_features(table(spark, d, "documents"), "source", {"lang": ["de", "en", "es", "fr"]})


@query("WITH r AS (SELECT p_type, p_partkey, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY p_type) - 1 AS l FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)) SELECT p_type, p_partkey FROM r WHERE p IN (0, floor(l * 0.25::DOUBLE), floor(l * 0.5::DOUBLE), floor(l * 0.75::DOUBLE), l)")
def rank_positions(spark, d):
    return selection.at_ranks(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")


@query("SELECT regexp_extract(p_name, '^([a-z]+)', 1) AS family, count(*) AS parts, count(DISTINCT p_brand) AS brands, round(avg(p_size), 6) AS mean_size, round(stddev_pop(p_retailprice), 4) AS spread FROM part GROUP BY ALL")
def family_summary(spark, d):
    family = F.regexp_extract("p_name", "^([a-z]+)", 1)
    return table(spark, d, "part").groupBy(family.alias("family")).agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.round(F.avg("p_size"), 6).alias("mean_size"), F.round(F.stddev_pop("p_retailprice"), 4).alias("spread"))


@query("SELECT CASE WHEN c_custkey IS NULL THEN 'no_source' WHEN c_nationkey <> s_nationkey THEN 's_nationkey' END AS violation, s_suppkey::VARCHAR AS key FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey <> s_nationkey")
def provenance_mismatch(spark, d):
    patches = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("s_nationkey"))
    return workflow.provenance(patches, sources, "id", ["s_nationkey"])


@query("""
    SELECT o_orderkey AS job FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH') AND NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
    AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3)
""")
def job_eligibility(spark, d):
    """Complete orders of high priority have no metrics; urgent open ones failed; status P waits for a review."""
    orders = table(spark, d, "orders").withColumn("job", F.col("o_orderkey"))
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "blocked_review").when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("pending")
    test = orders.select("job", F.lit("test").alias("split"), state.alias("state"))
    metrics = orders.where("o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH'").select("job", F.lit("test").alias("split"))
    val = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("n")).where("n > 3").select("job", F.lit("val").alias("split"), F.lit("complete").alias("state"))
    return workflow.eligible(orders.select("job"), test.unionByName(val), "test", metrics=metrics)


@query(f"""{GREEDY % (TARGETS, BEST % ("AND t.cid = ps[k + 1].cid", OVER, AREAS, OVER, "-"))},
    n AS (SELECT r.cid, count(*) FILTER (WHERE hit IS NOT NULL) AS tp, count(*) FILTER (WHERE hit IS NULL) AS fp FROM r WHERE k > 0 GROUP BY 1),
    f AS (SELECT b.cid, count(*) FILTER (WHERE NOT list_contains(u.used, b.j)) AS fn FROM b JOIN (SELECT l_orderkey, arg_max(used, k) AS used FROM r GROUP BY 1) u USING (l_orderkey) GROUP BY 1)
    SELECT cid, tp, fp, fn, {SQL_RATES} FROM n JOIN f USING (cid)
""")
def greedy_match(spark, d):
    return rounded(measures.counts(matching.greedy(*shifted_boxes(spark, d))), "precision", "recall", "f1")


@query()
def detection_report(spark, d):
    predictions, targets = shifted_boxes(spark, d)
    return measures.detection_report(matching.graded(predictions, targets, areas={"all": (0, 1e10), "small": (0, 0.02), "large": (0.02, 1e10)}, most=(1, 3, 100)))


@query()
def group_bootstrap(spark, d):
    hits = matching.greedy(*shifted_boxes(spark, d)).groupBy("image", "cid").agg(*[F.count_if(F.col("hit") == h).alias(h) for h in ("tp", "fp", "fn")])
    groups = hits.withColumn("group", F.substring(F.md5("image"), 1, 2))
    return rounded(statistics.group_bootstrap(groups, "group", by="cid"), "low", "high")


@query("""
    WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w
""")
def streamed_windows(spark, d):
    """The windows of a stream over the event files, each batch in full, as the last one left them."""
    out = shared_folder(spark, "windows")
    # a pattern, as the table may be one file or a folder of them
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    last: list[int] = []
    counted = control.windows(stream, "ts", "1 day", "1 day", "event_type")
    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    found = materialize(spark.read.parquet(f"{out}/{last[-1]}"))
    delete_path(spark, out)
    return found


@query("""
    WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM events),
    r AS (SELECT user_id, i, value::DOUBLE AS v FROM s WHERE i = 0 UNION ALL SELECT s.user_id, s.i, r.v * least(0.9::DOUBLE, (1 + s.i) / (10 + s.i)) + s.value * (1 - least(0.9::DOUBLE, (1 + s.i) / (10 + s.i))) FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
    SELECT user_id, round(arg_max(v, i), 6) AS ema FROM r GROUP BY user_id
""")
def moving_average(spark, d):
    """A user's events are few; only they are gathered in a row."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("value").cast("double").alias("value")))).alias("all"))
    return rows.select("user_id", F.round(control.ema(F.col("all.value"), 0.9), 6).alias("ema"))


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 25")
def seeded_rows(spark, d):
    return selection.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 25, 3)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def undecided_queue(spark, d):
    from ..operators.screening import undecided

    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("approved"))
    return undecided(rows, "approved", "o_orderkey", 20).select("o_orderkey")


@query()
def nested_subsets(spark, d):
    rows = docs_split(spark, d).where("split = 'train'")
    groups, sums = selection.totals_of(rows, "source", {x: (F.col("lang") == x).cast("int") for x in ("de", "en", "es", "fr")})
    found = selection.nested_subsets(groups, sums, [0.25, 0.5, 1.0], 0, 3)
    return spark.createDataFrame([(f, s) for f, some in found.items() for s in some], "fraction double, source string")


@query()
def grouped_split(spark, d):
    groups, sums = selection.totals_of(table(spark, d, "documents"), "source", {x: (F.col("lang") == x).cast("int") for x in ("de", "en", "es", "fr")})
    found = selection.grouped_split(groups, sums)
    return spark.createDataFrame([(g, ("train", "val", "test")[s]) for g, s in found.items()], "source string, split string")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """How much of the data leaks across splits: per split and class, rows, copies and rows shared with another split."""
    docs = materialize(docs_split(spark, d).select("split", "lang", "n_chars", F.md5("text").alias("h")))
    groups = docs.groupBy("h").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("copies"))
    return docs.join(groups, "h").groupBy("split", "lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("copies") > 1).alias("copied"), F.count_if(F.col("splits") > 1).alias("leaking"), F.percentile("n_chars", 0.5).alias("median_chars")
    )
