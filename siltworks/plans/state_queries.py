"""Reviews, receipts, screening, jobs and integrity over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import inventory, matching, neardup, quality_gates, screening, study, workflow
from ..session import table
from .registry import BITS, BOXES, SPLIT, docs_split, line_boxes, query


@query("SELECT doc_id, md5(trim(coalesce(text, ''))) <> md5(coalesce(text, '')) OR coalesce(lang, '') <> CASE WHEN quality = 0 THEN '' ELSE coalesce(lang, '') END AS stale FROM documents LEFT JOIN labels USING (doc_id)")
def review_staleness(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = F.coalesce("text", F.lit(""))
    then = F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("lang"))
    return rows.select("doc_id", quality_gates.stale([(F.md5(F.trim(text)), F.md5(text)), (F.col("lang"), then)]).alias("stale"))


@query("""
    SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN lang = 'es' THEN 'version' WHEN lang = 'fr' THEN 'stage' WHEN n_chars % 2 = 1 THEN 'stale' WHEN quality = 0 THEN 'rejected' WHEN n_chars < 2000 AND toxic = 0 THEN 'needs a reason' END AS problem
    FROM documents LEFT JOIN labels USING (doc_id)
""")
def receipt_gate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    receipt = {
        "version": F.when(known, F.when(F.col("lang") == "es", 2).otherwise(1)), "stage": F.when(F.col("lang") == "fr", "composites").otherwise("candidates"),
        "fingerprint": (F.col("n_chars") % 2).cast("string"), "outcome": F.when(F.col("quality") == 0, "reject").when(F.col("n_chars") < 2000, "needs_review").otherwise("pass"),
    }
    problem = workflow.receipt_problem(receipt, 1, "candidates", F.lit("0"), F.when(F.col("toxic") == 1, "seen"))
    return rows.select("doc_id", problem.alias("problem"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def with_letter_bits(df, text):
    """``df`` with bits: which letters are commoner in the first half of ``text`` than in the second, and in its odd quarters than in its even ones.

    Texts of their own differ in about half of the 52 bits, copies with a few other words in few.
    """
    part = "transform(sequence(0, 3), j -> substring(__t, int(1 + j * length(__t) div 4), int((j + 1) * length(__t) div 4 - j * length(__t) div 4)))"
    counts = ", ".join(f"length(q) - length(replace(q, '{c}', ''))" for c in LETTERS)
    more = "if(i < 26, n[0][i % 26] + n[1][i % 26] > n[2][i % 26] + n[3][i % 26], n[0][i % 26] + n[2][i % 26] > n[1][i % 26] + n[3][i % 26])"
    found = df.withColumn("__t", text).withColumn("n", F.expr(f"transform({part}, q -> array({counts}))"))
    return found.withColumn("bits", F.expr(f"aggregate(sequence(0, 51), 0L, (s, i) -> s + if({more}, shiftleft(1L, i), 0L))")).drop("__t", "n")


SCREENED = f"""
    w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS k FROM documents),
    h AS MATERIALIZED (SELECT doc_id, list_transform(range(0, 4), lambda j: substring(t, 1 + j * k // 4, (j + 1) * k // 4 - j * k // 4)) AS quarters FROM w),
    m AS MATERIALIZED (SELECT doc_id, list_transform(quarters, lambda q: list_transform(string_split('{LETTERS}', ''), lambda c: length(q) - length(replace(q, c, '')))) AS m FROM h),
    e AS MATERIALIZED (SELECT doc_id, list_sum(list_transform(range(0, 52), lambda i: CASE WHEN (CASE WHEN i < 26 THEN m[1][i % 26 + 1] + m[2][i % 26 + 1] > m[3][i % 26 + 1] + m[4][i % 26 + 1] ELSE m[1][i % 26 + 1] + m[3][i % 26 + 1] > m[2][i % 26 + 1] + m[4][i % 26 + 1] END) THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS bits FROM m),
    s AS MATERIALIZED (SELECT d.doc_id, n_chars, source, lang, coalesce(toxic, 0) AS cid, CASE WHEN coalesce(quality, 1) = 0 THEN 'other' WHEN coalesce(toxic, 0) = 1 THEN 'toxic' ELSE 'clean' END AS cname, md5(coalesce(text, '')) AS pixel, bits
        FROM documents d JOIN e USING (doc_id) LEFT JOIN labels USING (doc_id)),
    r AS (SELECT *, list_filter([CASE WHEN n_chars % 23 = 0 THEN 'image_hash_mismatch' END, CASE WHEN n_chars >= 40 AND source = 'src3' THEN 'checkpoint_hash_mismatch' END,
            CASE WHEN n_chars >= 40 AND NOT (cid < 2 AND cname = CASE cid WHEN 0 THEN 'clean' ELSE 'toxic' END) THEN 'invalid_class' END, CASE WHEN n_chars < 40 THEN 'unreadable_or_invalid:short' END], lambda x: x IS NOT NULL) AS reasons,
        list_filter([CASE WHEN n_chars >= 40 AND least(n_chars // 10, 100) < 16 THEN 'small_image' END, CASE WHEN n_chars >= 40 AND n_chars % 50 < 5 THEN 'low_contrast_or_blank' END, CASE WHEN n_chars >= 40 AND n_chars % 100 < 15 THEN 'low_detail_or_blur' END], lambda x: x IS NOT NULL) AS flags FROM s),
    f AS (SELECT pixel, min(doc_id) AS first FROM r WHERE len(reasons) = 0 GROUP BY 1),
    a AS (SELECT doc_id, bits FROM r JOIN f USING (pixel) WHERE len(reasons) = 0 AND doc_id = first),
    n AS (SELECT y.doc_id, min(x.doc_id) AS near FROM a x JOIN a y ON x.doc_id < y.doc_id AND bit_count(xor(x.bits, y.bits)) <= 2 GROUP BY 1),
    o AS (SELECT r.doc_id, CASE WHEN len(r.reasons) = 0 AND r.doc_id <> f.first THEN list_append(r.reasons, 'exact_duplicate_of:' || f.first) ELSE r.reasons END AS reasons, CASE WHEN n.near IS NOT NULL THEN list_append(r.flags, 'near_duplicate_of:' || n.near) ELSE r.flags END AS flags
        FROM r LEFT JOIN f ON r.pixel = f.pixel LEFT JOIN n ON r.doc_id = n.doc_id)
"""


def screened(spark, d):
    text = F.coalesce("text", F.lit(""))
    cid = F.coalesce("toxic", F.lit(0))
    # hashes first: texts are not shuffled for the join
    hashed = with_letter_bits(table(spark, d, "documents"), text).select("doc_id", "n_chars", "source", "bits", F.md5(text).alias("pixel_hash"))
    rows = hashed.join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 40, "short").alias("error"), F.lit("a").alias("sha256"), F.when(F.col("n_chars") % 23 == 0, "b").otherwise("a").alias("expected_sha256"),
        F.floor(F.col("n_chars") / 10).alias("width"), F.lit(100).cast("long").alias("height"), (F.col("n_chars") % 50).cast("double").alias("gray_std"), (F.col("n_chars") % 100).cast("double").alias("laplacian_variance"),
        "pixel_hash", F.col("bits").alias("phash"), F.when(F.col("source") == "src3", "y").otherwise("x").alias("checkpoint_now"), F.lit("x").alias("checkpoint_sha256"),
        cid.alias("class_id"), F.when(F.coalesce("quality", F.lit(1)) == 0, "other").when(cid == 1, "toxic").otherwise("clean").alias("class_name"),
    )
    return screening.screen(rows, "candidates", ["clean", "toxic"])


@query(f"WITH {SCREENED} SELECT doc_id, CASE WHEN len(reasons) > 0 THEN 'reject' WHEN len(flags) > 0 THEN 'needs_review' ELSE 'pass' END AS outcome, array_to_string(list_sort(list_distinct(list_concat(reasons, flags))), ';') AS codes FROM o")
def screening_rules(spark, d):
    return screened(spark, d).select(F.col("id").alias("doc_id"), "outcome", F.array_join("codes", ";").alias("codes"))


@query(f"""
    WITH {SCREENED}, p AS (SELECT o.doc_id, s.cid FROM o JOIN s USING (doc_id) WHERE len(reasons) = 0 AND len(flags) = 0)
    SELECT doc_id, cid, row_number() OVER (PARTITION BY cid ORDER BY doc_id) AS turn FROM p
""")
def passed_candidates(spark, d):
    rows, _ = screening.passed(screened(spark, d), 2)
    return rows.select(F.col("id").alias("doc_id"), F.col("class_id").alias("cid"), "turn")


@query("""
    WITH q AS (SELECT o_orderkey, o_orderstatus, min(l_discount) * 8 AS x1, min(l_tax) * 8 AS y1, (min(l_quantity) * 10)::INTEGER AS w, min(l_partkey) AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL),
    p AS (SELECT *, (x1 * 100)::INTEGER AS x, (y1 * 100)::INTEGER AS y, part // 2 || '/' || w AS pixel, part % 512 AS bits FROM q),
    r AS (SELECT *, least(x, y) >= 0 AND w > 0 AND x + w <= 480 AND y + 20 <= 480 AS fits FROM p),
    s AS (SELECT *, list_filter([CASE WHEN NOT fits THEN 'invalid_composite_region' END, CASE WHEN o_orderstatus = 'P' THEN 'label_hash_mismatch' END, CASE WHEN w = 250 THEN 'labels_disagree_with_targets' END,
            CASE WHEN w = 300 THEN 'dimension_mismatch' END, CASE WHEN NOT (x1 < 0.9 AND y1 < 0.9) THEN 'invalid_target_box' END], lambda x: x IS NOT NULL) AS reasons,
        list_filter([CASE WHEN fits AND least(w, 20) < 30 THEN 'small_inserted_region' END, CASE WHEN w < 50 THEN 'low_contrast_or_blank' END], lambda x: x IS NOT NULL) AS flags FROM r),
    f AS (SELECT pixel, min(o_orderkey) AS first FROM s WHERE len(reasons) = 0 GROUP BY 1),
    a AS (SELECT o_orderkey, bits FROM s JOIN f USING (pixel) WHERE len(reasons) = 0 AND o_orderkey = first),
    n AS (SELECT v.o_orderkey, min(u.o_orderkey) AS near FROM a u JOIN a v ON u.o_orderkey < v.o_orderkey AND bit_count(xor(u.bits, v.bits)) <= 2 GROUP BY 1)
    SELECT s.o_orderkey, array_to_string(list_sort(list_concat(list_concat(reasons, flags), list_filter([CASE WHEN len(reasons) = 0 AND s.o_orderkey <> first THEN 'exact_duplicate_of:' || first END, CASE WHEN near IS NOT NULL THEN 'near_duplicate_of:' || near END], lambda x: x IS NOT NULL))), ';') AS codes
    FROM s LEFT JOIN f USING (pixel) LEFT JOIN n USING (o_orderkey)
""")
def composite_screening(spark, d):
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.min(c).alias(c) for c in ("l_discount", "l_tax", "l_quantity", "l_partkey")])
    rows = table(spark, d, "orders").join(lines, "o_orderkey")
    x, y, w = F.col("l_discount") * 8, F.col("l_tax") * 8, F.round(F.col("l_quantity") * 10).cast("int")
    pixel = lambda v: F.round(v * 100).cast("int")
    other = lambda c, name: F.when(c, F.lit("b")).otherwise(F.lit("a")).alias(name)
    target = F.struct(F.lit(0).alias("cid"), x.alias("x1"), y.alias("y1"), F.lit(0.9).alias("x2"), F.lit(0.9).alias("y2"))
    rows = rows.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("error"), F.lit("a").alias("sha256"), F.lit("a").alias("expected_sha256"), F.lit(480).alias("width"), F.lit(480).alias("height"),
        w.cast("double").alias("gray_std"), F.lit(99.0).alias("laplacian_variance"), F.concat_ws("/", F.floor(F.col("l_partkey") / 2).cast("string"), w.cast("string")).alias("pixel_hash"), (F.col("l_partkey") % 512).cast("long").alias("phash"),
        F.struct(pixel(x).alias("x"), pixel(y).alias("y"), w.alias("w"), F.lit(20).alias("h")).alias("region"), other(F.col("o_orderstatus") == "P", "label_now"), F.lit("a").alias("label_sha256"),
        other(w == 250, "label_text"), F.lit("a").alias("target_text"), F.when(w == 300, 481).otherwise(480).alias("record_width"), F.lit(480).alias("record_height"), F.array(target).alias("targets"),
    )
    found = screening.screen(rows, "composites", ["one"], {"min_side": 30, "min_gray_std": 50})
    return found.select(F.col("id").alias("o_orderkey"), F.array_join("codes", ";").alias("codes"))


@query("""
    WITH r AS (SELECT doc_id, quality, toxic, lang, CASE WHEN quality IS NOT NULL THEN toxic = 0 END AS said, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS who FROM documents LEFT JOIN labels USING (doc_id))
    SELECT count(*) FILTER (WHERE said) AS approve, count(*) FILTER (WHERE NOT said) AS reject, count(*) FILTER (WHERE said IS NULL) AS pending, count(*) FILTER (WHERE said AND (quality = 0 OR coalesce(who, '') = '')) AS incomplete FROM r
""")
def review_decisions(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    said = table(spark, d, "labels").join(rows.withColumnRenamed("id", "doc_id"), "doc_id")
    decisions = said.select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("approved"), F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("reviewer"), (F.col("quality") == 1).alias("placement_valid"))
    done, violations = workflow.decide(rows, decisions, "placement")
    return workflow.outcomes(done).crossJoin(violations.agg(F.count_if(F.col("violation") == "incomplete").alias("incomplete")))  # one row each


@query("""
    WITH s AS (SELECT o_orderkey AS job, 'val' AS split, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'running' ELSE 'pending' END AS state FROM orders),
    c AS (SELECT l_orderkey AS job, max_by(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'complete' ELSE 'running' END, (l_linenumber::BIGINT * 100000 + l_partkey) * 10000 + l_suppkey) AS state FROM lineitem GROUP BY 1)
    SELECT s.job, s.split, coalesce(c.state, s.state) AS state FROM s LEFT JOIN c USING (job)
""")
def job_states(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.lit("val").alias("split"), state.alias("state"))
    then = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "complete").otherwise("running")
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.lit("val").alias("split"), then.alias("state"), ((F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("seq"))
    return workflow.advance(status, changes)


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 1 THEN lang = 'en' END AS approved, CASE WHEN n_chars % 2 = 1 THEN lang END AS reviewer, CASE WHEN n_chars % 2 = 1 THEN 'old' ELSE md5(text) END AS screening FROM documents")
def rescreening(spark, d):
    """Documents of even length are screened again and lose their approval; the others keep it."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("approved"), F.col("lang").alias("reviewer"), F.lit("old").alias("screening"), "text", (F.col("n_chars") % 2 == 1).alias("kept"))
    again = workflow.rescreened(rows.where("NOT coalesce(kept, false)"), F.md5("text"), ["approved", "reviewer"])
    return rows.where("kept").unionByName(again).drop("text", "kept")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS violation, coalesce(m.doc_id, l.doc_id)::VARCHAR AS key FROM (SELECT doc_id, md5((n_chars < 4000)::VARCHAR) AS h FROM documents) m FULL JOIN (SELECT doc_id, md5((quality = 1)::VARCHAR) AS h FROM labels) l ON m.doc_id = l.doc_id WHERE m.h IS DISTINCT FROM l.h")
def exchange_import(spark, d):
    sign = lambda c: F.md5(c.cast("string")).alias("h")
    manifest = table(spark, d, "documents").select("doc_id", sign(F.col("n_chars") < 4000))
    return workflow.imported(manifest, table(spark, d, "labels").select("doc_id", sign(F.col("quality") == 1)), "doc_id", ["h"])


@query("""
    WITH s AS (SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS k, count(*) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY 1)
    SELECT source, CASE WHEN n > 20 * en THEN 'un-augmented' WHEN k < n OR en > 100 THEN 'augmented' ELSE 'un-augmented' END AS verdict, CASE WHEN en > 0.9 * least(n, k) THEN 'contained' ELSE 'separate' END AS note FROM s
""")
def augmentation_notes(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("k"), F.count_if(F.col("lang") == "en").alias("en"))
    verdict = workflow.augmentation_verdict(F.lit(False), F.col("en") > 100, F.col("n") - F.col("k"), F.col("n") > 20 * F.col("en"))
    return s.select("source", verdict.alias("verdict"), workflow.containment_note(F.col("en"), F.least("n", "k")).alias("note"))


@query(f"""
    WITH t AS ({BOXES}), m AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE t.l_orderkey = a.l_orderkey AND t.l_linenumber = a.l_linenumber AND abs(t.x1 - a.x1 - a.l_linenumber * 0.002) <= 0.011 AND abs(t.y1 - a.y1) <= 0.011 AND abs(t.x2 - a.x2) <= 0.011 AND abs(t.y2 - a.y2) <= 0.011) AS met FROM t a)
    SELECT l_orderkey::VARCHAR AS image, bool_and(met) AS same FROM m GROUP BY 1
""")
def same_boxes(spark, d):
    t = line_boxes(spark, d).select(F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").cast("int").alias("cid"), "x1", "y1", "x2", "y2")
    moved = t.withColumn("x1", F.col("x1") + F.col("cid") * 0.002)
    return matching.same_boxes(moved, t)


MANIFEST = f"""
    m AS (SELECT CASE WHEN source = 'src3' THEN 'other' ELSE {SPLIT} END AS split, md5(text)[1:12] AS stem, source AS grp, CASE WHEN n_chars < 100 THEN 'pending_review' ELSE 'approved' END AS status, md5(trim(text)) AS image_sha256, CASE WHEN n_chars % 10 = 0 THEN 'old' ELSE 'same' END AS label_sha256, doc_id FROM documents WHERE lang <> 'es'),
    f AS (SELECT {SPLIT} AS split, md5(text)[1:12] AS stem, md5(text) AS sha FROM documents),
    l AS (SELECT {SPLIT} AS split, md5(text)[1:12] AS stem, quality || ' 0.5 0.5 0.1 0.1' || CASE WHEN toxic = 1 THEN ' 7' ELSE '' END AS text, toxic, quality FROM documents JOIN labels USING (doc_id))
"""


@query(f"""
    WITH {MANIFEST}, fc AS (SELECT split, stem, count(*) AS files, min(sha) AS now FROM f GROUP BY ALL), lc AS (SELECT split, stem FROM l GROUP BY ALL),
    r AS (SELECT m.*, files, now, lc.stem IS NOT NULL AS labelled FROM m LEFT JOIN fc ON m.split = fc.split AND m.stem = fc.stem LEFT JOIN lc ON m.split = lc.split AND m.stem = lc.stem),
    p AS (SELECT l.* FROM l WHERE (split, stem) IN (SELECT split, stem FROM m)),
    v AS (SELECT 'invalid_split' AS violation, split || '/' || stem AS key FROM r WHERE split = 'other'
        UNION ALL SELECT 'image_missing_or_ambiguous', split || '/' || stem FROM r WHERE split <> 'other' AND coalesce(files, 0) <> 1
        UNION ALL SELECT 'label_missing', split || '/' || stem FROM r WHERE split <> 'other' AND NOT labelled
        UNION ALL SELECT 'image_changed', split || '/' || stem FROM r WHERE split <> 'other' AND files = 1 AND now IS DISTINCT FROM image_sha256
        UNION ALL SELECT 'label_changed', split || '/' || stem FROM r WHERE split <> 'other' AND labelled AND label_sha256 <> 'same'
        UNION ALL SELECT 'not_a_box', split || '/' || stem FROM p WHERE toxic = 1
        UNION ALL SELECT 'not_approved', split || '/' || stem FROM m WHERE status <> 'approved'
        UNION ALL SELECT 'outside_manifest', fc.split || '/' || fc.stem FROM fc WHERE (split, stem) NOT IN (SELECT split, stem FROM m))
    SELECT violation, key, count(*) AS rows FROM v GROUP BY ALL
    UNION ALL SELECT 'repeated_image', stem, count(*) FROM m GROUP BY stem HAVING count(*) > 1
    UNION ALL SELECT 'group_crosses_splits', grp, count(*) FROM m GROUP BY grp HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'class_missing', s.split || '/' || c.cid, 1 FROM (SELECT unnest(['train', 'val', 'test']) AS split) s, (SELECT unnest([0, 1, 2]) AS cid) c WHERE NOT EXISTS (FROM p WHERE p.split = s.split AND p.quality = c.cid AND p.toxic = 0)
    UNION ALL SELECT 'class_order', '', 1
""")
def dataset_gate(spark, d):
    docs = docs_split(spark, d)
    stem = F.substring(F.md5("text"), 1, 12).alias("stem")
    split = F.when(F.col("source") == "src3", "other").otherwise(F.col("split")).alias("split")
    manifest = docs.where("lang <> 'es'").select(split, stem, F.col("source").alias("group"), F.when(F.col("n_chars") < 100, "pending_review").otherwise("approved").alias("status"), F.md5(F.trim("text")).alias("image_sha256"), F.when(F.col("n_chars") % 10 == 0, "old").otherwise("same").alias("label_sha256"))
    images = docs.select("split", stem, F.md5("text").alias("sha256"))
    text = F.concat(F.col("quality").cast("string"), F.lit(" 0.5 0.5 0.1 0.1"), F.when(F.col("toxic") == 1, " 7").otherwise(""))
    labels = docs.join(table(spark, d, "labels"), "doc_id").select("split", stem, text.alias("text"), F.lit("same").alias("sha256"))
    return inventory.violations(manifest, images, labels, ["b", "a", "c"], ["a", "b", "c"], "reviewed", True)


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus AS split FROM orders),
    b AS (SELECT l_orderkey, (l_linenumber - 1)::INTEGER AS cid, l_discount * 4 + 0.1 AS cx, l_tax * 4 + 0.1 AS cy, 0.2 AS w, 0.1 + l_discount AS h FROM lineitem)
    SELECT o_orderkey AS stem, split, count(cid) AS boxes, round(coalesce(sum(CASE WHEN cid IS NOT NULL THEN least(1, cx + w / 2) - greatest(0, cx - w / 2) END), 0), 6) AS wide, round(coalesce(sum(CASE WHEN cid IS NOT NULL THEN greatest(0, cy - h / 2) END), 0), 6) AS top, coalesce(sum(cid), 0)::BIGINT AS cids
    FROM o LEFT JOIN b ON o_orderkey = l_orderkey GROUP BY ALL
""")
def typed_inventory(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_orderstatus").alias("split"))
    images = orders.select("split", "stem", F.lit("p").alias("path"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    number = lambda c: c.cast("string")
    line = F.concat_ws(" ", number(F.col("l_linenumber") - 1), number(F.col("l_discount") * 4 + 0.1), number(F.col("l_tax") * 4 + 0.1), F.lit("0.2"), number(0.1 + F.col("l_discount")))
    texts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("stem")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    found = inventory.inventory(orders, images, texts.join(orders, "stem"), 7)
    total = lambda f: F.aggregate("targets", F.lit(0.0), lambda s, t: s + f(t))
    return found.select("stem", "split", F.size("targets").cast("long").alias("boxes"), F.round(total(lambda t: t["x2"] - t["x1"]), 6).alias("wide"), F.round(total(lambda t: t["y1"]), 6).alias("top"), total(lambda t: t["cid"]).cast("long").alias("cids"))


@query(f"""
    WITH r AS (SELECT *, {SPLIT} AS split FROM documents), b AS (SELECT r.split, 'c' || quality AS name FROM r JOIN labels USING (doc_id))
    SELECT split, 'images' AS kind, '' AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT split, 'source', source, count(*) FROM r GROUP BY ALL
    UNION ALL SELECT s.split, 'class', s.name, count(b.name) FROM (SELECT unnest(['train', 'val', 'test']) AS split, c.name FROM (SELECT unnest(['c0', 'c1', 'c2']) AS name) c) s LEFT JOIN b ON s.split = b.split AND s.name = b.name GROUP BY ALL
""")
def export_counts(spark, d):
    rows = docs_split(spark, d)
    boxes = rows.join(table(spark, d, "labels"), "doc_id").select("split", F.concat(F.lit("c"), F.col("quality").cast("string")).alias("name"))
    return inventory.export_counts(rows, boxes, ["c0", "c1", "c2"])


@query("""
    WITH r AS (SELECT source, coalesce('q' || quality, 'none') AS status, md5(text) AS grp, lang AS unit, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT source, status, count(*) AS n FROM r GROUP BY ALL)
    SELECT source, count(*) AS images, count(*) FILTER (WHERE n_chars < 100) AS empty, count(DISTINCT grp) AS groups, count(DISTINCT unit) AS units, sum(n_chars % 3)::BIGINT AS duplicates,
        (SELECT string_agg(s.status || '=' || s.n, ',' ORDER BY s.status) FROM s WHERE s.source = r.source) AS statuses FROM r GROUP BY source
""")
def scan_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("none"))
    records = rows.select("source", status.alias("status"), F.md5("text").alias("group"), F.col("lang").alias("unit"), F.when(F.col("n_chars") < 100, 0).otherwise(1).alias("boxes"), (F.col("n_chars") % 3).alias("duplicates"))
    found = inventory.scan_summary(records)
    return found.withColumn("statuses", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("SELECT count(*) AS groups, count(*) FILTER (WHERE s > 1) AS crossing FROM (SELECT md5(text) AS g, count(DISTINCT source) AS s FROM documents GROUP BY 1)")
def cross_source_groups(spark, d):
    return inventory.cross_source_groups(table(spark, d, "documents").select(F.md5("text").alias("group"), "source"))


@query("""
    WITH k AS (SELECT 'single' AS level, source, lang, count(DISTINCT md5(text)) AS total FROM documents GROUP BY ALL UNION ALL SELECT 'pooled', NULL, lang, count(DISTINCT md5(text)) FROM documents GROUP BY ALL)
    SELECT level, source, lang, total, fraction, round_even(total * 0.7::DOUBLE * fraction, 0)::BIGINT AS expected, CASE WHEN total * 0.7::DOUBLE * fraction < 5 THEN 'FAIL' WHEN total * 0.7::DOUBLE * fraction < 20 THEN 'WARN' ELSE 'OK' END AS verdict FROM k, (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS fraction)
""")
def pooled_planning(spark, d):
    records = table(spark, d, "documents").select("source", F.col("lang").alias("cls"), F.md5("text").alias("key"))
    return inventory.planning(records, [0.1, 0.5, 1.0]).withColumnRenamed("cls", "lang")


@query("SELECT md5(text) AS h, min(source || '/' || doc_id) AS path FROM documents GROUP BY 1")
def representatives(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("h"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return inventory.representatives(rows, "h", "path")


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_quantity >= 8) AS n FROM lineitem GROUP BY ALL HAVING count(*) FILTER (WHERE l_quantity >= 8) > 0),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_linenumber ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT DISTINCT l_orderkey FROM r WHERE before < 2
""")
def two_boxes_per_class(spark, d):
    return inventory.two_of_each(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") >= 8)


@query(f"WITH b AS ({BITS}) SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.bits, y.bits))::INTEGER AS distance FROM b x JOIN b y ON x.label < 5 AND y.label >= 5 WHERE bit_count(xor(x.bits, y.bits)) <= 20 ORDER BY a, b LIMIT 10")
def hamming_examples(spark, d):
    from .registry import hashes

    bits = hashes(spark, d)
    return neardup.examples(bits.where("label < 5"), bits.where("label >= 5"), "vec_id", "bits", 20)


@query("""
    WITH j AS (SELECT o_orderkey AS job, o_custkey % 7 AS seed, o_orderpriority AS arm FROM orders), m AS (SELECT l_orderkey AS job, l_linestatus AS split, avg(l_quantity) AS map FROM lineitem GROUP BY ALL)
    SELECT job, seed, arm, split, round(map, 6) AS map FROM j JOIN m USING (job)
""")
def run_rows(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 7).alias("seed"), F.col("o_orderpriority").alias("arm"))
    metrics = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linestatus").alias("split")).agg(F.round(F.avg("l_quantity"), 6).alias("map"), F.lit("p").alias("plan_identity"))
    rows, _ = study.run_rows(jobs, spark.createDataFrame([], "job long, state string"), metrics, "p")
    return rows.drop("plan_identity")


@query("""
    WITH r AS (SELECT o_orderstatus AS model, o_orderpriority AS arm, o_custkey % 11 AS seed FROM orders WHERE o_custkey % 3 < 3 GROUP BY ALL), b AS (SELECT model, seed FROM r WHERE arm = '1-URGENT'),
    a AS (SELECT DISTINCT model, arm FROM r WHERE arm <> '1-URGENT')
    SELECT a.model, a.arm, coalesce(string_agg(r.seed::VARCHAR, ',' ORDER BY r.seed), '') AS seeds, count(r.seed) AS pairs FROM a LEFT JOIN (SELECT r.* FROM r JOIN b USING (model, seed)) r ON a.model = r.model AND a.arm = r.arm GROUP BY ALL
""")
def shared_seeds(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 11).alias("seed"))
    return study.shared_seeds(runs, ["model"], "arm", "1-URGENT", "seed")


@query("SELECT l_orderkey AS job, l_linenumber AS name, l_quantity AS ap, l_discount AS recall FROM lineitem")
def per_class_metrics(spark, d):
    lists = [F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_discount"))).alias("all")]
    packed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(*lists)
    packed = packed.select("job", F.col("all.l_linenumber").alias("name"), F.col("all.l_quantity").alias("ap"), F.col("all.l_discount").alias("recall"))
    return study.per_class(packed, "name", "ap", "recall")


@query("""
    WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_suppkey, (l_discount * 1000)::INTEGER AS x, (l_tax * 1000)::INTEGER AS y, l_quantity::INTEGER AS w, l_linestatus = 'O' AS ok, l_returnflag FROM lineitem),
    b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')
    SELECT CASE WHEN again > 1 THEN 'repeated' WHEN l_returnflag = 'A' THEN 'incomplete' WHEN o_orderkey IS NULL THEN 'background_outside_subset' WHEN s_suppkey IS NULL THEN 'candidate_not_approved' WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'background_changed'
        WHEN NOT (least(x, y) >= 1 AND least(w, 10) >= 4 AND x + w < 120 AND y + 10 < 120) THEN 'rectangle' WHEN x < 30 AND y < 30 THEN 'overlaps' ELSE 'valid' END AS problem, count(*) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY id) AS again FROM p WHERE ok) p LEFT JOIN b ON l_orderkey = o_orderkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s_suppkey GROUP BY ALL
""")
def blend_placements(spark, d):
    whole = lambda c: F.round(c).cast("int")
    placements = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("background"), F.when(F.col("l_returnflag") == "R", "P").otherwise("x").alias("mark"), F.col("l_suppkey").alias("candidate"),
        whole(F.col("l_discount") * 1000).alias("x"), whole(F.col("l_tax") * 1000).alias("y"), whole("l_quantity").alias("w"), F.lit(10).alias("h"), (F.col("l_linestatus") == "O").alias("approved"), F.lit("ann").alias("reviewer"), (F.col("l_returnflag") != "A").alias("placement_valid"),
    )
    target = F.array(F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.25).alias("x2"), F.lit(0.25).alias("y2")))
    backgrounds = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("background"), F.col("o_orderstatus").alias("sha256"), F.lit(120).alias("width"), F.lit(120).alias("height"), target.alias("targets"))
    # a placement recorded an order's status as its hash; that of returned ones differs where the order is P
    recorded = placements.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("background"), F.col("o_orderstatus").alias("status")), "background")
    recorded = recorded.withColumn("background_sha256", F.when((F.col("status") == "P") & (F.col("mark") == "P"), "old").otherwise(F.col("status"))).drop("status", "mark")
    candidates = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("candidate"), F.lit(0).alias("cls"))
    valid, bad = study.blends(recorded, backgrounds, candidates)
    return valid.select(F.lit("valid").alias("problem")).unionByName(bad.select(F.col("violation").alias("problem"))).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def composites_in_subset(spark, d):
    subset = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("stem"))
    return study.composites_within(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), subset, "l_orderkey", "stem")


@query("SELECT doc_id, 'h' AS hash FROM documents LEFT JOIN labels USING (doc_id) WHERE (n_chars >= 2000) IS DISTINCT FROM (quality = 1)")
def changed_records(spark, d):
    mark = lambda c: c.cast("string").alias("h")
    return study.changed_records(table(spark, d, "documents").select("doc_id", mark(F.col("n_chars") >= 2000)), table(spark, d, "labels").select("doc_id", mark(F.col("quality") == 1)), "doc_id", ["h"])


@query("""
    WITH l AS (SELECT user_id, event_id, epoch(ts) - first_value(epoch(ts)) OVER w AS t, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, coalesce(lag(floor(t / 86400)) OVER (PARTITION BY user_id ORDER BY event_id) <> floor(t / 86400), true) AS new FROM l)
    SELECT user_id, event_id, round(100 * n / total, 6) AS percent, round(CASE WHEN t > 0 THEN (n - 1) / t END, 9) AS rate FROM s WHERE new OR last
""")
def progress_ticks(spark, d):
    from pyspark.sql import Window

    log = table(spark, d, "events").select("user_id", "event_id", "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    log = log.withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    found = study.progress(log, "user_id", "event_id", "ts", "n", "total", 86400)
    return found.select("user_id", "event_id", F.round("percent", 6).alias("percent"), F.round("rate", 9).alias("rate"))


#: Sources that a configuration names.
MOST_SOURCES = 1000


@query("SELECT source, lang, CASE lang WHEN 'en' THEN 'a' WHEN 'de' THEN 'b' END AS target, CASE WHEN lang NOT IN ('en', 'de') THEN 'unmapped_class:' || lang END AS issue, count(*) AS n FROM documents GROUP BY ALL")
def class_remap(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("lang").alias("raw"))
    sources = docs.select("source").distinct().limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"a configuration of more than {MOST_SOURCES} sources; join a table of classes instead")
    found = study.remapped(docs, study.class_map(spark, {r["source"]: {"en": "a", "de": "b"} for r in sources}))
    return found.groupBy("source", F.col("raw").alias("lang"), "target", "issue").agg(F.count("*").alias("n"))
