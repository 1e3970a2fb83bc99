"""Reports whole: rates of classes and of all, precision curves, resampled intervals, samples that cover classes, identities of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import group_identity, matching, measures, selection, statistics
from ..session import table
from .queries import SQL_RATES, labelled, shifted_boxes
from .registry import query, rounded


@query(f"""
    WITH t AS (SELECT lang AS name, count(*) FILTER (WHERE quality = 1 AND n_chars >= 300) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= 300) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 300) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM t)
    SELECT 'class' AS scope, name, tp, fp, fn, {SQL_RATES} FROM t UNION ALL SELECT 'micro', NULL, tp, fp, fn, {SQL_RATES} FROM m
    UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, NULL, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) FROM t
""")
def rates_report(spark, d):
    said, true = F.col("n_chars") >= 300, F.col("quality") == 1
    hits = labelled(spark, d).withColumn("hit", F.when(said & true, "tp").when(said, "fp").when(true, "fn"))
    return rounded(measures.rates_report(measures.counts(hits, ["lang"]), "lang"), "precision", "recall", "f1")


@query("""
    WITH s AS (SELECT lang, n_chars, doc_id, quality FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT lang, sum(quality) OVER w AS tp, row_number() OVER w AS n, sum(quality) OVER (PARTITION BY lang) AS total FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)),
    e AS (SELECT lang, tp / total AS recall, tp / n AS precision, total FROM r),
    p AS (SELECT unnest(range(0, 101)) AS k)
    SELECT lang, k::INTEGER AS point, round(CASE WHEN any_value(total) > 0 THEN coalesce(max(CASE WHEN recall >= k / 100 - 1e-12 THEN precision END), 0) ELSE -1 END, 9) AS precision FROM e, p GROUP BY lang, k
""")
def precision_curves(spark, d):
    return rounded(measures.precision_curves(labelled(spark, d), "n_chars", "quality", "doc_id", ["lang"]), "precision")


def graded(spark, d):
    predictions, targets = shifted_boxes(spark, d)
    return matching.graded(predictions, targets, areas={"all": (0, 1e10)}, most=(1, 3, 100))


@query()
def class_report(spark, d):
    return rounded(measures.class_report(graded(spark, d)), "ap50", "ap50_95", "ar_max")


@query()
def detection_curves(spark, d):
    return rounded(measures.detection_curves(graded(spark, d)), "precision")


@query()
def spread_bootstrap(spark, d):
    """Intervals over the orders' own groups, each order being one."""
    hits = matching.greedy(*shifted_boxes(spark, d)).groupBy("image", "cid").agg(*[F.count_if(F.col("hit") == h).alias(h) for h in ("tp", "fp", "fn")])
    return rounded(statistics.spread_bootstrap(hits, "image", by="cid"), "low", "high")


COVERING = """
    WITH o AS (SELECT l_orderkey AS id, list_distinct(list(l_linenumber || l_returnflag)) AS classes FROM lineitem GROUP BY 1),
    f AS (SELECT c, min(id) AS id FROM (SELECT id, unnest(classes) AS c FROM o) GROUP BY c),
    k AS (SELECT id, id IN (SELECT id FROM f) AS new, row_number() OVER (PARTITION BY id IN (SELECT id FROM f) ORDER BY id) AS n FROM o)
    SELECT id FROM k WHERE new OR n <= 50 - (SELECT count(DISTINCT id) FROM f)
"""


@query(COVERING)
def covering_sample(spark, d):
    """Orders whose lines show every pair of line number and return flag, filled up to 50."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat("l_linenumber", "l_returnflag")).alias("classes"))
    return selection.covering_sample(rows, "classes", "id", 50).select("id")


@query("SELECT coalesce(source, '') AS source, count(*) AS members, substr(sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 20) AS group_id FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL")
def group_ids(spark, d):
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    return group_identity.group_ids(rows, "source", "doc_id")


@query("SELECT source, sha256('[' || string_agg('{\"doc_id\":' || doc_id || ',\"md5\":\"' || md5(coalesce(text, '')) || '\"}', ',' ORDER BY doc_id) || ']') AS identity, count(*) AS rows FROM documents GROUP BY ALL")
def subset_ids(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    return group_identity.subset_ids(rows, "source", ["doc_id", "md5"])
