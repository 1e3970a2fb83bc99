import hashlib
import re

from pyspark.sql import functions as F

from siltworks.llm import exact_dedup

ROWS = [
    (5, "a b", "x"), (3, "a\tb", "y"), (9, "a \n b", "z"), (4, " a b", "x"), (1, None, "n"), (2, "", "n"), (7, " ", "s"), (8, "\r\n", "s"),
    (None, "a b", "q"), (None, "only null", "q"), (6, "A b", "x"), (3, "a b", "again"), (3, "other", "w"), (11, "é  ü", "u"), (12, "é\x0b\x0cü", "u"), (13, "w " * 60000, "long"), (14, "a\xa0b", "x"),
]


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, (key, text, _) in enumerate(rows):
        groups.setdefault(norm(text), []).append((key is None, key or 0, i))
    out = []
    for text, members in groups.items():
        members.sort()
        for m in members:
            keep = None if members[0][0] else members[0][1]
            out.append((rows[m[2]][0], keep, len(members), m == members[0], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(5)
    for salts in (1, 16):
        assert sorted(map(tuple, exact_dedup.groups(docs, salts=salts).collect()), key=repr) == brute(ROWS)
    assert exact_dedup.groups(docs.limit(0)).collect() == []


def test_equal_digests_of_different_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(5)
    weak = lambda c: F.substring(exact_dedup.sha256(c), 1, 1)
    assert sorted(map(tuple, exact_dedup.groups(docs, digest=weak).collect()), key=repr) == brute(ROWS)


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text")).repartition(8)
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.lit(0)).collect()]
    assert sorted(map(tuple, exact_dedup.groups(docs).collect()), key=repr) == brute(rows)


def test_deduplicate(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, __extra string").repartition(5)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    want = sorted((k, norm(t)) for k, t in {(r[0], next(x for x in ROWS if hashlib.sha256(norm(x[1]).encode()).hexdigest() == r[4])[1]) for r in brute(ROWS) if r[3]} if k is not None)
    assert sorted((r.doc_id, norm(r.text)) for r in got.collect() if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got.collect()) == 1


def test_plan_is_native(spark):
    plan = exact_dedup.groups(spark.createDataFrame(ROWS, "doc_id long, text string, kept string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
