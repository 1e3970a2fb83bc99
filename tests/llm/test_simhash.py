import random

import numpy as np
from tests_llm_shared import brute_components as brute
from tests_llm_shared import reference_print

from siltworks.llm import simhash


def test_fingerprint_definition():
    for text in (None, "", " \t\n", "One", "one two", "A b C d", "É à x y z q\x0bw", "same same same same", "a b c " * 40000):
        assert simhash.fingerprint(text) == reference_print(text)


def test_fingerprint_equals_spark_hash(spark):
    got = spark.range(1).selectExpr("xxhash64('a b c') h").first()[0]
    assert simhash.fingerprint("a b c") == got % 2**64


def clusters(rng, n):
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6, 40])):
            x = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << b
            out.append(x)
            if rng.random() < 0.3:
                base = x
    return out[:n]


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    prints = list(enumerate(clusters(rng, 1200)))
    rng.shuffle(prints)
    want = dict(zip((k for k, _ in prints), brute(prints)))
    frame = spark.createDataFrame([(k, x - 2**64 if x >= 2**63 else x) for k, x in prints], "id long, fp long")
    distinct = frame.groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "first")
    from siltworks.operators.components import connected_components

    for per_shard in (50, 10_000):
        edges = simhash.links(distinct, distinct.count(), per_shard=per_shard, sample=700)
        comp = {r.vertex: r.component for r in connected_components(edges).collect()}
        groups = {}
        for r in frame.collect():
            groups.setdefault(comp.get(r.fp, r.fp), []).append(r.id)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == want


def test_dense_group_gives_a_forest():
    rng = np.random.default_rng(0)
    base = np.uint64(0x123456789ABCDEF0)
    points = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))], np.uint64))
    label = simhash.link(points, len(points), 3)
    assert (label == label[0]).all()


def test_components_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "y"), (None, "lonely words stand here", None), (9, "alpha beta gamma delta", "z"), (9, "alpha beta gamma delta", "z"), (7, "ALPHA beta\tgamma\n delta", "w"), (11, "q " * 30000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id), r.fingerprint, r.component_id) for r in simhash.components(docs).collect())
    prints = [(d, reference_print(t)) for d, t, _ in rows]
    want = sorted(((d is None, d), f"{x:016x}", c) for (d, x), c in zip(prints, brute(prints)))
    assert [(k[0], k[1] or 0, f, c) for k, f, c in got] == [(k[0], k[1] or 0, f, c) for k, f, c in want]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for (d, _), c in zip(prints, brute(prints)) if d == c and d is not None})
    assert simhash.components(docs.limit(0)).collect() == []
