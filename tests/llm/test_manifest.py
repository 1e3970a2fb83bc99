import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.llm import manifest

ROWS = [
    (5, "b", "en", 3, "a\nb"), (3, "b", None, 4, "x\ny\n"), (3, "b", "en", 4, "x"), (3, "b", "en", 4, "x"), (None, "b", "en", 1, "n\nn"), (1, None, None, None, None), (2, None, "de", 0, ""), (4, None, "de", 5, "é\nü"),
    (7, "", "en", 1, "-"), (8, "é", "en", 2, "w\n" * 50_000), (9, "z", "en", 1, "a"), (10, "z", "en", 1, "b\n"), (11, "z", "en", 1, "c"), (12, "z", "en", 1, "d\n"), (14, "only", "en", 1, "\n\n"),
]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes, fanout):
    """The root of some digests, and for each of them its runs: level by level (before, after)."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a - a % fanout
            steps[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], steps


def brute(rows, fanout=3):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in sources[s]], fanout)
    root, above = climb([trees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, above):
        for r, own in zip(sources[s], trees[s][1]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf((*r[:4], r[4].replace("\n", ""))) if cut else leaf(r)
            for before, after in own + top:
                h = sha(before + h + after)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(b + a for b, a in own + top)), h, h == root))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], f"{SCHEMA}, key int, kid int, proof int").repartition(5)
    got = sorted(map(tuple, manifest.check(docs).collect()), key=repr)
    assert got == brute(ROWS)
    assert {r[-1] for r in got} == {True, False}
    assert manifest.check(docs.limit(0)).collect() == []
    assert sorted(map(tuple, manifest.check(docs.where("doc_id = 14")).collect()), key=repr) == brute([r for r in ROWS if r[0] == 14])


def test_hot_source(spark):
    """Two thirds of all rows in one source, the others in sources of their own."""
    rows = [(i, "hot" if i % 3 else f"s{i}", "en", i, f"t\n{i % 7}") for i in range(700)]
    got = sorted(map(tuple, manifest.check(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("fanout", [2, 5])
def test_fanouts_and_proofs(spark, fanout):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows, root = manifest.build(docs, fanout=fanout)
    assert root.hex() == brute(ROWS, fanout)[0][3]
    folded = rows.select(manifest.fold(manifest.hexed(F.col("leaf")), F.col("proof")).alias("h"), F.size("proof").alias("n")).collect()
    assert {r.h for r in folded} == {root.hex()} and len(folded) == len(ROWS)


def test_no_python_worker_and_no_single_task(spark):
    plan = manifest.check(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|SinglePartition|CartesianProduct|BroadcastNestedLoop", plan)
