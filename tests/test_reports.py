import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import group_identity, matching, measures, quality_gates, selection, statistics, workflow


def test_group_ids(spark):
    rows = [(g, f"m{i * 7919 % 5000}é") for i in range(5000) for g in ("hot",)] + [("a", "y"), ("a", "x"), ("a", "x"), ("b", None), (None, "z"), ("c", "q")]
    got = {r.group: (r.members, r.group_id) for r in group_identity.group_ids(spark.createDataFrame(rows, "group string, member string").repartition(7), "group", "member").collect()}
    want = {}
    for g, m in rows:
        if m is not None:
            want.setdefault(g, []).append(m)
    assert got == {g: (len(m), hashlib.sha256("\n".join(sorted(m, key=str.encode)).encode()).hexdigest()[:20]) for g, m in want.items()}


def test_subset_ids(spark):
    rows = [(i % 3, f"s{i:03d}", f'h"{i}') for i in range(50)]
    got = {r.k: (r.rows, r.identity) for r in group_identity.subset_ids(spark.createDataFrame(rows, "k int, stem string, sha string"), "k", ["stem", "sha"]).collect()}
    for k in range(3):
        some = [{"sha": h, "stem": s} for i, s, h in sorted(rows, key=lambda r: r[1]) if i == k]
        assert got[k] == (len(some), hashlib.sha256(json.dumps(some, sort_keys=True, separators=(",", ":")).encode()).hexdigest())


def test_spread_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i}", c, *map(int, rng.integers(0, 6, 3))) for i in range(90) for c in ("p", "q") if i % 7 or c == "p"]
    frame = spark.createDataFrame(rows, "g string, c string, tp long, fp long, fn long")
    blocks, repetitions, seed = 5, 200, 9
    dealt = {r.g: r.b for r in frame.select("g", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int").alias("b")).distinct().collect()}
    members = [sorted(g for g in dealt if dealt[g] == b) for b in range(blocks)]
    sizes = np.array([len(m) for m in members])
    table = {(g, c): np.array(v, float) for g, c, *v in rows}
    sums = {c: np.zeros((repetitions, 3)) for c in "pq"}
    for r in range(repetitions):
        shares = np.random.default_rng([seed, r]).multinomial(sizes.sum(), sizes / sizes.sum())
        assert shares.sum() == 90
        for b, m in enumerate(members):
            for pick in np.random.default_rng([seed, r, b]).integers(len(m), size=shares[b]) if m else ():
                for c in "pq":
                    sums[c][r] += table.get((m[pick], c), 0)
    got = {(r.c, r.measure): (r.low, r.high) for r in statistics.spread_bootstrap(frame, "g", repetitions, seed, by="c", blocks=blocks).collect()}
    for c in "pq":
        tp, fp, fn = sums[c].T
        for measure, v in {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn)}.items():
            assert np.allclose(got[c, measure], np.quantile(v, (0.025, 0.975)))
    whole = {r.measure: (r.low, r.high) for r in statistics.group_bootstrap(frame, "g", 400).collect()}
    for r in statistics.spread_bootstrap(frame, "g", 400).collect():
        assert abs(r.low - whole[r.measure][0]) < 0.02 and abs(r.high - whole[r.measure][1]) < 0.02
    assert {r.low for r in statistics.spread_bootstrap(frame.where("g = 'g1'"), "g", 10).collect()} == {None}


def boxes(spark):
    targets = [(f"i{i}", i % 3, 10.0 * k, 0.0, 10.0 * k + 8, 8.0) for i in range(12) for k in range(3)] + [("i0", 5, 50.0, 50.0, 60.0, 60.0)]
    predictions = [(f"i{i}", i % 3, 0.9 - 0.05 * k - 0.01 * i, 10.0 * k + 1.2 * k * (i % 2), 0.0, 10.0 * k + 8, 8.0) for i in range(12) for k in range(3)] + [("i1", 1, 0.95, 90.0, 90.0, 95.0, 95.0), ("i1", 7, 0.5, 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(predictions, matching.PREDICTIONS), spark.createDataFrame(targets, matching.TARGETS)


def test_class_report_and_curves(spark):
    graded = matching.graded(*boxes(spark), areas={"all": (0, 1e10)}, most=(1, 10))
    report = {r.cid: r for r in measures.class_report(graded).collect()}
    assert set(report) == {0, 1, 2, 5} and report[5][1:] == (1, 0.0, 0.0, 0.0)
    curves = {}
    for r in measures.detection_curves(graded).collect():
        curves.setdefault(r.cid, {})[r.point] = r.precision
    assert set(curves) == set(report) and all(set(c) == set(range(101)) for c in curves.values())
    for cid, c in curves.items():
        assert abs(sum(c.values()) / 101 - report[cid].ap50) < 1e-9
        assert all(c[k] >= c[k + 1] for k in range(100))
    whole = {r.measure: r.value for r in measures.detection_report(graded).collect()}
    assert abs(whole["map50_95"] - np.mean([r.ap50_95 for r in report.values()])) < 1e-8
    assert abs(whole["map50"] - np.mean([r.ap50 for r in report.values()])) < 1e-8 and abs(whole["ar10"] - np.mean([r.ar_max for r in report.values()])) < 1e-8


def test_curves_without_targets(spark):
    rows = spark.createDataFrame([("a", 0.9, 1, 1), ("a", 0.8, 0, 2), ("a", 0.7, 1, 3), ("b", 0.5, 0, 4)], "k string, s double, hit int, id int")
    got = {(r.k, r.point): r.precision for r in measures.precision_curves(rows, "s", "hit", "id", ["k"]).collect()}
    assert {got["b", i] for i in range(101)} == {-1.0}
    assert [got["a", i] for i in (0, 50)] == [1.0, 1.0] and abs(got["a", 51] - 2 / 3) < 1e-12 and len(got) == 202


def test_rates_report(spark):
    counted = spark.createDataFrame([("a", 3, 1, 0), ("b", 0, 0, 2)], "cid string, tp long, fp long, fn long")
    got = {(r.scope, r.name): r for r in measures.rates_report(counted).collect()}
    assert got["micro", None][2:] == (3, 1, 2, 0.75, 0.6, 6 / 9)
    assert abs(got["macro", None].f1 - (6 / 7) / 2) < 1e-12 and got["class", "b"].precision == 0.0 and got["class", "b"].recall == 0.0


def test_covering_sample(spark):
    rows = [("b", [1]), ("a", [1, 2]), ("c", [3]), ("d", []), ("e", [2, 3]), ("f", None), ("g", [4])]
    frame = spark.createDataFrame(rows, "k string, classes array<int>")
    pick = lambda limit, expected=None: sorted(r.k for r in selection.covering_sample(frame, "classes", "k", limit, expected).collect())
    assert pick(2) == ["a", "c", "g"] and pick(5) == ["a", "b", "c", "d", "g"] and pick(99, [1, 2, 3, 4]) == list("abcdefg")
    with pytest.raises(ValueError, match="no row has 5"):
        pick(3, [1, 5])
    with pytest.raises(ValueError):
        selection.nested_prefix(frame, "k", "k", 5.0)


def test_keys_are_compared_by_column(spark):
    rows = spark.createDataFrame([("a/b", "c"), ("a", "b/c"), (None, "z"), ("z", None), ("q", "q"), ("q", "q"), (None, "n"), (None, "n")], "x string, y string")
    assert sorted((r.key, r.rows) for r in quality_gates.repeated(rows, ["x", "y"], "again").collect()) == [("n", 2), ("q/q", 2)]


def test_eligible(spark):
    jobs = spark.createDataFrame([(j, "m1" if j < 5 else "m2", "x") for j in range(7)], "job int, model string, arm string")
    status = spark.createDataFrame([(0, "val", "complete"), (1, "val", "complete"), (2, "val", "failed"), (3, "val", "blocked_review"), (4, "val", "running"), (5, "val", "pending")], "job int, split string, state string")
    metrics = spark.createDataFrame([(0, "val"), (1, "test")], "job int, split string")
    pick = lambda **o: sorted(r.job for r in workflow.eligible(jobs, status, **o).collect())
    assert pick() == [3, 4, 5, 6] and pick(metrics=metrics) == [1, 3, 4, 5, 6] and pick(retry_failed=True, models=["m1"]) == [2, 3, 4]
    assert pick(arms=["y"]) == [] and workflow.eligible(jobs, status).columns == jobs.columns


def test_contrasts_without_pairs(spark):
    runs = spark.createDataFrame([("m", "ref", 1, 0.5), ("m", "ref", 2, 0.6), ("m", "a", 1, 0.7), ("m", "a", 2, 0.9), ("m", "b", 3, 0.1), (None, "a", 1, 0.2)], "model string, arm string, seed int, v double")
    tests = statistics.paired_tests(statistics.paired(runs, ["model", "seed"], "arm", "ref", "v"), ["model", "arm"])
    got = {(r.model, r.arm): r.n_pairs for r in statistics.with_unpaired(tests, runs, ["model", "arm"], "arm", "ref").collect()}
    assert got == {("m", "a"): 2, ("m", "b"): 0, (None, "a"): 0}
