import pytest
from pyspark.sql import functions as F

from siltworks.operators import selection, workflow


def test_jobs(spark):
    jobs = workflow.grid(spark.createDataFrame([("s1",), ("s2",)], "subset string"), ["real", "aug"], ["m"])
    assert {r.job for r in jobs.collect()} == {"s1_real_m", "s1_aug_m", "s2_real_m", "s2_aug_m"}
    with pytest.raises(ValueError, match="differ"):
        workflow.grid(jobs, ["a", "a"], ["m"])
    status = spark.createDataFrame([("s1_real_m", "val", "complete"), ("s1_aug_m", "val", "failed"), ("s2_real_m", "val", "blocked_review")], "job string, split string, state string")
    names = lambda *a, **k: {r.job for r in workflow.eligible(jobs, status, *a, **k).collect()}
    # a job that waits for a review stays eligible
    assert names() == {"s2_aug_m", "s2_real_m"} and names(retry_failed=True) == {"s2_aug_m", "s2_real_m", "s1_aug_m"} and names("test") == {"s1_real_m"}
    changes = spark.createDataFrame([("s1_aug_m", "val", "running", 1), ("s1_aug_m", "val", "complete", 2), ("new", "val", "running", 1)], "job string, split string, state string, seq int")
    assert {r.job: r.state for r in workflow.advance(status, changes).collect()} == {"s1_real_m": "complete", "s1_aug_m": "complete", "s2_real_m": "blocked_review", "new": "running"}


def test_decisions(spark):
    rows = spark.createDataFrame([(1, None, None), (2, True, "ann"), (3, False, "ann")], "id int, approved boolean, reviewer string")
    good = spark.createDataFrame([(1, True, "bob", True, True)], "id int, approved boolean, reviewer string, defect_present boolean, class_correct boolean")
    done, bad = workflow.decide(rows, good, "candidate")
    assert bad.collect() == [] and {r.id: (r.approved, r.reviewer) for r in done.collect()} == {1: (True, "bob"), 2: (True, "ann"), 3: (False, "ann")}
    assert tuple(workflow.outcomes(done).first()) == (2, 1, 0)
    wrong = spark.createDataFrame([(1, True, "bob", False, True), (9, False, "bob", None, None), (2, True, "", True, True), (2, False, "x", None, None)], good.schema)
    assert sorted((r.violation, r.key) for r in workflow.decide(rows, wrong, "candidate")[1].collect()) == [("incomplete", "1"), ("incomplete", "2"), ("repeated", "2"), ("unknown", "9")]
    again = workflow.rescreened(done, F.lit("new"), ["approved", "reviewer"]).collect()
    assert all(r.approved is None and r.screening == "new" for r in again)


def test_receipts_and_imports(spark):
    rows = spark.createDataFrame([(1, "s", "f", "pass", None), (2, "s", "f", "pass", None), (1, "t", "f", "pass", None), (1, "s", "g", "pass", None), (1, "s", "f", "reject", None), (1, "s", "f", "needs_review", None), (1, "s", "f", "needs_review", "fine"), (None, None, None, None, None)], "version int, stage string, fingerprint string, outcome string, reason string")
    problem = workflow.receipt_problem({c: F.col(c) for c in ("version", "stage", "fingerprint", "outcome")}, 1, "s", F.lit("f"), F.col("reason"))
    assert [r[0] for r in rows.select(problem).collect()] == [None, "version", "stage", "stale", "rejected", "needs a reason", None, "missing"]
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "name string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "name string, sha string")
    assert sorted((r.violation, r.key) for r in workflow.imported(a, b, "name", ["sha"]).collect()) == [("changed", "y"), ("extra", "w"), ("missing", "z")]


def test_samples(spark):
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 5)], "g string, k int")
    assert sorted((r.g, r.k) for r in selection.at_ranks(rows, "g", "k").collect()) == [("a", 0), ("a", 2), ("a", 4), ("a", 6), ("a", 8), ("b", 5)]
    assert selection.seeded_sample(rows, "k", 4, 1).count() == 4


def test_study_tables(spark):
    from siltworks.operators import study

    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    metrics = spark.createDataFrame([("a", "val", 0.5, "p")], "job string, split string, map double, plan_identity string")
    rows, coverage = study.run_rows(jobs, spark.createDataFrame([("a", "complete")], "job string, state string"), metrics, "p")
    assert [r.job for r in rows.collect()] == ["a"] and {r.job: r.state for r in coverage.collect()} == {"a": "complete", "b": "pending"}
    with pytest.raises(Exception, match="another study"):
        study.run_rows(jobs, coverage.select("job", "state"), metrics, "q")[0].collect()
    log = spark.createDataFrame([("s", i, t, i, 10) for i, t in ((1, 0), (2, 1), (3, 5), (4, 6), (5, 12))], "s string, step long, t long, done long, total long").selectExpr("s", "step", "timestamp_seconds(t) at", "done", "total")
    shown = {r.step: (r.percent, r.rate, r.eta) for r in study.progress(log, "s", "step", "at", "done", "total", 5).collect()}
    assert shown.keys() == {1, 3, 5} and shown[1] == (10, None, None) and shown[5] == (50, pytest.approx(4 / 12), pytest.approx(15))
    rows = spark.createDataFrame([(i, ["x", "y"], [0.1, 0.2], [1, 2]) for i in range(2)], "id long, names array<string>, ap array<double>, n array<int>")
    assert sorted((r.id, r.names, r.ap, r.n) for r in study.per_class(rows, "names", "ap", "n").collect()) == [(i, c, a, n) for i in range(2) for c, a, n in (("x", 0.1, 1), ("y", 0.2, 2))]
    assert spark.range(1).select(study.ema_keep(F.lit(0), 0.9).alias("k"), study.kimg(F.lit(500), 4).alias("g")).first() == (0.1, 2.0)


def test_screening_by_stage(spark):
    from siltworks.operators import screening

    rows = spark.createDataFrame([("i", "p", "s", 1, "w", 5)], "id string, path string, sha256 string, class_id int, class_name string, width int")
    assert "class_name" in screening.subject(rows, "candidates").first().subject and "width" in screening.subject(rows, "composites").first().subject
    for call in (lambda: screening.subject(rows, "other"), lambda: screening.screen(rows, "other", [])):
        with pytest.raises(ValueError, match="stage"):
            call()
    found = spark.createDataFrame([("a", 0, "pass"), ("a", 0, "pass"), ("b", 0, "reject")], "id string, class_id int, outcome string")
    kept, bad = screening.passed(found, 2)
    assert kept.count() == 2 and sorted((r.violation, r.key) for r in bad.collect()) == [("class_missing", "1"), ("repeated", "a")]
