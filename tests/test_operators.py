import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import matching, measures, neardup, quality_gates, selection, statistics
from siltworks.operators.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (200, 150), (60, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1)]
        edges += [(i, i + 1) for i in range(n, n + 40)] + [(n + 100, i) for i in range(n + 101, n + 140)]  # a path and a star
        at = {}

        def find(x):
            while at.setdefault(x, x) != x:
                x = at[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                a, b = sorted((find(a), find(b)))
                at[b] = a
        got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(at)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_band_join_is_exact(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(64)) for i in range(60)]
    rows += [(100 + i, x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for i, x in rows] + [(300, 0), (301, 255), (302, 254), (303, 2**64 - 1)]
    frame = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in rows], "id long, bits long")
    for within in (0, 1, 2, 5, 6, 20):
        want = {(i, j, (x ^ y).bit_count()) for (i, x), (j, y) in itertools.combinations(sorted(rows), 2) if (x ^ y).bit_count() <= within}
        assert sorted(map(tuple, neardup.hamming_join(frame, frame, "id", "bits", within, ordered=True).collect())) == sorted(want)
    for within, block in ((5, 8192), (20, 8192), (20, 25), (24, 25)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        whole = neardup.hamming_join(frame, frame, "id", "bits", within, ordered=True).select("a", "b")
        some = neardup.links(frame, "id", "bits", within)
        parts = lambda edges: {tuple(r) for r in connected_components(edges).collect()}
        assert parts(some) == parts(whole)
        first = {r.id: r.near for r in neardup.first_earlier(frame, "id", "bits", within).collect()}
        want: dict = {}
        for a, b in sorted(tuple(r) for r in whole.collect()):
            want.setdefault(b, a)
        assert first == want
    monkeypatch.setattr(neardup, "BLOCK", 8192)
    edges = neardup.hamming_join(frame, frame, "id", "bits", 1, ordered=True).select("a", "b")
    assert (301, 302) in {tuple(r) for r in edges.collect()}
    assert {r.id for r in neardup.within_reach(frame.where("id = 301"), frame.where("id = 302"), "id", "bits", 1).collect()} == {301}


def test_status_and_gates(spark):
    row = spark.createDataFrame([("approve", True, False), ("approve", False, False), ("exclude", False, False), (None, None, True), (None, None, False)], "action string, complete boolean, empty boolean")
    no = F.lit(False)
    status = quality_gates.review_status(no, no, no, F.col("action"), F.col("complete"), no, F.col("empty"), False)
    assert [r[0] for r in row.select(status).collect()] == ["approved", "quarantine_incomplete_approval", "excluded_review", "quarantine_empty", "provisional"]
    assert row.select(quality_gates.stale([(F.lit(None), F.lit("")), (F.lit("a"), F.lit("a"))])).first()[0] is False
    with pytest.raises(ValueError, match="left"):
        quality_gates.require_empty(quality_gates.set_differences(spark.range(3), spark.range(2), "id"), "keys")


def test_greedy_and_confusion(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    p = spark.createDataFrame([("i", 0, 0.9, *box), ("i", 0, 0.8, *box), ("i", 1, 0.7, *box), ("k", 0, 0.5, *box)], matching.PREDICTIONS)
    t = spark.createDataFrame([("i", 0, *box), ("i", 1, 5.0, 5.0, 6.0, 6.0), ("j", 1, *box)], matching.TARGETS)
    got = {(r.cid, r.tp, r.fp, r.fn, r.recall) for r in measures.counts(matching.greedy(p.where("image = 'i'"), t.where("image = 'i'"))).collect()}
    assert got == {(0, 1, 1, 0, 1.0), (1, 0, 1, 1, 0.0)}
    cells = sorted((r.image, r.truth, r.predicted) for r in matching.confusion(p, t, 2).collect())
    assert cells == [("i", 0, 0), ("i", 1, 2), ("i", 2, 0), ("i", 2, 1), ("j", 1, 2), ("k", 2, 0)]
    near = t.withColumn("x1", F.col("x1") + 0.01)
    assert {r.same for r in matching.same_boxes(near, t).collect()} == {True}
    assert {r.image: r.same for r in matching.same_boxes(near.withColumn("x1", F.col("x1") + 0.1), t).collect()} == {"i": False, "j": False}


def test_average_precision(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.random(), int(rng.random() < 0.4)) for k in ("a", "b") for i in range(80)] + [("none", 0, 0.5, 0)]
    got = {r.k: r.ap for r in measures.average_precision(spark.createDataFrame(rows, "k string, i long, s double, h int"), "s", "h", "i", by=["k"]).collect()}
    for k in ("a", "b"):
        ranked = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        tp = np.cumsum([r[3] for r in ranked])
        precision = np.maximum.accumulate((tp / np.arange(1, len(tp) + 1))[::-1])[::-1]
        recall = tp / tp[-1]
        want = np.mean([max((p for p, r in zip(precision, recall) if r >= q - 1e-12), default=0) for q in np.linspace(0, 1, 101)])
        assert got[k] == pytest.approx(want)
    assert got["none"] == -1


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert [r.adjusted for r in statistics.holm(rows, "p", "k").orderBy("k").collect()] == pytest.approx([0.03, 0.06, 0.06, None])
    one = statistics.summary(spark.createDataFrame([("x", 1.0), ("y", 1.0), ("y", 3.0), ("y", None)], "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert (one[0].n, one[0].sd, one[0].ci_low) == (1, None, None)
    assert one[1].ci_high == pytest.approx(2 + 12.7062047364 * 2**0.5 / 2**0.5, abs=1e-6)
    assert statistics.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert statistics.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == pytest.approx(0.0625)
    runs = spark.createDataFrame([(s, a, 1.0) for s in range(3) for a in ("ref", "new")], "seed long, arm string, v double")
    r = statistics.paired_tests(statistics.paired(runs, ["seed"], "arm", "ref", "v"), ["arm"]).first()
    assert (r.n_pairs, r.t_p, r.dz, r.wilcoxon_p, r.rank_biserial) == (3, 1.0, None, 1.0, 0.0)
    counts = spark.createDataFrame([(i, i % 4, 1, 2) for i in range(20)], "g long, tp long, fp long, fn long")
    ci = {r.measure: (r.low, r.high) for r in statistics.group_bootstrap(counts, "g", 300).collect()}
    rng, table, pooled = np.random.default_rng(1234), np.array([[i % 4, 1, 2] for i in sorted(range(20), key=str)], float), []
    for _ in range(300):  # one resample after the other
        tp, fp, fn = table[rng.integers(20, size=20)].sum(axis=0)
        pooled.append((tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)))
    for name, values in zip(("precision", "recall", "f1"), zip(*pooled)):
        assert ci[name] == pytest.approx(tuple(np.quantile(values, (0.025, 0.975))))
    assert statistics.group_bootstrap(counts.limit(1), "g", 10).first().low is None
    classes = counts.withColumn("c", F.lit("b")).unionByName(counts.withColumn("c", F.lit("a")).withColumn("fp", F.lit(0)))
    both = {(r.c, r.measure): (r.low, r.high) for r in statistics.group_bootstrap(classes, "g", 300, by="c").collect()}
    assert both["b", "f1"] == ci["f1"] and both["a", "precision"] == (1.0, 1.0) and both["a", "recall"] == ci["recall"]
    for n in (5, 14, 20):  # against all sign patterns, or the sums of a few
        d = np.arange(1, n + 1) * np.where(np.arange(n) % 3 == 0, -1.0, 1.0)
        low, ways = min(d[d > 0].sum(), -d[d < 0].sum()), {0: 1}
        for r in range(1, n + 1):
            new = dict(ways)
            for total, many in ways.items():
                new[total + r] = new.get(total + r, 0) + many
            ways = new
        assert statistics.wilcoxon(d) == pytest.approx(min(1, 2 * sum(m for t, m in ways.items() if t <= low) / 2**n))


def test_percentiles_and_places(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, 1.0, 2.5, rng.random(), float("nan"), None])) for _ in range(500)] + [("one", 3.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.p5, r.p50, r.p95) for r in statistics.percentiles(frame, ["k"], "v", [0.05, 0.5, 0.95]).collect()}
    for k in got:
        values = [v for q, v in rows if q == k and v is not None and v == v]
        assert got[k] == pytest.approx(tuple(np.quantile(values, (0.05, 0.5, 0.95))))
    assert len(got) == 4
    placed = selection.running(spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(400)], "i long, k long"), ["k"], [F.desc("i") if False else -F.col("i")], "place", buckets=7).collect()
    for k in (None, 0, 1, 2):
        own = sorted((r.place, r.i) for r in placed if r.k == k)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [i for _, i in own] == sorted((i for _, i in own), reverse=True)


def brute_report(predictions, targets, areas, limits):
    """Matching and accumulation as the measure is defined, one image, class, area and threshold at a time."""
    def over(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    images, classes = sorted({r[0] for r in targets + predictions}), sorted({r[1] for r in targets})
    ap, recall = {}, {}
    for area, (low, high) in areas.items():
        for c in classes:
            if not any(low <= size(t[2:]) <= high for t in targets if t[1] == c):
                continue
            for ti in range(10):
                scored, positives = [], 0
                for image in images:
                    gt = sorted(((not low <= size(t[2:]) <= high, i, t[2:]) for i, t in enumerate(t for t in targets if t[:2] == (image, c))), key=lambda g: g[0])
                    positives += sum(not g[0] for g in gt)
                    dt = sorted((p for p in predictions if p[:2] == (image, c)), key=lambda p: -p[2])[: max(limits)]
                    used = set()
                    for place, p in enumerate(dt):
                        best, pick = min(0.5 + 0.05 * ti, 1 - 1e-10), None
                        for g, (ignored, _, box) in enumerate(gt):
                            if g in used or over(p[3:], box) < best:
                                continue
                            if pick is not None and not gt[pick][0] and ignored:
                                break
                            best, pick = over(p[3:], box), g
                        if pick is not None:
                            used.add(pick)
                        ignore = gt[pick][0] if pick is not None else not low <= size(p[3:]) <= high
                        if not ignore:
                            scored.append((-p[2], image, place, pick is not None))
                for most in limits:
                    hits = np.array([h for _, _, place, h in sorted(scored) if place < most], float)
                    tp = np.cumsum(hits)
                    precision = np.maximum.accumulate((tp / np.arange(1, len(tp) + 1))[::-1])[::-1]
                    at = np.searchsorted(tp / positives, np.linspace(0, 1, 101) - 1e-12)
                    ap[area, c, ti, most] = np.mean([precision[i] if i < len(tp) else 0 for i in at])
                    recall[area, c, ti, most] = hits.sum() / positives
    top = max(limits)
    mean = lambda d, keep: np.mean([v for k, v in d.items() if keep(*k)])
    out = {"map50_95": mean(ap, lambda a, c, t, m: a == "all" and m == top), "map50": mean(ap, lambda a, c, t, m: a == "all" and m == top and t == 0), "map75": mean(ap, lambda a, c, t, m: a == "all" and m == top and t == 5)}
    out |= {f"ap_{name}": mean(ap, lambda a, c, t, m: a == name and m == top) for name in areas}
    return out | {f"ar{limit}": mean(recall, lambda a, c, t, m: a == "all" and m == limit) for limit in limits}


def test_detection_report(spark):
    rng = np.random.default_rng(11)
    targets, predictions = [], []
    for i in range(25):
        for _ in range(rng.integers(0, 5)):
            x, y, w, h = *rng.uniform(0, 60, 2), *rng.uniform(3, 40, 2)
            c = int(rng.integers(3))
            targets.append((f"i{i:02}", c, x, y, x + w, y + h))
            for _ in range(rng.integers(0, 3)):
                move = rng.normal(0, 2, 4)
                predictions.append((f"i{i:02}", c if rng.random() < 0.9 else 2, float(rng.random()), x + move[0], y + move[1], x + w + abs(move[2]), y + h + abs(move[3])))
    areas, limits = {"all": (0, 1e10), "small": (0, 300), "large": (300, 1e10)}, (1, 2, 100)
    frames = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in p) for p in predictions], matching.PREDICTIONS), spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in t) for t in targets], matching.TARGETS)
    got = {r.measure: r.value for r in measures.detection_report(matching.graded(*frames, areas, limits)).collect()}
    assert got == pytest.approx(brute_report(predictions, targets, areas, limits), abs=1e-8)


def test_matching_side_by_side(spark):
    """Ties, limits of places and ignored targets in groups of all sizes: as one loop over each group."""
    rng = np.random.default_rng(3)
    for last in (True, False):
        group, t_group = np.sort(rng.integers(0, 30, 120)), np.sort(rng.integers(0, 40, 90))
        corner = lambda n: rng.integers(0, 3, (n, 2)).astype(float)
        box, t_box = (np.hstack([c, c + 2]) for c in (corner(120), corner(90)))
        limits, ignored = np.array([0.1, 0.3, 0.9]), rng.random((2, 90)) < 0.3
        got = matching.assign(group, box, t_group, t_box, limits, ignored, last=last)
        for a in range(2):
            for k, limit in enumerate(limits):
                free = np.ones(90, bool)
                for i in range(120):
                    over = matching.overlaps(np.repeat(box[i : i + 1], 90, 0), t_box)
                    fits = free & (t_group == group[i]) & (over >= limit)
                    best = max(np.flatnonzero(fits), key=lambda j: (not ignored[a, j], over[j], j if last else -j), default=-1)
                    assert got[a, k, i] == best
                    free[best] &= best < 0


def test_detections_are_ordered_once(spark):
    """One row for each detection whatever the thresholds and areas, which used to be one row each of these in the order."""
    p = spark.createDataFrame([(f"i{i}", i % 2, i / 40, 0.0, 0.0, 1.0, 1.0 + i / 20) for i in range(40)], matching.PREDICTIONS)
    graded = matching.graded(p, p.drop("conf"), areas={"all": (0, 1e10), "small": (0, 2), "large": (2, 1e10)})
    assert graded.where("state = 'detection'").count() == 40


def test_selection(spark):
    groups, table = [f"g{i}" for i in range(60)], np.tile([2.0, 1, 1], (60, 1))
    picks = selection.nested_subsets(groups, table, [1, 0.5, 0.1], 3, 2)
    assert set(picks[0.1]) < set(picks[0.5]) < set(picks[1]) and len(picks[1]) == 60 and len(picks[0.5]) == 30
    assert picks == selection.nested_subsets(groups, table, [1, 0.5, 0.1], 3, 2) != selection.nested_subsets(groups, table, [1, 0.5, 0.1], 4, 2)
    with pytest.raises(ValueError, match="no room"):
        selection.nested_subsets(groups, table, [0.01], 0, 5)
    with pytest.raises(ValueError, match="differ"):
        selection.nested_subsets(groups, table, [0.5, 0.5], 0, 1)
    split = selection.grouped_split([f"g{i}" for i in range(10)], np.tile([10.0, 5], (10, 1)))
    assert [sum(v == s for v in split.values()) for s in (0, 1, 2)] == [7, 1, 2]
    many = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "g string, c string")
    names, sums = selection.totals_of(many, "g", {"x": (F.col("c") == "x").cast("int")})
    assert names == [None, "a", "b"] and sums.tolist() == [[1, 1], [2, 1], [1, 1]]
    rows = spark.createDataFrame([(i, "rare" if i > 17 else "common") for i in range(20)], "k long, c string")
    assert {r.k for r in selection.coverage_sample(rows, "c", "k", 9).collect()} == {0, 18, *range(1, 8)}
    few, many = ({r.k for r in selection.nested_prefix(rows, "c", "k", x).collect()} for x in (0.2, 0.7))
    assert few < many and len(few) == 5
    assert selection.place([(0, 0, 100, 100)], (20, 20), (100, 100), np.random.default_rng(0)) is None
    x, y = selection.place([(0, 0, 50, 100)], (20, 20), (100, 100), np.random.default_rng(0))
    assert x >= 50
