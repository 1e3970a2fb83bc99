import numpy as np
import pytest

from siltworks.llm import ann, queries

INF = float("inf")


def brute(ids, x, queries, k=20):
    out = {}
    for i in queries:
        at = int(np.flatnonzero(ids == i)[0])
        score = (x * x[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 24)) * 0.7).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    ids = np.arange(4000)
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int").repartition(4)
    got: dict = {}
    for r in ann.search(frame, frame.where("vec_id % 20 = 0"), id_col="vec_id", vec_col="embedding", leaf=30, per_shard=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(ids, x.astype(float), ids[ids % 20 == 0])
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        assert all(abs(s - (x[v].astype(float) * x[q].astype(float)).sum()) < 1e-12 for _, v, s in rows)
        hits += len({v for v, _ in want[q]} & {v for _, v, _ in rows})
    assert hits / (20 * len(want)) >= 0.9
    assert [v for _, v, _ in got[200]] == list(range(100, 120))


def test_queue_yields_the_leaves_within_the_bound():
    rng = np.random.default_rng(3)
    x = ann.Space(6.0).rows(rng.normal(size=(600, 8)))
    forest = ann.Forest(x, 5, trees=4, leaf=40)
    assert forest.depth == 4 and all(sorted(np.concatenate(m).tolist()) == list(range(600)) for m in forest.members)
    q = ann.Space.queries(rng.normal(size=(1, 8)))[0]
    worth = forest.priority(q, np.arange(600))
    for bound in (0.0, 0.02, 0.1, 0.5, 9.0):
        assert forest.search(q, 0.01, bound + 0.01).tolist() == np.flatnonzero(worth + 0.01 <= bound + 0.01).tolist()
    assert forest.search(q, 0.0, 9.0).tolist() == list(range(600))


def test_routing_priorities():
    rng = np.random.default_rng(4)
    x = ann.Space(6.0).rows(rng.normal(size=(500, 5)))
    below = ann.directions(2, 6, 1)
    normal, at = ann.plane(x, rng)
    tree = ann.Routing(normal[None, :], below, np.r_[at, rng.normal(size=6) * 0.1], 0.5)
    shard = tree.shard(x)
    assert tree.levels == 3 and set(shard) <= set(range(8)) and (x @ normal > at).tolist() == (shard >= 4).tolist()
    assert ann.medians(x @ below.T, 2)[0] == pytest.approx(np.median(x @ below[0]))
    q = ann.Space.queries(rng.normal(size=(1, 5)))[0]
    near = dict(tree.near(q, 99.0))
    assert len(near) == 8 and list(near.values()) == sorted(near.values())
    assert [tree.priority(q, i) for i in range(8)] == pytest.approx([near[i] for i in range(8)])
    assert dict(tree.near(q, near[3] + 1e-9)).keys() == {i for i in near if near[i] <= near[3] + 1e-9}


def test_shards_levels_and_chunks(spark):
    """Whatever the shards, rounds of fitting and chunks of queries: with recall 1 the result is the brute-force one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) * rng.lognormal(size=(900, 1))  # lengths differ: products, not angles
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(7)
    want = brute(np.arange(900), x, range(0, 900, 20))
    for more in ({"per_shard": 60, "leaf": 10}, {"per_shard": 60, "top": 1, "chunk": 3, "leaf": 10}, {}):
        got: dict = {}
        for r in ann.search(frame, frame.where("id % 20 = 0"), recall=1.0, **more).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
            assert r.scanned <= 900
        right = sum(len({v for _, v in rows} & {v for v, _ in want[q]}) for q, rows in got.items())
        assert got.keys() == want.keys() and right >= 0.99 * 20 * len(want)


def test_clusters_are_pruned(spark):
    """Of clustered vectors, under a quarter is scored for a query, each row once however many trees reach it."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(10, 32))[rng.integers(0, 10, 12_000)] + rng.normal(size=(12_000, 32)) * 0.25).astype(np.float32)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(4)
    rows = ann.search(frame, frame.where("id % 200 = 0"), per_shard=2000).collect()
    assert max(r.scanned for r in rows) <= 12_000 and np.mean([r.scanned for r in rows]) < 0.25 * 12_000
    want = brute(np.arange(12_000), x.astype(float), range(0, 12_000, 200))
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in rows) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    """The query itself on the driver's tables, against brute force; its trees have more than one leaf."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    want = brute(ids, x, ids[ids % 20 == 0])
    rows = queries.op6_ann(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == 20 * len(want)
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in rows) >= 0.9 * len(rows)
    assert ann.Forest(ann.Space(2.0).rows(x), 0).depth >= 2


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [INF, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [-1.0, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    search = lambda f: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(f, f.where("vec_id % 20 = 0"), id_col="vec_id").collect())
    assert search(frame) == [(0, 1, 20, 5.0), (0, 2, 6, 0.0), (20, 1, 0, 5.0), (20, 2, 6, 0.0)]
    assert search(frame.limit(0)) == []


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, (x[i] * 3).tolist()) for i in (900 - 1, 7)]  # two vectors of one id
    frame = spark.createDataFrame(rows + [rows[i] for i in range(0, 900, 9) for _ in range(40)], "id long, v array<double>").repartition(5)
    run = lambda f: sorted(tuple(r)[:4] for r in ann.search(f, f.where("id % 20 = 0"), leaf=20, per_shard=200).collect())
    got, once = run(frame), run(frame.distinct())
    assert got == once
    assert {q: sum(r[0] == q for r in got) for q in range(0, 900, 20)} == dict.fromkeys(range(0, 900, 20), ann.K)


def test_copies_of_one_row(spark):
    """200 vectors and 25 copies of one row; many ids share one vector."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 25 + [(1000 + i, x[40].tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got: dict = {}
    for r in sorted(ann.search(frame, frame.where("id % 20 = 0 AND id < 200"), leaf=10).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(set(some)) == 20 for some in got.values()) and len(got) == 10
    assert got[40] == list(range(1000, 1020)) or 40 not in got[40]


def test_vectors_of_one_id_take_one_place():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(400, 6)), rng.normal(size=(3, 6))
    ids = np.r_[np.repeat(7, 150), np.arange(100, 350)]
    for who, one in zip((1, 7, 120), q):
        top = {}
        for i, s in zip(ids, (x * one).sum(axis=1)):
            if i != who:
                top[i] = max(s, top.get(i, -INF))
        want = sorted(top, key=lambda i: (-top[i], i))[:20]
        assert ann.best(one, who, ids, x, 20)[0].tolist() == want
