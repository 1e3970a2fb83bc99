"""Registered curation queries against results computed without their SQL."""

import hashlib

import duckdb
import numpy as np

from siltworks.plans import catalog as queries

SF = "/root/testdata/sf0.01"


def rows_of(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def least_linked(ids, links):
    """The smallest id of every id's component."""
    least = {x: x for x in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_near_duplicates_reach_20_bits(spark):
    """SURVEY 7.2: 247 pairs, sum 4768."""
    found = sorted(rows_of("embeddings", "vec_id, label, embedding"))
    ids, labels = [r[0] for r in found], {r[0]: r[1] for r in found}
    signs = np.array([r[2] for r in found]) > 0
    apart = (signs[:, None, :] != signs[None, :, :]).sum(axis=2)
    want = {(ids[i], ids[j]): int(apart[i, j]) for i, j in zip(*np.nonzero(apart <= 20)) if i < j}
    assert (len(want), sum(want.values())) == (247, 4768)
    run = lambda name: queries.QUERIES[name](spark, SF).collect()
    assert {(r.a, r.b): r.distance for r in run("hamming_pairs")} == want
    first = {}
    for a, b in sorted(want):
        first.setdefault(b, a)
    assert {r.vec_id: r.near for r in run("near_dup_first_match")} == first
    across = {x for pair in want if (labels[pair[0]] < 5) != (labels[pair[1]] < 5) for x in pair}
    assert {r.side: r.n for r in run("hamming_semijoin")} == {"low": sum(labels[x] < 5 for x in across), "high": sum(labels[x] >= 5 for x in across)}
    bucket = {}
    for x in ids:
        bucket.setdefault((labels[x], x // 25), []).append(x)
    least = least_linked(ids, list(want) + [(some[0], x) for some in bucket.values() for x in some])
    assert {r.vec_id: r.component for r in run("components")} == least
    sizes = {}
    for c in least.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert [(r.component, r.members) for r in run("cluster_stats")] == sorted(((c, n) for c, n in sizes.items() if n > 1), key=lambda x: (-x[1], x[0]))[:5]


def test_every_order_is_a_job(spark):
    lines = {}
    for (key,) in rows_of("lineitem", "l_orderkey"):
        lines[key] = lines.get(key, 0) + 1
    # complete ones with metrics and failed ones are left out; those that wait for a review are not
    out = lambda status, priority: status == "F" and priority != "2-HIGH" or status == "O" and priority == "1-URGENT"
    want = sorted(key for key, status, priority in rows_of("orders", "o_orderkey, o_orderstatus, o_orderpriority") if not out(status, priority) and lines.get(key, 0) > 3)
    assert len(want) > 5000
    assert sorted(r.job for r in queries.QUERIES["job_eligibility"](spark, SF).collect()) == want


def test_interval_rests_on_2000_resamples(spark):
    users = {}
    for user, kind in duckdb.sql("SELECT user_id, event_type FROM '/root/testdata/sf0.001/events.parquet'").fetchall():
        hit, n = users.get(user, (0, 0))
        users[user] = (hit + (kind == "purchase"), n + 1)
    steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])
    counts = np.array(list(users.values()))
    shares = []
    for r in range(2000):
        u = np.array([int(hashlib.md5(f"7:{r}:{user}".encode()).hexdigest()[:8], 16) / 2**32 for user in users])
        hits, rows = np.searchsorted(steps, u, side="right") @ counts
        shares.append(hits / rows)
    got = queries.QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001").first()
    assert got.repetitions == 2000 and np.allclose((got.low, got.high), np.quantile(shares, (0.025, 0.975)), atol=1e-8)
