import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import neardup


def values(seed, n):
    """Random hashes, each with neighbours at 0 to 13 bits spread over all bands or crowded in one."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        out.append(x)
        for apart in (0, rng.randrange(1, 14), rng.randrange(4, 13)):
            spots = rng.sample(range(64), apart) if rng.random() < 0.7 else rng.sample(range(16 * rng.randrange(4), 64), min(apart, 12))
            out.append(x ^ sum(1 << s for s in set(spots)))
    return [(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(out)]


def apart(x, y):
    return ((x ^ y) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("within", [4, 6, 7, 8, 10, 11])
def test_multi_index_equals_brute_force(spark, within):
    rows = values(within, 60)
    frame = spark.createDataFrame([*rows, (None, 5), (999, None)], "id long, bits long")
    want = sorted((i, j, apart(x, y)) for i, x in rows for j, y in rows if i < j and apart(x, y) <= within)
    assert sorted(map(tuple, neardup.multi_index(frame, frame, "id", "bits", within, ordered=True).collect())) == want and want
    left, right = frame.where("id % 2 = 0"), frame.where("id % 2 = 1")
    want = sorted((i, j, apart(x, y)) for i, x in rows for j, y in rows if not i % 2 and j % 2 and apart(x, y) <= within)
    assert sorted(map(tuple, neardup.hamming_join(left, right, "id", "bits", within).collect())) == want


def test_values_that_many_rows_share(spark):
    """A third of all rows in one value: pairs are those of values."""
    rows = values(3, 30) + [(1000 + i, 77) for i in range(2000)] + [(5000, 79)]
    frame = spark.createDataFrame(rows, "id long, bits long")
    first, copies = {}, {}
    for i, x in rows:
        first[x], copies[x] = min(i, first.get(x, i)), copies.get(x, 0) + 1
    want = sorted((first[x], first[y], apart(x, y), copies[x], copies[y]) for x in first for y in first if first[x] < first[y] and apart(x, y) <= 10)
    assert sorted(map(tuple, neardup.near_values(frame, "id", "bits", 10).collect())) == want
    assert (1000, 5000, 1, 2000, 1) in want


def test_plan_is_an_equi_join(spark):
    frame = spark.createDataFrame(values(1, 5), "id long, bits long")
    plan = neardup.hamming_join(frame, frame, "id", "bits", 10, ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert neardup.hamming_join(frame.limit(0), frame, "id", "bits", 10).count() == 0
    with pytest.raises(ValueError):
        neardup.multi_index(frame, frame, "id", "bits", 12)
    assert F is not None


def test_bits_are_dealt_by_what_they_tell(spark):
    rng = np.random.default_rng(11)
    # 20 bits in a row tell something, the others are nearly always 0
    values = [int(v) << 7 for v in rng.integers(1 << 20, size=300)]
    values += [v ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for v in values[:60]] + [0, -1]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, bits long")
    masks = neardup.dealt_masks(frame, "bits", 3)
    assert sum(masks) == 2**64 - 1 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    telling = ((1 << 20) - 1) << 7
    assert all(6 <= (m & telling).bit_count() <= 8 for m in masks) and all(m.bit_count() in (21, 22) for m in masks)
    want = {(i, j) for j in range(len(values)) for i in range(j) if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= 2}
    found = neardup.hamming_join(frame, frame, "id", "bits", 2, ordered=True, masks=masks).collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    earlier = {r.id: r.near for r in neardup.first_earlier(frame, "id", "bits", 2).collect()}
    assert earlier == {j: min(i for i, k in want if k == j) for j in {j for _, j in want}}
    assert neardup.first_earlier(frame.limit(0), "id", "bits", 2).collect() == []


def test_exploded_sides_are_not_broadcast(spark):
    """Spark's estimate of a small table doesn't see its 68 probes or 6 bands a row."""
    rows = spark.createDataFrame([(i, i * 37) for i in range(50)], "id long, bits long")
    for within in (5, 8, 10):
        plan = neardup.hamming_join(rows, rows, "id", "bits", within)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
