import hashlib
import math

import pytest

from siltworks.operators import placement


def chance(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def sizes(size, share, margin):
    core = max(8, min(size - 4, round(share * size)))
    pad = math.floor(core * margin + 0.5)
    if core + 2 * pad > size - 4:
        core = size - 4 - 2 * pad
        pad = math.floor(core * margin + 0.5)
    return core, pad


def brute(records, boxes, candidates, wanted, seed):
    """Proposal by proposal and attempt by attempt."""
    out = []
    for subset, n in wanted:
        own = sorted(r for r in records if r[0] == subset)
        some = sorted(c for c in candidates if c[0] == subset)
        for i in range(n):
            _, name, cid, margin, canonical = some[i % len(some)]
            shapes = sorted((b[1], b[2], b) for b in boxes if b[0] == subset and b[3] == cid)
            for t in range(500):
                key = (seed, subset, i, t)
                _, stem, sha, width, height = own[int(chance(*key, "background") * len(own))]
                e = shapes[int(chance(*key, "exemplar") * len(shapes))][2][4:]
                (w, px), (h, py) = sizes(width, e[2] - e[0], margin), sizes(height, e[3] - e[1], margin)
                rw, rh = w + 2 * px, h + 2 * py
                x, y = (2 + int(chance(*key, a) * max(1, size - side - 3)) for a, size, side in (("x", width, rw), ("y", height, rh)))
                if x + rw >= width or y + rh >= height:
                    continue
                if all(min((x + rw) / width, b[6]) <= max(x / width, b[4]) or min((y + rh) / height, b[7]) <= max(y / height, b[5]) for b in boxes if b[:2] == (subset, stem)):
                    out.append((subset, f"blend_{i:06d}", stem, sha, name, [x, y, rw, rh], [x + px, y + py, w, h], canonical and h > w, t, False, "", False))
                    break
            else:
                raise ValueError
    return sorted(out)


RECORDS = [(s, f"{s}{i}", f"sha{i}", 200 + 40 * i, 160 + 20 * i) for s in "ab" for i in range(6)]
BOXES = [(s, f"{s}{i}", k, (i + k) % 3, 0.1 * k, 0.05 * i, 0.1 * k + 0.12 + 0.02 * i, 0.05 * i + 0.3) for s in "ab" for i in range(5) for k in range(4)]
CANDIDATES = [("a", "c2", 0, 0.1, True), ("a", "c1", 1, 0.0, False), ("b", "c3", 2, 0.25, True)]
WANTED = [("a", 40), ("b", 25)]
SCHEMAS = ["subset string, stem string, sha256 string, width long, height long", "subset string, stem string, line int, cid int, x1 double, y1 double, x2 double, y2 double", "subset string, id string, cid int, margin double, canonical boolean", "subset string, n int"]


def frames(spark, *tables):
    return [spark.createDataFrame(t, s).repartition(3) for t, s in zip(tables, SCHEMAS)]


def test_equals_brute_force(spark):
    got = sorted(tuple(r) for r in placement.propose(*frames(spark, RECORDS, BOXES, CANDIDATES, WANTED), seed=3).collect())
    assert got == brute(RECORDS, BOXES, CANDIDATES, WANTED, 3)
    assert max(r[8] for r in got) > 3  # some needed a second round
    again = placement.propose(*frames(spark, RECORDS, BOXES, CANDIDATES, [("a", 5)]), seed=3).collect()
    assert sorted(map(tuple, again)) == [r for r in got if r[0] == "a" and r[1] < "blend_000005"]


def test_errors(spark):
    full = [("a", "a0", 0, 0, 0.0, 0.0, 1.0, 1.0)]
    with pytest.raises(ValueError, match="by hand"):
        placement.propose(*frames(spark, RECORDS[:1], full, CANDIDATES[:1], [("a", 1)]), seed=1, tries=6)
    with pytest.raises(ValueError, match="exemplars"):
        placement.propose(*frames(spark, RECORDS, full, CANDIDATES[:2], [("a", 2)]), seed=1)
    with pytest.raises(ValueError, match="without"):
        placement.propose(*frames(spark, RECORDS, BOXES, CANDIDATES[:1], WANTED), seed=1)
    assert placement.propose(*frames(spark, RECORDS, BOXES, CANDIDATES, [("a", 0)]), seed=1).count() == 0
