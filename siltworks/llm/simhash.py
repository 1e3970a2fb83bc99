"""SimHash near-duplicates by vantage-point trees.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of all word shingles; a
bit is 1 if set in more than half of them. Texts are lower-cased in A-Z only,
words are split at the six ASCII white-space characters.

Linking within ``radius`` differing bits:

1. distinct fingerprints only: exact copies collapse before any comparison;
2. a routing tree of vantage points and radii, fitted on a sample (``SAMPLE``
   fingerprints, or ``PER_LEAF`` for each shard where that is more, one in 4,096;
   any tree gives exact results, the sample only balances it), deals every
   fingerprint to its home shard, and as a visitor to each shard whose boundary
   lies within ``radius`` of it by the triangle bound. Of the vantage points
   and radii tried, a node takes those with the fewest visitors for the
   information of the split, so boundaries run where few fingerprints lie;
3. each shard searches its own vantage-point tree, blockwise in numpy, and
   returns a spanning forest of the links found rather than all pairs, so a
   group of k near copies yields at most k - 1 rows per shard;
4. connected components over these links.

Defined cases: null text is empty text; no words give fingerprint zero, which
links like any other; fewer words than a shingle form one shingle; null ids
get a fingerprint, and are chosen as a component's id only if all are null;
repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import hot_keys, materialize, numbered, skew_join, text_of

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that the routing tree is fitted on, at least, and for each shard.
SAMPLE, PER_LEAF = 65_536, 16
#: Distinct fingerprints a shard is meant to hold.
PER_SHARD = 65_536
#: Below this many points the tree of a shard compares directly.
LEAF = 128
BLOCK = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six characters only
    if not words:
        return 0
    if len(words) < size:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(size)))), len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"), n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


class Routing:
    """A vantage-point tree over fingerprints whose leaves are shards."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int) -> None:
        self.radius, self.nodes, self.shards = radius, [], 0
        self.root = self._build(np.sort(sample), max(1, shards))

    def _build(self, points: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        found = boundary(points, self.radius) if shards > 1 else None
        if found:
            v, r = found
            near = np.bitwise_count(points ^ v) <= r
            part = min(shards - 1, max(1, round(shards * near.mean())))
            self.nodes[at] = (v, r, self._build(points[near], part), self._build(points[~near], shards - part))
            return at
        self.nodes[at] = self.shards
        self.shards += 1
        return at

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(shard, home or not, points): everything once at home, visitors where the triangle bound allows a neighbour."""
        stack = [(self.root, points, np.ones(len(points), bool))]
        while stack:
            at, some, home = stack.pop()
            if not len(some):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                for flag in (True, False):
                    if (home == flag).any():
                        yield node, flag, some[home == flag]
                continue
            v, r, near, far = node
            d = np.bitwise_count(some ^ v).astype(np.int16)
            inside = d <= r
            to_near, to_far = d <= r + self.radius, d > r - self.radius
            stack.append((near, some[to_near], (home & inside)[to_near]))
            stack.append((far, some[to_far], (home & ~inside)[to_far]))


def boundary(points: np.ndarray, radius: int, tries: int = 16) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that part these points with the fewest visitors; None if no radius parts them.

    A split costs the logarithm of how many places a point is sent to, and is
    worth the information of its sides; an eighth at least lies on either.
    """
    picks = points[:: max(1, len(points) // tries)][:tries]
    seen = points[:: max(1, len(points) // 4096)]
    best, found = np.inf, None
    for v in picks:
        inside = np.cumsum(np.bincount(np.bitwise_count(seen ^ v), minlength=65)) / max(1, len(seen))
        near = inside[:64]
        wide = np.concatenate([inside, np.ones(radius)])
        sent = wide[radius : radius + 64] + 1 - np.concatenate([np.zeros(radius), inside])[:64]
        fair = (near >= 0.125) & (near <= 0.875)
        if fair.any():
            p = np.where(fair, near, 0.5)
            worth = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
            cost = np.where(fair, np.log2(sent) / worth, np.inf)
            r = int(np.argmin(cost))
            if cost[r] < best:
                best, found = cost[r], (v, r)
    return found


def vantage(points: np.ndarray) -> np.uint64:
    """Of a few points, the one whose distances to the others spread most."""
    picks = points[:: max(1, len(points) // 8)][:8]
    seen = points[:: max(1, len(points) // 512)]
    return picks[int(np.argmax(np.bitwise_count(seen[None, :] ^ picks[:, None]).std(axis=1)))]


class Forest:
    """Union-find whose labels are kept flat for numpy."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the labels a[i] and b[i]."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                nxt = up[x]
                if nxt in up:
                    up[x] = up[nxt]
                x = nxt
            return x

        for x, y in set(zip(a.tolist(), b.tolist())):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            old = np.fromiter(up, np.int64, len(up))
            to = np.arange(len(self.label))
            to[old] = [find(x) for x in old.tolist()]
            self.label = to[self.label]


def link(points: np.ndarray, homes: int, radius: int) -> np.ndarray:
    """Labels of all points under links to one of the first ``homes`` points."""
    forest = Forest(len(points))

    def direct(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(p)))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            close = np.bitwise_count(points[some][:, None] ^ points[p][None, :]) <= radius
            if not close.any():
                continue
            rows = np.flatnonzero(close.any(axis=1))
            close, some = close[rows], some[rows]
            while True:
                apart = close & (forest.label[some][:, None] != forest.label[p][None, :])
                cols = np.flatnonzero(apart.any(axis=0))
                if not len(cols):
                    break
                forest.join(forest.label[some[apart[:, cols].argmax(axis=0)]], forest.label[p[cols]])

    stack = [(np.arange(homes), np.arange(len(points)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) <= LEAF or len(p) * len(q) <= BLOCK // 16:
            direct(p, q)
            continue
        v = vantage(points[p])
        dp, dq = np.bitwise_count(points[p] ^ v).astype(np.int16), np.bitwise_count(points[q] ^ v).astype(np.int16)
        r = int(np.median(dp))
        near = dp <= r
        if near.all():  # more than half at the largest distance: split just below it
            r -= 1
            near = dp <= r
        if not near.any():
            direct(p, q)
            continue
        stack.append((p[near], q[dq <= r + radius]))
        stack.append((p[~near], q[dq > r - radius]))
    return forest.label


def links(distinct: DataFrame, n: int, radius: int = RADIUS, per_shard: int = PER_SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b): spanning links between different fingerprints of column fp within ``radius`` bits."""
    spark = distinct.sparkSession
    shards = -(-n // per_shard)
    # a hash picks about one in ``every`` of the n fingerprints
    every = max(1, n // max(sample, PER_LEAF * shards))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Routing(picked, shards, radius)
    shared = spark.sparkContext.broadcast((tree.nodes, tree.root, tree.shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = object.__new__(Routing)
        mine.radius, (mine.nodes, mine.root, mine.shards) = radius, shared.value
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out = [(s, h, p.tobytes()) for s, h, p in mine.deal(points)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.binary())], ["shard", "home", "points"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        read = [np.frombuffer(b"".join(group["points"][group["home"] == flag]), np.uint64) for flag in (True, False)]
        points = np.concatenate(read)
        if not len(read[0]):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        label = link(points, len(read[0]), radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[label[linked]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, home boolean, points binary")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, per_shard: int = PER_SHARD, sample: int = SAMPLE) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col, size))
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    total, n = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    found = connected_components(links(distinct, n, radius, per_shard, sample))
    linked = found.withColumnRenamed("vertex", "fp").join(distinct, "fp")
    smallest = linked.groupBy("component").agg(F.min("first").alias("least"))
    big = hot_keys(linked.groupBy("component").agg(F.count(F.lit(1)).alias("k")), "component", "k", n)
    named = skew_join(linked.select("fp", "component"), smallest, "component", big).select("fp", "least")
    of = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    rows = skew_join(prints, of, "fp", hot_keys(distinct, "fp", "n", total))
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with their columns.

    Rows that repeat such an id with the same text stay only once; rows that
    repeat it with another text stay too. Rows with a null id stay if a
    component has no other id.
    """
    rows, (key, text) = numbered(docs, id_col, text_col)
    found = components(rows, key, text)
    stay = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__silt_keep"))
    kept = rows.join(stay, F.col(key).eqNullSafe(F.col("__silt_keep")), "left_semi")
    repeated = found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates([key, text]) if repeated else kept).toDF(*docs.columns)
