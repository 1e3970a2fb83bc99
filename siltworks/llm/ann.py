"""Approximate nearest neighbours by forests of random-projection trees.

Every row lies in one shard and is scored at most once for a query:

1. a routing tree of random projections deals the rows to shards of about
   ``PER_SHARD`` rows; its depth follows their number, its planes a sample;
2. each shard holds a forest of ``TREES`` random-projection trees over all its
   rows, down to leaves of about ``LEAF`` rows. A direction runs through two
   random rows, the cut lies near the median and where few rows are;
3. a query's priority of a branch is the sum of its squared distances to the
   planes that part it from the branch; those of the routing tree, which all
   trees of a shard share, count one tree's part. It goes to the shards, and there one
   priority queue shared by all trees yields the leaves, in the order of
   priority up to a bound; the rows of these leaves are taken once each and
   ranked by exact inner products in double precision.

The bound is calibrated: for ``CALIBRATION`` queries the exact neighbours are
found by one scan, and ``RECALL`` of them lie in leaves within the bound.
Directions live in a space with one more dimension, in which all rows have the
same length and the nearest row by angle is that of the largest product.

Of equal vectors the ``k + 1`` smallest ids are kept, as no result can hold
more of them; a vector that a third of all rows share is no third of the work.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components, and rows with a null id take no part;
fewer than ``k`` candidates are all returned; equal scores are ordered by id;
rows that repeat one id and vector count once, those of one id with several
vectors by the best of them, and never as their own neighbour; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, LEAF, PER_SHARD = 8, 64, 8192
#: Directions tried for a plane, and the rows on either side by which it tells how many lie there.
TRIES, WINDOW = 3, 16
#: Routing levels that the driver fits on a sample of PER_NODE rows per node below; deeper ones are fitted node by node in tasks.
TOP_LEVELS, PER_NODE = 10, 16
#: Queries that meet one copy of a shard, at most.
CHUNK = 32_768
K, RECALL, CALIBRATION, SEED = 20, 0.95, 128, 17
SLACK = 1e-9  # block products may differ from the exact ones by less
OUT = "query_id long, vec_id long, score double, scanned long"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part, each id and vector once."""
    kind = rows.schema[vec_col].dataType.simpleString()
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    # in SQL order NaN is above infinity, so the comparison drops both
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    clean = clean.where(finite & F.exists("v", lambda x: x != 0))
    sizes = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    # partial sums take in a hot row
    return clean.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(float) if len(column) else np.empty((0, 0))


def directions(n: int, dims: int, *seed: int) -> np.ndarray:
    """n random directions of length one."""
    normal = np.random.default_rng(seed).normal(size=(n, dims))
    return normal / np.linalg.norm(normal, axis=1, keepdims=True)


def plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A direction through two random rows, the best of ``TRIES``, and where to cut: near the median and where few rows lie."""
    best_cost, best_normal, best_at = np.inf, None, 0.0
    for _ in range(TRIES):
        normal = np.subtract(*x[rng.integers(len(x), size=2)]) if len(x) > 1 else np.zeros(x.shape[1])
        length = np.linalg.norm(normal)
        normal = normal / length if length > 1e-9 else directions(1, x.shape[1], int(rng.integers(1 << 31)))[0]
        if len(x) < 4 * WINDOW:
            return normal, float(np.median(x @ normal)) if len(x) else 0.0
        p = np.sort(x[:: -(-len(x) // 512)] @ normal)
        cuts = np.arange(int(0.3 * len(p)), int(0.7 * len(p)))
        f = cuts / len(p)
        gap = p[np.minimum(cuts + WINDOW, len(p) - 1)] - p[np.maximum(cuts - WINDOW, 0)]
        cost = (p[-1] - p[0]) / (gap + 1e-12) / (4 * f * (1 - f)) ** 2
        i = int(np.argmin(cost))
        if cost[i] < best_cost:
            best_cost, best_normal, best_at = cost[i], normal, float(p[cuts[i] - 1] + p[cuts[i]]) / 2
    return best_normal, best_at


class Space:
    """Rows and queries on the unit sphere of one more dimension; longest: the length of the longest row."""

    def __init__(self, longest: float) -> None:
        self.longest = longest

    def rows(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        return np.c_[scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))]

    @staticmethod
    def queries(q: np.ndarray) -> np.ndarray:
        length = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.c_[q / length, np.zeros(len(q))]


def medians(p: np.ndarray, levels: int) -> np.ndarray:
    """The planes of a complete tree whose level i splits by column i of p, in the order of its nodes."""
    at = np.zeros((1 << levels) - 1)
    held = [np.arange(len(p))]
    for node in range(len(at)):
        own = held[node]
        split = p[own, (node + 1).bit_length() - 1]
        at[node] = np.median(split) if len(own) else 0
        held += [own[split <= at[node]], own[split > at[node]]]
    return at


class Routing:
    """A tree whose leaves are shards; node i has the children 2 i + 1 and 2 i + 2.

    normal: a direction for each node of the first levels; below: one for each
    level beneath them; at: where the planes of all nodes lie; weight: of a
    squared distance to one of them in a priority.
    """

    def __init__(self, normal: np.ndarray, below: np.ndarray, at: np.ndarray, weight: float) -> None:
        self.normal, self.below, self.at, self.weight = normal, below, at, weight
        self.first = (len(normal) + 1).bit_length() - 1
        self.levels = self.first + len(below)

    def shard(self, x: np.ndarray) -> np.ndarray:
        node, p = np.zeros(len(x), np.int64), x @ self.below.T
        for i in range(self.levels):
            side = (x * self.normal[node]).sum(axis=1) if i < self.first else p[:, i - self.first]
            node = 2 * node + 1 + (side > self.at[node])
        return node - ((1 << self.levels) - 1)

    def _margins(self, q: np.ndarray) -> tuple[list[float], list[float]]:
        return (self.normal @ q - self.at[: len(self.normal)]).tolist(), (self.below @ q).tolist()

    def near(self, q: np.ndarray, bound: float) -> list[tuple[int, float]]:
        """(shard, priority) within the bound, best first, of one query."""
        top, p = self._margins(q)
        at, own, inner, out = self.at, len(top), (1 << self.levels) - 1, []
        queue = [(0.0, 0, 0)]
        while queue:
            worth, node, level = heapq.heappop(queue)
            while node < inner:
                m = top[node] if node < own else p[level - self.first] - at[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                level += 1
                parted = worth + m * m * self.weight
                if parted <= bound:
                    heapq.heappush(queue, (parted, far, level))
                node = near
            out.append((node - inner, worth))
        return out

    def priority(self, q: np.ndarray, shard: int) -> float:
        """One query's priority of a shard."""
        top, p = self._margins(q)
        node, level, path = shard + (1 << self.levels) - 1, self.levels, []
        while node:
            right, node, level = node % 2 == 0, (node - 1) >> 1, level - 1
            m = top[node] if node < len(top) else p[level - self.first] - self.at[node]
            path.append(0.0 if right == (m > 0) else m * m * self.weight)
        worth = 0.0
        for m in reversed(path):  # in the order in which near() adds them
            worth += m
        return worth


class Forest:
    """Trees over the rows of one shard."""

    def __init__(self, x: np.ndarray, shard: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> None:
        self.trees, self.rows = trees, len(x)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        self.inner = (1 << self.depth) - 1
        self.normal = np.zeros((trees, self.inner, x.shape[1]))
        self.at = np.zeros((trees, self.inner))
        self.leaf_of = np.empty((trees, len(x)), np.int64)
        self.members: list[list[np.ndarray]] = []
        rng = np.random.default_rng((seed, shard))
        for t in range(trees):
            held = [np.arange(len(x))]
            for node in range(self.inner):
                own = held[node]
                self.normal[t, node], self.at[t, node] = plane(x[own], rng)
                side = x[own] @ self.normal[t, node] > self.at[t, node]
                held += [own[~side], own[side]]
            self.members.append(held[self.inner :])
            for i, own in enumerate(self.members[t]):
                self.leaf_of[t, own] = i

    def search(self, q: np.ndarray, start: float, bound: float) -> np.ndarray:
        """The rows of the leaves within the bound, each once; ``start`` is the shard's own priority."""
        inner = self.inner
        margin = (self.normal @ q - self.at).tolist()
        found = np.zeros(self.rows, bool)
        queue = [(start, t, 0) for t in range(self.trees)]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            worth, t, node = pop(queue)
            m = margin[t]
            while node < inner:  # down the near side; far sides within the bound wait in the queue
                d = m[node]
                far = worth + d * d
                if d > 0:
                    if far <= bound:
                        push(queue, (far, t, 2 * node + 1))
                    node = 2 * node + 2
                else:
                    if far <= bound:
                        push(queue, (far, t, 2 * node + 2))
                    node = 2 * node + 1
            found[self.members[t][node - inner]] = True
        return np.flatnonzero(found)

    def priority(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The best priority among the trees of the leaves that hold some rows."""
        out = np.full(len(rows), np.inf)
        for t in range(self.trees):
            node, worth = self.leaf_of[t, rows] + self.inner, np.zeros(len(rows))
            while self.inner and node[0] > 0:  # all leaves lie at one depth
                right = node % 2 == 0
                node = (node - 1) >> 1
                m = self.normal[t, node] @ q - self.at[t, node]
                worth += np.where(right != (m > 0), m * m, 0)
            out = np.minimum(out, worth)
        return out


def by_id(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The largest value of every id: one per distinct id."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0]) if len(ids) else order
    return near if len(starts) == len(ids) else np.maximum.reduceat(near[order], starts)


def best(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of one query's k best by exact product, its own id aside and each id by its best row; ties to the smaller id."""
    other = np.flatnonzero(ids != own)
    ids, x = ids[other], x[other]
    near = x @ q
    each = by_id(near, ids)
    if len(each) > k:
        picks = np.flatnonzero(near >= np.partition(each, -k)[-k] - SLACK)
        ids, x = ids[picks], x[picks]
    # a sum along each row: equal vectors give equal scores wherever they lie
    score = (x * q).sum(axis=1)
    ranked = np.lexsort((ids, -score))
    first = ranked[np.sort(np.unique(ids[ranked], return_index=True)[1])[:k]]
    return ids[first], score[first]


def _frame(found: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pd.DataFrame:
    """Results per query as rows; the first row of each says how many rows were scored."""
    n = [len(ids) for _, ids, _, _ in found]
    scanned = np.zeros(sum(n), np.int64)
    starts = np.cumsum([0, *n[:-1]]) if n else np.empty(0, int)
    for at, size, (_, _, _, many) in zip(starts, n, found):
        if size:
            scanned[at] = many
    return pd.DataFrame({
        "query_id": np.repeat(np.array([f[0] for f in found], np.int64), n), "vec_id": np.concatenate([np.empty(0, np.int64), *[f[1] for f in found]]),
        "score": np.concatenate([np.empty(0), *[f[2] for f in found]]), "scanned": scanned,
    })


def _first(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scanned").alias("scanned"))
    w = Window.partitionBy("query_id")
    ranked = once.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).withColumn("scanned", F.sum("scanned").over(w))
    return ranked.where(F.col("rank") <= k)


def _by_hash(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the ``most`` rows of the smallest hash of their id, or all."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()
    vectors = np.array(got["v"].tolist(), float).reshape(len(got), -1) if len(got) else np.empty((0, 0))
    return got["id"].to_numpy(np.int64), vectors


def exact(rows: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int = K) -> DataFrame:
    """Brute force for a bounded number of broadcast queries: (query_id, rank, vec_id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                yield pa.RecordBatch.from_pandas(_frame([(i, *best(one, i, ids, x, k), len(ids)) for i, one in zip(asked.tolist(), vectors)]), preserve_index=False)

    return _first(rows.select("id", "v").mapInArrow(scan, OUT), k)


def fit(rows: DataFrame, n: int, space: Space, per_shard: int, top: int, seed: int, weight: float) -> Routing:
    """The routing tree: planes of the first levels from one sample, of the others from a sample of each node."""
    spark = rows.sparkSession
    levels = max(0, int(np.ceil(np.log2(max(1, n) / per_shard))))
    first = min(levels, top)
    _, sample = _by_hash(rows, PER_NODE << first)
    x, rng = space.rows(sample), np.random.default_rng(seed)
    normal, at, held = np.zeros(((1 << first) - 1, x.shape[1])), np.zeros((1 << levels) - 1), [np.arange(len(x))]
    for node in range(len(normal)):
        own = held[node]
        normal[node], at[node] = plane(x[own], rng)
        side = x[own] @ normal[node] > at[node]
        held += [own[~side], own[side]]
    below = directions(levels - first, x.shape[1], seed)
    if not len(below):
        return Routing(normal, below, at, weight)
    shared = spark.sparkContext.broadcast(Routing(normal, below[:0], at[: len(normal)], weight))
    # about PER_NODE rows of each shard to be
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, per_shard // PER_NODE))) == 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = space.rows(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.shard(x)), pa.array([row.tobytes() for row in x @ below.T], pa.binary())], ["node", "p"])

    def split(part: pd.DataFrame) -> pd.DataFrame:
        p = np.frombuffer(b"".join(part["p"]), float).reshape(len(part), -1)
        return pd.DataFrame({"node": part["node"].iloc[:1], "at": [medians(p, len(below)).tobytes()]})

    # eight bytes for each shard of PER_SHARD rows
    found = some.select("id", "v").mapInArrow(project, "node long, p binary").groupBy("node").applyInPandas(split, "node long, at binary").collect()
    for r in found:
        own, root = np.frombuffer(r["at"], float), (1 << first) - 1 + r["node"]
        for level in range(len(below)):
            begin = (root + 1 << level) - 1
            at[begin : begin + (1 << level)] = own[(1 << level) - 1 : (2 << level) - 1]
    return Routing(normal, below, at, weight)


def read_shard(part: pd.DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of packed rows, by id and vector."""
    ids = np.frombuffer(b"".join(part["ids"]), np.int64)
    raw = np.frombuffer(b"".join(part["data"]), kind).reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
    x = raw.astype(float)
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    return ids[order], x[order]


def search(rows: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, id_col: str = "id", vec_col: str = "v", per_shard: int = PER_SHARD, top: int = TOP_LEVELS, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score, scanned): the k nearest found of every query.

    rows and queries: frames with ids and vectors; a query that is also a row
    is not its own neighbour. scanned: how many rows were scored for the query.
    """
    spark = rows.sparkSession
    kind = np.float32 if rows.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64
    # tasks keep k + 1 rows of a vector before they are moved
    few = usable(rows, id_col, vec_col).withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    rows, queries = materialize(few), materialize(usable(queries, id_col, vec_col))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    asked, asked_v = _by_hash(queries, CALIBRATION)
    width = rows.select(F.size("v")).limit(1).collect()
    if not n or not len(asked) or width[0][0] != asked_v.shape[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned long")
    space = Space(longest * (1 + 1e-9))
    routing = spark.sparkContext.broadcast(fit(rows, n, space, per_shard, top, seed, 1 / trees))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield part.column(0).to_numpy(), matrix(part.column(1))

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches):
            shard = routing.value.shard(space.rows(x))
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
            parts = np.split(order, cuts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][cuts]), pa.array([ids[p].tobytes() for p in parts], pa.binary()), pa.array([x[p].astype(kind).tobytes() for p in parts], pa.binary())], ["shard", "ids", "data"])

    placed = materialize(rows.select("id", "v").mapInArrow(place_rows, "shard long, ids binary, data binary"))
    bound = calibrate(rows, placed, routing, space, asked, asked_v, k, recall, trees, leaf, seed, kind)

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q in blocks(batches):
            by: dict[int, list[tuple[int, float]]] = {}
            for i, one in enumerate(space.queries(q)):
                for shard, worth in routing.value.near(one, bound):
                    by.setdefault(shard, []).append((i, worth))
            data = ([], [], [], [], [])
            for shard, some in by.items():
                who = np.array([i for i, _ in some])
                for column, value in zip(data, (shard, len(who), ids[who].tobytes(), q[who].astype(kind).tobytes(), np.array([w for _, w in some]).tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, kinds)], ["shard", "many", "ids", "data", "worth"])

    wanted = materialize(queries.select("id", "v").mapInArrow(place_queries, "shard long, many long, ids binary, data binary, worth binary"))
    most = wanted.groupBy("shard").agg(F.sum("many").alias("n")).agg(F.max("n")).first()[0]
    copies = max(1, -(-most // chunk))
    # one task holds a shard and a part of its queries
    left = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = wanted.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int"))

    def meet(rows_in: pd.DataFrame, queries_in: pd.DataFrame) -> pd.DataFrame:
        if not len(rows_in) or not len(queries_in):
            return _frame([])
        ids, x = read_shard(rows_in, kind)
        asked = np.frombuffer(b"".join(queries_in["ids"]), np.int64)
        q = np.frombuffer(b"".join(queries_in["data"]), kind).reshape(len(asked), -1).astype(float)
        worth = np.frombuffer(b"".join(queries_in["worth"]), float)
        forest = Forest(space.rows(x), int(rows_in["shard"].iloc[0]), trees, leaf, seed)
        found = []
        for own, one, turned, start in zip(asked.tolist(), q, space.queries(q), worth.tolist()):
            at = forest.search(turned, start, bound)
            found.append((own, *best(one, own, ids[at], x[at], k), len(at)))
        return _frame(found)

    met = left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInPandas(meet, OUT)
    return _first(met, k).select("query_id", "rank", "vec_id", "score", "scanned")


def calibrate(rows: DataFrame, placed: DataFrame, routing, space: Space, asked: np.ndarray, asked_v: np.ndarray, k: int, recall: float, trees: int, leaf: int, seed: int, kind) -> float:
    """The bound of the queue within which ``recall`` of the calibration queries' true neighbours lie.

    Only the shards that hold one of these neighbours are looked into.
    """
    true = exact(rows, asked, asked_v, k).select("query_id", "vec_id").join(rows.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", "vec_id", "v").toPandas()
    if not len(true):
        return 0.0
    places = routing.value.shard(space.rows(np.array(true["v"].tolist(), float)))
    turned = dict(zip(asked.tolist(), space.queries(asked_v)))
    pairs = list(zip(true["query_id"].tolist(), true["vec_id"].tolist(), places.tolist()))
    shared = rows.sparkSession.sparkContext.broadcast((turned, pairs))

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        turned, pairs = shared.value
        shard = int(part["shard"].iloc[0])
        ids, x = read_shard(part, kind)
        forest = Forest(space.rows(x), shard, trees, leaf, seed)
        out = []
        for query, vec, place in pairs:
            if place == shard:
                own = np.flatnonzero(ids == vec)
                if len(own):
                    worth = routing.value.priority(turned[query], shard)
                    out.append((query, vec, worth + forest.priority(turned[query], own).min()))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "worth"]).astype({"query_id": "int64", "vec_id": "int64", "worth": "float64"})

    some = placed.where(F.col("shard").isin([int(s) for s in set(places.tolist())]))
    found = some.groupBy("shard").applyInPandas(measure, "query_id long, vec_id long, worth double")
    # an id with several vectors is met where its best one is
    worth = found.groupBy("query_id", "vec_id").agg(F.min("worth").alias("worth")).toPandas()["worth"].to_numpy()
    return float(np.quantile(worth, recall, method="higher")) * (1 + 1e-9) + 1e-12
