"""Connected components of an edge table, as an iterative DataFrame plan.

Each round hooks every vertex to its smallest smaller neighbour, flattens the
resulting trees by pointer jumping, and rewrites the edges that are left to
tree roots. A round at least removes every vertex that is not a local minimum,
so few rounds are needed; each is cut off by a checkpoint. Joins on a parent
or a hub are salted, so a star of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SALTS = 16


def salted_lookup(big: DataFrame, key: str, dim: DataFrame, by: str, how: str, salts: int = SALTS) -> DataFrame:
    """Join ``big`` with unique-keyed ``dim`` on ``key``; rows of one key are dealt by ``by`` over ``salts`` tasks."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _flatten(parents: DataFrame) -> DataFrame:
    """(u, p) with p the root of u's tree, by pointer jumping."""
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        inner = materialize(parents.select("p").distinct().join(up, "p"))
        if not inner.limit(1).count():
            return parents
        jumped = salted_lookup(parents, "p", inner, "u", "left")
        parents = materialize(jumped.select("u", F.coalesce("pp", "p").alias("p")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex on an edge between two different vertices.

    component is the smallest vertex reachable. Edges with a null end and
    loops are ignored; direction and repetition do not matter; no edges give
    an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    left = materialize(pairs.distinct())
    parents = None
    while left.limit(1).count():
        hooks = materialize(left.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n")))
        more = salted_lookup(left, "u", hooks.where("n > 1").select("u", "p"), "v", "inner").where("v > p").select("v", "p")
        parents = hooks.select("u", "p") if parents is None else parents.unionByName(hooks.select("u", "p"))
        parents = _flatten(materialize(parents))
        if not hooks.where("n > 1").limit(1).count():  # every vertex had one smaller neighbour: no edge is left
            break
        root = parents.select(F.col("u").alias("x"), F.col("p").alias("r"))
        for end in ("v", "p"):
            found = salted_lookup(more.withColumnRenamed(end, "x"), "x", root, "p" if end == "v" else "v", "left")
            more = found.select(F.coalesce("r", "x").alias(end), *[c for c in ("v", "p") if c != end])
        left = materialize(more.where("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v")).distinct())
    if parents is None:
        return left.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = parents.select(F.col("p").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return parents.select(F.col("u").alias("vertex"), F.col("p").alias("component")).unionByName(roots)
