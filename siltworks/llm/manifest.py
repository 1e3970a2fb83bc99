"""Merkle manifest of a table: leaves, subroots per source, one root, proofs and their verification.

A leaf is the SHA-256 of a row's fields, each as its UTF-8 length, a colon and
its value, or ``-`` if null. Per source, leaves stand in order of id (nulls
first; rows of one id by leaf), and every ``FANOUT`` consecutive nodes become
the SHA-256 of their digests as hex text, level by level, until one is left: the
subroot. Subroots, in order of source (null first, then bytewise), become the
root in the same way.

Places come from ranges of (source, id): row_number inside a range plus the
rows of the ranges before, so no source is one task's work. A level is a
DataFrame of nodes with their children, grouped by (source, place div fanout),
three rows a group at most, and written once. Proofs go the other way: a node's
proof is its siblings before that of its parent, joined level by level, so each
join moves a level's nodes and only the last is as long as a third of the rows.
Digests travel as 32 bytes and turn to hex where they are hashed.

Defined cases: null and empty texts differ (``-`` and ``0:``); null sources are
a source of their own; rows that repeat an id or are equal throughout are leaves
of their own; null ids are leaves, never altered by :func:`altered`; an empty
table has no rows, no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:binary,after:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields."""
    texts = [x.cast("string") for x in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]))


def joined(digests: Column) -> Column:
    """An array of digests as one binary value."""
    return F.aggregate(digests, F.lit(bytearray()), lambda a, x: F.concat(a, x))


def placed(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with i, the place within the key from 0, and c, the key's rows. ``order`` leaves only equal rows tied."""
    ranged = materialize(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select(key, "part", (F.sum("n").over(upto) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy(key)).alias("c"))
    inner = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    return ranged.withColumn("inner", inner).join(sums, [key, "part"]).withColumn("i", F.col("ahead") + F.col("inner") - 1).drop("part", "inner", "ahead")


@dataclass
class Tree:
    """nodes: (key, i, c, kid), kid.h being the digest; levels: (key, i, c, kids, kid) of the nodes above, each level once."""

    nodes: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(key, level, h) of every key: its only node on the first level that has one."""
        found = [x.where("c = 1").select("key", F.lit(n).alias("level"), F.col("kid.h").alias("h")) for n, x in enumerate([self.nodes, *self.levels])]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def grow(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """All levels above the nodes (key, i, c, kid)."""
    nodes = materialize(nodes)
    most, levels, level = nodes.agg(F.max("c")).first()[0] or 0, [], nodes
    while most > 1:
        kids = F.transform(F.sort_array(F.collect_list(F.struct("i", "kid"))), lambda x: x.kid)  # fanout rows at most
        up = level.where("c > 1").groupBy("key", F.expr(f"i div {fanout}").alias("i")).agg(kids.alias("kids"), F.expr(f"(max(c) + {fanout - 1}) div {fanout}").alias("c"))
        level = materialize(up.withColumn("kid", F.struct(digest(F.array_join(F.transform("kids", lambda x: hexed(x.h)), "")).alias("h"))))
        levels.append(level)
        most = -(-most // fanout)
    return Tree(nodes, levels)


def descend(tree: Tree, tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(key, kid, proof, subroot) of the tree's nodes, from (key, level, proof, subroot) of its roots."""
    path = None
    for n in range(len(tree.levels), 0, -1):
        own = tops.where(F.col("level") == n).select("key", F.lit(0).cast("long").alias("i"), "proof", "subroot")
        path = own if path is None else path.unionByName(own)
        spread = tree.levels[n - 1].select("key", "i", "kids").join(path, ["key", "i"]).select("*", F.posexplode("kids").alias("at", "kid"))
        digests = F.transform("kids", lambda x: x.h)
        beside = F.struct(joined(F.slice(digests, F.lit(1), F.col("at"))).alias("before"), joined(F.slice(digests, F.col("at") + 2, F.lit(fanout))).alias("after"))
        place = (F.col("i") * fanout + F.col("at")).alias("i")
        path = spread.select("key", place, F.concat(F.array(beside), F.col("proof")).alias("proof"), "subroot", *(["kid"] if n == 1 else []))
    alone = tree.nodes.where("c = 1").join(tops.where("level = 0"), "key").select("key", "kid", "proof", "subroot")
    return alone if path is None else path.select("key", "kid", "proof", "subroot").unionByName(alone)


def fold(leaf: Column, proof: Column) -> Column:
    """The root, as hex text, that a leaf (hex text) and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(hexed(s.before), h, hexed(s.after)), 256))


def build(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, fanout: int = FANOUT) -> tuple[DataFrame, bytes | None]:
    """One row per row of ``docs``: (id, source, leaf, tampered, subroot, proof), digests as bytes, and the root.

    tampered: the leaf of another version of the row, or null; it travels along and is part of no node.
    proof: level by level the siblings before and after the row's own node, subroots' levels included.
    """
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # null before all others, and equal to itself
    other = F.lit(None).cast("binary") if tampered is None else tampered
    leaves = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf_of(*[F.col(f) for f in fields]).alias("h"), other.alias("tampered"))
    tree = grow(placed(leaves, "key", ["id", "h"]).select("key", "i", "c", F.struct("h", "id", "tampered").alias("kid")), fanout)
    sources = tree.roots().select(F.lit("").alias("key"), F.col("key").alias("source"), "level", "h")
    above = grow(placed(sources, "key", ["source"]).select("key", "i", "c", F.struct("h", "source", "level").alias("kid")), fanout)
    root = above.roots().first()
    top = above.roots().select("key", "level", F.expr(f"CAST(array() AS {PROOF})").alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    tops = materialize(descend(above, top, fanout).select(F.col("kid.source").alias("key"), "kid.level", "proof", F.col("kid.h").alias("subroot")))
    rows = descend(tree, tops, fanout)
    named = F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source")
    return rows.select(F.col("kid.id").alias("id"), named, F.col("kid.h").alias("leaf"), "kid.tampered", "subroot", "proof"), root and bytes(root.h)


def altered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf of a row whose text lost its newlines, for ids whose decimal CRC-32 is even; else null."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    text = F.replace(F.col(text_col), F.lit("\n"), F.lit(""))
    return F.when(even & F.col(text_col).contains("\n"), leaf_of(*[text if f == text_col else F.col(f) for f in fields]))


def check(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's proof, folded from its altered leaf if it has one."""
    rows, root = build(docs, altered(docs))
    proof = F.array_join(F.transform("proof", lambda s: hexed(F.concat(s.before, s.after))), "")
    whole = F.lit(root.hex() if root else None).cast("string")
    told = rows.select(
        F.col("id").alias("doc_id"),
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        whole.alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        fold(hexed(F.coalesce("tampered", "leaf")), F.col("proof")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
