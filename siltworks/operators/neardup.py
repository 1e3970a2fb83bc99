"""Near-duplicate joins on 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import hamming
from ..session import materialize


def even_masks(n: int) -> list[int]:
    """The 64 bits in ``n`` runs, as masks."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]


def dealt_masks(df: DataFrame, bits: str, n: int) -> list[int]:
    """The 64 bits dealt to ``n`` masks, those that tell most first and to and fro.

    Bits that are nearly always the same tell little: a band of such bits would
    have one value for most rows. Dealt out by how even they are, they leave
    every band about as many values. One row of shares is gathered.
    """
    shares = df.agg(*[F.avg(F.shiftrightunsigned(F.col(bits), i).bitwiseAND(F.lit(1))) for i in range(64)]).first()
    turn = sorted(range(64), key=lambda i: (abs((0.5 if shares[i] is None else shares[i]) - 0.5), i))
    masks = [0] * n
    for place, bit in enumerate(turn):
        lap, at = divmod(place, n)
        masks[n - 1 - at if lap % 2 else at] |= 1 << bit
    return masks


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def bands(df: DataFrame, bits: str, masks: Sequence[int]) -> DataFrame:
    """One row per mask, with the bits it leaves: hashes that differ in fewer bits than there are masks agree under one of them."""
    parts = [F.struct(F.lit(i).alias("band"), F.col(bits).bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)]
    return df.select("*", F.inline(F.array(*parts)))


def spread(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """A join of exploded sides, shuffled: Spark takes a side's size from before the explode, so it would broadcast tables of many times its limit."""
    return left.hint("merge").join(right.hint("merge"), on)


#: Up to this radius a band has ten bits or more, and an equi-join on bands meets few pairs that are not near.
BANDED = 5
#: Up to this radius one of four 16-bit bands differs by two bits at most.
PROBED = 11
#: Rows of one side that a task compares with as many of the other.
BLOCK = 8192


def hamming_join(left: DataFrame, right: DataFrame, id_col: str, bits: str, within: int, ordered: bool = False, masks: Sequence[int] | None = None) -> DataFrame:
    """(a, b, distance): pairs within ``within`` bits; ordered: only a < b (a self-join).

    masks: the within + 1 bands of small radii, if not runs of bits. Small radii: an equi-join on bands, exact by the pigeonhole principle; a
    pair that agrees in several bands is reported by the first of them alone,
    so no distinct is needed. Up to ``PROBED`` bits: :func:`multi_index`. Larger
    radii, where bands would be a few bits that most rows share: :func:`blockwise`.
    """
    if within > PROBED:
        return blockwise(left, right, id_col, bits, within, ordered)
    if within > BANDED:
        return multi_index(left, right, id_col, bits, within, ordered)
    masks = even_masks(within + 1) if masks is None else masks
    a = bands(left.select(F.col(id_col).alias("a"), F.col(bits).alias("x")), "x", masks)
    b = bands(right.select(F.col(id_col).alias("b"), F.col(bits).alias("y")), "y", masks)
    near = hamming(F.col("x"), F.col("y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    meets = (F.col("l.band") == F.col("r.band")) & (F.col("l.value") == F.col("r.value"))
    if ordered:
        meets = meets & (F.col("a") < F.col("b"))
    pairs = spread(a.alias("l"), b.alias("r"), meets).where((near <= within) & (first == F.col("l.band")))
    return pairs.select("a", "b", near.alias("distance"))


def band_of(bits: Column, band: int) -> Column:
    """The 16 bits of a band, the lowest first."""
    return F.shiftrightunsigned(bits, 16 * band).bitwiseAND(F.lit(0xFFFF)).cast("int")


def multi_index(left: DataFrame, right: DataFrame, id_col: str, bits: str, within: int, ordered: bool = False) -> DataFrame:
    """(a, b, distance) of pairs within up to ``PROBED`` bits, by probing four bands of 16 bits.

    Within 4 r + 3 bits some band differs by r at most, r being 1 or 2. Both
    sides give every value one bit away from their bands, and their own, and
    meet in the middle by an equi-join: 17 rows a band and side, not the 137
    values within two bits. A pair meets once: in the first band that is near
    enough, at its own value (r = 0), at the left one's (r = 1), or at the left
    one's with the lowest differing bit turned (r = 2).
    """
    if not BANDED - 2 <= within <= PROBED:
        raise ValueError(f"multi_index takes 4 to {PROBED} bits")
    reach = within // 4

    def probed(df: DataFrame, key: str, value: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias(key), F.col(bits).alias(value)).where(F.col(value).isNotNull())
        banded = rows.select("*", F.posexplode(F.array(*[band_of(F.col(value), i) for i in range(4)])).alias("band", "own"))
        turned = F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)])
        return banded.select(key, value, "band", F.explode(F.transform(turned, lambda t: F.col("own").bitwiseXOR(t))).alias("spot"))

    a, b = probed(left, "a", "x"), probed(right, "b", "y")
    meets = (F.col("l.band") == F.col("r.band")) & (F.col("l.spot") == F.col("r.spot"))
    if ordered:
        meets = meets & (F.col("a") < F.col("b"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    parts = [band_of(differ, i) for i in range(4)]
    first = F.coalesce(*[F.when(F.bit_count(p) <= reach, F.lit(i)) for i, p in enumerate(parts)])
    own, apart = F.get(F.array(*[band_of(F.col("x"), i) for i in range(4)]), F.col("l.band")), F.get(F.array(*parts), F.col("l.band"))
    lowest = apart.bitwiseAND(-apart)
    middle = F.when(F.bit_count(apart) == 2, own.bitwiseXOR(lowest)).otherwise(own)
    near = F.bit_count(differ)
    pairs = spread(a.alias("l"), b.alias("r"), meets).where((near <= within) & (first == F.col("l.band")) & (middle == F.col("l.spot")))
    return pairs.select("a", "b", near.alias("distance"))


def distinct_values(df: DataFrame, id_col: str, bits: str) -> DataFrame:
    """(id, bits, copies): one row for each value, with its smallest id and how many rows have it."""
    return df.groupBy(bits).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")).select(id_col, bits, "copies")


def near_values(df: DataFrame, id_col: str, bits: str, within: int) -> DataFrame:
    """(a, b, distance, copies_a, copies_b): near pairs of different values, each by its smallest id.

    Rows of one value are never paired with each other, so a value that half
    the table has costs no more than any other.
    """
    values = distinct_values(df, id_col, bits)
    pairs = hamming_join(values, values, id_col, bits, within, ordered=True)
    of = lambda side: values.select(F.col(id_col).alias(side), F.col("copies").alias(f"copies_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "distance", "copies_a", "copies_b")


def blockwise(left: DataFrame, right: DataFrame, id_col: str, bits: str, within: int, ordered: bool = False, keep: str = "all") -> DataFrame:
    """(a, b, distance) of pairs within ``within`` bits, for radii at which most pairs have to be compared.

    Both sides are dealt to blocks of about ``BLOCK`` rows by a hash of the id;
    a task compares one block with one other in numpy. keep: all pairs; of each
    b and block the smallest a (first), or any a (any); or links that connect
    what the pairs of two blocks connect (spanning, without distances): what is
    moved on then grows with the rows, not with the pairs.
    """
    kind = left.schema[id_col].dataType.simpleString()
    rows = lambda df: df.select(F.col(id_col).alias("id"), F.col(bits).alias("bits")).where("id IS NOT NULL AND bits IS NOT NULL")
    a, b = rows(left), rows(right)
    m, n = (max(1, -(-x.count() // BLOCK)) for x in (a, b))
    if ordered:  # one table: a block meets itself and the later ones
        m = n = max(m, n)
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a, b = a.withColumn("i", block(m)), b.withColumn("j", block(n))
    a = a.withColumn("j", F.explode(F.sequence(F.col("i") if ordered else F.lit(0), F.lit(n - 1))))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if ordered else F.lit(m - 1))))

    def connect(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """A link from every row to the first of those it is connected with."""
        ids, at = np.unique(np.concatenate([p["id"].to_numpy(), q["id"].to_numpy()]), return_inverse=True)
        x, y = (side["bits"].to_numpy(np.int64).view(np.uint64) for side in (p, q))
        label = np.arange(len(ids))
        for k in range(0, len(x), 512):
            u, v = np.nonzero(np.bitwise_count(x[k : k + 512, None] ^ y[None, :]) <= within)
            while True:  # every round gives each label the least one that it is linked to
                one, other = label[at[k + u]], label[at[len(x) + v]]
                if (one == other).all():
                    break
                least = np.arange(len(ids))
                np.minimum.at(least, np.maximum(one, other), np.minimum(one, other))
                label = least[label]
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[label[linked]], "b": ids[linked], "distance": np.zeros(len(linked), np.int32)})

    def compare(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if keep == "spanning":
            return connect(p, q)
        out = []
        x, y = (side["bits"].to_numpy(np.int64).view(np.uint64) for side in (p, q))
        ids, others = p["id"].to_numpy(), q["id"].to_numpy()
        same = ordered and len(p) and len(q) and p["i"].iloc[0] == q["j"].iloc[0]
        for at in range(0, len(x), 512):
            apart = np.bitwise_count(x[at : at + 512, None] ^ y[None, :])
            u, v = np.nonzero(apart <= within)
            found = pd.DataFrame({"a": ids[at + u], "b": others[v], "distance": apart[u, v].astype(np.int32)})
            if ordered:
                if same:
                    found = found[found["a"] < found["b"]]
                else:
                    turned = found["a"] > found["b"]
                    found.loc[turned, ["a", "b"]] = found.loc[turned, ["b", "a"]].to_numpy()
                    found = found[found["a"] != found["b"]]
            out.append(found)
        found = pd.concat(out) if out else pd.DataFrame({"a": ids[:0], "b": others[:0], "distance": np.empty(0, np.int32)})
        return found if keep == "all" else found.sort_values(["b", "a"]).drop_duplicates("b")

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(compare, f"a {kind}, b {kind}, distance int")


def links(df: DataFrame, id_col: str, bits: str, within: int) -> DataFrame:
    """(a, b): rows to link so that those within ``within`` bits are connected."""
    near = hamming_join(df, df, id_col, bits, within, ordered=True) if within <= PROBED else blockwise(df, df, id_col, bits, within, ordered=True, keep="spanning")
    return near.select("a", "b")


def within_reach(left: DataFrame, right: DataFrame, id_col: str, bits: str, within: int) -> DataFrame:
    """The rows of ``left`` that have a row of ``right`` within ``within`` bits."""
    if within > PROBED:
        near = blockwise(right, left, id_col, bits, within, keep="any").select(F.col("b").alias(id_col)).distinct()
    else:
        near = hamming_join(left, right, id_col, bits, within).select(F.col("a").alias(id_col)).distinct()
    return left.join(near, id_col, "left_semi")


def examples(left: DataFrame, right: DataFrame, id_col: str, bits: str, within: int, n: int = 10) -> DataFrame:
    """The first ``n`` pairs of rows of the two sides within ``within`` bits, by their ids."""
    return hamming_join(left, right, id_col, bits, within).orderBy("a", "b").limit(n)


def first_earlier(df: DataFrame, id_col: str, bits: str, within: int, accepted: Column | None = None) -> DataFrame:
    """(id, near): the earliest accepted id before each row that is within ``within`` bits; only rows that have one.

    accepted: which rows others are compared with; all, if not given. Rows that
    are not accepted are neither compared with nor get a row.
    """
    rows = df if accepted is None else df.where(accepted)
    # of equal hashes only the first can be anyone's answer, so copies by the thousand are one row here
    firsts = materialize(rows.where(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(id_col).alias(id_col)))
    masks = dealt_masks(firsts, bits, within + 1) if within <= BANDED else None
    pairs = hamming_join(firsts, firsts, id_col, bits, within, ordered=True, masks=masks) if within <= PROBED else blockwise(firsts, firsts, id_col, bits, within, ordered=True, keep="first")
    best = pairs.groupBy(F.col("b").alias(id_col)).agg(F.min("a").alias("__a"))
    known = firsts.join(best, id_col, "left").select(bits, F.coalesce("__a", id_col).alias("near"))
    return rows.select(id_col, bits).join(known, bits).where(F.col("near") < F.col(id_col)).select(id_col, "near")


def distinct_first(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """``df`` with first: the earliest id of equal keys; a row is its own first if no earlier one has its key."""
    first = df.groupBy(key).agg(F.min(id_col).alias("first"))
    return df.join(first, key)


def key_edges(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(a, b): every row is linked to the smallest id of each key it has; null keys link nothing."""
    tagged = df.select(F.col(id_col).alias("b"), F.explode(F.array(*[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])).alias("key")).where("key IS NOT NULL")
    least = tagged.groupBy("key").agg(F.min("b").alias("a"))
    return tagged.join(least, "key").where("a <> b").select("a", "b")
