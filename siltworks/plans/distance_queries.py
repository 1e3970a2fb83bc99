"""Near-duplicate joins at each surveyed radius, over sign hashes with planted neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neardup
from .registry import BITS, hashes, query


def planted(spark, d) -> DataFrame:
    """Every embedding's sign hash, and a neighbour of it with 0 to 11 bits turned: as many as its id modulo 12."""
    rows = hashes(spark, d)
    spots = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda j: F.when(j < F.col("vec_id") % 12, (F.col("vec_id") * 7 + j * 5) % 64))
    turned = F.aggregate(spots, F.col("bits"), lambda x, s: F.when(s.isNotNull(), x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(s, F.lit(0)).cast("int")))).otherwise(x))
    return rows.select((F.col("vec_id") * 2).alias("id"), "label", "bits").unionByName(rows.select((F.col("vec_id") * 2 + 1).alias("id"), "label", turned.alias("bits")))


PLANTED = f"""
    s AS ({BITS}),
    p AS (SELECT vec_id * 2 AS id, label, bits FROM s UNION ALL
          SELECT vec_id * 2 + 1, label, xor(bits, coalesce(list_sum(list_transform(range(0, vec_id % 12), lambda j: 1::HUGEINT << ((vec_id * 7 + j * 5) % 64)::INTEGER)), 0)::UBIGINT) FROM s)
"""
VALUES = f"WITH {PLANTED}, v AS (SELECT min(id) AS id, bits, count(*) AS copies FROM p GROUP BY bits)"
PAIRS = VALUES + " SELECT x.id AS a, y.id AS b, bit_count(xor(x.bits, y.bits))::INTEGER AS distance, x.copies AS copies_a, y.copies AS copies_b FROM v x JOIN v y ON x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= {}"


@query(PAIRS.format(5))
def hamming_pairs_5(spark, d):
    return neardup.near_values(planted(spark, d), "id", "bits", 5)


@query(PAIRS.format(8))
def hamming_pairs_8(spark, d):
    return neardup.near_values(planted(spark, d), "id", "bits", 8)


@query(PAIRS.format(10))
def hamming_pairs_10(spark, d):
    return neardup.near_values(planted(spark, d), "id", "bits", 10)


@query(f"""
    WITH {PLANTED}, l AS (SELECT id, bits FROM p WHERE id % 2 = 0), r AS (SELECT id, bits FROM p WHERE id % 2 = 1),
    n AS (SELECT l.id AS a, r.id AS b, bit_count(xor(l.bits, r.bits)) AS distance FROM l JOIN r ON bit_count(xor(l.bits, r.bits)) <= 10)
    SELECT within, side, n FROM (SELECT unnest([0, 5, 10])::INTEGER AS within) w, LATERAL (
        SELECT 'left' AS side, count(DISTINCT a) AS n FROM n WHERE distance <= w.within UNION ALL SELECT 'right', count(DISTINCT b) FROM n WHERE distance <= w.within)
""")
def hamming_semijoin_radii(spark, d):
    """How many rows of either side have one of the other side within 0, 5 and 10 bits."""
    rows = planted(spark, d)
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    out = None
    for within in (0, 5, 10):
        for side, a, b in (("left", left, right), ("right", right, left)):
            # rows of one value share its neighbours: values are joined, copies counted
            near = neardup.within_reach(neardup.distinct_values(a, "id", "bits"), neardup.distinct_values(b, "id", "bits"), "id", "bits", within)
            part = near.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).select(F.lit(within).alias("within"), F.lit(side).alias("side"), "n")
            out = part if out is None else out.unionByName(part)
    return out


@query(f"{VALUES} SELECT y.id, min(x.id) AS near FROM v x JOIN v y ON x.id < y.id AND bit_count(xor(x.bits, y.bits)) <= 10 GROUP BY y.id")
def near_dup_first_match_10(spark, d):
    return neardup.first_earlier(neardup.distinct_values(planted(spark, d), "id", "bits"), "id", "bits", 10)
