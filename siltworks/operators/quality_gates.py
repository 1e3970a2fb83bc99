"""Status cascades and constraint checks. A check gives the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(*cases: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first case that holds."""
    found = F
    for name, holds in cases:
        found = found.when(holds, name)
    return found.otherwise(otherwise)


def review_status(issues: Column, unmapped: Column, stale: Column, action: Column, complete: Column, prior: Column, empty: Column, required: bool) -> Column:
    """A record's status: the first rule that applies, in the fixed order.

    action: a reviewer's decision or null; complete: whether an approval has
    all its confirmations; prior: quarantined before; required: whether rows
    without review wait for one.
    """
    said = lambda x: F.coalesce(action == x, F.lit(False))
    return cascade(
        ("excluded_unmapped", unmapped),
        ("quarantine_stale_review", action.isNotNull() & stale),
        ("excluded_review", said("exclude")),
        ("quarantine_invalid", issues),
        ("approved", said("approve") & complete),
        ("quarantine_incomplete_approval", said("approve")),
        ("quarantine_review", said("quarantine") | said("repair")),
        ("quarantine_prior_review", prior),
        ("quarantine_empty", empty),
        otherwise="pending_review" if required else "provisional",
    )


def stale(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether any recorded hash differs from the current one; null compares as empty."""
    same = F.lit(True)
    for now, then in pairs:
        same = same & (F.coalesce(now, F.lit("")) == F.coalesce(then, F.lit("")))
    return ~same


def outcome(reasons: Column, flags: Column) -> Column:
    """reject with any reason, else needs_review with any flag, else pass."""
    return F.when(F.size(reasons) > 0, "reject").when(F.size(flags) > 0, "needs_review").otherwise("pass")


def codes(**when: Column) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in when.items()]), lambda x: x.isNotNull())


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """(violation, key, rows): child keys that no parent has."""
    lost = child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return lost.groupBy(F.col(child_key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("violation"), "key", "rows")


def repeated(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(violation, key, rows): keys of several rows."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return many.select(F.lit(name).alias("violation"), F.concat_ws("/", *keys).alias("key"), "rows")


def crossing(df: DataFrame, group: str, split: str, name: str = "group_crosses_splits") -> DataFrame:
    """(violation, key, rows): groups found in several splits."""
    return df.groupBy(F.col(group).cast("string").alias("key")).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).where("splits > 1").select(F.lit(name).alias("violation"), "key", "rows")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has; empty if the key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left").alias("side"), F.col(key).alias("key")).unionByName(b.join(a, key, "left_anti").select(F.lit("right").alias("side"), F.col(key).alias("key")))


def require_empty(violations: DataFrame, what: str) -> None:
    """Stop unless a check found nothing; a few offenders are named."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(str(tuple(r)) for r in some))


def prediction_problem(cid: Column, conf: Column, box: Sequence[Column], classes: int) -> Column:
    """Why a prediction is not valid, or null."""
    x1, y1, x2, y2 = box
    bad = F.lit(False)
    for v in (cid.cast("double"), conf, *box):
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(bad, "nonfinite").when((cid != F.floor(cid)) | (cid < 0) | (cid >= classes), "class").when((conf < 0) | (conf > 1), "confidence")
        .when((x1 < 0) | (y1 < 0) | (x2 > 1) | (y2 > 1) | (x1 > x2) | (y1 > y2), "box")
    )
