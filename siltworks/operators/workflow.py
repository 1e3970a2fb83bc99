"""Jobs, reviews and receipts: the state around the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_hash

STATES = ("pending", "running", "complete", "failed", "blocked_review")


def grid(subsets: DataFrame, arms: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One job per subset, arm and model; the lists are exploded, nothing is joined."""
    if len(set(arms)) != len(arms) or len(set(models)) != len(models):
        raise ValueError("arms and models must differ")
    each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    jobs = subsets.withColumn("arm", each(arms)).withColumn("model", each(models))
    return jobs.withColumn("job", F.concat_ws("_", "subset", "arm", "model"))


def eligible(jobs: DataFrame, status: DataFrame, split: str = "val", retry_failed: bool = False, metrics: DataFrame | None = None, models: Sequence[str] | None = None, arms: Sequence[str] | None = None) -> DataFrame:
    """Jobs that may run on a split: not complete, not failed (unless retried), and for the test split complete on val.

    Jobs that wait for a review stay eligible: the review may have come in.
    metrics: (job, split) of the results there are; complete jobs without any
    run again. models, arms: only these.
    """
    of = lambda s: status.where(F.col("split") == s).select("job", F.col("state").alias(f"__{s}"))
    rows = jobs.join(of(split), "job", "left")
    for column, names in (("model", models), ("arm", arms)):
        if names is not None:
            rows = rows.where(F.col(column).isin(list(names)))
    state = F.coalesce(F.col(f"__{split}"), F.lit("pending"))
    done = state == "complete"
    if metrics is not None:
        rows = rows.join(metrics.where(F.col("split") == split).select("job", F.lit(True).alias("__metrics")).distinct(), "job", "left")
        done = done & F.coalesce("__metrics", F.lit(False))
    fine = ~done
    if not retry_failed:
        fine = fine & (state != "failed")
    if split == "test":
        rows = rows.join(of("val"), "job", "left")
        fine = fine & F.coalesce(F.col("__val") == "complete", F.lit(False))
    return rows.where(fine).drop(f"__{split}", "__val", "__metrics")


def advance(status: DataFrame, changes: DataFrame, keys: Sequence[str] = ("job", "split")) -> DataFrame:
    """The status table with the latest change of each key (by seq) in place of its row."""
    last = changes.groupBy(*keys).agg(F.max_by("state", "seq").alias("__state"))
    return status.join(last, list(keys), "full_outer").select(*keys, F.coalesce("__state", "state").alias("state"))


def provenance(patches: DataFrame, sources: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """(violation, key): patches without source, or whose recorded columns differ from it."""
    a, b = patches.select(on, *columns), sources.select(on, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    rows = a.join(b, on, "left")
    differ = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    what = F.when(F.col("__there").isNull(), F.lit("no_source")).when(F.size(differ) > 0, F.array_join(differ, "+"))
    return rows.select(what.alias("violation"), F.col(on).cast("string").alias("key")).where("violation IS NOT NULL")


def receipt_problem(receipt: Mapping[str, Column], version: int, stage: str, fingerprint: Column, override: Column) -> Column:
    """Why a screening receipt (version, stage, fingerprint, outcome) does not admit its row, or null."""
    return (
        F.when(receipt["version"].isNull(), "missing").when(receipt["version"] != version, "version").when(receipt["stage"] != stage, "stage")
        .when(~receipt["fingerprint"].eqNullSafe(fingerprint), "stale").when(receipt["outcome"] == "reject", "rejected")
        .when((receipt["outcome"] == "needs_review") & (F.coalesce(override, F.lit("")) == ""), "needs a reason")
    )


def rescreened(rows: DataFrame, receipt: Column, approvals: Sequence[str]) -> DataFrame:
    """Rows with a new receipt; approvals given under the old one are cleared."""
    clear = {c: F.lit(None).cast(rows.schema[c].dataType) for c in approvals}
    return rows.withColumns({"screening": receipt, **clear})


CONFIRM = {"candidate": ("defect_present", "class_correct"), "placement": ("placement_valid",), "composite": ("placement_valid", "defect_present")}


def decide(rows: DataFrame, decisions: DataFrame, stage: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows with the decisions, violations): an approval needs a reviewer and all confirmations of its stage.

    The whole batch counts or none of it: apply the rows only if the violations are empty.
    """
    confirms = CONFIRM[stage]
    unknown = decisions.join(rows, key, "left_anti").select(F.lit("unknown").alias("violation"), F.col(key).cast("string").alias("key"))
    again = decisions.groupBy(key).count().where("count > 1").select(F.lit("repeated").alias("violation"), F.col(key).cast("string").alias("key"))
    whole = F.lit(True)
    for c in confirms:
        whole = whole & F.coalesce(F.col(c), F.lit(False))
    short = decisions.where(F.col("approved") & (~whole | (F.coalesce("reviewer", F.lit("")) == ""))).select(F.lit("incomplete").alias("violation"), F.col(key).cast("string").alias("key"))
    fields = ["approved", "reviewer", *confirms]
    new = decisions.select(key, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__given"))
    kept = [c for c in rows.columns if c not in fields]
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    done = rows.join(new, key, "left").select(*kept, *[F.when(F.col("__given"), F.col(f"__{c}")).otherwise(old(c)).alias(c) for c in fields])
    return done, unknown.unionByName(again).unionByName(short)


def imported(manifest: DataFrame, found: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """(violation, key) of an exchange that came back: its keys must be the manifest's, its hashes unchanged."""
    a = manifest.select(key, *[F.col(c).alias(f"__{c}") for c in hashes], F.lit(True).alias("__a"))
    b = found.select(key, *hashes, F.lit(True).alias("__b"))
    rows = a.join(b, key, "full_outer")
    changed = F.lit(False)
    for c in hashes:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    what = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(changed, "changed")
    return rows.select(what.alias("violation"), F.col(key).cast("string").alias("key")).where("violation IS NOT NULL")


def outcomes(rows: DataFrame, approved: str = "approved") -> DataFrame:
    """(approve, reject, pending): how many rows were decided which way."""
    return rows.agg(F.count_if(F.col(approved)).alias("approve"), F.count_if(~F.col(approved)).alias("reject"), F.count_if(F.col(approved).isNull()).alias("pending"))


def augmentation_verdict(says: Column, exported: Column, copies: Column, denied: Column) -> Column:
    """Whether a source is augmented: any sign, unless its README denies it."""
    return F.when(denied, "un-augmented").when(says | exported | (copies > 0), "augmented").otherwise("un-augmented")


def containment_note(matched: Column, smaller: Column) -> Column:
    return F.when(matched > 0.9 * smaller, "contained").otherwise("separate")


def stream_key(value: Column) -> Column:
    """The identity of a JSON document, for plans and receipts."""
    return canonical_hash(value)
