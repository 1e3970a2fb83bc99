"""A study's plan, runs and reports as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .selection import identity


def plan_problems(config: Mapping, backends: Sequence[str], kinds: Sequence[str]) -> list[str]:
    """What is wrong with a study's grid; backends and kinds: those that there are, of models and arms."""
    found = []
    seeds, models, arms = config.get("seeds") or [], config.get("models") or {}, config.get("arms") or {}
    if not seeds or len(set(seeds)) != len(seeds):
        found.append("seeds must be given and differ")
    if not models or any(m.get("backend") not in backends for m in models.values()):
        found.append(f"models must be given, with a backend of {list(backends)}")
    if not arms or any(a.get("kind") not in kinds for a in arms.values()):
        found.append(f"arms must be given, with a kind of {list(kinds)}")
    return found


def sources_of(selected: Sequence[str], supported: Mapping[str, str], pool: bool) -> list[str]:
    """Ids of the selected sources: unique, supported, and several only where pooling is allowed."""
    if not selected or len(set(selected)) != len(selected):
        raise ValueError("sources must be given and differ")
    unknown = [s for s in selected if s not in supported]
    if unknown:
        raise ValueError(f"unsupported sources: {unknown}")
    if len(selected) > 1 and pool is not True:
        raise ValueError("several sources need pooling")
    return [supported[s] for s in selected]


def class_map(spark: SparkSession, config: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(source, raw, target): the configured class maps as a table of a few rows."""
    return spark.createDataFrame([(s, raw, target) for s, classes in config.items() for raw, target in classes.items()], "source string, raw string, target string")


def remapped(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """``boxes`` (source, raw) with target and issue: classes without a target have the issue ``unmapped_class:<raw>``."""
    found = boxes.join(F.broadcast(mapping), ["source", "raw"], "left")  # a table of the configuration
    return found.withColumn("issue", F.when(F.col("target").isNull(), F.concat(F.lit("unmapped_class:"), "raw")))


def stored_plan(payload: Mapping) -> dict:
    """A plan with its identity."""
    return {**payload, "plan_identity": identity(payload)}


def plan_problem(stored: Mapping, code: str, split: str, weights: Mapping[str, str | None]) -> str | None:
    """Why a stored plan can't go on: changed itself, or its code, data or weights."""
    body = {k: v for k, v in stored.items() if k != "plan_identity"}
    if identity(body) != stored.get("plan_identity"):
        return "the plan changed"
    if stored["code_identity"] != code:
        return "the code changed"
    if stored["split_manifest_sha256"] != split:
        return "the data changed"
    for name, planned in stored["weights"].items():
        if planned is None:
            return f"{name} had no weights when planned"
        if weights.get(name) != planned:
            return f"the weights of {name} changed"
    return None


def changed_records(records: DataFrame, now: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """(key, hash): records whose file's hash is not the recorded one, or that have no file."""
    there = now.select(key, *[F.col(h).alias(f"__{h}") for h in hashes])
    rows = records.select(key, *hashes).join(there, key, "left")
    return rows.select(key, F.explode(F.filter(F.array(*[F.when(~F.col(h).eqNullSafe(F.col(f"__{h}")), F.lit(h)) for h in hashes]), lambda x: x.isNotNull())).alias("hash"))


def run_rows(jobs: DataFrame, status: DataFrame, metrics: DataFrame, plan: str) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage): jobs with the metrics they have, by split, and the state of every job.

    A metric of another plan is an error when it is read; jobs without metrics have no row.
    """
    foreign = F.when(F.col("plan_identity") == plan, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("metric from another study: "), "job")).cast("boolean"))
    return jobs.join(metrics.where(foreign), "job"), jobs.join(status, "job", "left").withColumn("state", F.coalesce("state", F.lit("pending")))


def per_class(metrics: DataFrame, names: str, *lists: str) -> DataFrame:
    """A row per class of lists that run in parallel, paired by position."""
    return metrics.select("*", F.inline(F.arrays_zip(*[F.col(c) for c in (names, *lists)])).alias(*[f"{c}_" for c in (names, *lists)])).drop(names, *lists).withColumnsRenamed({f"{c}_": c for c in (names, *lists)})


def shared_seeds(runs: DataFrame, keys: Sequence[str], arm: str, reference: str, seed: str) -> DataFrame:
    """(keys..., arm, seeds, pairs): the seeds that an arm and the reference arm both have; arms without any stay."""
    base = runs.where(F.col(arm) == reference).groupBy(*keys).agg(F.collect_set(seed).alias("__base"))
    rows = runs.where(F.col(arm) != reference).groupBy(*keys, arm).agg(F.collect_set(seed).alias("__own")).join(base, list(keys), "left")
    both = F.array_sort(F.array_intersect("__own", F.coalesce("__base", F.array().cast(base.schema["__base"].dataType))))
    return rows.select(*keys, arm, F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("seeds"), F.size(both).cast("long").alias("pairs"))


def blends(placements: DataFrame, backgrounds: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placements with their background and candidate, violations) of the approved placements.

    placements: id, background, background_sha256, candidate, x, y, w, h,
    approved, reviewer, placement_valid; backgrounds: background, sha256, width,
    height, targets (structs with x1, y1, x2, y2 in shares); candidates:
    candidate, cls. Violations in a fixed order, one per placement.
    """
    rows = placements.where("approved").join(backgrounds.withColumnRenamed("sha256", "sha_now"), "background", "left").join(candidates.withColumn("known", F.lit(True)), "candidate", "left")
    again = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    box = [F.col("x") / F.col("width"), F.col("y") / F.col("height"), (F.col("x") + F.col("w")) / F.col("width"), (F.col("y") + F.col("h")) / F.col("height")]
    covers = F.exists("targets", lambda t: geometry.overlap(box, [t["x1"], t["y1"], t["x2"], t["y2"]]) > 0)
    fits = (F.least("x", "y") >= 1) & (F.least("w", "h") >= 4) & (F.col("x") + F.col("w") < F.col("width")) & (F.col("y") + F.col("h") < F.col("height"))
    problem = (
        F.when(again, "repeated").when((F.coalesce("reviewer", F.lit("")) == "") | ~F.coalesce("placement_valid", F.lit(False)), "incomplete").when(F.col("width").isNull(), "background_outside_subset")
        .when(F.col("known").isNull(), "candidate_not_approved").when(~F.col("sha_now").eqNullSafe(F.col("background_sha256")), "background_changed").when(~fits, "rectangle").when(covers, "overlaps")
    )
    marked = rows.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem", "known", "sha_now"), marked.where("problem IS NOT NULL").select(F.col("problem").alias("violation"), F.col("id").cast("string").alias("key"))


def composites_within(composites: DataFrame, subset: DataFrame, background: str, stem: str) -> DataFrame:
    """Composites whose background is in the training subset."""
    return composites.join(subset.select(F.col(stem).alias(background)), background, "left_semi")


def progress(log: DataFrame, session: str, step: str, at: str, done: str, total: str, every: float) -> DataFrame:
    """``log`` with percent, rate and eta: one row per ``every`` seconds of a session at most, the first and last among them.

    Rates count from the session's first row, so a resumed run is not judged by
    the pause before it.
    """
    w = Window.partitionBy(session).orderBy(step)
    seconds = F.col(at).cast("timestamp").cast("double")
    first, last = F.first(seconds).over(w), F.row_number().over(Window.partitionBy(session).orderBy(F.desc(step))) == 1
    rows = log.withColumns({"__t": seconds - first, "__d": F.col(done) - F.first(done).over(w), "__last": last})
    tick = F.floor(F.col("__t") / every)
    shown = rows.withColumn("__new", F.coalesce(F.lag(tick).over(w) != tick, F.lit(True))).where(F.col("__new") | F.col("__last"))
    rate = F.when(F.col("__t") > 0, F.col("__d") / F.col("__t"))
    out = shown.withColumns({"percent": 100 * F.col(done) / F.col(total), "rate": rate, "eta": F.when(rate > 0, (F.col(total) - F.col(done)) / rate)})
    return out.drop("__t", "__d", "__last", "__new")


def environment() -> dict[str, str]:
    """What a run was made with."""
    import platform

    import numpy
    import pandas
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "platform": platform.platform(), **{m.__name__: m.__version__ for m in (pyspark, numpy, pandas, pyarrow)}}


def names_differ(checkpoint: Mapping[int, str], names: Sequence[str]) -> bool:
    """Whether a checkpoint's classes, in the order of their ids, are not these."""
    return [checkpoint[k] for k in sorted(checkpoint)] != list(names)


class RowProviders:
    """Who gives a job its training rows, by the kind of its arm; a study may register its own."""

    def __init__(self) -> None:
        self._by_kind: dict[str, object] = {}

    def register(self, kind: str, provider) -> None:
        self._by_kind[kind] = provider

    def rows(self, kind: str, *args) -> DataFrame:
        if kind not in self._by_kind:
            raise ValueError(f"no rows for arms of the kind {kind!r}")
        return self._by_kind[kind](*args)


def ema_keep(step: Column, decay: float) -> Column:
    """How much of a moving average stays at a step that is still warming up."""
    return F.least(F.lit(decay), (1 + step) / (10 + step))


def kimg(step: Column, batch: int) -> Column:
    """Thousands of images shown up to a step."""
    return step * batch / 1000
