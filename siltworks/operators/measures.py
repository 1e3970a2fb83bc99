"""Detection and classification measures as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stored

#: Detections of a range that one task takes.
RANGE_ROWS = 1_000_000


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1): precision and f1 are 0 where undefined, recall is null."""
    ratio = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    return ratio(tp, tp + fp, F.lit(0.0)), ratio(tp, tp + fn, F.lit(None).cast("double")), ratio(2 * tp, 2 * tp + fp + fn, F.lit(0.0))


def counts(hits: DataFrame, by: Sequence[str] = ("cid",)) -> DataFrame:
    """tp, fp, fn and their rates per key, from rows marked tp, fp or fn."""
    n = hits.groupBy(*by).agg(*[F.count_if(F.col("hit") == h).alias(h) for h in ("tp", "fp", "fn")])
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": f})


def sweep(scored: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of the rule score >= threshold, in one pass."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    said = F.col(score) >= F.col("threshold")
    true = F.col(truth) == 1
    n = scored.withColumn("threshold", each).groupBy("threshold").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.withColumns({"precision": p, "recall": r, "f1": f})


def curve(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], hit: str) -> DataFrame:
    """``rows`` with tp, n and envelope: hits and rows up to each, and the best precision from it on, in the order of each key.

    Rows are dealt by ranges of (key, order), so a key of any size lies in
    several tasks; only sums per key and range are put in order as a whole.
    """
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns({**dict(zip(names, order)), "__h": F.col(hit).cast("int")})
    ranged = materialize(keyed.repartitionByRange(*keys, *names).withColumn("__range", F.spark_partition_id()))
    inner = Window.partitionBy("__range", *keys).orderBy(*names)
    turned = Window.partitionBy("__range", *keys).orderBy(*[F.desc(c) for c in names])
    within = ranged.withColumn("__tp", F.sum("__h").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(inner))

    def beside(frame: DataFrame, sums: DataFrame) -> DataFrame:
        other = sums.select(*[F.col(c).alias(f"{c}__s") for c in ("__range", *keys)], *[c for c in sums.columns if c not in ("__range", *keys)])
        same = F.lit(True)
        for c in ("__range", *keys):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}__s"))
        return frame.join(other, same).drop(*[f"{c}__s" for c in ("__range", *keys)])

    ranges = Window.partitionBy(*keys).orderBy("__range")
    sums = ranged.groupBy("__range", *keys).agg(F.sum("__h").alias("__a"), F.count(F.lit(1)).alias("__b"))
    ahead = lambda c: F.coalesce(F.sum(c).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__range", *keys, ahead("__a").alias("__ahead"), ahead("__b").alias("__rows"))
    whole = beside(within, sums).withColumns({"tp": F.col("__tp") + F.col("__ahead"), "n": F.col("__n") + F.col("__rows")}).withColumn("__p", F.col("tp") / F.col("n"))
    best = whole.groupBy("__range", *keys).agg(F.max("__p").alias("__m"))
    # frames that begin at the partition's start grow by one row each; those that reach to its end are gone through anew for every row
    back = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.select("__range", *keys, F.max("__m").over(back).alias("__later"))
    found = beside(whole, best).withColumn("envelope", F.greatest(F.max("__p").over(turned.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("__later", F.lit(0.0))))
    return found.drop("__range", "__h", "__tp", "__n", "__ahead", "__rows", "__p", "__later", *names)


def area_under(ranked: DataFrame, keys: Sequence[str], total: str, hit: str, points: int = 101) -> DataFrame:
    """(keys..., positives, hits, ap) of rows with tp and envelope; ``total`` is a key's number of targets. Recalls count as reached to 1e-9."""
    # the envelope at recall r is its value at the first row with tp >= r * total: each hit row serves a range of points
    last = F.floor(F.col("tp") * (points - 1) / F.col(total) + 1e-9)
    first = F.floor((F.col("tp") - 1) * (points - 1) / F.col(total) + 1e-9)
    share = F.when(F.col("tp") == 1, last + 1).otherwise(last - first)
    served = ranked.withColumn("__share", F.when((F.col(hit) == 1) & (F.col(total) > 0), share).otherwise(0))
    out = served.groupBy(*keys).agg(F.max(total).alias("positives"), F.sum(hit).alias("hits"), F.sum(F.col("__share") * F.coalesce("envelope", F.lit(0.0))).alias("__area"))
    return out.withColumn("ap", F.when(F.col("positives") > 0, F.col("__area") / points).otherwise(F.lit(-1.0))).drop("__area")


def average_precision(ranked: DataFrame, score: str, hit: str, tie: str, positives: Column | None = None, by: Sequence[str] = (), points: int = 101) -> DataFrame:
    """(by..., positives, ap): precision made non-increasing from the right, sampled at ``points`` recalls.

    ranked: one row per detection; hit is 1 or 0; positives: targets of a key
    (its hits, unless given). Keys without targets have the ap -1.
    """
    keys = [F.col(c) for c in by] or [F.lit(0).alias("__all")]
    names = list(by) or ["__all"]
    rows = ranked.select(*keys, F.col(score).alias("__s"), F.col(hit).cast("int").alias("__hit"), F.col(tie).alias("__t"), (positives if positives is not None else F.lit(None).cast("long")).alias("__given"))
    totals = rows.groupBy(*names).agg(F.coalesce(F.max("__given"), F.sum("__hit")).alias("__total"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    run = curve(rows, names, [-F.col("__s"), F.col("__t")], "__hit").alias("l").join(totals.alias("r"), same).select("l.*", "r.__total")
    out = area_under(run, names, "__total", "__hit", points).drop("hits")
    return out if by else out.drop("__all")


def rates_report(counted: DataFrame, by: str = "cid") -> DataFrame:
    """(scope, name, tp, fp, fn, precision, recall, f1): every class, all counts pooled (micro), and the mean f1 of the classes (macro).

    counted: tp, fp and fn of each class.
    """
    n = counted.groupBy(F.col(by).cast("string").alias("name")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    told = lambda df: df.withColumns(dict(zip(("precision", "recall", "f1"), rates(F.col("tp"), F.col("fp"), F.col("fn")))))
    classes = told(n)
    none = F.lit(None)
    micro = told(n.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    macro = classes.agg(F.avg("f1").alias("f1"))
    columns = ["tp", "fp", "fn", "precision", "recall", "f1"]
    whole = classes.select(F.lit("class").alias("scope"), "name", *columns).unionByName(micro.select(F.lit("micro").alias("scope"), none.cast("string").alias("name"), *columns))
    return whole.unionByName(macro.select(F.lit("macro").alias("scope"), none.cast("string").alias("name"), *[none.cast("long").alias(c) for c in columns[:3]], none.cast("double").alias("precision"), none.cast("double").alias("recall"), "f1"))


def sampled_curve(ranked: DataFrame, keys: Sequence[str], total: str, hit: str, points: int = 101) -> DataFrame:
    """(keys..., point, precision) at the recalls 0, 1 / (points - 1) ... 1 of every key of ``ranked`` (with tp and envelope).

    A point's precision is the envelope at the first row whose recall reaches
    it (to 1e-9), 0 where none does and -1 for keys without targets. Each hit
    row gives the points it is the first to reach, so a curve is cut from its
    ranges wherever they lie.
    """
    last = F.floor(F.col("tp") * (points - 1) / F.col(total) + 1e-9)
    first = F.when(F.col("tp") == 1, F.lit(0)).otherwise(F.floor((F.col("tp") - 1) * (points - 1) / F.col(total) + 1e-9) + 1)
    reached = ranked.where((F.col(hit) == 1) & (F.col(total) > 0)).select(*keys, "envelope", first.cast("int").alias("__f"), last.cast("int").alias("__l")).where("__f <= __l")
    some = reached.select(*keys, "envelope", F.explode(F.sequence("__f", "__l")).alias("point"))
    each = ranked.groupBy(*keys).agg(F.max(total).alias("__total"))
    every = each.select(*keys, "__total", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(None).cast("double").alias("envelope"))
    both = some.select(*keys, F.lit(None).cast("long").alias("__total"), "point", "envelope").unionByName(every)
    out = both.groupBy(*keys, "point").agg(F.max("__total").alias("__total"), F.max("envelope").alias("precision"))
    return out.select(*keys, "point", F.when(F.col("__total") > 0, F.coalesce("precision", F.lit(0.0))).otherwise(F.lit(-1.0)).alias("precision"))


def precision_curves(ranked: DataFrame, score: str, hit: str, tie: str, by: Sequence[str], positives: Column | None = None, points: int = 101) -> DataFrame:
    """(by..., point, precision): the curves whose means are :func:`average_precision`."""
    rows = ranked.select(*by, F.col(score).alias("__s"), F.col(hit).cast("int").alias("__hit"), F.col(tie).alias("__t"), (positives if positives is not None else F.lit(None).cast("long")).alias("__given"))
    totals = rows.groupBy(*by).agg(F.coalesce(F.max("__given"), F.sum("__hit")).alias("__total"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    run = curve(rows, list(by), [-F.col("__s"), F.col("__t")], "__hit").alias("l").join(totals.alias("r"), same).select("l.*", "r.__total")
    return sampled_curve(run, list(by), "__total", "__hit", points)


def class_report(graded: DataFrame) -> DataFrame:
    """(cid, positives, ap50, ap50_95, ar_max) of every class with targets, over all areas.

    graded: as ``matching.graded`` gives it. A class of detections alone has no
    row; its values are undefined.
    """
    named = asked(graded)
    cells = detections(graded, named, ["all"], named["thresholds"])
    half = F.abs(F.col("threshold") - 0.5) < 1e-9
    recall = F.get("hits", F.lit(len(named["limits"]) - 1)) / F.col("positives")
    return cells.groupBy("cid").agg(F.max("positives").alias("positives"), F.max(F.when(half, mean_of("curve"))).alias("ap50"), F.avg(mean_of("curve")).alias("ap50_95"), F.avg(recall).alias("ar_max"))


def detection_curves(graded: DataFrame, threshold: float = 0.5, points: int = 101) -> DataFrame:
    """(cid, point, precision) of every class with targets, over all areas at one overlap threshold; zeros for a class without detections."""
    named = asked(graded)
    cells = detections(graded, named, ["all"], [t for t in named["thresholds"] if abs(t - threshold) < 1e-9], points)
    return cells.select("cid", F.posexplode("curve").alias("point", "precision"))


def asked(graded: DataFrame) -> dict[str, list]:
    """The limits, areas, thresholds and number of predictions that a graded frame names; a few rows."""
    rows = graded.where("state IN ('limit', 'area', 'threshold', 'rows')").select("state", "area", "conf", "place", "n").collect()
    of = lambda state: sorted((r for r in rows if r["state"] == state), key=lambda r: r["place"] or 0)
    return {"limits": [r["place"] for r in of("limit")], "areas": [r["area"] for r in of("area")], "thresholds": [r["conf"] for r in of("threshold")], "rows": [r["n"] for r in of("rows")]}


def mean_of(curve: str) -> Column:
    return F.aggregate(curve, F.lit(0.0), lambda x, y: x + y) / F.size(curve)


def detections(graded: DataFrame, named: dict[str, list], areas: Sequence[str], thresholds: Sequence[float], points: int = 101) -> DataFrame:
    """(cid, area, threshold, positives, curve, hits) of every class with targets: precisions at recalls 0 to 1, hits as an array by limit.

    All areas and thresholds see detections in one order. So each is a row once,
    dealt by ranges of (class, order) and written there with its place. Batches
    give sums per range, running sums give what lies ahead of it, and a range
    gives the best precision for each recall point that its hits reach. The
    precision at a point is the best of this point and all later ones: rows
    between hits have lower ones than the hit before them.
    """
    spark = graded.sparkSession
    limits, shift = named["limits"], len(named["thresholds"])
    cells = [(named["areas"].index(a), named["thresholds"].index(t)) for a in areas for t in thresholds]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(named["rows"]) // RANGE_ROWS))
    order = ["cid", "__o", "image", "place"]
    rows = graded.where("state = 'detection'").select("cid", (-F.col("conf")).alias("__o"), "image", "place", *[F.get("marks", F.lit(a)).alias(f"m{a}") for a in sorted({a for a, _ in cells})])
    positives = graded.where("state = 'target'").select("cid", "area", F.col("n").alias("positives"))
    names = [f"h{i}" for i in range(len(limits))]

    def marked(frame: pd.DataFrame, cell: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        m = frame[f"m{cell[0]}"].to_numpy(np.int64)
        return m >> cell[1] & 1, 1 - (m >> (shift + cell[1]) & 1)

    def summed(batches):
        for batch in batches:
            out = []
            for (r, c), part in batch.groupby(["range", "cid"]):
                within = [part["place"].to_numpy() < m for m in limits]
                for i, cell in enumerate(cells):
                    hit, counts = marked(part, cell)
                    out.append((r, c, i, hit.sum(), counts.sum(), *[(hit * w).sum() for w in within]))
            yield pd.DataFrame(out, columns=["range", "cid", "cell", "tp", "n", *names])

    def steps(part: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        out, known = [], {c: g for c, g in ahead.groupby("cid")}
        for c, own in part.sort_values("at").groupby("cid"):
            for cell, tp, n, total in known[c][["cell", "tp", "n", "positives"]].itertuples(index=False) if c in known else ():
                hit, counts = marked(own, cells[cell])
                where = np.flatnonzero(hit)
                if len(where):
                    reached = tp + np.arange(1, len(where) + 1)
                    best, point = reached / (n + np.cumsum(counts))[where], np.floor(reached * (points - 1) / total + 1e-9).astype(np.int32)
                    first = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
                    out.append(pd.DataFrame({"cid": c, "cell": cell, "point": point[first], "best": np.maximum.reduceat(best, first)}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "cell": [], "point": [], "best": []}).astype({"cid": int, "cell": int, "point": int})

    # an id in this order: the range's number and, in 33 bits, the row's
    put = lambda df: df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("__o", "image")
    # ranges are found by a sample, a pass of its own
    with stored(rows) as matched, stored(put(matched)) as placed:
        placed = placed.withColumn("range", F.shiftright("at", 33))
        sums = placed.mapInPandas(summed, "range long, cid int, cell int, tp long, n long" + "".join(f", {h} long" for h in names))
        sums = materialize(sums.groupBy("range", "cid", "cell").agg(*[F.sum(x).alias(x) for x in ("tp", "n", *names)]))
        listed = F.inline(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(a).alias("area"), F.lit(t).alias("threshold")) for i, (a, t) in enumerate((a, t) for a in areas for t in thresholds)]))
        asked_for = materialize(positives.select("cid", "positives", F.col("area").alias("__area"), listed).where("area = __area").drop("__area"))
        earlier = Window.partitionBy("cid", "cell").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.select("range", "cid", "cell", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("tp", "n")]).join(asked_for.select("cid", "cell", "positives"), ["cid", "cell"])
        best = placed.groupBy("range").cogroup(ahead.groupBy("range")).applyInPandas(steps, "cid int, cell int, point int, best double")
        best = best.groupBy("cid", "cell", "point").agg(F.max("best").alias("best"))
        some = best.groupBy("cid", "cell").agg(F.collect_list(F.struct("point", "best")).alias("some"))
        hits = sums.groupBy("cid", "cell").agg(F.array(*[F.sum(h) for h in names]).alias("hits"))
        found = asked_for.join(some, ["cid", "cell"], "left").join(hits, ["cid", "cell"], "left")
        later = lambda k: F.array_max(F.transform(F.filter("some", lambda x: x["point"] >= k), lambda x: x["best"]))
        curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.coalesce(later(k), F.lit(0.0)))
        # classes with targets and without any detection have precisions and hits of 0
        return materialize(found.select("cid", "area", "threshold", "positives", curve.alias("curve"), F.coalesce("hits", F.array(*[F.lit(0).cast("long")] * len(limits))).alias("hits")))


def detection_report(graded: DataFrame) -> DataFrame:
    """(measure, value): mean precision over thresholds, at 0.5 and 0.75 and by area, and mean recall by limit.

    graded: as ``matching.graded`` gives it; its limits and areas are those found in it.
    """
    named = asked(graded)
    limits, areas = named["limits"], sorted(named["areas"])
    cells = detections(graded, named, areas, named["thresholds"]).withColumn("ap", mean_of("curve"))
    whole = F.col("area") == "all"
    near = lambda t: F.abs(F.col("threshold") - t) < 1e-9
    recall = lambda i: F.get("hits", F.lit(i)) / F.col("positives")
    ap = F.col("ap")
    measures = {"map50_95": (whole, ap), "map50": (whole & near(0.5), ap), "map75": (whole & near(0.75), ap), **{f"ap_{a}": (F.col("area") == a, ap) for a in areas}, **{f"ar{m}": (whole, recall(i)) for i, m in enumerate(limits)}}
    means = cells.agg(*[F.round(F.avg(F.when(c, v)), 9).alias(name) for name, (c, v) in measures.items()])
    return means.select(F.inline(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("value")) for name in measures])))


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with rank: the mean place of equal values. Places come from counts, so equal values share a row of work."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = n.withColumn("rank", F.coalesce(F.sum("__n").over(w), F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(ranks, [*by, value])
