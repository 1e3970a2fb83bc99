"""Where generated patches may go: seeded rejection draws as joins, a round of attempts for all proposals at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import margin_pixels
from ..session import materialize, stored
from .selection import running

#: The least side of a core box, and the pixels that stay free on either side of a rectangle.
LEAST, EDGE = 8, 2
#: Attempts that a proposal has, and how many are made in each round: most proposals need few.
TRIES, ROUNDS = 500, (4, 16, 64, 256)


def chance(seed: Column, name: str, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the key and what it is drawn for."""
    text = F.concat_ws(":", seed.cast("string"), *[k.cast("string") for k in key], F.lit(name))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rectangle(record: Sequence[Column], exemplar: Sequence[Column], margin: Column) -> dict[str, Column]:
    """w, h, px, py: core and margins in pixels; an image too small for the margins gets a smaller core."""
    out = {}
    for side, margin_name, size, share in (("w", "px", record[0], exemplar[2] - exemplar[0]), ("h", "py", record[1], exemplar[3] - exemplar[1])):
        core = F.greatest(F.lit(LEAST), F.least(size - 2 * EDGE, F.bround(share * size))).cast("long")
        pad = margin_pixels(core, margin)
        large = core + 2 * pad > size - 2 * EDGE
        fitted = F.when(large, size - 2 * EDGE - 2 * pad).otherwise(core)
        out[side], out[margin_name] = fitted, F.when(large, margin_pixels(fitted, margin)).otherwise(pad)
    return out


def _placed(places: DataFrame, shapes: DataFrame, boxes: DataFrame, candidates: DataFrame, wanted: DataFrame, seed: int, tries: int) -> DataFrame:
    """The first attempt of every proposal that is free, with its draws."""
    sizes = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("of"))
    turns = materialize(running(candidates.select("subset", "id", "cid", "margin", "canonical"), ["subset"], ["id"], "place"))
    each = wanted.select("subset", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"), F.col("n").alias("__n")).where("__n > 0").drop("__n")
    each = each.join(sizes(turns, "subset").withColumnRenamed("of", "turns"), "subset")
    each = each.withColumn("place", (F.col("i") % F.col("turns") + 1).cast("int")).join(turns, ["subset", "place"]).drop("place", "turns")
    each = each.join(sizes(places, "subset").withColumnRenamed("of", "backgrounds"), "subset")
    each = materialize(each.join(sizes(shapes, "subset", "cid").withColumnRenamed("of", "shapes"), ["subset", "cid"], "left"))
    asked = wanted.agg(F.sum(F.greatest("n", F.lit(0)))).first()[0] or 0
    if each.count() != asked:
        raise ValueError("a subset without records or without candidates")
    if each.where("shapes IS NULL").limit(1).count():
        raise ValueError("no size exemplars for a generated class")

    found, left, begun = None, each, 0
    rounds = iter(ROUNDS)
    while begun < tries:
        many = min(next(rounds, tries), tries - begun)
        drawn = left.withColumn("attempt", F.explode(F.sequence(F.lit(begun), F.lit(begun + many - 1))))
        u = lambda name: chance(F.lit(seed), name, F.col("subset"), F.col("i"), F.col("attempt"))
        drawn = drawn.withColumn("place", (F.floor(u("background") * F.col("backgrounds")) + 1).cast("int")).join(places, ["subset", "place"]).drop("place")
        drawn = drawn.withColumn("place", (F.floor(u("exemplar") * F.col("shapes")) + 1).cast("int"))
        drawn = drawn.join(shapes.select("subset", "cid", "place", *[F.col(c).alias(f"e_{c}") for c in ("x1", "y1", "x2", "y2")]), ["subset", "cid", "place"])
        drawn = drawn.withColumns(rectangle([F.col("width"), F.col("height")], [F.col(f"e_{c}") for c in ("x1", "y1", "x2", "y2")], F.col("margin")))
        drawn = drawn.withColumns({"rw": F.col("w") + 2 * F.col("px"), "rh": F.col("h") + 2 * F.col("py")})
        room = lambda size, side: F.greatest(size - side - 1 - EDGE, F.lit(1))
        drawn = drawn.withColumns({"x": EDGE + F.floor(u("x") * room(F.col("width"), F.col("rw"))), "y": EDGE + F.floor(u("y") * room(F.col("height"), F.col("rh")))})
        drawn = materialize(drawn.where("x + rw < width AND y + rh < height"))
        # the background's boxes that share area with the rectangle
        sides = {"l": F.col("x") / F.col("width"), "t": F.col("y") / F.col("height"), "r": (F.col("x") + F.col("rw")) / F.col("width"), "b": (F.col("y") + F.col("rh")) / F.col("height")}
        on = drawn.select("subset", "i", "attempt", "stem", *[v.alias(k) for k, v in sides.items()]).join(boxes.select("subset", "stem", "x1", "y1", "x2", "y2"), ["subset", "stem"])
        touched = on.where((F.least("r", "x2") > F.greatest("l", "x1")) & (F.least("b", "y2") > F.greatest("t", "y1"))).select("subset", "i", "attempt").distinct()
        free = drawn.join(touched, ["subset", "i", "attempt"], "left_anti")
        first = free.groupBy("subset", "i").agg(F.min("attempt").alias("attempt"))
        done = materialize(drawn.join(first, ["subset", "i", "attempt"]))
        found = done if found is None else found.unionByName(done)
        begun += many
        left = materialize(left.join(done.select("subset", "i"), ["subset", "i"], "left_anti"))
        if not left.limit(1).count():
            break
    else:
        if found is None or left.limit(1).count():
            raise ValueError(f"no disjoint placement in {tries} attempts; place it by hand")
    return found


def propose(records: DataFrame, boxes: DataFrame, candidates: DataFrame, wanted: DataFrame, seed: int, tries: int = TRIES) -> DataFrame:
    """One row per proposal: a rectangle on a background whose boxes it does not touch, for a person to confirm.

    records: subset, stem, sha256, width, height. boxes: subset, stem, line, cid
    and corners in shares of the image. candidates: subset, id, cid, margin,
    canonical; a subset's candidates take turns in order of their ids. wanted:
    subset, n.

    An attempt draws a background, a box of the candidate's class in the same
    subset for the size, then x and y; each number depends only on the seed,
    subset, proposal, attempt and its name, so a proposal's row does not depend
    on how tasks are cut. The first attempt disjoint from all boxes of its
    background counts. A class without boxes, or ``tries`` attempts in vain, is an error.
    """
    with stored(boxes.select("subset", "stem", "line", "cid", "x1", "y1", "x2", "y2")) as boxes:
        places = running(records.select("subset", "stem", "sha256", "width", "height"), ["subset"], ["stem"], "place")
        shapes = running(boxes, ["subset", "cid"], ["stem", "line"], "place").select("subset", "cid", "place", "x1", "y1", "x2", "y2")
        # every round reads them
        with stored(places) as places, stored(shapes) as shapes:
            found = _placed(places, shapes, boxes, candidates, wanted, seed, tries)
    turn = F.col("canonical") & (F.col("h") > F.col("w"))
    whole = lambda *names: F.array(*[F.col(n).cast("long") if isinstance(n, str) else n.cast("long") for n in names])
    return found.select(
        "subset",
        F.format_string("blend_%06d", F.col("i")).alias("id"),
        F.col("stem").alias("background_stem"),
        F.col("sha256").alias("background_sha256"),
        F.col("id").alias("candidate_id"),
        whole("x", "y", "rw", "rh").alias("rectangle_xywh"),
        whole(F.col("x") + F.col("px"), F.col("y") + F.col("py"), "w", "h").alias("core_box_xywh"),
        turn.alias("quarter_turn"),
        "attempt",
        F.lit(False).alias("approved"),
        F.lit("").alias("reviewer"),
        F.lit(False).alias("placement_valid"),
    )
