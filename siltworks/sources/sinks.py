"""Writers. None replaces what is there, but for :func:`replace_file`."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW_COLUMNS = (
    "image", "source", "image_sha256", "label_sha256", "schema_sha256", "action", "reviewer", "domain_ok", "labels_complete", "unmapped_absent",
    "visible_at_640", "grouping_checked", "unaugmented_real", "background_verified", "additional_group", "notes",
)


def manifest(df: DataFrame, path: str) -> None:
    """One JSON record per row."""
    df.write.mode("errorifexists").json(path)


def review_queue(records: DataFrame, path: str, stale: str = "stale", issues: str = "issues") -> None:
    """The review table: stale reviews are blanked, notes default to the joined issues."""
    kept = {"image", "source", "image_sha256", "label_sha256", "schema_sha256"}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")
    cell = {c: text(c) if c in kept else F.when(F.col(stale), F.lit("")).otherwise(text(c)) for c in REVIEW_COLUMNS}
    cell["notes"] = F.coalesce(F.nullif(cell["notes"], F.lit("")), F.array_join(issues, "; "))
    records.select(*[cell[c].alias(c) for c in REVIEW_COLUMNS]).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def union_csv(frames: Sequence[DataFrame], path: str) -> list[str]:
    """Rows of unlike tables in one CSV, its columns in the order first seen; gives the columns."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    whole.write.mode("errorifexists").option("header", True).csv(path)
    return whole.columns


def label_text(boxes: DataFrame, by: Sequence[str] = ("split", "stem")) -> DataFrame:
    """(by..., text): label lines of twelve significant digits in line order."""
    from ..functions.identity import short_number

    line = F.concat_ws(" ", F.col("cid").cast("string"), *[short_number(F.col(c)) for c in ("cx", "cy", "w", "h")])
    lines = boxes.select(*by, "line", line.alias("row"))
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("text"))


def export(labels: DataFrame, path: str) -> None:
    """Label texts partitioned by split, one record per image."""
    labels.write.mode("errorifexists").partitionBy("split").json(path)


def finite(df: DataFrame) -> DataFrame:
    """``df`` if none of its numbers is NaN or infinite; such a row is an error when it is read."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | (F.coalesce(F.isnan(name) | (F.abs(F.col(name)) == float("inf")), F.lit(False)))
    return df.where(F.when(bad, F.raise_error(F.lit("a number is not finite"))).otherwise(F.lit(True)).cast("boolean"))


def write_json(value, path: str, strict: bool = True) -> None:
    """A small document in a new file; strict refuses NaN and escapes non-ASCII."""
    text = json.dumps(value, indent=2, ensure_ascii=strict, allow_nan=not strict)
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)


def replace_file(text: str, path: str, expected: str | None = None) -> None:
    """Replace a small file at once; with ``expected``, only if it still holds that text."""
    if expected is not None:
        with open(path, encoding="utf-8") as f:
            if f.read() != expected:
                raise ValueError(f"{path} changed meanwhile")
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report's table of at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def exchange_xml(images: DataFrame, path: str) -> None:
    """An annotation exchange file from (name, width, height, boxes), boxes being structs of label and shares x1, y1, x2, y2."""
    side = lambda v, size: F.round(v * F.col(size), 6)
    box = F.transform("boxes", lambda b: F.struct(b["label"].alias("_label"), side(b["x1"], "width").alias("_xtl"), side(b["y1"], "height").alias("_ytl"), side(b["x2"], "width").alias("_xbr"), side(b["y2"], "height").alias("_ybr")))
    rows = images.select(F.col("name").alias("_id"), F.col("name").alias("_name"), F.col("width").alias("_width"), F.col("height").alias("_height"), box.alias("box"))
    rows.write.mode("errorifexists").format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path)
