"""File-name expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """With its dot; empty for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def export_base(name: Column) -> Column:
    """The name without an export's ``.rf.<hex>.<suffix>`` tail, whatever its case."""
    return F.regexp_replace(name, r"(?i)\.rf\.[0-9a-f]+\.[^.]+$", "")


def numeric_family(name: Column) -> Column:
    """The leading digits of a name, null without any."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def prefix_family(name: Column, prefixes: Sequence[str], other: str = "other") -> Column:
    """The first of the prefixes that a name starts with."""
    found = F.lit(other)
    for p in reversed(prefixes):
        found = F.when(F.startswith(name, F.lit(p)), p).otherwise(found)
    return found


def digit_family(name: Column) -> Column:
    """What an exported name has before its first digit, ``numeric`` if that is nothing."""
    base = F.regexp_replace(basename(name), r"\.rf\..*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(base, r"^[^\d]*", 0), F.lit("")), F.lit("numeric"))


def capture_unit(name: Column, patterns: Sequence[str]) -> Column:
    """``<index>:<unit>`` of the first matching pattern, whose first group is the unit; no match is an error."""
    found = F.raise_error(F.concat(F.lit("no capture unit in "), name)).cast("string")
    for i in reversed(range(len(patterns))):
        found = F.when(F.rlike(name, F.lit(patterns[i])), F.concat(F.lit(f"{i}:"), F.regexp_extract(name, patterns[i], 1))).otherwise(found)
    return found


def label_path(image_path: Column) -> Column:
    """The label beside an image: the first ``images`` folder becomes ``labels``, the suffix .txt."""
    return F.concat(F.regexp_replace(F.regexp_replace(image_path, r"^(|.*?/)images/", "$1labels/"), r"\.[^./]+$", ""), F.lit(".txt"))


def inside(path: Column, root: Column) -> Column:
    """Whether a path without .. steps lies in a folder."""
    return ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)")) & F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
