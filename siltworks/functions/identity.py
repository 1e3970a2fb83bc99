"""Hashes, keys and number formats."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(text: Column) -> Column:
    """16 hex digits to a signed 64-bit integer."""
    return F.conv(text, 16, -10).cast("long")


def sign_bits(vector: Column) -> Column:
    """A 64-bit hash of 64 numbers: bit i is set where number i is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def group_id(members: Column) -> Column:
    """20 hex digits that depend on the set of members, not their order; groups of any size: ``operators.group_identity``."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 20)


def export_stem(source: Column, path: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.sha2(path, 256), 1, 24))


def subset_key(seed: Column, fraction: Column) -> Column:
    return F.format_string("seed%d_f%05d", seed, F.bround(fraction * 10000).cast("int"))


def duration(seconds: Column) -> Column:
    """[Nd ]HH:MM:SS."""
    s = F.floor(seconds).cast("long")
    day = F.floor(s / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(day > 0, F.concat(day.cast("string"), F.lit("d "), clock)).otherwise(clock)


def annotation_signature(rows: Column) -> Column:
    """Sorted ``target:source`` and box of annotations (array of structs target, source, box), boxes to 10 places."""
    one = lambda x: F.concat_ws("|", F.concat(F.coalesce(x["target"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(x["source"], F.lit(""))), F.array_join(F.transform(x["box"], lambda v: F.format_number(v, 10)), ","))
    return F.array_sort(F.transform(rows, one))


@F.pandas_udf(StringType())
def canonical_hash(values: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with sorted keys, compact separators and ASCII escapes."""
    return values.map(lambda v: None if v is None else hashlib.sha256(json.dumps(json.loads(v), sort_keys=True, separators=(",", ":")).encode()).hexdigest())


@F.pandas_udf(StringType())
def spaced_hash(values: pd.Series) -> pd.Series:
    """As canonical_hash with ", " and ": " as separators."""
    return values.map(lambda v: None if v is None else hashlib.sha256(json.dumps(json.loads(v), sort_keys=True).encode()).hexdigest())


@F.pandas_udf(StringType())
def short_number(values: pd.Series) -> pd.Series:
    """Twelve significant digits without trailing zeros."""
    return pd.Series(np.char.mod("%.12g", values.to_numpy(float)), dtype=object).where(values.notna().to_numpy(), None)


@F.pandas_udf(StringType())
def import_number(values: pd.Series) -> pd.Series:
    """Ten significant digits without trailing zeros, as imported labels have them."""
    return pd.Series(np.char.mod("%.10g", values.to_numpy(float)), dtype=object).where(values.notna().to_numpy(), None)


def fixed_number(value: Column) -> Column:
    """Six decimals, as exchange files have them."""
    return F.format_string("%.6f", value.cast("double"))


def run_stamp(moment: Column) -> Column:
    """A run's name in UTC: 20250131T235959Z."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def or_else(*values: Column) -> Column:
    """The first value that is neither null nor the empty text; else the last one."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])
