"""Identities of groups of any size: members sorted by Spark, hashed as they stream past."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streamed(df: DataFrame, by: Sequence[str], order: Sequence[str], text: Column, between: str, around: tuple[str, str] = ("", "")) -> DataFrame:
    """(by..., members, sha256): of each key the SHA-256 of its rows' texts in order, ``between`` them and ``around`` them.

    Keys are dealt by hash and rows sorted within each partition, which spills;
    the hash keeps one state, so a key's rows need no memory, however many they
    are. By its nature one key is hashed by one task.
    """
    ranked = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], text.alias("text"))
    keys = [f"k{i}" for i in range(len(by))]
    dealt = ranked.repartition(*keys).sortWithinPartitions(*keys, *[f"o{i}" for i in range(len(order))]).select(*keys, "text")
    kinds = ", ".join(f"{k} {dealt.schema[k].dataType.simpleString()}" for k in keys)
    start, end, gap = around[0].encode(), around[1].encode(), between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, schema = None, None, 0, None

        def done() -> pa.RecordBatch:
            state.update(end)
            columns = [pa.array([v], schema.field(i).type) for i, v in enumerate(key)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([state.hexdigest()])], [*keys, "members", "sha256"])

        for batch in batches:
            schema = batch.schema
            texts = batch.column(len(keys)).to_pylist()
            for row, text in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))), texts):
                if state is None or row != key:
                    if state is not None:
                        yield done()
                    key, state, n = row, hashlib.sha256(start), 0
                state.update((gap if n else b"") + (text or "").encode())
                n += 1
        if state is not None:
            yield done()

    found = dealt.mapInArrow(run, f"{kinds}, members long, sha256 string")
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "members", "sha256")


def group_ids(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members, group_id): 20 hex digits of the newline-joined members of a group in order, each counted as often as it comes."""
    text = F.col(member).cast("string")
    rows = df.select(group, text.alias("__member")).where("__member IS NOT NULL")
    return streamed(rows, [group], ["__member"], F.col("__member"), "\n").select(group, "members", F.substring("sha256", 1, 20).alias("group_id"))


def subset_ids(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, rows, identity): SHA-256 of the JSON list of a subset's rows, ordered by the first of ``columns``, as objects with sorted keys.

    The columns hold plain texts or integers, as stems and hashes are; texts are escaped.
    """
    value = lambda c: F.to_json(F.struct(F.col(c)))
    member = lambda c: F.expr(f"substring(__j_{c}, 2, length(__j_{c}) - 2)")
    rows = df.select(by, *columns, *[value(c).alias(f"__j_{c}") for c in columns])
    one = F.concat(F.lit("{"), F.concat_ws(",", *[member(c) for c in sorted(columns)]), F.lit("}"))
    out = streamed(rows, [by], list(columns), one, ",", ("[", "]"))
    return out.select(by, F.col("members").alias("rows"), F.col("sha256").alias("identity"))
