"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after every run of the six ASCII white-space
characters became one space. Rows are combined in three stages, and each
groups by digest AND whole normalised text, so content is compared throughout:

1. local: partial aggregation inside every map task leaves one row per text;
2. salted: those rows meet by (digest, salt, text), the salt being the map
   task's number modulo ``salts``, so a text that occurs in every task of the
   cluster is merged by ``salts`` tasks instead of one;
3. global: at most ``salts`` winners per text meet by (digest, text).

Members then look up their group by digest. A digest found with two different
texts (``variants`` > 1) makes the lookup compare whole texts instead.

Defined cases: null text equals empty text; null ids lose against any other;
rows that repeat one id with equal text are one document given several times,
of which exactly one is kept; an empty table gives an empty result; other
columns are ignored by :func:`groups` and carried through by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, materialize, numbered, skew_join, text_of

SALTS = 16
ID, TEXT, DIGEST = "__silt_id", "__silt_text", "__silt_digest"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space.

    A text whose white space is lone spaces and newlines, the usual case,
    only needs its newlines replaced; the byte searches for anything else are
    cheap beside a regular expression that rewrites every gap between words.
    """
    other = [text.contains(x) for x in ("\t", "\x0b", "\x0c", "\r", "  ", "\n\n", " \n", "\n ")]
    return F.when(reduce(Column.__or__, other), F.regexp_replace(text, "[\x20\x09-\x0D]+", " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias(ID), normalised(text_of(text_col)).alias(TEXT), *more)
    return rows.withColumn(DIGEST, digest(F.col(TEXT)))


def winners(keyed: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, rows) of every distinct text, by the three stages."""
    salted = keyed.withColumn("__silt_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = salted.groupBy(DIGEST, "__silt_salt", TEXT).agg(F.min(ID).alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    return some.groupBy(DIGEST, TEXT).agg(F.min("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    won = winners(_keyed(docs, id_col, text_col, digest), salts)
    sums = materialize(won.select(DIGEST, "keep_id", "rows"))
    per = sums.groupBy(DIGEST).agg(F.min("keep_id").alias("keep_id"), F.sum("rows").alias("group_size"), F.count(F.lit(1)).alias("variants"))
    keyed = _keyed(docs, id_col, text_col, digest)
    if digest is not sha256 or per.where("variants > 1").limit(1).count():  # two texts under one digest: whole texts decide
        full = won.select(DIGEST, TEXT, "keep_id", F.col("rows").alias("group_size"))
        found = keyed.groupBy(ID, DIGEST, TEXT).agg(F.count(F.lit(1)).alias("m")).join(full, [DIGEST, TEXT]).withColumn("sha", sha256(F.col(TEXT)))
    else:
        members = keyed.groupBy(ID, DIGEST).agg(F.count(F.lit(1)).alias("m")).withColumn("sha", F.col(DIGEST))
        total = sums.agg(F.sum("rows")).first()[0] or 0
        hot = hot_keys(per, DIGEST, "group_size", total)
        found = skew_join(members, per.drop("variants"), DIGEST, hot)
    # an id given m times gives m rows; the first of the winner's is the one that stays
    times = found.withColumn("__silt_i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return times.select(
        F.col(ID).alias(id_col),
        "keep_id",
        "group_size",
        (F.col(ID).eqNullSafe(F.col("keep_id")) & (F.col("__silt_i") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, whole, with their original columns.

    A row stays if its id is the smallest among equal texts; of rows that
    repeat this id with an equal text, one stays.
    """
    rows, (key, text) = numbered(docs, id_col, text_col)
    kept = groups(rows, key, text, salts=salts).where("kept").select(F.col(key).alias("__silt_keep"), F.col("text_sha256").alias("__silt_sha"))
    keyed = rows.select("*", F.col(key).alias(ID), sha256(normalised(text_of(text))).alias(DIGEST))
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    stay = keyed.join(kept, F.col(ID).eqNullSafe(F.col("__silt_keep")) & (F.col(DIGEST) == F.col("__silt_sha")), "left_semi")
    if repeated:
        stay = stay.dropDuplicates([ID, DIGEST])
    return stay.drop(ID, DIGEST).toDF(*docs.columns)
