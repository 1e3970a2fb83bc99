"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, ensure_checkpoint_dir, materialize, shared_folder, table  # noqa: F401

#: At most this many keys are ever treated as hot, so what is broadcast for
#: them is bounded whatever the size of the table.
MAX_HOT_KEYS = 1000
#: Keys with fewer rows than this never count as hot.
MIN_HOT_ROWS = 256


def hot_keys(counts: DataFrame, key: str, rows: str, total: int) -> list:
    """The keys that hold over a thousandth of all rows: MAX_HOT_KEYS at most, by arithmetic.

    counts: one row per key with its number of rows.
    """
    least = max(total // MAX_HOT_KEYS, MIN_HOT_ROWS)
    return [r[0] for r in counts.where(F.col(rows) > least).select(key).collect()]


def skew_join(big: DataFrame, dim: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join many rows with a table of unique keys; hot keys never meet in one task.

    Rows of the ``hot`` keys are joined by broadcasting the (at most
    MAX_HOT_KEYS) matching rows of ``dim``; all others by an ordinary join.
    """
    if not hot:
        return big.join(dim, key, how)
    is_hot = F.col(key).isin(hot)
    cold = big.where(~F.coalesce(is_hot, F.lit(False))).join(dim.where(~F.coalesce(is_hot, F.lit(False))), key, how)
    return cold.unionByName(big.where(is_hot).join(F.broadcast(dim.where(is_hot)), key, how))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1 ..., and the new names of some: so that no name clashes with an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(c)}" for c in columns]
