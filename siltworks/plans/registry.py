"""The registered queries, each beside its SQL, and the analogues that several of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def split_of(key) -> F.Column:
    """train, val or test by the first hex digit of a hash: 11, 2 and 3 of 16."""
    d = F.substring(F.md5(key.cast("string")), 1, 1)
    return F.when(d < "b", "train").when(d < "d", "val").otherwise("test")


SPLIT = "CASE WHEN md5(doc_id::VARCHAR)[1] < 'b' THEN 'train' WHEN md5(doc_id::VARCHAR)[1] < 'd' THEN 'val' ELSE 'test' END"


def docs_split(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumn("split", split_of(F.col("doc_id")))


def hashes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", identity.sign_bits(F.col("embedding")).alias("bits"))


BITS = "SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::UBIGINT AS bits FROM embeddings"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def line_boxes(spark, d) -> DataFrame:
    x, y = F.col("l_discount") * 8, F.col("l_tax") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") / 100).alias("x2"), (y + F.col("l_quantity") / 100).alias("y2"))


BOXES = "SELECT l_orderkey, l_linenumber, l_discount * 8 AS x1, l_tax * 10 AS y1, l_discount * 8 + l_quantity / 100 AS x2, l_tax * 10 + l_quantity / 100 AS y2 FROM lineitem"
