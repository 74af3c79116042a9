"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.runtime import checkpoint_folder, cut_lineage

__all__ = ["checkpoint_folder", "cut_lineage", "delete", "fresh", "join_hot", "look_up", "without", "written"]

BROADCAST_ROWS = 500_000
HOT_SHARE = 256
HOT_ROWS = 20_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet under a new name in the shared folder, reread, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key columns aren't in ``keys``; null matches null.

    The keys are counted first: up to ``limit`` narrow rows are broadcast, so that the wide
    rows don't shuffle; more are joined by shuffling.
    """
    keys = cut_lineage(keys.select(*[F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(on)]).distinct())
    small = keys.count() <= limit
    match = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(keys[f"_key{i}"]) for i, c in enumerate(on)])
    return df.join(F.broadcast(keys) if small else keys, match, "left_anti")


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner", least: int = HOT_ROWS, few: bool = False) -> DataFrame:
    """``left`` joined (inner or left) with a table that has one narrow row a key; hot keys don't shuffle.

    Keys that hold more than a ``HOT_SHARE``-th of the rows of ``left`` (and ``least`` rows) are
    found by a pre-aggregated count. There are fewer than ``HOT_SHARE`` of them whatever the
    size, so their rows of ``right`` are broadcast; the other keys are joined by shuffling.
    Give tables whose lineage is cut, since each is read twice where a key is hot. ``few`` says
    that ``left`` is known to have no more than ``least`` rows.
    """
    if few:
        return left.join(right, on, how)
    total = left.count()
    if total <= least:
        return left.join(right, on, how)
    hot = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(least, total // HOT_SHARE))
    hot = cut_lineage(hot.select(on))
    if hot.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(hot)
    one = left.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how)
    return one.unionByName(left.join(few, on, "left_anti").join(right.join(few, on, "left_anti"), on, how))


def look_up(df: DataFrame, small: DataFrame, on: list[str], spread: str, limit: int = 100_000, salts: int = 16) -> DataFrame:
    """``df`` left-joined with a narrow table that has one row a key; no key lands in one task.

    The table is counted first. Up to ``limit`` rows are broadcast; beyond that both sides
    are salted: the table is repeated for every salt, and ``df`` is dealt by a hash of the
    column ``spread``. Null keys match nothing.
    """
    small = cut_lineage(small)
    if small.count() <= limit:
        return df.join(F.broadcast(small), on, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{spread}`")), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], "left").drop("_salt")
