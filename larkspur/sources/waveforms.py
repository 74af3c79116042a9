"""Waveforms derived from tables, as clip rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.schema import conform


def series(df: DataFrame, key: str, value: Column, order: list[str], rate: int) -> DataFrame:
    """One clip for each key: its values in order. A key's series is one row, so it must fit in one."""
    listed = F.array_sort(F.collect_list(F.struct(*order, value.cast("float").alias("_v"))))
    by = df.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.transform(listed, lambda x: x["_v"]).alias("audio"))
    return _clip(by, rate)


def arrays(df: DataFrame, key: str, array: str, rate: int) -> DataFrame:
    """One clip for each row's array of numbers."""
    return _clip(df.select(F.col(key).cast("string").alias("doc_id"), F.col(array).cast("array<float>").alias("audio")), rate)


def _clip(df: DataFrame, rate: int) -> DataFrame:
    return conform(df.withColumns({"sample_rate": F.lit(rate), "source_path": F.col("doc_id"), "duration_seconds": F.size("audio").cast("double") / rate}))
