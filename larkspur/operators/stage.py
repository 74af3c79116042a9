"""Stages and their accounting.

Rejection is an annotation: a row that a stage rejects keeps its features and gets
``reject_stage`` and ``reject_reason``; a row that fails gets ``error_stage`` and ``error``.
Later stages leave such rows alone, so statistics are plain aggregates and nothing has to
be computed twice for kept and rejected rows. Column stages rely on CASE WHEN for native
expressions, which evaluates lazily; Arrow kernels look at the annotation themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Apply = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named step; ``kind`` is filter, map or fanout and serves reports only."""

    name: str
    kind: str
    apply: Apply

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def active() -> Column:
    return F.col("reject_stage").isNull() & F.col("error_stage").isNull()


def annotate(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Set feature columns on active rows; other rows keep what they have."""
    return df.withColumns({c: F.when(active(), v).otherwise(F.col(c)) if c in df.columns else F.when(active(), v) for c, v in features.items()})


def reject(df: DataFrame, stage: str, keep: Column, reason: Column | str) -> DataFrame:
    """Mark active rows for which ``keep`` isn't true."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    out = active() & ~F.coalesce(keep, F.lit(False))
    return df.withColumns({"reject_reason": F.when(out, reason).otherwise(F.col("reject_reason")), "reject_stage": F.when(out, F.lit(stage)).otherwise(F.col("reject_stage"))})


def filter_stage(name: str, predicate: Column | Callable[[DataFrame], Column], reason: str = "rejected") -> Stage:
    """A user filter: a Boolean expression (a pandas UDF's result will do); null rejects."""
    return Stage(name, "filter", lambda df: reject(df, name, predicate(df) if callable(predicate) else predicate, reason))


def map_stage(name: str, apply: Apply) -> Stage:
    """A user transformer: any function from DataFrame to DataFrame that keeps the clip columns."""
    return Stage(name, "map", apply)


def fanout_stage(name: str, spans: Column, child: dict[str, Column]) -> Stage:
    """A user fan-out over an array expression; ``child`` may refer to its element as ``item``.

    A clip without items leaves one row rejected by this stage, so that it is counted.
    """

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumn("_was", active()).withColumn("item", F.explode_outer(F.when(active(), spans)))
        made = F.col("_was") & F.col("item").isNotNull()
        order = [c for c in child if c != "doc_id"] + [c for c in child if c == "doc_id"]
        fresh = {f"_new_{c}": F.when(made, child[c]).otherwise(F.col(c)) for c in order}
        out = out.withColumns(fresh)
        out = out.withColumns({c: F.col(f"_new_{c}") for c in order})
        out = reject(out, name, made, "no_items") if child else out
        return out.drop("_was", "item", *fresh)

    return Stage(name, "fanout", apply)


def run_stages(df: DataFrame, stages: Sequence[Stage | Apply]) -> DataFrame:
    """All stages in order; plain callables are accepted as they are."""
    for stage in stages:
        df = stage(df)
    return df


def run_stats(df: DataFrame) -> DataFrame:
    """One row: processed, kept, skipped, errors (see ``errors_by_stage``), by source clip.

    Reader rejections are skipped and not processed. A source with an error keeps nothing and
    counts as one error; its rejected rows are skipped, or all rows if none was rejected. A
    fan-out without items counts only for a source that has no other row.
    """
    by = df.groupBy("root_doc_id").agg(
        F.max(F.when(F.col("error_stage").isNotNull(), 1).otherwise(0)).alias("bad"),
        F.count_if(F.col("reject_stage") == "reader").alias("unread"),
        F.count_if(F.col("reject_stage").isNotNull() & (F.col("reject_reason") != "no_items") & (F.col("reject_stage") != "reader")).alias("out"),
        F.count_if(active()).alias("in_"),
        F.count(F.lit(1)).alias("all_"),
    )
    real = F.when(F.col("unread") > 0, F.col("unread")).when(F.col("bad") == 1, F.when(F.col("out") > 0, F.col("out")).otherwise(F.col("all_")))
    skipped = real.otherwise(F.when((F.col("out") == 0) & (F.col("in_") == 0), F.lit(1)).otherwise(F.col("out")))
    zero = F.lit(0).cast("bigint")
    return by.agg(
        F.coalesce(F.sum(F.when(F.col("unread") == 0, 1).otherwise(0)), zero).alias("processed"),
        F.coalesce(F.sum(F.when((F.col("bad") == 0) & (F.col("unread") == 0), F.col("in_")).otherwise(0)), zero).alias("kept"),
        F.coalesce(F.sum(skipped), zero).alias("skipped"),
        F.coalesce(F.sum("bad"), zero).alias("errors"),
    )


def errors_by_stage(df: DataFrame) -> DataFrame:
    """(error_stage, n): source clips with an error in each stage."""
    return df.where("error_stage is not null").groupBy("error_stage").agg(F.count_distinct("root_doc_id").alias("n"))


def drop_failed_families(df: DataFrame) -> DataFrame:
    """Kept rows, without those whose source had an error in any of its parts."""
    bad = df.where("error_stage is not null").select(F.col("root_doc_id").alias("_bad")).distinct()
    return df.where(active()).join(bad, F.col("root_doc_id") == F.col("_bad"), "left_anti")
