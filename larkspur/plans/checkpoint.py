"""Resumable runs: ids of finished sources, and outputs that count only once committed."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


class Checkpoint:
    """A folder with ``ids`` (doc_id, processed_at, run_id) and ``commits`` (run_id, version)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).option("mergeSchema", "true").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)

    def commits(self) -> DataFrame:
        return self._read("commits", "run_id string, version int")

    def done(self) -> DataFrame:
        """(doc_id) of sources that committed runs finished, each once."""
        ids = self._read("ids", "doc_id string, processed_at timestamp, run_id string")
        return ids.join(self.commits().select("run_id").distinct(), "run_id", "left_semi").select("doc_id").distinct()

    def remaining(self, sources: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Source rows that no committed run has finished."""
        done = self.done().select(F.col("doc_id").alias("_done"))
        return sources.join(done, F.col(id_col) == F.col("_done"), "left_anti")

    def commit(self, finished: DataFrame, run_id: str | None = None) -> str:
        """Append the ids (doc_id), then the marker that makes them count; the run's id."""
        run_id = run_id or uuid.uuid4().hex
        rows = finished.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        rows = rows.select("doc_id", F.current_timestamp().alias("processed_at"), F.lit(run_id).alias("run_id"))
        rows.write.mode("append").parquet(f"{self.folder}/ids")
        self.spark.createDataFrame([(run_id, VERSION)], "run_id string, version int").write.mode("append").parquet(f"{self.folder}/commits")
        return run_id

    def upgrade(self, old_ids: DataFrame) -> str:
        """Take over a bare list of ids (doc_id) of an older layout as one committed run."""
        return self.commit(old_ids.join(self.done(), "doc_id", "left_anti"), "upgrade-1-to-2")


def finished_sources(annotated: DataFrame, checkpoint_errors: bool = False) -> DataFrame:
    """(doc_id): sources to be skipped next time. Unread and failed ones are tried again."""
    by = annotated.groupBy("root_doc_id").agg(
        F.max(F.coalesce(F.col("reject_stage") == "reader", F.lit(False))).alias("unread"), F.max(F.col("error_stage").isNotNull()).alias("bad")
    )
    keep = ~F.col("unread") if checkpoint_errors else ~F.col("unread") & ~F.col("bad")
    return by.where(keep).select(F.col("root_doc_id").alias("doc_id"))


def committed_outputs(outputs: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """Output rows (with ``run_id``) of committed runs only."""
    return outputs.join(checkpoint.commits().select("run_id").distinct(), "run_id", "left_semi")
