"""Curation of files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import ids
from larkspur.operators.filters import reader_bounds
from larkspur.operators.stage import Stage, active, run_stages
from larkspur.plans.checkpoint import Checkpoint, finished_sources
from larkspur.runtime import ensure_workers_see_package
from larkspur.sources.audio import FILES, decode


def arriving_clips(spark: SparkSession, folder: str, pattern: str = "*.wav", rate: int = 16_000, least_seconds: float = 0.5, files_per_trigger: int = 1000) -> DataFrame:
    """Clip rows of a folder's files, old and new, as a stream."""
    ensure_workers_see_package(spark)
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    files = files.withColumn("path", ids.plain_path(F.col("path")))
    return reader_bounds(decode(files, rate), least_seconds)


def curate_stream(clips: DataFrame, stages: Sequence[Stage], output: str, checkpoint: str, once: bool = False):
    """Run stages on each micro-batch; rows of a batch are written under its number, so a retried batch replaces itself.

    Finished sources are committed by id as well, and skipped if their files come again.
    """

    def each(batch: DataFrame, number: int) -> None:
        store = Checkpoint(batch.sparkSession, f"{checkpoint}/ids")
        rows = run_stages(store.remaining(batch), stages).persist()
        rows.where(active()).drop("audio").write.mode("overwrite").parquet(f"{output}/batch={number}")
        store.commit(finished_sources(rows.drop("audio")), f"batch-{number}")
        rows.unpersist()

    writer = clips.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_report(clips: DataFrame, time_col: str, width: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window, clips, kept, seconds) by event time; later rows than ``late`` are dropped by the watermark."""
    by = clips.withWatermark(time_col, late).groupBy(F.window(time_col, width, slide) if slide else F.window(time_col, width))
    return by.agg(F.count(F.lit(1)).alias("clips"), F.count_if(active()).alias("kept"), F.sum(F.when(active(), F.col("duration_seconds"))).alias("seconds"))


def first_of_id(clips: DataFrame, time_col: str, late: str = "1 hour") -> DataFrame:
    """Drop repeats of a clip's id that arrive within the watermark."""
    return clips.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["doc_id"])

