"""The curation pipelines: assembled stages, one annotated result, all outputs from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import fanout, filters
from larkspur.operators.aggregates import inspect_stats, qc_report
from larkspur.operators.analyze import Analysis, analyze
from larkspur.operators.dedup import deduplicate
from larkspur.operators.models import enhance, transcribe
from larkspur.operators.stage import Stage, active, drop_failed_families, map_stage, run_stages, run_stats
from larkspur.plans.checkpoint import Checkpoint, finished_sources
from larkspur.sources import manifests
from larkspur.sources.audio import clips as read_clips


def tts_stages(
    snr_min: float = 20.0, least_seconds: float = 2.0, most_seconds: float = 15.0, padding_ms: float = 150, turns: DataFrame | None = None,
    segment: bool = False, transcriber: str | None = None, dedup_threshold: int | None = None, detector: str = "energy",
    min_speakers: int | None = None, max_speakers: int | None = None,
) -> list[Stage]:
    """[diarize] [segment] speech(0.1) trim noise duration [dedup] [transcribe], the middle fused into one kernel."""
    out: list[Stage] = []
    if turns is not None:
        out.append(fanout.speaker_turns(turns, min_speakers, max_speakers))
    if segment:
        out.append(fanout.segment_speech(merged=True))
    steps = Analysis(
        vad_min_ratio=0.1, trim_padding_ms=padding_ms, snr_min_db=snr_min, least_seconds=least_seconds, most_seconds=most_seconds,
        fingerprint=dedup_threshold is not None, detector=detector,
    )
    out.append(map_stage("analyze", lambda df: analyze(df, steps)))
    if dedup_threshold is not None:
        out.append(Stage("dedup", "filter", lambda df: deduplicate(df, dedup_threshold)))
    if transcriber is not None:
        out.append(map_stage("transcribe", lambda df: transcribe(df, transcriber)))
    return out


def generic_stages(vad_threshold: float = 0.3, snr_min: float = 15.0, enhancer: str | None = None, segment: bool = False, detector: str = "energy") -> list[Stage]:
    """[enhance] [speech] [segment after speech] [noise]; a threshold outside (0, 1) or a ratio of 0 or less leaves its filter out."""
    out: list[Stage] = []
    if enhancer is not None:
        out.append(map_stage("enhance", lambda df: enhance(df, enhancer)))
    vad = vad_threshold if 0 < vad_threshold < 1 else None
    if vad is not None:
        out.append(map_stage("vad", lambda df: analyze(df, Analysis(vad_min_ratio=vad, quality=False, detector=detector))))
        if segment:
            out.append(fanout.segment_speech(merged=True))
    if snr_min > 0:
        out.append(map_stage("snr", lambda df: analyze(df, Analysis(vad_min_ratio=None, snr_min_db=snr_min))))
    return out


@dataclass
class Result:
    """Annotated clips (persisted), kept ones and the run's numbers."""

    annotated: DataFrame
    kept: DataFrame
    stats: dict

    def close(self) -> None:
        self.annotated.unpersist()


def run(source: DataFrame, stages: Sequence[Stage | Callable[[DataFrame], DataFrame]], checkpoint: Checkpoint | None = None, sink: Callable[[DataFrame], object] | None = None, checkpoint_errors: bool = False, run_id: str | None = None) -> Result:
    """Run stages over clip rows once, give kept rows to the sink, then commit the finished sources under the run's id."""
    annotated = run_stages(source, stages).persist(StorageLevel.MEMORY_AND_DISK)
    stats = run_stats(annotated.drop("audio")).first().asDict()
    kept = drop_failed_families(annotated)
    if sink is not None:
        stats["sink"] = sink(kept)
    if checkpoint is not None:
        stats["run_id"] = checkpoint.commit(finished_sources(annotated.drop("audio"), checkpoint_errors), run_id)
    return Result(annotated, kept, stats)


def curate_tts(spark: SparkSession, source: str | Sequence[str] | DataFrame, output: str, formats: tuple[str, ...] = manifests.FORMATS, checkpoint: str | None = None, speaker: str = "speaker_00", **options) -> dict:
    """Curate speech for training: {kept, filtered, total_duration_seconds, output_files, qc_report}.

    The numbers and the report are this run's; the manifests hold all committed runs into the
    folder. Each run writes a part of its own, which counts once its sources are committed, so
    a crash before that leaves nothing, and one after it is made good by the next run.
    """
    manifests.check_formats(formats)
    store, reader = Checkpoint(spark, checkpoint) if checkpoint else None, {k: options.pop(k) for k in ("decoders", "warn_bytes") if k in options}
    frame = source if isinstance(source, DataFrame) else read_clips(spark, source, done=store.done() if store else None, **reader)
    if store is None:
        result = run(frame, tts_stages(**options), None, lambda kept: manifests.export_tts(kept, output, formats, speaker))
        files = result.stats["sink"]["output_files"]
    else:
        run_id, taken = uuid.uuid4().hex, manifests.exported(spark, output, store.commits())
        result = run(frame, tts_stages(**options), store, lambda kept: manifests.export_run(kept, output, run_id, taken), run_id=run_id)
        files = manifests.compose(manifests.exported(spark, output, store.commits()), output, formats, speaker)
    slim = result.kept.drop("audio")
    manifests.write_report(qc_report(slim), slim, f"{output}/qc_report.json")
    made = result.stats["sink"]
    out = {
        "kept": made["kept"], "filtered": result.stats["skipped"], "total_duration_seconds": made["total_duration_seconds"],
        "output_files": files, "qc_report": f"{output}/qc_report.json",
    }
    result.close()
    return out


def curate(spark: SparkSession, source: str | Sequence[str] | DataFrame, output: str, checkpoint: str | None = None, version: str = "0.1.0", **options) -> dict:
    """Curate to an appended JSON-lines manifest: the run's statistics.

    A run's lines are staged and shown once its sources are committed, so that no line comes twice.
    """
    store, reader = Checkpoint(spark, checkpoint) if checkpoint else None, {k: options.pop(k) for k in ("decoders", "warn_bytes") if k in options}
    if store:
        manifests.publish_jsonl(spark, output, store.commits())  # what a crash kept from being shown
    frame = source if isinstance(source, DataFrame) else read_clips(spark, source, done=store.done() if store else None, **reader)
    run_id = uuid.uuid4().hex
    result = run(frame, generic_stages(**options), store, lambda kept: manifests.stage_jsonl(kept.drop("audio"), output, version, run_id), run_id=run_id)
    manifests.publish_jsonl(spark, output, store.commits() if store else spark.createDataFrame([(run_id,)], "run_id string"))
    stats = {k: v for k, v in result.stats.items() if k != "sink"}
    result.close()
    return stats


def inspect(spark: SparkSession, source: str | Sequence[str], limit: int | None = None) -> dict:
    """Durations and counts of the files that can be read."""
    return inspect_stats(read_clips(spark, source, least_seconds=0.0).where(active())).first().asDict()


def column_stages(min_ratio: float, padding_ms: float, trim_least: float, min_db: float, least: float, most: float, frame: int) -> list[Stage]:
    """The training-speech chain as Column stages, for short series and SQL parity."""
    return [
        filters.vad_filter(min_ratio, frame), filters.trim_silence(padding_ms, trim_least, frame),
        filters.snr_filter(min_db, frame), filters.duration_filter(least, most),
    ]


def status():
    """The stage that rejected a row, or ``keep``."""
    return F.coalesce("error_stage", "reject_stage", F.lit("keep"))
