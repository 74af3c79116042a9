"""1:N operators: speech segments and speaker turns as child clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import ids
from larkspur.functions import signal as S
from larkspur.operators.filters import with_vad
from larkspur.operators.stage import Stage, active, fanout_stage
from larkspur.runtime import attach


def segment_speech(frame: int = 512, merged: bool = False, legacy_timestamps: bool = False) -> Stage:
    """One child clip for each speech span, with a deterministic id and its place in the parent.

    A child's own spans cover it whole; ``legacy_timestamps`` leaves the parent's spans on it
    instead. ``root_doc_id`` survives, ``parent_doc_id`` is the direct parent.
    """
    item, rate = F.col("item"), F.col("sample_rate")
    size = item["end"] - item["start"]
    child = {
        "audio": S.cut(F.col("audio"), item["start"], item["end"]),
        "n_samples": size,
        "duration_seconds": size.cast("double") / rate,
        "parent_doc_id": F.col("doc_id"),
        "segment_start_sample": item["start"],
        "segment_end_sample": item["end"],
        "segment_start_seconds": item["start"].cast("double") / rate,
        "segment_end_seconds": item["end"].cast("double") / rate,
        "doc_id": ids.segment_id(F.col("doc_id"), item["start"], item["end"]),
    }
    if not legacy_timestamps:
        child["vad_speech_timestamps"] = F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))
    explode = fanout_stage("segment", F.col("_spans"), child)

    def apply(df: DataFrame) -> DataFrame:
        had = df.withColumn("_had", F.col("vad_speech_timestamps"))
        found = with_vad(had, frame, merged).withColumn("_spans", F.col("vad_speech_timestamps"))
        found = found.withColumn("vad_speech_timestamps", F.col("_had")).drop("_had", "_ratio")
        return explode(found).drop("_spans")

    return Stage("segment", "fanout", apply)


def speaker_turns(turns: DataFrame, min_speakers: int | None = None, max_speakers: int | None = None) -> Stage:
    """One child clip for each turn of a table (doc_id, speaker_id, start, end; seconds).

    The table stands for a diarization model's output. It is joined on the clip's id as an
    array of turns, so a clip without turns leaves one rejected row. Speakers are bounded by
    clips: those outside the bounds have no turns.
    """
    by = turns.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "speaker_id"))).alias("_turns"), F.count_distinct("speaker_id").alias("_n")
    )
    if min_speakers is not None:
        by = by.where(F.col("_n") >= min_speakers)
    if max_speakers is not None:
        by = by.where(F.col("_n") <= max_speakers)
    item, rate, n = F.col("item"), F.col("sample_rate"), F.size("audio")
    first = F.greatest(F.lit(0), F.least((item["start"] * rate).cast("int"), n))
    last = F.greatest(first, F.least((item["end"] * rate).cast("int"), n))
    child = {
        "audio": F.slice("audio", first + 1, last - first),
        "n_samples": last - first,
        "duration_seconds": item["end"] - item["start"],
        "parent_doc_id": F.col("doc_id"),
        "speaker_id": item["speaker_id"],
        "segment_start": item["start"].cast("double"),
        "segment_end": item["end"].cast("double"),
        "doc_id": ids.turn_id(F.col("doc_id"), item["speaker_id"], item["start"], item["end"]),
    }
    explode = fanout_stage("diarize", F.col("_turns"), child)

    def apply(df: DataFrame) -> DataFrame:
        joined = attach(df, by, F.when(active(), F.col("doc_id")) == F.col("_id")).drop("_id", "_n")
        return explode(joined).drop("_turns")

    return Stage("diarize", "fanout", apply)
