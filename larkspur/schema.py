"""The clip row: one audio clip with its features and its fate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"

IDENTITY = {"doc_id": "string", "parent_doc_id": "string", "root_doc_id": "string", "source_path": "string"}
BASE = {"audio": "array<float>", "sample_rate": "int", "n_samples": "int", "duration_seconds": "double"}
FEATURES = {
    "vad_speech_ratio": "double", "vad_speech_timestamps": SPAN, "vad_backend": "string",
    "snr_db": "double", "snr_note": "string", "trimmed_duration_seconds": "double",
    "segment_start_sample": "int", "segment_end_sample": "int", "segment_start_seconds": "double", "segment_end_seconds": "double",
    "segment_start": "double", "segment_end": "double", "speaker_id": "string",
    "transcription": "string", "transcription_backend": "string", "enhanced": "boolean", "enhancement_model": "string",
    "fingerprint": "bigint", "audio_fingerprint": "string", "duplicate_of": "string", "clipped": "boolean", "silent": "boolean",
    "extra": "map<string,string>",
}
FATE = {"reject_stage": "string", "reject_reason": "string", "error_stage": "string", "error": "string"}
CLIP = IDENTITY | BASE | FEATURES | FATE


def conform(df: DataFrame) -> DataFrame:
    """``df`` with every clip column, missing ones null; other columns stay behind them.

    Vacant identities are filled: a root is its own root, and samples are counted.
    """
    have = set(df.columns)
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in CLIP.items() if c not in have})
    out = out.withColumns({
        "root_doc_id": F.coalesce("root_doc_id", "doc_id"),
        "n_samples": F.coalesce("n_samples", F.when(F.col("audio").isNotNull(), F.size("audio"))),
    })
    return out.select(*CLIP, *[c for c in df.columns if c not in CLIP])


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())
