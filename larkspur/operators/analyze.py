"""The fused Arrow kernel for decoded audio: speech, trim, noise, fingerprint and quality flags.

One pass over each clip computes everything that the curation stages need, so the samples
cross into Python once; the Column stages in ``filters`` give the same results for short
series. Rows that were rejected before come back untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions import kernels as K
from larkspur.providers import get_provider
from larkspur.schema import CLIP, conform

ROWS = 32


@dataclass(frozen=True)
class Analysis:
    """Which steps run, in the order of the fields, and their parameters; None leaves a step out."""

    vad_min_ratio: float | None = 0.3
    trim_padding_ms: float | None = None
    trim_least_seconds: float = 1.0
    snr_min_db: float | None = None
    least_seconds: float | None = None
    most_seconds: float | None = None
    fingerprint: bool = False
    quality: bool = True
    frame: int = K.FRAME
    detector: str = "energy"

    def run(self, row: dict, audio: np.ndarray) -> np.ndarray:
        """Set features and fate of an active row; returns its audio after trimming."""
        rate, spans = row["sample_rate"], None
        if self.vad_min_ratio is not None:
            spans, row["vad_backend"] = get_provider("detector", self.detector).spans(audio, rate, self.frame)
            ratio = sum(e - s for s, e in spans) / len(audio) if len(audio) else 0.0
            row["vad_speech_ratio"] = round(ratio, 4)
            if not spans or ratio < self.vad_min_ratio:
                row["reject_stage"], row["reject_reason"] = "vad", "low_speech_ratio"
        elif row["vad_speech_timestamps"] is not None:
            spans = [(s["start"], s["end"]) for s in row["vad_speech_timestamps"]]
        if row["reject_stage"] is None and self.trim_padding_ms is not None:
            bounds = K.trim_bounds(len(audio), rate, spans, self.trim_padding_ms, self.trim_least_seconds) if spans else None
            if bounds:
                start, end = bounds
                audio = audio[start:end]
                spans = [(max(0, s - start), min(end - start, e - start)) for s, e in spans]
                row["duration_seconds"] = len(audio) / rate
            row["trimmed_duration_seconds"] = row["duration_seconds"]
        row["vad_speech_timestamps"] = None if spans is None else [{"start": s, "end": e} for s, e in spans]
        if row["reject_stage"] is None and self.snr_min_db is not None:
            value, row["snr_note"] = K.snr(audio, rate, spans, self.frame)
            row["snr_db"] = None if math.isnan(value) else value if math.isinf(value) else round(value, 2)
            if not value >= self.snr_min_db:
                row["reject_stage"], row["reject_reason"] = "snr", "low_snr"
        if row["reject_stage"] is None:
            if self.least_seconds is not None and row["duration_seconds"] < self.least_seconds:
                row["reject_stage"], row["reject_reason"] = "duration", "too_short"
            elif self.most_seconds is not None and row["duration_seconds"] > self.most_seconds:
                row["reject_stage"], row["reject_reason"] = "duration", "too_long"
        if row["reject_stage"] is None and self.fingerprint:
            row["fingerprint"] = K.fingerprint(audio)
        if self.quality and row["reject_stage"] is None:
            level = np.abs(audio)
            row["clipped"] = bool(len(level)) and float(level.max()) >= 0.999
            row["silent"] = bool(len(level)) and float((level > 1e-4).mean()) < 0.01
        return audio


def analyze(df: DataFrame, steps: Analysis, rows: int = ROWS) -> DataFrame:
    """Run the steps on every active clip; an exception becomes the row's error.

    Input batches are cut to ``rows`` clips, so a batch of long clips stays small.
    """
    df = conform(df)
    others = [c for c in df.columns if c not in CLIP]
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                part = whole.slice(start, rows)
                clips = part.column("audio")
                table = part.drop_columns(["audio", *others]).to_pylist()
                audio = []
                for i, row in enumerate(table):
                    x = clips[i]
                    x = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
                    if row["reject_stage"] is None and row["error_stage"] is None:
                        if x is None:
                            row["error_stage"], row["error"] = "analyze", "no audio"
                        else:
                            try:
                                x = steps.run(row, x)
                            except Exception as e:  # a bad clip must not stop the others
                                row["error_stage"], row["error"] = "analyze", f"{type(e).__name__}: {e}"[:500]
                        row["n_samples"] = None if x is None else len(x)
                    audio.append(x)
                columns = []
                for f in schema:
                    if f.name == "audio":
                        columns.append(pa.array(audio, f.type))
                    elif f.name in others:
                        columns.append(part.column(f.name))
                    else:
                        columns.append(pa.array([r[f.name] for r in table], f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, df.schema)
