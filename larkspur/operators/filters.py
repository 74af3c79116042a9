"""Filters and 1:1 transformers as Column stages (see ``analyze`` for decoded audio)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import signal as S
from larkspur.operators.stage import Stage, active, annotate, reject


def with_vad(df: DataFrame, frame: int = 512, merged: bool = False) -> DataFrame:
    """Energy speech detection on active rows: spans, unrounded ``_ratio``, backend."""
    spans = S.energy_spans(F.col("audio"), frame)
    df = annotate(df, {"vad_speech_timestamps": S.merge_spans(spans, F.size("audio")) if merged else spans})
    df = annotate(df, {"_ratio": S.speech_ratio(F.col("vad_speech_timestamps"), F.size("audio")), "vad_backend": F.lit("energy_merged" if merged else "energy_fallback")})
    return annotate(df, {"vad_speech_ratio": F.round("_ratio", 4)})


def vad_filter(min_speech_ratio: float = 0.3, frame: int = 512, merged: bool = False) -> Stage:
    """Reject clips with too little speech; a clip without spans goes even at a minimum of 0."""

    def apply(df: DataFrame) -> DataFrame:
        df = with_vad(df, frame, merged)
        keep = (F.size("vad_speech_timestamps") > 0) & (F.col("_ratio") >= min_speech_ratio)
        return reject(df, "vad", keep, "low_speech_ratio").drop("_ratio")

    return Stage("vad", "filter", apply)


def snr_columns(audio: Column, spans: Column, rate: Column, frame: int = 512) -> tuple[Column, Column]:
    """(decibels, note) from spans, or from frame energies without them."""
    n = F.size(audio)
    merged = S.merge_spans(spans, n)
    short = n - S.spans_length(merged) < 0.1 * rate
    with_spans = S.span_snr(audio, merged, rate)
    by_frames = S.let(S.frame_energies(audio, frame, partial=False), lambda e: S.quartile_snr(e, S.quantile(e, 0.75)))
    without = F.when(n < frame, F.lit(S.CAP_DB)).otherwise(by_frames)
    has = F.coalesce(F.size(spans), F.lit(0)) > 0
    return F.when(has, with_spans).otherwise(without), F.when(has & short, F.lit("insufficient_noise_floor"))


def snr_filter(min_snr_db: float = 15.0, frame: int = 512) -> Stage:
    """Reject noisy clips; a ratio that can't be computed (null or NaN) rejects."""

    def apply(df: DataFrame) -> DataFrame:
        value, note = snr_columns(F.col("audio"), F.col("vad_speech_timestamps"), F.col("sample_rate"), frame)
        df = annotate(df, {"_snr": value, "snr_note": note})
        df = annotate(df, {"snr_db": F.round("_snr", 2)})
        return reject(df, "snr", ~F.isnan("_snr") & (F.col("_snr") >= min_snr_db), "low_snr").drop("_snr")

    return Stage("snr", "filter", apply)


def duration_filter(least: float = 2.0, most: float = 15.0) -> Stage:
    """Keep durations within inclusive bounds."""

    def apply(df: DataFrame) -> DataFrame:
        seconds = F.col("duration_seconds")
        return reject(df, "duration", seconds.between(least, most), F.when(seconds < least, F.lit("too_short")).otherwise(F.lit("too_long")))

    return Stage("duration", "filter", apply)


def reader_bounds(df: DataFrame, least: float = 0.5, most: float | None = None) -> DataFrame:
    """Reject clips under the least duration and cut longer ones than the most (null or 0: never)."""
    df = reject(df, "reader", F.col("duration_seconds") >= least, "too_short")
    if not most:
        return df
    long = F.col("duration_seconds") > most
    kept = (F.col("sample_rate") * F.lit(float(most))).cast("int")
    df = annotate(df, {"audio": F.when(long, F.slice("audio", F.lit(1), kept)).otherwise(F.col("audio")), "duration_seconds": F.when(long, F.lit(float(most))).otherwise(F.col("duration_seconds"))})
    return annotate(df, {"n_samples": F.size("audio")})


def trim_silence(padding_ms: float = 150, least_seconds: float = 1.0, frame: int = 512) -> Stage:
    """Cut to the first and last span with padding, spans shifted along; short results stay whole.

    Speech is detected first only where it never was (null spans).
    """

    def apply(df: DataFrame) -> DataFrame:
        known = df.withColumn("_known", F.col("vad_speech_timestamps"))
        df = with_vad(known, frame).withColumn("vad_speech_timestamps", F.coalesce("_known", "vad_speech_timestamps")).drop("_known", "_ratio")
        spans, n, rate = F.col("vad_speech_timestamps"), F.size("audio"), F.col("sample_rate")
        pad = (rate * F.lit(float(padding_ms)) / 1000).cast("int")
        df = df.withColumns({
            "_start": F.greatest(F.lit(0), F.array_min(F.transform(spans, lambda s: s["start"])) - pad),
            "_end": F.least(n, F.array_max(F.transform(spans, lambda s: s["end"])) + pad),
        })
        start, end = F.col("_start"), F.col("_end")
        seconds = (end - start).cast("double") / rate
        df = df.withColumn("_cut", active() & (F.size(spans) > 0) & (seconds >= least_seconds))
        moved = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), s["start"] - start).alias("start"), F.least(end - start, s["end"] - start).alias("end")))
        out = df.withColumns({
            "audio": F.when(F.col("_cut"), F.slice("audio", start + 1, F.greatest(F.lit(0), end - start))).otherwise(F.col("audio")),
            "duration_seconds": F.when(F.col("_cut"), seconds).otherwise(F.col("duration_seconds")),
            "n_samples": F.when(F.col("_cut"), end - start).otherwise(F.col("n_samples")),
            "vad_speech_timestamps": F.when(F.col("_cut"), moved).otherwise(spans),
            "trimmed_duration_seconds": F.when(active(), F.when(F.col("_cut"), seconds).otherwise(F.col("duration_seconds"))).otherwise(F.col("trimmed_duration_seconds")),
        })
        return out.drop("_start", "_end", "_cut")

    return Stage("trim", "map", apply)
