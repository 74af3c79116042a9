"""SQL surface: functions, a table function and views over clip rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import kernels as K
from larkspur.runtime import ensure_workers_see_package


def _vector(name: str, kind: str, one):
    def each(audio: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else one(np.asarray(a), int(r)) for a, r in zip(audio, rate)])

    each.__name__ = name
    return F.pandas_udf(each, kind)


class Segments:
    """clip_segments(audio, sample_rate): speech spans as rows."""

    def eval(self, audio: list, rate: int) -> Iterator[tuple]:
        x = np.asarray(audio if audio is not None else [], dtype=np.float32)
        for s, e in K.merge(K.energy_vad(x), len(x)):
            yield s, e, s / rate, e / rate


def register(spark: SparkSession) -> None:
    """Register clip_energy_vad, clip_speech_ratio, clip_snr_db, clip_fingerprint, clip_resample and clip_segments."""
    ensure_workers_see_package(spark)
    spans = "array<struct<start:int,end:int>>"
    made = {
        "clip_energy_vad": (spans, lambda a, r: [{"start": s, "end": e} for s, e in K.energy_vad(a)]),
        "clip_speech_ratio": ("double", lambda a, r: sum(e - s for s, e in K.energy_vad(a)) / len(a) if len(a) else 0.0),
        "clip_snr_db": ("double", lambda a, r: K.snr(a, r, K.energy_vad(a))[0]),
        "clip_fingerprint": ("bigint", lambda a, r: K.fingerprint(a)),
        "clip_resample": ("array<float>", lambda a, r: K.resample(a, 16_000, r)),
    }
    for name, (kind, one) in made.items():
        spark.udf.register(name, _vector(name, kind, one))
    spark.udtf.register("clip_segments", F.udtf(Segments, returnType="start int, end int, start_seconds double, end_seconds double"))


def view(clips: DataFrame, name: str = "clips") -> None:
    """A temporary view, so that clips can be queried with SQL."""
    clips.createOrReplaceTempView(name)
