"""Audio files as clip rows."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import ids
from larkspur.functions import kernels as K
from larkspur.operators.filters import reader_bounds
from larkspur.runtime import attach, ensure_workers_see_package
from larkspur.schema import conform

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def decode_by_library(data: bytes) -> tuple:
    """(mono samples, rate) by the soundfile library, where workers have it; without it such files are rejected by name."""
    import soundfile

    samples, rate = soundfile.read(io.BytesIO(data), dtype="float32", always_2d=True)
    return samples.mean(axis=1), rate


DECODERS: dict[str, Callable[[bytes], tuple]] = {"wav": K.decode_wav, "wave": K.decode_wav, "flac": decode_by_library, "ogg": decode_by_library, "mp3": decode_by_library}


def parse_extensions(text: str) -> list[str]:
    """'WAV, .flac' -> ['wav', 'flac']."""
    return [e for e in (x.strip().lower().lstrip(".") for x in text.split(",")) if e]


def patterns_of(place: str, extensions: Sequence[str]) -> list[str]:
    """Load patterns of a directory's immediate children by extension, or the one file itself."""
    last = place.rstrip("/").rpartition("/")[2].lower()
    if any(last.endswith("." + e) for e in extensions):
        return [place]
    return [f"{place.rstrip('/')}/*.{''.join(f'[{c}{c.upper()}]' if c.isalpha() else c for c in e)}" for e in extensions]


def audio_files(spark: SparkSession, patterns: str | Sequence[str], recursive: bool = False, extensions: Sequence[str] = ()) -> DataFrame:
    """(path, modificationTime, length, content) of files that any pattern matches, each path once.

    A pattern without a match adds nothing. Extensions filter in any letter case; none means all.
    ``path`` is the plain path; contents of files that a later filter drops aren't read.
    """
    found = spark.createDataFrame([], f"{FILES}, _pattern int")
    for number, pattern in enumerate([patterns] if isinstance(patterns, str) else patterns):
        try:
            part = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(pattern)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = found.unionByName(part.withColumn("_pattern", F.lit(number)))
    found = found.withColumn("path", ids.plain_path(F.col("path")))
    if extensions:
        found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    several = not isinstance(patterns, str) and len(patterns) > 1
    return (first_match(found) if several else found).drop("_pattern")


def first_match(found: DataFrame) -> DataFrame:
    """Rows (path, _pattern) of each path's first pattern; only the paths of several patterns are gathered, without contents."""
    many = found.groupBy("path").agg(F.min("_pattern").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = attach(found, many.select(F.col("path").alias("_path"), "_first"), F.col("path") == F.col("_path"))
    return out.where(F.col("_first").isNull() | (F.col("_pattern") == F.col("_first"))).drop("_path", "_first")


def list_audio(spark: SparkSession, patterns: str | Sequence[str], extensions: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(path): sorted, unique; contents aren't read."""
    return audio_files(spark, patterns, recursive, extensions).select("path").distinct().orderBy("path")


def decode(files: DataFrame, rate: int = 16_000, resampler: str = "linear", decoders: dict | None = None, warn_bytes: int | None = None) -> DataFrame:
    """Clip rows of files (path, content): mono samples at ``rate``.

    A file that can't be decoded becomes a row rejected by the reader, with the error as reason.
    ``resampler`` is ``linear`` or ``sinc``. Files over ``warn_bytes`` get a note in ``extra``.
    """
    known = dict(DECODERS) | (decoders or {})
    resample = {"linear": K.resample, "sinc": K.resample_sinc}[resampler]
    ddl = "source_path string, audio array<float>, sample_rate int, duration_seconds double, error_text string"
    schema = pa.schema([("source_path", pa.string()), ("audio", pa.list_(pa.float32())), ("sample_rate", pa.int32()), ("duration_seconds", pa.float64()), ("error_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                audio, got, error = None, 0, None
                try:
                    audio, got = known[path.rpartition(".")[2].lower()](content.as_py())
                    audio = resample(audio, got, rate)
                except KeyError:
                    error = f"no decoder for {path.rpartition('.')[2]}"
                except Exception as e:  # one bad file must not stop the scan
                    error = f"{type(e).__name__}: {e}"[:500]
                row = [[path], [audio], [rate if error is None else 0], [None if audio is None or error else len(audio) / rate], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    out = files.select("path", "content").mapInArrow(run, ddl)
    out = out.withColumn("doc_id", ids.source_id(F.col("source_path")))
    out = conform(out)
    out = out.withColumns({
        "reject_stage": F.when(F.col("error_text").isNotNull(), "reader"), "reject_reason": F.col("error_text"),
    }).drop("error_text")
    if warn_bytes:
        sizes = files.select(F.col("path").alias("_path"), "length").where(F.col("length") > warn_bytes)
        out = attach(out, sizes, F.col("source_path") == F.col("_path"))
        out = out.withColumn("extra", F.when(F.col("length").isNotNull(), F.create_map(F.lit("large_file"), F.col("length").cast("string"))).otherwise(F.col("extra"))).drop("_path", "length")
    return out


def clips(
    spark: SparkSession, patterns: str | Sequence[str], rate: int = 16_000, least_seconds: float = 0.5, most_seconds: float | None = None,
    recursive: bool = False, extensions: Sequence[str] = (), resampler: str = "linear", done: DataFrame | None = None, parallelism: int | None = None,
    decoders: dict[str, Callable[[bytes], tuple]] | None = None, warn_bytes: int | None = None,
) -> DataFrame:
    """Clip rows of audio files; ``done`` (doc_id) are left out before anything is read.

    ``decoders`` adds to ``DECODERS``: by extension, from a file's bytes to (mono samples, rate).
    """
    ensure_workers_see_package(spark)
    files = audio_files(spark, patterns, recursive, extensions)
    if done is not None:
        files = attach(files, done.select(F.col("doc_id").alias("_done")), ids.source_id(F.col("path")) == F.col("_done"), "left_anti")
    if parallelism:
        files = files.repartition(parallelism)
    return reader_bounds(decode(files, rate, resampler, decoders, warn_bytes), least_seconds, most_seconds)


def mark_missing(entries: DataFrame, decoded: DataFrame) -> DataFrame:
    """Manifest entries (path) with their decoded clips; entries without one keep null audio, to be decoded later."""
    return entries.join(decoded.select(F.col("source_path").alias("path"), "audio", "sample_rate"), "path", "left")

