"""Stages around model providers: transcripts and enhancement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions import kernels as K
from larkspur.operators.stage import annotate
from larkspur.providers import get_provider
from larkspur.runtime import attach


CLIPS = 16
SAMPLES = 1 << 24
Some = Callable[[list[dict], list[np.ndarray]], list[np.ndarray]]


def groups(lengths: list[int], clips: int = CLIPS, samples: int = SAMPLES) -> Iterator[tuple[int, int]]:
    """[start, end) of runs of clips, bounded in clips and in samples; a clip beyond the bound is alone."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= clips or held + n > samples):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _tried(run_some: Some, stage: str, rows: list[dict], audio: list[np.ndarray]) -> list[np.ndarray]:
    """The function's audio; clips of a failed group are tried one by one, and a bad clip gets its error."""
    try:
        return run_some(rows, audio)
    except ImportError:
        raise
    except Exception as e:  # a bad clip must not stop the others
        if len(rows) > 1:
            return [_tried(run_some, stage, [r], [x])[0] for r, x in zip(rows, audio)]
        rows[0]["error_stage"], rows[0]["error"] = stage, f"{type(e).__name__}: {e}"[:500]
        return audio


def _per_group(df: DataFrame, stage: str, run_some: Some) -> DataFrame:
    """Run a function on the rows and audio of active clips, a bounded group at a time; exceptions become a row's error."""
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("audio")), 0).to_pylist()
            for start, end in groups(lengths):
                part = batch.slice(start, end - start)
                rows = part.drop_columns(["audio"]).to_pylist()
                audio = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column("audio")]
                live = [i for i, r in enumerate(rows) if r["reject_stage"] is None and r["error_stage"] is None]
                if live:
                    given = [np.zeros(0, np.float32) if audio[i] is None else audio[i] for i in live]
                    for i, x in zip(live, _tried(run_some, stage, [rows[i] for i in live], given)):
                        audio[i] = x
                    columns = [pa.array(audio if f.name == "audio" else [r[f.name] for r in rows], f.type) for f in schema]
                    part = pa.RecordBatch.from_arrays(columns, schema=schema)
                yield part

    return df.mapInArrow(run, df.schema)


def _run_all(model: object, items: list[tuple]) -> list:
    """A model's results for argument tuples: by its ``run_batch`` if it has one, else one at a time."""
    made = model.run_batch(items) if hasattr(model, "run_batch") else [model.run(*item) for item in items]
    if len(made) != len(items):
        raise ValueError(f"a model gave {len(made)} results for {len(items)} clips")
    return made


def transcribe(df: DataFrame, provider: str = "table") -> DataFrame:
    """Set ``transcription`` on active clips; never rejects."""

    def some(rows: list[dict], audio: list[np.ndarray]) -> list[np.ndarray]:
        made = _run_all(get_provider("transcriber", provider), [(r["doc_id"], x, r["sample_rate"]) for r, x in zip(rows, audio)])
        for row, text in zip(rows, [(m.text or "").strip() for m in made]):
            row["transcription"], row["transcription_backend"] = text, provider
        return audio

    return _per_group(df, "transcribe", some)


def attach_transcripts(df: DataFrame, texts: DataFrame, backend: str = "table") -> DataFrame:
    """Set ``transcription`` from a table (doc_id, text), one text an id; without one it is empty."""
    found = texts.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    out = attach(df, found, F.col("doc_id") == F.col("_id"))
    out = annotate(out, {"transcription": F.trim(F.coalesce("_text", F.lit(""))), "transcription_backend": F.lit(backend)})
    return out.drop("_id", "_text")


def enhance(df: DataFrame, provider: str = "identity") -> DataFrame:
    """Run an enhancement model at its own rate; length and rate stay the clip's."""

    def some(rows: list[dict], audio: list[np.ndarray]) -> list[np.ndarray]:
        model = get_provider("enhancer", provider)
        made = _run_all(model, [(K.resample_closed(x, r["sample_rate"], model.required_rate),) for r, x in zip(rows, audio)])
        made = [K.resample_closed(y, model.required_rate, r["sample_rate"]) for r, y in zip(rows, made)]
        for row in rows:
            row["enhanced"], row["enhancement_model"] = True, model.name
        return [y if len(y) == len(x) else K.fit_length(y, len(x)) for x, y in zip(audio, made)]

    return _per_group(df, "enhance", some)


def mel_features(df: DataFrame, n_fft: int = 1024, hop: int = 256, mels: int = 100) -> DataFrame:
    """(doc_id, mel array<array<float>>, mel_length): the training spectrogram of every clip."""
    schema = pa.schema([("doc_id", pa.string()), ("mel", pa.list_(pa.list_(pa.float32()))), ("mel_length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, rate, audio in zip(*(batch.column(i) for i in range(3))):
                x = audio.values.to_numpy(zero_copy_only=False) if audio.is_valid else np.zeros(0, np.float32)
                mel = K.log_mel(x, rate.as_py(), n_fft, hop, mels)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()]), pa.array([list(mel)], schema.field(1).type), pa.array([K.mel_frames(len(x), hop)], pa.int32())], schema=schema)

    return df.select("doc_id", "sample_rate", "audio").mapInArrow(run, "doc_id string, mel array<array<float>>, mel_length int")
