import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import ids
from larkspur.functions import kernels as K
from larkspur.functions import signal as S
from larkspur.operators import filters
from larkspur.schema import conform


def clips(spark, arrays, rate=16, **columns):
    rows = [(str(i), [float(x) for x in a], rate, len(a) / rate) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "doc_id string, audio array<float>, sample_rate int, duration_seconds double")
    return conform(df.withColumn("source_path", F.concat(F.lit("/in/"), "doc_id", F.lit(".wav"))))


@pytest.fixture(scope="module")
def waves():
    r = np.random.default_rng(7)
    out = []
    for n in (0, 1, 5, 8, 9, 63, 64, 100, 200):
        x = r.normal(0, 0.05, n)
        if n > 20:
            x[n // 3 : n // 2] += r.normal(0, 0.6, n // 2 - n // 3)
        out.append(x.astype(np.float32))
    return [*out, np.zeros(64, np.float32), np.full(64, 0.5, np.float32)]


def test_columns_equal_kernels(spark, waves):
    df = filters.with_vad(clips(spark, waves), 8)
    value, note = filters.snr_columns(F.col("audio"), F.col("vad_speech_timestamps"), F.col("sample_rate"), 8)
    rows = df.select("doc_id", "vad_speech_timestamps", value.alias("v"), note.alias("note")).collect()
    for r in rows:
        x = waves[int(r.doc_id)]
        spans = K.energy_vad(x, 8)
        assert [(s.start, s.end) for s in r.vad_speech_timestamps] == spans
        v, n = K.snr(x, 16, spans, 8)
        assert n == r.note
        assert (r.v is None and math.isnan(v)) or r.v == pytest.approx(v, abs=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 30), st.integers(-5, 30)), max_size=8), st.integers(0, 25))
def test_merge_covers_the_same_samples(spans, n):
    merged = K.merge(spans, n)
    want = {i for s, e in spans for i in range(max(s, 0), min(e, n))}
    assert {i for s, e in merged for i in range(s, e)} == want
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))


def test_merge_and_gaps_as_columns(spark):
    cases = [([], 10), ([(2, 4), (4, 6), (8, 12)], 10), ([(-3, 2), (1, 3), (9, 9)], 9), ([(0, 5)], 5)]
    df = spark.createDataFrame([(i, [{"start": s, "end": e} for s, e in c], n) for i, (c, n) in enumerate(cases)], f"i int, s {S.SPAN}, n int")
    merged = S.merge_spans(F.col("s"), F.col("n"))
    for r in df.select("i", merged.alias("m"), S.gaps(merged, F.col("n")).alias("g")).collect():
        spans, n = cases[r.i]
        want = K.merge(spans, n)
        assert [(x.start, x.end) for x in r.m] == want
        cuts = [0, *[v for p in want for v in p], n]
        assert [(x.start, x.end) for x in r.g] == [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if b > a]


@pytest.mark.parametrize("source,target", [(4, 8), (8, 4), (48, 16), (10, 10), (3, 7)])
def test_resample_matches_columns(spark, waves, source, target):
    rows = clips(spark, waves).select("doc_id", S.resample_linear(F.col("audio"), source, target).alias("y")).collect()
    for r in rows:
        assert np.allclose(r.y, K.resample(waves[int(r.doc_id)], source, target), atol=1e-5)


def test_resample_lengths():
    assert len(K.resample(np.ones(4), 4, 8)) == 8
    x = np.sin(2 * np.pi * 5 * np.arange(800) / 800).astype(np.float32)
    y = K.resample_sinc(x, 800, 1600)
    assert len(y) == 1600 and np.abs(y[100:1500] - np.sin(2 * np.pi * 5 * np.arange(1600) / 1600)[100:1500]).max() < 0.02
    assert len(K.resample_sinc(x[:10], 8, 4)) == 5
    assert np.allclose(K.resample_closed(np.array([0.0, 1.0]), 2, 4), [0, 1 / 3, 2 / 3, 1])
    assert list(K.fit_length(np.array([1.0, 2.0]), 5)) == [1, 2, 1, 2, 1]


def test_wav_round_trip_and_formats():
    import io
    import struct
    import wave

    x = np.linspace(-1, 1, 101).astype(np.float32)
    y, rate = K.decode_wav(K.encode_wav(x, 8000))
    assert rate == 8000 and np.abs(x - y).max() <= 1 / 32767
    assert np.allclose(K.from_pcm16(K.pcm16(np.array([2.0, -2.0, 0.5])).tobytes()), [1, -1, 16383 / 32767])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(struct.pack("<4h", 32767, 0, -32767, 32767))
    assert np.allclose(K.decode_wav(out.getvalue())[0], [0.5, 0.0])
    body = np.array([0.25, -0.5], "<f4").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 3, 1, 50, 200, 4, 32, b"data", len(body))
    assert np.allclose(K.decode_wav(head + body)[0], [0.25, -0.5])
    with pytest.raises(Exception):
        K.decode_wav(b"no audio")


def test_fingerprints():
    r = np.random.default_rng(1)
    x = r.normal(size=3000).astype(np.float32)
    a, b = K.fingerprint(x), K.fingerprint(x + 1e-4 * r.normal(size=3000).astype(np.float32))
    assert (a ^ b).bit_count() <= 3 and K.fingerprint(np.zeros(10)) == 0
    assert K.fingerprint(np.r_[x[:2048], 99.0]) == K.fingerprint(x[:2048])


def test_ids(spark):
    import hashlib

    row = spark.range(1).select(
        ids.source_id(F.lit("/a/é.wav")).alias("a"), ids.segment_id(F.lit("p"), F.lit(3), F.lit(9)).alias("b"),
        ids.turn_id(F.lit("p"), F.lit("S"), F.lit(1.2345), F.lit(2.0)).alias("c"), ids.plain_path(F.lit("file:///a%20b/c+d.wav")).alias("d"),
        ids.plain_path(F.lit("hdfs://h/a%20b")).alias("e"), S.fingerprint_hash(F.expr("-2L")).alias("f"),
    ).first()
    assert row.a == hashlib.sha256("/a/é.wav".encode()).hexdigest()[:16]
    assert row.b == hashlib.sha256(b"p:3:9").hexdigest()[:16]
    assert row.c == "p__S__1234_2000" and row.d == "/a b/c+d.wav" and row.e == "hdfs://h/a%20b"
    assert row.f == hashlib.sha256((2**64 - 2).to_bytes(8, "little")).hexdigest()[:16]


def test_log_mel_shapes():
    assert K.log_mel(np.zeros(16_000), 24_000).shape == (63, 100)
    assert K.log_mel(np.zeros(0), 24_000).min() == pytest.approx(math.log(1e-5))
    assert K.mel_frames(0) == 1 and K.mel_frames(1000) == 3
