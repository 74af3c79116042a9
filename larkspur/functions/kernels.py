"""Signal mathematics in numpy, for the Arrow functions that handle decoded audio."""

from __future__ import annotations

import io
import math
import struct
import wave

import numpy as np

FRAME = 512
CAP_DB = 40.0
Spans = list[tuple[int, int]]


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(mono float32 samples, rate) of a PCM or float WAV file; integers scale by 2^(bits-1)-1."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
        if width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 127
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
            x = (np.where(v >= 1 << 23, v - (1 << 24), v) / ((1 << 23) - 1)).astype(np.float32)
        else:
            x = (np.frombuffer(raw, f"<i{width}") / (2 ** (8 * width - 1) - 1)).astype(np.float32)
    except wave.Error:
        x, channels, rate = _float_wav(data)
    usable = len(x) - len(x) % channels
    return (x[:usable].reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else np.asarray(x, np.float32)), rate


def _float_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """IEEE-float WAV, which the standard module doesn't read."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            kind, channels, rate, bits = form[0], form[1], form[2], form[5]
            if kind == 0xFFFE:
                kind = 3 if bits in (32, 64) else 1
            if kind != 3:
                break
            body = data[at + 8 : at + 8 + size]
            step = bits // 8
            return np.frombuffer(body[: len(body) // step * step], f"<f{step}").astype(np.float32), channels, rate
        at += 8 + size + size % 2
    raise ValueError("unsupported WAV encoding")


def encode_wav(audio: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(pcm16(audio).tobytes())
    return out.getvalue()


def pcm16(audio: np.ndarray) -> np.ndarray:
    return (np.clip(np.asarray(audio, np.float64), -1, 1) * 32767).astype("<i2")


def from_pcm16(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2").astype(np.float32) / 32767


def resample(audio: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation; the canonical resampler."""
    if source == target or not len(audio):
        return np.asarray(audio, np.float32)
    count = int(len(audio) * target / source)
    places = np.arange(count) * (len(audio) / max(count, 1))
    return np.interp(places, np.arange(len(audio)), audio).astype(np.float32)


def resample_sinc(audio: np.ndarray, source: int, target: int, taps: int = 64) -> np.ndarray:
    """Windowed-sinc interpolation to round(len * target / source) samples; short clips go linear."""
    if source == target:
        return np.asarray(audio, np.float32)
    if len(audio) < taps:
        return resample(audio, source, target)
    count, cutoff, half = round(len(audio) * target / source), min(1.0, target / source), taps // 2
    padded = np.pad(np.asarray(audio, np.float64), half)
    out = np.empty(count, np.float32)
    for start in range(0, count, 1 << 14):
        place = np.arange(start, min(count, start + (1 << 14))) * (source / target)
        base = np.floor(place).astype(np.int64)
        offset = np.arange(-half + 1, half + 1)
        x = place[:, None] - (base[:, None] + offset)
        weight = cutoff * np.sinc(cutoff * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / half, -1, 1)))
        index = np.clip(base[:, None] + offset + half, 0, len(padded) - 1)
        out[start : start + len(place)] = (padded[index] * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return out


def resample_closed(audio: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation that keeps both ends, as enhancement models get and give it."""
    if source == target or not len(audio):
        return np.asarray(audio, np.float32)
    count = max(1, round(len(audio) * target / source))
    return np.interp(np.linspace(0, len(audio) - 1, count), np.arange(len(audio)), audio).astype(np.float32)


def fit_length(audio: np.ndarray, n: int) -> np.ndarray:
    """The clip repeated or cut to n samples."""
    return np.resize(audio, n).astype(np.float32) if len(audio) else np.zeros(n, np.float32)


def energies(audio: np.ndarray, frame: int = FRAME, partial: bool = True) -> np.ndarray:
    x = np.asarray(audio, np.float64) ** 2
    whole = len(x) // frame * frame
    out = x[:whole].reshape(-1, frame).mean(axis=1)
    return np.r_[out, x[whole:].mean()] if partial and whole < len(x) else out


def energy_vad(audio: np.ndarray, frame: int = FRAME) -> Spans:
    """Spans of frames louder than mean plus deviation, one each."""
    e = energies(audio, frame)
    if not len(e) or (center := e.mean()) < 1e-4:
        return []
    hits = np.flatnonzero(e > center + e.std())
    if len(hits) < 0.1 * len(e):
        return []
    return [(int(i) * frame, min(len(audio), (int(i) + 1) * frame)) for i in hits]


def merge(spans: Spans, n: int) -> Spans:
    out: Spans = []
    for s, e in sorted((min(max(s, 0), n), min(max(e, 0), n)) for s, e in spans):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def snr(audio: np.ndarray, rate: int, spans: Spans | None, frame: int = FRAME) -> tuple[float, str | None]:
    """(decibels, note). Without spans frames are split at their third quartile; NaN if that can't be."""
    x = np.asarray(audio, np.float64)
    if not spans:
        if len(x) < frame:
            return CAP_DB, None
        e = energies(x, frame, partial=False)
        top = np.percentile(e, 75)
        loud, quiet = e[e >= top], e[e < top]
        if not len(quiet):
            return math.nan, None
        return _decibels(loud.mean(), quiet.mean()), None
    square = np.r_[0.0, np.cumsum(x * x)]
    merged = merge(spans, len(x))
    inside = sum(e - s for s, e in merged)
    signal = sum(square[e] - square[s] for s, e in merged)
    outside = len(x) - inside
    if outside < 0.1 * rate:
        return CAP_DB, "insufficient_noise_floor"
    cuts = [0, *[v for span in merged for v in span], len(x)]
    noise = sum(float(np.dot(x[a:b], x[a:b])) for a, b in zip(cuts[::2], cuts[1::2]))
    if noise == 0:
        return CAP_DB, None
    return _decibels(signal / inside if inside else 0.0, noise / outside), None


def _decibels(signal: float, noise: float) -> float:
    return 10 * math.log10(signal / (noise + 1e-10)) if signal > 0 else -math.inf


def trim_bounds(n: int, rate: int, spans: Spans, padding_ms: float, least_seconds: float) -> tuple[int, int] | None:
    """[start, end) from the first to the last span with padding; None if that is too short."""
    pad = int(rate * padding_ms / 1000)
    start, end = max(0, min(s for s, _ in spans) - pad), min(n, max(e for _, e in spans) + pad)
    return (start, end) if (end - start) / rate >= least_seconds else None


def fingerprint(audio: np.ndarray) -> int:
    """64 spectral bands of the first 2048 samples against their mean, as a signed 64-bit number."""
    spectrum = np.abs(np.fft.rfft(np.asarray(audio, np.float32), n=2048))[1:]
    bits = spectrum.reshape(64, 16).mean(axis=1) > spectrum.mean()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def log_mel(audio: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 256, mels: int = 100) -> np.ndarray:
    """(frames, mels) natural logarithm of the magnitude mel spectrogram, floor 1e-5, centred frames."""
    x = np.pad(np.asarray(audio, np.float64), n_fft // 2, mode="reflect" if len(audio) > n_fft // 2 else "constant")
    frames = 1 + max(0, len(x) - n_fft) // hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    cuts = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop][:frames] * window
    magnitude = np.abs(np.fft.rfft(cuts, axis=1))
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.log(np.maximum(magnitude @ np.maximum(0, np.minimum(rise, fall)), 1e-5)).astype(np.float32)


def mel_frames(n: int, hop: int = 256) -> int:
    return max(1, n // hop)
