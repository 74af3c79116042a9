"""Models behind the operators: a registry of named providers by kind.

Weights of third-party models aren't part of this engine. Each kind has deterministic
providers that need none, and ``register`` adds real ones. A provider is made once per
worker process, on first use. Transcribers and enhancers may have a ``run_batch`` that takes
a list of the argument tuples of ``run`` and gives a list of its results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from larkspur.functions import kernels as K


@dataclass
class InferenceResult:
    """What a session returns: audio or text, with whatever else is known."""

    audio: Any = None
    text: str | None = None
    sample_rate: int | None = None
    metadata: dict = field(default_factory=dict)


class SpeechDetector(Protocol):
    def spans(self, audio: np.ndarray, rate: int, frame: int) -> tuple[K.Spans, str]: ...


class EnergyDetector:
    """Frame energies; one span a frame, or joined frames if ``merged``."""

    def __init__(self, merged: bool = False):
        self.merged = merged

    def spans(self, audio: np.ndarray, rate: int, frame: int) -> tuple[K.Spans, str]:
        found = K.energy_vad(audio, frame)
        return (K.merge(found, len(audio)), "energy_merged") if self.merged else (found, "energy_fallback")


class WithFallback:
    """A model detector; where it finds nothing or fails, energies decide."""

    def __init__(self, model: SpeechDetector):
        self.model, self.energy = model, EnergyDetector()

    def spans(self, audio: np.ndarray, rate: int, frame: int) -> tuple[K.Spans, str]:
        try:
            found, name = self.model.spans(audio, rate, frame)
        except Exception:  # a failing model is the case that the fallback is for
            found, name = [], ""
        return (found, name) if found else self.energy.spans(audio, rate, frame)


class TableTranscriber:
    """Texts from a mapping of clip ids."""

    def __init__(self, texts: dict[str, str] | None = None):
        self.texts = texts or {}

    def run(self, doc_id: str, audio: np.ndarray, rate: int) -> InferenceResult:
        return InferenceResult(text=self.texts.get(doc_id, "").strip(), sample_rate=rate)


class PassThroughEnhancer:
    """Gives the audio back; stands for a model that works at ``required_rate``."""

    name, required_rate = "identity", 48_000

    def run(self, audio: np.ndarray) -> np.ndarray:
        return audio


class ToneSynthesizer:
    """A deterministic tone as long as the text, in place of a voice model."""

    rate = 16_000

    def run(self, text: str, voice: str) -> InferenceResult:
        n = max(1, len(text)) * self.rate // 20
        pitch = 110 + sum(voice.encode()) % 110
        return InferenceResult(audio=(0.3 * np.sin(2 * np.pi * pitch * np.arange(n) / self.rate)).astype(np.float32), sample_rate=self.rate)


class IdentityConverter:
    """Gives a voice back unchanged, in place of a voice-conversion model."""

    def run(self, audio: np.ndarray, rate: int) -> InferenceResult:
        return InferenceResult(audio=audio, sample_rate=rate)


_MAKERS: dict[tuple[str, str], Callable[[], Any]] = {
    ("detector", "energy"): EnergyDetector,
    ("detector", "energy_merged"): lambda: EnergyDetector(merged=True),
    ("transcriber", "table"): TableTranscriber,
    ("enhancer", "identity"): PassThroughEnhancer,
    ("synthesizer", "tone"): ToneSynthesizer,
    ("converter", "identity"): IdentityConverter,
}
_MADE: dict[tuple[str, str], Any] = {}


def register(kind: str, name: str, maker: Callable[[], Any]) -> None:
    """Add a provider; on a cluster the registering module must be imported by the workers too."""
    _MAKERS[kind, name.lower()] = maker
    _MADE.pop((kind, name.lower()), None)


def get_provider(kind: str, name: str) -> Any:
    """The process's provider of a kind by name, in any case; unknown names are a ValueError."""
    key = (kind, name.lower())
    if key not in _MAKERS:
        raise ValueError(f"unknown {kind}: {name}; there are {sorted(n for k, n in _MAKERS if k == kind)}")
    if key not in _MADE:
        _MADE[key] = _MAKERS[key]()
    return _MADE[key]


class InferenceSession:
    """Load, run, unload around a provider; running before loading is a RuntimeError."""

    def __init__(self, kind: str, family: str):
        self.kind, self.family, self._model = kind, family, None

    def load(self) -> InferenceSession:
        self._model = get_provider(self.kind, self.family)
        return self

    def run(self, *args, **options):
        if self._model is None:
            raise RuntimeError("load() comes before run()")
        return self._model.run(*args, **options)

    def unload(self) -> None:
        self._model = None

    def __enter__(self) -> InferenceSession:
        return self.load()

    def __exit__(self, *_) -> None:
        self.unload()
