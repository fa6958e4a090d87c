"""Pluggable models. Acoustic models are not part of the engine; deterministic stand-ins make the plans run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: samples -> (start, end) regions; (samples, windows) -> vectors; samples -> (start, end, text, probability) words
VadFn = Callable[[np.ndarray], list[tuple[float, float]]]
EmbedFn = Callable[[np.ndarray, list[tuple[float, float]]], np.ndarray]
TranscribeFn = Callable[[np.ndarray], list[tuple[float, float, str, float]]]
RATE = 16_000


@dataclass(frozen=True)
class ClusteredConfig:
    window: float = 1.5
    stride: float = 0.75
    distance_threshold: float = 0.75
    num_speakers: int | None = None
    vad_threshold: float = 0.5
    min_gap: float = 0.3
    min_duration: float = 0.2
    vad_pad: float = 0.25


def energy_vad(samples: np.ndarray, threshold: float = 0.5, rate: int = RATE) -> list[tuple[float, float]]:
    """Regions of frames of 20 ms whose level is over a share of the loudest; only at 16 kHz."""
    if rate != RATE:
        raise ValueError(f"speech detection takes {RATE} Hz, not {rate}")
    size = RATE // 50
    n = len(samples) // size
    if not n:
        return []
    level = np.sqrt((np.asarray(samples[: n * size], np.float64).reshape(n, size) ** 2).mean(1))
    on = np.concatenate([[False], level > max(1e-4, 0.2 * threshold * level.max()), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return [(a * size / RATE, b * size / RATE) for a, b in edge.reshape(-1, 2).tolist()]


def spectral_embedding(samples: np.ndarray, windows: list[tuple[float, float]], size: int = 192) -> np.ndarray:
    """Log band energies of each window."""
    out = np.zeros((len(windows), size), np.float32)
    for i, (a, b) in enumerate(windows):
        clip = np.asarray(samples[int(a * RATE) : int(b * RATE)], np.float64)
        power = np.abs(np.fft.rfft(clip, 4096)[: size * 10].reshape(size, 10)) ** 2 if len(clip) else np.zeros((size, 10))
        out[i] = np.log1p(power.sum(1))
    out[np.linalg.norm(out, axis=1) == 0, 0] = 1.0
    return out


def silent_asr(samples: np.ndarray) -> list[tuple[float, float, str, float]]:
    """One placeholder word a region; a stand-in for a recogniser."""
    return [(a, b, "speech", 1.0) for a, b in energy_vad(samples)]
