"""Audio as bytes: decoding, mixing down, resampling, encoding. PCM in WAV files; other codecs need a decoder of their own."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
Decoder = Callable[[bytes], tuple[np.ndarray, int]]


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(float32 samples, channels averaged, rate)."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1).astype(np.float32), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_pcm(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2").astype(np.float32) / 32768


def resample(audio: np.ndarray, source: int, target: int) -> np.ndarray:
    """By a windowed-sinc filter at the reduced ratio of the rates; equal rates give the same samples."""
    if source == target:
        return np.asarray(audio, np.float32)
    g = math.gcd(source, target)
    up, down = target // g, source // g
    widest = max(up, down)
    half = 10 * widest
    taps = np.sinc(np.arange(-half, half + 1) / widest) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(audio) * up // down)
    place = np.arange(n) * down + half
    phase, last = place % up, place // up
    width = -(-len(taps) // up)
    bank = np.zeros((up, width))
    for p in range(up):
        bank[p, : len(taps[p::up])] = taps[p::up]
    padded = np.concatenate([np.zeros(width), np.asarray(audio, np.float64), np.zeros(width + half // up + 1)])
    return np.einsum("nk,nk->n", bank[phase], padded[last[:, None] + width - np.arange(width)]).astype(np.float32)


def read_audio(spark: SparkSession, path: str, rate: int = RATE, decode: Decoder = decode_wav) -> DataFrame:
    """(rec_id, path, sample_rate, duration, samples) of the audio files below a path; rec_id is the file's stem."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("rec_id"), "path", "content")

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            for r in t.itertuples():
                samples, source = decode(r.content)
                samples = resample(samples, source, rate)
                yield pd.DataFrame([{"rec_id": r.rec_id, "path": r.path, "sample_rate": rate, "duration": len(samples) / rate, "samples": samples}])

    return files.mapInPandas(run, "rec_id string, path string, sample_rate int, duration double, samples array<float>")


def with_wav(mixtures: DataFrame) -> DataFrame:
    """Adds ``wav``, the bytes of a WAV file of the samples."""

    @F.pandas_udf("binary")
    def encode(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([encode_wav(s, int(r)) for s, r in zip(samples, rate, strict=True)])

    return mixtures.withColumn("wav", encode("samples", "sample_rate"))
