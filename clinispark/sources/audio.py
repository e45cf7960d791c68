"""PCM audio as bytes in columns: decoded, resampled, trimmed and written with the standard library and NumPy."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RATE, FRAME, HOP, TOP_DB = 16_000, 2048, 512, 40.0
CLIP = "path string, rate int, seconds double, wav binary, error string"


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(channels, samples) as float32 in [-1, 1), and the rate, of a PCM WAV file's bytes."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).T, rate


def resample(x: np.ndarray, rate: int, to: int = RATE, zeros: int = 16) -> np.ndarray:
    """Mono samples at another rate: a sinc with a Hann window of `zeros` zero crossings a side, cut off at the lower half rate."""
    if rate == to or not len(x):
        return x
    n, low = max(1, round(len(x) * to / rate)), min(1.0, to / rate)
    reach = int(np.ceil(zeros / low))
    padded = np.pad(x.astype(np.float64), reach + 1)
    out = np.empty(n, np.float32)
    for i in range(0, n, 1 << 14):
        at = np.arange(i, min(n, i + (1 << 14))) * rate / to
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 2)
        away = (at[:, None] - near) * low
        taps = np.sinc(away) * np.where(np.abs(away) < zeros, 0.5 + 0.5 * np.cos(np.pi * away / zeros), 0.0)
        out[i : i + len(at)] = (padded[np.clip(near + reach + 1, 0, len(padded) - 1)] * taps).sum(1) / taps.sum(1)
    return out


def trim(x: np.ndarray, top_db: float = TOP_DB) -> np.ndarray:
    """Leading and trailing silence cut: frames whose level lies top_db below the loudest; inner silence stays."""
    if not len(x):
        return x
    padded = np.pad(x, FRAME // 2)
    power = np.array([np.mean(padded[i : i + FRAME] ** 2) for i in range(0, len(x) + 1, HOP)])
    loud = np.flatnonzero(10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10)) > -top_db)
    return x[loud[0] * HOP : min(len(x), (loud[-1] + 1) * HOP)] if len(loud) else x[:0]


def encode(x: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def preprocess(found: DataFrame, denoise=None, decoder=None) -> DataFrame:
    """(path, content) -> CLIP: 16 kHz mono, trimmed; denoise is an optional samples -> samples hook, off by default.

    decoder(bytes) -> (channels x samples, rate) opens files that are no PCM WAV, where its libraries are installed.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, data in zip(f["path"], f["content"], strict=True):
                try:
                    x, rate = decode(bytes(data)) if decoder is None or bytes(data[:4]) == b"RIFF" else decoder(bytes(data))
                    y = resample(x.mean(axis=0), rate)
                    y = trim(denoise(y) if denoise else y)
                    rows.append((path, RATE, len(y) / RATE, encode(y), None))
                except (wave.Error, EOFError, ValueError, TypeError) as e:
                    rows.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "seconds", "wav", "error"])

    return found.mapInPandas(run, CLIP)
