"""Media columns: WAV bytes by the wave module, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bound_batches

RATE = 8_000
FRAME, HOP = 256, 192
BANDS = ((1, 8), (8, 20), (20, 44), (44, 80), (80, 129))
PAIR_REACH = 3
UNIT = 576
CHUNK_FRAMES = 16_384


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit WAV; an odd number of samples gets the format's pad byte, which isn't a sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loudest bin of each band in every frame (frames x bands), with its strength; frames go in chunks.

    Silence fills the last frame, so every sample lies in a frame.
    """
    if not len(samples):
        return np.zeros((0, len(BANDS)), np.int64), np.zeros((0, len(BANDS)))
    short = -(len(samples) - FRAME) % HOP if len(samples) > FRAME else FRAME - len(samples)
    samples = np.concatenate([samples, np.full(short, 128, samples.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    bins, levels = [], []
    for at in range(0, len(frames), CHUNK_FRAMES):
        part = frames[at : at + CHUNK_FRAMES].astype(np.float32) - 128
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        best = [power[:, lo:hi].argmax(axis=1) + lo for lo, hi in BANDS]
        bins.append(np.stack(best, axis=1))
        levels.append(np.take_along_axis(power, bins[-1], 1))
    return np.concatenate(bins), np.concatenate(levels)


def pair_fingerprints(bins: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of peak pairs.

    A frame's peak is its band peak that stands out most against the band's mean over the recording; it is
    paired with the peaks of the next PAIR_REACH frames. code = bin << 20 | later bin << 8 | frames between.
    """
    if not len(bins):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    loud = levels / (levels.mean(axis=0) + 1e-9)
    peak = bins[np.arange(len(bins)), loud.argmax(axis=1)].astype(np.int64)
    times, codes = [], []
    for step in range(1, PAIR_REACH + 1):
        times.append(np.arange(len(peak) - step, dtype=np.int32))
        codes.append(peak[:-step] << 20 | peak[step:] << 8 | step)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def fingerprint(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    payload = from_wav(media)
    return payload, *pair_fingerprints(*spectral_peaks(np.frombuffer(payload, np.uint8)))


def padded(text: Column, unit: int = UNIT) -> Column:
    """UTF-8 bytes of the text (null: empty), bytes 255 appended up to a positive multiple of `unit`."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    missing = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), missing)))


def media_columns(rows: DataFrame, payload_col: str) -> DataFrame:
    """`rows` plus media (WAV bytes), media_payload (read back from them), peak_times and peak_codes.

    `payload_col` is binary; null is empty. Equal payloads give equal values. Payloads of up to FRAME
    bytes have one frame, so no pairs. Other columns are kept, those named like the new ones replaced. No shuffle: a row
    is encoded where it is read.
    """

    @F.pandas_udf("media binary, media_payload binary, peak_times array<int>, peak_codes array<long>")
    def encode(payloads: pd.Series) -> pd.DataFrame:
        out = []
        for payload in payloads:
            media = to_wav(bytes(payload) if payload is not None else b"")
            back, times, codes = fingerprint(media)
            out.append((media, back, times, codes))
        return pd.DataFrame(out, columns=["media", "media_payload", "peak_times", "peak_codes"])

    new = ["media", "media_payload", "peak_times", "peak_codes"]
    coded = bound_batches(rows).withColumn("_media", encode(F.col(payload_col)))
    return coded.select(*[c for c in rows.columns if c not in new], *[F.col(f"_media.{c}").alias(c) for c in new])
