"""Media columns: bytes stored as 8-bit WAV samples, and spectral-peak pair fingerprints.

A payload is written and read by the wave module. Its samples go through a short-time Fourier transform; in each
band of each frame the strongest bin is a peak if it isn't below the band's peaks of the frames beside it. Each
peak is paired with the next `FAN` peaks within `SPAN` frames; a pair is stored as the anchor's frame (time code)
and a number made of both bins and their distance in time.

Cases: a null or empty text is one block of fill bytes; equal texts give equal values; repeated rows and null ids each
get their row; an empty table gives no rows; long texts are transformed in blocks of frames, so memory is bounded by
the text itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import map_rows

BLOCK = 576  # payload bytes come in multiples of this
FRAME, HOP = 576, 288
RATE = 8000
BANDS = (2, 12, 28, 56, 104, 180, 289)  # bin limits
FAN, SPAN = 3, 31
FRAMES_AT_ONCE = 2048
_WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float64)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


def store(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band, the strongest bin and its power."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, powers = [], []
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        best = np.stack([low + power[:, low:high].argmax(1) for low, high in zip(BANDS, BANDS[1:])], 1)
        bins.append(best)
        powers.append(np.take_along_axis(power, best, 1))
    return np.concatenate(bins), np.concatenate(powers)


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frames) and pair numbers (f1 << 15 | f2 << 5 | distance), in order of time."""
    samples = np.frombuffer(data, np.uint8).astype(np.float64) - 128.0
    bins, power = band_peaks(samples)
    top = power > 1e-6
    top[1:] &= power[1:] >= power[:-1]
    top[:-1] &= power[:-1] >= power[1:]
    when, band = np.nonzero(top)
    freq = bins[when, band]
    times, pairs = [], []
    for step in range(1, FAN + 1):
        gap = when[step:] - when[:-step]
        near = gap <= SPAN
        times.append(when[:-step][near])
        pairs.append((freq[:-step][near] << 15) | (freq[step:][near] << 5) | gap[near])
    times, pairs = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((pairs, times))
    return times[order].astype(np.int32), pairs[order].astype(np.int32)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, fp_time, fp_pair and, as asked, the stored media and digests of what was read back."""
    schema = "doc_id long, n_bytes long" + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" * digests + ", media binary" * keep_media + ", fp_time array<int>, fp_pair array<int>"

    def run(batch):
        out = {name.split()[0]: [] for name in schema.split(", ")}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            media = store(payload(text))
            back = read(media)
            times, pairs = fingerprint(back)
            out["n_bytes"].append(len((text or "").encode("utf-8")))
            out["fp_time"].append(times)
            out["fp_pair"].append(pairs)
            if keep_media:
                out["media"].append(media)
            if digests:
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-32:]))
                out["media_bytes"].append(len(media))
                out["media_sha256"].append(hashlib.sha256(media).hexdigest())
                out["feature"].append(",".join([f"{t}:{p:x}" for t, p in zip(times.tolist(), pairs.tolist())]))
        return out

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), schema, run)
