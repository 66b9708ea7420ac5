"""Audio bytes and log-mel features: numpy over Arrow batches, since bytes and FFTs have no column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StringType

# The feature front end.
RATE, WINDOW, SHIFT, FFT, MELS = 16_000, 400, 160, 512, 80
LOWEST, HIGHEST, PREEMPHASIS, FLOOR = 20.0, 8000.0, 0.97, 1.1920929e-07
WIDTHS = {"float32": 4, "int16": 2}


def whole_samples(payload: Column, form: Column) -> Column:
    """Whether the payload has a known format and holds whole samples."""
    return (form == "float32") & (F.octet_length(payload) % 4 == 0) | (form == "int16") & (F.octet_length(payload) % 2 == 0)


def pcm_samples(payload: bytes | None, form: str | None) -> np.ndarray | None:
    """Little-endian PCM as floats in [-1, 1); null for unknown formats and parts of samples."""
    if payload is None or form not in WIDTHS or len(payload) % WIDTHS[form]:
        return None
    return np.frombuffer(payload, "<f4") if form == "float32" else np.frombuffer(payload, "<i2").astype(np.float32) / 32768


@F.pandas_udf(ArrayType(FloatType()))
def decode_pcm(payload: pd.Series, form: pd.Series) -> pd.Series:
    """``pcm_samples`` of a column of payloads and one of formats."""
    return pd.Series([pcm_samples(r, k) for r, k in zip(payload, form, strict=True)])


@F.pandas_udf(BinaryType())
def encode_floats(samples: pd.Series) -> pd.Series:
    """Samples as little-endian float32 payloads."""
    return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in samples])


#: Half of the low-pass filter's length, in periods of the lower rate, and the Kaiser window's shape.
HALF_LENGTH, KAISER = 10, 5.0


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase resampling by the reduced ratio of the rates: up, a windowed-sinc low pass of unit gain, down.

    The result has ceil(n * up / down) samples. Only the filter taps that meet a sample are computed: output k sees the
    inputs around k * down / up through the phase (k * down) mod up of the filter.
    """
    if source == target or not len(x):
        return x.astype(np.float32)
    common = math.gcd(source, target)
    up, down = target // common, source // common
    most = max(up, down)
    half = HALF_LENGTH * most
    at = np.arange(-half, half + 1)
    taps = np.sinc(at / most) * np.kaiser(2 * half + 1, KAISER)
    taps *= up / taps.sum()
    size = -(-len(x) * up // down)
    reach = half // up + 1
    padded = np.concatenate([np.zeros(reach), x.astype(np.float64), np.zeros(reach + 1)])
    out = np.empty(size)
    near = np.arange(-reach, reach + 1)
    for begin in range(0, size, 65_536):
        place = np.arange(begin, min(size, begin + 65_536)) * down
        first, phase = place // up, place % up
        tap = phase[:, None] - near[None, :] * up + half  # of the filter, for input first + near
        weight = np.where((tap >= 0) & (tap <= 2 * half), taps[np.clip(tap, 0, 2 * half)], 0.0)
        out[begin : begin + len(place)] = (padded[np.minimum(first[:, None] + near[None, :] + reach, len(padded) - 1)] * weight).sum(axis=1)
    return out.astype(np.float32)


# WAVE format tags.
PCM, FLOAT, A_LAW, MU_LAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE


def mu_law(codes: np.ndarray) -> np.ndarray:
    """G.711 mu-law bytes as samples in (-1, 1): inverted sign, 3 bits of exponent, 4 of mantissa, a bias of 33 steps."""
    u = ~codes.astype(np.uint8)
    size = (((u & 0x0F).astype(np.int32) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size) / 32768.0


def a_law(codes: np.ndarray) -> np.ndarray:
    """G.711 A-law bytes as samples in (-1, 1): every second bit inverted, sign, 3 bits of exponent, 4 of mantissa."""
    a = codes.astype(np.uint8) ^ 0x55
    power = ((a >> 4) & 7).astype(np.int32)
    size = ((a & 0x0F).astype(np.int32) << 4) + np.where(power, 0x108, 8)
    size = np.where(power > 1, size << np.maximum(power - 1, 0), size)
    return np.where(a & 0x80, size, -size) / 32768.0


def _plain(kind: int, bits: int, data: bytes) -> np.ndarray | None:
    """The samples of a format, channels mixed in order; null for formats that aren't known."""
    if kind == PCM and bits == 8:
        return (np.frombuffer(data, "u1").astype(np.float64) - 128) / 128
    if kind == PCM and bits in (16, 32):
        return np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    if kind == PCM and bits == 24:
        low, middle, high = np.frombuffer(data, "u1").reshape(-1, 3).astype(np.int32).T
        return ((high << 24 | middle << 16 | low << 8) >> 8) / 2.0**23
    if kind == FLOAT and bits in (32, 64):
        return np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    if kind in (A_LAW, MU_LAW) and bits == 8:
        return (a_law if kind == A_LAW else mu_law)(np.frombuffer(data, "u1"))
    return None


def riff_chunks(raw: bytes) -> dict[bytes, bytes] | None:
    """The first chunk of each name of a RIFF/WAVE file, in whatever order they come.

    A data chunk of unknown length (0 or 0xFFFFFFFF, as a writer to a pipe leaves it) and one that is cut off go to
    the file's end; other chunks that are cut off are left out.
    """
    if len(raw) < 12 or raw[:4] not in (b"RIFF", b"RF64") or raw[8:12] != b"WAVE":
        return None
    found: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"data" and (size == 0xFFFFFFFF or body + size > len(raw) or (size == 0 and b"data" not in found and body < len(raw) and not _chunk_follows(raw, body))):
            size = len(raw) - body
        if body + size <= len(raw):
            found.setdefault(name, raw[body : body + size])
        at = body + size + size % 2  # chunks begin at even places
    return found


def _chunk_follows(raw: bytes, at: int) -> bool:
    """Whether a chunk with a printable name and a size that fits begins there."""
    name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
    return len(raw) >= at + 8 and all(32 <= c < 127 for c in name) and at + 8 + size <= len(raw)


def wave_samples(raw: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples (a row per frame, a column per channel) and rate of a RIFF/WAVE file; null for anything else.

    Integer PCM of 8, 16, 24 and 32 bits, floats of 32 and 64 bits, A-law and mu-law, also behind an extensible header. A
    part of a frame at the end is left out.
    """
    chunks = riff_chunks(raw) if raw is not None else None
    if not chunks or len(chunks.get(b"fmt ", b"")) < 16 or b"data" not in chunks:
        return None
    form = chunks[b"fmt "]
    kind, channels = (int.from_bytes(form[k : k + 2], "little") for k in (0, 2))
    rate, bits = int.from_bytes(form[4:8], "little"), int.from_bytes(form[14:16], "little")
    if kind == EXTENSIBLE:
        if len(form) < 26:
            return None
        kind = int.from_bytes(form[24:26], "little")
    width = channels * bits // 8
    if not channels or not rate or not width or bits % 8:
        return None
    data = chunks[b"data"]
    samples = _plain(kind, bits, data[: len(data) // width * width])
    return None if samples is None else (samples.reshape(-1, channels), rate)


@F.pandas_udf(ArrayType(FloatType()))
def load_wav(content: pd.Series) -> pd.Series:
    """RIFF/WAVE files of any form that ``wave_samples`` reads as mono floats at 16 kHz; null for anything else."""

    def one(raw):
        found = wave_samples(raw)
        return None if found is None else resample(found[0].mean(axis=1), found[1], RATE)

    return pd.Series([one(raw) for raw in content])


@F.pandas_udf(ArrayType(FloatType()))
def to_rate(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Arrays of samples at their own rates as mono floats at 16 kHz; null samples and rates below 1 give null."""
    return pd.Series([None if x is None or pd.isna(r) or r < 1 else resample(np.asarray(x, np.float64), int(r), RATE) for x, r in zip(samples, rate, strict=True)])


def encode_wave(samples: np.ndarray, rate: int = RATE, kind: int = PCM, bits: int = 16) -> bytes:
    """A WAVE file of integer PCM (16, 24, 32 bits) or floats; samples beyond [-1, 1) are clipped for PCM."""
    x = np.asarray(samples, np.float64)
    x = x.reshape(len(x), -1)
    if kind == FLOAT:
        data = x.astype(f"<f{bits // 8}").tobytes()
    else:
        whole = np.clip(np.round(x * 2.0 ** (bits - 1)), -(2 ** (bits - 1)), 2 ** (bits - 1) - 1).astype("<i4")
        data = whole.reshape(-1, 1).view("u1")[:, : bits // 8].tobytes()
    width = x.shape[1] * bits // 8
    form = kind.to_bytes(2, "little") + x.shape[1].to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * width).to_bytes(4, "little") + width.to_bytes(2, "little") + bits.to_bytes(2, "little")
    body = b"WAVEfmt " + len(form).to_bytes(4, "little") + form + b"data" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


@lru_cache(1)
def mel_filters() -> np.ndarray:
    to_mel = lambda hz: 1127.0 * np.log(1 + np.asarray(hz) / 700.0)
    low, high = to_mel(LOWEST), to_mel(HIGHEST)
    step = (high - low) / (MELS + 1)
    at = to_mel(np.arange(FFT // 2 + 1) * RATE / FFT)[None, :]
    left = (low + np.arange(MELS) * step)[:, None]
    up, down = (at - left) / step, (left + 2 * step - at) / step
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies, a row per frame; fewer samples than a window give no frame."""
    x = np.asarray(x, dtype=np.float64) * 32768
    if len(x) < WINDOW:
        return np.zeros((0, MELS))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::SHIFT]
    frames = frames - frames.mean(axis=1, keepdims=True)
    before = np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    hamming = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(WINDOW) / (WINDOW - 1))
    power = np.abs(np.fft.rfft((frames - PREEMPHASIS * before) * hamming, FFT)) ** 2
    return np.log(np.maximum(power @ mel_filters().T, FLOOR))


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def log_mel_frames(samples: pd.Series) -> pd.Series:
    """``log_mel`` of arrays of samples, in double precision."""
    return pd.Series([None if x is None else list(log_mel(x)) for x in samples])


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def fbank(samples: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in samples:
        yield pd.Series([None if x is None else [r.astype(np.float32) for r in log_mel(x)] for x in part])


def command_and_fields(message: str) -> tuple[str, dict]:
    """The command of a text frame and the JSON object that it came in.

    A JSON object's lower-cased ``type``, a bare word, or empty for broken JSON. Spark's own JSON parsers take trailing
    garbage as part of a document, so the strict one is used.
    """
    text = message.strip()
    if not text.startswith("{"):
        return text.lower(), {}
    try:
        found = json.loads(text)
    except ValueError:
        return "", {}
    return (str(found.get("type", "")).lower(), found) if isinstance(found, dict) else ("", {})


@F.pandas_udf(StringType())
def json_command(message: pd.Series) -> pd.Series:
    """The command of each text frame."""
    return pd.Series([None if m is None else command_and_fields(m)[0] for m in message], dtype=object)
