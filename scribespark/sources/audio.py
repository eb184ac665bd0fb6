"""WAV files: encoding, and what their heads say."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.BinaryType())
def wav_bytes(samples: pa.Array, rate: pa.Array, channels: pa.Array) -> pa.Array:
    """16-bit frames (interleaved if more than one channel) as a WAV file; null for null."""
    out = []
    for x, r, c in zip(samples, rate, channels):
        if not x.is_valid:
            out.append(None)
            continue
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(c.as_py())
            w.setsampwidth(2)
            w.setframerate(r.as_py())
            w.writeframes(x.values.to_numpy(zero_copy_only=False).astype("<i2").tobytes())
        out.append(held.getvalue())
    return pa.array(out, pa.binary())


def wav_figures(read: Callable[[int, int], bytes], size: int) -> tuple[int, int, float] | None:
    """Rate, channels and seconds (3 digits) of a WAV of ``size`` bytes, None if it isn't one.

    ``read(at, n)`` gives n bytes from a place, fewer at the end. Only the heads of chunks and the format are read, however many
    chunks stand before the sound and however long it is.
    """
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= size:
        head = read(at, 8)
        if len(head) < 8:
            return None
        name, length = head[:4], int.from_bytes(head[4:], "little")
        if name == b"fmt ":
            body = read(at + 8, 16)
            if len(body) < 16:
                return None
            _, channels, rate, _, frame, _ = struct.unpack("<HHIIHH", body)
            found = rate, channels, frame
        elif name == b"data":
            if not found:
                return None
            rate, channels, frame = found
            return rate, channels, round(length / (frame * rate), 3) if frame * rate else None
        at += 8 + length + length % 2
    return None


_FIGURES = T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("duration_sec", T.DoubleType())])


@F.arrow_udf(_FIGURES)
def header(content: pa.Array) -> pa.Array:
    """struct(sample_rate, channels, duration_sec) of a WAV in a binary column; null if it isn't one: see ``wav_figures``."""
    names = _FIGURES.fieldNames()
    found = []
    for x in content:
        held = x.as_buffer() if x.is_valid else None
        found.append(held and wav_figures(lambda at, n, b=held: b[at : at + n].to_pybytes() if at < b.size else b"", held.size))
    return pa.array([f and dict(zip(names, f)) for f in found], pa.struct([("sample_rate", pa.int32()), ("channels", pa.int32()), ("duration_sec", pa.float64())]))
