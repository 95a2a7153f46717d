"""Decoders from file bytes to numbers, chosen by suffix and replaceable.

A decoder is a function of a file's bytes. One that can't read a file returns None, which leaves the
file without a hash. Formats that need a library that is not here (video, MP3, PDF) have no decoder
until the caller gives one to ``DECODERS`` or ``with_decoders``.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

JPEG = ("jpg", "jpeg", "jpe")
#: Rate at which sound is compared.
RATE = 22050


@dataclass
class Sound:
    """Mono samples at ``RATE``, and the duration of the whole file in seconds."""

    samples: np.ndarray
    length: float


@dataclass
class Video:
    """Duration in seconds, size, format, and a function from a second to an (h, w, 3) frame."""

    length: float
    width: int
    height: int
    format: str
    frame: Callable[[int], np.ndarray | None]


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(x):
        return x
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(x.dtype)


def read_wav(data: bytes, offset: float = 0.0, length: float = 0.0) -> Sound | None:
    """PCM WAV of 8, 16 or 32 bits; channels are averaged. offset, length: seconds, 0 for all."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, rate, channels, n = f.getsampwidth(), f.getframerate(), f.getnchannels(), f.getnframes()
            f.setpos(min(n, int(offset * rate)))
            raw = f.readframes(int(length * rate) if length else n)
    except (wave.Error, EOFError, RuntimeError):
        return None
    if width not in (1, 2, 4) or not rate or not channels:
        return None
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) * 256 if width == 1 else x / 65536 if width == 4 else x
    mono = x.reshape(-1, channels).mean(1)
    return Sound(np.clip(resample(mono, rate), -32768, 32767).astype(np.int16), n / rate)


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV file of ``samples``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def read_png(data: bytes) -> np.ndarray | None:
    """8-bit PNG without interlace (gray, RGB, palette, with or without alpha) as (h, w, 3)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, idat, palette, head = 8, b"", None, None
    try:
        while at < len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = body
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                idat += body
            at += 12 + size
        w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
        depth, color, interlace = head[8], head[9], head[12]
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth != 8 or interlace:
            return None
        raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * n)
        out = np.zeros((h, w * n), np.uint8)
        for y in range(h):
            out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], out[y - 1] if y else np.zeros(w * n, np.uint8), n)
        px = out.reshape(h, w, n)
    except (zlib.error, ValueError, KeyError, TypeError, IndexError):
        return None
    if color == 3:
        return palette[px[:, :, 0]]
    return px[:, :, :3] if n >= 3 else np.repeat(px[:, :, :1], 3, 2)


def _unfilter(kind: int, row: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + up
    out = np.zeros(len(row), np.int64)
    for i in range(len(row)):
        a, b, c = (out[i - n] if i >= n else 0), int(up[i]), (int(up[i - n]) if i >= n else 0)
        if kind == 1:
            p = a
        elif kind == 3:
            p = (a + b) // 2
        else:
            e = a + b - c
            da, db, dc = abs(e - a), abs(e - b), abs(e - c)
            p = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (int(row[i]) + p) & 255
    return out.astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """(h, w, 3) as PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    h, w, _ = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.asarray(pixels, np.uint8).reshape(h, -1)], 1)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


_MAGIC = ((b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tif"), (b"MM\0*", "tif"))


def image_suffix(data: bytes) -> str:
    """Suffix of an image without a name, by its first bytes; empty if they are unknown."""
    return next((suffix for magic, suffix in _MAGIC if data.startswith(magic)), "")


def shrink(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area-averaged to exactly w x h, whatever the aspect; small images are repeated up first."""
    y, x = pixels.shape[:2]
    big = pixels.astype(np.float64)
    big = np.repeat(big, -(-h // y), 0) if y < h else big
    big = np.repeat(big, -(-w // x), 1) if x < w else big
    ys, xs = np.linspace(0, big.shape[0], h + 1), np.linspace(0, big.shape[1], w + 1)

    def means(a: np.ndarray, cut: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])
        low = np.floor(cut).astype(int)
        part = (cut - low).reshape(-1, *[1] * (a.ndim - 1))
        at = total[low] + part * np.concatenate([a, a[-1:]])[np.minimum(low, len(a))]
        return np.diff(at, axis=0) / np.diff(cut).reshape(-1, *[1] * (a.ndim - 1))

    out = means(means(big, ys).swapaxes(0, 1), xs).swapaxes(0, 1)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def grays(pixels: np.ndarray, side: int) -> list[int]:
    """Integer brightness of a side x side version, row by row."""
    px = shrink(pixels, side, side).astype(int)
    return ((30 * px[..., 0] + 59 * px[..., 1] + 11 * px[..., 2]) // 100).reshape(-1).tolist()


@dataclass
class Decoders:
    """Functions by suffix: images to (h, w, 3), sound to ``Sound``, videos to ``Video``, e-books to a cover's bytes."""

    image: dict[str, Callable[[bytes], np.ndarray | None]] = field(default_factory=lambda: {"png": read_png})
    audio: dict[str, Callable[[bytes], Sound | None]] = field(default_factory=lambda: {"wav": read_wav})
    video: dict[str, Callable[[bytes], Video | None]] = field(default_factory=dict)
    ebook: dict[str, Callable[[bytes], bytes | None]] = field(default_factory=dict)

    def of(self, kind: str, path: str) -> Callable | None:
        """The decoder of a path's suffix; the JPEG suffixes stand for each other."""
        found, suffix = getattr(self, kind), path.rpartition(".")[2].lower()
        same = JPEG if kind == "image" and suffix in JPEG else ()
        return next((found[s] for s in (suffix, *same) if s in found), None)
