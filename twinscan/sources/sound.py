"""Peaks of a sound's spectrum, in numpy: one spectrum per file, thresholds tried on it."""

from __future__ import annotations

import numpy as np

from ..operators.peaks import FAN, FARTHEST

SIZE, HOP, NEAR = 4096, 2048, 20
# Amplitude thresholds in dB, the highest first.
AMPLITUDES = tuple(range(50, 0, -5))


def spectrum(samples: np.ndarray, rate: int = 22050) -> np.ndarray:
    """Power density in dB, (2049, windows); no windows for fewer samples than one window."""
    n = (len(samples) - (SIZE - HOP)) // HOP
    if len(samples) < SIZE or n < 1:
        return np.zeros((SIZE // 2 + 1, 0), np.float32)
    hann = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / (SIZE - 1))).astype(np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), SIZE)[::HOP][:n]
    power = np.abs(np.fft.rfft(windows * hann, axis=1)).astype(np.float32) ** 2
    power[:, 1:-1] *= 2
    power /= rate * float((hann.astype(np.float64) ** 2).sum())
    return (10 * np.log10(np.maximum(power, 1e-8))).T


def _diamond(x: np.ndarray, steps: int, low: bool = False) -> np.ndarray:
    """Greatest (or least) value within ``steps`` moves up, down, left or right."""
    pick = np.minimum if low else np.maximum
    for _ in range(steps):
        out = x.copy()
        pick(out[1:], x[:-1], out=out[1:])
        pick(out[:-1], x[1:], out=out[:-1])
        pick(out[:, 1:], x[:, :-1], out=out[:, 1:])
        pick(out[:, :-1], x[:, 1:], out=out[:, :-1])
        x = out
    return x


def hash_count(t: np.ndarray) -> int:
    """How many constellation hashes peaks at these times, in order, make."""
    return sum(int((t[k:] - t[:-k] <= FARTHEST).sum()) for k in range(1, FAN + 1) if len(t) > k)


def peaks(db: np.ndarray, seconds: float) -> list[tuple[int, int]]:
    """(frequency bin, window) of local maxima, at the first threshold at which they make enough hashes.

    Enough: more than a fourth of the file's whole seconds; the lowest threshold's peaks otherwise. Flat
    zero background (eroded, so that its edges may still be peaks) is left out.
    """
    if not db.shape[1]:
        return []
    top = _diamond(db, NEAR) == db
    background = _diamond((db == 0).astype(np.int8), NEAR, low=True).astype(bool)
    f, t = np.nonzero(top & ~background)
    order = np.lexsort((f, t))
    f, t = f[order], t[order]
    loud = db[f, t]
    for amplitude in AMPLITUDES:
        keep = loud > amplitude
        if hash_count(t[keep]) > int(seconds) >> 2:
            break
    return list(zip(f[keep].tolist(), t[keep].tolist(), strict=True))
