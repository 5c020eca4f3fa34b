"""Audio kernels in numpy, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np

FRAME, HOP = 4096, 2048
#: Magnitudes below this count as it: -120 dB.
FLOOR = 1e-6


def windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping stretches of a signal, one a row; none if it is shorter than one."""
    if len(x) < size:
        return np.zeros((0, size), dtype=x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def log_spectrogram(x: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Magnitudes in dB, [bands, frames], scaled by the window's sum; neither padded nor extended."""
    taper = hann(size)
    spectrum = np.fft.rfft(windows(x.astype(np.float64), size, hop) * taper, axis=1) / taper.sum()
    return 20 * np.log10(np.abs(spectrum).T + FLOOR)


def sliding_max(grid: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Maxima over ``size`` cells, size // 2 of them before each; edges are mirrored."""
    pad = [(0, 0)] * grid.ndim
    pad[axis] = (size // 2, size - 1 - size // 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(grid, pad, mode="symmetric"), size, axis=axis).max(axis=-1)


def constellation(spectrogram: np.ndarray, neighborhood: int = 20, energy_pct: float = 20.0, flux_pct: float = 25.0) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bands) of peaks, by time, then band: local maxima, well above the mean, in active frames."""
    if not spectrogram.size:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    energy = spectrogram.mean(axis=0)
    rise = np.maximum(np.diff(spectrogram, axis=1, prepend=spectrogram[:, :1]), 0).sum(axis=0)
    active = (energy >= np.percentile(energy, energy_pct)) | (rise >= np.percentile(rise, flux_pct))
    peak = spectrogram == sliding_max(sliding_max(spectrogram, neighborhood, 0), neighborhood, 1)
    peak &= (spectrogram > spectrogram.mean() + 0.5 * spectrogram.std()) & active[None, :]
    at, band = np.nonzero(peak.T)
    return at, band


def fingerprint(x: np.ndarray, sr: int = 16000, fan: int = 15, max_dt: float = 5.0, min_dt: float = 0.0, size: int = FRAME, hop: int = HOP, neighborhood: int = 20, energy_pct: float = 20.0, flux_pct: float = 25.0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, seconds) of a signal's landmarks: each peak with the next ``fan`` peaks from ``min_dt`` to ``max_dt`` later."""
    at, band = constellation(log_spectrogram(x, size, hop), neighborhood, energy_pct, flux_pct)
    n = len(at)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    first = np.repeat(np.arange(n), fan)
    second = first + np.tile(np.arange(1, fan + 1), n)
    ok = second < n
    first, second = first[ok], second[ok]
    dt = at[second] - at[first]
    ok = (dt * hop / sr <= max_dt) & (dt * hop / sr >= min_dt)
    first, second, dt = first[ok], second[ok], dt[ok]
    low = 1023
    hashes = ((band[first] & low).astype(np.int64) << 20) | ((band[second] & low).astype(np.int64) << 10) | (dt & low)
    return hashes, at[first] * hop / sr


def bandwidth(x: np.ndarray, sr: int, share: float = 0.985) -> float:
    """Spectral roll-off in Hz from averaged periodograms (mean removed, half overlap); 0 for very short signals."""
    if len(x) < 2048:
        return 0.0
    size = min(FRAME, len(x))
    parts = windows(x.astype(np.float64), size, size - size // 2)
    parts = (parts - parts.mean(axis=1, keepdims=True)) * hann(size)
    power = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(axis=0)
    power[1 : (-1 if size % 2 == 0 else None)] *= 2
    run = np.cumsum(power)
    if run[-1] <= 0:
        return 0.0
    return float(min(np.searchsorted(run, share * run[-1]), len(run) - 1) * sr / size)


def clip_ratio(x: np.ndarray, threshold: float = 0.999) -> float:
    level = np.abs(x)
    return float(np.mean(level >= threshold * (level.max() + 1e-9))) if len(x) else 0.0


def dropout_ratio(x: np.ndarray, sr: int, window_ms: float = 20.0, silence_db: float = -60.0) -> float:
    """Silent share of short windows between the first and the last that is heard."""
    size = max(1, int(sr * window_ms / 1000))
    count = len(x) // size
    if len(x) < sr // 10 or count < 3:
        return 0.0
    power = np.mean(np.square(x[: count * size].astype(np.float64)).reshape(count, size), axis=1) + 1e-12
    level = np.sqrt(power)
    heard = np.flatnonzero(20 * np.log10(level / (level.max() + 1e-12)) > silence_db)
    return 1 - len(heard) / (heard[-1] - heard[0] + 1) if len(heard) else 0.0
