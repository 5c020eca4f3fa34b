"""Image kernels over stacks of gray frames [n, height, width], all frames at once."""

from __future__ import annotations

import hashlib

import numpy as np

EDGE, LOW = 32, 8


def resize(frames: np.ndarray, height: int, width: int) -> np.ndarray:
    """Triangle-filtered resampling: shrinking averages over the area that a pixel covers."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        center = (np.arange(m) + 0.5) * n / m - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - center[:, None]) / scale)
        return w / w.sum(axis=1, keepdims=True)

    _, h, w = frames.shape
    return np.einsum("ih,nhw,jw->nij", weights(h, height), frames.astype(np.float64), weights(w, width), optimize=True)


def cosine_basis(n: int) -> np.ndarray:
    """Rows of the orthonormal type-II cosine transform."""
    k, i = np.mgrid[:n, :n]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def perceptual_hash(frames: np.ndarray) -> np.ndarray:
    """64-bit hashes, as signed integers: low cosine coefficients against the median of all but the first, row by row."""
    if frames.shape[1:] != (EDGE, EDGE):
        frames = np.clip(np.rint(resize(frames, EDGE, EDGE)), 0, 255)
    basis = cosine_basis(EDGE)[:LOW]
    low = np.einsum("ui,nij,vj->nuv", basis, frames.astype(np.float64), basis, optimize=True).reshape(len(frames), -1)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def entropy(frames: np.ndarray) -> np.ndarray:
    """Bits of each frame's histogram of 256 levels."""
    n = len(frames)
    flat = frames.reshape(n, -1).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * 256 + flat).ravel(), minlength=256 * n).reshape(n, 256)
    p = counts / max(1, flat.shape[1])
    return -np.sum(p * np.log2(np.where(p > 0, p, 1)), axis=1)


def edge_density(frames: np.ndarray, step: int = 16) -> np.ndarray:
    """The mean over both directions of the share of steps larger than ``step``."""
    x = frames.astype(np.int16)
    return sum((np.abs(np.diff(x, axis=a)) > step).mean(axis=(1, 2)) for a in (1, 2)) / 2


def detail(frames: np.ndarray, band: tuple[float, float] = (0.25, 0.9)) -> float:
    """Median over frames of the share of spectral power within a band of normalised radii."""
    if not len(frames):
        return 0.0
    _, h, w = frames.shape
    power = np.abs(np.fft.fftshift(np.fft.fft2(frames.astype(np.float64)), axes=(1, 2))) ** 2
    y, x = (np.arange(n) / (n / 2) - 1 for n in (h, w))
    radius = np.hypot(y[:, None], x[None, :]) / np.sqrt(2)
    inside = (radius >= band[0]) & (radius <= band[1])
    return float(np.median(power[:, inside].sum(axis=1) / (power.sum(axis=(1, 2)) + 1e-9)))


def blockiness(frames: np.ndarray, block: int = 8) -> float:
    """How much steeper steps across block borders are than the others; 0 at least."""
    if not len(frames) or frames.shape[2] <= block:
        return 0.0
    steps = np.abs(np.diff(frames.astype(np.float64), axis=2)).mean(axis=1)
    border = np.arange(steps.shape[1]) % block == block - 1
    inner = steps[:, ~border].mean(axis=1)
    return float(max(0.0, np.median((steps[:, border].mean(axis=1) - inner) / (inner + 1e-6))))


def banding(frames: np.ndarray) -> float:
    """The share of exactly flat steps among small ones, the median over frames."""
    if not len(frames):
        return 0.0
    steps = np.abs(np.diff(frames.astype(np.int16), axis=2))
    return float(np.median((steps == 0).sum(axis=(1, 2)) / ((steps < 4).sum(axis=(1, 2)) + 1e-6)))


def _lit(profile: np.ndarray, dark: int) -> slice:
    """From the first to the last place of a brightness profile that is above ``dark``."""
    above = profile > dark
    return slice(int(above.argmax()), len(above) - int(above[::-1].argmax())) if above.any() else slice(0, 0)


def active_crop(frames: np.ndarray, dark: int = 24, least_bar: float = 0.02) -> tuple[int, int, int, int] | None:
    """(w, h, x, y) inside black bars, with even sizes; None without bars worth cropping.

    A row or column belongs to a bar if no frame ever lights it. One bar of ``least_bar`` of the
    picture's height or width is enough to crop all of them.
    """
    if not len(frames):
        return None
    brightest = frames.max(axis=0)
    tall, wide = brightest.shape
    rows, cols = _lit(brightest.max(axis=1), dark), _lit(brightest.max(axis=0), dark)
    bars = (rows.start / tall, 1 - rows.stop / tall, cols.start / wide, 1 - cols.stop / wide)
    w, h = ((x.stop - x.start) & ~1 for x in (cols, rows))
    if not w or not h or max(bars) < least_bar or (w, h) == (wide, tall):
        return None
    return w, h, cols.start, rows.start


def content_id(frames: np.ndarray, samples: int = 16) -> str:
    """128-bit BLAKE2b of at most ``samples`` evenly spaced key frames of 64 by 64."""
    n = len(frames)
    if n > samples:
        frames = frames[np.rint(np.linspace(0, n - 1, samples)).astype(int)]
    digest = hashlib.blake2b(f"{len(frames)}x{frames.shape[1]}".encode(), digest_size=16)
    digest.update(np.ascontiguousarray(frames).tobytes())
    return digest.hexdigest()


def fallback_id(path: str, size: int) -> str:
    return "stat-" + hashlib.blake2b(f"{path}:{size}".encode(), digest_size=16).hexdigest()
