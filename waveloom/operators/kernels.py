"""Numpy signal kernels on [rows, samples] blocks, called from Arrow-batched functions inside Spark tasks.

Only what has no SQL form is here: transforms, recursive filters, wavelets.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd

from ..functions.fixed import DB4_LOWPASS


def by_length(series: pd.Series, fn) -> list:
    """Apply ``fn([rows, n]) -> rows`` to equally long arrays together; keep the input order."""
    out = [None] * len(series)
    sizes: dict[int, list[int]] = {}
    for i, v in enumerate(series):
        if v is not None:
            sizes.setdefault(len(v), []).append(i)
    for idx in sizes.values():
        res = fn(np.stack([np.asarray(series.iloc[i], dtype=float) for i in idx]))
        for i, r in zip(idx, res):
            out[i] = r
    return out


def matrix(cell) -> np.ndarray:
    """Array-of-arrays cell to a 2-D block."""
    return np.stack([np.asarray(r, dtype=float) for r in cell])


def packed(x: np.ndarray) -> bytes:
    """Vectors as floats of 4 bytes where these are the same numbers, else of 8; the first 8 bytes name the size."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    x = small if np.array_equal(small, x) else x
    return np.int64(x.itemsize).tobytes() + x.tobytes()


def unpacked(b: bytes, dim: int, rows: int = -1) -> np.ndarray:
    return np.frombuffer(b, np.float32 if b[0] == 4 else np.float64, offset=8).reshape(rows, dim)


# ---- spectra ------------------------------------------------------------------------------------

def frames(x: np.ndarray, nperseg: int) -> np.ndarray:
    """[..., n] -> [..., frames, nperseg], half overlapping."""
    step = nperseg - nperseg // 2
    return np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=-1)[..., ::step, :]


def frame_spectra(x: np.ndarray, nperseg: int) -> np.ndarray:
    """Complex spectra of mean-free, Hann-weighted frames."""
    f = frames(x, nperseg)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg) if nperseg > 1 else np.ones(1)
    return np.fft.rfft((f - f.mean(axis=-1, keepdims=True)) * hann, axis=-1)


def welch(x: np.ndarray, sfreq: float, nperseg: int) -> np.ndarray:
    """One-sided power density, averaged over frames."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg) if nperseg > 1 else np.ones(1)
    p = (np.abs(frame_spectra(x, nperseg)) ** 2).mean(axis=-2) / (sfreq * np.sum(hann**2))
    last = -1 if nperseg % 2 == 0 else None
    p[..., 1:last] *= 2
    return p


def coherence(m: np.ndarray, nperseg: int) -> np.ndarray:
    """Magnitude-squared coherence [n, n, freq] of the rows of one window; 0 where a spectrum vanishes."""
    s = frame_spectra(m, nperseg)
    cross = np.einsum("afk,bfk->abk", s, s.conj()) / s.shape[1]
    auto = np.real(np.einsum("aak->ak", cross))
    den = auto[:, None, :] * auto[None, :, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        coh = np.abs(cross) ** 2 / den
    return np.nan_to_num(coh, nan=0.0, posinf=0.0, neginf=0.0)


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the last axis (one-sided spectrum doubled)."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * h, axis=-1)


def stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Centred Hann STFT with reflected ends: [rows, freq, frames]."""
    pad = n_fft // 2
    xp = np.pad(x, [(0, 0), (pad, pad)], mode="reflect")
    f = np.lib.stride_tricks.sliding_window_view(xp, n_fft, axis=-1)[:, ::hop, :]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.swapaxes(np.fft.rfft(f * hann, axis=-1), 1, 2)


# ---- recursive filters --------------------------------------------------------------------------

def butter_sos(order: int, sfreq: float, low: float | None, high: float | None) -> np.ndarray:
    """Butterworth second-order sections by the bilinear transform; low and high pass when one edge is absent."""
    nyq = sfreq / 2
    if low is not None and high is not None:
        high = min(high, nyq - 1e-3)
        if not 0 < low < high:
            raise ValueError("band edges must satisfy 0 < low < high < sfreq / 2")
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 4.0 * math.tan(math.pi * f / (2 * nyq))
    if low is not None and high is not None:
        w1, w2 = warp(low), warp(high)
        bw, w0 = w2 - w1, math.sqrt(w1 * w2)
        half = proto * bw / 2
        poles = np.concatenate([half + np.sqrt(half**2 - w0**2), half - np.sqrt(half**2 - w0**2)])
        zeros, gain = np.zeros(order, complex), bw**order
    elif high is not None:
        w = warp(high)
        poles, zeros, gain = proto * w, np.zeros(0, complex), w**order
    else:
        w = warp(low)
        poles, zeros, gain = w / proto, np.zeros(order, complex), 1.0
    zd = (4 + zeros) / (4 - zeros)
    pd_ = (4 + poles) / (4 - poles)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zd = np.concatenate([zd, -np.ones(len(pd_) - len(zd))])
    return _sections(zd, pd_, gain)


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Group conjugate poles into sections; zeros here are all +1 or -1."""
    up = sorted([p for p in poles if p.imag > 1e-12], key=lambda p: abs(p))
    real = sorted([p.real for p in poles if abs(p.imag) <= 1e-12], key=abs)
    den = [np.array([1, -2 * p.real, abs(p) ** 2]) for p in up]
    while len(real) > 1:
        a, b = real.pop(), real.pop(0)
        den.append(np.array([1, -(a + b), a * b]))
    if real:
        den.append(np.array([1, -real[0], 0]))
    z = sorted(zeros.real)
    num = []
    for d in den:
        if d[2] == 0 and len(z) % 2 == 1 and len(z) == 1:
            num.append(np.array([1, -z.pop(), 0]))
            continue
        a = z.pop(0) if z else None
        b = z.pop() if z else None
        num.append(np.array([1, -(a + b), a * b]) if b is not None else np.array([1, -a, 0]) if a is not None else np.array([1, 0, 0]))
    sos = np.array([np.concatenate([n, d]) for n, d in zip(num, den)], dtype=float)
    sos[0, :3] *= gain
    return sos


def notch_sos(freq: float, sfreq: float, q: float = 30.0) -> np.ndarray:
    """Second-order notch at ``freq`` with quality factor ``q``."""
    w0 = 2 * math.pi * freq / sfreq
    b = 1 / (1 + math.tan(w0 / q / 2))
    return np.array([[b, -2 * b * math.cos(w0), b, 1, -2 * b * math.cos(w0), 2 * b - 1]])


def steady_state(sos: np.ndarray) -> np.ndarray:
    """Section states for a constant unit input, [sections, 2]."""
    zi, scale = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        z1 = b2 - a2 * dc
        zi[i] = scale * np.array([b1 - a1 * dc + z1, z1])
        scale *= dc
    return zi


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter rows along the last axis from ``state`` [rows, sections, 2]; returns output and final state."""
    y, state = x.astype(float).copy(), state.astype(float).copy()
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z0, z1 = state[:, s, 0].copy(), state[:, s, 1].copy()
        for t in range(y.shape[1]):
            v = y[:, t].copy()
            o = b0 * v + z0
            z0 = b1 * v - a1 * o + z1
            z1 = b2 * v - a2 * o
            y[:, t] = o
        state[:, s, 0], state[:, s, 1] = z0, z1
    return y, state


def pad_length(sos: np.ndarray) -> int:
    n = 2 * len(sos) + 1
    n -= min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    return int(3 * n)


def odd_pad(x: np.ndarray, pad: int) -> np.ndarray:
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    return np.concatenate([left, x, right], axis=1)


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd padding at both ends."""
    pad = pad_length(sos)
    if x.shape[1] <= pad:
        raise ValueError(f"signal must be longer than {pad} samples for this filter")
    zi, e = steady_state(sos)[None], odd_pad(x, pad)
    y, _ = sos_filter(sos, e, zi * e[:, :1, None])
    y = y[:, ::-1]
    y, _ = sos_filter(sos, y, zi * y[:, :1, None])
    return y[:, ::-1][:, pad:-pad]


# ---- resampling and wavelets --------------------------------------------------------------------

def resample(x: np.ndarray, sfreq: float, target: float) -> np.ndarray:
    """Polyphase resampling with a Kaiser low pass, ends extended along the end-to-end line, trimmed or edge
    padded to round(n * target / sfreq)."""
    if math.isclose(sfreq, target, rel_tol=1e-9, abs_tol=1e-9):
        return x
    r = Fraction(target / sfreq).limit_denominator(1000)
    up, down = r.numerator, r.denominator
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    cut = 1.0 / max(up, down)
    h = np.sinc(cut * k) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = x.shape[1]
    line = x[:, :1] + (x[:, -1:] - x[:, :1]) * np.linspace(0, 1, n)[None] if n > 1 else x
    n_out = -(-n * up // down)
    dense = np.zeros((x.shape[0], (n - 1) * up + 1 + 2 * half))
    dense[:, half:half + (n - 1) * up + 1:up] = x - line
    # output j sits at dense position j * down; the kernel reaches half to each side
    pos = np.arange(n_out) * down
    pos = pos[pos <= (n - 1) * up]
    win = np.lib.stride_tricks.sliding_window_view(dense, 2 * half + 1, axis=1)[:, pos, :]
    y = win @ h[::-1] + (x[:, :1] + (x[:, -1:] - x[:, :1]) * (pos / ((n - 1) * up))[None] if n > 1 else x)
    want = int(round(n * target / sfreq))
    y = y[:, :want]
    return np.pad(y, [(0, 0), (0, max(0, want - y.shape[1]))], mode="edge")


def wavelet_energies(x: np.ndarray, level: int = 5) -> np.ndarray:
    """Energies of the Daubechies-4 sub-bands a_level, d_level .. d_1 with symmetric end extension."""
    lo = np.array(DB4_LOWPASS)
    hi = lo[::-1] * np.where(np.arange(len(lo)) % 2 == 0, -1.0, 1.0)
    a, det = x, []
    for _ in range(level):
        p = len(lo) - 1
        n = a.shape[1]
        # reflect including the edge sample, repeated when the block is shorter than the filter
        idx = np.arange(-p, n + p) % (2 * n)
        ext = a[:, np.where(idx < n, idx, 2 * n - 1 - idx)]
        w = np.lib.stride_tricks.sliding_window_view(ext, len(lo), axis=1)[:, 1::2, :]
        a, d = w @ lo[::-1], w @ hi[::-1]
        det.append((d**2).sum(axis=1))
    return np.stack([(a**2).sum(axis=1), *det[::-1]], axis=1)


def morlet_cwt(x: np.ndarray, dt: float, per_octave: int = 12, omega0: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Continuous wavelet transform with a Morlet wavelet; returns [rows, scales, n] and frequencies."""
    n = x.shape[1]
    flambda = 4 * np.pi / (omega0 + np.sqrt(2 + omega0**2))
    s0 = 2 * dt / flambda
    count = int(np.log2(n * dt / s0) * per_octave) + 1
    scales = s0 * 2 ** (np.arange(count) / per_octave)
    size = 1 << int(np.ceil(np.log2(n)))
    spec = np.fft.fft(x, size, axis=1)
    w = 2 * np.pi * np.fft.fftfreq(size, dt)
    psi = np.pi**-0.25 * np.exp(-0.5 * (scales[:, None] * w[None] - omega0) ** 2) * (w[None] > 0)
    psi = psi * np.sqrt(scales[:, None] * w[1] * size)
    out = np.fft.ifft(spec[:, None, :] * psi[None], axis=2)[:, :, :n]
    return out, 1 / (flambda * scales)
