"""Whole-recording filters as block scans, per-window kernels, and the preparation chain.

A recursive filter is linear in its state, so a recording is cut into blocks that are filtered in
parallel: each block's end state from rest, a short scan over block states, then the final pass. The
result equals filtering the whole recording at once, and no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import c
from . import kernels as K
from . import projections as prj
from . import quality as qc
from . import windows as win
from .landing import land

RKEYS = ["subject_id", "channel"]


def to_blocks(samples: DataFrame, block: int, keys: Sequence[str] = RKEYS) -> DataFrame:
    """(keys.., b, n_blocks, x): arrays of ``block`` samples; the rest joins the last block."""
    s = win.with_length(samples)
    nb = F.greatest(F.floor(F.col("n") / block), F.lit(1))
    s = s.withColumn("b", F.least(F.floor(F.col("t") / block), nb - 1)).withColumn("n_blocks", nb)
    return s.groupBy(*keys, "b").agg(F.max("n_blocks").alias("n_blocks"), F.max("n").alias("n"),
                                     F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s")).select(
        *keys, "b", "n_blocks", "n", F.col("s.value").alias("x"))


def _pass(blocks: DataFrame, sos: np.ndarray, keys: Sequence[str], x: str) -> DataFrame:
    """Filter the blocks of each key in order of ``b``, starting in the steady state of the first value."""
    n_sec = len(sos)
    zi = K.steady_state(sos)

    @F.pandas_udf("array<double>")
    def end_state(xs: pd.Series) -> pd.Series:
        def one(m):
            _, z = K.sos_filter(sos, m, np.zeros((len(m), n_sec, 2)))
            return z.reshape(len(m), -1)
        return pd.Series(K.by_length(xs, one))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        powers: dict[int, np.ndarray] = {}
        state, out = None, []
        for first, n, e in zip(pdf["first"], pdf["len"], pdf["e"]):
            if state is None:
                state = (zi * first).reshape(-1)
            out.append(state.tolist())
            if n not in powers:
                basis = np.eye(2 * n_sec).reshape(2 * n_sec, n_sec, 2)
                _, z = K.sos_filter(sos, np.zeros((2 * n_sec, int(n))), basis)
                powers[n] = z.reshape(2 * n_sec, -1)
            state = state @ powers[n] + np.asarray(e)
        return pdf[[*keys, "b"]].assign(state=out)

    @F.pandas_udf("array<double>")
    def final(xs: pd.Series, st: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(xs), index=xs.index, dtype=object)
        for _, idx in xs.groupby(xs.map(len)).groups.items():
            m = np.stack([np.asarray(v, float) for v in xs.loc[idx]])
            z = np.stack([np.asarray(v, float) for v in st.loc[idx]]).reshape(len(m), n_sec, 2)
            y, _ = K.sos_filter(sos, m, z)
            for i, r in zip(idx, y):
                out.at[i] = r
        return out

    small = blocks.select(*keys, "b", F.element_at(x, 1).alias("first"), F.size(x).alias("len"), end_state(c(x)).alias("e"))
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "b"]) + ", state array<double>"
    states = small.groupBy(*keys).applyInPandas(scan, schema)
    return blocks.join(states, [*keys, "b"]).withColumn(x, final(c(x), F.col("state"))).drop("state")


def filter_recording(samples: DataFrame, sos: np.ndarray, *, block: int = 65536, keys: Sequence[str] = RKEYS, short: str = "raise") -> DataFrame:
    """SIG12: zero-phase filtering of whole recordings, equal to one forward and one backward pass with odd padding.

    Recordings no longer than the padding raise, or are passed on as they are with ``short='keep'``.
    """
    if short == "keep":
        s = win.with_length(samples).select(*keys, "t", "value", "n")
        pad = K.pad_length(sos)
        return filter_recording(s.filter(F.col("n") > pad), sos, block=block, keys=keys).unionByName(s.filter(F.col("n") <= pad))
    pad = K.pad_length(sos)
    block = max(block, pad + 1)
    b = to_blocks(samples, block, keys)
    x, first, last = F.col("x"), F.col("b") == 0, F.col("b") == F.col("n_blocks") - 1
    too_short = F.size("x") <= pad
    x = F.when(too_short, F.raise_error(F.lit(f"recordings must be longer than {pad} samples"))).otherwise(x)
    head = F.transform(F.reverse(F.slice(x, 2, pad)), lambda v: 2 * F.element_at("x", 1) - v)
    tail = F.transform(F.reverse(F.slice(x, -(pad + 1), pad)), lambda v: 2 * F.element_at("x", -1) - v)
    none = F.array().cast("array<double>")
    b = b.withColumn("y", F.concat(F.when(first, head).otherwise(none), x, F.when(last, tail).otherwise(none)))
    # both steps of the backward pass read the forward result, so it is written once
    b = land(_pass(b, sos, keys, "y"))
    turned = b.withColumn("y", F.reverse("y")).withColumn("b", F.col("n_blocks") - 1 - F.col("b"))
    back = _pass(turned, sos, keys, "y").withColumn("y", F.reverse("y")).withColumn("b", F.col("n_blocks") - 1 - F.col("b"))
    cut = F.slice("y", F.when(F.col("b") == 0, pad + 1).otherwise(1), F.size("x"))
    return (back.select(*keys, "n", (F.col("b") * block).alias("_t0"), F.posexplode_outer(cut).alias("_i", "value"))
            .select(*keys, (F.col("_t0") + F.col("_i")).alias("t"), "value", "n"))


def bandpass_recording(samples: DataFrame, sfreq: float, low: float | None, high: float | None, order: int = 4, **kw) -> DataFrame:
    return filter_recording(samples, K.butter_sos(order, sfreq, low, high), **kw)


def notch_recording(samples: DataFrame, sfreq: float, freq: float, q: float = 30.0, **kw) -> DataFrame:
    return filter_recording(samples, K.notch_sos(freq, sfreq, q), **kw)


def map_windows(windows: DataFrame, fn, x: str = "x", out: str | None = None, returns: str = "array<double>") -> DataFrame:
    """UDF02: apply ``fn([rows, n]) -> rows`` to window arrays in Arrow batches; shapes may change."""

    @F.pandas_udf(returns)
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series(K.by_length(xs, fn))

    return windows.withColumn(out or x, run(c(x)))


def filter_windows(windows: DataFrame, sfreq: float, low: float | None, high: float | None, order: int = 4, x: str = "x") -> DataFrame:
    """SIG12 on windows: zero-phase Butterworth."""
    sos = K.butter_sos(order, sfreq, low, high)
    return map_windows(windows, lambda m: K.zero_phase(sos, m), x)


def resample_windows(windows: DataFrame, sfreq: float, target: float, x: str = "x") -> DataFrame:
    """SIG13."""
    return map_windows(windows, lambda m: K.resample(m, sfreq, target), x)


def spectrogram(windows: DataFrame, hop_ratio: float = 0.25, mode: str = "magnitude", x: str = "x") -> DataFrame:
    """WIN13: STFT with n_fft = round(sqrt(2 L / hop_ratio)), hop = round(n_fft hop_ratio); rows (part, f, frame, value).

    ``mode``: 'magnitude', 'real', or 'as_real' (real and imaginary parts stacked).
    """
    def values(m: np.ndarray):
        n_fft = int(round(np.sqrt(2.0 * m.shape[1] / hop_ratio)))
        hop = max(1, int(round(n_fft * hop_ratio)))
        s = K.stft(m, n_fft, hop)
        if mode == "magnitude":
            parts = np.abs(s)[:, None]
        elif mode == "real":
            parts = s.real[:, None]
        else:
            parts = np.stack([s.real, s.imag], axis=1)
        return [p.tolist() for p in parts]

    w = map_windows(windows, values, x, "_s", "array<array<array<double>>>")
    base = [k for k in windows.columns if k != x]
    return (w.select(*base, F.posexplode_outer("_s").alias("part", "_p")).select(*base, "part", F.posexplode("_p").alias("f", "_q"))
            .select(*base, "part", "f", F.posexplode("_q").alias("frame", "value")))


def node_features(windows: DataFrame, sfreq: float, bands: dict, families: Sequence[str], *, band: tuple | None = None,
                  update: bool = False, keys: Sequence[str] = ("subject_id", "segment_id")) -> DataFrame:
    """SIG14: optional band filter, then log10 band sums, Hjorth and wavelet energies per channel; the ``update`` form uses
    log shares and short Hjorth, z-scored over the channels of a window (sample std)."""
    from . import features as ft

    w = filter_windows(windows, sfreq, *band) if band else windows
    d = ft.hjorth(ft.band_sums(ft.welch_psd(w, sfreq, "one_sec"), bands), guard="zero")
    if not update and "energies" in families:
        d = ft.wavelet_energy(d)
    hj = ["hjorth_mobility", "hjorth_complexity"] if update else ["hjorth_activity", "hjorth_mobility", "hjorth_complexity"]
    cells = {"rbp": F.col("log_share" if update else "log10"), "hjorth": F.array(*hj)}
    if not update:
        cells["energies"] = F.col("energy") if "energies" in families else None
    arr = F.concat(*[cells[f] for f in families if f in cells])
    long = d.select(*keys, "channel", F.posexplode_outer(arr).alias("feature", "value"))
    if update:
        from ..functions.exprs import over, zscore

        long = long.withColumn("value", zscore("value", over([*keys, "feature"]), 1, 1e-8, "add"))
    return long


def prepare(samples: DataFrame, sfreq: float, *, band: tuple | None = (0.5, 45.0), notch: float | None = None,
            reference: str = "none", window_sec: float = 4.0, overlap: float = 0.0, normalize: str = "none",
            min_valid: int = 1, max_windows: int | None = None, seed: int = 0, macro_sec: float | None = None,
            unit: str = "uv", block: int = 65536, short: str = "raise") -> dict[str, DataFrame]:
    """QC04: filter, notch, reference, cut, check amplitudes, drop bad windows, then normalize what is kept, then blocks.

    Quality is judged before normalization. Returns 'windows', 'qc', 'summary' and, with ``macro_sec``, 'macros'.
    """
    s = samples
    if band:
        s = bandpass_recording(s, sfreq, *band, block=block, short=short)
    if notch:
        s = notch_recording(s, sfreq, notch, block=block, short=short)
    s = prj.reference(s, reference)
    w = win.segment_signal(s, sfreq, window_sec=window_sec, overlap=overlap)
    flags = qc.flag_windows(qc.window_metrics(prj.to_microvolts(w, unit)))
    kept, summary = qc.drop_bad_windows(flags, min_valid=min_valid, max_windows=max_windows, seed=seed)
    good = w.join(kept.select("subject_id", "segment_id"), ["subject_id", "segment_id"], "left_semi")
    if normalize == "per_channel":
        from ..functions.exprs import a_mean, a_var, let

        sd = F.sqrt(a_var("x"))
        good = good.withColumn("x", let(F.struct(a_mean("x").alias("m"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("s")),
                                        lambda k: F.transform("x", lambda v: (v - k["m"]) / k["s"])))
    out = {"windows": good, "qc": flags, "summary": summary}
    if macro_sec:
        idx = good.groupBy("subject_id", "segment_id").agg(F.min("start_sample").alias("start_sample"), F.min("end_sample").alias("end_sample"))
        out["macros"] = win.macro_groups(idx, duration=round(macro_sec * sfreq))
    return out
