"""Zero-phase Butterworth filters over blocks of a trace with a margin on both sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, low: float, high: float | None, rate: float) -> np.ndarray:
    """Second-order sections of a band-pass (a high-pass if high reaches half the rate), by bilinear transform."""
    theta = np.pi * (2 * np.arange(order) + 1) / (2 * order) + np.pi / 2
    proto = np.exp(1j * theta)
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if high is None or high >= rate / 2:
        w = warp(low)
        poles, zeros, gain = w / proto, np.zeros(order), np.real(1 / np.prod(-proto))
    else:
        w0, band = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = proto * band / 2
        root = np.sqrt(half**2 - w0**2)
        poles, zeros, gain = np.r_[half + root, half - root], np.zeros(order), band**order
    fs = 2 * rate
    zd, pd_ = (fs + zeros) / (fs - zeros), (fs + poles) / (fs - poles)
    gain = np.real(gain * np.prod(fs - zeros) / np.prod(fs - poles))
    zd = np.r_[zd, -np.ones(len(pd_) - len(zd))]
    # Pairs of conjugate poles, the closest to the circle last; real ones together.
    up = sorted(pd_[pd_.imag > 1e-12], key=lambda p: abs(1 - abs(p)), reverse=True)
    real = np.sort(pd_[np.abs(pd_.imag) <= 1e-12].real)
    pairs = [(p, np.conj(p)) for p in up]
    pairs = [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)] + pairs
    single = [(real[-1],)] if len(real) % 2 else []
    z = sorted(zd.real, reverse=True)
    out = []
    for p in [*single, *pairs]:
        # One zero at 1 with one at -1 where there are both.
        take = [z.pop(0), z.pop(-1)] if len(p) == 2 and len(z) > 1 else [z.pop(0)]
        b, a = np.real(np.poly(take)), np.real(np.poly(p))
        out.append([*b, *np.zeros(3 - len(b)), *a, *np.zeros(3 - len(a))])
    out = np.array(out)
    out[0, :3] *= gain
    return out


def _pass(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One direction, all channels (rows) at a time."""
    for b0, b1, b2, _, a1, a2 in sos:
        y = np.empty_like(x)
        z1, z2 = np.zeros(len(x)), np.zeros(len(x))
        for k in range(x.shape[1]):
            v = x[:, k]
            y[:, k] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[:, k] + z2, b2 * v - a2 * y[:, k]
        x = y
    return x


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int = 60) -> np.ndarray:
    """Forward and backward over odd extensions of both ends."""
    pad = min(pad, x.shape[1] - 1)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1) if pad > 0 else x
    out = _pass(sos, _pass(sos, wide)[:, ::-1])[:, ::-1]
    return out[:, pad : out.shape[1] - pad] if pad > 0 else out


def band_passed(trace: DataFrame, rate: float, low: float = 300.0, high: float | None = 6000.0, order: int = 5, width: int = 20_000, margin: int = 100) -> DataFrame:
    """chan, frame, v filtered block by block; each block sees ``margin`` frames beyond its ends."""
    sos = butterworth(order, low, high, rate)
    block = F.floor(F.col("frame") / width)
    near = F.array_distinct(F.array(block, F.floor((F.col("frame") - margin) / width), F.floor((F.col("frame") + margin) / width)))
    rows = trace.select("chan", "frame", "v", F.explode(near).alias("block")).where("block >= 0")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        k = p["block"].iloc[0]
        v = zero_phase(sos, p["v"].to_numpy(float)[None, :])[0] if len(p) > 1 else p["v"].to_numpy(float)
        out = pd.DataFrame({"chan": p["chan"], "frame": p["frame"], "v": v})
        return out[(out["frame"] >= k * width) & (out["frame"] < (k + 1) * width)]

    return rows.groupBy("chan", "block").applyInPandas(run, f"chan {dict(trace.dtypes)['chan']}, frame long, v double")
