"""Feature maps of slices and their slab statistics, and distances to masks.

A slice's maps are one NumPy call; a task holds a few slices with the margins of their slabs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import C
from . import blocks
from .windows import gaussian_weights

SIGMAS = (3, 5, 7)
#: Maps of feature_maps, in order.
MAPS = ["mean", "gradient", "variance", *[f"{k}{s}" for s in SIGMAS for k in ("gauss", "line", "log")], "band", "high", "low", "wiener1", "wiener3", "wiener5"]


def _mirror(v: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.pad(v, ((a, b), (a, b)), mode="symmetric")


def box_mean(v: np.ndarray, k: int) -> np.ndarray:
    a, b = k // 2, k - 1 - k // 2
    s = np.pad(np.cumsum(np.cumsum(_mirror(v, a, b), 0), 1), ((1, 0), (1, 0)))
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def _convolved(v: np.ndarray, by_row: np.ndarray, by_col: np.ndarray) -> np.ndarray:
    """v with mirrored ends under a kernel down the rows and one along the columns."""
    for axis, w in ((0, by_row), (1, by_col)):
        r = len(w) // 2
        wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        v = np.lib.stride_tricks.sliding_window_view(wide, len(w), axis) @ w
    return v


def gauss(v: np.ndarray, sigma: float) -> np.ndarray:
    w = np.array(gaussian_weights(sigma))
    return _convolved(v, w, w)


def laplace(v: np.ndarray, sigma: float) -> np.ndarray:
    """Laplacian of Gaussian: the second derivative of the kernel along each axis."""
    w = np.array(gaussian_weights(sigma))
    x = np.arange(len(w)) - len(w) // 2
    bent = (x * x / sigma**4 - 1 / sigma**2) * w
    return _convolved(v, bent, w) + _convolved(v, w, bent)


def second(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.pad(v, 1, mode="edge")
    yy = p[2:, 1:-1] + p[:-2, 1:-1] - 2 * v
    xx = p[1:-1, 2:] + p[1:-1, :-2] - 2 * v
    yx = (p[2:, 2:] - p[2:, :-2] - p[:-2, 2:] + p[:-2, :-2]) / 4
    return yy, xx, yx


def radial(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """Frequencies with radius in [low, high] of the centred spectrum."""
    h, w = v.shape
    y, x = np.ogrid[:h, :w]
    r = np.hypot(y - h // 2, x - w // 2)
    return np.real(np.fft.ifft2(np.fft.ifftshift(np.fft.fftshift(np.fft.fft2(v)) * ((r >= low) & (r <= high)))))


def wiener(v: np.ndarray, k: int) -> np.ndarray:
    """Wiener filter over k x k windows with zeros outside; what is not finite becomes 0 (all of it for k = 1)."""
    mean = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(a, k // 2), (k, k)).mean((2, 3))
    m = mean(v)
    var = mean(v * v) - m * m if k > 1 else np.zeros_like(v)
    noise = var.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(var < noise, m, m + (v - m) * (1 - noise / var))
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def line_response(v: np.ndarray, beta: float = 0.5, c: float = 15.0) -> np.ndarray:
    """How line-like the second differences of a smoothed slice are."""
    yy, xx, yx = second(v)
    half, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
    a, b = half + root, half - root
    l1, l2 = np.where(np.abs(a) > np.abs(b), b, a), np.where(np.abs(a) > np.abs(b), a, b)
    ratio = np.abs(l1) / (np.abs(l2) + 1e-12)
    return np.exp(-(ratio**2) / (2 * beta**2)) * (1 - np.exp(-(l1**2 + l2**2) / (2 * c**2)))


def feature_maps(v: np.ndarray) -> np.ndarray:
    """MAPS of a slice, stacked first."""
    h = v.shape[0]
    m = box_mean(v, 5)
    gy, gx = np.gradient(v) if min(v.shape) > 1 else (np.zeros_like(v), np.zeros_like(v))
    maps = [m, np.hypot(gy, gx), box_mean(v * v, 5) - m * m]
    for s in SIGMAS:
        smooth = gauss(v, s)
        maps += [smooth, line_response(smooth), laplace(v, s)]
    maps += [radial(v, h // 16, h // 6), radial(v, h // 8, np.inf), radial(v, 0, h // 8)]
    return np.nan_to_num(np.stack(maps + [wiener(v, k) for k in (1, 3, 5)]), nan=0.0, posinf=0.0, neginf=0.0)


def feature_bank(df: DataFrame, dims: DataFrame, thickness: int = 2, slices: int = 8) -> DataFrame:
    """(C, f): mean and variance of each map over the slab z - thickness .. z + thickness; zeros in the margin slices.

    A task holds `slices` whole slices (their spectra need them) and the slab's margins, whose maps it computes again, so
    that voxels are exchanged once and maps never are. Slices must be dense.
    """
    t, n = thickness, 2 * thickness + 1

    def f(b: blocks.Block) -> pa.RecordBatch:
        out = np.zeros((*b.shape, 2 * len(MAPS)), np.float32)
        maps: dict[int, np.ndarray] = {}
        for k in range(b.shape[0]):
            z = b.origin[0] + k
            if t <= z < b.dims[0] - t:
                maps = {j: maps[j] if j in maps else feature_maps(b.values[j]).astype(np.float32).astype(float) for j in range(k, k + n)}
                mean = sum(maps.values()) / n
                square = sum(m * m for m in maps.values()) / n
                out[k] = np.concatenate([mean, np.maximum(0, square - mean * mean)]).transpose(1, 2, 0)
        return blocks.voxel_rows(b, {"f": out}, b.present[t : t + b.shape[0]])

    return blocks.on_blocks(df, dims, ((t, t), (0, 0), (0, 0)), f, blocks.VOXEL + ", f array<float>", size=(slices, blocks.WHOLE, blocks.WHOLE))


def z_aggregate(df: DataFrame, thickness: int, kind: str = "mean") -> DataFrame:
    """The slab's centre, mean or Gaussian mean (sigma thickness / 2) at every slice that has its whole slab; and its variance."""
    n = 2 * thickness + 1
    if kind == "center":
        weights = [0.0] * thickness + [1.0] + [0.0] * thickness
    elif kind == "gaussian":
        raw = [float(np.exp(-0.5 * (k / max(thickness / 2, 1e-6)) ** 2)) for k in range(-thickness, thickness + 1)]
        weights = [r / sum(raw) for r in raw]
    else:
        weights = [1.0 / n] * n
    taps = F.array(*[F.struct(F.lit(k - thickness).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    rows = df.withColumn("t", F.explode(taps)).select("volume_id", (F.col("z") - F.col("t.k")).cast("int").alias("z"), "y", "x", "value", F.col("t.w").alias("w"))
    out = rows.groupBy(*C).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("value")).alias("value"), F.var_pop("value").alias("variance"))
    return out.where(F.col("n") == n).select(*C, "value", "variance")


def slice_features_v1(df: DataFrame, dims: DataFrame, thickness: int = 2, kind: str = "mean", sigma: float = 2.0) -> DataFrame:
    """(C, agg, variance, dog, s1, s2, h1, h2, trace, det): the earlier bank on the slab aggregate.

    s: structure tensor eigenvalues, h: Hessian eigenvalues, trace and det of the Hessian.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], ignore_index=True)
        h, w = int(f["y"].max()) + 1, int(f["x"].max()) + 1
        v = f["value"].to_numpy(float).reshape(h, w)
        eig = lambda a, b, c: ((a + c) / 2 + np.sqrt(((a - c) / 2) ** 2 + b * b), (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b))
        gy, gx = np.gradient(v)
        s1, s2 = eig(gauss(gy * gy, sigma), gauss(gy * gx, sigma), gauss(gx * gx, sigma))
        yy, xx, yx = second(gauss(v, sigma))
        h1, h2 = eig(yy, yx, xx)
        maps = {"dog": gauss(v, sigma) - gauss(v, 1.6 * sigma), "s1": s1, "s2": s2, "h1": h1, "h2": h2, "trace": yy + xx, "det": yy * xx - yx * yx}
        return f[[*C]].assign(agg=f["value"], variance=f["variance"], **{k: m.reshape(-1) for k, m in maps.items()})

    cols = ["agg", "variance", "dog", "s1", "s2", "h1", "h2", "trace", "det"]
    return z_aggregate(df, thickness, kind).groupBy("volume_id", "z").applyInPandas(run, "volume_id string, z int, y int, x int, " + ", ".join(f"{c} double" for c in cols))


def line_distances(f: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + f[j]: the lower envelope of parabolas, in linear time; infinities allowed."""
    n = len(f)
    ok = np.flatnonzero(np.isfinite(f))
    if not len(ok):
        return np.full(n, np.inf)
    at, cut = [int(ok[0])], [-np.inf]
    for q in ok[1:].tolist():
        while True:
            p = at[-1]
            s = ((f[q] + q * q) - (f[p] + p * p)) / (2 * (q - p))
            if s > cut[-1]:
                break
            at.pop()
            cut.pop()
        at.append(q)
        cut.append(s)
    k = np.searchsorted(np.array(cut), np.arange(n), "left") - 1
    j = np.array(at)[np.maximum(k, 0)]
    return (np.arange(n) - j) ** 2 + f[j]


#: Lines up to this length are searched whole, many at once.
SHORT = 64


def lines_distances(v: np.ndarray) -> np.ndarray:
    """line_distances along the last axis."""
    n = v.shape[-1]
    flat = np.ascontiguousarray(v).reshape(-1, n)
    if n > SHORT:
        return np.stack([line_distances(f) for f in flat]).reshape(v.shape) if len(flat) else v
    out = np.full(flat.shape, np.inf)
    i = np.arange(n)
    for j in range(n):
        np.minimum(out, flat[:, j : j + 1] + (i - j) ** 2, out=out)
    return out.reshape(v.shape)


def distance_map(mask: DataFrame, dims: DataFrame, inside: bool = False) -> DataFrame:
    """(C, value): exact Euclidean distance of every voxel to the mask, or from the mask's voxels to what lies outside.

    Three passes over lines: two within a slice, one across slices for a few lines at a time; without any target, null.
    """
    from ..sources.volumes import to_dense

    target = 0 if inside else 1

    def within(b: blocks.Block) -> pa.RecordBatch:
        v = lines_distances(np.where(b.present & (b.values == target), 0.0, np.inf))
        return blocks.voxel_rows(b, {"value": np.moveaxis(lines_distances(np.moveaxis(v, 1, 2)), 1, 2)}, b.present)

    def across(b: blocks.Block) -> pa.RecordBatch:
        v = np.where(b.present, b.values, np.inf)
        return blocks.voxel_rows(b, {"value": np.moveaxis(lines_distances(np.moveaxis(v, 0, 2)), 2, 0)}, b.present)

    none, schema = ((0, 0),) * 3, blocks.VOXEL + ", value double"
    df = blocks.on_blocks(to_dense(mask, dims), dims, none, within, schema, size=(4, blocks.WHOLE, blocks.WHOLE), border="missing")
    df = blocks.on_blocks(df, dims, none, across, schema, size=(blocks.WHOLE, 2, 8), border="missing")
    d = F.when(F.col("value") != float("inf"), F.sqrt("value"))
    return df.select(*C, d.alias("value"))


def distance_weight(df: DataFrame, radius: float = 30.0, mode: str = "sigmoid") -> DataFrame:
    """Soft-negative weights of distances, a tenth at most; no distance (no mask) counts as saturated."""
    d = F.coalesce(F.col("value"), F.lit(1e9))
    if mode == "linear":
        w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / radius))
    elif mode == "gaussian":
        w = 1 - F.exp(-(d * d) / (2 * radius * radius))
    elif mode == "sigmoid":
        w = F.greatest(F.lit(0.0), 1 / (1 + F.exp(-(d - radius) / (radius / 6))) - 0.01)
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.select(*C, (0.1 * w).alias("value"))
