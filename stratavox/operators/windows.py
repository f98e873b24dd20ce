"""Local-window operators.

Separable filters (boxes, Gaussians) work on blocks with halos, made by one exchange for all axes and sums. Frames are
ranges of coordinates: an even size n covers [-n/2, n/2 - 1]. Borders are mirrored, as often as a frame is longer than the
axis; maxima and minima over truncated frames equal those under mirroring. Operators of a single axis or of next
neighbours are window functions along voxel lines. dims (volume_id, d, h, w) is a row a volume; Spark broadcasts it by its
measured size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import C
from ..sources.store import written
from . import blocks


def frame(size: int) -> tuple[int, int]:
    """Rows before and after the centre."""
    return size // 2, size - 1 - size // 2


def line(axis: str, before: int, after: int, extra: tuple[str, ...] = ()) -> object:
    others = [c for c in C if c != axis]
    return Window.partitionBy(*others, *extra).orderBy(axis).rangeBetween(-before, after)


def mirrored(df: DataFrame, axis: str, before: int, after: int, dims: DataFrame) -> DataFrame:
    """df with its lines mirrored at their ends (d c b a | a b c d | d c b a), again and again as far as the frame reaches."""
    n = F.col("_n")
    turns = F.sequence(-F.ceil(F.lit(max(before, after)) / (2 * n)).cast("int") - 1, F.ceil(F.lit(max(before, after)) / (2 * n)).cast("int") + 1)
    images = F.concat(F.transform(turns, lambda t: F.col(axis) + 2 * n * t), F.transform(turns, lambda t: 2 * n * t - 1 - F.col(axis)))
    near = F.filter(images, lambda i: (i >= -before) & (i < n + after))
    both = df.join(dims.select("volume_id", F.col({"z": "d", "y": "h", "x": "w"}[axis]).alias("_n")), "volume_id")
    return both.withColumn("_at", F.explode(near)).drop(axis).withColumnRenamed("_at", axis)


def halo(size: tuple[int, int, int]) -> tuple:
    """The voxels before and after a box around every voxel, by axis."""
    return tuple(frame(n) for n in size)


def _box(a: np.ndarray, size: tuple[int, int, int]) -> np.ndarray:
    """Sums over a box; the array shrinks by the box less one."""
    for axis, n in enumerate(size):
        a = blocks.summed(a, axis, n)
    return a


def local_contrast_normalize(df: DataFrame, dims: DataFrame, size: tuple[int, int, int] = (3, 20, 20), eps: float = 1e-5, clip: bool = False) -> DataFrame:
    """(v - min) / (max - min + eps) in a box around every voxel, clamped to 0..1 if `clip`."""

    def f(b: blocks.Block) -> dict[str, np.ndarray]:
        lo = hi = b.values
        for axis, n in enumerate(size):
            lo, hi = blocks.slid(lo, axis, n, np.minimum), blocks.slid(hi, axis, n, np.maximum)
        out = (b.inner(b.values) - lo) / (hi - lo + eps)
        return {"value": np.clip(out, 0, 1) if clip else out}

    return blocks.filtered(df, dims, halo(size), f)


def local_normalize_2d(df: DataFrame, dims: DataFrame, w: int = 20, eps: float = 1e-6) -> DataFrame:
    """As above in a slice over a window of 2w - 1, clamped to 0..1."""
    return local_contrast_normalize(df, dims, (1, 2 * w - 1, 2 * w - 1), eps, clip=True)


def local_moments(df: DataFrame, size: tuple[int, int, int], dims: DataFrame) -> DataFrame:
    """(C, value, mean, var): mean and E[x^2] - E[x]^2 over a box with mirrored borders."""
    n = size[0] * size[1] * size[2]

    def f(b: blocks.Block) -> dict[str, np.ndarray]:
        m = _box(b.values, size) / n
        return {"value": b.inner(b.values), "mean": m, "var": _box(b.values * b.values, size) / n - m * m}

    return blocks.filtered(df, dims, halo(size), f, ("value", "mean", "var"))


def local_variance(df: DataFrame, size: tuple[int, int, int], dims: DataFrame) -> DataFrame:
    return local_moments(df, size, dims).select(*C, F.greatest(F.lit(0.0), F.col("var")).alias("value"))


def local_standardize(df: DataFrame, k: int, dims: DataFrame, eps: float = 1e-2) -> DataFrame:
    """(v - m) / (sqrt(max(q - m^2, 0)) + eps): the mean m over (k, k, 3), the mean square q over (2k, 2k, 3), axes z, y, x."""
    wide, near = (2 * k, 2 * k, 3), (k, k, 3)

    def f(b: blocks.Block) -> dict[str, np.ndarray]:
        spare = tuple(slice(w[0] - n[0], v - (w[1] - n[1])) for w, n, v in zip(halo(wide), halo(near), b.values.shape))
        m = _box(b.values[spare], near) / (3 * k * k)
        q = _box(b.values * b.values, wide) / (12 * k * k)
        return {"value": (b.inner(b.values) - m) / (np.sqrt(np.maximum(0, q - m * m)) + eps)}

    return blocks.filtered(df, dims, halo(wide), f)


def enhance_by_variance(edge: DataFrame, win: int, dims: DataFrame) -> DataFrame:
    """(C, value, weight): an edge map weighted by 1 minus its relative local variance (variance over the mean square, in a
    cube of win), scaled to the volume's range."""
    size = (win, win, win)

    def f(b: blocks.Block) -> dict[str, np.ndarray]:
        m, q = _box(b.values, size) / win**3, _box(b.values * b.values, size) / win**3
        return {"value": b.inner(b.values), "rel": (q - m * m) / (q + 1e-6)}

    rel = written(blocks.filtered(edge, dims, halo(size), f, ("value", "rel")), "relative")
    ends = written(rel.groupBy("volume_id").agg(F.min("rel").alias("lo"), F.max("rel").alias("hi")), "ends")
    weight = 1 - (F.col("rel") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-8))
    return rel.join(ends, "volume_id").select(*C, (F.col("value") * weight).alias("value"), weight.alias("weight"))


def mode_filter(labels: DataFrame, classes: list[int], w: int, dims: DataFrame | None = None) -> DataFrame:
    """The most frequent class in a (2w - 1)-square of the slice; ties go to the lowest. With dims, on blocks."""
    if dims is not None:
        names, r = np.sort(np.array(classes)), w - 1

        def f(b: blocks.Block) -> pa.RecordBatch:
            counts = [_box(((b.values == c) & b.present).astype(np.int32), (1, 2 * r + 1, 2 * r + 1)) for c in names]
            best = names[np.argmax(np.stack(counts), axis=0)].astype(np.int32)
            return blocks.voxel_rows(b, {"label": best}, b.inner(b.present))

        rows = labels.select(*C, F.col("label").cast("double").alias("value"))
        return blocks.on_blocks(rows, dims, ((0, 0), (r, r), (r, r)), f, blocks.VOXEL + ", label int", border="missing")
    counts = labels.select(*C, *[(F.col("label") == c).cast("int").alias(f"n{c}") for c in classes])
    for axis in ("y", "x"):
        win = line(axis, w - 1, w - 1)
        counts = counts.select(*C, *[F.sum(f"n{c}").over(win).alias(f"n{c}") for c in classes])
    best = F.greatest(*[F.struct(F.col(f"n{c}").alias("n"), F.lit(-c).alias("c")) for c in classes])
    return counts.select(*C, (-best.c).cast("int").alias("label"))


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights at -r..r, r = int(4 sigma + 0.5)."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_axis(df: DataFrame, axis: str, sigma: float, dims: DataFrame) -> DataFrame:
    """One pass over dense lines with mirrored ends: a weighted sum of each voxel's neighbours on its line, in one window."""
    if sigma <= 0:
        return df
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    wide = mirrored(df.select(*C, "value"), axis, r, r, dims)
    w = Window.partitionBy(*[c for c in C if c != axis]).orderBy(axis)
    total = weights[r] * F.col("value")
    for k in range(1, r + 1):
        total = total + weights[r + k] * (F.lag("value", k).over(w) + F.lead("value", k).over(w))
    return wide.select(*C, "_n", total.alias("value")).where((F.col(axis) >= 0) & (F.col(axis) < F.col("_n"))).select(*C, "value")


def smoothed(v: np.ndarray, sigma: tuple[float, float, float]) -> np.ndarray:
    """A block under Gaussian weights by axis; it uses up its halo."""
    for axis, s in enumerate(sigma):
        if s > 0:
            v = blocks.weighted(v, axis, gaussian_weights(s))
    return v


def gaussian_halo(sigma: tuple[float, float, float]) -> tuple:
    return tuple((int(4 * s + 0.5),) * 2 if s > 0 else (0, 0) for s in sigma)


def gaussian_smooth(df: DataFrame, sigma: tuple[float, float, float], dims: DataFrame) -> DataFrame:
    """Separable Gaussian smoothing with mirrored borders; sigma by (z, y, x)."""
    return blocks.filtered(df, dims, gaussian_halo(sigma), lambda b: {"value": smoothed(b.values, sigma)})


def smooth_and_threshold(df: DataFrame, sigma: tuple[float, float, float], t: float, dims: DataFrame) -> DataFrame:
    return gaussian_smooth(df, sigma, dims).where(F.col("value") > t).select(*C)


def dog_energy(df: DataFrame, s1: float, s2: float, dims: DataFrame) -> DataFrame:
    """|G(s1) - G(s2)| in a slice, divided by its mean over the volume."""
    wide = gaussian_halo((0, max(s1, s2), max(s1, s2)))

    def f(b: blocks.Block) -> dict[str, np.ndarray]:
        parts = []
        for s in (s1, s2):
            spare = tuple(slice(w - n, v - w + n) for (w, _), (n, _), v in zip(wide, gaussian_halo((0, s, s)), b.values.shape))
            parts.append(smoothed(b.values[spare], (0, s, s)))
        return {"value": np.abs(parts[0] - parts[1])}

    return _over_mean(blocks.filtered(df, dims, wide, f))


def _over_mean(df: DataFrame) -> DataFrame:
    df = written(df, "energy")
    mean = written(df.groupBy("volume_id").agg(F.avg("value").alias("m")), "means")
    return df.join(mean, "volume_id").select(*C, F.coalesce(F.try_divide(F.col("value"), F.col("m")), F.lit(0.0)).alias("value"))


def second_differences(df: DataFrame) -> DataFrame:
    """(C, value, yy, xx, yx) of a slice by central differences, borders repeated."""
    wy, wx = Window.partitionBy("volume_id", "z", "x").orderBy("y"), Window.partitionBy("volume_id", "z", "y").orderBy("x")
    v = F.col("value")
    near = lambda fn, c, w: F.coalesce(fn(c).over(w), F.col(c))
    out = df.select(*C, "value", (near(F.lag, "value", wy) + near(F.lead, "value", wy) - 2 * v).alias("yy"), (near(F.lag, "value", wx) + near(F.lead, "value", wx) - 2 * v).alias("xx"), ((near(F.lead, "value", wy) - near(F.lag, "value", wy)) / 2).alias("dy"))
    return out.select(*C, "value", "yy", "xx", ((near(F.lead, "dy", wx) - near(F.lag, "dy", wx)) / 2).alias("yx"))


def log_energy(df: DataFrame, sigma: float, dims: DataFrame) -> DataFrame:
    """|Laplacian of the smoothed slice|, divided by its mean over the volume."""
    d = second_differences(gaussian_smooth(df, (0, sigma, sigma), dims))
    return _over_mean(d.select(*C, F.abs(F.col("yy") + F.col("xx")).alias("value")))


def hessian_response(df: DataFrame, beta: float = 0.5, c: float = 15.0) -> DataFrame:
    """(C, l1, l2, line): eigenvalues of a slice's second differences by magnitude, and a line response."""
    d = second_differences(df)
    half = (F.col("yy") + F.col("xx")) / 2
    root = F.sqrt(((F.col("yy") - F.col("xx")) / 2) ** 2 + F.col("yx") ** 2)
    d = d.select(*C, (half + root).alias("a"), (half - root).alias("b"))
    swap = F.abs(F.col("a")) > F.abs(F.col("b"))
    d = d.select(*C, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("l1"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("l2"))
    ratio = F.abs(F.col("l1")) / (F.abs(F.col("l2")) + F.lit(1e-12))
    s2 = F.col("l1") ** 2 + F.col("l2") ** 2
    line_of = F.exp(-(ratio**2) / (2 * beta * beta)) * (1 - F.exp(-s2 / (2 * c * c)))
    return d.select(*C, "l1", "l2", line_of.alias("line"))


def gradient_magnitude(df: DataFrame, kind: str = "central") -> DataFrame:
    """Of a slice: central differences (one-sided at borders), or Sobel sums with repeated borders."""
    wy, wx = Window.partitionBy("volume_id", "z", "x").orderBy("y"), Window.partitionBy("volume_id", "z", "y").orderBy("x")
    near = lambda fn, c, w: F.coalesce(fn(c).over(w), F.col(c))
    if kind == "central":
        diff = lambda w: (near(F.lead, "value", w) - near(F.lag, "value", w)) / (F.when(F.lead("value").over(w).isNull() | F.lag("value").over(w).isNull(), 1.0).otherwise(2.0))
        both = df.select(*C, diff(wy).alias("gy"), diff(wx).alias("gx"))
    else:
        smooth = lambda c, w: near(F.lag, c, w) + 2 * F.col(c) + near(F.lead, c, w)
        step = lambda c, w: near(F.lead, c, w) - near(F.lag, c, w)
        both = df.select(*C, smooth("value", wx).alias("sx"), smooth("value", wy).alias("sy"))
        both = both.select(*C, step("sx", wy).alias("gy"), step("sy", wx).alias("gx"))
    return both.select(*C, F.sqrt(F.col("gy") ** 2 + F.col("gx") ** 2).alias("value"))
