"""Pixel-wise normalisation, thresholds, padding, resampling and augmentation.

Statistics are one partially aggregated row a volume, written and joined back, so that Spark knows their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import scrub
from ..sources.derived import C, grid
from ..sources.store import written
from . import blocks


def binarize(df: DataFrame, thr: float = 0.0) -> DataFrame:
    return df.where(F.col("value") > thr).select(*C)


fixed_threshold = binarize


def _with_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    return df.join(written(df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), "stats"), by)


def _ranks_below(rows: DataFrame, ranks: DataFrame, by: list[str], part: Column) -> DataFrame:
    """For each rank, the part of its range [lo, hi] that it lies in: its number of values m, and its first and last one.

    Values under lo count as one part ahead of the others.
    """
    spans = ranks.select(*by, "lo", "hi").distinct()
    counts = rows.join(spans, by).where(F.col("v") <= F.col("hi"))
    counts = counts.withColumn("part", F.when(F.col("v") >= F.col("lo"), part)).groupBy(*by, "lo", "hi", "part").agg(F.count("*").alias("m"), F.min("v").alias("first"), F.max("v").alias("last"))
    before = Window.partitionBy(*by, "lo", "hi").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).where("part is not null")
    both = ranks.join(counts, [*by, "lo", "hi"]).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("m")))
    return both.select(*by, "q", "at", "k", "m", "first", "last")


def quantiles(df: DataFrame, by: list[str], col: str, qs: dict[str, float], bins: int = 4096, rest: int = 200_000, accuracy: int = 10_000) -> DataFrame:
    """(by, a column for each of qs): exact quantiles with linear interpolation, null and NaN left out.

    A first pass keeps a mergeable sketch of each group, which brackets every wanted rank by 4 / accuracy of the values;
    a second one counts the values below and the distinct ones within. Groups of up to `rest` values need no bracket; where
    a bracket holds more, passes count its values in `bins` parts first. All counts are aggregated partially, so no group
    is held anywhere whatever its size.
    """
    rows = df.select(*by, F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    wide = 4.0 / accuracy
    ends = [min(1.0, max(0.0, q + s * wide)) for q in qs.values() for s in (-1, 1)]
    sketch = F.percentile_approx("v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("s")
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), (F.lit(q) * (F.col("n") - 1)).alias("at"), F.col("s")[2 * i].alias("lo"), F.col("s")[2 * i + 1].alias("hi")) for i, (name, q) in enumerate(qs.items())]))
    ranks = groups.withColumn("w", wanted).select("*", "w.q", "w.at", "w.lo", "w.hi").withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    few = F.col("n") <= rest
    ranks = ranks.select(*by, "q", "at", "k", "n", "least", "most", F.when(few, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(few, F.col("most")).otherwise(F.col("hi")).alias("hi"))
    ranks = written(ranks.withColumn("inside", F.when(few, F.col("n")).otherwise(F.ceil(F.col("n") * F.lit(3 * wide)))), "ranks")
    part = F.when(F.col("lo") < F.col("hi"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")).otherwise(0)
    for sure in (False, True):
        for _ in range(12):
            if not ranks.where((F.col("inside") > rest) & (F.col("lo") < F.col("hi"))).head(1):
                break
            near = _ranks_below(rows, ranks, by, part)
            ranks = written(near.select(*by, "q", "at", "k", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("m").alias("inside")), "ranks")
        found = _ranks_below(rows, ranks, by, F.col("v"))
        low, high = F.min_by("first", "k"), F.max_by("first", "k")
        cut = found.groupBy(*by, "q").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("cut"), F.count("*").alias("found"))
        out = written(cut.groupBy(*by).agg(*[F.max(F.when(F.col("q") == name, F.col("cut"))).alias(name) for name in qs], F.sum("found").alias("found")), "quantiles")
        if sure or out.agg(F.sum("found")).first()[0] == (ranks.count() or None):
            break
        # a rank outside of its bracket: begin with the whole range
        whole = groups.withColumn("w", wanted).select("*", "w.q", "w.at").withColumn("k", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        ranks = written(whole.select(*by, "q", "at", "k", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("inside")), "ranks")
    return out.drop("found")


def minmax_normalize(df: DataFrame) -> DataFrame:
    """(v - min) / (max - min) by volume, ignoring NaN; NaN and constant volumes become 0."""
    v = F.when(~F.isnan("value"), F.col("value"))
    both = _with_stats(df, ["volume_id"], lo=F.min(v), hi=F.max(v))
    return both.select(*C, F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("value"))


def percentile_threshold(df: DataFrame, q: float = 0.9, floor: float = 0.5, by: tuple[str, ...] = ("volume_id",), col: str = "value") -> DataFrame:
    """Voxels with value >= max(q-quantile, floor); the quantile interpolates linearly."""
    both = df.join(quantiles(df, list(by), col, {"cut": q}), list(by))
    keys = [*[b for b in by if b not in C], *C]
    return both.where(F.col(col) >= F.greatest(F.col("cut"), F.lit(floor))).select(*keys)


def percentile_binarize(df: DataFrame, q: float, by: tuple[str, ...] = ("volume_id", "z"), below: bool = False) -> DataFrame:
    """value >= the group's q-quantile (or <= it) as 0/1."""
    both = df.join(quantiles(df, list(by), "value", {"cut": q}), list(by))
    test = F.col("value") <= F.col("cut") if below else F.col("value") >= F.col("cut")
    return both.select(*C, test.cast("int").alias("value"))


def clip_normalize(df: DataFrame, q: float = 0.995, by: tuple[str, ...] = ("volume_id", "z")) -> DataFrame:
    """Clip to the (1-q, q) quantiles and scale to 0..1; NaN and infinities are 0, flat groups 0."""
    clean = df.select(*C, scrub(F.col("value")).alias("value"))
    both = clean.join(quantiles(clean, list(by), "value", {"lo": 1 - q, "hi": q}), list(by))
    v = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("value")))
    return both.select(*C, F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("value"))


def zscore(df: DataFrame, by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    both = _with_stats(df, list(by), m=F.avg("value"), s=F.stddev_pop("value"))
    return both.select(*C, F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("s")), F.lit(0.0)).alias("value"))


def pad_to_multiple(df: DataFrame, dims: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """Zeros around height and width to multiples of m, the odd one at the bottom or right; (rows, padded dims with top, left)."""
    up = lambda n: (F.ceil(F.col(n) / m) * m).cast("int")
    sizes = dims.select("volume_id", "d", F.col("h").alias("h0"), F.col("w").alias("w0"), up("h").alias("h"), up("w").alias("w"))
    half = lambda a, b: F.floor((F.col(a) - F.col(b)) / 2).cast("int")
    sizes = sizes.withColumn("top", half("h", "h0")).withColumn("left", half("w", "w0"))
    moved = df.join(sizes, "volume_id").select("volume_id", "z", (F.col("y") + F.col("top")).alias("y"), (F.col("x") + F.col("left")).alias("x"), "value")
    return grid(sizes).join(moved, C, "left").select(*C, F.coalesce("value", F.lit(0.0)).alias("value")), sizes


def unpad(df: DataFrame, padded: DataFrame) -> DataFrame:
    back = df.join(padded, "volume_id").select("volume_id", "z", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left")).alias("x"), "value", "h0", "w0")
    return back.where("y >= 0 and y < h0 and x >= 0 and x < w0").select(*C, "value")


def _tile(f: int) -> list[Column]:
    return [F.col("volume_id"), F.col("z"), F.expr(f"cast(y div {f} as int)").alias("y"), F.expr(f"cast(x div {f} as int)").alias("x")]


def downsample_mean(df: DataFrame, f: int) -> DataFrame:
    """Means of f x f blocks of a slice; what lacks in border blocks counts as 0."""
    return df.groupBy(*_tile(f)).agg((F.sum("value") / F.lit(f * f)).alias("value"))


def downsample_max(mask: DataFrame, f: int) -> DataFrame:
    return mask.select(*_tile(f)).distinct()


def labelled_slices(mask: DataFrame) -> DataFrame:
    """(volume_id, z, n): slices that hold any label."""
    return mask.groupBy("volume_id", "z").agg(F.count("*").alias("n"))


def crop(df: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Voxels of the half-open box, with coordinates from its corner."""
    keep = df
    for a, (lo, hi) in zip("zyx", (z, y, x)):
        keep = keep.where((F.col(a) >= lo) & (F.col(a) < hi))
    moved = [(F.col(a) - lo).alias(a) for a, (lo, _) in zip("zyx", (z, y, x))]
    return keep.select("volume_id", *moved, *[c for c in df.columns if c not in C])


def apply_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """The value inside the mask, 0 outside."""
    one = mask.select(*C).distinct().withColumn("one", F.lit(True))
    return df.join(one, C, "left").select(*C, F.when(F.col("one"), F.col("value")).otherwise(0.0).alias("value"))


def value_bins(df: DataFrame, n: int) -> DataFrame:
    """(C, bin 1..n): equal-width bins (lo, hi] of a volume's range; the minimum falls in none."""
    both = _with_stats(df, ["volume_id"], lo=F.min("value"), hi=F.max("value")).where("value > lo")
    b = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil((F.col("value") - F.col("lo")) * n / (F.col("hi") - F.col("lo")))))
    return both.select(*C, b.cast("int").alias("bin"))


def resample_z_linear(df: DataFrame, factor: int) -> DataFrame:
    """factor rows for each slice gap, linear between slices; z' / factor is the old position."""
    line = Window.partitionBy("volume_id", "y", "x").orderBy("z")
    both = df.withColumn("next", F.lead("value").over(line))
    steps = F.when(F.col("next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    both = both.withColumn("k", F.explode(steps))
    v = F.when(F.col("k") == 0, F.col("value")).otherwise(F.col("value") + (F.col("next") - F.col("value")) * F.col("k") / factor)
    return both.select("volume_id", (F.col("z") * factor + F.col("k")).cast("int").alias("z"), "y", "x", v.alias("value"))


def _bends(v: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic splines through the columns of v, by one elimination down the rows."""
    n = len(v)
    c = np.zeros(v.shape)
    if n < 3:
        return c
    c[1:-1] = 6 * (v[2:] - 2 * v[1:-1] + v[:-2])
    share = np.zeros(n)
    for k in range(1, n - 1):
        share[k] = 1 / (4 - share[k - 1])
        c[k] = (c[k] - c[k - 1]) * share[k]
    for k in range(n - 3, 0, -1):
        c[k] -= share[k] * c[k + 1]
    return c


def _between(v: np.ndarray, t: np.ndarray, i: np.ndarray, order: int) -> np.ndarray:
    """Columns of v at the places t, each in the gap after row i."""
    j = np.minimum(i + 1, len(v) - 1)
    u = (t - i)[:, None]
    w = 1 - u
    out = w * v[i] + u * v[j]
    if order == 3:
        c = _bends(v)
        out += ((w**3 - w) * c[i] + (u**3 - u) * c[j]) / 6
    return out


def resampled(v: np.ndarray, factor: float, order: int = 3) -> np.ndarray:
    """Columns of v (n, m) at round(n * factor) even positions from the first row to the last: natural cubic splines, or
    linear for order 1."""
    n, m = len(v), max(1, round(len(v) * factor))
    t = np.linspace(0, n - 1, m)
    return _between(v, t, np.clip(t.astype(int), 0, max(0, n - 2)), order)


#: Slices before and after a block that its splines take in: a value's part in a spline falls by 2 - sqrt(3) a slice, to
#: under 10^-22 here, beyond the digits of a double.
BENT = 40


def resample_z(df: DataFrame, factor: float, order: int = 3, dims: DataFrame | None = None) -> DataFrame:
    """Resample dense volumes along z: cubic splines, or linear for order 1.

    A task holds blocks of slices with BENT more on both sides, so volumes may be of any depth. dims: where volumes begin at
    0; else they begin at their least coordinates, and z is counted from there.
    """
    if dims is None:
        low = [F.min(a).alias(f"{a}0") for a in "zyx"]
        ends = written(df.groupBy("volume_id").agg(*low, *[(F.max(a) - F.min(a) + 1).cast("int").alias(n) for a, n in zip("zyx", "dhw")]), "ends")
        moved = df.join(ends, "volume_id").select("volume_id", *[(F.col(a) - F.col(f"{a}0")).cast("int").alias(a) for a in "zyx"], "value")
        out = resample_z(moved, factor, order, ends.select("volume_id", "d", "h", "w")).join(ends, "volume_id")
        return out.select("volume_id", "z", *[(F.col(a) + F.col(f"{a}0")).cast("int").alias(a) for a in "yx"], "value")
    wide = BENT if order == 3 else 1

    def f(b: blocks.Block) -> pa.RecordBatch | None:
        n, first, own = b.dims[0], b.origin[0], b.shape[0]
        lo, hi = max(0, first - wide), min(n, first + own + wide)
        some = slice(lo - first + wide, hi - first + wide)
        if not b.present[some].all():
            raise ValueError(f"volume {b.volume_id} lacks voxels: resampling needs dense volumes")
        m = max(1, round(n * factor))
        step = (n - 1) / (m - 1) if m > 1 else 0.0
        # as linspace gives them
        at = np.arange(m) if step == 0 else np.arange(max(0, int(first / step) - 2), min(m, int((first + own) / step) + 3))
        t = np.where((at == m - 1) & (m > 1), float(n - 1), at * step)
        i = np.clip(t.astype(int), 0, max(0, n - 2))
        mine = (i >= first) & (i < first + own)
        at, t, i = at[mine], t[mine], i[mine]
        if not len(at):
            return None
        v = _between(b.values[some].reshape(hi - lo, -1), t - lo, i - lo, order).reshape(-1)
        z, y, x = (c.reshape(-1).astype(np.int32) for c in np.indices((len(at), *b.shape[1:])))
        volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(v), np.int64)))
        return pa.RecordBatch.from_arrays([volume, pa.array(at.astype(np.int32)[z]), pa.array(y + np.int32(b.origin[1])), pa.array(x + np.int32(b.origin[2])), pa.array(v)], [*C, "value"])

    return blocks.on_blocks(df.select(*C, "value"), dims, ((wide, wide), (0, 0), (0, 0)), f, blocks.VOXEL + ", value double", size=(128, 64, 64), border="missing")


def augment_patches(rows: DataFrame, ph: int, pw: int, choice: Column) -> DataFrame:
    """Rows (patch_id, py, px, ...) of square patches under one drawn symmetry a patch, the same for every layer.

    choice: 0..7 from the patch: bit 0 flips rows, bit 1 flips columns, bit 2 transposes.
    """
    y = F.when(choice.bitwiseAND(1) == 1, F.lit(ph - 1) - F.col("py")).otherwise(F.col("py"))
    x = F.when(choice.bitwiseAND(2) == 2, F.lit(pw - 1) - F.col("px")).otherwise(F.col("px"))
    turned = choice.bitwiseAND(4) == 4
    rest = [c for c in rows.columns if c not in ("py", "px")]
    return rows.select(*rest, F.when(turned, x).otherwise(y).alias("py"), F.when(turned, y).otherwise(x).alias("px"))


def seeded_choice(key: str, seed: int) -> Column:
    """0..7 from plain integer arithmetic on an id, alike in any engine."""
    return ((F.col(key) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296) % 8).cast("int")
