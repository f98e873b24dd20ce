"""Measurements of labelled regions: sizes, moments, perimeters, Euler numbers, hulls, surfaces.

Tables are (volume_id, label, ...) from labels (volume_id, z, y, x, label). Everything but the convex hull is sums over
a region's voxels, so a region of any size is aggregated partially where its rows are. The hull works on the first
and last voxel of each row of a region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.derived import C
from ..sources.store import written
from . import blocks

R = ["volume_id", "label"]


def region_basics(labels: DataFrame) -> DataFrame:
    """size, the half-open bounding box, extent (share of the box) and the box's longest side over its shortest.

    Slice regions (one z) compare their two in-plane sides.
    """
    ends = [f(a).alias(f"{a}{k}") for a in "zyx" for f, k in ((F.min, 0), (F.max, 1))]
    out = labels.groupBy(*R).agg(F.count("*").alias("size"), *ends)
    side = {a: F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in "zyx"}
    flat = side["z"] == 1
    longest = F.greatest(side["y"], side["x"], side["z"])
    shortest = F.when(flat, F.least(side["y"], side["x"])).otherwise(F.least(side["y"], side["x"], side["z"]))
    box = [F.col(f"{a}0") for a in "zyx"] + [(F.col(f"{a}1") + 1).alias(f"{a}1") for a in "zyx"]
    return out.select(*R, "size", *box, (F.col("size") / (side["z"] * side["y"] * side["x"])).alias("extent"), (longest / shortest).alias("bbox_aspect"))


#: Exact whole numbers of up to 38 digits.
WHOLE = "decimal(38,0)"


def integer_moments(labels: DataFrame) -> DataFrame:
    """n, the centroid (cy, cx) and the central sums of powers of y and x of slice regions as whole numbers: k20, k11, k02
    are n times, k30, k21, k12, k03 n * n times the sums.

    Powers are summed exactly, so results depend on neither order nor partitioning; the digits suffice for regions of
    some 10^8 pixels of slices of up to 10^6 a side, beyond which Spark raises an overflow.
    """
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    powers = [(p, q) for p in range(4) for q in range(4) if 1 <= p + q <= 3]
    product = lambda p, q: F.lit(1).cast("long") if p + q == 0 else (y * product(p - 1, q) if p else x * product(p, q - 1))
    sums = [F.sum(product(p, q).cast("decimal(20,0)")).cast(WHOLE).alias(f"t{p}{q}") for p, q in powers]
    m = labels.groupBy(*R).agg(F.count("*").alias("n"), F.min("y").cast(WHOLE).alias("y0"), F.min("x").cast(WHOLE).alias("x0"), *sums)
    m = m.withColumn("t00", F.col("n").cast(WHOLE))
    times = lambda *factors: factors[0] if len(factors) == 1 else (factors[0] * times(*factors[1:])).cast(WHOLE)
    whole = lambda v: F.lit(v).cast(WHOLE)

    def moved(p: int, q: int) -> Column:
        """The sum of (y - y0)^p (x - x0)^q."""
        out = whole(0)
        for i in range(p + 1):
            for j in range(q + 1):
                sign = -1 if (p - i + q - j) % 2 else 1
                out = out + times(whole(sign * math.comb(p, i) * math.comb(q, j)), *[F.col("y0")] * (p - i), *[F.col("x0")] * (q - j), F.col(f"t{i}{j}"))
                out = out.cast(WHOLE)
        return out

    m = m.select(*R, "n", "t00", "y0", "x0", *[moved(p, q).alias(f"s{p}{q}") for p, q in powers])
    s = lambda name: F.col(f"s{name}")
    n = F.col("t00")
    k = {
        "20": times(n, s("20")) - times(s("10"), s("10")),
        "11": times(n, s("11")) - times(s("10"), s("01")),
        "02": times(n, s("02")) - times(s("01"), s("01")),
        "30": times(n, n, s("30")) - times(whole(3), n, s("10"), s("20")) + times(whole(2), s("10"), s("10"), s("10")),
        "03": times(n, n, s("03")) - times(whole(3), n, s("01"), s("02")) + times(whole(2), s("01"), s("01"), s("01")),
        "21": times(n, n, s("21")) - times(whole(2), n, s("10"), s("11")) - times(n, s("01"), s("20")) + times(whole(2), s("10"), s("10"), s("01")),
        "12": times(n, n, s("12")) - times(whole(2), n, s("01"), s("11")) - times(n, s("10"), s("02")) + times(whole(2), s("01"), s("01"), s("10")),
    }
    centre = [(F.col(f"{a}0").cast("double") + F.col(t).cast("double") / F.col("n")).alias(f"c{a}") for a, t in (("y", "s10"), ("x", "s01"))]
    return m.select(*R, "n", *centre, *[v.cast(WHOLE).alias(f"k{p}") for p, v in k.items()])


def hu_moments(m: DataFrame) -> DataFrame:
    """m (integer_moments) plus hu1..hu7 of the normalised central moments.

    Sums and differences of moments are taken in whole numbers: those of symmetric regions are exactly 0.
    """
    n = F.col("n").cast("double")
    second, third = n * n * n, n * n * n * n * F.sqrt(n)
    k = lambda p: F.col(f"k{p}")
    whole = lambda v: F.lit(v).cast(WHOLE)
    of = lambda c, scale: c.cast("double") / scale
    steps = {
        "s_": of(k("20") + k("02"), second),
        "t_": of(k("20") - k("02"), second),
        "u_": of(k("11"), second),
        "a_": of(k("30") + k("12"), third),
        "b_": of(k("21") + k("03"), third),
        "c_": of(k("30") - (whole(3) * k("12")).cast(WHOLE), third),
        "d_": of((whole(3) * k("21")).cast(WHOLE) - k("03"), third),
    }
    m = m.select("*", *[v.alias(name) for name, v in steps.items()])
    s, t, u, a, b, c, d = (F.col(name) for name in steps)
    hu = [
        s,
        t * t + 4 * u * u,
        c * c + d * d,
        a * a + b * b,
        c * a * (a * a - 3 * (b * b)) + d * b * (3 * (a * a) - b * b),
        t * (a * a - b * b) + 4 * u * (a * b),
        d * a * (a * a - 3 * (b * b)) - c * b * (3 * (a * a) - b * b),
    ]
    return m.select("*", *[h.alias(f"hu{i + 1}") for i, h in enumerate(hu)]).drop(*steps)


def region_moments(labels: DataFrame) -> DataFrame:
    """Centroid, axis lengths, elongation, eccentricity and Hu invariants of slice regions."""
    m = hu_moments(integer_moments(labels))
    area = F.col("n").cast("double") * F.col("n")
    a, b, c = (F.col(k).cast("double") / area for k in ("k20", "k11", "k02"))
    root = F.sqrt(((a - c) / 2) ** 2 + b * b)
    l1, l2 = (a + c) / 2 + root, F.greatest(F.lit(0.0), (a + c) / 2 - root)
    l2 = F.when(l2 < 1e-12, F.lit(0.0)).otherwise(l2)
    m = m.select("*", (4 * F.sqrt(l1)).alias("major"), (4 * F.sqrt(l2)).alias("minor"))
    ratio = F.try_divide(F.col("minor"), F.col("major"))
    ecc = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio)), F.lit(0.0))
    hu = [f"hu{k}" for k in range(1, 8)]
    return m.select(*R, F.col("n").alias("size"), "cy", "cx", "major", "minor", F.try_divide(F.col("major"), F.when(F.col("minor") > 0, F.col("minor"))).alias("elongation"), ecc.alias("eccentricity"), *hu)


def inertia_3d(labels: DataFrame) -> DataFrame:
    """elongation and flatness: largest and middle over smallest eigenvalue of the inertia tensor, null if that is 0.

    Moments are whole numbers from sums of powers, so one pass of partial sums is enough.
    """
    pairs = ["zz", "yy", "xx", "zy", "zx", "yx"]
    long = lambda a: F.col(a).cast("long")
    total = lambda v: F.sum(v.cast("decimal(20,0)")).cast(WHOLE)
    m = labels.groupBy(*R).agg(F.count("*").alias("n"), *[total(long(a)).alias(f"s{a}") for a in "zyx"], *[total(long(p[0]) * long(p[1])).alias(f"t{p}") for p in pairs])
    times = lambda a, b: (a * b).cast(WHOLE)
    n = F.col("n").cast("double")
    m = m.select(*R, "n", *[((times(F.col("n").cast(WHOLE), F.col(f"t{p}")) - times(F.col(f"s{p[0]}"), F.col(f"s{p[1]}"))).cast("double") / (n * n)).alias(p) for p in pairs])
    q = (F.col("zz") + F.col("yy") + F.col("xx")) / 3
    off = F.col("zy") ** 2 + F.col("zx") ** 2 + F.col("yx") ** 2
    p = F.sqrt(((F.col("zz") - q) ** 2 + (F.col("yy") - q) ** 2 + (F.col("xx") - q) ** 2 + 2 * off) / 6)
    m = m.select("*", q.alias("q"), p.alias("p"))
    b = {k: F.coalesce(F.try_divide(F.col(k) - (F.col("q") if k[0] == k[1] else F.lit(0.0)), F.when(F.col("p") > 0, F.col("p"))), F.lit(0.0)) for k in pairs}
    det = b["zz"] * (b["yy"] * b["xx"] - b["yx"] ** 2) - b["zy"] * (b["zy"] * b["xx"] - b["yx"] * b["zx"]) + b["zx"] * (b["zy"] * b["yx"] - b["yy"] * b["zx"])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    m = m.select(*R, F.col("n").alias("size"), "q", "p", angle.alias("t"))
    high = F.col("q") + 2 * F.col("p") * F.cos("t")
    low = F.col("q") + 2 * F.col("p") * F.cos(F.col("t") + 2 * math.pi / 3)
    m = m.select(*R, "size", "q", high.alias("c1"), low.alias("c3"))
    total, mid = 3 * F.col("q"), 3 * F.col("q") - F.col("c1") - F.col("c3")
    least = F.when(total - F.col("c1") > 1e-9, total - F.col("c1"))
    return m.select(*R, "size", (F.greatest(F.lit(0.0), total - F.col("c3")) / least).alias("elongation"), ((total - mid) / least).alias("flatness"))


def _sizes(labels: DataFrame) -> DataFrame:
    """dims that hold all labelled voxels."""
    return written(labels.groupBy("volume_id").agg(*[(F.max(a) + 1).cast("int").alias(n) for a, n in zip("zyx", "dhw")]), "sizes")


def region_outlines(labels: DataFrame, dims: DataFrame | None = None, neighbourhood: int = 4) -> DataFrame:
    """(R, size, perimeter, q) of slice regions: the length of their borders, and four times their Euler number.

    A block's part of every region is summed where the block is.
    """
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if neighbourhood == 8 else [])
    # fixed values: a border pixel counts 1, beside it 2, across a corner 10; codes give a step's length
    code = [(-1, 0, 2), (1, 0, 2), (0, -1, 2), (0, 1, 2), (-1, -1, 10), (-1, 1, 10), (1, -1, 10), (1, 1, 10)]
    length, euler, root2 = np.zeros(50), np.zeros(16, np.int64), math.sqrt(2)
    length[[5, 7, 15, 17, 25, 27]], length[[21, 33]], length[[13, 23]] = 1.0, root2, (1 + root2) / 2
    euler[[1, 2, 4, 8]], euler[[7, 11, 13, 14]], euler[[6, 9]] = 1, -1, -2

    def moved(a: np.ndarray, y: int, x: int, r: int) -> np.ndarray:
        """a at (y, x) from each place, r places fewer on every side of the slices."""
        return a[:, r + y : a.shape[1] - r + y, r + x : a.shape[2] - r + x]

    def f(b: blocks.Block) -> pa.RecordBatch:
        label = np.where(b.present, b.values, -1).astype(np.int64)
        mid = moved(label, 0, 0, 1)
        border = np.zeros(label.shape, bool)
        border[:, 1:-1, 1:-1] = (mid >= 0) & ~np.logical_and.reduce([moved(label, y, x, 1) == mid for y, x in near])
        own = moved(label, 0, 0, 2)
        codes = 1 + sum(w * (moved(border, y, x, 2) & (moved(label, y, x, 2) == own)) for y, x, w in code)
        steps = np.where(moved(border, 0, 0, 2) & (own >= 0), length[codes], 0.0)
        # 2 x 2 windows by their upper left place; the first ones begin before the slice
        y0, x0 = (1 if o == 0 else 2 for o in b.origin[1:])
        quad = [label[:, y0 + y : y0 + y + b.shape[1] + 2 - y0, x0 + x : x0 + x + b.shape[2] + 2 - x0] for y in (0, 1) for x in (0, 1)]
        names, kinds = [own[own >= 0]], [np.zeros((own >= 0).sum(), np.int64)]
        for p, one in enumerate(quad):
            first = (one >= 0) & ~np.logical_or.reduce([one == q for q in quad[:p]] or [np.zeros(one.shape, bool)])
            bits = sum((one == q).astype(np.int64) << k for k, q in enumerate(quad))
            names.append(one[first])
            kinds.append(euler[bits[first]])
        every, at = np.unique(np.concatenate(names), return_inverse=True)
        n = len(names[0])
        size, steps = np.bincount(at[:n], minlength=len(every)), np.bincount(at[:n], steps[own >= 0], len(every))
        kind = np.bincount(at, np.concatenate(kinds), len(every)).astype(np.int64)
        volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(every), np.int64)))
        return pa.RecordBatch.from_arrays([volume, pa.array(every), pa.array(size.astype(np.int64)), pa.array(steps), pa.array(kind)], [*R, "size", "perimeter", "q"])

    rows = labels.select(*C, F.col("label").cast("double").alias("value"))  # numbers of voxels: whole below 2^53
    schema = "volume_id string, label long, size long, perimeter double, q long"
    parts = blocks.on_blocks(rows, _sizes(labels) if dims is None else dims, ((0, 0), (2, 2), (2, 2)), f, schema, border="missing")
    return parts.groupBy(*R).agg(F.sum("size").alias("size"), F.sum("perimeter").alias("perimeter"), F.sum("q").alias("q"))


def _circularity() -> Column:
    p = F.col("perimeter")
    return F.when(p > 0, 4 * math.pi * F.col("size") / (p * p + F.lit(1e-8))).otherwise(0.0).alias("circularity")


def region_perimeter(labels: DataFrame, neighbourhood: int = 4, dims: DataFrame | None = None) -> DataFrame:
    """Perimeter of slice regions: border pixels weighted by how they continue to other border pixels."""
    return region_outlines(labels, dims, neighbourhood).select(*R, "size", "perimeter", _circularity())


def region_euler(labels: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """Euler number (8-connected) of slice regions, by counts of 2 x 2 patterns."""
    return region_outlines(labels, dims).select(*R, F.expr("cast(q div 4 as bigint)").alias("euler"))


def hull_pixels(y: np.ndarray, x: np.ndarray) -> int:
    """Pixels in the convex hull of the pixels' edge midpoints."""
    p = np.unique(np.concatenate([np.stack([y + a, x + b], 1) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]), axis=0)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for order in (p.tolist(), p[::-1].tolist()):
        chain: list = []
        for q in order:
            while len(chain) > 1 and turn(chain[-2], chain[-1], q) <= 0:
                chain.pop()
            chain.append(q)
        sides.append(chain[:-1])
    hull = sides[0] + sides[1]
    total = 0
    for row in range(int(y.min()), int(y.max()) + 1):
        xs = []
        for (y0, x0), (y1, x1) in zip(hull, hull[1:] + hull[:1]):
            if min(y0, y1) <= row <= max(y0, y1):
                xs += [x0, x1] if y0 == y1 else [x0 + (x1 - x0) * (row - y0) / (y1 - y0)]
        if xs:
            total += int(math.floor(max(xs) + 1e-9) - math.ceil(min(xs) - 1e-9)) + 1
    return total


#: Shapes whose hulls a task remembers.
KNOWN = 100_000


def region_solidity(labels: DataFrame) -> DataFrame:
    """(volume_id, label, size, hull, solidity) of slice regions: size over the pixels of the convex hull."""
    rows = labels.groupBy(*R, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))
    each = rows.groupBy(*R).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            cuts = b.column(3).offsets.to_numpy()
            y, x0, x1 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.column(3).flatten().flatten())
            hulls = np.zeros(b.num_rows, np.int64)
            for i, (lo, hi) in enumerate(zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0])):
                low = x0[lo:hi].min()
                shape = np.stack([y[lo:hi] - y[lo], x0[lo:hi] - low, x1[lo:hi] - low])
                key = shape.tobytes()
                if key not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[key] = hull_pixels(np.concatenate([shape[0], shape[0]]).astype(float), np.concatenate([shape[1], shape[2]]).astype(float))
                hulls[i] = known[key]
            size = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hulls), pa.array(size / hulls)], [*R, "size", "hull", "solidity"])

    return each.mapInArrow(run, "volume_id string, label long, size long, hull long, solidity double")


def _ways() -> np.ndarray:
    """The 426 directions of the planes that cut a hull."""
    ways = np.random.Generator(np.random.PCG64(0)).normal(size=(400, 3))
    axes = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)], float)
    return np.concatenate([axes, ways])


def _limits(p: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """How far points reach along each direction, some of them at a time."""
    out = np.full(len(ways), -np.inf)
    for k in range(0, len(p), 4096):
        np.maximum(out, (p[k : k + 4096].astype(float) @ ways.T).max(0), out=out)
    return out


def _inside(lo: np.ndarray, hi: np.ndarray, limit: np.ndarray, ways: np.ndarray) -> int:
    """Voxels of a box inside the planes."""
    rows = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(lo[1:], hi[1:])], indexing="ij"), -1).reshape(-1, 2)
    planes = range(int(lo[0]), int(hi[0]) + 1)
    if len(planes) * len(rows) <= 8192:  # few: all planes of directions at once
        box = np.concatenate([np.repeat(np.array(planes), len(rows))[:, None], np.tile(rows, (len(planes), 1))], 1)
        return sum(int((box[k : k + 2048] @ ways.T <= limit + 1e-9).all(1).sum()) for k in range(0, len(box), 2048))
    inside = 0
    for z in planes:  # plane by plane, as far as a plane's rows may still be inside
        left = rows
        for w, top in zip(ways, limit):
            left = left[left @ w[1:] <= top - z * w[0] + 1e-9]
        inside += len(left)
    return inside


def _span(p: np.ndarray) -> np.ndarray:
    """Up to four of the points p (whole numbers) that span what all of them span; four if that is not flat."""
    d = p - p[0]
    far = int(np.abs(d).sum(1).argmax())
    if not d[far].any():
        return p[:1]
    c = np.cross(d, d[far])
    wide = int(np.abs(c).max(1).argmax())
    if not c[wide].any():
        return p[[0, far]]
    v = d @ c[wide]
    deep = int(np.abs(v).argmax())
    return p[[0, far, wide, deep]] if v[deep] else p[[0, far, wide]]


def hull_voxels(p: np.ndarray) -> int:
    """Voxels in the convex hull of voxels p (n, 3): inside the supporting planes of 426 fixed directions."""
    pts = np.unique(p, axis=0).astype(np.int64)
    if len(_span(pts)) < 4:
        return len(pts)
    ways = _ways()
    return _inside(pts.min(0), pts.max(0), _limits(pts, ways), ways)


def region_surface(labels: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """surface = size without what a 3 x 3 x 3 erosion of the region leaves; surface / volume; size^(2/3) / surface.

    A block's part of every region is counted where the block is.
    """

    def f(b: blocks.Block) -> pa.RecordBatch:
        label = np.where(b.present, b.values, -1).astype(np.int64)
        lo = hi = label
        for axis in range(3):
            lo, hi = blocks.slid(lo, axis, 3, np.minimum), blocks.slid(hi, axis, 3, np.maximum)
        own = b.inner(label)
        core = (lo == hi)[own >= 0]
        every, at = np.unique(own[own >= 0], return_inverse=True)
        size, core = np.bincount(at, minlength=len(every)), np.bincount(at[core], minlength=len(every))
        volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(every), np.int64)))
        return pa.RecordBatch.from_arrays([volume, pa.array(every), pa.array(size.astype(np.int64)), pa.array(core.astype(np.int64))], [*R, "size", "core"])

    rows = labels.select(*C, F.col("label").cast("double").alias("value"))
    parts = blocks.on_blocks(rows, _sizes(labels) if dims is None else dims, ((1, 1),) * 3, f, "volume_id string, label long, size long, core long", border="missing")
    both = parts.groupBy(*R).agg(F.sum("size").alias("size"), F.sum("core").alias("core")).select(*R, "size", (F.col("size") - F.col("core")).alias("surface"))
    return both.select("*", (F.col("surface") / F.col("size")).alias("surface_ratio"), F.try_divide(F.pow("size", F.lit(2 / 3)), F.col("surface")).alias("sphericity"))


def regionprops_3d(labels: DataFrame, min_volume: int = 100, dims: DataFrame | None = None) -> DataFrame:
    """The full table of 3-D regions of at least min_volume voxels (without solidity, see region_solidity_3d)."""
    basics = region_basics(labels).where(F.col("size") >= min_volume).select(*R, "size", "extent", "bbox_aspect")
    return basics.join(inertia_3d(labels).drop("size"), R).join(region_surface(labels, dims).drop("size"), R)


#: Slices of a region whose rows one call holds.
SLAB = 64


def region_solidity_3d(labels: DataFrame) -> DataFrame:
    """size over hull voxels; the hull is cut by supporting planes in 426 fixed directions, so it is a slight upper bound.

    A region is taken in slabs of slices: first how far each reaches along every direction, then how many voxels of each lie
    inside of what all of them reach. So a region of any depth is spread.
    """
    rows = labels.groupBy(*R, "z", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))
    slabs = rows.groupBy(*R, F.floor(F.col("z") / SLAB).alias("slab")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("z", "y", "x0", "x1")).alias("rows"))
    lists = lambda values, kind: pa.array([v.tolist() for v in values], pa.list_(kind))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = _ways()
        for b in batches:
            cuts = b.column(4).offsets.to_numpy()
            z, y, x0, x1 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.column(4).flatten().flatten())
            points, ends, limits, spans = [], [], [], []
            for lo, hi in zip(cuts[:-1] - cuts[0], cuts[1:] - cuts[0]):
                p = np.concatenate([np.stack([z[lo:hi], y[lo:hi], x[lo:hi]], 1) for x in (x0, x1)])
                points.append(int(hi - lo + (x1[lo:hi] > x0[lo:hi]).sum()))
                ends.append(np.concatenate([p.min(0), p.max(0)]))
                limits.append(_limits(p, ways))
                spans.append(_span(p).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(points, pa.int64()), lists(ends, pa.int64()), lists(limits, pa.float64()), lists(spans, pa.int64())], [*R, "n", "points", "ends", "limits", "span"])

    parts = slabs.mapInArrow(reached, "volume_id string, label long, n long, points long, ends array<long>, limits array<double>, span array<long>")
    end = [(F.min if k < 3 else F.max)(F.col("ends")[k]).alias(f"e{k}") for k in range(6)]
    whole = parts.groupBy(*R).agg(F.sum("n").alias("n"), F.sum("points").alias("points"), F.collect_list("limits").alias("limits"), F.flatten(F.collect_list("span")).alias("span"), *end)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits = [np.max([np.asarray(v.values) for v in x], axis=0) for x in b.column(4)]
            flat = [len(_span(np.asarray(x.values).reshape(-1, 3))) < 4 for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists(limits, pa.float64()), pa.array(flat, pa.bool_()), *b.columns[6:]], [*R, "n", "points", "limits", "flat", *[f"e{k}" for k in range(6)]])

    schema = "volume_id string, label long, n long, points long, limits array<double>, flat boolean, " + ", ".join(f"e{k} long" for k in range(6))
    whole = written(whole.mapInArrow(joined, schema), "hulls")
    pieces = whole.where("not flat").withColumn("slab", F.explode(F.sequence(F.floor(F.col("e0") / SLAB), F.floor(F.col("e3") / SLAB))))
    pieces = pieces.select(*R, "limits", F.greatest("e0", F.col("slab") * SLAB).alias("z0"), F.least("e3", F.col("slab") * SLAB + SLAB - 1).alias("z1"), "e1", "e4", "e2", "e5").repartition(*R, "z0")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = _ways()
        for b in batches:
            z0, z1, y0, y1, x0, x1 = (b.column(k).to_numpy() for k in range(3, 9))
            n = [_inside(np.array([z0[i], y0[i], x0[i]]), np.array([z1[i], y1[i], x1[i]]), np.asarray(limit.values), ways) for i, limit in enumerate(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], [*R, "inside"])

    inside = pieces.mapInArrow(counted, "volume_id string, label long, inside long").groupBy(*R).agg(F.sum("inside").alias("inside"))
    hull = F.greatest("n", F.coalesce("inside", "points"))
    return whole.join(inside, R, "left").select(*R, F.col("n").alias("size"), hull.alias("hull"), (F.col("n") / hull).alias("solidity"))


def regionprops_2d(labels: DataFrame, min_area: int = 400) -> DataFrame:
    """The full table of slice regions of more than min_area pixels."""
    basics = region_basics(labels).where(F.col("size") > min_area).select(*R, "size", "extent", "bbox_aspect")
    shape = region_moments(labels).select(*R, "elongation", "eccentricity")
    return basics.join(shape, R).join(region_solidity(labels).select(*R, "solidity"), R)


def shape_vectors(labels: DataFrame, dims: DataFrame | None = None) -> DataFrame:
    """(volume_id, label, size, euler, v): circularity, aspect, extent, solidity, eccentricity, Euler number, hu1..hu3."""
    m = region_moments(labels)
    outline = region_outlines(labels, dims).select(*R, _circularity(), F.expr("cast(q div 4 as bigint)").alias("euler"))
    both = region_basics(labels).select(*R, "size", "extent").join(m.drop("size"), R).join(outline, R)
    both = both.join(region_solidity(labels).select(*R, "solidity"), R)
    aspect = F.when(F.col("minor") > 0, F.col("major") / (F.col("minor") + F.lit(1e-8))).otherwise(1.0)
    v = F.array("circularity", aspect, "extent", "solidity", "eccentricity", F.col("euler").cast("double"), "hu1", "hu2", "hu3")
    return both.select(*R, "size", "euler", v.alias("v"))
