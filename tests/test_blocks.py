"""Blocks with halos, and what runs on them, against dense arrays and line windows."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from stratavox.operators import blocks
from stratavox.operators import components as co
from stratavox.operators import features as fe
from stratavox.operators import windows as wi
from stratavox.plans import scoring
from stratavox.sources.derived import C

from .test_volumes import dense, volume

RNG = np.random.default_rng(3)
BOX = RNG.integers(0, 255, (5, 21, 18)).astype(float)
PAD = {"mirror": {"mode": "symmetric"}, "edge": {"mode": "edge"}, "missing": {"mode": "constant", "constant_values": 0.0}}

def sized(spark, v):
    """A volume whose row of dims Spark knows to be small, as it does of written tables."""
    df, dims = volume(spark, v)
    return df, F.broadcast(dims)


def exchanges(df):
    """Of a plan that has not run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

@pytest.mark.parametrize("border", list(PAD))
@pytest.mark.parametrize("size,halo", [((2, 8, 5), ((1, 1), (2, 2), (3, 3))), ((32, 128, 128), ((0, 0), (9, 9), (4, 4))), ((1, 4, 4), ((0, 0), (6, 6), (7, 7)))])
def test_blocks_hold_their_neighbours(spark, monkeypatch, size, halo, border):
    monkeypatch.setattr(blocks, "PACKED", 1 << 12)
    df, dims = sized(spark, BOX)
    wide = np.pad(BOX, halo, **PAD[border])

    def f(b):
        at = tuple(slice(o, o + n + before + after) for o, n, (before, after) in zip(b.origin, b.shape, b.halo))
        return {"value": b.inner(b.values), "same": np.full(b.shape, float(np.array_equal(b.values, wide[at])))}

    out = blocks.filtered(df.repartition(9), dims, halo, f, ("value", "same"), size, border)
    assert exchanges(out) == 1
    assert np.array_equal(dense(out, BOX.shape), BOX) and dense(out, BOX.shape, "same").all()

def test_arrays_sparse_and_stray_voxels(spark):
    rows = [("a", 0, 0, 0, [1.0, 2.0]), ("a", 0, 5, 3, [3.0, 4.0]), ("b", 1, 1, 1, [5.0, 6.0]), ("a", 9, 0, 0, [7.0, 8.0]), ("a", 0, -1, 0, [7.0, 8.0])]
    df = spark.createDataFrame(rows, blocks.VOXEL + ", f array<double>")
    dims = spark.createDataFrame([("a", 2, 6, 4), ("b", 2, 2, 2), ("c", 1, 1, 1)], "volume_id string, d int, h int, w int")
    out = blocks.on_blocks(df, dims, ((0, 0), (1, 1), (0, 0)), lambda b: blocks.voxel_rows(b, {"f": b.inner(b.values) * 2}, b.inner(b.present)), blocks.VOXEL + ", f array<double>", "f", (1, 3, 4), "missing")
    assert sorted(map(tuple, out.collect())) == [("a", 0, 0, 0, [2.0, 4.0]), ("a", 0, 5, 3, [6.0, 8.0]), ("b", 1, 1, 1, [10.0, 12.0])]
    assert blocks.on_blocks(df.limit(0), dims, ((0, 0),) * 3, lambda b: None, blocks.VOXEL, "f").collect() == []

def by_lines(df, size):
    """Local contrast by window functions, axis by axis."""
    both = df.select(*C, "value", F.col("value").alias("lo"), F.col("value").alias("hi"))
    for axis, n in zip("zyx", size):
        w = wi.line(axis, *wi.frame(n))
        both = both.select(*C, "value", F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    return both.select(*C, ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-5))).alias("value"))

@pytest.mark.parametrize("size", [(3, 20, 20), (2, 3, 1)])
def test_contrast_equals_line_windows(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SIZE", (2, 8, 8))
    df, dims = sized(spark, BOX)
    got = wi.local_contrast_normalize(df, dims, size)
    assert exchanges(got) == 1
    assert np.allclose(dense(got, BOX.shape), dense(by_lines(df, size), BOX.shape), rtol=0, atol=1e-12)

@pytest.mark.parametrize("sigma", [(1, 3, 3), (0, 1.5, 0.4), (2, 0, 7)])
def test_smoothing_equals_line_windows(spark, sigma):
    df, dims = sized(spark, BOX)
    got, want = wi.gaussian_smooth(df, sigma, dims), df
    assert exchanges(got) == 1
    for axis, s in zip("zyx", sigma):
        want = wi.gaussian_axis(want, axis, s, dims)
    assert np.allclose(dense(got, BOX.shape), dense(want, BOX.shape), rtol=0, atol=1e-9)

def test_feature_bank_equals_sums_over_slices(spark):
    """The bank of blocks of two slices: each slice's maps, summed over slabs by Spark."""
    v = RNG.normal(100, 30, (7, 20, 17))
    df, dims = sized(spark, v)
    bank = fe.feature_bank(df, dims, 2, slices=2)
    assert exchanges(bank) == 1
    maps = np.stack([fe.feature_maps(s).astype(np.float32) for s in v]).astype(float)
    rows = [("v", z, int(y), int(x), maps[z, :, y, x].tolist()) for z in range(7) for y, x in np.ndindex(20, 17)]
    flat = spark.createDataFrame(rows, blocks.VOXEL + ", f array<double>").withColumn("t", F.explode(F.sequence(F.col("z") - 2, F.col("z") + 2)))
    sums = flat.select("volume_id", "t", "y", "x", F.posexplode("f").alias("k", "m")).groupBy("t", "y", "x", "k").agg(F.sum("m").alias("s"), F.sum(F.col("m") ** 2).alias("q"), F.count("*").alias("n"))
    want = np.zeros((7, 20, 17, 2 * len(fe.MAPS)))
    for r in sums.where("n = 5 and t between 2 and 4").collect():
        want[r.t, r.y, r.x, r.k], want[r.t, r.y, r.x, len(fe.MAPS) + r.k] = r.s / 5, max(0.0, r.q / 5 - (r.s / 5) ** 2)
    got = np.zeros_like(want)
    for r in bank.collect():
        got[r.z, r.y, r.x] = r.f
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)

def components(on, steps):
    """Labels by flooding, and their smallest indices."""
    label = np.full(on.shape, -1)
    for start in zip(*np.nonzero(on)):
        if label[start] >= 0:
            continue
        todo, name = [start], int(np.ravel_multi_index(start, on.shape))
        label[start] = name
        while todo:
            p = todo.pop()
            for s in steps:
                for sign in (1, -1):
                    q = tuple(a + sign * b for a, b in zip(p, s))
                    if all(0 <= a < n for a, n in zip(q, on.shape)) and on[q] and label[q] < 0:
                        label[q] = name
                        todo.append(q)
    return label

def mask_rows(spark, on):
    rows = [("v", *map(int, p)) for p in zip(*np.nonzero(on))]
    return spark.createDataFrame(rows, blocks.VOXEL), spark.createDataFrame([("u", 3, 4, 4), ("v", *on.shape)], "volume_id string, d int, h int, w int")

@pytest.mark.parametrize("connectivity", [4, 8, 6, 26])
def test_labels_across_seams(spark, connectivity):
    on = RNG.random((4, 30, 27)) < (0.55 if connectivity in (4, 6) else 0.35)
    on[:, 12, :] = True
    mask, dims = mask_rows(spark, on)
    want = components(on, co.half_steps(connectivity))
    for tile in ((2, 8, 8), (1, 8, 5), (32, 64, 64)):
        got = (co.label_2d if connectivity in (4, 8) else co.label_3d)(mask, dims, connectivity, tile)
        rows = got.collect()
        assert len(rows) == on.sum() and all(want[r.z, r.y, r.x] == r.label for r in rows)

def test_spiral_and_empty(spark):
    """One component that crosses every seam again and again."""
    on = np.zeros((1, 33, 33), bool)
    y = x = 0
    dy, dx, n = 0, 1, 32
    for turn in range(30):
        for _ in range(n):
            on[0, y, x] = True
            y, x = y + dy, x + dx
        on[0, y, x] = True
        dy, dx = dx, -dy
        n -= 2 if turn % 2 and turn > 1 else 0
        if n <= 0:
            break
    mask, dims = mask_rows(spark, on)
    want = components(on, co.half_steps(4))
    rows = co.label_2d(mask, dims, 4, (1, 8, 8)).collect()
    assert len(rows) == on.sum() and all(want[r.z, r.y, r.x] == r.label for r in rows)
    assert co.label_2d(mask.limit(0), dims).collect() == [] and co.fill_holes(mask.limit(0), dims).collect() == []

@pytest.mark.parametrize("share", [0.45, 0.62, 0.8])
def test_holes_across_seams(spark, share):
    on = RNG.random((3, 26, 31)) < share
    on[1] = False
    on[2, 2:24, 3:29] = False
    on[2, 2, 3:29] = on[2, 23, 3:29] = on[2, 2:24, 3] = on[2, 2:24, 28] = True  # a frame whose inside has blocks without a voxel
    outside = components(~on, co.half_steps(4))
    rim = {int(v) for z in range(3) for v in np.concatenate([outside[z, 0], outside[z, -1], outside[z, :, 0], outside[z, :, -1]]) if v >= 0}
    want = on | ~np.isin(outside, list(rim | {-1}))
    mask, dims = mask_rows(spark, on)
    for tile in ((1, 6, 6), (2, 64, 64)):
        got = np.zeros_like(on)
        rows = co.fill_holes(mask, dims, tile).collect()
        for r in rows:
            assert not got[r.z, r.y, r.x]
            got[r.z, r.y, r.x] = True
        assert np.array_equal(got, want)

@pytest.mark.parametrize("fuse", ["avg", "max"])
def test_tiles_on_blocks(spark, fuse):
    """Scores that depend on a tile's whole content, fused over repeated and clamped origins."""
    v = RNG.normal(0, 1, (5, 25, 22))
    df, dims = sized(spark, v)
    f = df.select(*C, F.array("value", F.col("value") * 2).alias("f"))

    def scorer(b):
        x = b["features"]
        return x[..., 0] - x[..., 1].mean((1, 2), keepdims=True) + np.arange(x.shape[2])[None, None, :] / 10

    total, n = np.zeros(v.shape), np.zeros(v.shape)
    for z in range(1, 4):
        for y in [min(s, 25 - 6) for s in range(0, 25, 4)]:
            for x in [min(s, 22 - 6) for s in range(0, 22, 4)]:
                t = v[z, y : y + 6, x : x + 6]
                p = 1 / (1 + np.exp(-(t - 2 * t.mean() + np.arange(6)[None] / 10)))
                at = (z, slice(y, y + 6), slice(x, x + 6))
                total[at] = total[at] + p if fuse == "avg" else np.maximum(total[at], p > 0.5)
                n[at] += 1
    want = np.where(n > 0, total / np.maximum(n, 1), 0) if fuse == "avg" else total
    out = scoring.score_tiles(f, scorer, dims, 6, 4, 1, fuse)
    assert exchanges(out) == 2
    assert np.allclose(dense(out, v.shape), want)
