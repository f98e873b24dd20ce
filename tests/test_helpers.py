"""The NumPy helpers and edge cases against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions.scalar import from_linear, linear_index
from stratavox.operators import components as co
from stratavox.operators import features as fe
from stratavox.operators import metrics as me
from stratavox.operators import morphology as mo
from stratavox.operators import pixel as px
from stratavox.operators import regions as re_
from stratavox.operators import windows as wi
from stratavox.plans.scoring import score_tiles

VOXEL = "volume_id string, z int, y int, x int"


def mask_of(spark, *planes):
    """Planes drawn as text; '#' is set."""
    rows = [("v", z, y, x) for z, p in enumerate(planes) for y, line in enumerate(p.split()) for x, c in enumerate(line) if c == "#"]
    d, h, w = len(planes), len(planes[0].split()), len(planes[0].split()[0])
    return spark.createDataFrame(rows, VOXEL), spark.createDataFrame([("v", d, h, w)], "volume_id string, d int, h int, w int")


def cells(df):
    return sorted((r.z, r.y, r.x) for r in df.collect())


def test_labels_of_shapes(spark):
    u, dims = mask_of(spark, "#.# #.# ###")
    assert co.label_2d(u, dims).select("label").distinct().count() == 1
    diagonal, dims = mask_of(spark, "#.. .#. ..#")
    assert co.label_2d(diagonal, dims).select("label").distinct().count() == 3
    assert co.label_2d(diagonal, dims, 8).select("label").distinct().count() == 1
    two, dims = mask_of(spark, "##.. ....", ".##. ....", "..## ....")
    assert {r.label for r in co.label_3d(two, dims, 6).collect()} == {0}
    steps, dims = mask_of(spark, "#.. ...", "... .#.", "..# ...")
    assert {r.label for r in co.label_3d(steps, dims, 26).collect()} == {0}
    assert co.label_3d(steps, dims, 6).select("label").distinct().count() == 3
    empty, dims = mask_of(spark, "... ...")
    assert co.label_3d(empty, dims).count() == 0


def test_labels_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [("v", int(z), int(y), int(x)) for z, y, x in np.argwhere(rng.random((5, 12, 12)) < 0.45)]
    df = spark.createDataFrame(rows, VOXEL)
    dims = spark.createDataFrame([("v", 5, 12, 12)], "volume_id string, d int, h int, w int")
    a = sorted(map(tuple, co.label_3d(df.repartition(1), dims).collect()))
    assert a == sorted(map(tuple, co.label_3d(df.repartition(8), dims).collect()))


def test_holes_and_euler(spark):
    ring, dims = mask_of(spark, "##### #...# #.#.# #...# #####")
    assert len(cells(co.fill_holes(ring, dims))) == 25
    labels = co.label_2d(ring, dims)
    assert sorted(r.euler for r in re_.region_euler(labels).collect()) == [0, 1]
    border, dims = mask_of(spark, "##.## #...# #...# #####")
    assert cells(co.fill_holes(border, dims)) == cells(border)


def test_erosion_within_dilation(spark):
    m, dims = mask_of(spark, "..#.. .###. .###. ..#..")
    e, d = set(cells(mo.erode(m, (1, 3, 3)))), set(cells(mo.dilate(m, (1, 3, 3), dims)))
    assert e <= set(cells(m)) <= d
    o = mo.opening(m, (1, 2, 2), dims)
    assert cells(mo.opening(o, (1, 2, 2), dims)) == cells(o)


def test_solidity_of_an_l_and_a_square():
    y, x = np.indices((4, 4)).reshape(2, -1)
    assert re_.hull_pixels(y.astype(float), x.astype(float)) == 16
    ys, xs = np.array([0, 1, 2, 2, 2.0]), np.array([0, 0, 0, 1, 2.0])
    assert re_.hull_pixels(ys, xs) == 6


def test_line_distances_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        f = np.where(rng.random(n) < 0.3, rng.integers(0, 40, n).astype(float), np.inf)
        want = np.array([min((i - j) ** 2 + f[j] for j in range(n)) for i in range(n)])
        assert np.array_equal(fe.line_distances(f), want)


def test_gaussian_weights_and_impulse(spark):
    assert abs(sum(wi.gaussian_weights(2.0)) - 1) < 1e-12
    rng = np.random.default_rng(5)
    v = rng.random((1, 6, 7))
    df = spark.createDataFrame([("v", 0, int(y), int(x), float(v[0, y, x])) for y in range(6) for x in range(7)], VOXEL + ", value double")
    dims = spark.createDataFrame([("v", 1, 6, 7)], "volume_id string, d int, h int, w int")
    got = {(r.y, r.x): r.value for r in wi.gaussian_smooth(df, (0, 2.0, 2.0), dims).collect()}
    want = fe.gauss(v[0], 2.0)
    assert max(abs(got[y, x] - want[y, x]) for y in range(6) for x in range(7)) < 1e-9


def test_slice_maps():
    v = np.random.default_rng(1).random((16, 20))
    k = 5
    p = np.pad(v, 2, mode="symmetric")
    assert np.allclose(fe.box_mean(v, k), [[p[i : i + k, j : j + k].mean() for j in range(20)] for i in range(16)])
    assert np.allclose(fe.radial(v, 0, 2.9) + fe.radial(v, 3, np.inf), v)  # both ends are included
    assert fe.feature_maps(v).shape == (len(fe.MAPS), 16, 20)
    assert np.isfinite(fe.wiener(np.ones((8, 8)), 3)).all()


def test_splines_keep_constants_and_lines():
    v = np.stack([np.full(7, 3.0), np.arange(7.0)], 1)
    out = px.resampled(v, 3)
    assert np.allclose(out[:, 0], 3) and np.allclose(out[:, 1], np.linspace(0, 6, 21))
    assert np.allclose(px.resampled(v[:1], 4), v[0])


def test_scores_of_equal_and_empty_masks(spark):
    m, dims = mask_of(spark, "##. #..")
    r = me.iou_fpr(m, m, dims, ["volume_id"]).first()
    assert abs(r.iou - 1) < 1e-6 and r.fpr == 0 and r.dice == 1
    none = me.iou_fpr(m.limit(0), m, dims, ["volume_id"]).first()
    assert none.iou == 0 and none.dice == 0


def test_constant_volumes_and_small_slices(spark):
    flat = spark.createDataFrame([("v", 0, y, x, 5.0) for y in range(3) for x in range(3)], VOXEL + ", value double")
    dims = spark.createDataFrame([("v", 1, 3, 3)], "volume_id string, d int, h int, w int")
    assert {r.value for r in px.minmax_normalize(flat).collect()} == {0.0}
    assert {r.value for r in px.clip_normalize(flat).collect()} == {0.0}
    assert {r.value for r in px.zscore(flat).collect()} == {0.0}
    assert px.value_bins(flat, 3).count() == 0
    with pytest.raises(ValueError):
        score_tiles(flat.select("volume_id", "z", "y", "x", F.array("value").alias("f")), lambda b: b["features"][..., 0], dims, 4, 2, 0)


def test_projection_needs_both_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k int, f array<double>")
    with pytest.raises(ValueError):
        me.mean_diff_projection(df, "k", F.col("k") == 1, F.col("k") == 2)


def test_linear_index_round_trip(spark):
    df = spark.createDataFrame([(2, 3, 4)], "z int, y int, x int")
    i = linear_index(F.col("z"), F.col("y"), F.col("x"), F.lit(10), F.lit(20))
    z, y, x = from_linear(i, F.lit(10), F.lit(20))
    assert tuple(df.select(i, z, y, x).first()) == (464, 2, 3, 4)
