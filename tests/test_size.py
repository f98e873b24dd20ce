"""Work that must not grow with a volume's depth, with copies or with the square of the regions."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import components as co
from stratavox.operators import features as fe
from stratavox.operators import matching as ma
from stratavox.operators import metrics as me
from stratavox.operators import morphology as mo
from stratavox.operators import pixel as px
from stratavox.operators import regions as re_
from stratavox.operators import windows as wi
from stratavox.sources import derived, volumes
from stratavox.sources.derived import C

VOXEL = "volume_id string, z int, y int, x int"
DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def dims_of(spark, d, h, w):
    return spark.createDataFrame([("v", d, h, w)], "volume_id string, d int, h int, w int")


def mask_of(spark, on):
    return spark.createDataFrame([("v", *map(int, p)) for p in np.argwhere(on)], VOXEL)


def cells(df):
    return {(r.z, r.y, r.x) for r in df.collect()}


def vectors(rng, n):
    return np.round(np.exp(rng.normal(size=(n, 9))) * [1, 1, 1, 1, 1, 1, 1, 0.01, 0.001], 5)


def test_resampling_holds_no_square_of_the_depth(spark):
    v = np.random.default_rng(0).normal(size=(3000, 2))
    tracemalloc.start()
    px.resampled(v, 2.0)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert top < 3000 * 3000  # bytes


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_in_blocks_of_slices(spark, order):
    v = np.random.default_rng(1).normal(size=(300, 1, 2)) * 100
    df = spark.createDataFrame([("v", z + 5, 3, x + 2, float(v[z, 0, x])) for z in range(300) for x in range(2)], VOXEL + ", value double")
    out = px.resample_z(df, 1.7, order)
    assert "FlatMapGroups" not in plan(out)
    got = {(r.z, r.x): r.value for r in out.collect()}
    want = px.resampled(v.reshape(300, 2), 1.7, order)
    assert len(got) == want.size
    assert np.allclose([[got[z, x + 2] for x in range(2)] for z in range(len(want))], want, rtol=0, atol=1e-10)


def test_shapes_meet_a_few_templates_first(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, t = vectors(rng, 60), vectors(rng, 40)
    v[::7, 7] = 0
    rows = lambda m: spark.createDataFrame([("v", k, 10, 1, x.tolist()) for k, x in enumerate(m)], "volume_id string, label long, size long, euler long, v array<double>")
    tol = 0.95
    ends = (1 + tol) / 2 * (np.ptp(t, axis=0) + 1e-8)
    want = {k for k, x in enumerate(v) if (np.abs(x - t.mean(0)) < ends).all() and (np.abs(x - t) / (np.abs(t) + 1e-8) <= tol).all(1).any()}
    for few in (1, 40):
        monkeypatch.setattr(ma, "FIRST", few)
        assert {r.label for r in ma.match_shapes(rows(v), rows(t), 1 - tol, 0.5).collect()} == want
    # what fits a template itself needs no pairs
    monkeypatch.setattr(ma, "_within_bands", None)
    assert len(want) and ma.match_shapes(rows(t), rows(t), 0.5, 0.5).count() == sum((np.abs(x - t.mean(0)) < 0.75 * (np.ptp(t, axis=0) + 1e-8)).all() for x in t)


def test_hu_filter_meets_a_few_templates_first(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, t = rng.normal(size=(80, 7)), rng.normal(size=(30, 7))
    rows = lambda m: spark.createDataFrame([("v", k, 10, x.tolist()) for k, x in enumerate(m)], "volume_id string, label long, size long, v array<double>")
    cos = v @ t.T / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(t, axis=1) + 1e-8)
    for few in (1, 30):
        monkeypatch.setattr(ma, "FIRST", few)
        assert {r.label for r in ma.filter_by_hu(rows(v), rows(t), 0.6, 0.5).collect()} == set(np.flatnonzero((cos >= 0.6).any(1)).tolist())
    monkeypatch.setattr(ma, "_alike", None)
    assert ma.filter_by_hu(rows(t), rows(t), 0.999, 0.5).count() == 30


def test_hu_pairs_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ma, "MEMBERS", 3)
    monkeypatch.setattr(ma, "PAIRS_PER_TASK", 10)
    base = np.random.default_rng(4).normal(size=(5, 7))
    m = base[np.arange(40) % 5 * (np.arange(40) < 30)]
    rows = spark.createDataFrame([("v", k, 1, x.tolist()) for k, x in enumerate(m)], "volume_id string, label long, size long, v array<double>")
    cos = m @ m.T / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(m, axis=1) + 1e-8)
    got = [(r.label_a, r.label_b) for r in ma.hu_similarity(rows, rows, 0.9).collect()]
    assert sorted(got) == [tuple(p) for p in np.argwhere(cos >= 0.9).tolist()]


def test_equal_grids_count_once(spark, monkeypatch):
    monkeypatch.setattr(ma, "CELLS_PER_PASS", 1)
    rows = [("v", 0, 0, 10 * k + x, k) for k in range(12) for x in range(3 + k % 2)]
    labels = spark.createDataFrame(rows, VOXEL + ", label long")
    calls, before = [], ma.Scratch.written
    monkeypatch.setattr(ma.Scratch, "written", lambda self, df, tag, *a: (calls.append(tag), before(self, df, tag, *a))[1])
    assert ma.filter_by_shape_3d(labels, labels, 1.0).count() == 12
    assert calls.count("met") <= 8  # two shapes


def test_voxels_are_not_joined(spark):
    assert "SortMergeJoin" not in plan(derived.voxels(spark, DATA))


def test_overlay_aggregates_numbers(spark):
    raw = spark.createDataFrame([("v", 0, 0, x, 300.0 * x) for x in range(3)], VOXEL + ", value double")
    preds = spark.createDataFrame([("v", 0, 0, 0, "a", 0.9), ("v", 0, 0, 0, "b", 0.6), ("v", 0, 0, 1, "a", 0.5)], VOXEL + ", class string, p double")
    colors = spark.createDataFrame([("a", 0, 1, 2, 3), ("b", 1, 4, 5, 6)], "class string, place int, r int, g int, b int")
    out = volumes.overlay_classes(raw, preds, colors)
    assert "max_by" not in plan(out)
    assert sorted((r.x, r.r, r.g, r.b) for r in out.collect()) == [(0, 4, 5, 6), (1, 255, 255, 255), (2, 255, 255, 255)]


def test_rings_and_chains_take_one_exchange(spark):
    on = np.random.default_rng(5).random((2, 40, 37)) < 0.1
    mask, dims = mask_of(spark, on), dims_of(spark, 2, 40, 37)
    assert plan(mo.dilated_rings(mask, dims, 1, 2)).count("RepartitionByExpression") + plan(mo.dilated_rings(mask, dims, 1, 2)).count("Exchange") == 1
    one = mo.chained(mask, dims, [(True, (1, 3, 4), 2), (False, (1, 3, 4), 2)])
    assert plan(one).count("Exchange") == 1
    steps = mo.erode(mo.dilate(mo.dilate(mask, (1, 3, 4), dims), (1, 3, 4), dims), (1, 3, 4), 2)
    assert cells(one) == cells(steps)


def test_weights_need_one_grouping(spark):
    dense = spark.createDataFrame([("v", 0, 0, x, x / 10) for x in range(4)], VOXEL + ", soft double")
    m = lambda *xs: spark.createDataFrame([("v", 0, 0, x) for x in xs], VOXEL)
    out = me.supervision_weights(dense, m(1), m(2, 9), m(3).withColumn("ring", F.lit("inner")))
    assert "Join" not in plan(out)
    assert sorted((r.x, r.weight) for r in out.collect()) == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0)]


def test_edges_close_regions_on_blocks(spark):
    on = np.zeros((1, 20, 20), bool)
    on[0, 5:15, 5:15] = True
    on[0, 7:13, 7:13] = False
    out = co.closed_region_fill(mask_of(spark, on), dims_of(spark, 1, 20, 20))
    assert "LeftAnti" not in plan(out) and len(cells(out)) == 36


def test_modes_on_blocks(spark):
    on = np.random.default_rng(6).integers(0, 3, (1, 9, 11))
    rows = spark.createDataFrame([("v", 0, y, x, int(on[0, y, x])) for y in range(9) for x in range(11)], VOXEL + ", label int")
    out = wi.mode_filter(rows, [0, 1, 2], 2, dims_of(spark, 1, 9, 11))
    assert "Window" not in plan(out) and sorted(out.collect()) == sorted(wi.mode_filter(rows, [0, 1, 2], 2).collect())


def test_distances_need_no_whole_plane(spark):
    on = np.random.default_rng(7).random((9, 12, 70)) < 0.01
    out = fe.distance_map(mask_of(spark, on), dims_of(spark, 9, 12, 70))
    assert "FlatMapGroups" not in plan(out)
    at = np.argwhere(on)
    want = {p: np.sqrt(((at - p) ** 2).sum(1).min()) for p in np.ndindex(on.shape)}
    assert all(abs(want[r.z, r.y, r.x] - r.value) < 1e-9 for r in out.collect())


def test_hulls_of_deep_regions_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p = np.unique(np.rint(rng.normal(size=(300, 3)) * [12, 4, 3]).astype(int), axis=0)
    p -= p.min(0)
    flat = [(z, z, 2) for z in range(9)]
    rows = [("v", *map(int, c), 1) for c in p] + [("v", z, y + 90, x, 2) for z, y, x in flat] + [("v", 3, 70, 3, 3)]
    labels = spark.createDataFrame(rows, VOXEL + ", label long")
    monkeypatch.setattr(re_, "SLAB", 5)
    out = re_.region_solidity_3d(labels)
    assert "FlatMapGroups" not in plan(out)
    ends = np.array([(z, y, x) for z, y in {(a, b) for a, b, _ in p.tolist()} for x in (min(c for a, b, c in p.tolist() if (a, b) == (z, y)), max(c for a, b, c in p.tolist() if (a, b) == (z, y)))])
    assert {r.label: r.hull for r in out.collect()} == {1: max(len(p), re_.hull_voxels(ends)), 2: 9, 3: 1}


def test_perimeters_are_summed_by_block(spark):
    labels = mask_of(spark, np.random.default_rng(9).random((2, 12, 12)) < 0.6).withColumn("label", F.lit(5).cast("long"))
    out = re_.region_perimeter(labels, 8, dims_of(spark, 2, 12, 12))
    assert "Generate" not in plan(out) and out.count() == 1
