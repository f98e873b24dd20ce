"""Volume operators against direct NumPy computation on small volumes, and jobs on drawn ones."""

import itertools
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import components as co
from stratavox.operators import features as fe
from stratavox.operators import matching as ma
from stratavox.operators import metrics as me
from stratavox.operators import pixel as px
from stratavox.operators import regions as re_
from stratavox.operators import sampling as sa
from stratavox.operators import windows as wi
from stratavox.plans import jobs, scoring
from stratavox.sources import store, volumes

VOXEL = "volume_id string, z int, y int, x int"


def volume(spark, v):
    rows = [("v", int(z), int(y), int(x), float(v[z, y, x])) for z, y, x in np.ndindex(v.shape)]
    return spark.createDataFrame(rows, VOXEL + ", value double"), spark.createDataFrame([("v", *v.shape)], "volume_id string, d int, h int, w int")


def dense(df, shape, col="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.z, r.y, r.x])
        out[r.z, r.y, r.x] = r[col]
    return out


def drawn(*planes):
    """Planes drawn as text; '#' is set."""
    return np.array([[[c == "#" for c in line] for line in p.split()] for p in planes])


def mask(spark, m):
    dims = spark.createDataFrame([("v", *m.shape)], "volume_id string, d int, h int, w int")
    return spark.createDataFrame([("v", *map(int, at)) for at in np.argwhere(m)], VOXEL), dims


def cells(df):
    got = [(r.z, r.y, r.x) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def at(m):
    return set(map(tuple, np.argwhere(m).tolist()))


RNG = np.random.default_rng(11)
BOX = RNG.integers(0, 255, (4, 9, 11)).astype(float)


def windowed(v, size, fn):
    """fn over boxes with mirrored borders; an even size reaches one further down."""
    pads = [(n // 2, n - 1 - n // 2) for n in size]
    return fn(np.lib.stride_tricks.sliding_window_view(np.pad(v, pads, mode="symmetric"), size), axis=(-3, -2, -1))


@pytest.mark.parametrize("size", [(3, 4, 5), (15, 30, 23)])
def test_box_sums_mirror_as_often_as_the_window_reaches(spark, size):
    df, dims = volume(spark, BOX)
    out = wi.local_moments(df, size, dims)
    mean = windowed(BOX, size, np.mean)
    assert np.allclose(dense(out, BOX.shape, "mean"), mean) and np.allclose(dense(out, BOX.shape, "var"), windowed(BOX**2, size, np.mean) - mean**2)


def test_local_standardize(spark):
    df, dims = volume(spark, BOX)
    for k in (3, 15):
        m = windowed(BOX, (k, k, 3), np.mean)
        std = np.sqrt(np.maximum(windowed(BOX**2, (2 * k, 2 * k, 3), np.mean) - m**2, 0))
        assert np.allclose(dense(wi.local_standardize(df, k, dims), BOX.shape), (BOX - m) / (std + 1e-2))


def test_variance_weights(spark):
    e = BOX / 255
    df, dims = volume(spark, e)
    m, q = windowed(e, (5, 5, 5), np.mean), windowed(e**2, (5, 5, 5), np.mean)
    rel = (q - m**2) / (q + 1e-6)
    w = 1 - (rel - rel.min()) / (rel.max() - rel.min() + 1e-8)
    out = wi.enhance_by_variance(df, 5, dims)
    assert np.allclose(dense(out, e.shape), e * w) and np.allclose(dense(out, e.shape, "weight"), w)


def smooth(v, sigma, bent=()):
    """Direct sums over mirrored positions; axes in `bent` take the kernel's second derivative."""
    for axis, s in enumerate(sigma):
        if s > 0:
            r = int(4 * s + 0.5)
            k = np.arange(-r, r + 1)
            w = np.exp(-0.5 * (k / s) ** 2)
            w /= w.sum()
            if axis in bent:
                w = w * (k * k / s**4 - 1 / s**2)
            wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(v.ndim)], mode="symmetric")
            v = sum(w[j] * np.take(wide, range(j, j + v.shape[axis]), axis) for j in range(2 * r + 1))
    return v


def test_smoothing_thresholds_and_energies(spark):
    df, dims = volume(spark, BOX)
    assert np.allclose(dense(wi.gaussian_smooth(df, (1, 3, 3), dims), BOX.shape), smooth(BOX, (1, 3, 3)))
    assert cells(wi.smooth_and_threshold(df, (0, 1, 1), 128, dims)) == at(smooth(BOX, (0, 1, 1)) > 128)
    dog = np.abs(smooth(BOX, (0, 1, 1)) - smooth(BOX, (0, 2, 2)))
    assert np.allclose(dense(wi.dog_energy(df, 1, 2, dims), BOX.shape), dog / dog.mean())
    g = np.pad(smooth(BOX, (0, 1.5, 1.5)), ((0, 0), (1, 1), (1, 1)), mode="edge")
    lap = np.abs(g[:, 2:, 1:-1] + g[:, :-2, 1:-1] + g[:, 1:-1, 2:] + g[:, 1:-1, :-2] - 4 * g[:, 1:-1, 1:-1])
    assert np.allclose(dense(wi.log_energy(df, 1.5, dims), BOX.shape), lap / lap.mean())


def expected_maps(v):
    """All maps of a slice by name, each by its definition."""
    h, w = v.shape
    mean = lambda a, k: windowed(a[None], (1, k, k), np.mean)[0]
    out = {"mean": mean(v, 5), "variance": mean(v * v, 5) - mean(v, 5) ** 2}
    gy, gx = np.zeros_like(v), np.zeros_like(v)
    for y, x in np.ndindex(v.shape):
        a, b, c, d = max(y - 1, 0), min(y + 1, h - 1), max(x - 1, 0), min(x + 1, w - 1)
        gy[y, x], gx[y, x] = (v[b, x] - v[a, x]) / (b - a), (v[y, d] - v[y, c]) / (d - c)
    out["gradient"] = np.sqrt(gy**2 + gx**2)
    for s in (3, 5, 7):
        g = smooth(v, (s, s))
        out[f"gauss{s}"] = g
        out[f"log{s}"] = smooth(v, (s, s), (0,)) + smooth(v, (s, s), (1,))
        p, line = np.pad(g, 1, mode="edge"), np.zeros_like(v)
        for y, x in np.ndindex(v.shape):
            q = p[y : y + 3, x : x + 3]
            yx = (q[2, 2] - q[2, 0] - q[0, 2] + q[0, 0]) / 4
            eig = np.linalg.eigvalsh([[q[2, 1] + q[0, 1] - 2 * q[1, 1], yx], [yx, q[1, 2] + q[1, 0] - 2 * q[1, 1]]])
            l1, l2 = sorted(eig, key=abs)
            line[y, x] = np.exp(-((abs(l1) / (abs(l2) + 1e-12)) ** 2) / 0.5) * (1 - np.exp(-(l1**2 + l2**2) / 450))
        out[f"line{s}"] = line
    f = np.fft.fft2(v)
    for name, low, high in (("band", h // 16, h // 6), ("high", h // 8, 1e9), ("low", 0, h // 8)):
        keep = np.zeros(v.shape)
        for y, x in np.ndindex(v.shape):  # frequencies from -n // 2
            r = np.hypot((y + h // 2) % h - h // 2, (x + w // 2) % w - w // 2)
            keep[y, x] = low <= r <= high
        out[name] = np.real(np.fft.ifft2(f * keep))
    for k in (3, 5):
        m, var = np.zeros_like(v), np.zeros_like(v)
        p = np.pad(v, k // 2)
        for y, x in np.ndindex(v.shape):
            q = p[y : y + k, x : x + k]
            m[y, x], var[y, x] = q.mean(), (q * q).mean() - q.mean() ** 2
        noise = var.mean()
        out[f"wiener{k}"] = np.where(var < noise, m, m + (v - m) * (1 - noise / var))
    out["wiener1"] = np.zeros_like(v)
    return out


def test_all_feature_maps_by_name():
    v = RNG.random((17, 20)) * 200
    want, got = expected_maps(v), dict(zip(fe.MAPS, fe.feature_maps(v), strict=True))
    assert want.keys() == got.keys() and len(got) == 18
    for name in want:
        assert np.allclose(got[name], want[name], atol=1e-7), name


def test_feature_bank_and_a_resumed_store(spark, tmp_path):
    v = RNG.random((7, 6, 8)) * 100
    df, dims = volume(spark, v)
    maps = np.stack([fe.feature_maps(s) for s in v])
    bank = lambda rows: fe.feature_bank(rows, dims, 1)
    fresh = {(r.z, r.y, r.x): r.f for r in bank(df).collect()}
    assert len(fresh) == v.size
    for z in range(7):
        slab = maps[z - 1 : z + 2].astype(np.float32).astype(float)
        want = np.concatenate([slab.mean(0), slab.var(0)]) if 0 < z < 6 else np.zeros((36, 6, 8))
        got = np.array([[fresh[z, y, x] for x in range(8)] for y in range(6)]).transpose(2, 0, 1)
        assert np.allclose(got, want, rtol=1e-4, atol=1e-2)
    path = str(tmp_path / "store")
    volumes.ensure_features(spark, df.where("z < 3"), path, bank, 1)
    partly = volumes.ensure_features(spark, df.where("z < 3"), path, bank, 1)
    assert partly.count() == 3 * 48
    store = volumes.ensure_features(spark, df.where("z > 3"), path, bank, 1)  # slabs at the new end are whole where their slices are given
    assert store.count() == 6 * 48
    again = {(r.z, r.y, r.x): r.f for r in volumes.ensure_features(spark, df, str(tmp_path / "two"), bank, 1).collect()}
    first = volumes.ensure_features(spark, df.where("z < 7"), str(tmp_path / "two"), bank, 1)
    assert first.count() == v.size and again == fresh


def test_a_store_resumed_at_a_seam_equals_a_fresh_one(spark, tmp_path):
    v = RNG.random((7, 4, 4)) * 100
    df, dims = volume(spark, v)
    bank = lambda rows: fe.feature_bank(rows, dims, 1)
    fresh = {(r.z, r.y, r.x): list(r.f) for r in bank(df).collect()}
    path = str(tmp_path / "store")
    bank(df).where("z < 3").write.partitionBy("volume_id").parquet(path)  # slices 0 to 2 are stored, and whole
    got = volumes.ensure_features(spark, df, path, bank, 1).collect()
    assert len(got) == v.size and {(r.z, r.y, r.x): list(r.f) for r in got} == fresh


@pytest.mark.parametrize("bins,rest", [(4096, 200_000), (4, 3)])
def test_quantiles_are_exact(spark, bins, rest):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, 7.5], [60, 1, 60]), "c": np.array([3.0]), "d": rng.integers(0, 5, 200).astype(float), "e": rng.lognormal(0, 4, 300)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("a", float("nan")), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q0": 0.0, "q1": 0.1, "q2": 0.5, "q3": 0.937, "q4": 1.0}
    got = {r.g: r for r in px.quantiles(df, ["g"], "v", qs, bins, rest).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        for name, q in qs.items():
            assert np.isclose(got[g][name], np.quantile(v, q), rtol=1e-12, atol=1e-12), (g, q)


def test_ranks_by_ranges_of_values(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 30, 80) / 4, rng.integers(5, 40, 60) / 4
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 1.0), ("a", None)], "g string, v double")
    both = np.concatenate([a, b])
    rank = np.array([(both < x).sum() + ((both == x).sum() + 1) / 2 for x in both])
    u = rank[:80].sum() - 80 * 81 / 2
    for ranges in (4096, 3):
        r = me.mann_whitney(df, "g", "v", "a", "b", ranges).first()
        assert (r.n_a, r.n_b, r.u) == (80, 60, u) and 0 < r.p < 1


# ---- shapes


def test_matching_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    t = rng.random((40, 9)) * [1, 3, 1, 1, 1, 1, 0.3, 0.1, 0.1]
    t[:, 5] = 1
    t[0, 0] = 0.0
    c = t[rng.integers(0, 40, 300)] * rng.uniform(0.6, 1.5, (300, 9))
    c[:, 5] = 1
    row = lambda k, v: ("v", k, int(20 + k % 30), 1 if k % 7 else 0, [float(x) for x in v])
    schema = "volume_id string, label long, size long, euler long, v array<double>"
    cand, temp = spark.createDataFrame([row(k, v) for k, v in enumerate(c)], schema), spark.createDataFrame([row(k, v) for k, v in enumerate(t)], schema)
    sizes = [20 + k % 30 for k in range(40)]
    for threshold, ratio in ((0.7, 1.0), (0.5, 0.5), (0.9, 0.8)):
        tol = 1 - threshold
        want = set()
        for k, v in enumerate(c):
            near = (np.abs(v - t) / (np.abs(t) + 1e-8) <= tol).all(1).any()
            ranged = (np.abs(v - t.mean(0)) < (1 + tol) / 2 * (t.max(0) - t.min(0) + 1e-8)).all()
            if k % 7 and near and ranged and min(sizes) * ratio <= 20 + k % 30 <= max(sizes) / ratio:
                want.add(k)
        got = [r.label for r in ma.match_shapes(cand, temp, threshold, ratio).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (want or threshold == 0.9)


def test_cosines_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 7)) @ np.diag([5, 1, 1, 1, 1, 1, 1]) + [6, 0, 0, 0, 0, 0, 0]
    v[7] = 0
    df = spark.createDataFrame([("v" if k % 2 else "w", k, 5 + k, [float(x) for x in r]) for k, r in enumerate(v)], "volume_id string, label long, size long, v array<double>")
    n = np.linalg.norm(v, axis=1)
    cos = v @ v.T / (n[:, None] * n[None] + 1e-8)
    for least in (0.99, 0.9, 0.3):
        got = {(r.label_a, r.label_b): r.sim for r in ma.hu_similarity(df, df, least).collect()}
        assert got.keys() == {(a, b) for a, b in itertools.product(range(60), repeat=2) if a % 2 == b % 2 and min(1, cos[a, b]) >= least}
        temp = df.where("label % 5 = 0")
        hit = {r.label for r in ma.filter_by_hu(df, temp, least, 0.5).collect()}
        assert hit == {k for k in range(60) if 10 <= 5 + k and cos[k, ::5].max() >= least}


def grid_of(p):
    """The aligned occupancy grid of voxels, each axis towards its longer tail."""
    q = p - p.mean(0)
    vec = np.linalg.eigh(np.cov(q.T))[1][:, ::-1]
    vec = vec * np.where(((q @ vec) ** 3).sum(0) < 0, -1, 1)
    q = q @ vec
    k = np.clip(np.rint((q / np.abs(q).max() + 1) * 31 / 2).astype(int), 0, 31)
    return {tuple(x) for x in k.tolist()}


def test_shapes_3d_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    regions = []
    for k in range(14):
        p = np.unique(np.rint(rng.normal(size=(60 + 5 * k, 3)) * [1 + k % 3, 2, 4]).astype(int), axis=0)
        regions.append(p[:, rng.permutation(3)])
    rows = [("v", *map(int, c), k) for k, p in enumerate(regions) for c in p] + [("v", 0, 0, 0, 99)]
    labels = spark.createDataFrame(rows, VOXEL + ", label long")
    grids = [grid_of(p.astype(float)) for p in regions]
    temp = [k for k in range(14) if k % 3 == 0]
    sizes = [len(regions[k]) for k in temp]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    for t, per in ((0.1, 2048), (0.25, 2)):
        monkeypatch.setattr(ma, "TEMPLATES_PER_PASS", per)
        want = {k for k, p in enumerate(regions) if min(sizes) * 0.5 <= len(p) <= max(sizes) * 2 and max(dice(grids[k], grids[m]) for m in temp) >= t}
        got = ma.filter_by_shape_3d(labels, labels.where("label % 3 = 0 and label < 99"), t)
        assert {r.label for r in got.collect()} == want and want
    part = labels.where("label < 99 and (z + y) % 2 = 0")
    got = {r.label: r.iou for r in ma.pca_iou(labels.where("label < 99"), part).collect()}
    for k, p in enumerate(regions):
        half = grid_of(p[(p[:, 0] + p[:, 1]) % 2 == 0].astype(float))
        assert abs(got[k] - len(grids[k] & half) / len(grids[k] | half)) < 1e-9


def test_hulls_against_every_pixel():
    rng = np.random.default_rng(12)
    for _ in range(30):
        y, x = np.unique(rng.integers(0, 9, (rng.integers(1, 12), 2)), axis=0).T.astype(float)
        mid = np.concatenate([np.stack([y + a, x + b], 1) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
        ways = [np.array([np.cos(a), np.sin(a)]) for a in np.arctan2(*np.array([(p[0] - q[0], p[1] - q[1]) for p in mid for q in mid if tuple(p) != tuple(q)]).T) + np.pi / 2]
        ways = [w[::-1] for w in ways]
        inside = sum(all(np.dot(w, (r, c)) <= max(mid @ w) + 1e-9 for w in ways) for r in range(-1, 11) for c in range(-1, 11))
        assert re_.hull_pixels(y, x) == inside


# ---- edges and jobs

# a line of one pixel around 6 x 6, away from the border (outside of a slice counts as unset)
RING = np.pad(drawn("######## #......# #......# #......# #......# #......# #......# ########"), ((0, 0), (4, 4), (4, 4)))
INNER = {(0, y, x) for y in range(5, 11) for x in range(5, 11)}


def test_interiors_of_closed_lines(spark):
    m, dims = mask(spark, RING)
    assert cells(co.closed_region_fill(m, dims)) == INNER
    gap = RING.copy()
    gap[0, 7, 4] = False  # closed by the closing
    assert cells(co.closed_region_fill(mask(spark, gap)[0], dims)) == INNER
    wide = RING.copy()
    wide[0, 5:11, 11] = False
    assert cells(co.closed_region_fill(mask(spark, wide)[0], dims)) == set()


def test_edge_regions_keep_a_band_of_sizes(spark):
    v = np.where(RING, 0.9, 0.1)
    df, dims = volume(spark, v)
    assert cells(co.edge_regions(df, dims)) == set()  # 28 pixels are under the least size of 100
    assert cells(co.edge_regions(df, dims, lo=28)) == INNER
    assert cells(co.edge_regions(df, dims, lo=5, hi=27)) == set()
    assert cells(co.edge_regions(df.withColumn("value", F.col("value") * 100), dims, lo=5)) == INNER


def test_boxes_of_hollow_lines(spark):
    m, dims = mask(spark, drawn("####...... #......... #......... #.....##.. ......##.. .........."))
    labels = co.label_2d(m, dims)
    hulls = re_.region_solidity(labels)
    box = {(0, y, x) for y in range(4) for x in range(4)}
    assert cells(ma.fill_edge_boxes(labels, hulls, 5, 1.4)) == box
    assert cells(ma.fill_edge_boxes(labels, hulls, 5, 3.0)) == set()
    assert cells(ma.fill_edge_boxes(labels, hulls, 8, 1.4)) == set()


def test_perimeters_of_regions_over_slices(spark):
    area = np.zeros((2, 12, 12), bool)
    line = np.zeros_like(area)
    area[:, 4:7, 4:7] = True
    line[:, 3:8, 3:8] = True  # twice the border
    area[0, 10:12, 0:2] = True
    (a, dims), (b, _) = mask(spark, area), mask(spark, line)
    la, lb = co.label_3d(a, dims), co.label_3d(b, dims)
    p = lambda df: re_.region_perimeter(df, 8).select("volume_id", "label", "perimeter")
    assert {r.perimeter for r in p(lb).collect()} == {32.0}
    assert {r.perimeter for r in p(la).where("label = 52").collect()} == {16.0}
    hit = lambda lo, hi: [r.label for r in ma.filter_by_perimeter_ratio(p(la), p(lb), co.overlap_pairs(la, lb), lo, hi).collect()]
    assert hit(1.8, 2.2) == [52] and hit(2.1, 3.0) == []


def test_a_round_accepts_what_lines_enclose(spark):
    """Two squares score high; a hollow line surrounds one of them, so that one alone is accepted."""
    shape = (1, 30, 60)
    pred = np.full((*shape, 2), 0.1)
    first, second, seed = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, bool)
    first[0, 10:18, 10:18] = second[0, 10:18, 40:48] = seed[0, 2:10, 26:34] = True
    known = np.zeros(shape, bool)
    known[0, 25:28, 2:5] = True
    pred[first | second, 0] = 0.95
    ring = np.zeros(shape, bool)
    ring[0, 8:20, 8:20] = True
    ring[0, 9:19, 9:19] = False
    pred[ring, 1] = 0.8
    rows = [("v", int(z), int(y), int(x), float(pred[z, y, x, 0]), float(pred[z, y, x, 1])) for z, y, x in np.ndindex(shape)]
    df = spark.createDataFrame(rows, VOXEL + ", area double, edge double")
    s, dims = mask(spark, seed)
    none = s.limit(0)
    neg = np.zeros(shape, bool)
    neg[0, 2, 26] = neg[0, 12, 12] = True
    got = jobs.refine_round(df, mask(spark, known)[0], s, none, dims)
    assert cells(got) == at(first | known | seed)
    got = jobs.refine_round(df, mask(spark, known)[0], s, mask(spark, neg)[0], dims)
    assert cells(got) == at((first | known | seed) & ~neg)
    assert cells(jobs.refine_round(df, none, s, none, dims, hull_times=4.0)) == at(seed)
    flat = df.withColumn("edge", F.lit(0.4))
    assert cells(jobs.refine_round(flat, none, s, none, dims)) == at(seed)


def test_labels_are_vetted_by_shape(spark):
    """A bar is not shaped like the square seeds and is withdrawn; squares stay, with the slices they reach through."""
    shape = (3, 24, 24)
    base, seed = np.zeros(shape, bool), np.zeros(shape, bool)
    seed[0, 2:8, 2:8] = True
    base[1, 12:18, 12:18] = True
    base[2, 20:22, 1:23] = True
    (b, dims), (s, _) = mask(spark, base), mask(spark, seed)
    assert cells(jobs.vetted_labels(b, s, dims)) == at(seed) | {(1, y, x) for y in range(12, 18) for x in range(12, 18)}
    seen = []

    def scorer(r):
        seen.append((r.number, cells(r.labels), cells(r.negative), r.line_weight.first().ratio))
        soft = dense(r.soft, shape)
        last = seed & ~(off if r.number else np.zeros(shape, bool))
        d = np.sqrt(np.array([min((np.subtract(p, q) ** 2).sum() for q in zip(*np.nonzero(last))) for p in np.ndindex(shape)]).reshape(shape))
        assert np.allclose(soft, 0.1 * np.maximum(0, 1 / (1 + np.exp(-(d - 6) / 1.0)) - 0.01))
        return r.voxels.select("volume_id", "z", "y", "x", F.lit(0.0).alias("area"), F.lit(0.0).alias("edge"))

    v, _ = volume(spark, np.arange(np.prod(shape), dtype=float).reshape(shape))
    off = np.zeros(shape, bool)
    off[0, 2:4, 2] = True
    negative = mask(spark, off)[0]
    path = tempfile.mkdtemp() + "/rounds"
    got = jobs.propagate_labels(v, s, negative, dims, scorer, path, 2, radius=6.0)
    gone = cells(negative)
    assert [(k, labels, neg) for k, labels, neg, _ in seen] == [(k, at(seed), gone) for k in range(2)]
    assert seen[0][3] == me.line_coefficient(s, dims).first().ratio
    assert cells(got) == at(seed) - gone


def test_rounds_go_on_where_they_ended(spark, monkeypatch):
    """A run that is killed within a round and started again equals an unbroken one; so does one begun at a round. The
    steps of a round are plain stand-ins here."""
    monkeypatch.setattr(jobs, "vetted_labels", lambda base, seed, dims, **_: base.union(seed).distinct())
    monkeypatch.setattr(jobs, "soft_negatives", lambda labels, dims, radius: labels.withColumn("value", F.lit(0.0)))
    monkeypatch.setattr(jobs, "refine_round", lambda pred, base, *_, **__: base.union(pred.where("area > 0.5").select(*base.columns)).distinct())
    rng = np.random.default_rng(4)
    v = rng.random((3, 16, 16)) * 0.3
    v[0, 2:8, 2:8] = v[1, 3:9, 3:9] = v[2, 8:14, 8:14] = 0.9
    df, dims = volume(spark, v)
    s = mask(spark, np.pad(np.ones((1, 6, 6), bool), ((0, 2), (2, 8), (2, 8))))[0]
    calls = []

    def scorer(r, fail=None):
        calls.append(r.number)
        if r.number == fail:
            raise RuntimeError("killed")
        # the circle of light widens with the rounds
        area = F.when(F.col("z") <= r.number, F.col("value")).otherwise(0.0)
        return df.select("volume_id", "z", "y", "x", area.alias("area"), F.lit(0.0).alias("edge"))

    run = lambda path, f=scorer, rounds=2, **more: cells(jobs.propagate_labels(df, s, s.limit(0), dims, f, path, rounds, **more))
    home, folder = tempfile.mkdtemp(), store.shared_dir(spark).removeprefix("file://") + "/stratavox"
    stored = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = stored()
    whole = run(f"{home}/a", rounds=2)
    assert calls == [0, 1] and len(whole) > 36
    path = f"{home}/b"
    with pytest.raises(RuntimeError):
        run(path, lambda r: scorer(r, 1), 2)
    calls.clear()
    assert run(path, rounds=2) == whole and calls == [1]
    assert run(path, rounds=2) == whole and calls == [1]
    assert run(path, rounds=2, start=1) == whole and calls == [1, 1]
    with pytest.raises(ValueError):
        run(f"{home}/c", start=1)
    left = {d for d in stored() - before if d.split("-")[0] in ("vetted", "scores", "soft", "normal", "weights", "labels")}
    assert not left


def test_sketched_quantiles_are_exact(spark):
    """Groups above the bound, brackets from sketches of several accuracies, and passes within them."""
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=4000), "b": rng.integers(0, 40, 3000).astype(float), "c": np.array([5.0]), "d": np.repeat(1.0, 2500)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(6)
    qs = {"q0": 0.0, "q1": 0.003, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    for accuracy, rest in ((10_000, 100), (100, 1000), (50, 60)):
        got = {r.g: r for r in px.quantiles(df, ["g"], "v", qs, 16, rest, accuracy).collect()}
        for g, v in groups.items():
            assert np.allclose([got[g][n] for n in qs], np.quantile(v, list(qs.values())), rtol=1e-12, atol=1e-12)


def test_totals_of_the_matrix(spark):
    rows = [("a", 0, 30, 0.5), ("a", 1, 30, 0.7), ("b", 0, 50, 0.1), ("b", 0, 30, 0.2), (None, 1, 50, 0.9)]
    df = spark.createDataFrame(rows, "model_cell string, data_cell int, ratio int, iou double")
    got = {(r.model_cell, r.ratio): (r["0"], r["1"], r["all"]) for r in me.cross_model_totals(df, [0, 1], ["ratio"]).collect()}
    mean = lambda *v: sum(v) / len(v)
    near = lambda x, y: all(a == b or abs(a - b) < 1e-12 for a, b in zip(x, y))
    assert near(got["all", "all"], (mean(0.5, 0.1, 0.2), mean(0.7, 0.9), mean(0.5, 0.7, 0.1, 0.2, 0.9)))
    assert near(got["b", "30"], (0.2, None, 0.2)) and near(got[None, "all"], (None, 0.9, 0.9)) and near(got["all", "30"], (mean(0.5, 0.2), 0.7, mean(0.5, 0.7, 0.2)))
    assert len(got) == 10


def test_stored_layers_meet_without_an_exchange(spark):
    rng = np.random.default_rng(2)
    v = rng.random((4, 6, 5))
    df, _ = volume(spark, v)
    m = df.where("value > 0.6").select("volume_id", "z", "y", "x")
    names = [volumes.store_layer(rows, f"test_layer_{k}", 4) for k, rows in enumerate((df, df.where("value < 0.8"), m))]
    spark.conf.set(volumes._BY_SLICE, "false")
    plan = volumes.joined_stored(spark, names[0], {"other": names[1]}, {"on": names[2]})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(volumes._BY_SLICE)
    assert plan.count("SortMergeJoin") >= 2 and "Exchange" not in plan
    got = volumes.align_stored(spark, names[0], {"other": names[1]}, {"on": names[2]}).collect()
    assert len(got) == v.size
    for r in got:
        x = v[r.z, r.y, r.x]
        assert r.value == x and r.other == (x if x < 0.8 else None) and r.on == (x > 0.6)
    for n in names:
        spark.sql(f"drop table {n}")


def test_slices_arrive_and_end(spark):
    """Repeats within and across batches count once, state falls when slices end, and late rows change nothing."""
    rng = np.random.default_rng(7)
    truth, pred = rng.random((3, 9, 9)) < 0.5, rng.random((3, 9, 9)) < 0.5
    gt, dims = mask(spark, truth)
    row = lambda z, y, x: (0, "v", z, y, x)
    at = lambda z: [row(z, int(y), int(x)) for y, x in zip(*np.nonzero(pred[z]))]
    batches = [at(0)[:20] + at(0)[:5], at(0)[10:] + at(1)[:9] + [row(1, 99, 0)], [row(0, None, None)] + at(2), at(0)[:7] + [row(0, 0, 0), row(1, None, None)] + at(1), [row(2, None, None), row(0, None, None)]]
    home = tempfile.mkdtemp()
    from stratavox.streaming.iou import prediction_stream, slice_counts, streaming_counts

    states = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run int, volume_id string, z int, y int, x int").coalesce(1).write.parquet(f"{home}/in/{k}")
    stream = prediction_stream(spark, f"{home}/in/*")
    for k in range(len(batches)):  # in order
        os.utime(next(f"{home}/in/{k}/{n}" for n in os.listdir(f"{home}/in/{k}") if n.endswith("parquet") and not n.startswith(".")), (1e9 + k, 1e9 + k))
    query = streaming_counts(gt, stream, dims).writeStream.outputMode("update").foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{home}/out/batch={b}")).option("checkpointLocation", f"{home}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, query.recentProgress) if p["stateOperators"]]
    counts = spark.read.parquet(f"{home}/out")
    got = {r.z: (r.tp, r.fp) for r in slice_counts(counts).collect()}
    assert got == {z: (int((pred[z] & truth[z]).sum()), int((pred[z] & ~truth[z]).sum())) for z in range(3)}
    assert max(states) == 2 and states[-1] <= 1 and states[0] == 1


def test_candidates_of_all_methods(spark):
    area = np.full((1, 24, 24), 0.05)
    area[0, 6:12, 6:12] = 0.9
    area[0, 8:10, 8:10] = 0.2
    edge = np.full_like(area, 0.1)
    edge[0, 4:15, 4:15] = 0.8
    edge[0, 5:14, 5:14] = 0.1
    rows = [("v", 0, y, x, float(area[0, y, x]), float(edge[0, y, x])) for y in range(24) for x in range(24)]
    df, (_, dims) = spark.createDataFrame(rows, VOXEL + ", area double, edge double"), mask(spark, area > 0)
    assert cells(jobs.candidate_mask(df, dims, 0)) == at(area >= max(0.2, np.quantile(area, 0.9)))
    whole = np.zeros_like(area, bool)
    whole[0, 6:12, 6:12] = True
    assert cells(jobs.candidate_mask(df, dims, 2)) == at(whole)
    assert cells(jobs.candidate_mask(df, dims, 1, lo=10)) == at((area > 0.5) & whole)
    assert cells(jobs.candidate_mask(df, dims, 1)) == set()  # no line of 100 pixels


def test_slices_scored_whole(spark):
    df, dims = volume(spark, BOX)
    f = df.select("volume_id", "z", "y", "x", F.array(F.col("value").cast("float")).alias("f"))
    got = dense(scoring.score_slices(f, lambda b: b["features"][..., 0] / 64 - 2, dims, 1, (1, 1, 1)), BOX.shape)
    p = 1 / (1 + np.exp(2 - BOX / 64))
    p[[0, -1]] = 0
    assert np.allclose(got, smooth(p, (1, 1, 1)))


def test_tiles_with_overlaps_and_clamped_origins(spark):
    df, dims = volume(spark, BOX)
    f = df.select("volume_id", "z", "y", "x", F.array("value", F.lit(1.0)).alias("f"))
    scorer = lambda b: b["features"][..., 0] / 64 - b["features"].mean((1, 2, 3))[:, None, None]  # noqa: E731  of the tile
    got = dense(scoring.score_tiles(f, scorer, dims, 4, 3, 1), BOX.shape)
    total, n = np.zeros(BOX.shape), np.zeros(BOX.shape)
    for z in (1, 2):
        for y, x in itertools.product(range(0, 9, 3), range(0, 11, 3)):
            y, x = min(y, 5), min(x, 7)
            t = BOX[z, y : y + 4, x : x + 4]
            total[z, y : y + 4, x : x + 4] += 1 / (1 + np.exp(-(t / 64 - (t.mean() + 1) / 2)))
            n[z, y : y + 4, x : x + 4] += 1
    want = np.where(n > 0, total / np.maximum(n, 1), 0)
    assert np.allclose(got, want)


def test_refined_labels(spark):
    m = RNG.random((2, 17, 19)) < 0.6
    df, dims = mask(spark, m)
    got = cells(co.refine_label(df.withColumn("label", F.lit(2)), 2, dims, 4, 3, 20))
    wide = np.zeros_like(m)
    for z, y, x in np.argwhere(m):
        if y % 4 == 2 and x % 4 == 2:
            wide[z, y // 4 * 4 : y // 4 * 4 + 4, x // 4 * 4 : x // 4 * 4 + 4] = True
    grown = np.zeros_like(m)
    for z, y, x in np.argwhere(wide):
        grown[z, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] = True
    p = np.pad(grown, ((0, 0), (1, 1), (1, 1)))
    closed = np.lib.stride_tricks.sliding_window_view(p, (1, 3, 3)).all((-3, -2, -1))
    want = set()
    for z in range(2):
        left = at(closed[z : z + 1])
        while left:
            todo, region = [left.pop()], set()
            while todo:
                c = todo.pop()
                region.add(c)
                for d in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    if (k := (0, c[1] + d[0], c[2] + d[1])) in left:
                        left.remove(k)
                        todo.append(k)
            if len(region) >= 20:
                want |= {(z, y, x) for _, y, x in region}
    assert got == want


# ---- sampling


def number(key, seed):
    return (key % 2**31 * 2654435761 + seed * 40503) % 2**32


def test_patch_origins_against_the_definition(spark):
    m = RNG.random((6, 12, 14)) < 0.2
    soft = ~m & (RNG.random(m.shape) < 0.5)
    (a, dims), (b, _) = mask(spark, m), mask(spark, soft)
    got = {(r.k, r.z, r.y0, r.x0) for r in sa.sample_patches(a, b, dims, 25, 4, 6, 1, 4.0, 3).collect()}
    extra = max(1, int(0.01 * 4.0 * m.sum()))
    linear = lambda c: (c[0] * 12 + c[1]) * 14 + c[2]
    picks = sorted(at(soft), key=lambda c: (number(linear(c), 3), c))[:extra]
    fits = [c for c in [*sorted(at(m)), *picks] if 1 <= c[0] <= 4 and 2 <= c[1] <= 9 and 3 <= c[2] <= 10]
    want = {(k, (c := fits[k * len(fits) // 25])[0], max(0, min(8, c[1] - 2)), max(0, min(8, c[2] - 3))) for k in range(25)}
    assert got == want


def test_points_and_soft_masks_against_the_definition(spark):
    m = RNG.random((3, 12, 14)) < 0.5
    a, dims = mask(spark, m)
    linear = lambda c: (c[0] * 12 + c[1]) * 14 + c[2]
    z, y, x = min(at(m), key=lambda c: (number(linear(c), 4), c))
    r = sa.sample_point(a, dims, 6, 4, 1, 4).first()
    assert (r.z, r.y, r.x) == (max(1, min(1, z)), max(3, min(8, y)), max(2, min(11, x)))
    gone = set()
    for z in range(3):
        own = [c for c in at(m) if c[0] == z]
        cy, cx = np.mean([c[1] for c in own]), np.mean([c[2] for c in own])
        key = lambda c: -np.log((number(linear(c), 7) + 1) / 4294967297) / np.exp(-0.1 * np.hypot(c[1] - cy, c[2] - cx))  # noqa: B023, E731
        for _, y, x in sorted(own, key=key)[: int(len(own) * 0.1)]:
            gone |= {(z, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    assert cells(sa.soften_mask(a, dims, 0.1, 0.1, 7)) == at(m) - gone


def test_sparse_annotations_by_number_of_regions(spark):
    v = RNG.integers(0, 4, (3, 6, 6)).astype(float)
    df, dims = volume(spark, v)
    whole = co.label_by_bins(px.value_bins(df, 3), dims).count()
    for many in (1, 10_000):
        got = sa.sparse_annotations(df, dims, [30, 95], many=many)
        n = {r.ratio: r["count"] for r in got.groupBy("ratio").count().collect()}
        assert n[95] <= n[30] <= whole
        ids = got.where("ratio = 30").select("label").distinct().count()
        every = co.label_by_bins(px.value_bins(df, 3), dims).select("bin", "label").distinct().count()
        assert ids == (every - int(every * 0.3) if many == 1 else every)


def test_clean_volume_of_a_ball(spark):
    z, y, x = np.ogrid[:6, :12, :12]
    ball = np.exp(-((z - 2.5) ** 2 + (y - 5.5) ** 2 + (x - 5.5) ** 2) / 8)
    df, dims = volume(spark, ball)
    got = dense(jobs.clean_volume(df, dims, 0.4, 8), (12, 12, 12))
    assert got.max() > 1 and got[0, 0, 0] < 0.05
    assert np.unravel_index(got.argmax(), got.shape)[1] in (5, 6)
    assert np.allclose(dense(jobs.clean_volume(df, dims, 2.0, 8), (12, 12, 12)), 0)


def test_moments_do_not_depend_on_partitions(spark):
    """Symmetric and odd regions, far from the origin: whole numbers, so the same bits under any partitioning."""
    rng = np.random.default_rng(11)
    shapes = [[(0, 0), (0, 1), (1, 0), (1, 1)], [(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)], [(y, x) for y in range(9) for x in range(9) if (y - 4) ** 2 + (x - 4) ** 2 < 18], [(y, 0) for y in range(7)] + [(6, x) for x in range(1, 7)]]
    shapes += [[(int(y), int(x)) for y, x in {tuple(p) for p in rng.integers(0, 12, (60, 2))}] for _ in range(6)]
    rows = [("v", 0, 90_000 + y, 70_001 + x, k) for k, cells in enumerate(shapes) for y, x in cells]
    out = []
    for n in (1, 7, 64):
        labels = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, label long").repartition(n)
        out.append([tuple(r) for r in re_.region_moments(labels).orderBy("label").collect()])
    assert out[0] == out[1] == out[2]
    for r, cells in zip(out[0], shapes):
        y, x = (np.array(c, float) for c in zip(*cells))
        m = len(y)
        y, x = y - y.mean(), x - x.mean()
        e = {(p, q): (y**p * x**q).sum() / m ** ((p + q) / 2 + 1) for p in range(4) for q in range(4)}
        a, b, c, d = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3], e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
        want = [e[2, 0] + e[0, 2], (e[2, 0] - e[0, 2]) ** 2 + 4 * e[1, 1] ** 2, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), (e[2, 0] - e[0, 2]) * (a * a - b * b) + 4 * e[1, 1] * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)]
        assert np.allclose(r[-7:], want, rtol=1e-9, atol=1e-15)
    for r in out[0][:3]:  # twofold symmetry: exactly no third moments
        assert r[-5:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert out[0][3][-1] == 0.0 and out[0][3][-3] != 0.0  # symmetry about a diagonal
