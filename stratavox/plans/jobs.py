"""Jobs: label fusion and propagation rounds, texture masks and clean volumes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import edge_regions, fill_holes, filter_by_line_overlap, intersect_regions, label_2d, label_3d, refine_label, relabel_by_priority, remove_small
from ..operators.features import distance_map, distance_weight
from ..operators.matching import filter_by_shape, fill_edge_boxes
from ..operators.metrics import line_coefficient
from ..operators.morphology import dilate, mask_except, mask_union
from ..operators.pixel import apply_mask, percentile_threshold, quantiles, resample_z
from ..operators.regions import region_solidity, shape_vectors
from ..operators.windows import gaussian_smooth, local_contrast_normalize, mode_filter
from ..sources.derived import C
from ..sources.store import passing_tables, removed, written
from ..sources.volumes import write_labels
from .scoring import cluster_voxels


def fuse_labels(new: DataFrame, base: DataFrame, seed: DataFrame, negative: DataFrame) -> DataFrame:
    """new and base and seed together, without the negatives."""
    return mask_except(mask_union(mask_union(new, base), seed), negative)


def candidate_mask(pred: DataFrame, dims: DataFrame, method: int = 2, q: float = 0.9, **edges) -> DataFrame:
    """Candidates of (C, area, edge): 0: area above its quantile or 0.2; 1: those that meet a region closed by the edges
    (edges: see edge_regions); 2: area above its quantile or 0.5, holes filled."""
    area = pred.select(*C, F.col("area").alias("value"))
    if method == 0:
        return percentile_threshold(area, q, 0.2)
    high = percentile_threshold(area, q, 0.5)
    if method == 2:
        return fill_holes(high, dims)
    closed = edge_regions(pred.select(*C, F.col("edge").alias("value")), dims, **edges)
    return intersect_regions(closed, written(label_3d(high, dims, 6), "high"), 0.01)


def seed_templates(seed: DataFrame, dims: DataFrame) -> DataFrame:
    """The shapes of the seed's slice regions."""
    return written(shape_vectors(written(label_2d(seed, dims), "seeds"), dims), "templates")


def shaped_like(mask: DataFrame, seed: DataFrame, dims: DataFrame, threshold: float, min_ratio: float, max_height: int, templates: DataFrame | None = None) -> DataFrame:
    """The mask's regions that are shaped like the seed's slice regions; whole 3-D components for max_height > 5.
    templates: seed_templates, where they are known already."""
    labels = written(label_2d(mask, dims), "regions")
    templates = seed_templates(seed, dims) if templates is None else templates
    return filter_by_shape(labels, written(shape_vectors(labels, dims), "vectors"), templates, threshold, min_ratio, dims, max_height)


def vetted_labels(base: DataFrame, seed: DataFrame, dims: DataFrame, threshold: float = 0.5, max_height: int = 10, templates: DataFrame | None = None) -> DataFrame:
    """What a round learns from: the last round's labels as far as they are shaped like the seed, and the seed itself."""
    return mask_union(shaped_like(base, seed, dims, threshold, 0.8, max_height, templates), seed)


def refine_round(pred: DataFrame, base: DataFrame, seed: DataFrame, negative: DataFrame, dims: DataFrame, method: int = 2, threshold: float = 0.5, min_ratio: float = 1.0, max_height: int = 10, line: float = 0.5, min_line: int = 5, hull_times: float = 3.0, line_share: float = 0.6, templates: DataFrame | None = None, **edges) -> DataFrame:
    """One round: candidates shaped like the seed's regions are accepted where the boxes of hollow edge lines (edge above
    `line`, at least min_line pixels, a hull of hull_times their size) cover a share of at least line_share of them, and
    fused with what is known."""
    shaped = shaped_like(candidate_mask(pred, dims, method, **edges), seed, dims, threshold, min_ratio, max_height, templates)
    lines = written(label_2d(pred.where(F.col("edge") > line).select(*C), dims), "lines")
    boxes = fill_edge_boxes(lines, region_solidity(lines), min_line, hull_times)
    accepted = filter_by_line_overlap(written(label_2d(shaped, dims), "shaped"), boxes, line_share)
    return fuse_labels(accepted, base, seed, negative)


def soft_negatives(labels: DataFrame, dims: DataFrame, radius: float = 30.0) -> DataFrame:
    """(C, value): weights of what is far from the labels."""
    return distance_weight(distance_map(labels, dims), radius)


@dataclass
class Round:
    """What a model learns a round from: normalised voxels (C, value), vetted labels and negatives (C), the weights of soft
    negatives (C, value), and each volume's weight of lines (volume_id, ratio)."""

    number: int
    voxels: DataFrame
    labels: DataFrame
    negative: DataFrame
    soft: DataFrame
    line_weight: DataFrame


def _finished(spark: SparkSession, path: str) -> int:
    """Rounds that ended, from the first on, by their markers beside path."""
    try:
        rows = spark.read.schema("round int").json(f"{path}-rounds").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    done = {r["round"] for r in rows}
    return next(k for k in range(len(done) + 1) if k not in done)


def propagate_labels(voxels: DataFrame, seed: DataFrame, negative: DataFrame, dims: DataFrame, scorer: Callable[[Round], DataFrame], path: str, rounds: int = 5, max_height: int = 10, radius: float = 200.0, start: int | None = None, **params) -> DataFrame:
    """Rounds of refinement, each reading what the last one wrote under path; the last round's labels.

    scorer(Round) gives predictions (C, area, edge): this is where a model trains. A round that ends leaves a marker; a run
    that is started again goes on after the last round that ended (or from round `start` on, writing it and those after
    it anew). The tables that led to a round's labels are removed when these are written.
    """
    spark = voxels.sparkSession
    done = _finished(spark, path)
    first = min(done, rounds) if start is None else start
    if not 0 <= first <= done:
        raise ValueError(f"round {first} needs the labels of the round before it; {done} have ended")
    of = lambda k: spark.read.parquet(path).where(F.col("iteration") == k).select(*C) if k >= 0 else seed.select(*C)
    if first < done:  # what was written after it is void
        removed(spark, f"{path}-rounds")
        for k in range(first):
            spark.createDataFrame([(k,)], "round int").write.mode("append").json(f"{path}-rounds")
    with passing_tables(spark):
        normal = written(local_contrast_normalize(voxels, dims), "normal") if first < rounds else None
        templates = seed_templates(seed, dims) if first < rounds else None
        for k in range(first, rounds):
            with passing_tables(spark):
                labels = written(of(k - 1), "labels")
                vetted = written(vetted_labels(labels, seed, dims, max_height=max_height, templates=templates), "vetted")
                soft = written(soft_negatives(labels, dims, radius), "soft")
                weight = written(line_coefficient(vetted, dims), "weights")
                pred = written(scorer(Round(k, normal, vetted, negative, soft, weight)), "scores")
                write_labels(refine_round(pred, labels, seed, negative, dims, max_height=max_height, templates=templates, **params), path, k)
            spark.createDataFrame([(k,)], "round int").write.mode("append").json(f"{path}-rounds")
    return of(rounds - 1)


def texture_mask(features: DataFrame, voxels: DataFrame, dims: DataFrame, box: tuple, k: int = 3, w: int = 3, grow: int = 3, seed: int = 1) -> DataFrame:
    """Cluster the features, number clusters by frequency in the box, smooth by majority, refine those that are not the
    most frequent there, dilate, and keep the volume inside."""
    labels = mode_filter(relabel_by_priority(cluster_voxels(features, k, seed), *box), list(range(k)), w, dims)
    other = labels.select(*C, (F.col("label") != 0).cast("int").alias("label"))
    return apply_mask(voxels, dilate(refine_label(other, 1, dims), (1, grow, grow), dims))


def clean_volume(pred: DataFrame, dims: DataFrame, threshold: float | None = None, min_voxels: int = 8, factor: float = 2.0, sigma: tuple = (1, 1, 1)) -> DataFrame:
    """(C, value): resample z, smooth, threshold (strictly; the 90th percentile if None), drop small components, and
    smooth the distance inside what is left."""
    fine = written(resample_z(pred, factor, dims=dims), "fine")
    deep = fine.groupBy("volume_id").agg((F.max("z") + 1).cast("int").alias("d"))
    sizes = written(dims.drop("d").join(deep, "volume_id").select("volume_id", "d", "h", "w"), "sizes")
    smooth = written(gaussian_smooth(fine, sigma, sizes), "smooth")
    if threshold is None:
        mask = smooth.join(quantiles(smooth, ["volume_id"], "value", {"cut": 0.9}), "volume_id").where(F.col("value") > F.col("cut")).select(*C)
    else:
        mask = smooth.where(F.col("value") > threshold).select(*C)
    kept = remove_small(written(label_3d(mask, sizes, 6), "parts"), min_voxels)
    inner = distance_map(kept, sizes, inside=True)
    return gaussian_smooth(inner.na.fill(0.0, ["value"]), sigma, sizes)
