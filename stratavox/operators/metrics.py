"""Agreement of masks, metric grids, group statistics and quality scores of stored predictions.

Counts of overlaps come from one grouping over tagged rows with partial aggregation; true negatives are counted, never
listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dot, sigmoid
from ..sources.derived import C
from .morphology import edge_mask
from .pixel import quantiles
from .windows import line

EPS = 1e-8


def overlap_counts(gt: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn) of prediction rows (by, C) against ground truth C; a run without any row does not appear.

    The truth is joined to the predictions by voxel once, whatever the number of runs; misses are its size less the hits.
    """
    truth = gt.select(*C).distinct()
    keys = [b for b in by if b not in C]
    both = pred.select(*keys, *C).join(truth.withColumn("hit", F.lit(1)), C, "left")
    per = both.groupBy(*keys, "volume_id").agg(F.count("hit").alias("tp"), (F.count("*") - F.count("hit")).alias("fp"))
    size = truth.groupBy("volume_id").agg(F.count("*").alias("n"))
    per = per.join(size, "volume_id", "left")
    per = per.select(*keys, "volume_id", "tp", "fp", (F.coalesce("n", F.lit(0)) - F.col("tp")).alias("fn"))
    return per if "volume_id" in by else per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def rates(counts: DataFrame, total: Column) -> DataFrame:
    """iou, fpr and dice from tp, fp, fn and the number of voxels; 0 for two empty masks."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    iou = tp / (tp + fp + fn + F.lit(EPS))
    fpr = fp / (total - tp - fn + F.lit(EPS))
    dice = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return counts.select("*", iou.alias("iou"), fpr.alias("fpr"), dice.alias("dice"))


def iou_fpr(gt: DataFrame, pred: DataFrame, dims: DataFrame, by: list[str]) -> DataFrame:
    """by (with volume_id) and tp, fp, fn, iou, fpr, dice."""
    both = overlap_counts(gt, pred, by).join(dims, "volume_id")
    return rates(both, F.col("d").cast("long") * F.col("h") * F.col("w")).drop("d", "h", "w")


def evaluate_grid(gt: DataFrame, preds: DataFrame, runs: DataFrame, dims: DataFrame, keys: list[str], q: float | None = None, floor: float = 0.5) -> DataFrame:
    """(keys, volume_id, tp, fp, fn, iou, fpr, dice) of every run of a grid such as cell type, organelle, ratio, trial, method.

    runs: (keys, volume_id), the runs there are; one whose prediction has no voxel counts with its misses. preds: (keys, C)
    masks, or (keys, C, value) maps that are cut at their q-quantile or floor, whichever is higher, run by run.
    """
    by = [*keys, "volume_id"]
    if q is not None:
        cut = quantiles(preds, by, "value", {"cut": q})
        preds = preds.join(cut, by).where(F.col("value") >= F.greatest(F.col("cut"), F.lit(floor)))
    counts = overlap_counts(gt, preds, by).drop("fn")
    size = gt.select(*C).distinct().groupBy("volume_id").agg(F.count("*").alias("n"))
    full = runs.select(*by).distinct().join(counts, by, "left").join(size, "volume_id", "left").join(dims, "volume_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = full.select(*by, zero("tp").alias("tp"), zero("fp").alias("fp"), (zero("n") - zero("tp")).alias("fn"), (F.col("d").cast("long") * F.col("h") * F.col("w")).alias("total"))
    return rates(full, F.col("total")).drop("total")


def cross_model_matrix(metrics: DataFrame, columns: list) -> DataFrame:
    """Mean IoU with the model's cell type down and the tested one across."""
    return metrics.groupBy("model_cell").pivot("data_cell", columns).agg(F.avg("iou"))


def cross_model_totals(metrics: DataFrame, columns: list, by: list[str] | None = None, total: str = "all") -> DataFrame:
    """The matrix with totals: rows and a column named `total` hold the mean over all models, over all tested cell types, and
    over both, and, for each further key in `by` (such as the ratio), over all its values.

    One pass over the metrics: the grouping sets of a cube.
    """
    keys = ["model_cell", "data_cell", *(by or [])]
    cells = metrics.cube(*keys).agg(F.avg("iou").alias("iou"), *[F.grouping(k).alias(f"{k}_all") for k in keys])
    named = [F.when(F.col(f"{k}_all") == 1, F.lit(total)).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    down = [k for k in keys if k != "data_cell"]
    return cells.select(*named, "iou").groupBy(*down).pivot("data_cell", [*map(str, columns), total]).agg(F.first("iou"))


def box_summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 interquartile ranges) of each group."""
    both = df.join(quantiles(df, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = both.groupBy(*by, "q1", "median", "q3").agg(F.count(col).alias("n"), F.min(F.when(F.col(col) >= F.col("q1") - reach, F.col(col))).alias("low"), F.max(F.when(F.col(col) <= F.col("q3") + reach, F.col(col))).alias("high"))
    return ends.select(*by, "n", "q1", "median", "q3", "low", "high")


def histogram(df: DataFrame, group: str, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """(group, bin, density): every group's histogram over the pooled range, all bins."""
    v = F.log10(F.col(col) + F.lit(1e-6)) if log else F.col(col)
    rows = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(group).alias("g"), v.alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = rows.join(F.broadcast(ends)).select("g", b.alias("bin"), "lo", "hi").groupBy("g", "bin", "lo", "hi").agg(F.count("*").alias("n"))
    total = counts.groupBy("g", "lo", "hi").agg(F.sum("n").alias("all")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = total.join(counts.select("g", "bin", "n"), ["g", "bin"], "left")
    return full.select(F.col("g").alias(group), "bin", (F.coalesce("n", F.lit(0)) * bins / (F.col("all") * (F.col("hi") - F.col("lo")))).alias("density"))


def histogram_correlation(df: DataFrame, group: str, col: str, bins: int = 50, log: bool = False) -> DataFrame:
    """(group_a, group_b, r): Pearson correlations of the groups' histograms."""
    h = histogram(df, group, col, bins, log)
    a = h.select(F.col(group).alias("group_a"), "bin", F.col("density").alias("da"))
    b = h.select(F.col(group).alias("group_b"), "bin", F.col("density").alias("db"))
    return a.join(b, "bin").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.corr("da", "db").alias("r"))


def normal_tail(z: Column) -> Column:
    """P(|N| > z) by a rational approximation of erfc, good to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, group: str, col: str, a: str, b: str, ranges: int = 4096) -> DataFrame:
    """(n_a, n_b, u, p): two-sided, tie-corrected normal approximation with continuity correction; null and NaN dropped.

    Ranks come from counts of distinct values, by `ranges` ranges of values first and then within a range.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    counts = rows.groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.when(F.col(group) == a, 1)).alias("ca"), F.count(F.when(F.col(group) == b, 1)).alias("cb"))
    counts = counts.withColumn("t", F.col("ca") + F.col("cb"))
    ends = rows.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * ranges)).otherwise(0)
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("span", span)
    totals = counts.groupBy("span").agg(F.sum("t").alias("all"))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of values
    totals = totals.select("span", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("span").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("in", F.coalesce(F.sum("t").over(inside), F.lit(0))).join(totals, "span")
    ranked = ranked.select("ca", "cb", "t", (F.col("before") + F.col("in")).alias("below"))
    rank = F.col("below") + (F.col("t") + 1) / 2
    s = ranked.agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), F.sum(F.col("ca") * rank).alias("ra"), F.sum((F.col("t") ** 3 - F.col("t"))).alias("ties"))
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    s = s.select("n_a", "n_b", (F.col("ra") - na * (na + 1) / 2).alias("u"), (F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))).alias("sd"))
    z = F.greatest(F.lit(0.0), F.abs(F.col("u") - F.col("n_a") * F.col("n_b") / 2) - 0.5) / F.col("sd")
    return s.select("n_a", "n_b", "u", normal_tail(z).alias("p"))


def mean_diff_direction(features: DataFrame, pos: Column, neg: Column, col: str = "f", relu: bool = False) -> list[float]:
    """Unit vector from the mean of the negative to the mean of the positive rows; an error if either has none.

    One partially aggregated row for every feature; the vector is as long as a row's features.
    """
    rows = features.where(pos | neg).select(F.when(pos, 1).otherwise(0).alias("s"), F.posexplode(col).alias("k", "v"))
    means = rows.groupBy("k").agg(F.avg(F.when(F.col("s") == 1, F.col("v").cast("double"))).alias("p"), F.avg(F.when(F.col("s") == 0, F.col("v").cast("double"))).alias("n")).orderBy("k").collect()
    if not means or any(r["p"] is None or r["n"] is None for r in means):
        raise ValueError("positive or negative rows are missing")
    w = [r["p"] - r["n"] for r in means]
    w = [max(0.0, x) for x in w] if relu else w
    length = sum(x * x for x in w) ** 0.5 + EPS
    return [x / length for x in w]


def mean_diff_projection(features: DataFrame, key: str, pos: Column, neg: Column, col: str = "f", relu: bool = False) -> DataFrame:
    """(key, p): projections on the mean-difference direction, scaled to 0..1."""
    w = mean_diff_direction(features, pos, neg, col, relu)
    p = features.select(key, dot(F.col(col), F.array(*[F.lit(x) for x in w])).alias("p"))
    ends = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return p.join(F.broadcast(ends)).select(key, ((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(EPS))).alias("p"))


def line_coefficient(mask: DataFrame, dims: DataFrame, width: int = 1) -> DataFrame:
    """(volume_id, ratio): 1.2 times the voxels of the edge band over those of the mask."""
    e = edge_mask(mask, width, dims).groupBy("volume_id").agg(F.count("*").alias("e"))
    m = mask.groupBy("volume_id").agg(F.count("*").alias("m"))
    return m.join(e, "volume_id", "left").select("volume_id", (1.2 * F.coalesce("e", F.lit(0)) / F.col("m")).alias("ratio"))


def _local_zero(df: DataFrame, win: int = 3) -> DataFrame:
    """mean and var of img over a window of a slice with zeros outside, var at least 1e-6."""
    r = win // 2
    both = df.select(*C, "logit", F.col("img").alias("s"), (F.col("img") * F.col("img")).alias("s2"))
    for a in ("y", "x"):
        w = line(a, r, r)
        both = both.select(*C, "logit", F.sum("s").over(w).alias("s"), F.sum("s2").over(w).alias("s2"))
    m = F.col("s") / (win * win)
    return both.select(*C, sigmoid(F.col("logit")).alias("p"), m.alias("mean"), F.greatest(F.lit(1e-6), F.col("s2") / (win * win) - m * m).alias("var"))


def region_consistency(df: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(volume_id, z, score) of rows (C, logit, img): weighted variance of the local mean and of the local variance.

    From weighted first and second moments: one grouping.
    """
    t = _local_zero(df).groupBy("volume_id", "z").agg(F.sum("p").alias("w"), *[F.sum(F.col("p") * F.col(c)).alias(f"{c}1") for c in ("mean", "var")], *[F.sum(F.col("p") * F.col(c) ** 2).alias(f"{c}2") for c in ("mean", "var")])
    w = F.col("w") + F.lit(1e-6)
    share = F.col("w") / w

    def spread(c: str) -> Column:
        mu = F.col(f"{c}1") / w
        return F.col(f"{c}2") / w - 2 * mu * F.col(f"{c}1") / w + mu * mu * share

    return t.select("volume_id", "z", ((1 - alpha) * spread("var") + alpha * spread("mean")).alias("score"))


def region_contrast(df: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(volume_id, z, score): how far local mean and variance differ between foreground and background; lower is better."""
    t = _local_zero(df)
    p, q = F.col("p"), 1 - F.col("p")
    t = t.groupBy("volume_id", "z").agg(F.sum(p).alias("f"), F.sum(q).alias("b"), *[F.sum(F.col(c) * x).alias(f"{c}{n}") for c in ("mean", "var") for n, x in (("f", p), ("b", q))])
    part = lambda c: F.abs(F.col(f"{c}f") / (F.col("f") + F.lit(1e-6)) - F.col(f"{c}b") / (F.col("b") + F.lit(1e-6)))
    return t.select("volume_id", "z", (-((1 - alpha) * part("var") + alpha * part("mean"))).alias("score"))


def supervision_weights(dense: DataFrame, target: DataFrame, negative: DataFrame, rings: DataFrame) -> DataFrame:
    """(C, weight): 1 on negatives, then 1 on the target, 0 on its inner ring, 1 on the outer ring, else the soft value.

    dense: (C, soft) over the grid; rings: dilated_rings of the target.
    """
    tag = lambda df, k: df.select(*C, F.lit(k).alias("k"))
    marks = tag(negative, 4).unionByName(tag(target, 3)).unionByName(tag(rings.where("ring = 'inner'"), 2)).unionByName(tag(rings.where("ring = 'outer'"), 1))
    rows = dense.select(*C, F.lit(None).cast("int").alias("k"), "soft", F.lit(1).alias("here"))
    rows = rows.unionByName(marks.select(*C, "k", F.lit(None).cast("double").alias("soft"), F.lit(None).cast("int").alias("here")))
    rows = rows.groupBy(*C).agg(F.max("k").alias("k"), F.max("soft").alias("soft"), F.max("here").alias("here")).where("here = 1")
    w = F.when(F.col("k") == 2, 0.0).when(F.col("k").isNotNull(), 1.0).otherwise(F.col("soft"))
    return rows.select(*C, w.alias("weight"))


def bce_with_logits(x: Column, t: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def weighted_bce(rows: DataFrame) -> DataFrame:
    """(volume_id, z, score): mean weighted cross-entropy of (C, logit, target, weight) less the mean probability on the target."""
    x, t = F.col("logit"), F.col("target").cast("double")
    return rows.groupBy("volume_id", "z").agg((F.avg(F.col("weight") * bce_with_logits(x, t)) - F.avg(sigmoid(x) * t)).alias("score"))


def edge_local_bce(rows: DataFrame, near_edge: DataFrame) -> DataFrame:
    """Cross-entropy counted only near the edge (voxels near_edge), averaged over the slice."""
    one = near_edge.select(*C).distinct().withColumn("one", F.lit(1.0))
    both = rows.join(one, C, "left")
    return both.groupBy("volume_id", "z").agg(F.avg(F.coalesce("one", F.lit(0.0)) * bce_with_logits(F.col("logit"), F.col("target").cast("double"))).alias("score"))


def smoothness_score(df: DataFrame) -> DataFrame:
    """(volume_id, z, score): mean of (1 - exp(-|image step|)) * |prediction step| in x and y of rows (C, logit, img)."""
    rows = df.select(*C, "img", sigmoid(F.col("logit")).alias("p"))
    for a, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("volume_id", "z", other).orderBy(a)
        di, dp = F.abs(F.lead("img").over(w) - F.col("img")), F.abs(F.lead("p").over(w) - F.col("p"))
        rows = rows.withColumn(f"t{a}", F.coalesce((1 - F.exp(-di)) * dp, F.lit(0.0)))
    return rows.groupBy("volume_id", "z").agg(F.avg(F.col("tx") + F.col("ty")).alias("score"))


def correlation_score(df: DataFrame) -> DataFrame:
    """(volume_id, z, score): 1 - correlation of the columns a and b, with 1e-6 in the denominator."""
    s = df.groupBy("volume_id", "z").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") ** 2), ("bb", F.col("b") ** 2), ("ab", F.col("a") * F.col("b")))])
    cov = lambda x, y, xy: F.col(xy) - F.col(x) * F.col(y) / F.col("n")
    root = F.sqrt(F.greatest(F.lit(0.0), cov("a", "a", "aa"))) * F.sqrt(F.greatest(F.lit(0.0), cov("b", "b", "bb")))
    return s.select("volume_id", "z", (1 - cov("a", "b", "ab") / (root + F.lit(1e-6))).alias("score"))
