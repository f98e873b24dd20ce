"""Quality rules with an isolation forest on rule statistics.

Counts of every whole text (words, symbols, repeated lines, words in repeated 5-word windows) become statistics in three
groups: marks, repeats and length. Isolation trees of each group, grown by random splits on few rows each, give short
paths to anomalous documents; each group's threshold on the anomaly score is calibrated from labelled rows, and a
document that passes none of them too far is kept. Statistics of different groups vary independently among good texts,
so one forest over all would hide what is odd in one of them (README has figures).

The counts are one pass over the texts, written to the shared folder (a few numbers a document). Isolation needs trees of
few rows, so every row that passes the base rule grows a tree: all of them are dealt to trees of about `points` rows, and
the number of trees goes with the table. Splits lie on a grid of `bins` equal steps a statistic, so paths are the same
within a cell of it, and the sum over all trees is one number a cell, whatever the table's size. Thresholds come from the
counts of all labelled rows by score, exactly. No row is left out of either.

Defined cases: a null or empty text has no words and fails the base rule; without labelled rows of both kinds the
thresholds are quantiles of all rows that pass the base rule (`contamination` in all); an empty table gives an empty
result; repeated rows grow trees and are scored each, also under null ids; extra columns are ignored. Forests
depend on neither ids nor partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch, written
from . import text as tx

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forests split on, from COUNTS. Shares near 0 are spread by a logarithm.
GROUPS = {"marks": ("symbols", "word_length"), "repeats": ("dup_lines", "repeat_words"), "length": ("length",)}


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offs])


def slice_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS (columns) of the texts (rows) of a slice."""
    starts, ends, bounds = tx.words(data, offs)
    out = np.zeros((len(offs) - 1, len(COUNTS)), np.int64)
    space = tx._SPACE[data]
    out[:, 0] = np.diff(bounds)
    out[:, 1] = per_text(~space & ((data & 0xC0) != 0x80), offs)
    out[:, 2] = per_text(_SYMBOL[data], offs)
    ls, le, lb = tx.runs(data != 10, offs)
    worded = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
    ls, le = ls[worded], le[worded]
    lb = np.concatenate(([0], np.cumsum(worded)))[lb]
    lines = tx.span_hashes(data, ls, le)
    h = tx.span_hashes(data, starts, ends)
    win = tx.windows(h, WINDOW)
    for k in range(len(offs) - 1):
        a, b = int(lb[k]), int(lb[k + 1])
        if b - a > 1:
            out[k, 3] = b - a - len(np.unique(lines[a:b]))
        a, b = int(bounds[k]), int(bounds[k + 1])
        if b - a > WINDOW:
            w = win[a : b - WINDOW + 1]
            s = np.sort(w)
            twice = s[1:][s[1:] == s[:-1]]
            if len(twice):
                at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w)
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + WINDOW, -1)
                out[k, 4] = int((np.cumsum(cover)[:-1] > 0).sum())
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                c = slice_counts(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios(c: dict[str, np.ndarray], group: str) -> np.ndarray:
    """The statistics (columns) of a group for rows of counts."""
    n = np.maximum(c["n_words"], 1)
    share = lambda k: np.log1p(20 * c[k] / n)
    take = {
        "symbols": lambda: share("n_symbols"),
        "word_length": lambda: np.log(np.maximum(c["word_chars"], 1) / n),
        "dup_lines": lambda: share("n_dup_lines"),
        "repeat_words": lambda: share("n_repeat_words"),
        "length": lambda: np.log(n),
    }
    return np.stack([take[k]() for k in GROUPS[group]], 1)


@dataclass
class Forest:
    """trees: rows (feature or -1, split value, left child or path length); threshold: scores above it are rejected."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    norm: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, value, link in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = link[k].astype(np.int64) + (x[inner, f[inner]] >= value[k])
            depth += link[at]
        return 2.0 ** (-depth / max(1, len(self.trees)) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = 400, points: int = 32, seed: int = 11) -> Forest:
    rng = np.random.Generator(np.random.PCG64(seed))
    points = min(points, len(x))
    limit = int(np.ceil(np.log2(max(2, points))))
    out = []
    for _ in range(trees):
        feature, value, link = [-1], [0.0], [0.0]
        todo = [(0, x[rng.choice(len(x), points, replace=False)] if len(x) else x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            split = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(split):
                link[at] = depth + _expected(len(rows))
                continue
            f = int(rng.choice(split))
            v = float(rng.uniform(low[f], high[f]))
            feature[at], value[at], link[at] = f, v, float(len(feature))
            for side in (rows[rows[:, f] < v], rows[rows[:, f] >= v]):
                todo.append((len(feature), side, depth + 1))
                feature.append(-1)
                value.append(0.0)
                link.append(0.0)
        out.append((np.array(feature), np.array(value), np.array(link)))
    return Forest(out, max(_expected(points), 1e-9))


@dataclass
class Cells:
    """All trees of a group by cells. paths: mean path length in each cell; a statistic's bins have width `step` from
    `least` on."""

    paths: np.ndarray
    least: np.ndarray
    step: np.ndarray
    norm: float
    trees: int
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.paths[tuple(binned(x, self.least, self.step, len(self.paths)).T)] / self.norm)


def binned(x: np.ndarray, least: np.ndarray, step: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(np.floor((x - least) / step), 0, bins - 1).astype(np.int64)


def leaves(x: np.ndarray, tree: np.ndarray, bins: int, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bins, end bins, path length) of the leaves of all trees. x: bins (columns) of rows in order of their tree.

    A split depends on the tree's number and on the least and greatest bins of a node's rows alone.
    """
    first = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
    node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tree))))
    key = tx.mix(tx.mix(tree[first].astype(np.uint64)) ^ np.uint64(seed))
    low_end, high_end = np.zeros((len(first), x.shape[1]), np.int64), np.full((len(first), x.shape[1]), bins)
    out = []
    for depth in range(limit + 1):
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        rows = np.diff(np.append(first, len(x)))
        open_ = high > low
        inner = open_.any(1) & (depth < limit)
        out.append((low_end[~inner], high_end[~inner], depth + np.array([_expected(n) for n in rows[~inner].tolist()])))
        if not inner.any():
            break
        unit = lambda k: (tx.mix(key + np.uint64(k)) >> np.uint64(11)) / float(1 << 53)  # noqa: B023, E731
        f = np.argmax(np.cumsum(open_, 1) > np.floor(unit(1) * open_.sum(1))[:, None], 1)
        at = np.arange(len(f))
        cut = low[at, f] + 1 + np.floor(unit(2) * (high[at, f] - low[at, f])).astype(np.int64)
        x, node = x[inner[node]], node[inner[node]]
        child = 2 * node + (x[np.arange(len(x)), f[node]] >= cut[node])
        order = np.argsort(child, kind="stable")
        x, child = x[order], child[order]
        first = np.flatnonzero(np.diff(child, prepend=-1))
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(child))))
        parent, right = child[first] // 2, child[first] % 2 == 1
        low_end, high_end = low_end[parent], high_end[parent]
        at, f, cut = np.arange(len(parent)), f[parent], cut[parent]
        low_end[at[right], f[right]] = cut[right]
        high_end[at[~right], f[~right]] = cut[~right]
        key = tx.mix(2 * key[parent] + right.astype(np.uint64))
    return tuple(map(np.concatenate, zip(*out)))


#: Path lengths are summed as whole numbers of this part, so sums do not depend on their order.
_PART = 1_000_000


def add_leaves(corners: np.ndarray, low_end: np.ndarray, high_end: np.ndarray, path: np.ndarray) -> None:
    """Add path lengths to the cells of leaves, kept as differences: the cells are cumulative sums along all axes."""
    whole = np.rint(path * _PART).astype(np.int64)
    for ends in itertools.product((0, 1), repeat=corners.ndim):
        np.add.at(corners, tuple(np.where(e, high_end[:, k], low_end[:, k]) for k, e in enumerate(ends)), whole * (-1) ** sum(ends))


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in COUNTS}


def _bounds(rows: DataFrame) -> tuple[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The number of rows, and each group's least and greatest statistics."""
    names = [f"{g}_{k}" for g, of in GROUPS.items() for k in of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.concatenate([ratios(_counts(batch), g) for g in GROUPS], 1)
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], **{f"low_{c}": [v] for c, v in zip(names, x.min(0))}, **{f"high_{c}": [v] for c, v in zip(names, x.max(0))}})

    ends = [f"{end}_{c}" for end in ("low", "high") for c in names]
    found = rows.select(*COUNTS).mapInArrow(run, "n long, " + ", ".join(f"{c} double" for c in ends))
    row = found.agg(F.sum("n").alias("n"), *((F.min if c.startswith("low_") else F.max)(c).alias(c) for c in ends)).first()
    take = lambda end, g: np.array([row[f"{end}_{g}_{k}"] or 0.0 for k in GROUPS[g]])
    return row.n or 0, {g: (take("low", g), take("high", g)) for g in GROUPS}


#: Copies of equal counts are numbered in pieces of so many.
_PIECE = 4096


def grow_all(rows: DataFrame, trees: int = 400, points: int = 32, seed: int = 11, bins: int = 512) -> dict[str, Cells]:
    """A forest a group from all rows (COUNTS): each grows one tree of about `points` rows, or as many as it takes to
    have `trees` of them."""
    n, bounds = _bounds(rows)
    total = max(trees, -(-n // points))
    each = min(total, max(1, -(-total * points // max(1, n))))
    limit = int(np.ceil(np.log2(max(2, min(points, n)))))
    least = {g: low for g, (low, _) in bounds.items()}
    step = {g: np.where(high > low, (high - low) / bins, 1.0) for g, (low, high) in bounds.items()}
    names = list(GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corners = [np.zeros((bins + 1,) * len(GROUPS[g]), np.int64) for g in names]
        grown, rest = 0, None
        for batch in itertools.chain(batches, [None]):  # a last round for the last tree
            if batch is not None and not batch.num_rows:
                continue
            table = [t for t in (rest, batch) if t is not None]
            if not table:
                return
            whole = pa.Table.from_batches(table).combine_chunks().to_batches()[0]
            tree = whole.column(whole.num_columns - 1).to_numpy()
            end = int(np.searchsorted(tree, tree[-1])) if batch is not None else len(tree)
            rest, whole, tree = whole.slice(end), whole.slice(0, end), tree[:end]
            if not end:
                continue
            grown += len(np.unique(tree))
            for k, g in enumerate(names):
                x = binned(ratios(_counts(whole), g), least[g], step[g], bins)
                add_leaves(corners[k], *leaves(x, tree, bins, limit, seed + k))
        for k, at in enumerate(corners):
            flat = at.ravel()
            cell = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(flat[cell])], ["forest", "cell", "path"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([grown], pa.int64())], ["forest", "cell", "path"])

    # equal counts are numbered, so that copies spread over the trees like other rows
    dealt = rows.groupBy(*COUNTS).agg(F.count("*").alias("copies"))
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {_PIECE}"))))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("piece") * _PIECE, F.least("copies", (F.col("piece") + 1) * _PIECE) - 1)))
    tree = F.pmod(F.xxhash64(*COUNTS, "copy", F.lit(seed)), F.lit(total))
    dealt = dealt.select(*COUNTS, tree.alias("tree"))
    if each > 1:
        dealt = dealt.select(*COUNTS, "tree", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")).select(*COUNTS, F.pmod(F.col("tree") + F.col("k"), F.lit(total)).cast("long").alias("tree"))
    dealt = dealt.select(*COUNTS, F.col("tree").cast("long").alias("tree")).repartition("tree").sortWithinPartitions("tree")
    # at most (bins + 1) ** 2 cells a group, whatever the number of rows
    found = dealt.mapInArrow(run, "forest int, cell long, path long").groupBy("forest", "cell").agg(F.sum("path").alias("path")).toPandas()
    grown = int(found.path[found.forest == -1].sum())
    out = {}
    for k, g in enumerate(names):
        mine = found[found.forest == k]
        cells = np.zeros((bins + 1) ** len(GROUPS[g]), np.int64)
        cells[mine.cell.to_numpy()] = mine.path.to_numpy()
        cells = cells.reshape((bins + 1,) * len(GROUPS[g]))
        for axis in range(cells.ndim):
            cells = np.cumsum(cells, axis)
        cells = cells[(slice(0, bins),) * cells.ndim]
        out[g] = Cells(cells / _PART / max(1, grown), least[g], step[g], max(_expected(min(points, n)), 1e-9), grown)
    return out


def calibrate(scores: np.ndarray, good: np.ndarray, max_loss: float, rows: np.ndarray | None = None) -> float:
    """The threshold that rejects most labelled bad rows while rejecting at most max_loss of the good ones. rows: how many
    rows each entry stands for."""
    rows = np.ones(len(scores), np.int64) if rows is None else rows
    order = np.argsort(scores, kind="stable")
    scores, good, rows = scores[order], good[order], rows[order]
    g, b = np.cumsum(rows * good), np.cumsum(rows * ~good)
    rank = min(int(g[-1]), max(1, int(np.ceil(g[-1] * (1 - max_loss))) if max_loss > 0 else int(g[-1])))
    floor = scores[np.searchsorted(g, rank)]
    options = np.unique(scores[scores >= floor])
    at = np.searchsorted(scores, options, "right") - 1
    return float(options[np.argmax((b[-1] - b[at]) / b[-1] - (g[-1] - g[at]) / g[-1])])


def quantile(scores: np.ndarray, rows: np.ndarray, q: float) -> float:
    """As np.quantile, of scores that stand for some rows each."""
    order = np.argsort(scores, kind="stable")
    scores, upto = scores[order], np.cumsum(rows[order])
    at = q * (upto[-1] - 1)
    low, high = (scores[np.searchsorted(upto, k, "right")] for k in (np.floor(at), np.ceil(at)))
    return float(low + (high - low) * (at - np.floor(at)))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None, trees: int = 400, points: int = 32, max_loss: float = 0.003, contamination: float = 0.02, seed: int = 11, bins: int = 512) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly_<group> (0 to 1) and kept for every document. labels: (doc_id, quality 0/1).

    max_loss: the share of good labelled rows that all thresholds together may reject, a third of it each. sample_rows: for
    callers who want forests of `trees` trees from about so many rows, grown at the driver; all rows by default.
    """
    anomalies = [f"anomaly_{g}" for g in GROUPS]
    with Scratch(docs.sparkSession) as passing:
        stats = passing.written(statistics(docs, id_col, text_col), "statistics")
        failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        usable = stats.where(~failed)
        if sample_rows is None:
            forests = grow_all(usable, trees, points, seed, bins)
        else:
            # rows of a null or repeated id differ by their statistics
            unit = F.shiftrightunsigned(F.xxhash64("doc_id", *COUNTS, F.lit(seed)), 11) / F.lit(float(1 << 53))
            frame = usable.where(unit < min(1.0, sample_rows / max(1, usable.count()))).limit(2 * sample_rows).toPandas().sort_values(["doc_id", *COUNTS])
            forests = {g: grow(ratios({c: frame[c].to_numpy(dtype=np.float64) for c in COUNTS}, g), trees, points, seed) for g in GROUPS}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = _counts(batch)
                # six decimals: the number of different scores is bounded
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.round(f.score(ratios(c, g)), 6)) for g, f in forests.items())], [*batch.schema.names, *anomalies])

        scored = stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in anomalies))
        scored = written(scored.select("doc_id", *COUNTS, failed.alias("base_failed"), *anomalies), "scored")

    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))

    def by_score(rows: DataFrame, *by: str) -> pd.DataFrame:
        """How many rows have each score: at most 10 ** 6 scores a group, whatever the number of rows."""
        each = F.explode(F.array(*[F.struct(F.lit(g).alias("forest"), F.col(c).alias("score")) for g, c in zip(GROUPS, anomalies)])).alias("s")
        return rows.select(*by, each).groupBy(*by, "s.forest", "s.score").agg(F.count("*").alias("rows")).toPandas()

    passed = scored.where("not base_failed")
    marked = by_score(passed.join(known, "doc_id").withColumn("good", F.col("quality") > 0), "good")
    both = marked.good.nunique() == 2
    found = marked if both else by_score(passed)
    kept = ~F.col("base_failed")
    for g, c in zip(GROUPS, anomalies):
        f = found[found.forest == g]
        score, rows = f.score.to_numpy(dtype=np.float64), f.rows.to_numpy(dtype=np.int64)
        if both:
            forests[g].threshold = calibrate(score, f.good.to_numpy(dtype=bool), max_loss / len(GROUPS), rows)
        elif len(f):
            forests[g].threshold = quantile(score, rows, 1 - contamination / len(GROUPS))
        kept &= F.col(c) <= F.lit(forests[g].threshold)
    return scored.withColumn("kept", kept)
