"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector over hashed text features, shared by all grades, and
ordered thresholds. Features are the presence of lower-cased words, of their first four and five bytes and of
punctuation runs, and coarse levels of the share of capitals and of words that repeat the word before them; features
of few rated documents are left out, and an L1 penalty leaves weights, of either sign, on telling features only.

The model is fitted on a bounded sample of rated documents: `docs_per_grade` each, and no more of them than have
`features_per_grade` features together, by a hash of the id; their ids are broadcast (bounded) and only the sample's
features reach the driver. One pass without a shuffle scores every whole text.

Defined cases: a null or empty text has only level features; with fewer than two grades among the rated rows every
document gets that grade (0 without any) and is kept; rows repeating a doc_id are scored each; of repeated ratings the
lowest counts; more than MAX_GRADES grades are an error (a continuous rating must be binned first); extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch
from . import text as tx

BITS = 19
MAX_GRADES = 100
_SPACE = tx._SPACE
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_LEVELS = np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, repeats included."""
    mask = np.uint64((1 << BITS) - 1)
    low = tx.LOWER[data]
    out_t, out_f = [], []
    ws, we, wb = tx.runs(~_SPACE[data] & ~_PUNCT[data], offs)
    words = tx.span_hashes(low, ws, we)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(wb))
    out_t.append(text)
    out_f.append(words & mask)
    for k in (4, 5):
        long = np.flatnonzero(we - ws > k)
        out_t.append(text[long])
        out_f.append(tx.mix(tx.span_hashes(low, ws[long], ws[long] + k) + np.uint64(k)) & mask)
    ps, pe, pb = tx.runs(_PUNCT[data], offs)
    marks = tx.span_hashes(data, ps, pe)
    out_t.append(np.repeat(np.arange(len(offs) - 1), np.diff(pb)))
    out_f.append(tx.mix(marks + np.uint64(1)) & mask)
    count = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[offs])
    capital = count((data >= 65) & (data <= 90)) / np.maximum(1, count(~_SPACE[data]))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    repeat = np.diff(np.concatenate(([0], np.cumsum(same)))[wb]) / np.maximum(1, np.diff(wb))
    for k, share in enumerate((capital, repeat)):
        level = np.searchsorted(_LEVELS, share).astype(np.uint64)
        out_t.append(np.arange(len(offs) - 1))
        out_f.append(tx.mix(level + np.uint64(1000 * (k + 1))) & mask)
    return np.concatenate(out_t), np.concatenate(out_f).astype(np.int64)


def distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((text << BITS) | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    """grades: ascending; weights over hashed features; thresholds: ordered, one fewer than the grades."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(s: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sum of -log P(grade = y): with respect to each row's w . x, and to the thresholds."""
    edge = np.concatenate(([-np.inf], theta, [np.inf]))
    hi, lo = _sigmoid(edge[y + 1] - s), _sigmoid(edge[y] - s)
    p = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    k = len(theta) + 1
    return dhi - dlo, np.bincount(y, dlo, minlength=k)[1:] - np.bincount(y, dhi, minlength=k)[:-1]


def train(flat: np.ndarray, cuts: np.ndarray, y: np.ndarray, grades: np.ndarray, l1: float = 5e-4, min_docs: int = 5, rounds: int = 400) -> Model:
    """Weights and thresholds of the least mean loss plus l1 times the weights' absolute values, by accelerated proximal
    steps. Row i has the features flat[cuts[i]:cuts[i + 1]]; y are indices into grades. Features of under min_docs rows
    get no weight."""
    k, n = len(grades), len(y)
    keep = (np.bincount(flat, minlength=1 << BITS) >= min_docs)[flat]
    cuts = np.concatenate(([0], np.cumsum(keep)))[cuts]
    used, col = np.unique(flat[keep], return_inverse=True)
    col = col.astype(np.int32)
    m, row = len(used), np.repeat(np.arange(n, dtype=np.int32), np.diff(cuts))
    by_col = np.argsort(col, kind="stable")
    col_rows, col_starts = row[by_col], np.searchsorted(col[by_col], np.arange(m))
    some = np.flatnonzero(np.diff(cuts))

    def sums(v: np.ndarray) -> np.ndarray:
        s = np.zeros(n)
        if m:
            s[some] = np.add.reduceat(v[col], cuts[some])
        return s

    def loss(s: np.ndarray, theta: np.ndarray) -> float:
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        return float(-np.log(np.maximum(_sigmoid(edge[y + 1] - s) - _sigmoid(edge[y] - s), 1e-9)).mean())

    def slope(s: np.ndarray, theta: np.ndarray) -> np.ndarray:
        gs, gt = gradient(s, y, theta)
        return np.concatenate([np.add.reduceat(gs[col_rows], col_starts) if m else gs[:0], gt]) / n

    cum = np.cumsum(np.bincount(y, minlength=k))[:-1] / max(1, n)
    theta = np.log(np.clip(cum, 1e-3, 1 - 1e-3) / np.clip(1 - cum, 1e-3, 1))
    x = np.concatenate([np.zeros(m), np.maximum.accumulate(theta + 1e-3 * np.arange(k - 1))])
    # sx, sz: the rows' sums at x and z; they are linear, so those at z need no pass over the features
    z, sx, pull, step, last, held = x, np.zeros(n), 1.0, 1.0, np.inf, 0
    sz = sx
    for _ in range(rounds):
        at, g = loss(sz, z[m:]), slope(sz, z[m:])
        for _ in range(40):  # halve the step until the loss is below its bound
            new = z - step * g
            new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * l1, 0)
            new[m:] = np.maximum.accumulate(new[m:])
            move, s = new - z, sums(new)
            there = loss(s, new[m:])
            if there <= at + g @ move + move @ move / (2 * step) + 1e-12:
                break
            step /= 2
        else:
            break
        now = there + l1 * np.abs(new[:m]).sum()
        held = held + 1 if abs(last - now) <= 1e-5 * now else 0
        if now > last:  # the pull went too far: start it anew
            z, sz, pull, last = x, sx, 1.0, np.inf
            continue
        after = (1 + np.sqrt(1 + 4 * pull * pull)) / 2
        far = (pull - 1) / after
        z, sz = new + far * (new - x), s + far * (s - sx)
        z[m:] = np.maximum.accumulate(z[m:])
        x, sx, pull, last, step = new, s, after, now, 1.1 * step
        if held == 5:
            break
    w = np.zeros(1 << BITS)
    w[used] = x[:m]
    return Model(grades, w, x[m:])


def _selected(docs: DataFrame, rated: DataFrame, docs_per_grade: int, features_per_grade: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts between rows, the rows' grades, all grades) of the sample."""
    counts = rated.groupBy("grade").count().limit(MAX_GRADES + 1).collect()
    if len(counts) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades: bin the ratings first")
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / F.lit(float(1 << 53))
    shares = rated.sparkSession.createDataFrame([(r["grade"], min(1.0, docs_per_grade / r["count"])) for r in counts], "grade double, share double")
    picked = rated.join(F.broadcast(shares), "grade").where(unit < F.col("share")).select("doc_id", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(2)):
                t, f = distinct(*features(data, offs))
                cut = np.searchsorted(t, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), lists], ["doc_id", "grade", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as passing:
        found = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
        found = passing.written(found.mapInArrow(run, "doc_id long, grade double, f array<int>"), "sample")
        totals = found.groupBy("grade").agg(F.sum(F.size("f")).alias("total"))
        within = F.least(F.lit(1.0), F.lit(float(features_per_grade)) / F.greatest(F.col("total"), F.lit(1)))
        own = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("f")), 11) / F.lit(float(1 << 53))  # rows of an id one by one
        table = found.join(F.broadcast(totals), "grade").where(own < within).orderBy("doc_id", F.xxhash64("f")).select("grade", "f").toArrow()
    lists = table.column(1).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return flat, cuts, table.column(0).to_numpy(), np.array(sorted(r["grade"] for r in counts))


def graded_quality(docs: DataFrame, labels: DataFrame, grade: Column, keep_grade: float | None = None, min_tail: float = 0.5, docs_per_grade: int = 4000, features_per_grade: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_tail, kept) for every document: p_tail = P(grade >= keep_grade), kept if >= min_tail.

    grade: the rating, a column over labels (doc_id, ...); keep_grade: the highest grade if None.
    """
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("double").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    flat, cuts, got, grades = _selected(docs, rated, docs_per_grade, features_per_grade, id_col, text_col)
    keep = keep_grade if keep_grade is not None else (float(grades[-1]) if len(grades) else 0.0)
    grades = np.array(sorted(set(got.tolist()))) if len(got) else grades
    model = train(flat, cuts, np.searchsorted(grades, got), grades) if len(grades) > 1 and len(got) else None
    fitted = model is not None
    used = np.flatnonzero(model.weights) if fitted else np.zeros(0, np.int64)
    weights, thresholds = (model.weights[used], model.thresholds) if fitted else (None, None)
    del model  # the tasks get the weights in use

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fitted:
            w = np.zeros(1 << BITS)
            w[used] = weights
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                if fitted:
                    t, f = features(data, offs)
                    some = w[f] != 0
                    t, f = distinct(t[some], f[some])
                    s = np.bincount(t, w[f], minlength=j - i)
                    above = 1 - _sigmoid(thresholds[None, :] - s[:, None])  # P(grade > k)
                    expected = grades[0] + (above * np.diff(grades)[None, :]).sum(1)
                    at = int(np.searchsorted(grades, keep))
                    tail = np.ones(j - i) if at == 0 else np.zeros(j - i) if at >= len(grades) else above[:, at - 1]
                    kept = tail >= min_tail
                else:
                    expected, tail, kept = np.full(j - i, float(grades[0]) if len(grades) else 0.0), np.ones(j - i), np.ones(j - i, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(expected), pa.array(tail), pa.array(kept)], ["doc_id", "expected_grade", "p_tail", "kept"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id long, expected_grade double, p_tail double, kept boolean")
