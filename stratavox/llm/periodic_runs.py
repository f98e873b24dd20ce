"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word
extends. Factors of 1, 2, 4 ... words are named level by level, the name of a factor being that of its two halves;
a place stays only while its factor occurs elsewhere in the text, so levels thin out quickly in prose.
Where a factor of w words has its next occurrence d <= w words on, the stretch from the one to the end of the other has
period d, and no smaller one: a smaller one would give a nearer occurrence. Within a run of period q every factor of at
least q words has its successor exactly q on, so the places of one run of three periods or more form one
progression at the level with w / 2 < q <= w. Each progression is a proposal; proposals are extended word by word and told apart.

Scale: one pass without a shuffle, whole texts, slices of about a megabyte (at least one text) in a task.

Defined cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; ids may be null or
repeat, every row is judged by its own text; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def progressions(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of the stretches proposed by successors; `names` differ between texts."""
    found = [], [], []
    at, name, width = np.arange(len(names)), names, 1
    while len(at) > 1:
        order = np.argsort(name, kind="stable")
        place = at[order]
        same = name[order[1:]] == name[order[:-1]]
        step = place[1:] - place[:-1]
        near = same & (step <= width) & (2 * step > width)
        first, step = place[:-1][near], step[near]
        by = np.argsort(first, kind="stable")
        first, step = first[by], step[by]
        if len(first):
            cut = np.flatnonzero((first[1:] != first[:-1] + 1) | (step[1:] != step[:-1]))
            head, tail = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(first) - 1]))
            for out, value in zip(found, (first[head], first[tail] + width + step[head], step[head])):
                out.append(value)
        stays = np.zeros(len(at), bool)
        stays[order[1:]] |= same
        stays[order[:-1]] |= same
        at, name = at[stays], name[stays]
        if not len(at):
            break
        other = np.searchsorted(at, at + width)
        whole = at[np.minimum(other, len(at) - 1)] == at + width
        name = tx.mix(tx.mix(name[whole] + np.uint64(width)) ^ (name[other[whole]] * np.uint64(0x9FB21C651E98DF25)))
        at, width = at[whole], 2 * width
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in found)


def text_runs(names: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int, min_exponent: int) -> np.ndarray:
    """Rows (start, stop, period), sorted, of all runs of at least min_words words and min_exponent periods.

    low and high: the first word of each word's text and the one after its last.
    """
    start, stop, period = progressions(names)
    enough = stop - start >= np.maximum(min_words, min_exponent * period) - 2  # before extension
    start, stop, period = start[enough], stop[enough], period[enough]
    low, high = low[start] if len(start) else start, high[start] if len(start) else stop
    while True:
        left = start > low
        left[left] = names[start[left] - 1] == names[start[left] - 1 + period[left]]
        right = stop < high
        right[right] = names[stop[right]] == names[stop[right] - period[right]]
        if not (left.any() or right.any()):
            break
        start, stop = start - left, stop + right
    runs = np.stack([start, stop, period], 1)
    return np.unique(runs[stop - start >= np.maximum(min_words, min_exponent * period)], axis=0)


def cycled(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one id in ten, the words of a text as a cycle from a place on: the number of the word at each place."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def find_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3, arranged: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: runs of at least min_words words and min_exponent (3 or more)
    periods by start, then period; collapsed joins, by one space, the words that no run contains after its first period.

    arranged(id, number of words) may give the number of the word to take at each place of a text (None: as it stands).
    """

    if min_exponent < 3:
        raise ValueError("shorter runs may hold no two factors of a period's length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, *_slice_runs(ids.to_pylist(), data, offs, min_words, min_exponent, arranged)], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _slice_runs(ids: list[int | None], data: np.ndarray, offs: np.ndarray, min_words: int, min_exponent: int, arranged: Callable | None) -> list[pa.Array]:
    starts, ends, bounds = tx.words(data, offs)
    n = np.diff(bounds)
    source = np.arange(len(starts))
    moved = set()
    if arranged:
        for k, (doc_id, count) in enumerate(zip(ids, n.tolist())):
            at = arranged(doc_id, count)
            if at is not None:
                source[bounds[k] : bounds[k + 1]] = bounds[k] + at
                moved.add(k)
    owner = np.repeat(np.arange(len(n)), n)
    names = tx.span_hashes(data, starts, ends)[source]
    names = tx.mix(names + tx.mix(owner.astype(np.uint64) + np.uint64(1)))
    runs = text_runs(names, bounds[:-1][owner], bounds[1:][owner], min_words, min_exponent)
    of = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    edge = np.zeros(len(names) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    raw = data.tobytes()
    texts = []
    dropped = set(of.tolist())
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        words = raw[a:b].split()
        if k in moved or k in dropped:
            x, y = bounds[k], bounds[k + 1]
            words = [words[w] for w in (source[x:y][kept[x:y]] - x).tolist()]
        texts.append(b" ".join(words))
    values = [runs[:, 0] - bounds[:-1][of], runs[:, 1] - runs[:, 0], runs[:, 2]] if len(runs) else [np.zeros(0, np.int64)] * 3
    at = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(_RUN)))
    return [pa.array(n), lists, pa.array(texts, pa.binary()).cast(pa.string())]


def best_run(runs: str = "runs") -> F.Column:
    """The run of greatest exact length / period; ties: smallest start, then period; null without runs."""
    order = "case when a.length * b.period <> b.length * a.period then (case when a.length * b.period > b.length * a.period then -1 else 1 end) when a.start <> b.start then (case when a.start < b.start then -1 else 1 end) when a.period < b.period then -1 when a.period > b.period then 1 else 0 end"
    return F.expr(f"try_element_at(array_sort({runs}, (a, b) -> {order}), 1)")
