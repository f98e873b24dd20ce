"""Benchmark decontamination with spaced seeds.

Fixed masks hash the words of a window at the mask's care positions only, so a substituted word at an ignored
position does not hide an overlap. The hashes of all windows of every whole document meet those of the benchmark;
each hit is verified on its diagonal (the document laid beside the item at that shift): an overlap is any segment of it
that holds `min_match` equal words (or all the words of a shorter item) with at least `min_identity` of its words equal.
Of an item of fewer than `SHORT` words, `min_identity` of all its words suffice, wherever the others are.

The seeds are complete for the default limits: every placement of substitutions in a segment of 10 to 24 words that
passes leaves a window of a mask whole (the tests enumerate them), and a longer segment that passes can be halved until
a half of 12 to 24 words passes. So no overlap within the limits is lost, whatever else stands around it.

The benchmark side is a query set: it is sent to the tasks in blocks of at most `block_chars` characters (one block
for any usual benchmark, one pass over the documents for each block), so its size is checked and bounded. Documents
are neither shuffled nor grouped; a passage in many documents costs each of them its own check only.

Defined cases: null or empty texts and empty tables give no rows; items of fewer than `min_words` words carry no
evidence and are left out, those shorter than a mask are sought by masks of their length; equal items (A-Z lower-cased) count as
one, under the smallest item_id; a null item_id is left out; rows with a null doc_id are reported with it; repeated
rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: 1 marks the positions that count.
MASKS = ("110111", "110001011")

#: Items of fewer words are judged as a whole. The further mask leaves no placement of two substitutions in 10 or 11 words
#: without a seed; items of 5 to 9 words have masks with each one word left out.
SHORT = 18
SHORT_MASK = "10111"


def best_run(same: np.ndarray, need: int, min_identity: float) -> tuple[int, int, int] | None:
    """(equal words, start, end) of the segment with the most equal words among those with a share of at least
    min_identity; None if they are fewer than need."""
    share = round(1000 * min_identity)
    total = np.concatenate(([0], np.cumsum(np.where(same, 1000 - share, -share))))
    equal = np.concatenate(([0], np.cumsum(same)))
    # a segment passes if its total is 0 or more: the longest one to each end starts at the first total not above
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(equal - equal[first]))
    start, count = int(first[end]), int(equal[end] - equal[first[end]])
    if count < max(1, need):
        return None
    at = np.flatnonzero(same[start:end])
    return count, start + int(at[0]), start + int(at[-1]) + 1


class Probe:
    """The spaced-seed index of one benchmark block."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS, min_words: int = 5):
        data = np.frombuffer("".join(t for _, t in items).encode(), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in items]))).astype(np.int64)
        data = tx.LOWER[data]
        starts, ends, bounds = tx.words(data, offs)
        h = tx.span_hashes(data, starts, ends)
        self.vocab = np.unique(h)
        self.words = np.searchsorted(self.vocab, h).astype(np.int64) + 1
        self.first, self.ids = bounds, np.array([i for i, _ in items], np.int64)
        length = np.diff(bounds)
        item_of = np.repeat(np.arange(len(items)), length)
        where = np.arange(len(h)) - bounds[item_of]
        shapes = [(m, length >= len(m)) for m in masks]
        shapes += [("1" * k, length == k) for k in range(min_words, 5)]
        shapes += [("1" * x + "0" + "1" * (k - x - 1), length == k) for k in range(max(5, min_words), 10) for x in range(k)]
        shapes.append((SHORT_MASK, (length == 10) | (length == 11)))
        self.seeds = []
        for mask, use in shapes:
            code, _ = self.codes(self.words, mask)
            at = np.arange(len(code))
            at = at[use[item_of[at]] & (where[at] + len(mask) <= length[item_of[at]])]
            if len(at):
                order = np.argsort(code[at], kind="stable")
                self.seeds.append((mask, code[at][order], item_of[at][order], where[at][order]))

    @staticmethod
    def codes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the masked windows, and whether all their words are known."""
        n = max(0, len(ids) - len(mask) + 1)
        h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for k, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64)
                ok &= ids[k : n + k] > 0
        return h, ok

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of document words; 0 where the block has no such word."""
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)

    def hits(self, ids: np.ndarray, text_of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed hits in a slice."""
        found = []
        for mask, code, item, where in self.seeds:
            h, ok = self.codes(ids, mask)
            at = np.flatnonzero(ok)
            at = at[text_of[at] == text_of[at + len(mask) - 1]] if len(at) else at
            low = np.searchsorted(code, h[at], "left")
            n = np.searchsorted(code, h[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if len(at):
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(at, n)
                found.append(np.stack([text_of[pos], item[k], pos - bounds[text_of[pos]] - where[k]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verify(self, words: np.ndarray, item: int, diagonal: int, min_match: int, min_identity: float) -> tuple[int, int, int, int] | None:
        """(matches, length, document word, item word) of the best overlap on a diagonal."""
        want = self.words[self.first[item] : self.first[item + 1]]
        low, high = max(0, -diagonal), min(len(want), len(words) - diagonal)
        same = words[low + diagonal : high + diagonal] == want[low:high]
        got = best_run(same, min(min_match, len(want)), min_identity)
        if got is None and len(want) < SHORT and same.sum() >= min_identity * len(want):
            got = int(same.sum()), 0, high - low
        if got is None:
            return None
        count, start, end = got
        return count, end - start, low + diagonal + start, low + start

    def overlaps(self, column: pa.Array, min_match: int, min_identity: float) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(row, item, best overlap) of all texts of a column."""
        for i, j, data, offs in tx.slices(column):
            data = tx.LOWER[data]
            starts, ends, bounds = tx.words(data, offs)
            ids = self.lookup(tx.span_hashes(data, starts, ends))
            text_of = np.repeat(np.arange(j - i), np.diff(bounds))
            best: dict[tuple[int, int], tuple] = {}
            for t, item, diagonal in self.hits(ids, text_of, bounds).tolist():
                got = self.verify(ids[bounds[t] : bounds[t + 1]], item, diagonal, min_match, min_identity)
                if got and got > best.get((t, item), (0,)):
                    best[t, item] = got
            for (t, item), got in sorted(best.items()):
                yield i + t, item, got


def probes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = 5, block_chars: int = 16_000_000) -> Iterator[Probe]:
    """The benchmark's blocks, one at a time."""
    lower = F.translate(F.col(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).groupBy(lower.alias("words")).agg(F.min(F.col(item_col).cast("long")).alias("item"))
    size = items.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = 1 + int(size) // block_chars
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).orderBy("item")
        yield Probe([(r["item"], r["words"]) for r in part.collect()], masks, min_words)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = 10, min_identity: float = 0.8, **blocks) -> DataFrame:
    """(doc_id, item_id, n_match, n_overlap, doc_word, item_word): each verified overlap, the best for a pair.

    n_match words of the n_overlap words from the document's word doc_word and the item's word item_word are equal.
    blocks: see probes.
    """
    names = ["doc_id", "item_id", "n_match", "n_overlap", "doc_word", "item_word"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def with_probe(probe: Probe) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.array([(t, probe.ids[item], *got) for t, item, got in probe.overlaps(batch.column(1), min_match, min_identity)], np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), *(pa.array(found[:, k]) for k in range(1, 6))], names)

        return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))

    return reduce(DataFrame.union, map(with_probe, probes(benchmark, **blocks)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = 10, min_identity: float = 0.8, **blocks) -> DataFrame:
    """The rows of docs without a verified overlap, each judged by its own text, in a pass for each block."""

    def with_probe(rows: DataFrame, probe: Probe) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, _, _ in probe.overlaps(batch.column(at), min_match, min_identity)]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    at = docs.columns.index(text_col)
    return reduce(with_probe, probes(benchmark, **blocks), docs)
