"""Groups of spelling variants: k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most one up and one down. Words of
one length form a k-d tree; each word searches the tree of its own length (a replaced letter) and of the next one (an
inserted letter), leaves out boxes further off than that, and what the boxes leave is verified letter by letter.

Scale: words are counted in slices, then by a partially aggregated group-by. The upper planes of the trees come from a
bounded sample of the vocabulary and only route words to cells of bounded size; each cell has its own tree in one task,
and words reach all cells whose boxes they touch, so no near word is lost whatever the sample. A cell gives each
searching word one row: its number of near words there, and the most frequent of them. Forms are followed to the last by
pointer doubling; a form is at least twice as frequent as its word, so chains are short.

Defined cases: a null or empty text has no words; a null id leaves its words as they are where words are thinned; repeated
rows count as often as they stand; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch, written
from . import text as tx

#: Words of the vocabulary that the upper planes are taken from, and words of one cell, about.
SAMPLE = 100_000
CELL = 4_000
#: Points of a leaf of the trees within a cell, and pairs looked at together.
LEAF = 64
PAIRS = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
#: Spans of more bytes are summed one by one.
_LONG = 64


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span, continued from `state`."""
    n = ends - starts
    crc = ~state.astype(np.uint32)
    for k in range(min(int(n.max(initial=0)), _LONG)):
        at = np.flatnonzero((n > k) & (n <= _LONG))
        c = crc[at]
        crc[at] = _CRC[(c ^ data[starts[at] + k]) & 0xFF] ^ (c >> np.uint32(8))
    crc = ~crc
    for k in np.flatnonzero(n > _LONG).tolist():
        crc[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(state[k]))
    return crc


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, and each text's first run."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return tx.runs(inside, offs)


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as strings."""
    n = ends - starts
    offs = np.concatenate(([0], np.cumsum(n)))
    flat = data[np.repeat(starts - offs[:-1], n) + np.arange(offs[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(flat))


def _without(words: list[str], at: list[int]) -> pa.Array:
    return pa.array([w[:k] + w[k + 1 :] for w, k in zip(words, at)], pa.string())


def _slice_words(ids: list[int | None], data: np.ndarray, offs: np.ndarray, min_letters: int, thin: int | None) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(hashes, numbers, words) of a slice of texts: those that stay as they are, told apart, and those thinned."""
    data = tx.LOWER[data]
    starts, ends, bounds = letter_runs(data, offs)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    n_letters = letters[ends] - letters[starts]
    out = []
    if thin:
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        known = np.array([i is not None for i in ids], bool)
        state = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        crc = crc32_spans(data, starts, ends, state[owner])
        hit = (crc % np.uint32(thin) == 0) & known[owner]
        at = np.flatnonzero(hit & (n_letters > min_letters))
        words = _without(_gathered(data, starts[at], ends[at]).to_pylist(), (crc[at] % n_letters[at]).tolist())
        raw, cut = tx.string_buffers(words)
        out.append((tx.span_hashes(raw, cut[:-1], cut[1:]), np.ones(len(at), np.int64), words))
        starts, ends, n_letters = starts[~hit], ends[~hit], n_letters[~hit]
    at = np.flatnonzero(n_letters >= min_letters)
    h, first, count = np.unique(tx.span_hashes(data, starts[at], ends[at]), return_index=True, return_counts=True)
    return [*out, (h, count, _gathered(data, starts[at[first]], ends[at[first]]))]


#: Words that a task holds before it adds up their numbers, and gives them out if most of them differ.
HELD = 400_000


def _added(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    h, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
    n = np.zeros(len(h), np.int64)
    np.add.at(n, at, np.concatenate([x[1] for x in held]))
    return h, n, pa.concat_arrays([x[2] for x in held]).take(pa.array(first))


def vocabulary(docs: DataFrame, min_letters: int = 5, min_count: int = 3, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of at least min_letters letters and min_count occurrences.

    With `thin`, a run whose CRC-32 of "id:run" that number divides loses the letter at that CRC modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        given = lambda x: pa.RecordBatch.from_arrays([x[2], pa.array(x[1])], ["word", "n"])
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                held += _slice_words(batch.column(0).slice(i, j - i).to_pylist(), data, offs, min_letters, thin)
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_added(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield given(held.pop())
        if held:
            yield given(_added(held))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


# ---- trees


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts, one row a word."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(words)), n) * 256 + flat, minlength=256 * len(words)).reshape(-1, 256).astype(np.int32)


class Tree:
    """A k-d tree of integer points with boxes from its planes; leaves hold about `leaf` points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.dims = np.flatnonzero(points.min(0, initial=1 << 30) < points.max(0, initial=-1)) if len(points) else np.zeros(0, np.int64)
        self.plane: list[tuple[int, int, int, int]] = []  # dimension, value, children; no dimension: a leaf
        self.members: list[np.ndarray] = []
        low, high = np.full(256, -(1 << 30), np.int32), np.full(256, 1 << 30, np.int32)
        self.low, self.high = [], []
        todo = [(np.arange(len(points)), low, high, -1, 0)]
        while todo:
            at, low, high, parent, side = todo.pop()
            node = len(self.plane)
            if parent >= 0:
                p = self.plane[parent]
                self.plane[parent] = (p[0], p[1], node, p[3]) if side == 0 else (p[0], p[1], p[2], node)
            self.low.append(low)
            self.high.append(high)
            self.members.append(at)
            self.plane.append((-1, 0, -1, -1))
            if len(at) <= leaf:
                continue
            x = points[at][:, self.dims]
            dim = int(self.dims[np.argmax(x.var(0))])
            v = points[at, dim]
            if v.min() == v.max():
                continue  # equal points
            cut = int(np.sort(v)[(len(v) - 1) // 2])
            cut = cut if cut < v.max() else cut - 1
            self.plane[node] = (dim, cut, -1, -1)
            self.members[node] = at[:0]
            up, down = low.copy(), high.copy()
            down[dim], up[dim] = cut, cut + 1
            todo.append((at[v > cut], up, high, node, 1))
            todo.append((at[v <= cut], low, down, node, 0))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.leaves = [k for k, p in enumerate(self.plane) if p[0] < 0]

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            dim, cut, left, right = self.plane[node]
            if dim < 0:
                out[at] = node
            else:
                above = points[at, dim] > cut
                todo += [(left, at[~above]), (right, at[above])]
        return out

    def reached(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points) for all leaves whose box a point enters by at most `up` more and `down` fewer letters."""
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int32), np.zeros(len(points), np.int32))]
        while todo:
            node, at, more, less = todo.pop()
            dim, cut, left, right = self.plane[node]
            if dim < 0:
                yield node, at
                continue
            v = points[at, dim]
            for child in (left, right):
                # the step from this node's box to the child's along the plane's dimension
                a = more + np.maximum(self.low[child, dim] - v, 0) - np.maximum(self.low[node, dim] - v, 0)
                b = less + np.maximum(v - self.high[child, dim], 0) - np.maximum(v - self.high[node, dim], 0)
                ok = (a <= up) & (b <= down)
                if ok.any():
                    todo.append((child, at[ok], a[ok], b[ok]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one replaced letter (equal lengths) or by one that b has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    n = a.shape[1]
    front = np.cumprod(a == b[:, :n], 1, dtype=np.int8).sum(1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    return front + back >= n


def near_pairs(points: list[bytes], searching: list[bytes], leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of (searching word, point) that are one edit apart; all points have one length, the others that or one less."""
    if not points or not searching:
        return
    longer = len(points[0]) - len(searching[0])
    x, q = vectors(points), vectors(searching)
    letters = [np.frombuffer(b"".join(w), np.uint8).reshape(len(w), -1) for w in (searching, points)]
    tree, size = Tree(x, leaf), len(points[0])
    steps = None if size > _STEPS else [_unary(v, np.maximum(x.max(0), q.max(0))) for v in (q, x)]
    for node, at in tree.reached(q, 1, 1 - longer):
        members = tree.members[node]
        step = max(1, PAIRS // max(1, len(members)))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            for j in range(0, len(members), PAIRS):
                to = members[j : j + PAIRS]
                if steps:  # letters in common, from sums of products of 0 and 1
                    a, b = np.nonzero(steps[0][some] @ steps[1][to].T >= size - 1)
                else:
                    a, b = np.nonzero(_apart(q[some], x[to]) <= 2 - longer)
                a, b = some[a], to[b]
                ok = one_edit(letters[0][a], letters[1][b])
                yield a[ok], b[ok]


#: Words of more letters are compared count by count.
_STEPS = 64


def _unary(x: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as 0 and 1: a column for each letter and number up to the most there is of it."""
    return np.stack([x[:, d] >= k for d in np.flatnonzero(most) for k in range(1, most[d] + 1)], 1).astype(np.float32)


def _apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """L1 distances of all rows of q and x."""
    out = np.zeros((len(q), len(x)), np.int32)
    for d in np.flatnonzero((q.max(0) > 0) | (x.max(0) > 0)):
        out += np.abs(q[:, d, None] - x[None, :, d])
    return out


def _planes(vocab: DataFrame, sample: int, cell: int) -> dict[int, Tree]:
    """The upper planes of each length's tree, from a sample bounded by `sample` words; lengths of few words have none."""
    sizes = {r.size: r.n for r in vocab.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    share = min(1.0, 0.9 * sample / total)
    kept = vocab.where((F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))) & F.length("word").isin(list(sizes))).select("word").limit(sample)
    by: dict[int, list[bytes]] = {}
    for w in sorted(kept.toArrow().column(0).to_pylist()):
        by.setdefault(len(w), []).append(w.encode("latin-1"))
    return {size: Tree(vectors(ws), max(1, int(cell * share))) for size, ws in by.items()}


def _dealt(vocab: DataFrame, planes: dict[int, Tree]) -> DataFrame:
    """(size, cell, side, word, n): each word at its place in the tree of its length (side 0), and in all cells it searches
    (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in words], np.int64)
            x = vectors(words)
            out = []
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                for to in (s, s + 1):
                    tree = planes.get(to)
                    if tree is None:
                        out.append((np.full(len(at), to), np.zeros(len(at), np.int64), np.ones(len(at), np.int64), at))
                        continue
                    for node, some in tree.reached(x[at], 1, 1 - (to - s)):
                        out.append((np.full(len(some), to), np.full(len(some), node), np.ones(len(some), np.int64), at[some]))
                own = planes[s].cell(x[at]) if s in planes else np.zeros(len(at), np.int64)
                out.append((np.full(len(at), s), own, np.zeros(len(at), np.int64), at))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), batch.column(0).take(pa.array(cols[3])), batch.column(1).take(pa.array(cols[3]))], ["size", "cell", "side", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "size long, cell long, side long, word string, n long")


def _cell_best(t: pa.Table) -> pa.RecordBatch | None:
    """(word, n_near, near_n, near) of the searching words of one cell that have a near word there, and of its points
    where the search came from shorter words."""
    side, n = t.column(2).to_numpy(), t.column(4).to_numpy()
    names, rank = np.unique(np.array([w.encode("latin-1") for w in t.column(3).to_pylist()], object), return_inverse=True)
    words = names[rank]
    points = np.flatnonzero(side == 0)
    if not len(points):
        return None
    size = len(words[points[0]])
    lengths = np.array([len(w) for w in words], np.int64)
    found = []
    for less in (0, 1):
        q = np.flatnonzero((side == 1) & (lengths == size - less))
        for a, b in near_pairs(words[points].tolist(), words[q].tolist()):
            found.append((q[a], points[b]))
            if less:
                found.append((points[b], q[a]))
    if not found:
        return None
    a, b = (np.concatenate(x) for x in zip(*found))
    at, to = rank[a], rank[b]  # a word may stand on both sides of a cell
    order = np.lexsort((to, -n[b], at))
    first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))[: len(order)]]
    text = lambda k: pa.array([w.decode("latin-1") for w in names[k]], pa.string())
    return pa.RecordBatch.from_arrays([text(at[first]), pa.array(np.bincount(at, minlength=len(names))[at[first]]), pa.array(n[b[first]]), text(to[first])], ["word", "n_near", "near_n", "near"])


def near_words(vocab: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, near, near_n) of every word with a near word: their number and the most frequent, ties by code point."""
    planes = _planes(vocab, sample, cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.grouped(batches, 2):
            out = _cell_best(t)
            if out is not None:
                yield out

    n = sum(len(tree.leaves) for tree in planes.values()) // 2 + 8  # searching, not size, decides how many tasks are worth it
    cells = _dealt(vocab, planes).repartition(n, "size", "cell").sortWithinPartitions("size", "cell")
    parts = cells.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(docs: DataFrame, min_letters: int = 5, min_count: int = 3, ratio: int = 2, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    form is the most frequent near word if that occurs at least `ratio` (2 or more) times as often, else null; root is
    the word reached by following forms.
    """
    if ratio < 2:
        raise ValueError("forms of less than twice the frequency might not end")
    with Scratch(docs.sparkSession) as passing:
        vocab = passing.written(vocabulary(docs, min_letters, min_count, thin, id_col, text_col), "vocabulary")
        rows = vocab.join(near_words(vocab, sample, cell), "word", "left")
        has = F.col("near_n") >= ratio * F.col("n")
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
        rows = passing.written(rows.withColumn("root", F.coalesce("form", "word")), "variants")
        heads = rows.select("word", "root")
        while True:
            ahead = heads.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = passing.written(heads.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            heads = moved.select("word", "root")
            if not moved.where("moved").head(1):
                break
        return written(rows.drop("root").join(heads, "word"), "variants")
