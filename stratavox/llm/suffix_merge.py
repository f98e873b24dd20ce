"""Repeated byte strings found by merging the Burrows-Wheeler transforms of shards.

Only suffixes at anchors take part: in every window of `length` bytes the anchor is the gram of GRAM bytes with the least
hash, so equal windows have equal anchors at equal offsets, and an anchor whose gram occurs once lies in no repeated
window. A shard (the texts of a task, in pieces of bounded size) orders the suffixes at its remaining anchors and keeps,
beside each, the bytes before it, which are its transform's columns. Suffixes of equal context fold into the
earliest of the shard.

The shards' runs of a gram are merged by refining their interleave, eight bytes a round: a round separates only those
stretches of the interleave that are still equal, and the round in which neighbours part gives their common
prefix. From the order of the suffixes at the anchors, one step of the transform after another (a stable sort by the byte
before) gives the order of the suffixes one byte further left. Step o holds the windows that begin o bytes before an
anchor; a repeated interval is a stretch of equal bytes before and a common prefix of at least length - o bytes, and all
its members but the earliest begin with a repeat. No step sorts whole suffixes.

Scale: one row an anchor (about one in 31 bytes) meets the others of its gram, one row a shard where a
gram is common; texts are joined twice with what concerns them. A gram with more than HOT contexts is taken apart into
its offsets, at each of which the context is the window itself and folds in every shard, so no group is held in one task.

Defined cases: a null or empty text has no bytes; texts of fewer than `length` bytes stay whole; ids order the texts, where
ids are null (first) or repeat the text breaks the tie, so of equal rows one keeps the bytes; further columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Scratch, written
from . import text as tx

#: Bytes of an anchor's gram; a window of n bytes has n - GRAM + 1 of them, at most 63.
GRAM = 40
#: Contexts of one gram that are merged in one task; suffixes of one piece of a shard, or of one merge.
HOT = 10_000
PIECE = 100_000
#: Anchors among which a task folds equal grams before they leave it.
FOLD = 1_000_000

_CODE = tx.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Grams:
    """Rolling hashes of grams; powers are kept between slices."""

    def __init__(self, size: int = GRAM):
        self.size, self.up, self.down = size, _powers(_BASE, 1 << 16), _powers(_BACK, 1 << 16)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if len(self.up) < len(data):
            self.up, self.down = (_powers(b, 2 * len(data)) for b in (_BASE, _BACK))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * self.up[: len(data)], out=total[1:])
        return tx.mix((total[self.size :] - total[:n]) * self.down[:n])

    def at(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        total = np.zeros(len(places), np.uint64)
        for k in range(self.size):
            total += _CODE[data[places + k]] * self.up[k]
        return tx.mix(total)


def anchors(h: np.ndarray, offs: np.ndarray, length: int, size: int = GRAM) -> np.ndarray:
    """The places of the least gram (the first of equal ones) of every window of `length` bytes within a text."""
    span = length - size + 1
    n = int(offs[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    fits = np.zeros(n + 1, np.int32)
    lengths = np.diff(offs)
    long = lengths >= length
    np.add.at(fits, offs[:-1][long], 1)
    np.add.at(fits, offs[1:][long] - length + 1, -1)
    places = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.cumsum(fits[:n]) > 0]
    return places[np.concatenate(([True], places[1:] != places[:-1]))] if len(places) else places


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each value, whether the row's value occurs again), rows in order of appearance."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    first = np.ones(len(key), bool)
    first[order[1:]] = ~same
    many = np.zeros(len(key), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return first, many


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, known, row, place) of every anchor of texts (row, text). The first of a gram in a task is keyed by it; the
    others are known to repeat and are spread."""

    def emit(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, row, place = (np.concatenate(x) for x in zip(*held))
        first, many = _firsts(gram)
        key = np.where(first, gram, tx.mix(gram + tx.mix(row.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(many), pa.array(row), pa.array(place.astype(np.int32))], ["key", "known", "row", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, n = Grams(), [], 0
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                h = grams(data)
                at = anchors(h, offs, length)
                if not len(at):
                    continue
                owner = np.searchsorted(offs, at, "right") - 1
                row = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                held.append((h[at], row[owner], at - offs[owner]))
                n += len(at)
                if n >= FOLD:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    return texts.mapInArrow(run, "key long, known boolean, row long, place int")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(row, place) of the anchors whose gram occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before: its fate may depend on the next
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = batch.column(1).to_numpy(zero_copy_only=False).copy()
            keep[1:] |= same
            keep[:-1] |= same
            last = batch.slice(batch.num_rows - 1)
            last = pa.RecordBatch.from_arrays([last.column(0), pa.array([bool(keep[-1])]), last.column(2), last.column(3)], batch.schema.names)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).select([2, 3])
        if last is not None:
            yield last.filter(last.column(1)).select([2, 3])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, place int")


# ---- contexts: the bytes before and after an anchor


def _eights(block: np.ndarray) -> list[np.ndarray]:
    """The columns of eight bytes of a matrix of bytes, as numbers that order as the bytes do."""
    n, width = block.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = block
    return list(np.ascontiguousarray(wide.view(">u8").astype(np.uint64).T))


def interleave(columns: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows ordered by group (given in order) and columns, and the bytes each shares with the one before.

    Rounds refine the interleave of the runs in the rows; a round takes up only stretches still equal.
    """
    n = len(group)
    order = np.arange(n)
    head = np.concatenate(([True], group[1:] != group[:-1]))[:n]
    common = np.where(head, 0, 8 * len(columns)).astype(np.int32)
    for k, column in enumerate(columns):
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        stretch = np.cumsum(head)[at]
        rows = order[at]
        rows = rows[np.lexsort((column[rows], stretch))]
        order[at] = rows
        value = column[rows]
        differ = (value[1:] ^ value[:-1]) & np.where(stretch[1:] == stretch[:-1], ~np.uint64(0), np.uint64(0))
        some = np.flatnonzero(differ)
        if len(some):
            lead = np.zeros(len(some), np.int32)
            for b in range(1, 8):
                lead += (differ[some] >> np.uint64(64 - 8 * b)) == 0
            head[at[some + 1]] = True
            common[at[some + 1]] = 8 * k + lead
    return order, common


def _context(data: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray, before: int, after: int) -> np.ndarray:
    """The bytes from `before` before to `after` after each place, zeros outside of its text [low, high)."""
    at = places[:, None] + np.arange(-before, after)[None, :]
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def _valid(left: np.ndarray, right: np.ndarray, before: int, length: int) -> np.ndarray:
    """Bits of the offsets at which the window lies within its text."""
    out = np.zeros(len(left), np.uint64)
    for o in range(before + 1):
        out |= ((left >= o) & (right >= length - o)).astype(np.uint64) << np.uint64(o)
    return out


def repeats(block: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, when: np.ndarray, before: int, length: int) -> np.ndarray:
    """Bits of the offsets at which a member's window occurs earlier in its group.

    block: contexts; group: numbers in order; left, right: bytes of its text before and after the anchor; when: ranks.
    """
    n = len(group)
    order, common = interleave(_eights(block[:, before:]), group)
    base = np.empty(n, np.int64)
    base[order] = np.arange(n)
    stretch = group.copy()  # of equal bytes before, within a group
    mask = np.zeros(n, np.uint64)
    never = np.iinfo(np.int64).max
    for o in range(before + 1):
        if o:
            byte = block[:, before - o]
            order = order[np.argsort(byte[order], kind="stable")]
            b, s = byte[order], stretch[order]
            new = np.concatenate(([True], (b[1:] != b[:-1]) | (s[1:] != s[:-1])))
            # those without company will have none further left either
            alone = new & np.concatenate((new[1:], [True]))
            stretch[order] = np.cumsum(new)
            order = order[~alone]
        else:
            s = stretch[order]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            order = order[~(new & np.concatenate((new[1:], [True])))]
        if not len(order):
            break
        part = np.cumsum(common < length - o)[base[order]]
        s = stretch[order]
        head = np.concatenate(([True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])))
        first = np.flatnonzero(head)
        time = np.where((left[order] >= o) & (right[order] >= length - o), when[order], never)
        earliest = np.repeat(np.minimum.reduceat(time, first), np.diff(np.append(first, len(order))))
        mask[order[(time > earliest) & (time < never)]] |= np.uint64(1) << np.uint64(o)
    return mask


_FOUND = "kind byte, key long, key2 long, row long, place int, after int, mask long, context binary"


def _rows(kind: int, n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    types = {"kind": pa.int8(), "key": pa.int64(), "key2": pa.int64(), "row": pa.int64(), "place": pa.int32(), "after": pa.int32(), "mask": pa.int64(), "context": pa.binary()}
    out = []
    for name, kind_of in types.items():
        value = pa.array(np.full(n, kind, np.int8)) if name == "kind" else columns.get(name)
        out.append(pa.nulls(n, kind_of) if value is None else value if isinstance(value, pa.Array) else pa.array(value).cast(kind_of))
    return pa.RecordBatch.from_arrays(out, list(types))


#: Kinds of rows: windows that repeat, suffixes to merge, single windows of common grams.
MARK, SUFFIX, WINDOW = 0, 1, 2


def _shard(piece: list[tuple], before: int, length: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of a piece of a shard in order, equal contexts folded into the earliest."""
    block, gram, row, place, right = (np.concatenate(x) for x in zip(*piece))
    left = np.minimum(place, before)
    group, by = np.unique(gram, return_inverse=True)
    first = np.lexsort((place, row, by))
    block, gram, row, place, right, left, by = (x[first] for x in (block, gram, row, place, right, left, by))
    order, common = interleave([*_eights(block[:, before:]), *_eights(block[:, :before]), left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)], by)
    width = 8 * (-(-length // 8) + -(-before // 8) + 1)
    head = common < width
    fold = order[~head]
    if len(fold):
        yield _rows(MARK, len(fold), row=row[fold], place=place[fold], mask=_valid(left[fold], right[fold], before, length).view(np.int64))
    stay = order[head]
    yield _rows(SUFFIX, len(stay), key=gram[stay].view(np.int64), row=row[stay], place=place[stay], after=right[stay], context=_binary(block[stay]))


def _windows(block: np.ndarray, row: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, before: int, length: int) -> Iterator[pa.RecordBatch]:
    """Every window around anchors of common grams, folded into the earliest of each text; rows come in order of time."""
    for o in range(before + 1):
        ok = np.flatnonzero((left >= o) & (right >= length - o))
        if not len(ok):
            continue
        flat = np.ascontiguousarray(block[ok, before - o : before - o + length]).reshape(-1)
        starts = np.arange(len(ok), dtype=np.int64) * length
        one = tx.span_hashes(flat, starts, starts + length)
        two = tx.span_hashes(flat[::-1].copy(), starts, starts + length)[::-1].copy()
        order = np.lexsort((two, one))
        same = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        again = np.zeros(len(ok), bool)
        again[order[1:]] = same
        at = ok[again]
        if len(at):
            yield _rows(MARK, len(at), row=row[at], place=place[at] - o, mask=np.ones(len(at), np.int64))
        at, k = ok[~again], np.flatnonzero(~again)
        yield _rows(WINDOW, len(at), key=one[k].view(np.int64), key2=two[k].view(np.int64), row=row[at], place=place[at] - o)


def _binary(block: np.ndarray) -> pa.Array:
    n, width = block.shape
    at = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(block))])


def shards(texts: DataFrame, length: int) -> DataFrame:
    """Marks and suffixes for texts (row, text, places): the places of repeated anchors."""
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, piece, n = Grams(), [], 0
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                lists = batch.column(2).slice(i, j - i)
                count = pc.list_value_length(lists).to_numpy()
                place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(j - i), count)
                row = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                for k in range(0, len(place), PIECE // 4):
                    p, o = place[k : k + PIECE // 4], owner[k : k + PIECE // 4]
                    low, high = offs[o], offs[o + 1]
                    at = low + p
                    piece.append((_context(data, low, high, at, before, length), grams.at(data, at), row[o], p, np.minimum(high - at, length)))
                    n += len(p)
                    if n >= PIECE:
                        yield from _shard(piece, before, length)
                        piece, n = [], 0
        if n:
            yield from _shard(piece, before, length)

    return texts.select("row", "text", "places").mapInArrow(run, _FOUND)


def _columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """key, row, place, after and the contexts of suffixes."""
    key, row, place, after = (t.column(k).to_numpy() for k in range(4))
    raw, offs = tx.string_buffers(t.column(4))
    return key, row, place.astype(np.int64), after, raw[offs[0] : offs[-1]].reshape(len(key), -1)


def merged(suffixes: DataFrame, length: int) -> DataFrame:
    """(row, place, mask) of the suffixes with a repeated window: the shards' runs of each gram are merged."""
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.whole_groups(batches, 1, PIECE):
            key, row, place, after, block = _columns(t)
            group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
            when = np.empty(len(key), np.int64)
            when[np.lexsort((place, row))] = np.arange(len(key))
            mask = repeats(block, group, np.minimum(place, before), after, when, before, length)
            at = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(place[at].astype(np.int32)), pa.array(mask[at].view(np.int64))], ["row", "place", "mask"])

    rows = suffixes.select("key", "row", "place", "after", "context")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, place int, mask long")


def windows(suffixes: DataFrame, length: int) -> DataFrame:
    """Marks and windows for the suffixes of common grams, taken apart into their offsets."""
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, row, place, after, block = _columns(batch)
                at = np.lexsort((place, row))
                yield from _windows(block[at], row[at], place[at], np.minimum(place, before)[at], after[at], before, length)

    return suffixes.select("key", "row", "place", "after", "context").mapInArrow(run, _FOUND)


def _later(windows: DataFrame) -> DataFrame:
    """(row, place, mask) of all windows but the earliest of each text; no group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.zeros((2, 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            one, two, row, place = (b.column(k).to_numpy() for k in range(4))
            new = np.ones(b.num_rows, bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            new[0] = last != (one[0], two[0])
            last = (one[-1], two[-1])
            # the first window of each text of it; that of the batch before is put in front
            firsts = np.concatenate([first, np.stack([row[new], place[new].astype(np.int64)])], 1)
            mine = firsts[:, np.cumsum(new)]
            first = mine[:, -1:]
            at = pa.array((row != mine[0]) | (place != mine[1]))  # one window may be given by two anchors
            row, place = b.column(2).filter(at), b.column(3).filter(at)
            yield pa.RecordBatch.from_arrays([row, place, pa.array(np.ones(len(row), np.int64))], ["row", "place", "mask"])

    rows = windows.select("key", "key2", "row", "place").repartition("key").sortWithinPartitions("key", "key2", "row", "place")
    return rows.mapInArrow(run, "row long, place int, mask long")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of texts (doc_id, text, marks): the bytes that no marked window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                lists = batch.column(2).slice(i, j - i)
                marks = lists.flatten()
                owner = np.repeat(np.arange(j - i), pc.list_value_length(lists).fill_null(0).to_numpy())
                place, mask = marks.field(0).to_numpy().astype(np.int64), marks.field(1).to_numpy().view(np.uint64)
                edge = np.zeros(len(data) + 1, np.int32)
                for k in range(0, len(place), 1 << 16):
                    some = mask[k : k + (1 << 16)]
                    base = place[k : k + (1 << 16)] + offs[owner[k : k + (1 << 16)]]
                    for o in range(64):
                        at = base[(some >> np.uint64(o)) & np.uint64(1) == 1] - o
                        if len(at):
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                starts, ends, first = tx.runs(covered, offs)
                own = np.searchsorted(offs, starts, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(starts - offs[own]), pa.array(ends - offs[own])], ["start", "stop"])
                left = data[~covered]
                gone = np.concatenate(([0], np.cumsum(covered)))
                at = offs - gone[offs]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(left)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans), kept], ["doc_id", "n_bytes", "spans", "kept"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def _ordered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, text), rows numbered in the order of the texts: the ids where they tell rows apart."""
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1):
        return docs.withColumn("row", F.col("doc_id"))
    return scratch.written(docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("row", F.monotonically_increasing_id()), "numbered")


def _marks(texts: DataFrame, length: int, hot: int, out: Scratch) -> DataFrame:
    """(row, place, mask) of all repeated windows of texts (row, text), stored in out; what led to it is removed."""
    with Scratch(texts.sparkSession) as passing:
        with Scratch(texts.sparkSession) as before:
            places = repeated_anchors(anchor_rows(texts.select("row", "text"), length)).groupBy("row").agg(F.collect_list("place").alias("places"))
            places = before.written(places, "anchors", "zstd")
            found = passing.written(shards(texts.join(places, "row"), length), "suffixes", "zstd")
        suffixes = found.where(F.col("kind") == SUFFIX)
        common = passing.written(suffixes.groupBy("key").count().where(F.col("count") > hot).select("key"), "common")
        parts = [found.where(F.col("kind") == MARK)]
        if common.head(1):
            apart = passing.written(windows(suffixes.join(common, "key", "left_semi"), length), "windows", "zstd")
            parts += [apart.where(F.col("kind") == MARK), _later(apart.where(F.col("kind") == WINDOW))]
            suffixes = suffixes.join(common, "key", "left_anti")
        marks = merged(suffixes, length)
        for part in parts:
            marks = marks.union(part.select("row", "place", "mask"))
        return out.written(marks, "marks", "zstd")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: spans of UTF-8 bytes covered by a string of `length` bytes that also
    starts earlier (a smaller id, or further ahead in the same text), and the bytes left."""
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 63}")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as passing:
        texts = _ordered(slim, passing)
        marks = _marks(texts, length, hot, passing)
        marks = marks.groupBy("row").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))
        return written(_cut(texts.join(marks, "row", "left").select("doc_id", "text", "marks"), length), "repeats")
