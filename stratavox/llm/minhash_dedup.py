"""MinHash near-duplicates found by a multi-index Hamming join.

Every text becomes a set of word shingles and a signature of b-bit MinHash slots. The slots are split into
`chunks`; two signatures that differ in at most 2 * chunks - 1 slots have a chunk with at most one error
(pigeonhole), so indexing each chunk once per possible error position (that slot left out) finds every such pair.
Pairs under the distance threshold are confirmed on full shingle sets, and components are taken over the
confirmed links.

Scale: equal sets collapse to one class by a partially aggregated group-by before anything is paired. Within an
index key, members are first compared with one pivot only (linear). Keys that then still hold several components are
taken through their signatures in blocks of bounded size, the largest component against the rest and the rest among
themselves; what remains close forms clusters of components, whose full sets are compared in such blocks once, by
matrix products where many pairs remain. Blocks give stars, not pairs. So no link between different texts is lost, no
key or family is gathered in one task, and no pairs are listed for a group. What is reused is written to the shared
folder, and removed once the links it led to are written.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing; a text with
fewer words than a shingle is one shingle; where ids are null or repeat, rows get numbers of their own first, so every row
links by its own text, and a component bears its smallest id (null if it has none); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected, forest
from ..sources.store import Scratch, written
from . import text as tx


@dataclass(frozen=True)
class Scheme:
    """chunks x slots MinHash values of 16 bits; all pairs that differ in at most `distance` slots are found."""

    chunks: int = 13
    slots: int = 5
    seed: int = 7

    @property
    def size(self) -> int:
        return self.chunks * self.slots

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1

    def constants(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.integers(0, 2**63, self.size, dtype=np.uint64), rng.integers(0, 2**62, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Members and shingles of one block when the remaining pairs are compared.
BLOCK = 1024
SHINGLES_PER_BLOCK = 500_000
#: Ids that may be broadcast to pick the texts whose sets are needed; above it the texts are joined by a shuffle.
BROADCAST_IDS = 500_000


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as binary values."""
    width = rows.shape[1] * rows.itemsize
    flat = np.ascontiguousarray(rows)
    offs = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(flat)]).cast(pa.binary())


def _matrix(col: pa.Array | pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    """Equal-length binary values as a 2-d array."""
    raw, offs = tx.string_buffers(col)
    return raw[offs[0] : offs[-1]].view(dtype).reshape(-1, width)


def signatures(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): set_a and set_b hash the whole set, sig holds the slots (null if empty)."""
    xor, mul = scheme.constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                data = tx.LOWER[data]
                starts, ends, bounds = tx.words(data, offs)
                sets = tx.shingle_sets(tx.span_hashes(data, starts, ends), bounds, words)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                hashes = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, scheme.size), np.uint16)
                if len(some):
                    flat = np.concatenate([sets[x] for x in some])
                    at = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                    hashes[0, some] = np.add.reduceat(tx.mix(flat), at)
                    hashes[1, some] = np.add.reduceat(tx.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for k in range(scheme.size):
                        least = np.minimum.reduceat((flat ^ xor[k]) * mul[k], at)
                        sig[some, k] = tx.mix(least) >> np.uint64(48)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(hashes[0].view(np.int64)), pa.array(hashes[1].view(np.int64)), _fixed_binary(sig)], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def index_keys(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, node): for every chunk and every slot of it left out, the remaining slots as one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sig = _matrix(part.column(1), "<u2", scheme.size).reshape(-1, scheme.chunks, scheme.slots).astype(np.uint64)
                keys = np.empty((len(sig), scheme.chunks, scheme.slots), np.uint64)
                for out in range(scheme.slots):
                    h = np.arange(scheme.chunks, dtype=np.uint64)[None, :] * np.uint64(64) + np.uint64(out + 1)
                    h = np.repeat(tx.mix(h), len(sig), 0)
                    for s in range(scheme.slots):
                        if s != out:
                            h = tx.mix(h + sig[:, :, s])
                    keys[:, :, out] = h
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), scheme.size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _close(pairs: DataFrame, classes: DataFrame, scheme: Scheme, low: int) -> DataFrame:
    """Pairs whose signatures differ in at most scheme.distance slots and whose sizes allow the similarity."""
    limit, size = scheme.distance, scheme.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(2), "<u2", size) != _matrix(batch.column(3), "<u2", size)).sum(1) <= limit
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    side = {x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    both = both.where((100 * F.col("na") >= low * F.col("nb")) & (100 * F.col("nb") >= low * F.col("na")))
    return both.select("a", "b", "siga", "sigb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(node, set): the full shingle sets of the needed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tx.slices(batch.column(1)):
                data = tx.LOWER[data]
                starts, ends, bounds = tx.words(data, offs)
                sets = tx.shingle_sets(tx.span_hashes(data, starts, ends), bounds, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    rows = docs.select(F.col("doc_id").alias("node"), "text")
    few = need.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(need) if few else need, "node", "left_semi").mapInArrow(run, "node long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, low: int) -> DataFrame:
    """Pairs with 100 * intersection >= low * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(both > 0 and 100 * both >= low * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _crossing(t: pa.Table, scheme: Scheme, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a cell's pairs of different components that the sizes and signatures leave as candidates.

    Columns: cell (4), side, comp, node, n, sig. Pairs go from side 0 to side 1, in a diagonal cell from row to row.
    """
    side, comp, n = (t.column(k).to_numpy() for k in (4, 5, 7))
    sig = _matrix(t.column(8), "<u2", scheme.size)
    left = np.flatnonzero(side == 0)
    same = t.column(1)[0].as_py() == 1 and t.column(2)[0].as_py() == t.column(3)[0].as_py()
    right = left if same else np.flatnonzero(side == 1)
    a, b = [left[:0]], [left[:0]]
    for x in left.tolist():
        ok = right[(comp[right] != comp[x]) & (100 * n[right] >= low * n[x]) & (100 * n[x] >= low * n[right])]
        ok = ok[(sig[ok] != sig[x]).sum(1) <= scheme.distance]
        ok = ok[ok > x] if same else ok
        a.append(np.full(len(ok), x))
        b.append(ok)
    return np.concatenate(a), np.concatenate(b)


def _cells(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, comp, node, n, ...) dealt to cells (key, kind, i, j, side, ...) that cover all pairs of different
    components of a key: its largest component against the rest (kind 0), and the rest among themselves (kind 1).

    A block has about `block` members, and about SHINGLES_PER_BLOCK shingles if that is fewer.
    """
    parts = rows.groupBy(key, "comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    heads = parts.groupBy(key).agg(F.count("*").alias("comps"), F.sum("m").alias("all"), F.sum("s").alias("size"), F.max(F.struct("m", "comp", "s")).alias("top"))
    blocks = lambda m, s: F.greatest(F.ceil(m / F.lit(block)), F.ceil(s / F.lit(SHINGLES_PER_BLOCK))).cast("int")
    rest = blocks(F.col("all") - F.col("top.m"), F.col("size") - F.col("top.s"))
    heads = heads.where("comps > 1").select(key, F.col("top.comp").alias("major"), blocks(F.col("top.m"), F.col("top.s")).alias("ga"), rest.alias("gb"))
    rows = rows.join(heads, key)
    spread = lambda g: F.pmod(F.xxhash64("node"), F.col(g)).cast("int")
    cell = lambda kind, i, j, s: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), s.alias("side"))
    upto = lambda g: F.sequence(F.lit(0), F.col(g) - 1)
    rows = rows.withColumn("own", F.when(F.col("comp") == F.col("major"), spread("ga")).otherwise(spread("gb")))
    from_major = F.transform(upto("gb"), lambda j: cell(0, F.col("own"), j, F.lit(0)))
    to_major = F.transform(upto("ga"), lambda i: cell(0, i, F.col("own"), F.lit(1)))
    among = F.transform(upto("gb"), lambda j: cell(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") <= j, 0).otherwise(1)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("comp") == F.col("major"), from_major).otherwise(F.concat(to_major, among))))
    return rows.select(F.col(key).alias("key"), "cell.kind", "cell.i", "cell.j", "cell.side", "comp", "node", "n")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")


def _families(keyed: DataFrame, nodes: DataFrame, found: DataFrame, scheme: Scheme, low: int, block: int, passing: Scratch) -> DataFrame:
    """(node, cluster): clusters hold together all candidates of different components that share a key.

    Within a cell, candidates are joined to the smallest member of their local group, so a cell gives at most a row a
    member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.grouped(batches, 4):
            x, y = _crossing(t, scheme, low)
            if len(x):
                comp = t.column(5).to_numpy()
                u, v = forest(comp[x], comp[y])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    known = keyed.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    known = passing.written(known.join(nodes.select("node", "n"), "node"), "known")
    cells = _cells(known, "key", block).join(nodes.select("node", "sig"), "node")
    order = ["key", "kind", "i", "j", "side", "comp", "node", "n", "sig"]
    near = passing.written(_dealt(cells.select(order)).mapInArrow(run, "a long, b long").distinct(), "near")
    clusters = connected(near)
    clusters = clusters.union(clusters.select("component", "component").distinct())
    members = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    return passing.written(members.join(clusters.select(F.col("node").alias("comp"), F.col("component").alias("cluster")), "comp"), "families")


def _within(families: DataFrame, nodes: DataFrame, sets: DataFrame, scheme: Scheme, low: int, block: int) -> DataFrame:
    """Confirmed links between different components of a cluster, as stars within each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.grouped(batches, 4):
            x, y = _crossing(t, scheme, low)
            if len(x):
                both = _intersections([np.frombuffer(s.as_buffer(), np.uint64) for s in t.column(9).combine_chunks()], x, y)
                n, node = t.column(7).to_numpy(), t.column(6).to_numpy()
                ok = 100 * both >= low * (n[x] + n[y] - both)
                if ok.any():
                    u, v = forest(node[x[ok]], node[y[ok]])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    rows = families.join(nodes.select("node", "n"), "node")
    cells = _cells(rows, "cluster", block).join(nodes.select("node", "sig"), "node").join(sets, "node")
    order = ["key", "kind", "i", "j", "side", "comp", "node", "n", "sig", "set"]
    return _dealt(cells.select(order)).mapInArrow(run, "a long, b long")


def _intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered x and y: pair by pair, or by products of 0/1 columns if many."""
    if len(x) <= 64:
        out = []
        for a, b in zip(x.tolist(), y.tolist()):
            p, q = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            out.append(int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()))
        return np.array(out, np.int64)
    rows, cols = np.unique(x), np.unique(y)
    used = np.unique(np.concatenate([rows, cols]))
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[word] > 1  # others cannot meet
    word, owner = word[shared], owner[shared]
    _, word = np.unique(word, return_inverse=True)
    total = np.zeros((len(rows), len(cols)), np.float32)
    at_row, at_col = np.searchsorted(used, rows), np.searchsorted(used, cols)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for first in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
        a, b = np.searchsorted(word, (first, first + 4096))
        some = np.zeros((len(used), 4096), np.float32)
        some[owner[a:b], word[a:b] - first] = 1
        total += some[at_row] @ some[at_col].T
    return np.rint(total[np.searchsorted(rows, x), np.searchsorted(cols, y)]).astype(np.int64)


#: A row's own number where ids do not tell rows apart.
ROW = "__row"


def _clear_ids(docs: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    return not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _components(docs: DataFrame, words: int, low: int, scheme: Scheme, block: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text) with ids of their own."""
    with Scratch(docs.sparkSession) as passing:
        base = passing.written(signatures(docs, words, scheme), "signatures")
        classes = base.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"))
        classes = passing.written(classes, "classes")
        found = _linked(docs, classes, words, low, scheme, block)
        named = classes.join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
        out = base.join(named, ["set_a", "set_b"], "left")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
        return written(out.select("doc_id", "n_shingles", component.alias("component_id")), "components")


def near_duplicates(docs: DataFrame, words: int = 5, low: int = 80, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: component_id is the smallest doc_id reachable over links.

    Two documents are linked if 100 * |intersection| >= low * |union| of their sets of `words`-word shingles
    (A-Z lower-cased). kept is true for the document whose id the component bears.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if _clear_ids(slim):
        return _components(slim, words, low, scheme or Scheme(), block).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    with Scratch(docs.sparkSession) as passing:
        rows = _numbered(slim, passing)
        out = _components(rows.select(F.col(ROW).alias("doc_id"), "text"), words, low, scheme or Scheme(), block)
        out = out.withColumnRenamed("doc_id", ROW).join(rows.select(ROW, "doc_id"), ROW)
        names = out.groupBy("component_id").agg(F.min("doc_id").alias("least"))
        out = out.join(names, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))
        return written(out, "components")


def deduplicated(docs: DataFrame, words: int = 5, low: int = 80, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of docs for each component, that with the smallest id; rows without words all stay."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if _clear_ids(slim):
        found = near_duplicates(docs, words, low, scheme, id_col, text_col, block)
        gone = written(found.where("not kept").select(F.col("doc_id").alias(ROW)), "duplicates")
        return docs.join(gone, F.col(id_col).cast("long") == F.col(ROW), "left_anti").select(docs.columns)
    rows = _numbered(docs, Scratch(docs.sparkSession))
    out = _components(rows.select(F.col(ROW).alias("doc_id"), F.col(text_col).cast("string").alias("text")), words, low, scheme or Scheme(), block)
    out = out.withColumnRenamed("doc_id", ROW).join(rows.select(ROW, F.col(id_col).alias("id")), ROW)
    first = out.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    stay = written(first.select(f"first.{ROW}"), "firsts")
    return rows.join(stay, ROW, "left_semi").select(docs.columns)


def _linked(docs: DataFrame, classes: DataFrame, words: int, low: int, scheme: Scheme, block: int) -> DataFrame:
    """(node, component) of all classes with a confirmed link."""
    nodes = classes.select("node", "n", "sig")
    keys = index_keys(nodes, scheme)
    with Scratch(docs.sparkSession) as passing:
        crowded = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
        keyed = passing.written(keys.join(crowded, "key"), "keyed")
        # a key's pivot is its member with most company over all keys: the middle of a family links most of it
        company = keyed.groupBy("node").agg(F.sum("members").alias("company"))
        pivots = keyed.join(company, "node").groupBy("key").agg(F.max(F.struct(F.col("company"), (-F.col("node")).alias("node"))).alias("top"))
        stars = keyed.join(pivots.select("key", (-F.col("top.node")).alias("pivot")), "key").where("node <> pivot")
        stars = stars.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        close = passing.written(_close(stars, nodes, scheme, low), "close")
        ids = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
        sets = passing.written(_sets(docs, ids(close), words), "sets")
        links = passing.written(_confirmed(close, sets, low), "links")
        found = connected(links)
        families = _families(keyed.where("members > 2").select("key", "node"), nodes, found, scheme, low, block, passing)
        if families.head(1):
            missing = families.select("node").join(sets.select("node"), "node", "left_anti")
            more = passing.written(_sets(docs, missing, words), "sets")
            found = connected(links.union(_within(families, nodes, sets.union(more), scheme, low, block)))
    return found
