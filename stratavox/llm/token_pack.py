"""Token ids in fixed-width bit-packed shard files.

Every whole text is encoded, an end id is appended, and the ids are stored in the fewest bits that hold the
vocabulary. A shard file is

    magic "STVXPACK", version, bits, block ids, number of blocks, ids, documents (little-endian, 8 bytes each)
    blocks: `block_ids` ids of `bits` bits each, least significant bit first, every block byte-aligned
    block offsets (blocks + 1 unsigned 64-bit), documents' ids, null flags and start positions
    trailer: offset of the block offsets, magic

so one block is read by its offset and unpacked by vectorised numpy, and any position of any document is found without
reading the rest.

Shards are ranges of the ascending (doc_id, text hash) order, or of another one that is given (`stored_order`: as the rows
lie in their files). A task encodes its range in bounded batches, appends
finished blocks to a temporary file in the shared folder and renames it when complete; the name is fixed by the
range, so a task that runs again after a lost executor replaces it with the same bytes. Only the manifest (a row for
each shard) travels; global starts are prefix sums over it.

Defined cases: a null or empty text is the end id alone; null ids come first; repeated ids are stored each, in order of
their texts' hashes; an empty table writes no file and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Scratch, new_path
from . import text as tx

MAGIC = b"STVXPACK"
VERSION = 1
BLOCK_IDS = 1 << 16
HEADER = 8 + 6 * 8


#: Lead bytes of the characters beyond ASCII that count as white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    # an id spans at most five bytes: gather them as one 64-bit word, shift and mask
    data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
    at = np.arange(n, dtype=np.int64) * bits
    first, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 7) // 8 + 1):
        word |= data[first + k] << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Appends documents to a shard; holds one unfinished block and the index."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.offsets = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(ids[at : at + self.block_ids])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.offsets[-1]
        nulls = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        head = np.array([VERSION, self.bits, self.block_ids, len(self.offsets) - 1, self.n_ids, len(self.docs)], "<u8")
        self.out.write(np.array(self.offsets, "<u8").tobytes() + ids.tobytes() + nulls.tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(head.tobytes() + np.array([index], "<u8").tobytes() + MAGIC)


class ShardReader:
    """Random access to a shard through a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._at(size - HEADER - 8, HEADER + 8)
        if tail[-8:] != MAGIC:
            raise ValueError("not a token shard")
        version, self.bits, self.block_ids, blocks, self.n_ids, docs = np.frombuffer(tail[:48], "<u8").tolist()
        if version != VERSION:
            raise ValueError(f"version {version} of the shard format is not known")
        index = int(np.frombuffer(tail[48:56], "<u8")[0])
        raw = self._at(index, 8 * (blocks + 1) + 17 * docs)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.docs = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64), self.n_ids)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), self.bits, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at positions [start, end) of the shard."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) in order, reading every block once."""
        k, held, at = 0, np.zeros(0, np.uint32), 0
        for d in range(len(self.docs)):
            start, end = int(self.starts[d]), int(self.starts[d + 1])
            parts = [held[start - at :]]
            have = at + len(held)
            while have < end:
                held, at = self.block(k), k * self.block_ids
                have, k = at + len(held), k + 1
                parts.append(held)
            ids = np.concatenate(parts)[: end - start]
            yield (None if self.nulls[d] else int(self.docs[d])), start, ids


class Grown:
    """An array that is appended to; `all` is what it holds."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1024, dtype), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            room = np.zeros(2 * (self.n + len(x)), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


class Slots:
    """Numbers of distinct 64-bit hashes: an open-addressed table that takes whole arrays at a time."""

    def __init__(self, bits: int = 21):
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.mask, self.n = np.uint64((1 << bits) - 1), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for new ones."""
        at, out, todo = (keys & self.mask).astype(np.int64), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            n = self.numbers[at[todo]]
            hit = (n >= 0) & (self.keys[at[todo]] == keys[todo])
            out[todo[hit]] = n[hit]
            todo = todo[(n >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keys that find does not know."""
        at, todo = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        self.n += len(keys)
        while len(todo):
            free = todo[self.numbers[at[todo]] < 0]
            self.numbers[at[free]] = numbers[free]  # of several that want one place, one gets it
            won = free[self.numbers[at[free]] == numbers[free]]
            self.keys[at[won]] = keys[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & int(self.mask)


class SegmentEncoder:
    """Ids of whole texts from a byte-level BPE tokenizer, with the ids of segments kept.

    Texts are cut before every single space between two characters that are surely not white space (the lead bytes of
    wider white space are taken as such). The pre-tokenizer starts a piece exactly there whatever stands around it, so the
    ids of the segments joined are the ids of the text; each distinct segment is encoded by the tokenizer once, until
    the store is full and starts anew. A stored segment is found by a hash and used only if its bytes are equal.
    """

    MAX_SEGMENTS, MAX_IDS = 600_000, 4_000_000

    def __init__(self, file: str, encode_special: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.encode_special_tokens = encode_special
        state = json.loads(self.model.to_str())
        pre = state.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and state.get("normalizer") is None
        #: Bytes of each token: its byte-level string has a character for each; added tokens are their text.
        lengths = {i: len(t) for t, i in self.model.get_vocab(with_added_tokens=False).items()} | {t["id"]: len(t["content"].encode()) for t in state.get("added_tokens", [])}
        self.bytes = np.array([lengths.get(i, 0) for i in range(max(lengths, default=0) + 1)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        #: Ids and bytes of the stored segments, and where each begins.
        self.ids, self.first_id, self.n_ids = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self.text, self.first_byte, self.n_bytes = Grown(np.uint8), Grown(np.int64), Grown(np.int64)

    def _add(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Encode and store segments; their numbers."""
        ids, first, n_ids = self._fresh(raw, starts, ends, joined)
        n_bytes, number = ends - starts, self.n_ids.n + np.arange(len(starts))
        self.first_id.add(self.ids.n + first)
        self.first_byte.add(self.text.n + np.cumsum(n_bytes) - n_bytes)
        self.n_ids.add(n_ids)
        self.n_bytes.add(n_bytes)
        self.ids.add(ids)
        self.text.add(data[np.repeat(starts - np.cumsum(n_bytes) + n_bytes, n_bytes) + np.arange(n_bytes.sum())])
        return number

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the segments, and which of them are cuts within a text."""
        cut = np.zeros(len(data), bool)
        if self.cuts and len(data) > 2:
            space = tx._SPACE[data]
            cut[1:-1] = (data[1:-1] == 32) & ~space[:-2] & ~space[2:] & ~_WIDE[data[2:]]
            cut[2:] &= data[:-2] != 0xC2
            cut[3:] &= ~_WIDE[data[:-3]]
        first = offs[:-1][offs[1:] > offs[:-1]]
        inner = cut.copy()
        inner[first] = False
        cut[first] = True
        starts = np.flatnonzero(cut)
        return starts, inner[starts]

    def _fresh(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, each segment's first id, number of ids) of new segments. Those that are cut at both ends are encoded as
        runs of text of their own, since the cuts hold there too, and told apart by the lengths of the tokens in bytes."""
        some, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        runs = [some[k : k + 2048] for k in range(0, len(some), 2048)]
        texts = [b"".join([raw[a:b] for a, b in zip(starts[r].tolist(), ends[r].tolist())]).decode("utf-8") for r in runs]
        texts += [raw[starts[k] : ends[k]].decode("utf-8") for k in alone.tolist()]
        got = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        before = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64)
        first, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for r, g, at in zip(runs, got, before.tolist()):
            place = np.concatenate(([0], np.cumsum(self.bytes[g])))
            cut = np.searchsorted(place, np.concatenate(([0], np.cumsum(ends[r] - starts[r]))))
            first[r], size[r] = at + cut[:-1], np.diff(cut)
        first[alone], size[alone] = before[len(runs) : -1], np.diff(before[len(runs) :])
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), first, size

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, the texts' bounds)."""
        if self.slots.n > self.MAX_SEGMENTS or self.ids.n > self.MAX_IDS:
            self.clear()
        starts, inner = self._starts(data, offs)
        ends = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
        keys, first, which = np.unique(tx.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        slot = self.slots.find(keys)
        new, raw = np.flatnonzero(slot < 0), None
        if len(new):
            pick, raw = first[new], data.tobytes()
            closed = np.append(inner[1:], False)
            slot[new] = self._add(raw, data, starts[pick], ends[pick], inner[pick] & closed[pick])
            self.slots.add(keys[new], slot[new])
        slot, n = slot[which], ends - starts
        same = self.n_bytes.all[slot] == n
        same &= tx.same_spans(data, starts, self.text.all, self.first_byte.all[slot], np.where(same, n, 0))
        if not same.all():  # another segment's hash
            odd = np.flatnonzero(~same)
            slot[odd] = self._add(raw or data.tobytes(), data, starts[odd], ends[odd], np.zeros(len(odd), bool))
        size = self.n_ids.all[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.first_id.all[slot] - total[:-1], size) + np.arange(total[-1])
        return self.ids.all[at], total[np.searchsorted(starts, offs)]


_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder(file: str, encode_special: bool = False) -> SegmentEncoder:
    """The encoder of this Python worker, kept over tasks."""
    key = (file, encode_special)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentEncoder(file, encode_special)
    return _ENCODERS[key]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def stored_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows of docs, as read from the files of one write, were written; None for other tables."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    file = F.col("_metadata.file_path")
    return [F.regexp_extract(file, "part-([0-9]+)[^/]*$", 1).try_cast("long"), file, F.col("_metadata.row_index")]


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, encode_special: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Encode and write the shards under path; the manifest (shard, file, n_docs, n_ids, start), also written there.

    tokenizer: a tokenizers JSON file that every executor can open. encode_special: read special tokens' strings in a
    text as ordinary text. order: columns over docs by which documents are stored, ascending ids by default.
    """
    from tokenizers import Tokenizer

    bits = bits_for(max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()))
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keys = [k.alias(f"k{n}") for n, k in enumerate(order or [doc_id, F.xxhash64(text)])]
    names = [f"k{n}" for n in range(len(keys))]
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), *keys)
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer, out = None, None
        disk, root = _filesystem(path)
        final = str(PurePosixPath(root) / f"shard-{shard:06d}.bin")
        part = f"{final}.{uuid.uuid4().hex}.tmp"
        try:
            for batch in batches:
                if batch.num_rows and writer is None:
                    disk.create_dir(root, recursive=True)
                    out = disk.open_output_stream(part)
                    writer = ShardWriter(out, bits, block_ids)
                doc_ids = batch.column(0).to_pylist()
                for i, j, data, offs in tx.slices(batch.column(1)):
                    ids, bounds = encoder(tokenizer, encode_special).encode(data, offs)
                    for k in range(j - i):
                        own = np.empty(bounds[k + 1] - bounds[k] + 1, np.uint32)
                        own[:-1], own[-1] = ids[bounds[k] : bounds[k + 1]], end_id
                        writer.add(doc_ids[i + k], own)
            if writer is not None:
                writer.close()
                out.close()
                disk.move(part, final)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [PurePosixPath(final).name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})
        except BaseException:
            if out is not None:
                out.close()
                if disk.get_file_info(part).type != pafs.FileType.NotFound:
                    disk.delete_file(part)
            raise

    with Scratch(docs.sparkSession) as passing:
        shards = passing.written(rows.mapInArrow(run, "shard int, file string, n_docs long, n_ids long"), "shards")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
        manifest = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        manifest.write.parquet(f"{path}/manifest")
        return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, unpacked from the shard files."""
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "file", "start")
    manifest = manifest.repartition(max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _filesystem(path)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = str(PurePosixPath(root) / name)
                with disk.open_input_file(file) as f:
                    reader = ShardReader(f, disk.get_file_info(file).size)
                    rows: list[tuple] = []
                    for doc_id, at, ids in reader.documents():
                        rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, path: str | None = None, **more) -> DataFrame:
    """Write the documents' ids as shards (to a new folder in the shared one by default) and read them back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer, **more)
    return read_shards(docs.sparkSession, path)
