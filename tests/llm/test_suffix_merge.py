import hashlib
import random

import numpy as np
import pytest

from stratavox.llm import suffix_merge
from stratavox.llm.suffix_merge import GRAM, anchors, Grams, interleave, remove_repeats

ODD = [None, "", "one", "x" * 5000, "ab" * 700, "é" * 300, "a\0b" * 200, "\0" * 400]


def brute(rows, length):
    """(n_bytes, spans, kept) by row: the first start of every string of `length` bytes stays."""
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, texts[k]))
    seen, out = set(), {}
    for k in order:
        b = texts[k]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out[k] = (len(b), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [prose(rng.randint(8, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 30)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.7:
            cut = rng.choice(shared)
            parts.insert(rng.randint(0, len(parts)), cut[rng.randint(0, 20) : len(cut) - rng.randint(0, 20)])
        texts.append(" ".join(parts))
        if rng.random() < 0.3:
            t = texts[-1]
            texts.append(t[: len(t) // 2] + rng.choice("xyz") + t[len(t) // 2 :])
    return texts + [t for t in texts[:5]] + ODD + ODD


def check(spark, rows, length=100, **more):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, row int, key string").repartition(7)
    got = remove_repeats(docs, length, **more).collect()
    want = sorted((str(rows[k][0]), *v) for k, v in brute(rows, length).items())
    assert sorted((str(r.doc_id), r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("hot", [suffix_merge.HOT, 3])
def test_against_all_strings(spark, hot):
    texts = corpus(1, 80)
    random.Random(2).shuffle(texts)
    check(spark, [(7 * i, t) for i, t in enumerate(texts)], hot=hot)


def test_other_length_and_ids(spark):
    texts = corpus(3, 25)
    check(spark, list(enumerate(texts)), length=57)
    check(spark, [(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts)])
    check(spark, [(None, t) for t in texts], hot=2)


def test_small_pieces(spark, monkeypatch):
    """Shards of a few suffixes, merges of a few groups."""
    monkeypatch.setattr(suffix_merge, "PIECE", 40)
    rows = list(enumerate(corpus(4, 30)))
    want = brute(rows, 100)
    left = {}
    before = 100 - GRAM
    # the same steps without Spark, so that the bound reaches them
    grams, held = Grams(), []
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        offs = np.array([0, len(raw)])
        at = anchors(grams(raw), offs, 100)
        left[i] = np.zeros(len(raw), bool)
        for a in at.tolist():
            one = np.array([a])
            held.append((suffix_merge._context(raw, offs[:1], offs[1:], one, before, 100), grams.at(raw, one), np.array([i]), one, np.minimum(offs[1:] - one, 100)))
    out, suffixes = [], []
    for k in range(0, len(held), 40):
        for b in suffix_merge._shard(held[k : k + 40], before, 100):
            (out if b.column(0)[0].as_py() == suffix_merge.MARK else suffixes).extend(b.to_pylist())
    suffixes.sort(key=lambda r: r["key"])
    key = np.array([r["key"] for r in suffixes])
    block = np.array([list(r["context"]) for r in suffixes], np.uint8)
    row, place, after = (np.array([r[c] for r in suffixes]) for c in ("row", "place", "after"))
    when = np.empty(len(row), np.int64)
    when[np.lexsort((place, row))] = np.arange(len(row))
    mask = suffix_merge.repeats(block, np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))), np.minimum(place, before), after, when, before, 100)
    marks = [(r["row"], r["place"], r["mask"]) for r in out] + list(zip(row.tolist(), place.tolist(), mask.tolist()))
    for r, p, m in marks:
        for o in range(before + 1):
            if m >> o & 1:
                left[r][p - o : p - o + 100] = True
    for k, (i, t) in enumerate(rows):
        assert left[i].sum() == want[k][0] - len(want[k][2])


def test_interleave_is_the_sorted_order():
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 99, (400, 20), dtype=np.uint8)
    rows[200:] = rows[rng.integers(0, 200, 200)]
    group = np.sort(rng.integers(0, 5, 400))
    order, common = interleave(suffix_merge._eights(rows), group)
    want = sorted(range(400), key=lambda k: (group[k], bytes(rows[k]), k))
    assert order.tolist() == want
    for i in range(1, 400):
        a, b = rows[order[i - 1]], rows[order[i]]
        same = int(np.cumprod(a == b).sum())
        assert common[i] == (0 if group[order[i]] != group[order[i - 1]] else 24 if same == 20 else same)


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(6)
    for data in (rng.integers(0, 4, 3000, dtype=np.uint8), np.zeros(500, np.uint8), np.tile(np.arange(7, dtype=np.uint8), 90)):
        offs = np.array([0, 0, 130, 200, len(data)])
        h = Grams()(data)
        at = set(anchors(h, offs, 100).tolist())
        seen = {}
        for lo, hi in zip(offs[:-1], offs[1:]):
            for s in range(lo, hi - 99):
                inside = tuple(a - s for a in range(s, s + 100 - GRAM + 1) if a in at)
                assert inside
                # some anchor's offset is common to all places of the window
                w = data[s : s + 100].tobytes()
                seen[w] = seen.get(w, set(inside)) & set(inside)
        assert all(seen.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []


def test_digest(spark):
    r = remove_repeats(spark.createDataFrame([(1, "ab" * 60), (0, "ab" * 60)], "doc_id long, text string")).where("doc_id = 1").collect()[0]
    assert (r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) == (120, [(0, 120)], hashlib.sha256(b"").hexdigest())
