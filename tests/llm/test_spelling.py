import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratavox.llm import spelling
from stratavox.llm.spelling import crc32_spans, near_pairs, one_edit, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows, thin):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if thin and i is not None and h % thin == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, thin):
    n = words_of(rows, thin)
    out = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v)) if close else None
        out[w] = (len(close), best if best and n[best] >= 2 * n[w] else None)
    rows = []
    for w, (k, form) in out.items():
        root = w
        while out[root][1]:
            root = out[root][1]
        rows.append((w, n[w], k, form, n[form] if form else None, root))
    return sorted(rows)


def corpus(seed, n, letters="abcdeéüÀ×"):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(150)]
    for w in list(vocab):
        k = rng.randrange(len(w))
        vocab += [w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :]][: rng.randint(0, 2)]
    weights = [rng.paretovariate(0.8) for _ in vocab]
    rows = []
    for i in range(n):
        ws = rng.choices(vocab, weights, k=rng.randint(0, 60))
        rows.append((i, rng.choice((" ", "-", "1", " ,\n")).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in ws)))
    return rows + [(n, None), (n + 1, ""), (None, rows[0][1]), (0, rows[1][1]), (n + 2, "x" * 5000 + " " + "y" * 5000), (n + 3, ("x" * 5000 + " ") * 3 + ("x" * 4999 + " ") * 9), (n + 4, "Ÿ日本 1234567 ÿÿÿÿÿ"), (n + 5, "chainzz " * 3 + "chainzy " * 7 + "chaizzy " * 20)]


@pytest.mark.parametrize("thin,cell", [(97, 4000), (11, 30), (None, 7)])
def test_against_all_pairs(spark, thin, cell):
    rows = corpus(cell, 120)
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(5)
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(docs, thin=thin, cell=cell).collect())
    want = brute(rows, thin)
    assert got == want and (cell == 4000 or any(r[3] and r[5] != r[3] for r in want))


def test_small_sample_of_planes(spark):
    rows = corpus(9, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(docs, thin=13, sample=40, cell=10).collect())
    assert got == brute(rows, 13)


def test_searches_find_all_and_only_edits():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    long = ["x" * 100, "x" * 99 + "y", "x" * 98 + "yy", "y" + "x" * 99]
    got = {(a, b) for x, y in near_pairs([w.encode() for w in long], [w.encode() for w in long], leaf=1) for a, b in zip(x.tolist(), y.tolist())}
    assert got == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 3), (3, 0)}
    for less in (0, 1):
        other = sorted({"".join(rng.choice("abc") for _ in range(6 - less)) for _ in range(200)})
        got = sorted((other[a], words[b]) for x, y in near_pairs([w.encode() for w in words], [w.encode() for w in other], leaf=3) for a, b in zip(x, y))
        assert got == sorted((a, b) for a in other for b in words if near(a, b))
    a = np.array([list(b"abcd")], np.uint8)
    assert one_edit(a, np.array([list(b"abxd")], np.uint8)) and not one_edit(a, a) and not one_edit(a, np.array([list(b"bacd")], np.uint8))


def test_crc_of_spans():
    data = np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8)
    starts = np.array([0, 5, 5, 100, 400])
    ends = np.array([0, 6, 68, 165, 3000])
    state = np.array([zlib.crc32(b"7:"), 0, zlib.crc32(b"x"), 1, 2], np.uint32)
    assert crc32_spans(data, starts, ends, state).tolist() == [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, state)]


def test_bounds(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(docs).collect() == []
    with pytest.raises(ValueError):
        variants(docs, ratio=1)
    assert spelling.SAMPLE > 0
