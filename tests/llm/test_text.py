import random
import re

import numpy as np
import pyarrow as pa

from stratavox.llm import text as tx


def test_words_and_hashes_match_a_regular_expression():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\t\n\x0b\u00a0\U0001f642 ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "x"]
    seen = {}
    for i, j, data, offs in tx.slices(pa.array([*texts, None]), 500):
        starts, ends, bounds = tx.words(data, offs)
        h = tx.span_hashes(data, starts, ends)
        for k in range(j - i):
            want = re.findall(r"[^\x20\x09-\x0D]+", ([*texts, ""])[i + k])
            got = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])]
            assert got == want
            for w, x in zip(want, h[bounds[k] : bounds[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_windows_are_position_free():
    h = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    w = tx.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(tx.windows(h, 9)) == 0


def test_a_word_and_its_complement_hash_apart():
    """Words by the parity of the bits of each place, which polynomial hashes modulo 2^64 cannot tell from their complement."""
    for size in (16, 64, 128, 1024, 2048):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        _, _, data, offs = next(tx.slices(pa.array([f"x {word} y {other} {word}"])))
        h = tx.span_hashes(data, *tx.words(data, offs)[:2])
        assert h[1] != h[3] and h[1] == h[4]


def test_equal_spans():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 7, 8, 9, 127, 128, 129, 300)))) for _ in range(200)]
    texts += texts[:50] + [t[:-1] + "c" for t in texts[:50] if t]
    _, _, data, offs = next(tx.slices(pa.array(texts)))
    for a in range(0, len(texts), 7):
        n = np.diff(offs)
        n = np.where(n == n[a], n, 0)
        got = tx.same_spans(data, offs[:-1], data, np.full(len(texts), offs[a]), n)
        assert got.tolist() == [k == 0 or texts[x] == texts[a] for x, k in enumerate(n.tolist())]
