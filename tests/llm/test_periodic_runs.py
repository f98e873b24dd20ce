import random
import re

import pytest

from stratavox.llm.periodic_runs import best_run, cycled, find_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least, times):
    """All (start, length, period) with the smallest period, by comparing every two places."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            run = words[s : i + q]
            if len(run) >= max(least, times * q) and not any(all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                out.append((s, len(run), q))
    return sorted((s, m, q) for s, m, q in out)


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vocab = [f"w{k}" for k in range(rng.choice((1, 2, 3, 30)))]
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
            words += (unit * rng.randint(2, 9))[: rng.randint(3, 90)]
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 5))]
        out.append(rng.choice((" ", "  ", "\n", " \t")).join(words))
    return out + [None, "", " \n ", "one", "same words " * 5000, "é x y " * 9]


@pytest.mark.parametrize("least,times", [(24, 3), (3, 3), (1, 4)])
def test_against_all_periods(spark, least, times):
    rows = list(enumerate(texts(least, 120)))
    rows += [(None, rows[3][1]), (5, rows[4][1])]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = find_runs(docs, least, times).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = brute(w, least, times) if len(w) < 1000 else [(0, 10000, 2)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)


def test_cycles_and_best(spark):
    import zlib

    rows = [(i, " ".join(f"v{i}_{k}" for k in range(5 + 7 * i % 300))) for i in range(300)]
    got = {r.doc_id: r for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string"), arranged=cycled).withColumn("best", best_run()).collect()}
    some = 0
    for i, t in rows:
        w = t.split()
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = brute(w, 24, 3)
        some += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        assert [tuple(x) for x in got[i].runs] == runs and (tuple(got[i].best) if got[i].best else None) == best
    assert some > 5


def test_best_compares_exactly(spark):
    df = spark.sql("select array(struct(5L as start, 30L as length, 10L as period), struct(1L as start, 33L as length, 11L as period), struct(2L as start, 29L as length, 10L as period)) as runs")
    assert tuple(df.select(best_run().alias("b")).collect()[0].b) == (1, 33, 11)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find_runs(docs).collect() == []
    with pytest.raises(ValueError):
        find_runs(docs, min_exponent=2)
