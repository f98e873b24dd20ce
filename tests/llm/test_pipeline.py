"""Every stage of the pipeline against brute-force versions, with null and repeated ids and further columns."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from stratavox.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, kept boolean, __h long, block long"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "xx", True, 1, 2) for r in rows], COLUMNS).repartition(3)


def bag(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


VOCAB = {"aa": ["that", "with", "house", "ing", "them", "when"], "bb": ["nicht", "auch", "straße", "über", "wir", "denn"]}


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = {lang: [f"{w}{s}" for w in v for s in ("", "er", "ly", "est", "un")] for lang, v in VOCAB.items()}
    rows = []
    for k in range(n):
        lang = rng.choice(list(words))
        rows.append((k, prose(rng, rng.randint(20, 60), words[lang]), lang, rng.choice(["s1", "s1", "s1", "s2", None])))
    for k in range(20):  # near and exact copies
        w = rows[k][1].split()
        if k % 2:
            w[len(w) // 2] = "changed"
        rows.append((1000 + k, " ".join(w), rows[k][2], "s1"))
    return rows


def test_language_stage(spark):
    rows = corpus()
    odd = [(2000, None, "aa", "s1"), (2001, "", None, "s1"), (2002, "12 34", None, None), (None, "that with house when them", None, "s1"), (2003, "日本語の文章です", None, "s1"), (5, "12", None, "s1"), (5, rows[5][1], "aa", "s1")]
    got = cp.language(spark, table(spark, rows + odd), "")
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert bag(got) == sorted(rows + [odd[3], odd[6]], key=str)
    assert bag(cp.language(spark, table(spark, [(1, "a b", None, "s"), (2, None, None, "s")]), "")) == [(1, "a b", None, "s"), (2, None, None, "s")]
    assert cp.language(spark, table(spark, rows).limit(0), "").collect() == []


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicate_stage(spark):
    rows = corpus(2)
    got = cp.near_dedup(spark, table(spark, rows), "")
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert bag(got) == sorted((r for i, r in enumerate(rows) if top(i) == i), key=str) and len(bag(got)) <= len(rows) - 10
    a, b, c = "p q r s t u v", "another text with seven words here now", "x1 x2 x3 x4 x5 x6"
    odd = [(3, a, "l", "s"), (5, a, "l", "s"), (5, b, "l", "s"), (7, c, "l", "s"), (7, c, "l", "s"), (None, "n o t h i n g", "l", "s"), (None, "n o t h i n g", "l", "s"), (9, None, "l", "s")]
    assert bag(cp.near_dedup(spark, table(spark, odd), "")) == sorted([odd[0], odd[2], odd[3], odd[5], odd[7]], key=str)
    assert cp.near_dedup(spark, table(spark, odd).limit(0), "").collect() == []


def test_decontamination_stage(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [prose(rng, n, vocab) for n in (15, 30, 6)]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(k, prose(rng, 60, vocab), "l", "s") for k in range(20)] + [(4, None, "l", "s"), (None, "", "l", "s")]
    dirty = [(4, f"x {items[0]} y", "l", "s"), (None, items[1].upper(), "l", "s"), (60, f"{prose(rng, 9, vocab)} {items[1][:60]}", "l", "s"), (61, items[2], "l", "s")]
    got = cp.benchmark_free(spark, table(spark, clean + dirty), str(tmp_path))
    assert bag(got) == sorted(clean, key=str)


def test_mix_and_pack_in_the_order_of_the_blocks(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = [r for r in corpus(4, 400)] + [(None, "null id", "l", "s2"), (7, rows7 := "again seven", "l", "s3")]
    docs = table(spark, rows)
    stage = cp.mix(spark, docs, "")
    assert stage.columns == docs.columns
    plan = sorted(mixing.mixed(docs, mixing.word_tokens(), **queries.MIX).collect(), key=lambda r: (r.block, r.position))
    text = {(i, s): t for i, t, _, s in rows}
    stage.write.parquet(f"{tmp_path}/mixed")
    back = spark.read.parquet(f"{tmp_path}/mixed")
    assert back.count() == len(plan) > len(rows)
    got = sorted(cp.tokens(spark, back, "").collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    at = 0
    for p, r in zip(plan, got, strict=True):
        ids = np.array([*whole.encode(text[p.doc_id, p.source], add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (p.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert order != sorted(order) and rows7


def test_tokens_of_a_table_without_files(spark):
    pytest.importorskip("public_tokenizers")
    got = sorted(cp.tokens(spark, table(spark, [(2, "b", "l", "s"), (1, "a", "l", "s")]), "").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2]


def test_whole_run(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows = [*corpus(5), (3000, None, "aa", "s1"), (3001, "benchmark words stand here in a row for all to see", "aa", "s1")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "benchmark words stand here in a row for all to see")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {3000, 3001} and ids >= set(range(20)) and not ids & set(range(1000, 1020, 2))
