import random
import re

from stratavox.llm.minhash_dedup import Scheme, deduplicated, near_duplicates


def brute(rows, words, low):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= low * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                x, y = sorted((a, b), key=lambda k: rows[k][0])
                up[y] = x
    return {rows[i][0]: (len(sets[i]), rows[top(i)][0]) for i in range(len(rows))}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 6))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append("\n".join([" ".join(w).upper()]) if rng.random() < 0.3 else " ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    k = len(rows)
    return rows + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "é x"), (k + 6, "same words " * 30000)]


def check(spark, rows, words, **more):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, node string, n int").repartition(5)
    out = near_duplicates(docs, words=words, **more).collect()
    want = brute(rows, words, 80)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_brute_force_two_words(spark):
    check(spark, corpus(), 2)


def test_brute_force_five_words_and_small_blocks(spark):
    check(spark, corpus(2), 5, block=2)


def test_a_family_that_no_single_member_links(spark):
    """A chain of near copies: neighbours link, ends do not; every member reaches the smallest."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(200)] = f"u{rng.random()}"
    check(spark, rows, 2, block=4)


def test_two_near_copies_whose_keys_are_led_by_longer_texts(spark):
    """A family of longer texts with the same passage leads every key that two near copies share (so with this seed)."""
    rng = random.Random(17)
    passage, tail = [f"p{i}" for i in range(100)], [f"t{i}" for i in range(45)]
    near = [*passage[:50], "changed", *passage[51:]]
    texts = [" ".join(passage), " ".join(near)]
    for k in range(30):
        tail[rng.randrange(45)] = f"u{k}"
        texts.append(" ".join((near if k % 2 else passage) + tail))
    check(spark, list(enumerate(texts)), 2, scheme=Scheme(chunks=2, slots=2))


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f g"), (None, "z"), (3, "a b c d e f g"), (4, None), (4, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (None, 1, None, True), (3, 3, 3, True), (4, 0, 4, True), (4, 0, 4, True)], key=str)


def test_rows_stay_by_text_where_ids_repeat_or_lack(spark):
    """A text of its own is not lost with the copy that bears its id, and one of equal rows stays."""
    a, b, c = ("p q r s t u v", "another text with seven words here", "x1 x2 x3 x4 x5 x6")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, "n o t h i n g"), (None, "n o t h i n g"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, component_id string, kept double")
    got = deduplicated(docs, 2)
    assert got.columns == docs.columns
    want = [(3, a), (5, b), (7, c), (None, "n o t h i n g"), (8, None), (8, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    clear = docs.where("doc_id in (3, 5)").where(docs.text == a)
    assert [r.doc_id for r in deduplicated(clear, 2).collect()] == [3]
    assert deduplicated(docs.limit(0)).collect() == []
    near = near_duplicates(spark.createDataFrame([(None, f"{a} w x y z {k}") for k in range(2)], "doc_id long, text string"), 2)
    assert {(r.component_id, r.kept) for r in near.collect()} == {(None, True)}


def test_words_that_a_polynomial_hash_confuses(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_pigeonhole_guarantee():
    s = Scheme(chunks=4, slots=3)
    assert (s.size, s.distance) == (12, 7)
