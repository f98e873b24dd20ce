"""Fitting samples above their bounds, where ids are null or one id stands on every row; the ordinal fit's optimum."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import language_id, ordinal_quality, pii_semicrf, quality_forest, queries

VOCAB = {"aa": ["that", "with", "house", "ing", "there"], "bb": ["nicht", "auch", "straße", "über", "haus"], "cc": ["être", "leçon", "pour", "eau", "maison"]}
IDS = ["cast(null as long)", "4L", "id"]


@pytest.mark.parametrize("doc_id", IDS)
def test_languages_above_the_bound(spark, doc_id):
    n = 6_000  # a language; the bound is 4,000
    word = lambda k: F.element_at(F.array(*[F.expr(f"map({', '.join(repr(x) for lang, ws in VOCAB.items() for x in (lang, ws[j]))})[lang]") for j in range(5)]), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5)).cast("int") + 1)
    docs = spark.range(3 * n).withColumn("lang", F.element_at(F.array(*map(F.lit, VOCAB)), (F.col("id") % 3).cast("int") + 1))
    docs = docs.select(F.expr(doc_id).alias("doc_id"), "lang", F.concat_ws(" ", *[word(k) for k in range(12)]).alias("text"))
    model = queries.language_model(docs)
    assert sorted(model.languages) == sorted(VOCAB) and (model.fpr > 0).all()
    out = language_id.predict(docs, model, ["lang"])
    assert out.where("lang <> lang_pred").count() == 0
    assert language_id.known(docs, model, min_score=0.1).count() == 3 * n


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([("some words", f"l{k}") for k in range(5)], "text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit(docs)


@pytest.mark.parametrize("doc_id", IDS)
def test_forests_above_the_bound(spark, doc_id, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["plain", "words", "of", "a", "text"]) + str(rng.randrange(900)) for _ in range(rng.randint(20, 90)))) for i in range(900)]
    rows += [(900 + i, " ".join(rng.choice(["#$%", "&|<", "a*b"]) + str(rng.randrange(9000)) for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string").select(F.expr(doc_id).alias("doc_id"), "text", (F.col("id") >= 900).alias("junk"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    grown = []
    grow = quality_forest.grow
    monkeypatch.setattr(quality_forest, "grow", lambda rows, *a: (grown.append(len(rows)), grow(rows, *a))[1])
    out = quality_forest.quality_rules(docs, labels, sample_rows=200, contamination=0.1)
    assert all(100 < n < 400 for n in grown), grown
    got = out.agg(F.count("*").alias("n"), F.sum((F.col("n_symbols") > 40).cast("int")).alias("junk"), F.sum(((F.col("n_symbols") > 40) & F.col("kept")).cast("int")).alias("left"), F.sum(F.col("kept").cast("int")).alias("kept")).first()
    assert got.n == 930 and got.junk == 30 and got.left <= 15 and 750 < got.kept < 915


@pytest.mark.parametrize("doc_id", IDS)
def test_field_above_the_bound(spark, doc_id):
    rng = random.Random(5)
    some = lambda k: "".join(rng.choice("abcdefgh0123456789") for _ in range(k))
    rows = [(i, f"note {some(5)} mail {some(6)}@{some(5)}.org or password = {some(16)} from 10.0.{i % 256}.7 item {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, text string").select(F.expr(doc_id).alias("doc_id"), "text")
    full, part = pii_semicrf.fit(docs), pii_semicrf.fit(docs, sample_docs=150)
    few = pii_semicrf.fit(docs, sample_docs=600, sample_features=3_000)
    for field in (full, part, few):
        assert np.abs(field.weights).max() > 0.1
        base, spans = pii_semicrf.all_spans("reach me at token = abcd1234efgh5678 now", field)
        assert not base and [s[0] for s in spans] == ["secret"]


def test_one_rated_id_on_all_rows(spark):
    rng = random.Random(6)
    rows = [(7 if i % 2 else 8, " ".join(rng.choice(["good", "fine", "calm"] if i % 2 else ["bad", "vile", "rude"]) for _ in range(9)) + f" {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 2.0), (8, 0.0), (None, 1.0)], "doc_id long, grade double")
    seen = []
    train = ordinal_quality.train
    try:
        ordinal_quality.train = lambda flat, *a, **k: (seen.append(len(flat)), train(flat, *a, **k))[1]
        out = ordinal_quality.graded_quality(docs, labels, F.col("grade"), features_per_grade=1_000).collect()
    finally:
        ordinal_quality.train = train
    assert 800 < seen[0] < 3_500
    assert all(r.kept == (r.doc_id == 7) and (r.expected_grade > 1) == (r.doc_id == 7) for r in out)


# ---- the ordinal fit, against its own conditions and plain probabilities


def _rated(seed, n=300, m=40):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random(m) < 0.4, rng.normal(0, 1.5, m), 0)
    x = rng.random((n, m)) < 0.3
    s = x @ w
    u = rng.logistic(size=n)
    y = (s + u > -1).astype(int) + (s + u > 1)
    return x, y


def test_fit_is_the_optimum():
    x, y = _rated(1)
    n, m = x.shape
    rows, cols = np.nonzero(x)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    l1 = 5e-3
    model = ordinal_quality.train(cols.astype(np.int64), cuts, y, np.array([0.0, 1.0, 2.0]), l1=l1, min_docs=1, rounds=4000)
    w, theta = model.weights[:m], model.thresholds

    def loss(w, theta):
        f = lambda t: 1 / (1 + np.exp(-(t - x @ w)))
        p = np.stack([f(theta[0]), f(theta[1]) - f(theta[0]), 1 - f(theta[1])], 1)
        return -np.log(p[np.arange(n), y]).mean()

    h = 1e-6
    slope = np.array([(loss(w + h * e, theta) - loss(w - h * e, theta)) / (2 * h) for e in np.eye(m)])
    cuts_slope = np.array([(loss(w, theta + h * e) - loss(w, theta - h * e)) / (2 * h) for e in np.eye(2)])
    assert np.abs(cuts_slope).max() < 2e-3 and theta[0] < theta[1]
    on = w != 0
    assert 5 < on.sum() < m
    assert np.abs(slope[on] + l1 * np.sign(w[on])).max() < 2e-3 and np.abs(slope[~on]).max() < l1 + 2e-3
    best = loss(w, theta) + l1 * np.abs(w).sum()
    rng = np.random.default_rng(2)
    for _ in range(200):
        other = w + rng.normal(0, 0.05, m) * (rng.random(m) < 0.2)
        cut = np.sort(theta + rng.normal(0, 0.05, 2))
        assert loss(other, cut) + l1 * np.abs(other).sum() > best - 1e-4


def _features(text):
    """Plain descriptions of a text's features."""
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    words = [low(w) for w in re.findall(r"[^\s!-/:-@\[-`{-~]+", text, re.ASCII)]
    out = {("w", w) for w in words}
    out |= {(k, w.encode()[:k]) for w in words for k in (4, 5) if len(w.encode()) > k}
    return out | {("p", p) for p in re.findall(r"[!-/:-@\[-`{-~]+", text)}


def test_features_stand_for_words_beginnings_and_marks():
    import pyarrow as pa

    from stratavox.llm import text as tx

    rng = random.Random(8)
    texts = ["".join(rng.choice(["Ab", "abc", "thing", "things", "été", " ", " ", "\n", "!", "?!", "x", "WORD"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    raw, offs = tx.string_buffers(pa.array(texts))
    t, f = ordinal_quality.distinct(*ordinal_quality.features(raw, offs))
    meant = {}
    for k, text in enumerate(texts):
        got, want = set(f[t == k].tolist()), _features(text)
        assert len(got) <= len(want) + 2 and len(got) >= len(want)  # two levels, which may share a bucket
        meant[k] = (got, want)
    for a in range(0, 150, 3):
        for b in range(1, 150, 7):
            shared = len(meant[a][1] & meant[b][1])
            assert shared <= len(meant[a][0] & meant[b][0]) <= shared + 2


def test_expected_grade_and_tail_from_plain_probabilities(spark, monkeypatch):
    rows = [(i, " ".join(["good"] * (i % 3 == 2) + ["mid"] * (i % 3 == 1) + ["poor"] * (i % 3 == 0)) + f" n{i % 11}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float((i % 3) ** 2)) for i in range(300)], "doc_id long, grade double")
    kept = []
    train = ordinal_quality.train
    monkeypatch.setattr(ordinal_quality, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    out = ordinal_quality.graded_quality(docs, labels, F.col("grade"), keep_grade=1.0, min_tail=0.6).collect()
    model = kept[0]
    import pyarrow as pa

    from stratavox.llm import text as tx

    text = dict(rows)
    for r in out[:60]:
        raw, offs = tx.string_buffers(pa.array([text[r.doc_id]]))
        s = model.weights[sorted(set(ordinal_quality.features(raw, offs)[1].tolist()))].sum()
        below = [*(1 / (1 + np.exp(-(model.thresholds - s)))), 1.0]
        p = np.diff([0.0, *below])
        assert abs(r.expected_grade - p @ model.grades) < 1e-9 and abs(r.p_tail - (p[1] + p[2])) < 1e-9 and r.kept == (r.p_tail >= 0.6)
    assert model.grades.tolist() == [0.0, 1.0, 4.0]
