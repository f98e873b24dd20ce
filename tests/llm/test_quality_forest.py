"""Forests and thresholds of all rows: nothing of op5 comes from a sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import quality_forest as qf

SCORES = [f"anomaly_{g}" for g in qf.GROUPS]


@pytest.fixture(scope="module")
def many(spark):
    """45,000 documents of varying words, symbols and lengths: more than any sample op5 used to take."""
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    words = F.transform(F.sequence(F.lit(1), pick(1, 60) + 11), lambda j: F.concat(F.substring(F.md5(F.concat(F.col("id"), F.lit(":"), j)), 1, F.pmod(F.xxhash64("id", j), F.lit(9)).cast("int") + 2), F.repeat(F.lit("#"), F.when(pick(2, 25) == 0, pick(3, 4)).otherwise(0))))
    return spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))


def threshold_verdicts(rows, thresholds):
    inside = np.logical_and.reduce([rows[c].to_numpy() <= t for c, t in thresholds.items()])
    return ~rows.base_failed.to_numpy() & inside


def test_thresholds_of_all_labelled_rows(spark, many):
    labels = spark.range(45_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(25)) != 0).cast("int").alias("quality"))
    rows = qf.quality_rules(many, labels, max_loss=0.03).join(labels, "doc_id").toPandas()
    judged = rows[~rows.base_failed]
    good = judged.quality.to_numpy() > 0
    want = {c: qf.calibrate(judged[c].to_numpy(), good, 0.01) for c in SCORES}
    assert len(rows) == 45_000 and (rows.kept == threshold_verdicts(rows, want)).all()
    for c, t in want.items():
        assert (judged[c].to_numpy()[good] > t).mean() <= 0.01


def test_quantiles_of_all_rows_without_labels(spark, many):
    rows = qf.quality_rules(many, spark.createDataFrame([], "doc_id long, quality int"), contamination=0.1).toPandas()
    judged = rows[~rows.base_failed]
    want = {c: np.quantile(judged[c].to_numpy(), 1 - 0.1 / 3) for c in SCORES}
    assert (rows.kept == threshold_verdicts(rows, want)).all()


def test_every_row_grows_a_tree(spark, many):
    """The forest grows with the table, is the same under any ids and partitions, and each leaf counts its own rows."""
    rows = qf.statistics(many).where("n_words >= 10").persist()
    n = rows.count()
    forests = qf.grow_all(rows)
    assert all(abs(f.trees - n / 32) < 5 for f in forests.values())
    other = qf.grow_all(rows.withColumn("doc_id", F.lit(None).cast("long")).repartition(13))
    assert all((forests[g].paths == other[g].paths).all() for g in qf.GROUPS)
    # one row more, within the others' bounds, moves its tree's leaves
    more = qf.grow_all(rows.unionByName(rows.where("doc_id = 7")))
    assert more["marks"].trees == forests["marks"].trees
    assert (forests["marks"].paths != more["marks"].paths).any()
    rows.unpersist()


def test_leaves_against_walked_rows():
    rng = np.random.default_rng(2)
    tree = np.sort(rng.integers(0, 40, 900))
    x = np.minimum(rng.geometric(0.2, (900, 2)), 15)
    low, high, path = qf.leaves(x, tree, 16, 5, 3)
    assert ((high - low).prod(1).sum() == 16 * 16 * len(np.unique(tree))) and (high > low).all()
    # trees one by one give the same leaves, which share out the grid and hold the tree's rows
    apart = [qf.leaves(x[tree == t], tree[tree == t], 16, 5, 3) for t in np.unique(tree)]
    key = lambda a, b, c: sorted(zip(map(tuple, a), map(tuple, b), c))
    assert key(low, high, path) == sorted(leaf for part in apart for leaf in key(*part))
    for t, (a, b, c) in zip(np.unique(tree), apart):
        mine = x[tree == t]
        held = [int(((mine >= p) & (mine < q)).all(1).sum()) for p, q in zip(a, b)]
        assert sum(held) == len(mine) and min(held) >= 1
        depth = c - np.array([qf._expected(k) for k in held])
        assert np.allclose(depth, np.rint(depth)) and depth.max() <= 5 and np.isclose((0.5 ** depth).sum(), 1)
    corners = np.zeros((17, 17), np.int64)
    qf.add_leaves(corners, low, high, path)
    sums = np.cumsum(np.cumsum(corners, 0), 1) / 1e6
    for cell in rng.integers(0, 16, (30, 2)):
        inside = ((cell >= low) & (cell < high)).all(1)
        assert inside.sum() == len(apart) and abs(sums[tuple(cell)] - path[inside].sum()) < 1e-3
    assert not sums[16].any() and not sums[:, 16].any()


def test_copies_without_ids_spread_over_trees(spark):
    docs = spark.range(9_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 8_800, "a b c d e f g h i j k l").otherwise(F.concat(F.lit("# one two three four five six seven eight nine ten "), F.col("id"))).alias("text"))
    got = qf.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"), contamination=0.2).groupBy("n_symbols").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("anomaly_marks").alias("score")).toPandas().set_index("n_symbols")
    assert got.n.to_dict() == {0: 8_800, 1: 200} and got.kept[0] == 8_800 and got.kept[1] == 0
    assert got.score[1] > got.score[0]
    assert qf.grow_all(qf.statistics(docs))["marks"].trees == 400


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(k, f"a few words that make a text of more than ten words {k}") for k in range(n)] + [(9, "short"), (10, None)], "doc_id long, text string")
    got = qf.quality_rules(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).collect()
    assert len(got) == n + 2 and sum(r.kept for r in got) == n and all(0 <= r[c] <= 1 for r in got for c in SCORES)
