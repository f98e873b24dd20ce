"""Mixing sources to target weights by temperature, with DataFrame operations only.

Source token shares p are raised to an exponent a and normalised. The exponent is the largest in [0, 1] (nearest the
natural shares) that meets the target entropy, unless the limit on repetitions of any source forces it closer to 1.
The interval is bisected over the table of sources itself: each pass evaluates, in one aggregate, all the midpoints of
`STEPS` successive halvings, so any number of sources works and only scalars reach the driver.

The weights are realised as budgeted block permutations: every source's documents follow a seeded permutation, drawn
anew for each repetition, until the source's share of the budget is used; the streams are cut into blocks of
`block_tokens` tokens that each hold every source at its weight, and a block's rows are permuted. Without a budget,
the smallest one that uses every document at least once is taken, so no document is dropped.

Scale: texts are not moved to plan the mix; rows are (source, id, tokens). A source's running token count is a prefix sum over hash
ranges of a few thousand rows each (range totals first, then within a range), so a source with a third of all rows is
spread over its ranges.

Defined cases: rows with the same source and id are one document and stay together; a null source is a source, a null
id an id; null texts and texts without words have no tokens and appear where their hash falls; sources without any
token are taken once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Halvings evaluated by one pass, and passes: 30 halvings in all.
STEPS, PASSES = 5, 6
RANGE_ROWS = 4096


@dataclass(frozen=True)
class Mix:
    """The exponent found, the budget in tokens and the number of blocks."""

    exponent: float
    budget: float
    blocks: int


def word_tokens(text: str = "text") -> Column:
    """Words of a text as a stand-in for its tokens."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _bisect(sources: DataFrame, holds) -> float:
    """The largest a in [0, 1] for which holds(row of sums at a) is true, given that it is true for all smaller a.

    A row has z = sum p^a, e = sum p^a ln p, least and most = extreme p^(a-1).
    """
    low, high = 0.0, 1.0
    for turn in range(PASSES):
        cuts = [low + (high - low) * k / 2**STEPS for k in range(0 if turn == 0 else 1, 2**STEPS + (turn == 0))]
        p = F.col("p")
        sums = []
        for k, a in enumerate(cuts):
            power = F.pow(p, F.lit(a))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(p)).alias(f"e{k}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"least{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"most{k}")]
        row = sources.agg(*sums).first()
        good = [holds(a, {x: row[f"{x}{k}"] for x in ("z", "e", "least", "most")}) for k, a in enumerate(cuts)]
        if turn == 0:
            if good[-1]:
                return 1.0
            if not good[0]:
                return 0.0
        last = max((a for a, g in zip(cuts, good) if g), default=low)
        low, high = last, last + (high - low) / 2**STEPS
    return low


def plan(docs: DataFrame, tokens: Column, target_entropy: float | None, max_repeats: float | None, budget: float | None = None, block_tokens: int = 1_000_000, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, DataFrame, Mix]:
    """(slim rows, sources, mix). sources: source, total, docs, p, repeats, whole, part (tokens of the last repetition)."""
    import math

    slim = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), tokens.alias("tokens"))
    slim = written(slim.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")), "mixrows")
    totals = slim.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"))
    row = totals.where("total > 0").agg(F.sum("total").alias("all"), F.count("*").alias("n")).first()
    every, n = row["all"] or 0, row["n"]
    sources = written(totals.withColumn("p", F.when(F.col("total") > 0, F.col("total") / F.lit(float(max(every, 1))))), "mixsources")
    live = sources.where("total > 0")
    exponent = 1.0
    if n and target_entropy is not None:
        want = target_entropy * math.log(n)
        exponent = _bisect(live, lambda a, r: math.log(r["z"]) - a * r["e"] / r["z"] >= want)
    if n and max_repeats is not None:
        # repetitions fall with a: find where the limit stops being broken
        broken = lambda a, r: (r["most"] / r["least"] if budget is None else r["most"] * budget / (r["z"] * every)) > max_repeats
        exponent = max(exponent, _bisect(live, broken))
    exponent = round(exponent, 6)
    power = F.pow(F.col("p"), F.lit(exponent - 1))
    ends = live.agg(F.min(power).alias("least"), F.sum(F.pow(F.col("p"), F.lit(exponent))).alias("z")).first()
    scale = (1 / ends["least"] if budget is None else budget / (ends["z"] * every)) if n else 1.0
    repeats = F.coalesce(F.round(power * F.lit(scale), 9), F.lit(1.0))
    sources = sources.withColumn("repeats", repeats).withColumn("whole", F.floor("repeats").cast("int"))
    sources = sources.withColumn("part", F.floor((F.col("repeats") - F.col("whole")) * F.col("total")).cast("long"))
    spent = sources.agg(F.sum(F.col("whole") * F.col("total") + F.col("part"))).first()[0] or 0
    return slim, sources, Mix(exponent, float(spent), max(1, math.ceil(spent / block_tokens)))


def blocks(slim: DataFrame, sources: DataFrame, mix: Mix, seed: int = 1) -> DataFrame:
    """(doc_id, source, copy, tokens, block, position): the documents of each block, in the block's order."""
    rows = slim.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = rows.withColumn("digest", digest).withColumn("k", number(1)).withColumn("shuffle", number(16)).drop("digest")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(RANGE_ROWS)))).cast("int")
    rows = rows.withColumn("bits", bits).withColumn("range", F.expr("shiftright(k, 60 - bits)"))
    keys = ["source", "copy"]
    ranges = rows.groupBy(*keys, "range").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "range")), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("copy") == F.col("_copy")) & (F.col("range") == F.col("_range")))
    inside = Window.partitionBy(*keys, "range").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    rows = rows.where((F.col("copy") < F.col("whole")) | (F.col("at") < F.col("part")))
    place = (F.col("copy") * F.col("total") + F.col("at")).cast("decimal(38,0)")
    quota = F.col("whole") * F.col("total") + F.col("part")
    rows = rows.withColumn("place", place).withColumn("quota", quota)
    block = F.expr(f"CASE WHEN quota > 0 THEN least({mix.blocks - 1}L, CAST(place * {mix.blocks} AS DECIMAL(38,0)) div CAST(quota AS DECIMAL(38,0))) ELSE k % {mix.blocks} END")
    rows = rows.withColumn("block", block.cast("long"))
    order = Window.partitionBy("block").orderBy("shuffle", "doc_id", "source", "copy")
    return rows.select("doc_id", "source", "copy", "tokens", "block", F.row_number().over(order).cast("long").alias("position"))


def mixed(docs: DataFrame, tokens: Column, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, block_tokens: int = 1_000_000, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The block permutations of the mix: (doc_id, source, copy, tokens, block, position)."""
    return blocks(*plan(docs, tokens, target_entropy, max_repeats, budget, block_tokens, seed, id_col, source_col), seed)


def arranged(docs: DataFrame, mix_rows: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents with their own columns, each as often as the mix has it, block after block in the blocks' orders:
    partitions are ranges of that order and sorted, so the files that are written of it hold it too."""
    mix = mix_rows.select(*(F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "source", "block", "position")))
    both = docs.join(mix, F.col(id_col).eqNullSafe(F.col("__mix_doc_id")) & F.col(source_col).eqNullSafe(F.col("__mix_source")))
    return both.repartitionByRange("__mix_block", "__mix_position").sortWithinPartitions("__mix_block", "__mix_position").select(docs.columns)
